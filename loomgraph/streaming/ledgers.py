"""Structured Streaming: trust counters, windows, incremental ingest, alerts; keyed state of other kinds is in :mod:`stateful`.

Windows over event time, watermarks and late-data handling are additions of
this library; the ledgers themselves only need processing order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.durable import delete

#: Buckets of the state that a stream of files keeps.
BUCKETS = 16


def trust_counters(events: DataFrame) -> DataFrame:
    """Update-mode counters by key: total, defects, last defect. ``events``: key, kind, ts."""
    bad = F.col("kind") == "defect"
    return events.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.sum(bad.cast("long")).alias("defects"), F.max(F.when(bad, F.col("ts"))).alias("last_defect"))


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window and type behind a watermark (``ts`` a timestamp)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def coalesced_changes(changes: DataFrame, debounce: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """Pending changes by path, one for each burst; the last kind wins. ``changes``: path, kind, ts."""
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", debounce), "path").agg(F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("at"))


def tick(tracked: DataFrame, live: DataFrame, most: int | None = 32) -> DataFrame:
    """One maintenance step: (path, change) of files that appeared, changed or went, newest first (``most`` None: all, in no order). Columns: path, size, mtime, hash."""
    t = tracked.select("path", F.struct("size", "mtime", "hash").alias("t"))
    n = live.select("path", "mtime", F.struct("size", "mtime", "hash").alias("n"))
    change = F.when(F.col("t").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("t") != F.col("n"), "modified")
    found = t.join(n, "path", "full_outer").select("path", change.alias("change"), F.coalesce("mtime", F.lit(0.0)).alias("mtime")).where("change IS NOT NULL")
    return found if most is None else found.orderBy(F.desc("mtime"), "path").limit(most)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))


def _manifest(spark: SparkSession, state_path: str, upto: int | None = None) -> tuple[int, dict[int, int]]:
    """Number of the newest manifest (below ``upto``), and the version of each bucket in it."""
    try:
        rows = spark.read.schema("bucket int, version int, v int").parquet(f"{state_path}/manifest")
    except AnalysisException:  # nothing is there yet
        return -1, {}
    rows = rows if upto is None else rows.where(F.col("v") < upto)
    last = rows.agg(F.max("v")).first()[0]
    if last is None:
        return -1, {}
    return last, {r["bucket"]: r["version"] for r in rows.where(F.col("v") == last).collect()}  # one row a bucket


def ingest_stream(source: DataFrame, state_path: str, checkpoint: str):
    """Upsert a stream of file rows (path, size, mtime, hash) into a state of ``BUCKETS`` buckets below ``state_path``.

    A batch rewrites the buckets that it touches as ``data/v=<batch>/bucket=<k>``
    and then writes the manifest of that number, so a retried batch writes the
    same again (exactly once).  Data that neither of the last two manifests
    names is deleted.  Read the state with :func:`ingested`.
    """
    spark = source.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        rows = _bucketed(batch.select("path", "size", "mtime", "hash")).persist()
        try:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
            _, now = _manifest(spark, state_path, number)
            old = [f"{state_path}/data/v={now[k]}/bucket={k}" for k in touched if k in now]
            whole = rows.unionByName(_bucketed(spark.read.schema(rows.drop("bucket").schema).parquet(*old))) if old else rows
            # the latest state of a path counts, whatever order batches bring them in
            new = whole.groupBy("bucket", "path").agg(F.max_by(F.struct("size", "mtime", "hash"), "mtime").alias("s")).select("bucket", "path", "s.*")
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/data/v={number}")
        finally:
            rows.unpersist()
        after = now | dict.fromkeys(touched, number)
        spark.createDataFrame(list(after.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/manifest/v={number}")
        for k in set(_manifest(spark, state_path, number - 1)[1].items()) - set(now.items()) - set(after.items()):
            delete(spark, f"{state_path}/data/v={k[1]}/bucket={k[0]}")

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def ingested(spark: SparkSession, state_path: str) -> DataFrame:
    """(path, size, mtime, hash): the state of the newest manifest."""
    _, now = _manifest(spark, state_path)
    return spark.read.parquet(*[f"{state_path}/data/v={v}/bucket={k}" for k, v in sorted(now.items())])


def alerts(found: DataFrame, acked: DataFrame, most: int = 500, include_acked: bool = False) -> DataFrame:
    """The newest alerts that nobody has acknowledged. ``found``: alert_id, ts, ...; ``acked``: alert_id."""
    rows = found if include_acked else found.join(acked, "alert_id", "left_anti")
    return rows.orderBy(F.desc("ts"), "alert_id").limit(most)


def lock_events(changes: DataFrame, lock: DataFrame) -> DataFrame:
    """Edge changes (src, dst, ...) that touch a lock's nodes (node_id)."""
    ids = lock.select("node_id").distinct()
    hit = changes.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return hit.unionByName(changes.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")).distinct()
