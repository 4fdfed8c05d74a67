"""Intermediate tables and global ranks that survive the loss of executors.

Everything here goes through the folder named by ``spark.checkpoint.dir``,
which all executors share.  The setting is read from the session; only a session
on ``local[...]``, which has no other machine, may leave it unset.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and bytes of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20

#: Bytes of a row group of an intermediate table: what a task holds of it to write or read it.
ROW_GROUP_BYTES = 8 << 20

#: Whether the shuffle files of a query are deleted at its end, not when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one where that is unset and all work is on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    For wide or large intermediates: columnar and compressed, unlike a
    checkpoint.  ``files``: at most so many (a number that follows the rows).
    The shuffle files of the write go with it; the folder goes with
    :func:`dropped`, else when the driver's process ends.
    """
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = scratch(spark, name)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete what :func:`stored` wrote for ``df``; nothing that is still to be computed may read it."""
    path = getattr(df, "_stored_at", None)
    if path:
        delete(df.sparkSession, path)
        _made[:] = [m for m in _made if m[1] != path]


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Drop what is stored inside, but for the tables that are put into the list; what leaves must rest on those alone."""
    before, kept = {path for _, path in _made}, []
    yield kept
    stay = {getattr(df, "_stored_at", None) for df in kept}
    for _, path in [m for m in _made if m[1] not in before and m[1] not in stay]:
        delete(spark, path)
        _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            return


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows from files and between the JVM and Python, for wide rows in what runs inside."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {key: spark.conf.get(key) for key in keys}
    for key, now in before.items():
        spark.conf.set(key, str(min(rows, int(now)) if int(now) > 0 else rows))
    try:
        yield
    finally:
        for key, now in before.items():
            spark.conf.set(key, now)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 24
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
                return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + of(x, inner)), F.lit(0)) + 24
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 24
        if isinstance(kind, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(64 if isinstance(kind, T.MapType) else 8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(16)).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; no more rows than that are looked at."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0))).first()
    return n <= rows and held <= size


def checked_join(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``small`` broadcast only if it has at most ``rows`` rows and ``size`` bytes.

    ``small`` is measured first (it should be stored or cheap), so that what is
    broadcast has a bound; a larger side goes through a shuffle join.
    """
    return big.join(F.broadcast(small) if is_small(small, rows, size) else small, on, how)


#: Rows of one key of a join's right side that go to one task before they are dealt to several.
ROWS_A_KEY = 1 << 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = ROWS_A_KEY) -> DataFrame:
    """An inner join in which keys with more than ``rows`` rows on the right are dealt over several tasks.

    Such keys are few (all rows over ``rows``) and known by their counts; the left
    rows of one are repeated for each of its parts.
    """
    counts = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    hot = stored(counts.select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_salts")), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, on)
    known = F.coalesce("_salts", F.lit(1))
    a = checked_join(left, hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), known - 1))).drop("_salts")
    turn = F.pmod(F.xxhash64(*[c for c in right.columns if c not in on] or on), known.cast("long")).cast("int")
    b = checked_join(right, hot, on, "left").withColumn("_salt", turn).drop("_salts")
    return a.join(b, [*on, "_salt"]).drop("_salt")


def global_rank(df: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """Number all rows from 0 in the order of ``by``, without a one-task window.

    Rows are dealt by ranges of ``by`` and sorted inside each range; the driver
    gets one count for each range and hands back the ranges' offsets.  ``by``
    should be total, so that a frequent first key is split over many ranges.
    """
    spark = df.sparkSession
    held = cut(df.repartitionByRange(parts(spark), *by).sortWithinPartitions(*by))
    held = held.withColumn("_at", F.monotonically_increasing_id())
    pid, offset, starts = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1), {}
    total = 0
    for row in sorted(held.groupBy(pid.alias("p")).count().collect()):
        starts[row["p"]] = total
        total += row["count"]
    if not starts:
        return held.withColumn(rank, F.lit(0).cast("long")).drop("_at")
    size = max(starts) + 1
    base = F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(size)]) if size <= 512 else None
    if base is not None:
        return held.withColumn(rank, base[pid.cast("int")] + offset).drop("_at")
    table = spark.createDataFrame([(int(k), int(v)) for k, v in starts.items()], "_p long, _base long")
    joined = held.withColumn("_p", pid).join(F.broadcast(table), "_p")
    return joined.withColumn(rank, F.col("_base") + offset).drop("_at", "_p", "_base")
