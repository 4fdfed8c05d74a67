"""Trust, tremor, velocity, heat, decay and history ledgers over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def trust(events: DataFrame, now: float, half_life_hours: float = 720.0, risk_cap: float = 3.0) -> DataFrame:
    """Per key: defect density, recency, trust, risk multiplier, tier. ``events``: key, kind, ts (epoch seconds)."""
    bad = F.col("kind") == "defect"
    c = events.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("defects"), F.count_if(F.col("kind") == "false_alarm").alias("false_alarms"), F.max(F.when(bad, F.col("ts"))).alias("last_defect"))
    hours = F.greatest((F.lit(float(now)) - F.col("last_defect")) / 3600.0, F.lit(0.0))
    recency = F.coalesce(F.exp(-LN2 * hours / half_life_hours), F.lit(0.0))
    density = F.col("defects") / F.col("total")
    w = density * (0.3 + 0.7 * recency)
    score = F.greatest(1 - w, F.lit(0.05))
    tier = F.when(F.col("trust") < 0.4, "High").when(F.col("trust") < 0.7, "Medium").otherwise("Low")
    return c.select("key", "total", "defects", "false_alarms", score.alias("trust"), F.least(1 + 2 * w, F.lit(risk_cap)).alias("risk")).withColumn("tier", tier)


def trust_report(scores: DataFrame) -> DataFrame:
    """Nodes and mean trust by tier."""
    return scores.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("trust").alias("mean_trust"))


def adjust_prior(prior: float, scores: DataFrame, positive: bool) -> DataFrame:
    """One row: the prior by mean trust (or risk), within 0 and 0.95."""
    factor = F.avg("trust" if positive else "risk")
    return scores.agg(F.least(F.greatest(F.lit(float(prior)) * F.coalesce(factor, F.lit(1.0)), F.lit(0.0)), F.lit(0.95)).alias("adjusted"))


def ring(events: DataFrame, key: str, order: str, size: int = 256, tie: str | None = None) -> DataFrame:
    """The newest ``size`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *([F.desc(tie)] if tie else []))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def _apart(rows: DataFrame, gap: float) -> DataFrame:
    """Rows (key, ts, ...) without those less than ``gap`` behind the last kept one of their key; sorted rows pass by, none are gathered."""

    def kept(batches):
        key, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["ts"]):
                keep.append(last is None or k != key or t - last >= gap)
                if keep[-1]:
                    key, last = k, t
            yield batch[keep]

    dealt = rows.repartition("key").sortWithinPartitions("key", *[F.asc_nulls_last(c) for c in rows.columns if c != "key"])
    return dealt.mapInPandas(kept, rows.schema)


def tremor(observations: DataFrame, now: float | None = None, window_days: int | None = None, least_observations: int = 3, least_gap: float = 1.0, newest: int | None = None) -> DataFrame:
    """Acceleration of change. ``observations``: key, ts, delta, edge_events.

    All observations count, or the ``newest`` of each key. Those within ``least_gap``
    seconds of the last kept one are dropped (a
    greedy fold over the sorted series; 0 keeps all); velocities are the deltas over their time
    step of at least a second, accelerations the change of velocities.  Accelerations at one time alone have
    no slope (NaN); without any it is 0.
    """
    if window_days is not None:
        observations = observations.where(F.col("ts") >= float(now) - 86400.0 * window_days)
    if newest is not None:
        observations = ring(observations, "key", "ts", newest, "delta")
    rows = observations.select("key", "ts", "delta", "edge_events")
    if least_gap > 0:
        rows = _apart(rows, least_gap)
    w = Window.partitionBy("key").orderBy(*[F.asc_nulls_last(c) for c in ("ts", "delta", "edge_events")])
    rows = rows.withColumn("i", F.row_number().over(w) - 1)
    rows = rows.withColumn("dt", F.greatest(F.col("ts") - F.lag("ts").over(w), F.lit(1.0))).withColumn("v", F.col("delta") / F.col("dt"))
    rows = rows.withColumn("a", F.when(F.col("i") > 1, (F.col("v") - F.lag("v").over(w)) / F.col("dt")))
    s = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_acceleration"), F.regr_slope(F.col("a"), F.col("ts")).alias("slope"), F.count("a").alias("n_a"), F.sum("edge_events").alias("edge_events")).where(F.col("n") >= least_observations)
    magnitude = F.least(F.abs("mean_acceleration") * F.sqrt(F.col("edge_events").cast("double")), F.lit(100.0))
    tier = F.when(F.col("magnitude") >= 10, "Critical").when(F.col("magnitude") >= 1, "High").when(F.col("magnitude") >= 0.1, "Medium").otherwise("Low")
    return s.select("key", "n", F.coalesce("mean_acceleration", F.lit(0.0)).alias("mean_acceleration"), F.coalesce("slope", F.when(F.col("n_a") > 0, F.lit(float("nan"))), F.lit(0.0)).alias("slope"), F.coalesce(magnitude, F.lit(0.0)).alias("magnitude")).withColumn("tier", tier)


def velocity(values: DataFrame, least: float = 0.1) -> DataFrame:
    """z-scores of a frequency over all keys: key, z, trend. ``values``: key, frequency."""
    s = values.agg(F.avg("frequency").alias("mean"), F.stddev_pop("frequency").alias("dev"))
    z = (F.col("frequency") - F.col("mean")) / F.greatest(F.col("dev"), F.lit(0.01))
    out = values.crossJoin(F.broadcast(s)).select("key", z.alias("z")).where(F.abs("z") > least)  # one row
    return out.withColumn("trend", F.when(F.col("z") > 0.5, "Accelerating").when(F.col("z") < -0.5, "Decelerating").otherwise("Stable"))


def runtime_heat(spans: DataFrame, key: str, batch: str, last_batch: Column, decay: float = 0.9) -> DataFrame:
    """Per node: heat, invocations, errors, mean and longest duration. ``spans``: duration_us, count, is_error."""
    one = F.log1p(F.col("count")) * (1 + F.col("duration_us") / 1e6) * F.pow(F.lit(decay), last_batch - F.col(batch))
    return spans.groupBy(key).agg(
        F.least(F.sum(one), F.lit(10.0)).alias("heat"), F.sum("count").alias("invocations"), F.sum(F.when(F.col("is_error"), F.col("count")).otherwise(0)).alias("errors"),
        F.avg("duration_us").alias("mean_us"), F.max("duration_us").alias("max_us"),
    )


def decay_score(age_hours: Column, half_life_hours: Column, dormant_hours: Column | None = None) -> Column:
    """Exponential decay of at least 1e-6; a node that slept over 720 h wakes at 0.3 + 0.1 ln(depth + 1)."""
    raw = F.greatest(F.exp(-LN2 * F.greatest(age_hours, F.lit(0.0)) / half_life_hours), F.lit(1e-6))
    if dormant_hours is None:
        return raw
    depth = dormant_hours / 720.0
    floor = F.least(F.greatest(0.3 + 0.1 * F.log(depth + 1), F.lit(0.0)), F.lit(1.0))
    return F.when(dormant_hours > 720, F.greatest(raw, floor)).otherwise(raw)


def change_groups(commits: DataFrame, least: int = 2) -> DataFrame:
    """Commits that touch several files: (commit, files). ``commits``: commit, file."""
    return commits.groupBy("commit").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files") >= least)


def co_change(commits: DataFrame, most_files: int | None = None) -> DataFrame:
    """(a, b, times, strength): pairs of files in one commit over the larger file count.

    The pair join is by commit, and a commit's files are few by nature.
    ``most_files``: leave out commits of more files (bulk moves); none by default.
    """
    files = commits.select("commit", "file").distinct()
    if most_files is not None:
        size = files.groupBy("commit").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most_files)
        files = files.join(size.select("commit"), "commit", "left_semi")
    n = commits.select("commit", "file").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    x, y = files.alias("x"), files.alias("y")
    pairs = x.join(y, (F.col("x.commit") == F.col("y.commit")) & (F.col("x.file") < F.col("y.file"))).groupBy(F.col("x.file").alias("a"), F.col("y.file").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    out = pairs.join(n.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "times", (F.col("times") / F.greatest("na", "nb")).alias("strength"))


def ghost_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Co-changed pairs without an edge either way; strength = times / most, in [0.1, 1]. ``edges``: (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loose = pairs.join(both, ["a", "b"], "left_anti")
    top = loose.agg(F.max("times").alias("top"))
    return loose.crossJoin(F.broadcast(top)).select("a", "b", "times", F.least(F.greatest(F.col("times") / F.col("top"), F.lit(0.1)), F.lit(1.0)).alias("strength"))


def coupling_changes(before: DataFrame, after: DataFrame, least: float = 0.15, top: int = 20) -> DataFrame:
    """Pairs whose strength changed: (a, b, delta, kind)."""
    j = before.select("a", "b", F.col("strength").alias("s0")).join(after.select("a", "b", F.col("strength").alias("s1")), ["a", "b"], "full_outer")
    d = F.coalesce("s1", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0))
    kind = F.when(F.col("s0").isNull(), "new_coupling").when(F.col("delta") > 0, "strengthened").otherwise("weakened")
    return j.withColumn("delta", d).where(F.abs("delta") > least).select("a", "b", "delta", kind.alias("kind")).orderBy(F.desc(F.abs("delta")), "a", "b").limit(top)


def churn(changes: DataFrame) -> DataFrame:
    """Per key: changes, added, deleted, pattern by time-halves, stability. ``changes``: key, ts, added, deleted."""
    w = Window.partitionBy("key")
    mid = (F.min("ts").over(w) + F.max("ts").over(w)) / 2
    c = changes.withColumn("late", (F.col("ts") > mid).cast("long")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    early = F.col("n") - F.col("late")
    speed = F.when(F.col("late") > 1.5 * early, "accelerating").when(early > 1.5 * F.col("late"), "decelerating").otherwise("stable")
    pattern = (
        F.when(F.col("n") <= 1, "dormant").when(F.col("added") > 2 * F.col("deleted"), "expanding").when(F.col("deleted") > 2 * F.col("added"), "shrinking")
        .when(F.col("added") + F.col("deleted") > 100, "churning").otherwise("stable")
    )
    return c.select("key", "n", "added", "deleted", speed.alias("velocity"), pattern.alias("pattern"), (1 / (1 + F.col("n") / 10.0)).alias("stability"))


def query_memory(log: DataFrame, size: int = 1000) -> DataFrame:
    """The newest queries that are remembered. ``log``: seq, ..."""
    return log.orderBy(F.desc("seq")).limit(size)


def priming(log: DataFrame, seeds: list[int], boost: float = 0.15, memory: int = 1000, top: int = 50) -> DataFrame:
    """Nodes activated together with the seeds in the last queries: (node_id, boost). ``log``: seq, seeds, activated."""
    last = query_memory(log, memory)
    hit = last.where(F.arrays_overlap("seeds", F.array(*[F.lit(s).cast("long") for s in seeds])))
    n = hit.select(F.explode("activated").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select("node_id", (F.col("n") / F.col("most") * boost).alias("boost")).orderBy(F.desc("boost"), "node_id").limit(top)
