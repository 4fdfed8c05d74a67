"""Tiered lookups, views, truncation, hotspots, timelines, co-occurrence, and reloading of learnt weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.text import lines


def view(docs: DataFrame, key: str, text: str, path, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(line_no, line) of one document from an offset on."""
    rows = lines(docs.where(F.col(key) == path), key, text).where(F.col("line_no") > offset)
    return (rows.where(F.col("line_no") <= offset + limit) if limit else rows).select("line_no", "line")


def resolve_tiered(nodes: DataFrame, target: str, preferred_types: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """(external_id, tier): exact id, else label, else an ``::`` part, else inside the id; the first tier that has any."""
    low = target.lower()
    tier = (
        F.when(F.col("external_id") == target, 0).when(F.lower("label") == low, F.when(F.col("node_type").isin(*preferred_types), 1).otherwise(2))
        .when(F.array_contains(F.split(F.lower("external_id"), "::"), low), 3).when(F.lower("external_id").contains(low) | F.lower("label").contains(low), 4)
    )
    found = nodes.select("external_id", tier.alias("tier")).where("tier IS NOT NULL")
    return found.groupBy("tier").agg(F.min("external_id").alias("external_id")).orderBy("tier").limit(1).select("external_id", "tier")


def truncate(rows: DataFrame, group: str, order: str, text: str, most_chars: int) -> DataFrame:
    """The first rows of each group whose running length stays within a number of characters."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_chars", F.sum(F.length(text)).over(w)).where(F.col("_chars") <= most_chars).drop("_chars")


def hotspot(trust_risk: Column, tremor: Column, pattern: Column, blast: Column | None = None) -> Column:
    """Heat in 0..1: 0.5/0.3/0.2 for plans, 0.4/0.25/0.15/0.2 with blast for surfaces."""
    heat = 0.5 * trust_risk + 0.3 * tremor + 0.2 * pattern if blast is None else 0.4 * trust_risk + 0.25 * tremor + 0.15 * pattern + 0.2 * blast
    return F.least(F.greatest(heat, F.lit(0.0)), F.lit(1.0))


def subgraph(edges: DataFrame, active: DataFrame, top: int) -> DataFrame:
    """Edges among the ``top`` strongest nodes. ``active``: node_id, activation."""
    best = active.orderBy(F.desc("activation"), "node_id").limit(top).select("node_id")
    e = edges.join(F.broadcast(best.withColumnRenamed("node_id", "src")), "src", "left_semi")  # `top` rows
    return e.join(F.broadcast(best.withColumnRenamed("node_id", "dst")), "dst", "left_semi")


def coupling_delta(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """(community, delta) where the share of crossing edges moved. Both: community, coupling."""
    j = before.select("community", F.col("coupling").alias("c0")).join(after.select("community", F.col("coupling").alias("c1")), "community", "full_outer")
    return j.select("community", (F.coalesce("c1", F.lit(0.0)) - F.coalesce("c0", F.lit(0.0))).alias("delta")).where(F.abs("delta") > least)


def anomalies(files: DataFrame, spike: float = 3.0) -> DataFrame:
    """(path, anomaly): growth beyond ``spike`` times, sources without tests, tests without sources.

    ``files``: path, stem, is_test, added, previous.
    """
    tests = files.where("is_test").select(F.regexp_replace("stem", "^test_|_test$", "").alias("stem")).distinct().withColumn("t", F.lit(1))
    sources = files.where("NOT is_test").select("stem").distinct().withColumn("s", F.lit(1))
    lone = files.where("NOT is_test").join(tests, "stem", "left").where("t IS NULL").select("path", F.lit("test_deficit").alias("anomaly"))
    orphan = files.where("is_test").withColumn("stem", F.regexp_replace("stem", "^test_|_test$", "")).join(sources, "stem", "left").where("s IS NULL").select("path", F.lit("orphan_test").alias("anomaly"))
    fast = files.where(F.col("added") > spike * F.greatest(F.col("previous"), F.lit(1))).select("path", F.lit("velocity_spike").alias("anomaly"))
    return lone.unionByName(orphan).unionByName(fast)


def ppmi(pairs: DataFrame) -> DataFrame:
    """(a, b, ppmi): positive pointwise mutual information (natural log) of weighted pairs. ``pairs``: a, b, n."""
    total = pairs.agg(F.sum("n").alias("t"))
    a, b = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    v = F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    return pairs.join(a, "a").join(b, "b").crossJoin(F.broadcast(total)).select("a", "b", v.alias("ppmi")).where("ppmi > 0")  # one row


def reload_weights(edges: DataFrame, saved: DataFrame, floor: float = 0.05, cap: float = 3.0) -> DataFrame:
    """Edges with learnt weights put back by (src, dst, relation), within bounds."""
    s = saved.select("src", "dst", "relation", F.least(F.greatest("weight", F.lit(floor)), F.lit(cap)).alias("_w"))
    return edges.join(s, ["src", "dst", "relation"], "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w")


def normalise_ghost(strength: Column) -> Column:
    return F.sqrt(F.greatest(strength, F.lit(0.0)))


def hop_closeness(hop: Column) -> Column:
    return 1 / (1 + hop)


def path_coherence(weights: Column) -> Column:
    """Geometric mean of a path's weights over 1 + 0.1 (n - 1)."""
    n = F.size(weights)
    mean = F.exp(F.aggregate(weights, F.lit(0.0), lambda s, x: s + F.log(x)) / n)
    return F.when(n > 0, mean / (1 + 0.1 * (n - 1)))


def savings(log: DataFrame) -> DataFrame:
    """One row: calls, items and the ratio saved. ``log``: manual, used."""
    a = log.agg(F.count(F.lit(1)).alias("calls"), F.sum("manual").alias("manual"), F.sum("used").alias("used"))
    return a.select("calls", "manual", "used", F.when(F.col("manual") > 0, 1 - F.col("used") / F.col("manual")).otherwise(0.0).alias("saved"))
