"""Perspectives, locks and trails: cursors and snapshots over the graph, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.traversal import induced, reach


def routes(g: PropertyGraph, focus: str, visited: list[str] | None = None) -> DataFrame:
    """(external_id, direction, relation, score): out-neighbours 0.6 weight + 0.4 novelty, in-neighbours 0.5 + 0.3."""
    me = g.seeds([focus]).select("node_id")
    e = g.expanded()
    out = e.join(me, e.src == me.node_id, "left_semi").select(F.col("dst").alias("node_id"), "relation", "weight", F.lit("out").alias("direction"))
    into = e.join(me, e.dst == me.node_id, "left_semi").select(F.col("src").alias("node_id"), "relation", "weight", F.lit("in").alias("direction"))
    rows = g.named(out.unionByName(into), "external_id", "label")
    new = F.when(F.col("external_id").isin(visited or [""]), 0.0).otherwise(1.0)
    score = F.when(F.col("direction") == "out", 0.6 * F.col("weight") + 0.4 * new).otherwise(0.5 * F.col("weight") + 0.3 * new)
    best = rows.withColumn("score", score).groupBy("external_id", "direction").agg(F.max_by("relation", F.struct("score", "relation")).alias("relation"), F.max("score").alias("score"))
    return best


def page(rows: DataFrame, number: int = 1, size: int = 6) -> DataFrame:
    """One page of routes in their total order."""
    size = min(max(size, 1), 10)
    return rows.orderBy(F.desc("score"), "external_id", "direction").offset((number - 1) * size).limit(size)


def suggest(g: PropertyGraph, focus: str, visited: list[str], cap: float = 0.85) -> DataFrame:
    """The best route not visited yet, with a capped confidence."""
    r = routes(g, focus, visited).where(~F.col("external_id").isin(visited or [""]))
    return r.orderBy(F.desc("score"), "external_id").limit(1).withColumn("confidence", F.least("score", F.lit(cap)))


def lock(g: PropertyGraph, roots: list[str], radius: int = 0) -> tuple[DataFrame, DataFrame]:
    """A baseline: the region's nodes and the edges inside it."""
    nodes = reach(g, g.seeds(roots), radius).select("node_id").distinct()
    return nodes, induced(g, nodes).select("src", "dst", "relation", "weight")


def lock_diff(baseline: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, n): nodes and edges that came, went or changed weight since the baseline."""
    (n0, e0), (n1, e1) = baseline, now
    key = ["src", "dst", "relation"]
    j = e0.select(*key, F.col("weight").alias("w0")).join(e1.select(*key, F.col("weight").alias("w1")), key, "full_outer")
    kind = F.when(F.col("w0").isNull(), "edge_added").when(F.col("w1").isNull(), "edge_removed").when(F.abs(F.col("w0") - F.col("w1")) > 0.001, "edge_reweighted")
    changed = j.select(kind.alias("kind")).where("kind IS NOT NULL")
    nodes = n1.join(n0, "node_id", "left_anti").select(F.lit("node_added").alias("kind")).unionByName(n0.join(n1, "node_id", "left_anti").select(F.lit("node_removed").alias("kind")))
    return changed.unionByName(nodes).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def trail_boosts(visited: DataFrame, supporting: DataFrame, contradicting: DataFrame, concluded: DataFrame) -> DataFrame:
    """(node_id, boost) of a saved trail: visited 0.2 + 0.5 relevance, supporting 0.7, contradicting 0.45, conclusion 0.8."""
    rows = visited.select("node_id", (0.2 + 0.5 * F.col("relevance")).alias("boost"))
    for df, b in ((supporting, 0.7), (contradicting, 0.45), (concluded, 0.8)):
        rows = rows.unionByName(df.select("node_id", F.lit(b).alias("boost")))
    return rows.groupBy("node_id").agg(F.max("boost").alias("boost"))


def resume(trail_nodes: DataFrame, g: PropertyGraph, generation: int, now: int, force: bool = False) -> DataFrame:
    """One row: what is missing of a trail, whether it is stale, and whether it may be resumed."""
    present = trail_nodes.join(g.nodes.select("external_id"), "external_id", "left_semi")
    a = trail_nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(present.agg(F.count(F.lit(1)).alias("present")))  # one row each
    missing = 1 - F.col("present") / F.greatest(F.col("n"), F.lit(1))
    return a.select("n", (F.col("n") - F.col("present")).alias("missing"), F.lit(now > generation).alias("stale"), (F.lit(force) | (missing <= 0.5)).alias("resumable"))


def merge_trails(visited: DataFrame) -> DataFrame:
    """(node_id, relevance, n_trails): the union of visited nodes with their largest relevance. ``visited``: trail, node_id, relevance."""
    return visited.groupBy("node_id").agg(F.max("relevance").alias("relevance"), F.count_distinct("trail").alias("n_trails"))


def hypothesis_conflicts(support: DataFrame, least: float = 0.3, clear: float = 0.2) -> DataFrame:
    """(a, b, overlap, winner): hypotheses of different trails and verdicts that rest on the same nodes.

    ``support``: trail, hypothesis, verdict, confidence, node_id.
    """
    size = support.groupBy("hypothesis").agg(F.count_distinct("node_id").alias("k"), F.first("trail").alias("trail"), F.first("verdict").alias("verdict"), F.max("confidence").alias("confidence"))
    s = support.select("hypothesis", "node_id").distinct()
    x, y = s.alias("x"), s.alias("y")
    shared = x.join(y, (F.col("x.node_id") == F.col("y.node_id")) & (F.col("x.hypothesis") < F.col("y.hypothesis"))).groupBy(F.col("x.hypothesis").alias("a"), F.col("y.hypothesis").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    side = lambda n: size.select(F.col("hypothesis").alias(n), F.col("k").alias(f"k_{n}"), F.col("trail").alias(f"t_{n}"), F.col("verdict").alias(f"v_{n}"), F.col("confidence").alias(f"c_{n}"))
    j = shared.join(side("a"), "a").join(side("b"), "b").where("t_a <> t_b AND v_a <> v_b")
    j = j.withColumn("overlap", F.col("shared") / F.greatest("k_a", "k_b")).where(F.col("overlap") >= least)
    return j.select("a", "b", "overlap", F.when(F.abs(F.col("c_a") - F.col("c_b")) < clear, "unresolved").when(F.col("c_a") > F.col("c_b"), F.col("a")).otherwise(F.col("b")).alias("winner"))
