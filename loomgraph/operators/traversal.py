"""Hop-by-hop operators: impact, reachability, paths, neighbourhoods, PageRank.

A hop is one join of the frontier with the edges and one aggregation by target.
Hops are few and bounded, so they stay one declarative plan; the loops that run
longer cut their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans.durable import cut

DECAY = 0.55


def _edges(g: PropertyGraph, direction: str) -> DataFrame:
    e = g.expanded().select("src", "dst", "weight", "relation", "causal_strength", "inhibitory")
    back = e.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return {"forward": e, "reverse": back}.get(direction) or e.unionByName(back)


def impact_radius(g: PropertyGraph, sources: list[str], direction: str = "forward", max_hops: int = 5, least: float = 0.01) -> DataFrame:
    """(node_id, signal_strength, hop_distance): best product of weights and decay; hop of the last improvement."""
    edges = _edges(g, direction).select("src", "dst", "weight")
    level = g.seeds(sources).select("node_id", F.col("score").alias("signal"), F.lit(0).alias("hop"))
    levels = [level]
    for hop in range(1, max_hops + 1):
        level = (
            level.join(edges, level.node_id == edges.src)
            .select(F.col("dst").alias("node_id"), (F.col("signal") * F.col("weight") * DECAY).alias("signal"))
            .where(F.col("signal") > least)
            .groupBy("node_id")
            .agg(F.max("signal").alias("signal"))
            .withColumn("hop", F.lit(hop))
        )
        levels.append(level)
    best = reduce(DataFrame.unionByName, levels).groupBy("node_id").agg(F.max(F.struct("signal", (-F.col("hop")).alias("back"))).alias("b"))
    return best.select("node_id", F.col("b.signal").alias("signal_strength"), (-F.col("b.back")).alias("hop_distance")).where("hop_distance > 0")


def reach(g: PropertyGraph, sources: DataFrame, max_hops: int, direction: str = "forward", without: DataFrame | None = None) -> DataFrame:
    """(node_id, depth) within ``max_hops`` of ``sources`` (node_id), sources at depth 0; ``without``: removed nodes."""
    edges = _edges(g, direction).select("src", "dst")
    if without is not None:
        gone = without.select("node_id")
        edges = edges.join(gone, edges.dst == gone.node_id, "left_anti")
        sources = sources.join(gone, "node_id", "left_anti")
    seen = frontier = sources.select("node_id", F.lit(0).alias("depth"))
    for depth in range(1, max_hops + 1):
        new = frontier.join(edges, frontier.node_id == edges.src).select(F.col("dst").alias("node_id")).distinct()
        frontier = new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
        if depth % 4 == 0:
            seen, frontier = cut(seen), cut(frontier)
    return seen


def cascade(g: PropertyGraph, node: str, max_depth: int = 5) -> DataFrame:
    """Nodes newly reached at each depth behind one node."""
    return reach(g, g.seeds([node]), max_depth).where("depth > 0").groupBy("depth").agg(F.count(F.lit(1)).alias("affected"))


def why(g: PropertyGraph, source: str, target: str, max_hops: int = 6) -> DataFrame:
    """One shortest undirected path: (step, external_id, relation that led there); ties go to the least node id."""
    edges = g.expanded().select("src", "dst", "relation")
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))
    seen = frontier = g.seeds([source]).select("node_id", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("depth"))
    goal = g.seeds([target]).select("node_id")
    for depth in range(1, max_hops + 1):
        if seen.join(goal, "node_id", "left_semi").limit(1).count():
            break
        step = frontier.join(edges.withColumnRenamed("relation", "by"), F.col("node_id") == F.col("src"))
        new = step.groupBy("dst").agg(F.min(F.struct("src", "by")).alias("p"))
        frontier = cut(new.select(F.col("dst").alias("node_id"), F.col("p.src").alias("parent"), F.col("p.by").alias("relation"), F.lit(depth).alias("depth")).join(seen.select("node_id"), "node_id", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    walk = seen.join(goal, "node_id", "left_semi")
    steps = [walk]
    for _ in range(max_hops):
        walk = seen.join(walk.select(F.col("parent").alias("_up")), F.col("node_id") == F.col("_up"), "left_semi")
        steps.append(walk)
    path = reduce(DataFrame.unionByName, steps)
    return g.named(path.select("node_id", F.col("depth").alias("step"), F.coalesce("relation", F.lit("")).alias("relation")), "external_id")


def bounded_paths(g: PropertyGraph, source: str, max_hops: int, relation_weight: str = "causal_strength", least: float = 0.1) -> DataFrame:
    """Simple paths with the product of a strength: (path, strength, hops), of all lengths."""
    edges = g.expanded().where(F.col(relation_weight) > 0).select("src", "dst", F.col(relation_weight).alias("w"))
    level = g.seeds([source]).select(F.array("node_id").alias("path"), F.col("node_id").alias("at"), F.lit(1.0).alias("strength"))
    out = []
    for hop in range(1, max_hops + 1):
        level = (
            level.join(edges, F.col("at") == F.col("src"))
            .where(~F.array_contains("path", F.col("dst")) & (F.col("strength") * F.col("w") >= least))
            .select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"), (F.col("strength") * F.col("w")).alias("strength"))
        )
        out.append(level.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.unionByName, out)


def causal_chains(g: PropertyGraph, source: str, max_hops: int = 6, least: float = 0.1, top: int | None = None) -> DataFrame:
    """(chain as text, strength, hops), strongest first."""
    chains = bounded_paths(g, source, max_hops, least=least).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("chain"), "strength", "hops")
    return chains.orderBy(F.desc("strength"), "chain").limit(top) if top else chains


def pagerank(g: PropertyGraph, damping: float = 0.85, max_iterations: int = 50, tolerance: float = 1e-6, fixed: bool = False) -> DataFrame:
    """(node_id, pagerank), largest 1. Dangling mass is dropped; ``fixed``: all iterations, no early stop."""
    n = g.nodes.count()
    out = g.expanded().groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    edges = cut(g.expanded().select("src", "dst").join(out, "src").select("src", "dst", (1.0 / F.col("deg")).alias("share")))
    base = (1 - damping) / max(n, 1)
    ids = cut(g.nodes.select("node_id"))
    pr = ids.withColumn("pr", F.lit(1.0 / max(n, 1)))
    for k in range(1, max_iterations + 1):
        got = pr.join(edges, pr.node_id == edges.src).groupBy("dst").agg(F.sum(F.col("pr") * F.col("share")).alias("in_mass"))
        new = ids.join(got, ids.node_id == got.dst, "left").select("node_id", (F.lit(base) + damping * F.coalesce("in_mass", F.lit(0.0))).alias("pr"))
        if fixed and k % 5:
            pr = new
            continue
        new = cut(new)
        if not fixed:
            delta = new.join(pr.withColumnRenamed("pr", "old"), "node_id").agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0]
            if delta is None or delta < tolerance:
                pr = new
                break
        pr = new
    top = pr.agg(F.max("pr").alias("top"))
    return pr.crossJoin(F.broadcast(top)).select("node_id", (F.col("pr") / F.col("top")).alias("pagerank"))  # one row


def type_trace(g: PropertyGraph, target: str, direction: str = "forward", max_hops: int = 4) -> DataFrame:
    """Users of a type by depth; ``forward`` follows incoming edges, as callers of this operator expect."""
    return reach(g, g.seeds([target]), max_hops, "reverse" if direction == "forward" else "forward").where("depth > 0")


def induced(g: PropertyGraph, region: DataFrame) -> DataFrame:
    """Edges with both ends in ``region`` (node_id)."""
    ids = region.select("node_id").distinct()
    e = g.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return e.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def neighbours(g: PropertyGraph, node: str, test_words: tuple[str, ...] = ("test", "spec", "mock")) -> DataFrame:
    """(external_id, role, relation, weight): callers, callees, and those that look like tests."""
    me = g.seeds([node]).select("node_id")
    e = g.expanded().select("src", "dst", "relation", "weight")
    out = e.join(me, e.src == me.node_id, "left_semi").select(F.col("dst").alias("node_id"), F.lit("callee").alias("role"), "relation", "weight")
    into = e.join(me, e.dst == me.node_id, "left_semi").select(F.col("src").alias("node_id"), F.lit("caller").alias("role"), "relation", "weight")
    rows = g.named(out.unionByName(into), "external_id", "label")
    text = F.lower(F.concat_ws(" ", "relation", "label", "external_id"))
    like = reduce(lambda a, b: a | b, [text.contains(w) for w in test_words])
    return rows.withColumn("role", F.when(like, "test").otherwise(F.col("role")))
