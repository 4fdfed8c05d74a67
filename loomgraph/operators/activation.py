"""Spreading activation in four dimensions, their merge, and what is found on the result.

Hops are synchronous: positive signals reach a node by their maximum, then the
sum of inhibition is taken off, and nothing goes below 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.traversal import DECAY, reach
from loomgraph.plans.durable import cut

THRESHOLD = 0.04
#: What rounding can leave where inhibition takes all of a signal off.
NOTHING = 1e-12
#: Dimension weights: structural, semantic, temporal, causal.
WEIGHTS = {"structural": 0.35, "semantic": 0.15, "temporal": 0.25, "causal": 0.25}


def wavefront(g: PropertyGraph, seeds: DataFrame, max_depth: int = 5, strength: Column | None = None, threshold: float = THRESHOLD, checkpoint_every: int = 3, turn: str | None = None) -> DataFrame:
    """(node_id, activation) spread from ``seeds`` (node_id, score; capped at 1).

    Inhibition is added in decimals, the same in any order, and what rounding can
    leave is nothing.  ``turn``: it is added as doubles in the order of this column of
    the edges, as one thread would, and what that leaves stays.
    """
    w = F.col("weight") if strength is None else strength
    edges = g.expanded().select("src", "dst", w.alias("w"), "inhibitory", *([F.col(turn).alias("turn")] if turn else []))
    half = F.when(F.col("inhibitory"), F.col("s") * 0.5)
    in_turn = Window.partitionBy("dst").orderBy("turn", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = F.max_by("upto", "place") if turn else F.sum(half.cast("decimal(28,18)")).cast("double")
    state = seeds.groupBy("node_id").agg(F.least(F.max("score"), F.lit(1.0)).alias("activation")).withColumn("entered", F.lit(0))
    for hop in range(1, min(max_depth, 20) + 1):
        front = state.where((F.col("entered") == hop - 1) & (F.col("activation") >= threshold)).select("node_id", "activation")
        signal = F.col("activation") * F.col("w") * DECAY
        sent = front.join(edges, front.node_id == edges.src).select("dst", signal.alias("s"), "inhibitory", *(["turn"] if turn else []))
        if turn:
            sent = sent.select("dst", "s", "inhibitory", F.sum(half).over(in_turn).alias("upto"), F.count(F.lit(1)).over(in_turn).alias("place"))
        got = sent.groupBy("dst").agg(
            F.max(F.when(~F.col("inhibitory") & (F.col("s") > threshold), F.col("s"))).alias("up"),
            down.alias("down"),
        )
        both = state.join(got, state.node_id == got.dst, "full_outer")
        act = F.greatest(F.greatest(F.coalesce("activation", F.lit(0.0)), F.coalesce("up", F.lit(0.0))) - F.coalesce("down", F.lit(0.0)), F.lit(0.0))
        act = F.when(act > (0.0 if turn else NOTHING), act).otherwise(0.0)
        state = both.select(F.coalesce("node_id", "dst").alias("node_id"), act.alias("activation"), F.when(F.col("entered").isNotNull(), F.col("entered")).when(F.col("up").isNotNull(), F.lit(hop)).alias("entered"))
        if hop % checkpoint_every == 0 and hop < max_depth:
            state = cut(state)
    return state.where("activation > 0").select("node_id", "activation")


def temporal(g: PropertyGraph, seeds: DataFrame, now: float, half_life_hours: float = 168.0) -> DataFrame:
    """Recency and change frequency of the seeds alone."""
    freq = F.col("change_frequency") if "change_frequency" in g.nodes.columns else F.lit(0.0)
    age = F.greatest((F.lit(float(now)) - F.col("last_modified")) / 3600.0, F.lit(0.0))
    value = (F.exp(-F.log(F.lit(2.0)) * age / half_life_hours) * 0.6 + freq * 0.4) * F.col("score")
    return seeds.join(g.nodes, "node_id").select("node_id", value.alias("activation")).where("activation > 0")


def causal(g: PropertyGraph, seeds: DataFrame, max_depth: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Forward along causal edges, then backward from the seeds at 0.7; the larger counts."""
    fwd = g.expanded().where("causal_strength > 0").select("src", "dst", (F.col("weight") * F.col("causal_strength")).alias("w"))
    out = [seeds.select("node_id", F.least("score", F.lit(1.0)).alias("activation"))]
    for edges, damp in ((fwd, 1.0), (fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), 0.7)):
        level = out[0]
        for _ in range(max_depth):
            signal = F.col("activation") * F.col("w") * DECAY * damp
            level = level.join(edges, level.node_id == edges.src).select(F.col("dst").alias("node_id"), signal.alias("activation")).where(F.col("activation") > threshold).groupBy("node_id").agg(F.max("activation").alias("activation"))
            out.append(level)
    return reduce(DataFrame.unionByName, out).groupBy("node_id").agg(F.max("activation").alias("activation"))


def merge_dimensions(dimensions: dict[str, DataFrame], top: int | None = None, pagerank: DataFrame | None = None) -> DataFrame:
    """(node_id, activation, n_dimensions): weights renormalised over the dimensions that have rows, x1.3 at three, x1.5 at four."""
    rows = cut(reduce(DataFrame.unionByName, [d.select("node_id", F.lit(name).alias("dimension"), "activation") for name, d in dimensions.items()]))
    present = rows.groupBy("dimension").agg(F.max("activation").alias("m")).where("m > 0")
    weight = reduce(lambda c, kv: c.when(F.col("dimension") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0.0))
    total = present.agg(F.sum(weight).alias("total"))
    per = rows.crossJoin(F.broadcast(total))  # one row
    merged = per.groupBy("node_id").agg(F.sum(F.col("activation") * weight / F.col("total")).alias("base"), F.count_if(F.col("activation") > 0.01).alias("n_dimensions"))
    bonus = F.when(F.col("n_dimensions") >= 4, 1.5).when(F.col("n_dimensions") == 3, 1.3).otherwise(1.0)
    out = merged.select("node_id", (F.col("base") * bonus).alias("activation"), "n_dimensions")
    if top:
        out = out.orderBy(F.desc("activation"), "node_id").limit(top)
    if pagerank is not None:  # on what the cut has left, as the reference order is
        out = out.join(pagerank, "node_id", "left").select("node_id", (F.col("activation") + 0.1 * F.coalesce("pagerank", F.lit(0.0))).alias("activation"), "n_dimensions")
    return out


def ghost_edges(g: PropertyGraph, active: DataFrame, top: int = 10, candidates: int = 50) -> DataFrame:
    """Pairs of strongly active nodes without a forward edge. ``active``: node_id, activation, dimensions (array)."""
    best = active.where(F.size("dimensions") >= 2).orderBy(F.desc("activation"), "node_id").limit(candidates)
    a, b = best.alias("a"), best.alias("b")  # `candidates` rows on either side
    shared = F.size(F.array_intersect("a.dimensions", "b.dimensions"))
    ahead = (F.col("a.activation") > F.col("b.activation")) | ((F.col("a.activation") == F.col("b.activation")) & (F.col("a.node_id") < F.col("b.node_id")))
    pairs = a.join(F.broadcast(b), ahead & (shared >= 2)).select(F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"), F.least(F.sqrt(F.col("a.activation") * F.col("b.activation")), F.lit(1.0)).alias("strength"))
    return pairs.join(g.expanded().select("src", "dst"), ["src", "dst"], "left_anti").orderBy(F.desc("strength"), "src", "dst").limit(top)


def structural_holes(g: PropertyGraph, active: DataFrame, least: float = 0.3, top: int = 10) -> DataFrame:
    """Quiet nodes with at least two loud out-neighbours: (node_id, siblings, mean_activation)."""
    loud = active.where(F.col("activation") > least).select(F.col("node_id").alias("dst"), "activation")
    near = g.expanded().select("src", "dst").distinct().join(loud, "dst").groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("siblings"), F.avg("activation").alias("mean_activation")).where("siblings >= 2")
    quiet = near.join(active.where("activation > 0.01").select("node_id"), "node_id", "left_anti")
    return quiet.orderBy(F.desc("mean_activation"), "node_id").limit(top)


def anti_seeds(g: PropertyGraph, seeds: DataFrame, top: int = 3) -> DataFrame:
    """Nodes of similar degree that share little with the seeds' neighbourhood: (node_id, share, score)."""
    s = seeds.select("node_id").distinct()
    e = g.expanded().select("src", "dst")
    deg = g.degrees().select("node_id", (F.col("out_degree") + F.col("in_degree")).alias("deg"), "out_degree")
    mean = deg.join(s, "node_id", "left_semi").agg(F.avg("deg").alias("mean"))
    hood = e.join(s, e.src == s.node_id, "left_semi").select(F.col("dst").alias("node_id")).unionByName(s).distinct()
    inside = e.join(hood.withColumnRenamed("node_id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("inside"))
    c = deg.crossJoin(F.broadcast(mean)).where(F.col("deg") / F.col("mean") >= 0.3).join(s, "node_id", "left_anti").where("out_degree > 0").join(inside, "node_id", "left")
    share = F.coalesce("inside", F.lit(0)) / F.col("out_degree")
    outside = c.join(hood.withColumn("in_hood", F.lit(True)), "node_id", "left")
    score = F.when(F.col("in_hood").isNull(), 1.0).otherwise(0.0) + 1 - F.col("share")
    return outside.withColumn("share", share).where("share <= 0.2").select("node_id", "share", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(top)


def immunity(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """Nodes within two forward hops of the seeds."""
    return reach(g, seeds, 2).select("node_id")


def spectral_pulses(g: PropertyGraph, origins: DataFrame, max_depth: int = 5, threshold: float = THRESHOLD, budget: int | None = None) -> DataFrame:
    """(node_id, amplitude, paths): walks that never turn straight back; inhibition halves them.

    Walks below the threshold die.  A ``budget`` keeps only the strongest walks of a hop, in a total order.
    """
    edges = g.expanded().select("src", "dst", (F.col("weight") * DECAY * F.when(F.col("inhibitory"), 0.5).otherwise(1.0)).alias("f"))
    level = origins.select("node_id", F.lit(-1).cast("long").alias("prev"), F.col("score").alias("amp"))
    out = [level.select("node_id", "amp")]
    for _ in range(max_depth):
        level = level.join(edges, (level.node_id == edges.src) & (F.col("dst") != F.col("prev"))).select(F.col("dst").alias("node_id"), F.col("src").alias("prev"), (F.col("amp") * F.col("f")).alias("amp")).where(F.col("amp") >= threshold)
        if budget:
            level = level.orderBy(F.desc("amp"), "node_id", "prev").limit(budget)
        out.append(level.select("node_id", "amp"))
    return reduce(DataFrame.unionByName, out).groupBy("node_id").agg(F.sum("amp").alias("amplitude"), F.count(F.lit(1)).alias("paths"))


def xlr(g: PropertyGraph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node_id, score): hot pulses less cold ones (not in the immune region), by degree, through a sigmoid gate."""
    hot = spectral_pulses(g, seeds, max_depth).select("node_id", F.col("amplitude").alias("hot"))
    cold = spectral_pulses(g, anti_seeds(g, seeds).select("node_id", F.lit(1.0).alias("score")), max_depth).select("node_id", F.col("amplitude").alias("cold"))
    cold = cold.join(immunity(g, seeds), "node_id", "left_anti")
    deg = g.degrees().select("node_id", (F.col("out_degree") + F.col("in_degree")).cast("double").alias("deg"))
    mean = deg.agg(F.avg("deg").alias("mean"))
    net = (F.col("hot") - F.coalesce("cold", F.lit(0.0))) * F.least(F.greatest(F.col("deg") / F.col("mean"), F.lit(0.3)), F.lit(2.0))
    x = F.least(F.greatest(6 * net, F.lit(-20.0)), F.lit(20.0))
    out = hot.join(cold, "node_id", "left").join(deg, "node_id").crossJoin(F.broadcast(mean))
    return out.select("node_id", (1 / (1 + F.exp(-x))).alias("score")).where("score > 0.01")


def spectral_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared amplitude over united amplitude of two pulse sets."""
    j = a.select("node_id", F.col("amplitude").alias("x")).join(b.select("node_id", F.col("amplitude").alias("y")), "node_id", "full_outer").na.fill(0.0)
    return j.agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("overlap"))
