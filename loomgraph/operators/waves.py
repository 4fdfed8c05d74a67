"""Standing waves on the graph: propagation with reflection, harmonics, sweeps, sympathetic nodes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.traversal import reach
from loomgraph.plans.durable import checked_join, stored


def local_maxima(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Rows above both neighbours in the order; a row without a place in it comes last."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(order))
    return df.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)}).where((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))).drop("_p", "_n")


def maxima_of_sums(rows: DataFrame, order: str, value: str, by: list[str], turn: str) -> DataFrame:
    """Local maxima of the sums of ``value`` over ``by`` and ``order``, the same however the rows are dealt.

    A shuffle adds doubles in any order, which moves a sum of n values by less than
    n roundings of the sum of their magnitudes (of one or two: not at all).  Sums of
    neighbours nearer to each other than that are added again in the order of ``turn``.
    """
    key, n = [*by, order], F.count(value)
    slack = F.when(n > 2, n * F.sum(F.abs(value)) * 2.0**-52).otherwise(0.0)
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(order))
    near = [F.coalesce(F.abs(F.col(value) - beside(value).over(w)) < F.col("_e") + beside("_e").over(w), F.lit(False)) for beside in (F.lag, F.lead)]
    sums = stored(rows.groupBy(*key).agg(F.sum(value).alias(value), slack.alias("_e")).select(*key, value, (near[0] | near[1]).alias("_near")), "sums")
    close = sums.where("_near").select(*key)
    if not close.limit(1).count():
        return local_maxima(sums.drop("_near"), order, value, by)
    same = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key])
    again = checked_join(rows.alias("r"), close.alias("c"), same, "left_semi")
    in_turn = Window.partitionBy(*key).orderBy(turn, value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = again.select(*key, F.sum(value).over(in_turn).alias(value)).dropDuplicates(key)
    return local_maxima(sums.where("NOT _near").drop("_near").unionByName(again), order, value, by)


def standing_wave(g: PropertyGraph, seeds: DataFrame, tones: DataFrame, hops: int = 4, least: float = 0.01, budget: int | None = None) -> DataFrame:
    """(tone, node_id, amplitude) of pulses with phase, all tones in one job.

    ``tones``: tone, frequency, wavelength.  A dead end reflects at 0.9 and half
    a turn; a hub (over four times the mean degree) reflects 0.3 likewise and
    lets 0.7 through; a pulse splits over the out-edges.  Pulses below ``least``
    die.  A ``budget`` keeps only the strongest pulses of a hop, in a total order.
    """
    e = g.undirected().select("src", "dst", "weight")
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    mean = deg.agg(F.avg("deg").alias("mean"))
    kind = deg.crossJoin(F.broadcast(mean)).select("src", "deg", (F.col("deg") / F.col("mean") > 4).alias("hub"))
    edges = e.join(kind, "src")
    step = 2 * math.pi * F.col("frequency") / F.col("wavelength")
    level = seeds.crossJoin(F.broadcast(tones)).select("tone", step.alias("step"), "node_id", F.lit(-1).cast("long").alias("prev"), F.col("score").alias("amp"), F.lit(0.0).alias("phase"))
    out = [level]
    for hop in range(hops):
        j = level.join(edges, level.node_id == edges.src)
        end = (F.col("deg") == 1) & (F.lit(hop > 0))
        through = F.col("amp") * F.col("weight") * F.when(F.col("hub"), 0.7).otherwise(1.0) / F.col("deg")
        ahead = j.where(~end & (F.col("dst") != F.col("prev"))).select("tone", "step", F.col("dst").alias("node_id"), F.col("src").alias("prev"), through.alias("amp"), (F.col("phase") + F.col("step")).alias("phase"))
        back = level.join(kind, level.node_id == kind.src).where((F.col("prev") >= 0) & ((F.col("deg") == 1) | F.col("hub")))
        reflected = back.select("tone", "step", F.col("prev").alias("node_id"), F.col("node_id").alias("prev"), (F.col("amp") * F.when(F.col("deg") == 1, 0.9).otherwise(0.3)).alias("amp"), (F.col("phase") + math.pi + F.col("step")).alias("phase"))
        level = ahead.unionByName(reflected).where(F.col("amp") >= least)
        if budget:
            level = level.orderBy(F.desc("amp"), "tone", "node_id", "prev").limit(budget)
        out.append(level)
    pulses = reduce(DataFrame.unionByName, out)
    z = pulses.groupBy("tone", "node_id").agg(F.sum(F.col("amp") * F.cos("phase")).alias("x"), F.sum(F.col("amp") * F.sin("phase")).alias("y"))
    return z.select("tone", "node_id", F.hypot("x", "y").alias("amplitude"))


def harmonics(g: PropertyGraph, seeds: DataFrame, frequency: float = 1.0, wavelength: float = 4.0, n: int = 5, least: float = 0.05, hops: int = 4, faintest: float = 0.01) -> DataFrame:
    """(node_id, signature): the harmonics in which a node swings by ``least``; pulses die below ``faintest``."""
    tones = g.nodes.sparkSession.createDataFrame([(h, frequency * h, wavelength / h) for h in range(1, n + 1)], "tone int, frequency double, wavelength double")
    w = standing_wave(g, seeds, tones, hops, faintest).where(F.col("amplitude") >= least)
    return w.groupBy("node_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col("tone").cast("string")))).alias("signature"))


def sweep(g: PropertyGraph, seeds: DataFrame, low: float = 0.1, high: float = 10.0, steps: int = 20, hops: int = 3) -> DataFrame:
    """Resonant frequencies: local maxima of total energy over a sweep."""
    fs = [low + (high - low) * k / (steps - 1) for k in range(steps)]
    tones = g.nodes.sparkSession.createDataFrame([(k, f, max(10.0 / f, 0.1)) for k, f in enumerate(fs)], "tone int, frequency double, wavelength double")
    energy = standing_wave(g, seeds, tones, hops).groupBy("tone").agg(F.round(F.sum("amplitude"), 9).alias("energy")).join(F.broadcast(tones), "tone")
    return local_maxima(energy.withColumn("_one", F.lit(1)), "tone", "energy", ["_one"]).select("frequency", "energy")


def sympathetic(g: PropertyGraph, seeds: DataFrame, frequency: float = 1.0, wavelength: float = 4.0, least: float = 0.05, hops: int = 4, faintest: float = 0.01) -> DataFrame:
    """Nodes that swing by ``least`` outside the seeds' two-hop surroundings; pulses die below ``faintest``."""
    tones = g.nodes.sparkSession.createDataFrame([(1, frequency, wavelength)], "tone int, frequency double, wavelength double")
    loud = standing_wave(g, seeds, tones, hops, faintest).where(F.col("amplitude") >= least)
    return loud.join(reach(g, seeds, 2, "both").select("node_id"), "node_id", "left_anti").select("node_id", "amplitude")


def wave_export(g: PropertyGraph, wave: DataFrame, least: float = 0.0) -> DataFrame:
    """A wave pattern for other programs: (tone, external_id, label, amplitude, kind), loudest first.

    ``wave``: tone, node_id, amplitude; antinodes swing by half of the tone's loudest or more, nodes by a tenth or less.
    """
    top = wave.groupBy("tone").agg(F.max("amplitude").alias("top"))
    swing = F.round("amplitude", 9)
    kind = F.when(swing >= F.round(0.5 * F.col("top"), 9), "antinode").when(swing <= F.round(0.1 * F.col("top"), 9), "node").otherwise("between")
    rows = g.named(wave.where(F.col("amplitude") >= least), "external_id", "label").join(top, "tone")
    return rows.select("tone", "external_id", "label", "amplitude", kind.alias("kind")).orderBy("tone", F.desc("amplitude"), "external_id")
