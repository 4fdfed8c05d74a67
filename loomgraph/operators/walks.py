"""Seeded random walks, and what is met on them together.

A step is drawn from an MD5 of (seed, start, walk, step), so every walk is the same
whatever tasks run it and however often.  A node's out-edges are dealt into
buckets of about ``ENTRIES`` by ranges of their targets; a walker's draw falls into
a bucket by the buckets' running sums and on an edge by those inside it, so no node's
edges stand in one row or window.  A walk does not depend on the buckets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.durable import checked_join, dropped, global_rank, is_small, stored

#: Out-edges of a bucket, about.
ENTRIES = 128
#: Pairs, counted both ways, that a pass over the walks deals out.
PAIRS_A_PASS = 1 << 25


def _draw(seed: int, step: int) -> Column:
    """A number in [0, 1) for each walker."""
    text = F.concat_ws(":", F.lit(f"{seed}"), F.col("start").cast("string"), F.col("walk").cast("string"), F.lit(f"{step}e"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _picked(entries: str, beyond: Column, base: Column | float = 0.0) -> Column:
    """The first entry (upto, name) whose running sum, on top of ``base``, is beyond a number; else the last."""
    return F.coalesce(F.get(F.filter(entries, lambda e: e["upto"] + base > beyond), F.lit(0)), F.element_at(entries, -1))


def step_tables(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, buckets) and (node, bucket, edges): running sums by bucket, and by target inside a bucket; edges without weight are left out."""
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).where("w > 0")
    e = weights = stored(e, "walk-weights")
    many = stored(e.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).alias("n")).where("n > 1"), "hubs")
    ranked = global_rank(checked_join(e, many, "src"), ["src", "dst"])  # a hub's targets lie together, in order
    hub = ranked.withColumn("bucket", F.floor(F.col("rank") / ENTRIES)).drop("rank", "n")
    e = checked_join(e, many.select("src"), "src", "left_anti").withColumn("bucket", F.lit(0).cast("long")).unionByName(hub)
    inside = e.withColumn("upto", F.sum("w").over(Window.partitionBy("src", "bucket").orderBy("dst").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    entries = F.sort_array(F.collect_list(F.struct("upto", F.col("dst").alias("name"))))
    buckets = stored(inside.groupBy(F.col("src").alias("node"), "bucket").agg(entries.alias("edges"), F.sum("w").alias("w")), "walk-edges")
    dropped(weights)
    w = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = buckets.select("node", F.col("bucket").alias("name"), F.sum("w").over(w).alias("upto"), F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    nodes = sums.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("upto", "name", "base"))).alias("buckets"))
    return stored(nodes, "walk-nodes"), buckets.select("node", "bucket", "edges")


def random_walks(nodes: DataFrame, edges: DataFrame, walks: int = 20, steps: int = 10, seed: int = 42) -> DataFrame:
    """(start, walk, path): ``walks`` walks from every node (node_id), of at most ``steps`` steps along out-edges (src, dst, weight).

    The next edge is drawn by its share of the weights; a walk ends where no edge
    leads on.  Parallel edges count together.
    """
    own, targets = (F.broadcast(t) if is_small(t) else t for t in step_tables(edges))  # measured once for all steps
    state = nodes.select(F.col("node_id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    state = state.select("start", "walk", F.array("start").alias("path"), F.col("start").alias("node"))
    for k in range(steps):
        last = state
        state = state.join(own, "node", "left").withColumn("beyond", _draw(seed, k) * F.element_at("buckets", -1)["upto"])
        state = state.withColumn("b", _picked("buckets", F.col("beyond"))).select("start", "walk", "path", "node", "beyond", F.col("b.name").alias("bucket"), F.col("b.base").alias("base"))
        state = state.join(targets, ["node", "bucket"], "left").withColumn("to", _picked("edges", F.col("beyond"), F.col("base"))["name"])
        state = state.select("start", "walk", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("to"))).alias("path"), F.col("to").alias("node"))
        state = stored(state, "walkers")  # a step's shuffle files go with it, and so does the table before
        dropped(last)
    return state.select("start", "walk", "path")


def co_occurrence(walks: DataFrame, window: int = 4) -> DataFrame:
    """(a, b, n): how often b stands within ``window`` steps of a on a walk, both ways; a node is not met with itself."""
    at = F.sequence(F.lit(0), F.size("path") - 1)
    near = lambda i: F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.struct(F.get("path", i).alias("a"), F.get("path", i + d).alias("b")))
    pairs = walks.select(F.explode(F.flatten(F.transform(at, near))).alias("p")).where("p.b IS NOT NULL AND p.a <> p.b")
    once = pairs.groupBy(F.least("p.a", "p.b").alias("x"), F.greatest("p.a", "p.b").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    return once.select(both.alias("p"), "n").select("p.a", "p.b", "n")


def information(walks: DataFrame, window: int = 4, pairs_a_pass: int = PAIRS_A_PASS) -> DataFrame:
    """(a, pairs, n, ppmi): of each node its pairs with positive mutual information, how often they are met, and the sum of it.

    As ``ppmi`` of :func:`co_occurrence`, but pairs are dealt out for a part of the
    nodes at a time, so that no more than a pass of them lies on disk.  ``walks`` should be stored.
    """

    def around(i):
        return F.filter(F.slice("path", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + window + 1), lambda b: b != F.get("path", i))

    def places(mine):
        at = F.filter(F.sequence(F.lit(0), F.size("path") - 1), lambda i: mine(F.get("path", i)))
        return walks.select(F.explode(F.transform(at, lambda i: F.struct(F.get("path", i).alias("a"), around(i).alias("near")))).alias("p")).select("p.*")

    met = stored(places(lambda a: F.lit(True)).groupBy("a").agg(F.sum(F.size("near").cast("long")).alias("na")).where("na > 0"), "met-sums")
    total = met.agg(F.sum("na")).first()[0] or 0
    passes, out = max(1, math.ceil(total / pairs_a_pass)), []
    for k in range(passes):
        mine = lambda a: F.pmod(F.xxhash64(a), F.lit(passes).cast("long")) == k  # noqa: B023, E731
        pairs = places(mine).select("a", F.explode("near").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        known = checked_join(pairs, met.where(mine(F.col("a"))), "a").join(met.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
        v = known.withColumn("v", F.log(F.col("n") * F.lit(total) / (F.col("na") * F.col("nb")))).where("v > 0")
        out.append(stored(v.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"), F.sum("v").alias("ppmi")), "met"))
    return reduce(DataFrame.unionByName, out)
