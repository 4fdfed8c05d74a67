"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.durable import BROADCAST_ROWS, dropped, stored

#: Edges of a file of an intermediate table.
EDGES_A_FILE = 100_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One pass over (u, v), u > v; no vertex's neighbours are ever gathered.

    ``few``: the edges, and so the vertices' least neighbours, are few enough
    to be broadcast.
    """
    held = F.broadcast if few else (lambda df: df)
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(held(low), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(held(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has an edge; a component's name is its least vertex."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = stored(e, "edges"), None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == before or not state[0]:
            break
        before = state
        few, files = state[0] <= BROADCAST_ROWS // 2, max(1, state[0] // EDGES_A_FILE)
        last, e = e, stored(_star(_star(e, True, few), False, few).distinct(), "edges", files)
        dropped(last)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
