"""Composed reports: time, antibodies from feedback, two-phase lookups of many targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.texts import segments
from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.ledgers import decay_score
from loomgraph.operators.traversal import causal_chains, impact_radius, induced
from loomgraph.plans.durable import checked_join, is_small


def temporal_report(g: PropertyGraph, node: str, now: float, co_change: DataFrame, half_life_hours: float = 168.0, hops: int = 3, top: int = 10) -> DataFrame:
    """(section, n, strongest) of one node: co-change partners, causal chains, decay, and impact both ways.

    ``co_change``: a, b, strength by node id.
    """
    me = g.seeds([node]).select("node_id")
    both = co_change.select("a", "b", "strength").unionByName(co_change.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
    partners = both.join(me, both.a == me.node_id, "left_semi").groupBy("b").agg(F.max("strength").alias("strength")).orderBy(F.desc("strength"), "b").limit(top)
    age = (F.lit(float(now)) - F.col("last_modified")) / 3600.0
    decay = g.nodes.join(me, "node_id", "left_semi").select(decay_score(age, F.lit(half_life_hours)).alias("strength"))
    rows = {
        "co_change": partners, "causal_chains": causal_chains(g, node, hops), "decay": decay,
        "impact_forward": impact_radius(g, [node], "forward", hops).withColumnRenamed("signal_strength", "strength"),
        "impact_reverse": impact_radius(g, [node], "reverse", hops).withColumnRenamed("signal_strength", "strength"),
    }
    out = None
    for name, df in rows.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("strongest")).select(F.lit(name).alias("section"), "n", "strongest")
        out = one if out is None else out.unionByName(one)
    return out


def extract_antibody(g: PropertyGraph, picked: DataFrame, most_share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """A pattern from the nodes of a feedback: its node constraints and its edges.

    Constraints: (node_id, node_type, segment, matches), the segment of the
    node's label that fewest labels contain (ties to the longer, then the lesser
    one); a segment that more than ``most_share`` of all labels contain says
    nothing and is left out.  Edges: those between the picked nodes.
    """
    own = g.nodes.join(picked.select("node_id"), "node_id", "left_semi").select("node_id", "node_type", F.explode(segments(F.col("label"))).alias("segment"))
    asked = own.select("segment").distinct()
    if not is_small(asked, 10_000):
        raise ValueError("feedback names too many nodes")
    low = g.nodes.select(F.lower("label").alias("low"))
    matches = low.join(F.broadcast(asked), F.col("low").contains(F.col("segment"))).groupBy("segment").agg(F.count(F.lit(1)).alias("matches"))  # segments of a feedback are few
    total = g.nodes.agg(F.count(F.lit(1)).alias("total"))
    order = F.struct("matches", (-F.length("segment")).alias("l"), "segment")
    best = own.join(matches, "segment").groupBy("node_id", "node_type").agg(F.min(order).alias("b")).crossJoin(F.broadcast(total))  # one row
    kept = best.where(F.col("b.matches") <= most_share * F.col("total"))
    return kept.select("node_id", "node_type", F.col("b.segment").alias("segment"), F.col("b.matches").alias("matches")), induced(g, picked).select("src", "dst", "relation")


def resolve_roots(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, external_id, tier) of many targets: exact id, else label, else a part of the id; least id of the first tier."""
    low = F.lower("target")
    n = nodes.select("external_id", F.lower("external_id").alias("id_low"), F.lower("label").alias("label_low"))
    t = targets.select("target", low.alias("low")).distinct()
    exact = checked_join(n, t, F.col("external_id") == F.col("target")).select("target", "external_id", F.lit(0).alias("tier"))
    label = checked_join(n, t, F.col("label_low") == F.col("low")).select("target", "external_id", F.lit(1).alias("tier"))
    part = checked_join(n.withColumn("part", F.explode(F.array_distinct(F.split("id_low", "::")))), t, F.col("part") == F.col("low")).select("target", "external_id", F.lit(2).alias("tier"))
    found = exact.unionByName(label).unionByName(part)
    return found.groupBy("target").agg(F.min(F.struct("tier", "external_id")).alias("m")).select("target", "m.external_id", "m.tier")


def groupings(nodes: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, size, namespaces): what nodes share a key, for keys of at least ``least`` nodes. ``nodes``: namespace, id, and the key."""
    return nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count_distinct("id").alias("size"), F.count_distinct("namespace").alias("namespaces")).where(F.col("size") >= least)
