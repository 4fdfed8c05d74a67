"""Structural metrics: degrees, risk panorama, densities, line metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph


def panoramic(g: PropertyGraph, prefix: str, churn: float = 0.0) -> DataFrame:
    """Centrality and risk of the nodes under a prefix; N counts every node."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    d = g.degrees().join(g.nodes.where(F.col("external_id").startswith(prefix)).select("node_id", "external_id"), "node_id")
    total = (F.col("in_degree") + F.col("out_degree")).cast("double")
    d = d.crossJoin(F.broadcast(n))  # one row
    centrality = F.least(total / (2.0 * F.greatest(F.col("n") - 1, F.lit(1))), F.lit(1.0))
    risk = 0.5 * F.least(total / F.col("n"), F.lit(1.0)) + 0.3 * centrality + 0.2 * churn
    return d.select("external_id", "in_degree", "out_degree", centrality.alias("centrality"), risk.alias("risk"), (risk >= 0.7).alias("critical"))


def relation_profile(g: PropertyGraph) -> DataFrame:
    """For each relation: edges, mean weight, inhibitory edges, distinct ends."""
    return g.edges.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("mean_weight"), F.sum(F.col("inhibitory").cast("long")).alias("n_inhibitory"),
        F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"),
    )


def node_metrics(g: PropertyGraph, child_relations: tuple[str, ...] = ("contains", "defines", "owned_by_impl")) -> DataFrame:
    """Per node: children by type, degrees and density of its surroundings."""
    kids = g.edges.where(F.col("relation").isin(*child_relations)).join(g.nodes.select(F.col("node_id").alias("dst"), F.col("node_type").alias("t")), "dst")
    kids = kids.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("t") == 13).alias("n_suppliers"), F.count_if(F.col("t") >= 100).alias("n_custom"))
    out = g.degrees().join(kids, "node_id", "left").na.fill(0, ["n_children", "n_suppliers", "n_custom"])
    return out.withColumn("complexity", F.col("n_children") + F.col("in_degree") + F.col("out_degree"))


def coupling(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Per group: inner and outgoing edges, cohesion, density, share of crossing edges.

    ``group``: (node_id, community).
    """
    s = group.select(F.col("node_id").alias("src"), F.col("community").alias("cs"))
    t = group.select(F.col("node_id").alias("dst"), F.col("community").alias("ct"))
    e = edges.join(s, "src").join(t, "dst").select("cs", "ct")
    inner = (F.col("cs") == F.col("ct")).cast("long")
    per = e.groupBy(F.col("cs").alias("community")).agg(F.sum(inner).alias("internal"), F.sum(1 - inner).alias("crossing"))
    size = group.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    out = size.join(per, "community", "left").na.fill(0, ["internal", "crossing"])
    n, i, x = F.col("n_nodes"), F.col("internal"), F.col("crossing")
    return out.withColumns(
        {
            "density": F.when(n > 1, F.least(i / (n * (n - 1)).cast("double"), F.lit(1.0))).otherwise(0.0),
            "cohesion": F.when(i + x > 0, i / (i + x).cast("double")).otherwise(1.0),
            "coupling": F.when(i + x > 0, x / (i + x).cast("double")).otherwise(0.0),
        }
    )
