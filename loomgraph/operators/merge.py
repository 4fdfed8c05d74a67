"""Set operations on graphs: union and merge, diff, prune, drift, and ranked de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph

EDGE_KEY = ("src", "dst", "relation")


def merge_graphs(base: PropertyGraph, overlay: PropertyGraph) -> PropertyGraph:
    """Nodes by external id (tags united, latest change), edges by their key (largest weight and strength)."""
    n = base.nodes.withColumn("_o", F.lit(0)).unionByName(overlay.nodes.withColumn("_o", F.lit(1)))
    nodes = n.groupBy("external_id").agg(
        F.min("node_id").alias("node_id"), F.min_by("label", "_o").alias("label"), F.min_by("node_type", "_o").alias("node_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.max("last_modified").alias("last_modified"),
    )
    key = [*EDGE_KEY, "direction", "inhibitory"]
    e = base.edges.unionByName(overlay.edges)
    edges = e.groupBy(*key).agg(F.max("weight").alias("weight"), F.max("causal_strength").alias("causal_strength"))
    return PropertyGraph(nodes.select(*base.nodes.columns), edges.select(*base.edges.columns))


def diff_nodes(old: DataFrame, new: DataFrame, compare: list[str]) -> DataFrame:
    """(external_id, change): added, removed or modified."""
    o = old.select("external_id", F.struct(*compare).alias("o"), F.lit(True).alias("in_o"))
    n = new.select("external_id", F.struct(*compare).alias("n"), F.lit(True).alias("in_n"))
    change = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return o.join(n, "external_id", "full_outer").select("external_id", change.alias("change")).where("change IS NOT NULL")


def diff_edges(old: DataFrame, new: DataFrame, least: float = 0.001) -> DataFrame:
    """(src, dst, relation, change, delta); weights count as changed beyond ``least``."""
    o = old.groupBy(*EDGE_KEY).agg(F.max("weight").alias("ow"))
    n = new.groupBy(*EDGE_KEY).agg(F.max("weight").alias("nw"))
    d = F.col("nw") - F.col("ow")
    change = F.when(F.col("ow").isNull(), "added").when(F.col("nw").isNull(), "removed").when(F.abs(d) > least, "reweighted")
    return o.join(n, [*EDGE_KEY], "full_outer").select(*EDGE_KEY, change.alias("change"), F.coalesce(d, F.lit(0.0)).alias("delta")).where("change IS NOT NULL")


def jaccard_drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes, intersection and 1 - |A & B| / |A | B|."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    s = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("n"))
    return s.select("n_a", "n_b", "shared", F.when(F.col("n") > 0, 1 - F.col("shared") / F.col("n")).otherwise(0.0).alias("drift"))


def prune_claims(claims: DataFrame, source: str) -> DataFrame:
    """Ids claimed by ``source`` alone: (id). ``claims``: (id, source)."""
    c = claims.groupBy("id").agg(F.count_distinct("source").alias("k"), F.max((F.col("source") == source).cast("int")).alias("own"))
    return c.where("k = 1 AND own = 1").select("id")


def family_key(label: Column) -> Column:
    """What ranked results are de-duplicated by: the type behind ``impl``/``crate`` labels, else the label."""
    low = F.lower(F.trim(label))
    impl = F.regexp_extract(low, r"^impl\s*(?:<[^>]*>)?\s*(?:[\w:]+\s+for\s+)?([\w:]+)", 1)
    return F.when(impl != "", F.concat(F.lit("impl:"), impl)).when(low.startswith("crate::"), F.concat(F.lit("crate:"), F.split(low, "::")[1])).otherwise(low)


def dedupe_ranked(df: DataFrame, score: str, label: str, tie: str, top: int, near: float = 0.05) -> DataFrame:
    """The best row of each family; within ``near`` of the best the longer (more specific) label wins."""
    w = Window.partitionBy("_family")
    ranked = df.withColumn("_family", family_key(F.col(label))).withColumn("_close", F.col(score) >= F.max(score).over(w) - near)
    order = w.orderBy(F.desc("_close"), F.desc(F.length(label)), F.desc(score), tie)
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_family", "_close", "_n").orderBy(F.desc(score), tie).limit(top)
