"""The property graph: two DataFrames and what every analysis needs of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.durable import stored


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(node_id, external_id, label, node_type, tags, last_modified), edges(src, dst, relation, weight, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def expanded(self) -> DataFrame:
        """Edges with those of direction 1 in both directions."""
        back = self.edges.where("direction = 1").withColumns({"src": F.col("dst"), "dst": F.col("src")})
        return self.edges.unionByName(back)

    def finalised(self) -> "PropertyGraph":
        """The same graph with its edges written once, narrow and sorted by source, for operators of many hops."""
        return PropertyGraph(self.nodes, stored(self.edges.sortWithinPartitions("src"), "graph-edges"))

    def problems(self) -> DataFrame:
        """Rows that break the graph's constraints: repeated external ids, edges without an end."""
        twice = self.nodes.groupBy("external_id").count().where("count > 1").select(F.lit("duplicate_node").alias("problem"), F.col("external_id").alias("what"))
        ids = self.nodes.select("node_id")
        loose = [
            self.edges.join(ids, F.col(end) == F.col("node_id"), "left_anti").select(F.lit(f"dangling_{end}").alias("problem"), F.concat_ws("->", "src", "dst").alias("what"))
            for end in ("src", "dst")
        ]
        return twice.unionByName(loose[0]).unionByName(loose[1])

    def degrees(self) -> DataFrame:
        """(node_id, out_degree, in_degree) of every node, from one pass over the edges."""
        ends = self.expanded().select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        d = ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        return self.nodes.select("node_id").join(d, "node_id", "left").na.fill(0, ["out_degree", "in_degree"])

    def named(self, df: DataFrame, *columns: str, on: str = "node_id") -> DataFrame:
        """``df`` with node columns joined on, and the id dropped."""
        wanted = columns or ("external_id", "label", "node_type")
        side = self.nodes.select(F.col("node_id").alias("_id"), *wanted)
        return df.join(side, F.col(on) == F.col("_id")).drop("_id", on)

    def seeds(self, external_ids: list[str], score: float = 1.0) -> DataFrame:
        """Nodes by exact external id (the filter reaches the scan)."""
        return self.nodes.where(F.col("external_id").isin(external_ids)).select("node_id", F.lit(float(score)).alias("score"))

    def undirected(self) -> DataFrame:
        e = self.edges.select("src", "dst", "weight", "relation")
        return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "relation"))


def r6(c: Column | str) -> Column:
    """Six decimals: what results are published at."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scaled6(c: Column | str) -> Column:
    """Six decimals as the SQL rounds them: the millions are rounded, not the decimal form."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6
