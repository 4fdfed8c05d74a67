"""Session state on disk: the graph first, then side tables, then the marker that makes a version count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.sources.formats import load_graph, save_graph

#: Side tables of a session.
SIDECARS = ("trust", "tremor", "antibodies", "epidemic", "plasticity")


def persist(g: PropertyGraph, path: str, version: int, **sides: DataFrame) -> list[str]:
    """Write one version below ``path``; the names written, in their order.

    A version without its marker does not count, so a run that dies half way
    leaves the one before in force.
    """
    unknown = set(sides) - set(SIDECARS)
    if unknown:
        raise ValueError(f"unknown side tables: {sorted(unknown)}")
    at = f"{path}/v={version}"
    save_graph(g.nodes, g.edges, at)
    written = ["graph"]
    for name in SIDECARS:
        if name in sides:
            sides[name].write.mode("overwrite").parquet(f"{at}/{name}")
            written.append(name)
    spark = g.nodes.sparkSession
    spark.createDataFrame([(version, ",".join(written))], "version int, tables string").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/v={version}")
    return [*written, "mark"]


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, tables) of every complete version."""
    return spark.read.parquet(f"{path}/marks").select(F.col("version"), "tables")


def restore(spark: SparkSession, path: str) -> tuple[PropertyGraph, dict[str, DataFrame]]:
    """The newest complete version: the graph without loose edges, and its side tables."""
    row = versions(spark, path).orderBy(F.desc("version")).limit(1).first()
    at = f"{path}/v={row['version']}"
    nodes, edges = load_graph(spark, at)
    return PropertyGraph(nodes, edges), {name: spark.read.parquet(f"{at}/{name}") for name in row["tables"].split(",") if name != "graph"}


def write_artifacts(docs: DataFrame, claims: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Canonical documents as artifacts: the text, what is claimed, and metadata, each a table of JSON lines by key."""
    docs.select(key, text).write.mode("overwrite").json(f"{path}/markdown")
    claims.write.mode("overwrite").json(f"{path}/claims")
    meta = docs.select(key, F.length(text).alias("n_chars"), F.size(F.split(text, "\n")).alias("n_lines"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha256"))
    meta.write.mode("overwrite").json(f"{path}/metadata")
