"""Where queries are registered, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.tables_graph import GRAPH_SQL, place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a query under its function's name; ``sql`` follows the graph's common table expressions."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if graph:
                body = f"WITH {GRAPH_SQL}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {GRAPH_SQL} {body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ``place``, a row's place in its files."""
    df = table(spark, sf_dir, name)
    return df.select("*", place(df).alias("place"))
