"""The weighted property graph over the star-schema tables.

Node ids are numbers (table code and key), external ids ``<table>::<key>``;
strings are only made where they are output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph

#: Node id = code * SPAN + key.
SPAN = 10**15
CODES = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "order": 6}
#: Node types by table: wire codes.
TYPES = {"region": 15, "nation": 14, "supplier": 13, "customer": 100, "part": 12, "order": 11}


def node_id(table: str, key: Column | str) -> Column:
    return F.lit(CODES[table] * SPAN) + (F.col(key) if isinstance(key, str) else key).cast("long")


def id_of(external: str) -> int:
    table, key = external.split("::")
    return CODES[table] * SPAN + int(key)


def place(df: DataFrame) -> Column:
    """A row's place (long) in the files that ``df`` was just read from, in the order of their names.

    Where rounding decides, sums are added in this order, which is that of the SQL in one thread.
    """
    files, row = sorted(df.inputFiles()), F.col("_metadata.row_index")
    if len(files) > 1:
        row = row + F.array_position(F.array(*[F.lit(f) for f in files]), F.col("_metadata.file_path")).cast("long") * (1 << 40)
    return row


def _nodes(df: DataFrame, table: str, key: str, label: str, tags: Column | None = None, modified: Column | None = None) -> DataFrame:
    return df.select(
        node_id(table, key).alias("node_id"),
        F.concat(F.lit(f"{table}::"), F.col(key).cast("string")).alias("external_id"),
        F.col(label).alias("label"),
        F.lit(TYPES[table]).alias("node_type"),
        (tags if tags is not None else F.array().cast("array<string>")).alias("tags"),
        (modified if modified is not None else F.lit(0.0)).alias("last_modified"),
    )


def _edges(df: DataFrame, src: Column, dst: Column, relation: str, weight, causal: float, inhibitory=False, turn: str | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), lit(weight).alias("weight"), F.lit(causal).alias("causal_strength"), lit(inhibitory).alias("inhibitory"), F.lit(0).alias("direction"), *([turn] if turn else []))


def spine_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, suppliers and customers with their ``contains`` edges."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, supplier, customer = map(t, ("region", "nation", "supplier", "customer"))
    nodes = (
        _nodes(region, "region", "r_regionkey", "r_name")
        .unionByName(_nodes(nation, "nation", "n_nationkey", "n_name"))
        .unionByName(_nodes(supplier, "supplier", "s_suppkey", "s_name"))
        .unionByName(_nodes(customer, "customer", "c_custkey", "c_name"))
    )
    edges = (
        _edges(nation, node_id("region", "n_regionkey"), node_id("nation", "n_nationkey"), "contains", 1.0, 0.8)
        .unionByName(_edges(supplier, node_id("nation", "s_nationkey"), node_id("supplier", "s_suppkey"), "contains", 1.0, 0.8))
        .unionByName(_edges(customer, node_id("nation", "c_nationkey"), node_id("customer", "c_custkey"), "contains", 1.0, 0.8))
    )
    return PropertyGraph(nodes, edges)


def full_graph(spark: SparkSession, sf_dir: str, turns: bool = False) -> PropertyGraph:
    """The spine, orders and parts; ``calls``, ``references`` (inhibitory where all lines came back) and ``imports``.

    ``turns``: edges have a column ``turn``, for ``references`` the place of their first line in its file.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, orders, lines = map(t, ("part", "orders", "lineitem"))
    spine = spine_graph(spark, sf_dir)
    nodes = spine.nodes.unionByName(_nodes(part, "part", "p_partkey", "p_name", F.array("p_brand", "p_type"))).unionByName(
        _nodes(orders, "order", "o_orderkey", "o_orderpriority", None, F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    )
    first = [F.min("place").alias("turn")] if turns else []
    placed = lines.withColumn("place", place(lines)) if turns else lines
    refs = placed.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.bool_and(F.col("l_returnflag") == "R").alias("back"), *first)
    edges = (
        spine.edges.unionByName(_edges(orders, node_id("customer", "o_custkey"), node_id("order", "o_orderkey"), "calls", 0.7, 0.5))
        .unionByName(_edges(refs, node_id("order", "l_orderkey"), node_id("part", "l_partkey"), "references", F.least(F.col("q") / 50, F.lit(1.0)), 0.4, F.col("back"), "turn" if turns else None), True)
        .unionByName(_edges(lines.select("l_suppkey", "l_partkey").distinct(), node_id("supplier", "l_suppkey"), node_id("part", "l_partkey"), "imports", 0.5, 0.6), True)
    )
    return PropertyGraph(nodes, edges)


def _sql() -> str:
    def nodes(table, key, label, frm, tags="[]::VARCHAR[]", modified="0.0::DOUBLE"):
        return f"SELECT {CODES[table] * SPAN} + {key}::BIGINT AS node_id, '{table}::' || {key} AS external_id, {label} AS label, {TYPES[table]} AS node_type, {tags} AS tags, {modified} AS last_modified FROM {frm}"

    def edges(st, sk, dt, dk, rel, w, c, frm, inh="false"):
        return f"SELECT {CODES[st] * SPAN} + {sk}::BIGINT AS src, {CODES[dt] * SPAN} + {dk}::BIGINT AS dst, '{rel}' AS relation, ({w})::DOUBLE AS weight, {c}::DOUBLE AS causal_strength, {inh} AS inhibitory FROM {frm}"

    spine_n = [nodes("region", "r_regionkey", "r_name", "region"), nodes("nation", "n_nationkey", "n_name", "nation"), nodes("supplier", "s_suppkey", "s_name", "supplier"), nodes("customer", "c_custkey", "c_name", "customer")]
    spine_e = [
        edges("region", "n_regionkey", "nation", "n_nationkey", "contains", 1.0, 0.8, "nation"),
        edges("nation", "s_nationkey", "supplier", "s_suppkey", "contains", 1.0, 0.8, "supplier"),
        edges("nation", "c_nationkey", "customer", "c_custkey", "contains", 1.0, 0.8, "customer"),
    ]
    full_n = [*spine_n, nodes("part", "p_partkey", "p_name", "part", "[p_brand, p_type]"), nodes("order", "o_orderkey", "o_orderpriority", "orders", modified="epoch_us(o_orderdate) / 1e6::DOUBLE")]
    full_e = [
        *spine_e,
        edges("customer", "o_custkey", "order", "o_orderkey", "calls", 0.7, 0.5, "orders"),
        edges("order", "l_orderkey", "part", "l_partkey", "references", "least(q / 50, 1.0)", 0.4, "(SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, bool_and(l_returnflag = 'R') AS back FROM lineitem GROUP BY ALL)", "back"),
        edges("supplier", "l_suppkey", "part", "l_partkey", "imports", 0.5, 0.6, "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    ]
    union = " UNION ALL ".join
    return (
        f"spine_nodes AS ({union(spine_n)}), spine_edges AS ({union(spine_e)}), "
        f"nodes AS MATERIALIZED ({union(full_n)}), edges AS MATERIALIZED ({union(full_e)})"
    )


#: Common table expressions of the same graph for the SQL that results are held against.
GRAPH_SQL = _sql()
