"""Lookups, views, hotspots, federation, traces, timelines and co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import flow, ledgers, lookups, matching, metrics, spread, walks
from loomgraph.operators.graph import r6
from loomgraph.queries.registry import query, table
from loomgraph.sources.tables_graph import full_graph, id_of, spine_graph

_LINES = "al AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), ln AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM al), li AS (SELECT doc_id, i AS line_no, a[i] AS line FROM ln)"


@query(f"WITH {_LINES} SELECT CAST(line_no AS BIGINT) AS line_no, line FROM li WHERE doc_id = 9 AND line_no BETWEEN 2 AND 6", graph=False)
def f12_view(spark, sf_dir):
    return lookups.view(table(spark, sf_dir, "documents"), "doc_id", "text", 9, 1, 5).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT min(external_id) AS external_id, 2::BIGINT AS tier FROM nodes WHERE lower(label) = 'europe'")
def f13_tiered_resolution(spark, sf_dir):
    return lookups.resolve_tiered(full_graph(spark, sf_dir).nodes, "Europe").withColumn("tier", F.col("tier").cast("long"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations) WHERE c <= 800", graph=False)
def t5_truncate(spark, sf_dir):
    return lookups.truncate(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 800).select("conv_id", "turn")


@query("SELECT node_id, round(least(greatest(0.4::DOUBLE * ((node_id % 11) / 10.0::DOUBLE) + 0.25::DOUBLE * ((node_id % 7) / 6.0::DOUBLE) + 0.15::DOUBLE * ((node_id % 3) / 2.0::DOUBLE) + 0.2::DOUBLE * ((node_id % 5) / 4.0::DOUBLE), 0), 1), 6) AS heat FROM spine_nodes")
def g52_hotspots(spark, sf_dir):
    p = lambda m: (F.col("node_id") % m) / float(m - 1)
    return spine_graph(spark, sf_dir).nodes.select("node_id", r6(lookups.hotspot(p(11), p(7), p(3), p(5))).alias("heat"))


@query("WITH best AS (SELECT node_id FROM nodes WHERE node_type IN (13, 14, 15, 100) ORDER BY (node_id % 101) / 101.0::DOUBLE DESC, node_id LIMIT 200) SELECT src, dst, relation FROM edges WHERE src IN (SELECT node_id FROM best) AND dst IN (SELECT node_id FROM best)")
def g62_subgraph(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    active = g.nodes.where("node_type IN (13, 14, 15, 100)").select("node_id", ((F.col("node_id") % 101) / 101.0).alias("activation"))
    return lookups.subgraph(g.edges, active, 200).select("src", "dst", "relation")


def _cut_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT s.node_id % 7 AS community, avg(CASE WHEN s.node_id % 7 = t.node_id % 7 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS coupling FROM edges JOIN nodes s ON s.node_id = src JOIN nodes t ON t.node_id = dst WHERE {where} GROUP BY 1)"


@query(f"WITH {_cut_sql('b', 'true')}, {_cut_sql('a', 'NOT (src % 2 = 0 AND src % 7 = dst % 7)')} SELECT community, round(a.coupling - b.coupling, 6) AS delta FROM a JOIN b USING (community) WHERE abs(a.coupling - b.coupling) > 0.01")
def u3_coupling_delta(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    group = g.nodes.select("node_id", (F.col("node_id") % 7).alias("community"))
    before = metrics.coupling(g.edges, group)
    after = metrics.coupling(g.edges.where("NOT (src % 2 = 0 AND src % 7 = dst % 7)"), group)
    return lookups.coupling_delta(before, after).withColumn("delta", r6("delta"))


@query("WITH f AS (SELECT p_partkey AS path, 'm' || (p_partkey % 50) AS stem, p_partkey % 4 = 0 AS is_test, p_size AS added, p_partkey % 9 AS previous FROM part), t AS (SELECT DISTINCT stem FROM f WHERE is_test), s AS (SELECT DISTINCT stem FROM f WHERE NOT is_test) SELECT path, 'test_deficit' AS anomaly FROM f WHERE NOT is_test AND stem NOT IN (SELECT stem FROM t) UNION ALL SELECT path, 'orphan_test' FROM f WHERE is_test AND stem NOT IN (SELECT stem FROM s) UNION ALL SELECT path, 'velocity_spike' FROM f WHERE added > 3.0 * greatest(previous, 1)", graph=False)
def g69_anomalies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat(F.when(F.col("p_partkey") % 4 == 0, "test_").otherwise(""), F.lit("m"), (F.col("p_partkey") % 50).cast("string")).alias("stem"), (F.col("p_partkey") % 4 == 0).alias("is_test"), F.col("p_size").alias("added"), (F.col("p_partkey") % 9).alias("previous"))
    return lookups.anomalies(p)


@query("WITH p AS (SELECT l_suppkey AS a, l_partkey % 30 AS b, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p), a AS (SELECT a, sum(n) AS na FROM p GROUP BY a), b AS (SELECT b, sum(n) AS nb FROM p GROUP BY b) SELECT a, b, round(ln(n * t / (na * nb)::DOUBLE), 6) AS ppmi FROM p JOIN a USING (a) JOIN b USING (b), t WHERE ln(n * t / (na * nb)::DOUBLE) > 0", graph=False)
def x6_ppmi(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 30).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return lookups.ppmi(p).withColumn("ppmi", r6("ppmi"))


@query("SELECT src, dst, relation, round(CASE WHEN dst % 5 = 0 THEN least(greatest((dst % 40) / 10.0::DOUBLE, 0.05), 3.0) ELSE weight END, 6) AS weight FROM spine_edges")
def k3_reload_weights(spark, sf_dir):
    e = spine_graph(spark, sf_dir).edges
    saved = e.where("dst % 5 = 0").withColumn("weight", (F.col("dst") % 40) / 10.0)
    return lookups.reload_weights(e, saved).select("src", "dst", "relation", r6("weight").alias("weight"))


@query("WITH w AS (SELECT l_orderkey AS k, list(l_discount + 0.1) AS w FROM lineitem GROUP BY l_orderkey) SELECT k, round(exp(list_sum(list_transform(w, lambda x: ln(x))) / len(w)) / (1 + 0.1::DOUBLE * (len(w) - 1)), 6) AS coherence FROM w", graph=False)
def x11_path_coherence(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_discount") + 0.1).alias("w"))
    return w.select("k", r6(lookups.path_coherence(F.col("w"))).alias("coherence"))


@query("SELECT CAST(count(*) AS BIGINT) AS calls, round(sum(o_totalprice), 2) AS manual, round(sum(o_totalprice / 2), 2) AS used, round(1 - sum(o_totalprice / 2) / sum(o_totalprice), 6) AS saved FROM orders", graph=False)
def a22_savings(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("manual"), (F.col("o_totalprice") / 2).alias("used"))
    return lookups.savings(log).withColumns({"manual": F.round("manual", 2), "used": F.round("used", 2), "saved": r6("saved")})


@query("WITH n AS (SELECT n_nationkey AS a, n_regionkey AS b, 1.0::DOUBLE * n_nationkey % 4 AS t FROM nation), m AS (SELECT a, b, 0.05::DOUBLE AS s FROM n WHERE a % 2 = 0) SELECT coalesce(n.a, m.a) AS a, coalesce(n.b, m.b) AS b, round(least(coalesce(s, 0) + 0.1::DOUBLE * coalesce(t, 0), 1.0), 6) AS strength FROM n FULL JOIN m ON n.a = m.a AND n.b = m.b", graph=False)
def g44_record_co_change(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), (F.col("n_nationkey") % 4).alias("times"))
    matrix = n.where("a % 2 = 0").select("a", "b", F.lit(0.05).alias("strength"))
    return spread.record_co_change(matrix, n).withColumn("strength", r6("strength"))


@query("SELECT 'left::' || external_id AS external_id FROM spine_nodes WHERE node_type = 14 UNION ALL SELECT 'right::' || external_id FROM spine_nodes WHERE node_type = 15")
def g65_federation(spark, sf_dir):
    from loomgraph.operators.graph import PropertyGraph

    g = spine_graph(spark, sf_dir)
    both = matching.federate({"left": PropertyGraph(g.nodes.where("node_type = 14"), g.edges.limit(0)), "right": PropertyGraph(g.nodes.where("node_type = 15"), g.edges.limit(0))})
    return both.nodes.select("external_id")


@query("WITH f AS (SELECT l_orderkey AS frame_no, 'supplier::' || l_suppkey AS external_id FROM lineitem), p AS (SELECT external_id, (node_id % 10)::DOUBLE AS pr FROM spine_nodes), l AS (SELECT greatest(max(frame_no), 1) AS last FROM f), t AS (SELECT max(pr) AS top FROM p) SELECT f.external_id, round(max(0.4::DOUBLE * frame_no / last + 0.25::DOUBLE * coalesce(pr / top, 0)), 6) AS score FROM f LEFT JOIN p USING (external_id), l, t GROUP BY 1")
def g55_trace(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_no"), F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")).alias("external_id"))
    pr = spine_graph(spark, sf_dir).nodes.select("external_id", (F.col("node_id") % 10).cast("double").alias("pagerank"))
    return flow.trace_scores(f, pr).withColumn("score", r6("score"))


@query("WITH c AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey) SELECT key, CAST(n AS BIGINT) AS n, round(1 / (1 + n / 10.0::DOUBLE), 6) AS stability FROM c", graph=False)
def g70_timeline_stability(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"), F.lit(1).alias("added"), F.lit(0).alias("deleted"))
    return ledgers.churn(c).select("key", "n", r6("stability").alias("stability"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM edges WHERE src = {id_of('nation::3')} OR dst = {id_of('nation::3')}")
def r8_lock_events(spark, sf_dir):
    from loomgraph.streaming.ledgers import lock_events

    g = full_graph(spark, sf_dir)
    return lock_events(g.edges.select("src", "dst", "relation"), g.seeds(["nation::3"])).agg(F.count(F.lit(1)).alias("n"))


def _walks_sql(walks: int, steps: int, seed: int) -> str:
    """Walks over the whole graph both ways; no node has so many edges here that they are dealt into buckets."""
    draw = lambda k: f"('0x' || md5('{seed}:' || start || ':' || walk || ':{k}e')[1:8])::UBIGINT::DOUBLE / 4294967296.0::DOUBLE"
    parts = [
        "we AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY ALL)",
        "wc AS MATERIALIZED (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY src) AS total FROM we WHERE w > 0)",
        f"w0 AS MATERIALIZED (SELECT node_id AS start, walk, node_id AS node, 0 AS step FROM nodes, range({walks}) r(walk))",
    ]
    for k in range(steps):
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT start, walk, arg_min(dst, upto) AS node, {k + 1} AS step FROM w{k} JOIN wc ON src = node WHERE upto > total * ({draw(k)}) GROUP BY start, walk)")
    parts.append(f"wp AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM w{k}' for k in range(steps + 1))})")
    parts.append("wn AS MATERIALIZED (SELECT a.node AS a, b.node AS b, count(*) AS n FROM wp a JOIN wp b ON a.start = b.start AND a.walk = b.walk AND abs(a.step - b.step) BETWEEN 1 AND 4 AND a.node <> b.node GROUP BY ALL)")
    return ", ".join(parts)


@query(
    f"WITH {_walks_sql(1, 10, 42)}, t AS (SELECT sum(n) AS t FROM wn), s AS (SELECT a, sum(n) AS n FROM wn GROUP BY a), v AS (SELECT wn.a, wn.n, ln(wn.n * t / (x.n * y.n)::DOUBLE) AS v FROM wn JOIN s x ON x.a = wn.a JOIN s y ON y.a = wn.b, t) "
    "SELECT a, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS n, round(sum(v), 4) AS ppmi FROM v WHERE v > 0 GROUP BY a"
)
def x6_random_walks(spark, sf_dir):
    """Walks from every node both ways along the edges, counted within four steps, as mutual information."""
    g = full_graph(spark, sf_dir)
    met = walks.information(walks.random_walks(g.nodes, g.undirected(), 1, 10, 42))
    return met.select("a", "pairs", "n", F.round("ppmi", 4).alias("ppmi"))
