"""Degrees, metrics, lookups, traversals, diffs and merges over the table graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import merge, metrics, traversal
from loomgraph.operators.graph import PropertyGraph, r6
from loomgraph.queries.registry import query
from loomgraph.sources.tables_graph import full_graph, id_of, spine_graph

_DEG = "deg AS (SELECT node_id, CAST(count(*) FILTER (o = 1) AS BIGINT) AS out_degree, CAST(count(*) FILTER (o = 0) AS BIGINT) AS in_degree FROM (SELECT src AS node_id, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY node_id), degrees AS (SELECT n.node_id, n.external_id, n.node_type, n.label, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM nodes n LEFT JOIN deg USING (node_id))"


def impact_sql(source: int, hops: int, direction: str = "forward") -> str:
    """Levels of best products, unrolled."""
    e = {"forward": "SELECT src, dst, weight FROM edges", "reverse": "SELECT dst AS src, src AS dst, weight FROM edges"}.get(direction) or "SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges"
    parts = [f"walk AS ({e})", f"l0 AS (SELECT {source}::BIGINT AS node_id, 1.0::DOUBLE AS signal, 0 AS hop)"]
    for k in range(1, hops + 1):
        parts.append(f"l{k} AS (SELECT dst AS node_id, max(signal * weight * 0.55::DOUBLE) AS signal, {k} AS hop FROM l{k - 1} JOIN walk ON node_id = src WHERE signal * weight * 0.55::DOUBLE > 0.01 GROUP BY dst)")
    union = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(hops + 1))
    return f"WITH {', '.join(parts)}, best AS (SELECT node_id, max(signal) AS signal_strength FROM ({union}) GROUP BY node_id), impact AS (SELECT b.node_id, signal_strength, min(hop) AS hop_distance FROM best b JOIN ({union}) u ON u.node_id = b.node_id AND u.signal = b.signal_strength GROUP BY ALL)"


@query(f"WITH {_DEG} SELECT external_id, out_degree, in_degree FROM degrees")
def a1_degrees(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return g.named(g.degrees(), "external_id").select("external_id", "out_degree", "in_degree")


@query(f"WITH {_DEG} SELECT node_type::BIGINT AS node_type, CAST(count(*) AS BIGINT) AS n, round(avg(out_degree), 6) AS mean_out, round(avg(in_degree), 6) AS mean_in, CAST(max(out_degree) AS BIGINT) AS top_out FROM degrees GROUP BY node_type")
def a1_average_degree(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    d = g.named(g.degrees(), "node_type")
    return d.groupBy(F.col("node_type").cast("long").alias("node_type")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("out_degree")).alias("mean_out"), r6(F.avg("in_degree")).alias("mean_in"), F.max("out_degree").alias("top_out"))


@query(
    f"WITH {_DEG}, kids AS (SELECT src AS node_id, count(*) AS n_children, count(*) FILTER (n.node_type = 13) AS n_suppliers, count(*) FILTER (n.node_type >= 100) AS n_custom FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE relation IN ('contains', 'defines', 'owned_by_impl') GROUP BY src) "
    "SELECT external_id, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(coalesce(n_suppliers, 0) AS BIGINT) AS n_suppliers, CAST(coalesce(n_custom, 0) AS BIGINT) AS n_custom, CAST(coalesce(n_children, 0) + in_degree + out_degree AS BIGINT) AS complexity "
    "FROM degrees LEFT JOIN kids USING (node_id) ORDER BY complexity DESC, external_id LIMIT 50"
)
def a2_metrics(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    m = g.named(metrics.node_metrics(g), "external_id").select("external_id", "n_children", "n_suppliers", "n_custom", "complexity")
    return m.orderBy(F.desc("complexity"), "external_id").limit(50)


@query(
    f"WITH {_DEG}, n AS (SELECT count(*) AS n FROM nodes), p AS (SELECT external_id, in_degree, out_degree, least((in_degree + out_degree) / (2.0::DOUBLE * greatest(n - 1, 1)), 1.0::DOUBLE) AS c, least((in_degree + out_degree)::DOUBLE / n, 1.0::DOUBLE) AS d FROM degrees, n WHERE starts_with(external_id, 'supplier::')) "
    "SELECT external_id, in_degree, out_degree, round(c, 6) AS centrality, round(0.5::DOUBLE * d + 0.3::DOUBLE * c, 6) AS risk, (0.5::DOUBLE * d + 0.3::DOUBLE * c >= 0.7::DOUBLE) AS critical FROM p"
)
def a3_panoramic(spark, sf_dir):
    return metrics.panoramic(full_graph(spark, sf_dir), "supplier::").withColumns({"centrality": r6("centrality"), "risk": r6("risk")})


@query("SELECT relation, CAST(count(*) AS BIGINT) AS n_edges, round(avg(weight), 6) AS mean_weight, CAST(count(*) FILTER (inhibitory) AS BIGINT) AS n_inhibitory, CAST(count(DISTINCT src) AS BIGINT) AS n_src, CAST(count(DISTINCT dst) AS BIGINT) AS n_dst FROM edges GROUP BY relation")
def a22_relation_report(spark, sf_dir):
    return metrics.relation_profile(full_graph(spark, sf_dir)).withColumn("mean_weight", r6("mean_weight"))


@query("SELECT external_id, label FROM nodes WHERE external_id IN ('nation::3', 'customer::17', 'part::5')")
def f1_resolve(spark, sf_dir):
    return full_graph(spark, sf_dir).nodes.where(F.col("external_id").isin("nation::3", "customer::17", "part::5")).select("external_id", "label")


@query("SELECT external_id, label FROM nodes WHERE starts_with(external_id, 'supplier::1')")
def f2_scope_prefix(spark, sf_dir):
    return full_graph(spark, sf_dir).nodes.where(F.col("external_id").startswith("supplier::1")).select("external_id", "label")


@query("SELECT external_id, label FROM nodes WHERE contains(external_id, '::77')")
def f3_scope_substring(spark, sf_dir):
    return full_graph(spark, sf_dir).nodes.where(F.col("external_id").contains("::77")).select("external_id", "label")


@query("SELECT external_id FROM nodes WHERE node_type IN (13, 14, 15)")
def f4_node_types(spark, sf_dir):
    return full_graph(spark, sf_dir).nodes.where(F.col("node_type").isin(13, 14, 15)).select("external_id")


@query(impact_sql(id_of("nation::0"), 3) + " SELECT external_id, label, node_type::BIGINT AS node_type, round(signal_strength, 6) AS signal_strength, hop_distance::BIGINT AS hop_distance FROM impact JOIN nodes USING (node_id) WHERE hop_distance > 0")
def g14_impact(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    out = g.named(traversal.impact_radius(g, ["nation::0"], "forward", 3))
    return out.select("external_id", "label", F.col("node_type").cast("long").alias("node_type"), r6("signal_strength").alias("signal_strength"), F.col("hop_distance").cast("long").alias("hop_distance"))


@query(impact_sql(id_of("part::10"), 4, "reverse") + " SELECT external_id, round(signal_strength, 6) AS signal_strength, hop_distance::BIGINT AS hop_distance FROM impact JOIN nodes USING (node_id) WHERE hop_distance > 0")
def g14_impact_reverse(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    out = g.named(traversal.impact_radius(g, ["part::10"], "reverse", 4), "external_id")
    return out.select("external_id", r6("signal_strength").alias("signal_strength"), F.col("hop_distance").cast("long").alias("hop_distance"))


@query(impact_sql(id_of("supplier::3"), 2, "both") + " SELECT CAST(count(*) AS BIGINT) AS n, round(sum(signal_strength), 5) AS total_energy, max(hop_distance)::BIGINT AS max_hop FROM impact WHERE hop_distance > 0")
def g14_impact_energy(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return traversal.impact_radius(g, ["supplier::3"], "both", 2).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("signal_strength"), 5).alias("total_energy"), F.max("hop_distance").cast("long").alias("max_hop"))


def _levels_sql(source: int, hops: int) -> str:
    parts = [f"w0 AS (SELECT {source}::BIGINT AS node_id)"]
    for k in range(1, hops + 1):
        parts.append(f"w{k} AS (SELECT DISTINCT dst AS node_id FROM w{k - 1} JOIN edges ON src = node_id WHERE " + " AND ".join(f"dst NOT IN (SELECT node_id FROM w{j})" for j in range(k)) + ")")
    return "WITH " + ", ".join(parts)


@query(_levels_sql(id_of("region::1"), 5) + " SELECT depth::BIGINT AS depth, CAST(count(*) AS BIGINT) AS affected FROM (" + " UNION ALL ".join(f"SELECT {k} AS depth FROM w{k}" for k in range(1, 6)) + ") GROUP BY depth")
def g33_cascade(spark, sf_dir):
    return traversal.cascade(full_graph(spark, sf_dir).finalised(), "region::1").withColumn("depth", F.col("depth").cast("long"))


@query(
    f"WITH removed AS (SELECT {id_of('nation::2')}::BIGINT AS id), e AS (SELECT src, dst FROM edges WHERE dst NOT IN (SELECT id FROM removed) AND src NOT IN (SELECT id FROM removed)), l0 AS (SELECT node_id FROM nodes WHERE external_id LIKE 'region::%'), l1 AS (SELECT DISTINCT dst AS node_id FROM l0 JOIN e ON src = node_id), l2 AS (SELECT DISTINCT dst AS node_id FROM l1 JOIN e ON src = node_id) "
    "SELECT external_id FROM (SELECT * FROM l0 UNION SELECT * FROM l1 UNION SELECT * FROM l2) JOIN nodes USING (node_id)"
)
def g18_masked_reach(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    seeds = g.nodes.where(F.col("external_id").startswith("region::"))
    return g.named(traversal.reach(g, seeds, 2, without=g.seeds(["nation::2"])), "external_id").select("external_id")


@query(f"WITH l1 AS (SELECT DISTINCT src AS node_id FROM edges WHERE dst = {id_of('part::10')}), l2 AS (SELECT DISTINCT src AS node_id FROM edges JOIN l1 ON dst = l1.node_id WHERE src NOT IN (SELECT node_id FROM l1)) SELECT external_id, depth::BIGINT AS depth FROM (SELECT node_id, 1 AS depth FROM l1 UNION ALL SELECT node_id, 2 FROM l2) JOIN nodes USING (node_id)")
def g19_type_trace(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return g.named(traversal.type_trace(g, "part::10", max_hops=2), "external_id").select("external_id", F.col("depth").cast("long").alias("depth"))


@query("SELECT 'region::0' AS a, r.external_id, 'contains' AS relation, 1::BIGINT AS step FROM nodes r WHERE false")
def g16_why_nothing(spark, sf_dir):
    g = spine_graph(spark, sf_dir)  # regions are not connected with each other
    return traversal.why(g, "region::0", "region::1").select(F.lit("region::0").alias("a"), "external_id", "relation", F.col("step").cast("long").alias("step"))


@query("SELECT external_id, step::BIGINT AS step, relation FROM (SELECT 'customer::1' AS external_id, 0 AS step, '' AS relation UNION ALL SELECT 'nation::' || c_nationkey, 1, 'contains' FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'region::' || n_regionkey, 2, 'contains' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)")
def g16_why(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey = 1").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    region = f"region::{c.first()['n_regionkey']}"
    return traversal.why(g, "customer::1", region).select("external_id", F.col("step").cast("long").alias("step"), "relation")


@query(
    f"WITH l1 AS (SELECT {id_of('region::2')} || '>' || dst AS chain, dst AS tip, causal_strength AS s FROM edges WHERE src = {id_of('region::2')} AND causal_strength > 0), l2 AS (SELECT chain || '>' || dst AS chain, dst AS tip, s * causal_strength AS s FROM l1 JOIN edges ON src = tip WHERE causal_strength > 0 AND s * causal_strength >= 0.1::DOUBLE) "
    "SELECT chain, round(s, 6) AS strength, hops::BIGINT AS hops FROM (SELECT chain, s, 1 AS hops FROM l1 UNION ALL SELECT chain, s, 2 FROM l2)"
)
def g15_causal_chains(spark, sf_dir):
    out = traversal.causal_chains(spine_graph(spark, sf_dir), "region::2", 4)
    return out.select("chain", r6("strength").alias("strength"), F.col("hops").cast("long").alias("hops"))


def _pagerank_sql(iterations: int) -> str:
    parts = ["n AS (SELECT count(*)::DOUBLE AS n FROM spine_nodes)", "d AS (SELECT src, count(*)::DOUBLE AS deg FROM spine_edges GROUP BY src)", "p0 AS MATERIALIZED (SELECT node_id, 1 / n AS pr FROM spine_nodes, n)"]
    for k in range(1, iterations + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT s.node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(m, 0) AS pr FROM spine_nodes s CROSS JOIN n LEFT JOIN (SELECT dst, sum(pr / deg) AS m FROM p{k - 1} JOIN spine_edges e ON e.src = node_id JOIN d ON d.src = node_id GROUP BY dst) t ON t.dst = s.node_id)")
    return f"WITH {', '.join(parts)} SELECT external_id, round(pr / (SELECT max(pr) FROM p{iterations}), 6) AS pagerank FROM p{iterations} JOIN spine_nodes USING (node_id)"


@query(_pagerank_sql(10))
def g1_pagerank(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return g.named(traversal.pagerank(g, max_iterations=10, fixed=True), "external_id").select("external_id", r6("pagerank").alias("pagerank"))


@query(
    f"WITH l1 AS (SELECT DISTINCT dst AS node_id FROM edges WHERE src = {id_of('customer::5')}), l2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN l1 ON src = l1.node_id), region AS (SELECT {id_of('customer::5')}::BIGINT AS node_id UNION SELECT * FROM l1 UNION SELECT * FROM l2) "
    "SELECT a.external_id AS source, b.external_id AS target, relation FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE src IN (SELECT node_id FROM region) AND dst IN (SELECT node_id FROM region)"
)
def g61_lock_region(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    e = traversal.induced(g, traversal.reach(g, g.seeds(["customer::5"]), 2)).select("src", "dst", "relation")
    e = g.named(e, "external_id", on="src").withColumnRenamed("external_id", "source")
    return g.named(e, "external_id", on="dst").select("source", F.col("external_id").alias("target"), "relation")


@query(f"SELECT external_id, 'callee' AS role, relation FROM edges JOIN nodes ON node_id = dst WHERE src = {id_of('supplier::2')} UNION ALL SELECT external_id, 'caller', relation FROM edges JOIN nodes ON node_id = src WHERE dst = {id_of('supplier::2')}")
def g54_surgical_context(spark, sf_dir):
    return traversal.neighbours(full_graph(spark, sf_dir), "supplier::2").select("external_id", "role", "relation")


@query(
    f"WITH l1 AS (SELECT DISTINCT dst AS node_id FROM edges WHERE src = {id_of('customer::7')}), l2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN l1 ON src = l1.node_id), r AS (SELECT * FROM l1 UNION SELECT * FROM l2), c AS (SELECT count(*) AS n FROM r JOIN nodes USING (node_id) WHERE node_type = 12) "
    "SELECT CAST(n AS BIGINT) AS n_files, CASE WHEN n <= 3 THEN 'low' WHEN n <= 10 THEN 'medium' ELSE 'high' END AS risk FROM c"
)
def g53_file_blast_radius(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    r = traversal.reach(g, g.seeds(["customer::7"]), 2).where("depth > 0").join(g.nodes.where("node_type = 12"), "node_id", "left_semi")
    n = r.agg(F.count(F.lit(1)).alias("n_files"))
    return n.withColumn("risk", F.when(F.col("n_files") <= 3, "low").when(F.col("n_files") <= 10, "medium").otherwise("high"))


_VERSIONS = "old_edges AS (SELECT src, dst, relation, weight FROM edges WHERE NOT (relation = 'imports' AND dst % 7 = 0)), new_edges AS (SELECT src, dst, relation, CASE WHEN relation = 'calls' AND dst % 5 = 0 THEN weight + 0.1::DOUBLE ELSE weight END AS weight FROM edges WHERE NOT (relation = 'references' AND src % 11 = 0))"


@query(f"WITH {_VERSIONS}, c AS (SELECT coalesce(o.src, n.src) AS src, coalesce(o.relation, n.relation) AS relation, CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' WHEN abs(n.weight - o.weight) > 0.001::DOUBLE THEN 'reweighted' END AS change, coalesce(n.weight - o.weight, 0) AS delta FROM old_edges o FULL JOIN new_edges n ON o.src = n.src AND o.dst = n.dst AND o.relation = n.relation) SELECT relation, change, CAST(count(*) AS BIGINT) AS n, round(sum(delta), 6) AS delta FROM c WHERE change IS NOT NULL GROUP BY ALL")
def j17_snapshot_diff(spark, sf_dir):
    e = full_graph(spark, sf_dir).edges.select("src", "dst", "relation", "weight")
    old = e.where("NOT (relation = 'imports' AND dst % 7 = 0)")
    new = e.where("NOT (relation = 'references' AND src % 11 = 0)").withColumn("weight", F.expr("CASE WHEN relation = 'calls' AND dst % 5 = 0 THEN weight + 0.1D ELSE weight END"))
    return merge.diff_edges(old, new).groupBy("relation", "change").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("delta")).alias("delta"))


@query("SELECT external_id, CASE WHEN k % 10 = 3 THEN 'removed' WHEN k % 10 = 4 THEN 'added' ELSE 'modified' END AS change FROM (SELECT external_id, node_id % 1000000000000000 AS k FROM nodes WHERE node_type = 100) WHERE k % 10 IN (3, 4, 5)")
def u7_ingest_diff(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes.where("node_type = 100").withColumn("k", F.expr("node_id % 1000000000000000 % 10"))
    new = n.where("k <> 3").withColumn("label", F.when(F.col("k") == 5, F.upper(F.concat("label", F.lit("!")))).otherwise(F.col("label")))
    return merge.diff_nodes(n.where("k <> 4"), new, ["label", "node_type"])


@query("SELECT CAST(count(*) FILTER (a) AS BIGINT) AS n_a, CAST(count(*) FILTER (b) AS BIGINT) AS n_b, CAST(count(*) FILTER (a AND b) AS BIGINT) AS shared, round(1 - count(*) FILTER (a AND b) / count(*)::DOUBLE, 6) AS drift FROM (SELECT node_id % 3 <> 0 AS a, node_id % 4 <> 0 AS b FROM nodes) WHERE a OR b")
def u2_drift(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes
    return merge.jaccard_drift(n.where("node_id % 3 <> 0"), n.where("node_id % 4 <> 0"), "node_id").withColumn("drift", r6("drift"))


@query("WITH a AS (SELECT external_id FROM nodes WHERE node_id % 3 = 0), b AS (SELECT external_id FROM nodes WHERE node_id % 5 = 0) SELECT 'shared' AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def u4_perspective_compare(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes
    a, b = n.where("node_id % 3 = 0").select("external_id"), n.where("node_id % 5 = 0").select("external_id")
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count(a.intersect(b), "shared").unionByName(count(a.subtract(b), "only_a")).unionByName(count(b.subtract(a), "only_b"))


@query("WITH a AS (SELECT * FROM edges WHERE relation IN ('contains', 'calls')), b AS (SELECT src, dst, relation, weight * 1.1::DOUBLE AS weight, causal_strength, inhibitory FROM edges WHERE relation IN ('calls', 'imports')) SELECT relation, CAST(count(*) AS BIGINT) AS n, round(sum(weight), 4) AS weight FROM (SELECT src, dst, relation, inhibitory, max(weight) AS weight FROM (SELECT src, dst, relation, weight, inhibitory FROM a UNION ALL SELECT src, dst, relation, weight, inhibitory FROM b) GROUP BY ALL) GROUP BY relation")
def u1_graph_merge(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    a = PropertyGraph(g.nodes, g.edges.where("relation IN ('contains', 'calls')"))
    b = PropertyGraph(g.nodes, g.edges.where("relation IN ('calls', 'imports')").withColumn("weight", F.col("weight") * 1.1))
    return merge.merge_graphs(a, b).edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query("WITH c AS (SELECT l_partkey AS id, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_partkey % 4 ELSE 's1' END AS source FROM lineitem) SELECT id::BIGINT AS id FROM c GROUP BY id HAVING count(DISTINCT source) = 1 AND max(source) = 's1'", graph=False)
def a11_prune_claims(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("id"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), (F.col("l_partkey") % 4).cast("string"))).otherwise("s1").alias("source"))
    return merge.prune_claims(c, "s1")


@query("SELECT external_id, label FROM (SELECT external_id, label, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY length(label) DESC, external_id) AS n FROM nodes WHERE node_type IN (11, 15)) WHERE n = 1")
def a23_dedupe_families(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes.where("node_type IN (11, 15)").withColumn("score", F.lit(1.0))
    return merge.dedupe_ranked(n, "score", "label", "external_id", 1000).select("external_id", "label")


@query(f"WITH {_DEG} SELECT external_id, r::BIGINT AS r FROM (SELECT external_id, row_number() OVER (PARTITION BY node_type ORDER BY out_degree DESC, external_id) AS r FROM degrees) WHERE r BETWEEN 7 AND 12")
def t4_route_page(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    d = g.named(g.degrees(), "external_id", "node_type")
    r = F.row_number().over(Window.partitionBy("node_type").orderBy(F.desc("out_degree"), "external_id"))
    return d.withColumn("r", r.cast("long")).where("r BETWEEN 7 AND 12").select("external_id", "r")
