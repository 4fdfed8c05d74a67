"""Topology, matching joins, layers, flow, taint and plans over the table graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import flow, matching, metrics, topology, traversal, waves
from loomgraph.operators.graph import r6
from loomgraph.queries.registry import query, table
from loomgraph.queries.texts import pagerank_sql
from loomgraph.sources.tables_graph import full_graph, id_of, spine_graph

# Communities by key: a fixed grouping that SQL can restate; label propagation itself is tested on fixtures.
_GROUP = "grp AS (SELECT node_id, node_id % 7 AS community FROM nodes)"


def _group(g):
    return g.nodes.select("node_id", (F.col("node_id") % 7).alias("community"))


@query(f"WITH {_GROUP}, e AS (SELECT s.community AS cs, t.community AS ct FROM edges JOIN grp s ON s.node_id = src JOIN grp t ON t.node_id = dst), p AS (SELECT cs AS community, count(*) FILTER (cs = ct) AS i, count(*) FILTER (cs <> ct) AS x FROM e GROUP BY cs), n AS (SELECT community, count(*) AS n FROM grp GROUP BY community) SELECT community, CAST(n AS BIGINT) AS n_nodes, CAST(coalesce(i, 0) AS BIGINT) AS internal, CAST(coalesce(x, 0) AS BIGINT) AS crossing, round(CASE WHEN n > 1 THEN least(coalesce(i, 0) / (n * (n - 1))::DOUBLE, 1.0) ELSE 0 END, 8) AS density, round(CASE WHEN i + x > 0 THEN i / (i + x)::DOUBLE ELSE 1 END, 6) AS cohesion, round(CASE WHEN i + x > 0 THEN x / (i + x)::DOUBLE ELSE 0 END, 6) AS coupling FROM n LEFT JOIN p USING (community)")
def a4_community_stats(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return metrics.coupling(g.edges, _group(g)).withColumns({"density": F.round("density", 8), "cohesion": r6("cohesion"), "coupling": r6("coupling")})


@query(f"WITH {_GROUP}, e AS (SELECT src, dst, max(weight) AS w FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY ALL), k AS (SELECT src, sum(w) AS k FROM e GROUP BY src), m AS (SELECT sum(w) AS m2 FROM e), i AS (SELECT sum(w) AS inn FROM e JOIN grp s ON s.node_id = src JOIN grp t ON t.node_id = dst WHERE s.community = t.community), q AS (SELECT sum(kc * kc) AS sq FROM (SELECT community, sum(k) AS kc FROM k JOIN grp ON node_id = src GROUP BY community)) SELECT round(inn / m2 - sq / (m2 * m2), 6) AS modularity FROM i, q, m")
def a5_modularity(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return topology.modularity(g, _group(g)).withColumn("modularity", r6("modularity"))


@query(f"WITH {_GROUP} SELECT s.community AS from_community, t.community AS to_community, CAST(count(*) AS BIGINT) AS n, round(max(weight), 6) AS top FROM edges JOIN grp s ON s.node_id = src JOIN grp t ON t.node_id = dst WHERE s.community <> t.community GROUP BY ALL")
def g21_bridges(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return topology.bridges(g, _group(g)).groupBy("from_community", "to_community").agg(F.count(F.lit(1)).alias("n"), r6(F.max("importance")).alias("top"))


@query("SELECT CASE WHEN node_id % 1000000000000000 >= 0 AND node_type IN (15) THEN node_id END AS component, CAST(n AS BIGINT) AS n FROM spine_nodes JOIN (SELECT n_regionkey AS r, 1 + count(DISTINCT n_nationkey) + count(DISTINCT s_suppkey) + count(DISTINCT c_custkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey) ON node_type = 15 AND node_id % 1000000000000000 = r")
def g23_components(spark, sf_dir):
    return topology.components(spine_graph(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH l1 AS (SELECT dst AS node_id FROM spine_edges WHERE src = {id_of('region::0')}), l2 AS (SELECT dst AS node_id FROM spine_edges JOIN l1 ON src = node_id) SELECT {id_of('region::0')}::BIGINT + r AS component, CAST(n AS BIGINT) AS size FROM (SELECT n_regionkey AS r, 1 + count(DISTINCT n_nationkey) + count(DISTINCT s_suppkey) + count(DISTINCT c_custkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey) WHERE r <> 0")
def j11_unreachable(spark, sf_dir):
    from loomgraph.operators.traversal import reach

    g = spine_graph(spark, sf_dir)
    return topology.unreached(g, reach(g, g.seeds(["region::0"]), 3))


@query("SELECT CAST(sum(CASE layer WHEN 0 THEN 1 ELSE 0 END) AS BIGINT) AS l0, CAST(sum(CASE layer WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS l1, CAST(sum(CASE layer WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS l2 FROM (SELECT CASE node_type WHEN 15 THEN 0 WHEN 14 THEN 1 ELSE 2 END AS layer FROM spine_nodes)")
def g39_layers(spark, sf_dir):
    l = topology.layers(spine_graph(spark, sf_dir))
    return l.agg(F.count_if(F.col("layer") == 0).alias("l0"), F.count_if(F.col("layer") == 1).alias("l1"), F.count_if(F.col("layer") == 2).alias("l2"))


_LAYER = "lay AS (SELECT node_id, CASE node_type WHEN 15 THEN 0 WHEN 14 THEN 2 WHEN 13 THEN 1 WHEN 100 THEN 3 WHEN 11 THEN 2 ELSE 4 END AS layer FROM nodes)"


def _layer(g):
    t = F.col("node_type")
    return g.nodes.select("node_id", F.when(t == 15, 0).when(t == 14, 2).when(t == 13, 1).when(t == 100, 3).when(t == 11, 2).otherwise(4).alias("layer"))


@query(f"WITH {_LAYER}, e AS (SELECT s.layer AS ls, t.layer AS lt, weight, relation FROM edges JOIN lay s ON s.node_id = src JOIN lay t ON t.node_id = dst WHERE t.layer < s.layer), v AS (SELECT CASE WHEN relation IN ('imports', 'depends_on') THEN 3 WHEN relation = 'calls' THEN 2 ELSE 1 END + CASE WHEN ls - lt > 1 THEN 1 ELSE 0 END + CASE WHEN weight > 0.5 THEN 1 ELSE 0 END AS p FROM e) SELECT CASE WHEN p >= 4 THEN 'critical' WHEN p = 3 THEN 'high' WHEN p = 2 THEN 'medium' ELSE 'low' END AS severity, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1")
def g40_layer_violations(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return topology.layer_violations(g, _layer(g)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LAYER}, e AS (SELECT s.layer AS layer, t.layer AS lt FROM edges JOIN lay s ON s.node_id = src JOIN lay t ON t.node_id = dst), a AS (SELECT layer, count(*) AS m, count(*) FILTER (lt = layer) AS i, count(*) FILTER (lt < layer) AS v FROM e GROUP BY layer), n AS (SELECT layer, count(*) AS n FROM lay GROUP BY layer) SELECT layer::BIGINT AS layer, CAST(n AS BIGINT) AS n_nodes, CAST(coalesce(m, 0) AS BIGINT) AS n_edges, round(coalesce(i / m::DOUBLE, 0), 6) AS cohesion, round(coalesce(v / m::DOUBLE, 0), 6) AS violation_density FROM n LEFT JOIN a USING (layer)")
def a8_layer_health(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return topology.layer_health(g, _layer(g)).select(F.col("layer").cast("long").alias("layer"), "n_nodes", "n_edges", r6("cohesion").alias("cohesion"), r6("violation_density").alias("violation_density"))


_SPINE_BOTH = "(SELECT src, dst, weight FROM spine_edges UNION ALL SELECT dst, src, weight FROM spine_edges)"
_SPINE_WEIGHTS = f"(SELECT src, dst, max(weight) AS w FROM {_SPINE_BOTH} WHERE src <> dst GROUP BY ALL)"


def _communities_sql(rounds: int, n: str = "c", nodes: str = "spine_nodes", weights: str = _SPINE_WEIGHTS) -> str:
    """Rounds of label propagation: labels ``<n><k>``."""
    parts = [f"{n}e AS MATERIALIZED {weights}", f"{n}o AS (SELECT src AS node_id, avg(w) * 0.5::DOUBLE AS w FROM {n}e GROUP BY src)", f"{n}0 AS (SELECT node_id, node_id AS c FROM {nodes})"]
    for k in range(1, rounds + 1):
        votes = f"SELECT src AS node_id, c, w FROM {n}e JOIN {n}{k - 1} l ON l.node_id = dst UNION ALL SELECT l.node_id, c, w FROM {n}{k - 1} l JOIN {n}o USING (node_id)"
        best = f"SELECT node_id, c FROM (SELECT node_id, c, sum(w) AS w FROM ({votes}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY w DESC, c) = 1"
        parts.append(f"{n}{k} AS MATERIALIZED (SELECT l.node_id, coalesce(b.c, l.c) AS c FROM {n}{k - 1} l LEFT JOIN ({best}) b USING (node_id))")
    return ", ".join(parts)


@query(f"WITH {_communities_sql(5)} SELECT c AS community, CAST(count(*) AS BIGINT) AS size FROM c5 GROUP BY c")
def g20_communities(spark, sf_dir):
    return topology.communities(spine_graph(spark, sf_dir), 5).groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def _louvain_sql(rounds: int) -> str:
    """Rounds of local moves over the whole graph: labels ``l<k>``."""
    parts = [
        "le AS MATERIALIZED (SELECT src, dst, max(weight) AS w FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) WHERE src <> dst GROUP BY ALL)", "lm AS MATERIALIZED (SELECT sum(w) AS m2 FROM le)",
        "l0 AS MATERIALIZED (SELECT node_id, node_id AS c, coalesce(k, 0.0::DOUBLE) AS k FROM nodes LEFT JOIN (SELECT src, sum(w) AS k FROM le GROUP BY src) ON src = node_id)",
    ]
    for r in range(rounds):
        p = f"l{r}"
        parts += [
            f"li{r} AS MATERIALIZED (SELECT src AS node_id, c, sum(w) AS w FROM le JOIN {p} ON node_id = dst GROUP BY ALL)", f"lt{r} AS MATERIALIZED (SELECT c, sum(k) AS t FROM {p} GROUP BY c)",
            f"lw{r} AS MATERIALIZED (SELECT i.node_id, i.c, round((i.w / m2 - n.t * l.k / (m2 * m2)) - (coalesce(o.w, 0) / m2 - (ot.t - l.k) * l.k / (m2 * m2)), 12) AS gain FROM li{r} i JOIN {p} l ON l.node_id = i.node_id JOIN lt{r} n ON n.c = i.c JOIN lt{r} ot ON ot.c = l.c LEFT JOIN li{r} o ON o.node_id = l.node_id AND o.c = l.c, lm WHERE i.c <> l.c)",
            f"lb{r} AS MATERIALIZED (SELECT node_id, c, ((node_id % 1000003) + 1) * {48_271 + 2 * r} % 2147483647 // 1024 % 2 = {r % 2} AS turn FROM lw{r} WHERE gain > 0.000000000001::DOUBLE QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY gain DESC, c) = 1)",
            f"l{r + 1} AS MATERIALIZED (SELECT l.node_id, coalesce(b.c, l.c) AS c, l.k FROM {p} l LEFT JOIN (SELECT * FROM lb{r} WHERE turn) b ON b.node_id = l.node_id)",
        ]
    return ", ".join(parts)


@query(f"WITH {_louvain_sql(3)} SELECT c AS community, CAST(count(*) AS BIGINT) AS size, round(sum(k), 3) AS degree FROM l3 GROUP BY c")
def g20_louvain(spark, sf_dir):
    """Three rounds of local moves over the whole graph."""
    g = full_graph(spark, sf_dir)
    return topology.louvain(g, 3, degrees=True).groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("k"), 3).alias("degree"))


def _spectral_sql(iterations: int) -> str:
    parts = [
        "se AS MATERIALIZED (SELECT src, dst, max(weight) AS w FROM (SELECT src, dst, weight FROM spine_edges UNION ALL SELECT dst, src, weight FROM spine_edges) WHERE src <> dst GROUP BY ALL)",
        "sd AS (SELECT node_id, coalesce(d, 0.0::DOUBLE) AS d FROM spine_nodes LEFT JOIN (SELECT src, sum(w) AS d FROM se GROUP BY src) ON src = node_id)", "st AS (SELECT max(d) * 2.1::DOUBLE AS top FROM sd)",
        "v0 AS (SELECT node_id, d, (node_id % 1009) / 1009.0::DOUBLE - 0.5::DOUBLE AS z FROM sd)",
    ]
    for k in range(1, iterations + 1):
        parts.append(f"s{k} AS (SELECT avg(z) AS mean, sqrt(greatest(sum(z * z) - count(*) * avg(z) * avg(z), 0)) AS norm FROM v{k - 1})")
        parts.append(f"u{k} AS MATERIALIZED (SELECT node_id, d, (z - mean) / norm AS x FROM v{k - 1}, s{k})")
        parts.append(f"v{k} AS MATERIALIZED (SELECT node_id, d, x, top * x - d * x + coalesce(ay, 0) AS z FROM u{k} LEFT JOIN (SELECT src, sum(w * x) AS ay FROM se JOIN u{k} ON node_id = dst GROUP BY src) ON src = node_id, st)")
    return ", ".join(parts) + f", gap AS (SELECT greatest(any_value(top) - sum(x * z), 0) AS gap FROM v{iterations}, st)"


_ROBUST = "CASE WHEN gap < 0.01 THEN 'Fragile' WHEN gap < 0.5 THEN 'Moderate' ELSE 'Robust' END"


@query(f"WITH {_spectral_sql(8)} SELECT round(gap, 6) AS spectral_gap, {_ROBUST} AS robustness FROM gap")
def g22_spectral_gap(spark, sf_dir):
    return topology.spectral_gap(spine_graph(spark, sf_dir), 8).withColumn("spectral_gap", r6("spectral_gap"))


@query(
    f"WITH {_spectral_sql(8)}, grp AS (SELECT node_id, node_id % 7 AS c FROM spine_nodes), me AS (SELECT sum(w) AS m2 FROM se), mk AS (SELECT sum(kc * kc) AS sq FROM (SELECT c, sum(w) AS kc FROM se JOIN grp ON node_id = src GROUP BY c)), mi AS (SELECT sum(w) AS inn FROM se JOIN grp a ON a.node_id = src JOIN grp b ON b.node_id = dst WHERE a.c = b.c), "
    f"br AS (SELECT count(*) AS n FROM spine_edges JOIN grp a ON a.node_id = src JOIN grp b ON b.node_id = dst WHERE a.c <> b.c) SELECT CAST((SELECT count(DISTINCT c) FROM grp) AS BIGINT) AS n_communities, CAST((SELECT count(*) FROM grp) AS BIGINT) AS n_nodes, round(inn / m2 - sq / (m2 * m2), 6) AS modularity, CAST(n AS BIGINT) AS n_bridges, round(gap, 6) AS spectral_gap, {_ROBUST} AS robustness FROM gap, me, mk, mi, br"
)
def g26_topology(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return topology.topology_report(g, _group(g), 8).withColumns({"modularity": r6("modularity"), "spectral_gap": r6("spectral_gap")})


_COARSE = f"(SELECT a.c AS src, b.c AS dst, sum(weight) AS w FROM {_SPINE_BOTH} e JOIN c10 a ON a.node_id = src JOIN c10 b ON b.node_id = dst WHERE a.c <> b.c GROUP BY ALL)"
_SCALE = "SELECT {0} AS scale, n.c AS community, n.n AS size, CAST(coalesce(internal, 0) AS BIGINT) AS internal, CAST(coalesce(crossing, 0) AS BIGINT) AS crossing FROM (SELECT c, count(*) AS n FROM {1} GROUP BY c) n LEFT JOIN (SELECT a.c, count(*) FILTER (a.c = b.c) AS internal, count(*) FILTER (a.c <> b.c) AS crossing FROM spine_edges JOIN {1} a ON a.node_id = src JOIN {1} b ON b.node_id = dst GROUP BY a.c) e USING (c)"


@query(f"WITH {_communities_sql(10)}, {_communities_sql(10, 'dd', '(SELECT DISTINCT c AS node_id FROM c10)', _COARSE)}, cd AS MATERIALIZED (SELECT x.node_id, y.c FROM c10 x JOIN dd10 y ON y.node_id = x.c) {_SCALE.format(0, 'c10')} UNION ALL {_SCALE.format(1, 'cd')}")
def g25_scales(spark, sf_dir):
    return topology.scale_views(spine_graph(spark, sf_dir), 2)


@query("WITH e AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM e a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) <= 5", graph=False)
def g24_nearest_fingerprints(spark, sf_dir):
    """The five nearest fingerprints of every 100th vector, against all of them."""
    e = table(spark, sf_dir, "embeddings")
    return topology.similar_pairs(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", top=5).withColumn("similarity", r6("similarity"))


_UNIT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_UNIT}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND {_UNIT} >= 0.3::DOUBLE", graph=False)
def g24_equivalents(spark, sf_dir):
    """All fingerprints as like as 0.3 to every 100th one."""
    e = table(spark, sf_dir, "embeddings")
    return topology.equivalents(e, "vec_id", "embedding", 0.3, e.where("vec_id % 100 = 0")).withColumn("similarity", r6("similarity"))


@query(f"WITH {_GROUP}, e AS (SELECT s.community AS cs, t.community AS ct FROM edges JOIN grp s ON s.node_id = src JOIN grp t ON t.node_id = dst), o AS (SELECT cs AS community, count(*) FILTER (cs = ct) AS i, count(*) FILTER (cs <> ct) AS x FROM e GROUP BY cs), n AS (SELECT ct AS community, count(*) AS inc FROM e WHERE cs <> ct GROUP BY ct), z AS (SELECT community, count(*) AS n FROM grp GROUP BY community), m AS (SELECT count(*) AS m FROM edges) SELECT community, CAST(n AS BIGINT) AS n_nodes, round(i / (i + x)::DOUBLE, 6) AS cohesion, CAST(x + coalesce(inc, 0) AS BIGINT) AS interface, CASE WHEN (x + coalesce(inc, 0)) / m::DOUBLE < 0.05 THEN 'low' WHEN (x + coalesce(inc, 0)) / m::DOUBLE < 0.15 THEN 'medium' WHEN (x + coalesce(inc, 0)) / m::DOUBLE < 0.3 THEN 'high' ELSE 'critical' END AS risk FROM z JOIN o USING (community) LEFT JOIN n USING (community), m")
def g42_refactor_plan(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return topology.refactor_plan(g, _group(g)).withColumn("cohesion", r6("cohesion"))


# --- joins ------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT o_orderkey AS src, 'ref::' || o_orderpriority AS ref, lower(trim(split_part(o_orderpriority, '-', 2))) AS name FROM orders), t AS (SELECT 'm::' || n_nationkey AS external_id, lower(trim(split_part(p, '-', 2))) AS name FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders)) SELECT 'o::' || src AS src, name AS ref, min(external_id) AS target FROM r JOIN t USING (name) GROUP BY ALL", graph=False)
def j3_reference_resolution(spark, sf_dir):
    name = lambda c: F.lower(F.trim(F.element_at(F.split(c, "-"), 2)))
    o = table(spark, sf_dir, "orders")
    refs = o.select(F.concat(F.lit("o::"), F.col("o_orderkey").cast("string")).alias("src"), name("o_orderpriority").alias("ref"), F.lit(None).cast("string").alias("hint"))
    kinds = o.select("o_orderpriority").distinct()
    nodes = table(spark, sf_dir, "nation").crossJoin(F.broadcast(kinds)).select(F.concat(F.lit("m::"), F.col("n_nationkey").cast("string")).alias("external_id"), name("o_orderpriority").alias("label"))  # five kinds
    return matching.resolve_references(refs, nodes).select("src", "ref", "target")


@query("WITH i AS (SELECT p_partkey AS src, 'pkg.' || lower(p_brand) || '.' || p_size || '.x' AS module FROM part), m AS (SELECT DISTINCT 'pkg.' || lower(p_brand) AS module FROM part UNION SELECT DISTINCT 'pkg.' || lower(p_brand) || '.' || p_size FROM part WHERE p_size % 2 = 0) SELECT src, i.module, max_by(m.module, length(m.module)) AS target FROM i JOIN m ON i.module = m.module OR starts_with(i.module, m.module || '.') GROUP BY ALL", graph=False)
def j4_module_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    base = F.concat(F.lit("pkg."), F.lower("p_brand"))
    sized = F.concat(base, F.lit("."), F.col("p_size").cast("string"))
    imports = p.select(F.col("p_partkey").alias("src"), F.concat(sized, F.lit(".x")).alias("module"))
    modules = p.select(base.alias("module")).union(p.where("p_size % 2 = 0").select(sized)).distinct().withColumn("external_id", F.col("module"))
    return matching.resolve_modules(imports, modules)


@query("WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'test_' ELSE '' END || 'm' || (p_partkey // 2) AS stem FROM part) SELECT a.k AS test, b.k AS target FROM f a JOIN f b ON b.stem = replace(a.stem, 'test_', '') WHERE starts_with(a.stem, 'test_')", graph=False)
def j5_test_edges(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "test_").otherwise(""), F.lit("m"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("stem"))
    return matching.test_edges(f)


@query("WITH n AS (SELECT 's' AS ns, s_suppkey AS id, CAST(round(s_acctbal) AS BIGINT) AS k FROM supplier UNION ALL SELECT 'c', 1000000 + c_custkey, CAST(round(c_acctbal) AS BIGINT) FROM customer), z AS (SELECT k FROM n GROUP BY k HAVING count(DISTINCT id) BETWEEN 2 AND 20) SELECT DISTINCT a.id AS a, b.id AS b, 'shared_keyword' AS relation, 0.6::DOUBLE AS weight FROM n a JOIN n b ON a.k = b.k AND a.ns < b.ns WHERE a.k IN (SELECT k FROM z)", graph=False)
def j6_cross_domain(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("namespace"), F.col("s_suppkey").alias("id"), F.round("s_acctbal").cast("long").alias("key"))
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("namespace"), (F.col("c_custkey") + 1000000).alias("id"), F.round("c_acctbal").cast("long").alias("key"))
    return matching.cross_links(s.unionByName(c), "key", "shared_keyword", 0.6)


@query("SELECT DISTINCT a.src, b.dst, 'citation_chain' AS relation, 0.5::DOUBLE AS weight FROM spine_edges a JOIN spine_edges b ON a.dst = b.src WHERE a.src <> b.dst")
def j7_two_hop(spark, sf_dir):
    return matching.two_hop(spine_graph(spark, sf_dir).edges.select("src", "dst"))


@query("WITH n AS (SELECT 'a' AS repo, 'route' AS kind, 'r' || (c_custkey % 300) AS norm, c_custkey AS id FROM customer UNION ALL SELECT 'b', 'route', 'r' || (s_suppkey * 3), 1000000 + s_suppkey FROM supplier) SELECT 'x::' || a.id AS a, 'x::' || b.id AS b, 'api_contract' AS relation, 0.8::DOUBLE AS weight FROM n a JOIN n b ON a.norm = b.norm AND a.repo < b.repo WHERE length(a.norm) > 2", graph=False)
def j8_cross_repo(spark, sf_dir):
    mk = lambda df, repo, label, i: df.select(F.lit(repo).alias("repo"), F.lit("route").alias("kind"), label.alias("label"), F.concat(F.lit("x::"), i.cast("string")).alias("external_id"))
    a = mk(table(spark, sf_dir, "customer"), "a", F.concat(F.lit("R-"), (F.col("c_custkey") % 300).cast("string")), F.col("c_custkey"))
    b = mk(table(spark, sf_dir, "supplier"), "b", F.concat(F.lit("r"), (F.col("s_suppkey") * 3).cast("string")), F.col("s_suppkey") + 1000000)
    return matching.cross_repo_edges(a.unionByName(b))


@query("WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS frame_no, l_partkey // 3 AS path, l_linenumber * 7 AS line FROM lineitem), n AS (SELECT p_partkey AS id, p_partkey // 3 AS path, p_size AS a, p_size + p_partkey % 13 AS b FROM part) SELECT frame_no, arg_min(id, (b - a) * 10000000000 + id) AS external_id FROM f JOIN n USING (path) WHERE line BETWEEN a AND b GROUP BY frame_no", graph=False)
def j13_stack_frames(spark, sf_dir):
    path = lambda c: F.floor(F.col(c) / 3)
    f = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_no"), path("l_partkey").alias("path"), (F.col("l_linenumber") * 7).alias("line"))
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), path("p_partkey").alias("path"), F.col("p_size").alias("line_start"), (F.col("p_size") + F.col("p_partkey") % 13).alias("line_end"))
    return matching.frames_to_nodes(f, n)


@query("WITH s AS (SELECT DISTINCT event_type AS name FROM events), n AS (SELECT r_name AS external_id, lower(r_name) AS low FROM region UNION ALL SELECT 'k' || i, low FROM (VALUES (1, 'purchase'), (2, 'clicks'), (3, 'user_signup_flow'), (4, 'err')) t(i, low)), x AS (SELECT name, min(external_id) AS external_id FROM s JOIN n ON lower(name) = low GROUP BY name) SELECT * FROM x UNION ALL SELECT name, min(external_id) FROM s JOIN n ON length(name) >= 4 AND length(low) >= 4 AND 2 * least(length(low), length(name)) >= greatest(length(low), length(name)) AND (contains(name, low) OR contains(low, name)) WHERE name NOT IN (SELECT name FROM x) GROUP BY name", graph=False)
def j14_span_labels(spark, sf_dir):
    extra = spark.createDataFrame([("k1", "Purchase"), ("k2", "clicks"), ("k3", "user_signup_flow"), ("k4", "err")], "external_id string, label string")
    nodes = table(spark, sf_dir, "region").select(F.col("r_name").alias("external_id"), F.col("r_name").alias("label")).unionByName(extra)
    return matching.spans_to_labels(table(spark, sf_dir, "events").select(F.col("event_type").alias("name")), nodes)


@query(
    "WITH n AS (SELECT lower(p_name) AS low, min(p_partkey) AS external_id FROM part GROUP BY 1), s AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 3, length(p_name) - 3 - p_partkey % 4) AS name FROM part UNION SELECT DISTINCT 'the ' || p_name FROM part), x AS (SELECT name, external_id FROM s JOIN n ON lower(name) = low), "
    "f AS (SELECT name, min(external_id) AS external_id FROM s JOIN n ON length(name) >= 4 AND length(low) >= 4 AND 2 * least(length(low), length(name)) >= greatest(length(low), length(name)) AND (contains(lower(name), low) OR contains(low, lower(name))) WHERE name NOT IN (SELECT name FROM x) GROUP BY name) SELECT * FROM x UNION ALL SELECT * FROM f", graph=False
)
def j14_contained_names(spark, sf_dir):
    """Spans named by a piece of a part's name, or by more than it, against all parts: an index of trigrams."""
    p = table(spark, sf_dir, "part")
    piece = F.substr("p_name", (1 + F.col("p_partkey") % 3).cast("int"), (F.length("p_name") - 3 - F.col("p_partkey") % 4).cast("int"))
    names = p.select(piece.alias("name")).unionByName(p.select(F.concat(F.lit("the "), "p_name").alias("name")))
    return matching.spans_to_labels(names, p.select(F.col("p_partkey").alias("external_id"), F.col("p_name").alias("label")))


_PATTERN = matching.Pattern("returned", [{"node_type": 100, "label_contains": "7"}, {"node_type": 11}, {"node_type": 12}], [(0, 1, "calls"), (1, 2, "references")], [(2, 0, None)])


_MATCH = (
    "pc AS MATERIALIZED (SELECT node_id FROM nodes WHERE node_type = 100 AND contains(lower(label), '7')), po AS MATERIALIZED (SELECT src AS n0, dst AS n1 FROM edges WHERE relation = 'calls' AND src IN (SELECT node_id FROM pc)), "
    "pm AS MATERIALIZED (SELECT n0, n1, dst AS n2 FROM po JOIN (SELECT src, dst FROM edges WHERE relation = 'references') ON src = n1)"
)


@query(f"WITH {_MATCH} SELECT n0, n1, n2 FROM pm")
def j15_pattern_match(spark, sf_dir):
    return matching.match_pattern(full_graph(spark, sf_dir), _PATTERN)


@query(f"WITH {_MATCH}, vm AS (SELECT src AS n0 FROM edges JOIN nodes ON node_id = dst WHERE relation = 'imports' AND contains(lower(label), 'red')), s AS (SELECT 'returned' AS pattern, 0.5::DOUBLE AS severity, n0 FROM pm UNION ALL SELECT 'vendor', 0.8, n0 FROM vm) SELECT pattern, severity, min(n0) AS first_node, CAST(least(count(*), 50) AS BIGINT) AS matches, count(*) >= 50 AS disabled FROM s GROUP BY ALL")
def g57_antibody_scan(spark, sf_dir):
    two = matching.Pattern("vendor", [{"node_type": 13}, {"node_type": 12, "label_contains": "red"}], [(0, 1, "imports")], [], 0.8)
    return matching.scan_patterns(full_graph(spark, sf_dir), [_PATTERN, two])


@query(
    "WITH a AS (SELECT dst AS p, count(*) AS k, min(src) AS f FROM (SELECT DISTINCT src, dst FROM edges WHERE relation = 'references') GROUP BY dst), b AS (SELECT dst AS p, count(*) AS k FROM (SELECT DISTINCT src, dst FROM edges WHERE relation = 'imports') GROUP BY dst) "
    "SELECT CAST((SELECT sum(k) FROM a) * (SELECT sum(k) FROM b) - (SELECT sum(a.k * b.k) FROM a JOIN b USING (p)) AS BIGINT) AS matches, (SELECT min(f) FROM a) AS first_node"
)
def g57_separate_parts(spark, sf_dir):
    """Orders with a part next to suppliers with another part: counted, never crossed."""
    two = matching.Pattern("apart", [{"node_type": 11}, {"node_type": 12}, {"node_type": 13}, {"node_type": 12}], [(0, 1, "references"), (2, 3, "imports")])
    return matching.match_count(full_graph(spark, sf_dir), two)


@query("WITH c AS (SELECT DISTINCT lower(x) AS low FROM (SELECT unnest(['nation::3', 'ASIA', '17', 'customer#000000011', 'steel']) AS x)), n AS (SELECT external_id, lower(label) AS l, lower(external_id) AS i FROM nodes), m AS (SELECT low, external_id, 1.0::DOUBLE AS s FROM c JOIN n ON low = i UNION ALL SELECT low, external_id, 0.92 FROM c JOIN n ON low = l UNION ALL SELECT low, external_id, 0.88 FROM c JOIN n ON low = split_part(i, '::', 2) UNION ALL SELECT low, external_id, 0.8 FROM c JOIN (SELECT external_id, unnest(regexp_split_to_array(l, '[\\s#_./:-]+')) AS p FROM n) ON low = p), b AS (SELECT low, external_id, max(s) AS s FROM m GROUP BY ALL) SELECT low AS candidate, external_id, s AS score FROM b QUALIFY row_number() OVER (PARTITION BY low ORDER BY s DESC, external_id) <= 10")
def j16_document_bindings(spark, sf_dir):
    c = spark.createDataFrame([(x,) for x in ("nation::3", "asia", "17", "customer#000000011", "steel")], "candidate string")
    return matching.bindings(c, full_graph(spark, sf_dir).nodes)


# --- waves, flow, taint, plans -----------------------------------------------------------------------


def _wave_sql(tones: list[tuple[int, float, float]], seeds: list[str], hops: int, faintest: float) -> str:
    """amp: tone, node_id, amplitude of the pulses of every tone over the spine, hop by hop."""
    step = f"2 * pi() * {{f}}::DOUBLE / {{w}}::DOUBLE"
    t = ", ".join(f"({n}, {step.format(f=f, w=w)})" for n, f, w in tones)
    parts = [
        "we AS MATERIALIZED (SELECT src, dst, weight FROM spine_edges UNION ALL SELECT dst, src, weight FROM spine_edges)", "wd AS (SELECT src, count(*) AS deg FROM we GROUP BY src)", "wk AS MATERIALIZED (SELECT src, deg, deg / (SELECT avg(deg) FROM wd) > 4 AS hub FROM wd)",
        f"wt AS (SELECT * FROM (VALUES {t}) t(tone, step))", f"w0 AS (SELECT tone, step, node_id, -1::BIGINT AS prev, 1.0::DOUBLE AS amp, 0.0::DOUBLE AS phase FROM (SELECT unnest([{', '.join(str(id_of(x)) for x in seeds)}])::BIGINT AS node_id), wt)",
    ]
    for k in range(hops):
        ahead = f"SELECT tone, step, dst AS node_id, e.src AS prev, amp * weight * CASE WHEN hub THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END / deg AS amp, phase + step AS phase FROM w{k} l JOIN we e ON e.src = l.node_id JOIN wk ON wk.src = l.node_id WHERE NOT (deg = 1 AND {k} > 0) AND dst <> prev"
        back = f"SELECT tone, step, prev, node_id, amp * CASE WHEN deg = 1 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END, phase + pi() + step FROM w{k} l JOIN wk ON wk.src = l.node_id WHERE prev >= 0 AND (deg = 1 OR hub)"
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * FROM ({ahead} UNION ALL {back}) WHERE amp >= {faintest}::DOUBLE)")
    union = " UNION ALL ".join(f"SELECT tone, node_id, amp, phase FROM w{k}" for k in range(hops + 1))
    return f"{', '.join(parts)}, wz AS (SELECT tone, node_id, sum(amp * cos(phase)) AS x, sum(amp * sin(phase)) AS y FROM ({union}) GROUP BY ALL), amp AS (SELECT tone, node_id, sqrt(x * x + y * y) AS amplitude FROM wz)"


@query(f"WITH {_wave_sql([(1, 1.0, 4.0)], ['region::0'], 3, 0.0001)} SELECT external_id, round(amplitude, 6) AS amplitude FROM amp JOIN spine_nodes USING (node_id)")
def g27_standing_wave(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    tones = spark.createDataFrame([(1, 1.0, 4.0)], "tone int, frequency double, wavelength double")
    return g.named(waves.standing_wave(g, g.seeds(["region::0"]), tones, 3, 0.0001), "external_id").select("external_id", r6("amplitude").alias("amplitude"))


_HARMONICS = [(h, float(h), 4.0 / h) for h in range(1, 6)]


@query(f"WITH {_wave_sql(_HARMONICS, ['nation::1'], 3, 0.0001)}, s AS (SELECT node_id, string_agg(tone::VARCHAR, ',' ORDER BY tone::VARCHAR) AS signature FROM amp WHERE amplitude >= 0.001::DOUBLE GROUP BY node_id) SELECT signature, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY signature")
def g28_harmonics(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return waves.harmonics(g, g.seeds(["nation::1"]), hops=3, least=0.001, faintest=0.0001).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


_SWEEP = [(k, 0.1 + 9.9 * k / 19, max(10.0 / (0.1 + 9.9 * k / 19), 0.1)) for k in range(20)]


@query(f"WITH {_wave_sql(_SWEEP, ['nation::1', 'region::2'], 2, 0.01)}, e AS (SELECT tone, round(sum(amplitude), 9) AS energy FROM amp GROUP BY tone), f AS (SELECT *, lag(energy) OVER (ORDER BY tone) AS p, lead(energy) OVER (ORDER BY tone) AS n FROM e) SELECT round(0.1::DOUBLE + 9.9::DOUBLE * tone / 19, 6) AS frequency, round(energy, 6) AS energy FROM f WHERE energy > p AND energy > n")
def g29_sweep(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return waves.sweep(g, g.seeds(["nation::1", "region::2"]), hops=2).select(r6("frequency").alias("frequency"), r6("energy").alias("energy"))


@query(f"WITH {_wave_sql([(1, 1.0, 4.0)], ['customer::1'], 3, 0.00001)}, h1 AS (SELECT DISTINCT dst AS node_id FROM we WHERE src = {id_of('customer::1')}), h2 AS (SELECT DISTINCT dst AS node_id FROM we JOIN h1 ON src = node_id) SELECT node_id, round(amplitude, 6) AS amplitude FROM amp WHERE amplitude >= 0.0001::DOUBLE AND node_id <> {id_of('customer::1')} AND node_id NOT IN (SELECT node_id FROM h1) AND node_id NOT IN (SELECT node_id FROM h2)")
def g30_sympathetic(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return waves.sympathetic(g, g.seeds(["customer::1"]), least=0.0001, hops=3, faintest=0.00001).withColumn("amplitude", r6("amplitude"))


@query(f"WITH {_wave_sql([(1, 1.0, 4.0)], ['region::0'], 2, 0.0001)}, t AS (SELECT max(amplitude) AS top FROM amp) SELECT external_id, label, round(amplitude, 6) AS amplitude, CASE WHEN round(amplitude, 9) >= round(0.5 * top, 9) THEN 'antinode' WHEN round(amplitude, 9) <= round(0.1 * top, 9) THEN 'node' ELSE 'between' END AS kind FROM amp JOIN spine_nodes USING (node_id), t")
def k7_wave_export(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    tones = spark.createDataFrame([(1, 1.0, 4.0)], "tone int, frequency double, wavelength double")
    wave = waves.standing_wave(g, g.seeds(["region::0"]), tones, 2, 0.0001)
    return waves.wave_export(g, wave).select("external_id", "label", r6("amplitude").alias("amplitude"), "kind")


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE NOT inhibitory AND weight >= 0.1::DOUBLE), o AS (SELECT unnest([{id_of('customer::1')}, {id_of('customer::2')}, {id_of('customer::4')}])::BIGINT AS origin), l1 AS (SELECT DISTINCT origin, dst AS node_id FROM o JOIN e ON src = origin), l2 AS (SELECT DISTINCT origin, dst AS node_id FROM l1 JOIN e ON src = node_id) SELECT origin, depth::BIGINT AS depth, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY ALL")
def g37_flow(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    f = flow.flow_paths(g, g.seeds(["customer::1", "customer::2", "customer::4"]), 2, budget=None)
    return f.where("depth > 0").groupBy("origin", "depth").agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.col("depth").cast("long"))


def _flow_sql(origins: list[str], depth: int) -> str:
    """fl: origin, node_id, lock, depth of particles that visit no node of an origin twice."""
    words = lambda ws: " OR ".join(f"contains(lower(label), '{w}')" for w in ws)
    parts = [
        f"fn AS MATERIALIZED (SELECT node_id, ({words(flow.VALVES)}) AS valve, ({words(flow.READ_ONLY)}) AS reads FROM nodes)", "fe AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE NOT inhibitory AND weight >= 0.1::DOUBLE)",
        f"f0 AS (SELECT node_id AS origin, node_id, valve AS lock FROM fn WHERE node_id IN ({', '.join(str(id_of(o)) for o in origins)}))",
    ]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT origin, node_id FROM f{i}" for i in range(k))
        parts.append(f"f{k} AS MATERIALIZED (SELECT origin, dst AS node_id, bool_or(l.lock OR n.valve) AS lock FROM f{k - 1} l JOIN fe ON src = l.node_id JOIN fn n ON n.node_id = dst WHERE (origin, dst) NOT IN ({seen}) GROUP BY ALL)")
    return ", ".join(parts) + ", fl AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, depth + 1)) + ")"


@query(
    f"WITH {_flow_sql(['nation::1', 'nation::2', 'nation::3'], 3)}, r AS (SELECT node_id, count(DISTINCT origin) AS origins, count(DISTINCT CASE WHEN NOT lock THEN origin END) AS free, bool_or(lock) AS locked FROM fl GROUP BY node_id HAVING count(DISTINCT origin) > 1), i AS (SELECT dst AS node_id, count(*) AS indeg FROM edges GROUP BY dst), "
    "z AS (SELECT node_id, origins, locked, CASE WHEN free > 1 THEN free ELSE origins END AS hit, valve, reads, coalesce(indeg, 0) / (SELECT max(indeg) FROM i)::DOUBLE AS c FROM r JOIN fn USING (node_id) LEFT JOIN i USING (node_id)), "
    "q AS (SELECT *, least(hit / 2.0::DOUBLE, 1) * CASE WHEN valve THEN 0.0::DOUBLE WHEN locked THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN reads THEN 0.2::DOUBLE ELSE 1 END * (0.5::DOUBLE + 0.5::DOUBLE * c) * CASE WHEN reads AND c > 0.9 THEN 0.1::DOUBLE ELSE 1 END AS score FROM z) "
    "SELECT external_id, CAST(origins AS BIGINT) AS origins, round(score, 6) AS score, CASE WHEN score >= 0.8 AND hit >= 3 AND NOT locked THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium' ELSE 'Low' END AS severity FROM q JOIN nodes USING (node_id) WHERE score >= 0.3::DOUBLE"
)
def g37_turbulence(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    f = flow.flow_paths(g, g.seeds(["nation::1", "nation::2", "nation::3"]), 3, budget=None)
    return g.named(flow.turbulence(g, f, 2, 0.3), "external_id").select("external_id", "origins", r6("score").alias("score"), "severity")


@query(f"WITH l1 AS (SELECT DISTINCT dst AS node_id FROM edges WHERE src = {id_of('customer::1')}), l2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN l1 ON src = node_id), o2 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN l1 ON src = node_id JOIN nodes n ON n.node_id = src WHERE NOT contains(lower(n.label), 'high')) SELECT external_id, depth::BIGINT AS depth, leaked FROM (SELECT node_id, 1 AS depth, true AS leaked FROM l1 UNION ALL SELECT node_id, 2, node_id IN (SELECT node_id FROM o2) FROM l2) JOIN nodes USING (node_id)")
def g38_taint(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    return g.named(flow.taint(g, ["customer::1"], ("high",), 2), "external_id").select("external_id", F.col("depth").cast("long").alias("depth"), "leaked")


_TAINT = (
    f"n0 AS (SELECT {id_of('nation::2')}::BIGINT AS node_id), op AS MATERIALIZED (SELECT node_id FROM nodes WHERE NOT (contains(lower(label), 'high') OR contains(lower(label), 'urgent'))), a1 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN n0 ON src = node_id), a2 AS MATERIALIZED (SELECT DISTINCT dst AS node_id FROM edges JOIN a1 ON src = node_id), a3 AS (SELECT DISTINCT dst AS node_id FROM edges JOIN a2 ON src = node_id), "
    "ar AS (SELECT node_id FROM a1 UNION SELECT node_id FROM a2 UNION SELECT node_id FROM a3), oe AS MATERIALIZED (SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM op)), b1 AS (SELECT DISTINCT dst AS node_id FROM oe JOIN n0 ON src = node_id), b2 AS MATERIALIZED (SELECT DISTINCT dst AS node_id FROM oe JOIN b1 ON src = node_id), b3 AS (SELECT DISTINCT dst AS node_id FROM oe JOIN b2 ON src = node_id), bl AS (SELECT node_id FROM b1 UNION SELECT node_id FROM b2 UNION SELECT node_id FROM b3)"
)


@query(f"WITH {_TAINT}, z AS (SELECT count(*) AS n, count(*) FILTER (node_id NOT IN (SELECT node_id FROM op)) AS hits, count(*) FILTER (node_id IN (SELECT node_id FROM bl)) AS leaks FROM ar) SELECT CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, CAST(leaks AS BIGINT) AS leaks, round(0.4::DOUBLE * (1 - hits / n::DOUBLE) + 0.35::DOUBLE * least(ln(1 + leaks) / 5, 1) + 0.25::DOUBLE * least(n / 100.0::DOUBLE, 1), 6) AS risk FROM z")
def g38_taint_risk(spark, sf_dir):
    return flow.taint_risk(flow.taint(full_graph(spark, sf_dir).finalised(), ["nation::2"], ("high", "urgent"), 3)).withColumn("risk", r6("risk"))


@query(f"WITH u AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), l1 AS (SELECT DISTINCT dst AS node_id FROM u WHERE src = {id_of('customer::3')}), l2 AS (SELECT DISTINCT dst AS node_id FROM u JOIN l1 ON src = node_id WHERE dst <> {id_of('customer::3')} AND dst NOT IN (SELECT node_id FROM l1)), r AS (SELECT node_id, 1 AS depth FROM l1 UNION ALL SELECT node_id, 2 FROM l2), h AS (SELECT *, CASE WHEN node_id % 9 = 0 THEN 0.6::DOUBLE WHEN node_id % 9 = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS heat, node_id % 4 = 0 AS tested FROM r), a AS (SELECT count(*) AS blast, count(*) FILTER (depth = 1 OR heat >= 0.55::DOUBLE) AS critical, count(*) FILTER (NOT (depth = 1 OR heat >= 0.55::DOUBLE) AND heat >= 0.25::DOUBLE) AS warnings, avg(CASE WHEN tested THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS un, coalesce(max(heat), 0) AS heat FROM h), z AS (SELECT *, 0.3::DOUBLE * least(0.1::DOUBLE * critical, 1.0) + 0.25::DOUBLE * un + 0.2::DOUBLE * blast / (SELECT count(*) FROM nodes) + 0.25::DOUBLE * heat AS risk FROM a) SELECT CAST(blast AS BIGINT) AS blast, CAST(critical AS BIGINT) AS critical, CAST(warnings AS BIGINT) AS warnings, round(risk, 6) AS risk, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM z")
def g51_validate_plan(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    hot = g.nodes.select("node_id", F.when(F.col("node_id") % 9 == 0, 0.6).when(F.col("node_id") % 9 == 1, 0.3).otherwise(0.0).alias("heat"))
    return flow.validate_plan(g, ["customer::3"], g.nodes.where("node_id % 4 = 0"), hot, 2).withColumn("risk", r6("risk"))


@query("SELECT 'depends_on' AS kind, 2::BIGINT AS hops, 1::BIGINT AS into, round(2.0::DOUBLE / 3, 6) AS confidence, 'open' AS verdict FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1 AND n_regionkey = (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1)", graph=False)
def g56_hypothesize(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_custkey = 1").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).first()
    out = flow.hypothesize(g, f"{c['r_name']} reaches {c['c_name']}")
    return out.select("kind", F.col("hops").cast("long").alias("hops"), (F.col("into") + 1).cast("long").alias("into"), r6("confidence").alias("confidence"), "verdict")


@query(f"WITH {pagerank_sql(3)} SELECT node_id FROM nodes JOIN pr USING (node_id) WHERE node_type = 11 AND (starts_with(lower(label), '1-') OR starts_with(lower(label), '2-')) ORDER BY round(pagerank, 9) DESC, node_id LIMIT 100")
def f17_entry_points(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    n = g.nodes.where("node_type IN (11, 12)").withColumn("node_type", F.when(F.col("node_type") == 11, 2).otherwise(0))
    return flow.entry_points(n.join(traversal.pagerank(g, max_iterations=3, fixed=True), "node_id"), 100, ("1-", "2-"))


_URGENT = "contains(lower(label), 'urgent') OR len(list_filter(tags, lambda t: contains(lower(t), 'urgent') OR contains(lower(t), 'brand#11'))) > 0 OR contains(lower(label), 'brand#11')"


@query(f"WITH s AS MATERIALIZED (SELECT node_id FROM nodes WHERE {_URGENT}), n AS (SELECT DISTINCT src AS node_id FROM edges WHERE dst IN (SELECT node_id FROM s) AND src NOT IN (SELECT node_id FROM s)) SELECT node_id, 'self' AS by FROM s UNION ALL SELECT node_id, 'neighbour' FROM n")
def f16_guards(spark, sf_dir):
    return flow.guards(full_graph(spark, sf_dir), ("urgent", "brand#11"))
