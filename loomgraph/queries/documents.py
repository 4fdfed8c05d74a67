"""Canonical documents, sessions, audits and streaming ledgers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import documents, sessions, topology
from loomgraph.operators.graph import PropertyGraph, r6
from loomgraph.plans.durable import scratch
from loomgraph.queries.registry import query, table
from loomgraph.sources.tables_graph import full_graph, id_of, spine_graph
from loomgraph.streaming import ledgers as streams
from loomgraph.streaming import stateful

_LINES = "al AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), ln AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM al), li AS (SELECT doc_id, i AS line_no, a[i] AS line FROM ln)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"WITH {_LINES}, k AS (SELECT CASE WHEN regexp_matches(line, '^\\s*([-*+]|[0-9]+[.])\\s') THEN 'list' WHEN regexp_matches(line, '^\\s*>') THEN 'quote' WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' ELSE 'paragraph' END AS kind FROM li WHERE trim(line) <> '') SELECT kind, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kind", graph=False)
def s16_blocks(spark, sf_dir):
    return documents.blocks(_docs(spark, sf_dir), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES}, c AS (SELECT doc_id, line_no, ' ' || lower(line) || ' ' AS low FROM li WHERE ends_with(rtrim(line), '.') AND length(line) > 20) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN contains(low, ' must ') THEN 'must' WHEN contains(low, ' should ') THEN 'should' WHEN contains(low, ' may ') THEN 'may' WHEN contains(low, ' is ') THEN 'is' ELSE 'none' END AS modality, (contains(low, ' not ') OR contains(low, ' no ')) AS negated FROM c", graph=False)
def s16_claims(spark, sf_dir):
    return documents.claims(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "modality", "negated")


@query("SELECT item_id, count(DISTINCT e)::BIGINT AS n_entities FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS e FROM benchmark) WHERE regexp_full_match(e, '[A-Z][A-Za-z]{3,}') GROUP BY item_id", graph=False)
def s16_entities(spark, sf_dir):
    return documents.links(table(spark, sf_dir, "benchmark"), "item_id", "text").where("kind = 'entity'").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_entities"))


@query("SELECT CASE WHEN d.doc_id % 10 = 0 THEN 'missing_target' WHEN d.n_chars % 7 = 0 THEN 'changed' ELSE 'ok' END AS finding, CAST(count(*) AS BIGINT) AS n FROM documents d GROUP BY 1", graph=False)
def a21_document_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bound = d.select(F.col("doc_id").alias("source"), F.col("doc_id").alias("target"), F.col("n_chars").alias("hash"))
    now = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("target"), F.when(F.col("n_chars") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("hash"))
    return documents.drift(bound, now)


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN 'missing_from_disk' WHEN p_partkey % 5 = 1 THEN 'missing_from_graph' WHEN p_partkey % 5 = 2 THEN 'loc_mismatch' ELSE 'hash_mismatch' END AS finding, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 5 < 4 GROUP BY 1", graph=False)
def g67_cross_verify(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("loc"), F.col("p_name").alias("hash"))
    disk = p.where("path % 5 <> 0").withColumn("loc", F.when(F.col("path") % 5 == 2, F.col("loc") + 1).otherwise(F.col("loc"))).withColumn("hash", F.when(F.col("path") % 5 >= 2, F.when(F.col("path") % 5 < 4, F.concat("hash", F.lit("!"))).otherwise(F.col("hash"))).otherwise(F.col("hash")))
    return documents.cross_verify(p.where("path % 5 <> 1"), disk).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT n_regionkey AS k, count(DISTINCT s_suppkey)::DOUBLE / (count(DISTINCT s_suppkey) + count(DISTINCT c_custkey)) AS share FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey) SELECT k::BIGINT AS k, CASE WHEN share <= 0.05 THEN 'A' WHEN share <= 0.15 THEN 'B' WHEN share <= 0.3 THEN 'C' WHEN share <= 0.5 THEN 'D' ELSE 'F' END AS grade FROM r", graph=False)
def g66_audit_grades(spark, sf_dir):
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    a = n.join(s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s")), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c")), F.col("n_nationkey") == F.col("c_nationkey"), "left").na.fill(0, ["s", "c"])
    r = a.groupBy(F.col("n_regionkey").cast("long").alias("k")).agg((F.sum("s") / (F.sum("s") + F.sum("c"))).alias("share"))
    return r.select("k", documents.grade(F.col("share")).alias("grade"))


@query("SELECT DISTINCT page_id, regexp_extract(html, 'href=\"(/[^\"]*)\"', 1) AS first_link FROM pages WHERE regexp_matches(html, 'href=\"/')", graph=False)
def s1_page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where(F.col("html").rlike('href="/')).select("page_id", F.regexp_extract("html", 'href="(/[^"]*)"', 1).alias("first_link"))


@query(f"SELECT external_id, 'out' AS direction, round(max(0.6::DOUBLE * weight + 0.4::DOUBLE * CASE WHEN external_id = 'part::1' THEN 0 ELSE 1 END), 6) AS score FROM edges JOIN nodes ON node_id = dst WHERE src = {id_of('supplier::6')} GROUP BY external_id UNION ALL SELECT external_id, 'in', round(max(0.5::DOUBLE * weight + 0.3::DOUBLE), 6) FROM edges JOIN nodes ON node_id = src WHERE dst = {id_of('supplier::6')} GROUP BY external_id")
def g59_perspective_routes(spark, sf_dir):
    return sessions.routes(full_graph(spark, sf_dir), "supplier::6", ["part::1"]).select("external_id", "direction", r6("score").alias("score"))


@query(f"SELECT external_id, round(0.6::DOUBLE * weight + 0.4::DOUBLE, 6) AS score, round(least(0.6::DOUBLE * weight + 0.4::DOUBLE, 0.85::DOUBLE), 6) AS confidence FROM edges JOIN nodes ON node_id = dst WHERE src = {id_of('customer::8')} ORDER BY score DESC, external_id LIMIT 1")
def g60_perspective_suggest(spark, sf_dir):
    return sessions.suggest(full_graph(spark, sf_dir), "customer::8", []).select("external_id", r6("score").alias("score"), r6("confidence").alias("confidence"))


@query(f"WITH b AS (SELECT dst FROM edges WHERE src = {id_of('nation::5')}) SELECT 'edge_removed' AS kind, CAST(count(*) FILTER (dst % 3 = 0) AS BIGINT) AS n FROM b UNION ALL SELECT 'edge_reweighted', CAST(count(*) FILTER (dst % 3 = 1) AS BIGINT) FROM b UNION ALL SELECT 'node_removed', CAST(count(*) FILTER (dst % 3 = 0) AS BIGINT) FROM b")
def u5_lock_diff(spark, sf_dir):
    g = full_graph(spark, sf_dir).finalised()
    e = g.edges.where(f"NOT (src = {id_of('nation::5')} AND dst % 3 = 0)").withColumn("weight", F.expr(f"CASE WHEN src = {id_of('nation::5')} AND dst % 3 = 1 THEN weight / 2 ELSE weight END"))
    return sessions.lock_diff(sessions.lock(g, ["nation::5"], 1), sessions.lock(PropertyGraph(g.nodes, e), ["nation::5"], 1))


@query("WITH v AS (SELECT conv_id % 20 AS trail, turn AS node_id, max(length(text)) / 1000.0::DOUBLE AS relevance FROM conversations GROUP BY ALL) SELECT node_id, round(max(relevance), 6) AS relevance, count(DISTINCT trail)::BIGINT AS n_trails FROM v GROUP BY node_id", graph=False)
def u6_trail_merge(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 20).alias("trail"), F.col("turn").alias("node_id")).agg((F.max(F.length("text")) / 1000.0).alias("relevance"))
    return sessions.merge_trails(v).withColumn("relevance", r6("relevance"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT known) AS BIGINT) AS missing, true AS stale, count(*) FILTER (NOT known) <= 0.5 * count(*) AS resumable FROM (SELECT o_orderkey % 2 = 0 AS known FROM orders)", graph=False)
def g64_trail_resume(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    t = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("order::"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("gone::"), F.col("o_orderkey").cast("string"))).alias("external_id"))
    return sessions.resume(t, g, 1, 2)


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS defects FROM events GROUP BY user_id", graph=False)
def r6_trust_stream(spark, sf_dir):
    """The trust ledger as a stream that is drained into a table."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "defect").otherwise("partial").alias("kind"), F.col("ts"))
    return _drained(spark, streams.trust_counters(rows).select("key", "total", "defects"), "update", ["key"])


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 hour, ts)) // 1000000 AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL", graph=False)
def r_windowed_events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed_events(e).select("event_type", F.unix_timestamp("window.start").alias("hour"), "n")
    return _drained(spark, out, "update", ["event_type", "hour"])


def _drained(spark, df, mode, keys=None):
    """All that a stream gives, through tables in the shared folder: all rows, or of each key (``keys``) the last."""
    at, schema = scratch(spark, "drained"), df.schema
    with stateful.rocksdb(spark):
        stateful.into_table(df, f"{at}/rows", f"{at}/checkpoint", mode).trigger(availableNow=True).start().awaitTermination()
    return stateful.latest(spark, f"{at}/rows", schema, keys)


@query("WITH t AS (SELECT o_orderkey AS path, o_totalprice AS s FROM orders), n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS s FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P') SELECT change, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN t.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN t.s <> n.s THEN 'modified' END AS change FROM t FULL JOIN n ON t.path = n.path) WHERE change IS NOT NULL GROUP BY change", graph=False)
def r2_daemon_tick(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cols = lambda df: df.select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.lit(1.0).alias("mtime"), F.lit("").alias("hash"))
    tracked = cols(o)
    live = cols(o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END")))
    live = live.unionByName(cols(o.where("o_orderstatus = 'P'").withColumns({"o_orderkey": -F.col("o_orderkey"), "o_totalprice": F.lit(1.0)})))
    return streams.tick(tracked, live, None).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT event_id AS alert_id, ts FROM events WHERE event_type = 'error') SELECT alert_id FROM f WHERE alert_id % 3 <> 0 ORDER BY ts DESC, alert_id LIMIT 500", graph=False)
def r4_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "ts")
    return streams.alerts(e, e.where("alert_id % 3 = 0").select("alert_id")).select("alert_id")


_K6 = f"SELECT '  ' || src || ' -->|' || relation || '| ' || dst AS l FROM edges WHERE src = {id_of('region::1')}"


@query(f"SELECT 'graph LR' || chr(10) || string_agg(l, chr(10) ORDER BY l) AS diagram FROM ({_K6})")
def k6_diagram(spark, sf_dir):
    from loomgraph.sources.formats import diagram

    g = full_graph(spark, sf_dir)
    e = g.edges.where(f"src = {id_of('region::1')}").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "relation")
    return diagram(e)


_RELATIONS = ("contains", "calls", "references", "imports")


def _signature_sql(nodes: str, edges: str) -> str:
    """Degrees, mean weights and relation counts of nodes, as rounded logarithms."""
    side = lambda end, p: f"{p}s AS (SELECT {end} AS node_id, count(*) AS {p}_n, avg(weight) AS {p}_w, " + ", ".join(f"count(*) FILTER (relation = '{r}') AS {p}_{r}" for r in _RELATIONS) + f" FROM {edges} GROUP BY {end})"
    cols = ["node_type", *(f"{p}_{c}" for p in ("go", "come") for c in ("n", "w", *_RELATIONS))]
    rounded = ", ".join(f"round(ln(1 + abs(coalesce({c}, 0)::DOUBLE)), 6)" for c in cols)
    return f"{side('src', 'go')}, {side('dst', 'come')}, sig AS (SELECT node_id, [{rounded}] AS signature FROM {nodes} LEFT JOIN gos USING (node_id) LEFT JOIN comes USING (node_id))"




@query(f"WITH {_signature_sql('nodes', 'edges')} SELECT CAST(count(*) AS BIGINT) AS size, min(node_id) AS first_node FROM sig JOIN nodes USING (node_id) WHERE node_type IN (13, 14, 15, 100) GROUP BY signature HAVING count(*) > 1 ORDER BY 1 DESC, 2 LIMIT 50")
def g41_twins(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return topology.twins(g, g.nodes.where("node_type IN (13, 14, 15, 100)"))


_COS = "list_dot_product(x.signature, y.signature) / (sqrt(list_dot_product(x.signature, x.signature)) * sqrt(list_dot_product(y.signature, y.signature)))"


@query(f"WITH {_signature_sql('spine_nodes', 'spine_edges')}, reps AS (SELECT signature, min(node_id) AS node_id FROM sig GROUP BY signature) SELECT x.node_id AS a, y.node_id AS b, round({_COS}, 6) AS similarity FROM reps x JOIN reps y ON x.node_id < y.node_id WHERE {_COS} >= 0.8::DOUBLE ORDER BY 3 DESC, 1, 2 LIMIT 50")
def g41_twin_pairs(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return topology.twin_pairs(g, g.nodes).withColumn("similarity", r6("similarity"))
