"""Search, seeds, similarity and scanning over labels, documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import text
from loomgraph.operators.graph import r6
from loomgraph.operators.traversal import pagerank
from loomgraph.plans.durable import checked_join, stored
from loomgraph.queries.registry import placed, query, table
from loomgraph.sources.tables_graph import full_graph


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_LINES = "al AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), ln AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM al), li AS (SELECT doc_id, i AS line_no, a[i] AS line, a FROM ln)"


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM li WHERE contains(lower(line), 'idiot')", graph=False)
def f5_search_literal(spark, sf_dir):
    return text.search(_docs(spark, sf_dir), "doc_id", "text", "Idiot").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM li WHERE regexp_matches(line, '[0-9]{{3}}[.][0-9]{{1,3}}[.][0-9]')", graph=False)
def f5_search_regex(spark, sf_dir):
    return text.search(_docs(spark, sf_dir), "doc_id", "text", r"[0-9]{3}[.][0-9]{1,3}[.][0-9]", "regex", True).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {_LINES} SELECT CAST(count(*) AS BIGINT) AS matches FROM li WHERE NOT contains(lower(line), 'the')", graph=False)
def f5_search_invert_count(spark, sf_dir):
    return text.search(_docs(spark, sf_dir), "doc_id", "text", "the", invert=True, count_only=True)


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, array_to_string(a[greatest(line_no - 2, 1):line_no - 1], '~') AS before, array_to_string(a[line_no + 1:line_no + 2], '~') AS after FROM li WHERE contains(line, 'moron')", graph=False)
def w10_context_lines(spark, sf_dir):
    found = text.search(_docs(spark, sf_dir), "doc_id", "text", "moron", case_sensitive=True, context=2)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("before", "~").alias("before"), F.array_join("after", "~").alias("after"))


@query("SELECT doc_id, CAST(n AS BIGINT) AS n_matches FROM (SELECT doc_id, len(regexp_extract_all(text, '(?s)the[.]\\n[A-Z]')) AS n FROM documents) WHERE n > 0", graph=False)
def f5_search_multiline(spark, sf_dir):
    return text.search_multiline(_docs(spark, sf_dir), "doc_id", "text", r"the[.]\n[A-Z]").withColumn("n_matches", F.col("n_matches").cast("long"))


@query(f"WITH {_LINES}, f AS (SELECT DISTINCT 'doc/' || doc_id AS path, line_no, line FROM li WHERE contains(lower(line), 'clown')) SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(200 + CASE WHEN regexp_matches(lower(line), '(^|[^a-z0-9_])clown($|[^a-z0-9_])') THEN 180 ELSE 120 END + CASE WHEN line_no > 1 THEN 25 ELSE 0 END AS BIGINT) AS rank FROM f", graph=False)
def f6_search_ranking(spark, sf_dir):
    found = text.search(_docs(spark, sf_dir), "doc_id", "text", "clown").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "line_no", "line").withColumn("label", F.lit(""))
    return text.rank_results(found, "clown").select("path", F.col("line_no").cast("long").alias("line_no"), F.col("rank").cast("long").alias("rank"))


@query("SELECT page_id FROM pages WHERE regexp_matches(split_part(split_part(url, '?', 1), '#', 1), '^https?://[^/]*example[.]org/en/[^/]*$')", graph=False)
def f8_glob(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u")).withColumn("u", F.regexp_replace("u", "^https?://", ""))
    return text.glob(p, "u", "*example.org/en/*").select("page_id")


_NEG = "NOT (contains(lower(label), 'green') OR contains(lower(label), 'safe'))"


@query(f"SELECT external_id FROM nodes WHERE (contains(lower(label), 'steel') OR contains(lower(label), 'brass') OR contains(lower(label), 'urgent')) AND {_NEG}")
def f9_scan(spark, sf_dir):
    return text.scan(full_graph(spark, sf_dir).nodes, "label", ["steel", "brass", "urgent"], ["green", "safe"]).select("external_id")


CATALOGUE = {"metal": (["steel", "brass", "tin"], ["green"], 0.5), "rush": (["urgent", "high"], [], 0.8), "people": (["customer"], ["7"], 0.3)}


def _catalogue_sql() -> str:
    one = lambda ws: " OR ".join(f"contains(lower(label), '{w}')" for w in ws) or "false"
    return " UNION ALL ".join(f"SELECT '{n}' AS pattern, {s}::DOUBLE AS severity, node_id, external_id FROM nodes WHERE ({one(k)}) AND NOT ({one(no)})" for n, (k, no, s) in CATALOGUE.items())


@query(f"WITH f AS ({_catalogue_sql()}) SELECT pattern, severity, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL")
def f11_scan_all(spark, sf_dir):
    return text.scan_all(full_graph(spark, sf_dir).nodes, "label", CATALOGUE).groupBy("pattern", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH f AS (SELECT * FROM ({_catalogue_sql()}) WHERE pattern = 'people'), nb AS (SELECT src AS node_id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges), m AS (SELECT nb.node_id, bool_or(contains(lower(label), 'low') OR contains(lower(label), 'china')) AS neg FROM nb JOIN nodes n ON n.node_id = other WHERE nb.node_id IN (SELECT node_id FROM f) GROUP BY nb.node_id) SELECT external_id, CASE WHEN neg THEN 'mitigated' ELSE 'confirmed' END AS status, round(severity * CASE WHEN neg THEN 0.4::DOUBLE ELSE 1 END, 6) AS severity FROM f LEFT JOIN m USING (node_id)")
def f10_scan_validation(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    found = text.scan_all(g.nodes, "label", {"people": CATALOGUE["people"]})
    out = text.validate_findings(found, g.edges, g.nodes, ["low", "china"])
    return out.select("external_id", "status", r6("severity").alias("severity"))


@query("SELECT external_id, CASE WHEN contains(lower(label), 'urgent') THEN 'urgent' WHEN contains(lower(label), 'high') THEN 'high' WHEN contains(lower(label), 'region') THEN 'region' END AS boundary FROM nodes WHERE node_type = 11 AND (contains(lower(label), 'urgent') OR contains(lower(label), 'high'))")
def f15_taint_boundary(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes.where("node_type = 11")
    return n.select("external_id", text.first_pattern(F.col("label"), ["urgent", "high", "region"]).alias("boundary")).where("boundary IS NOT NULL")


_TRI = "list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))"


@query(f"WITH g AS (SELECT item_id, {_TRI.format('lower(text)')} AS a, {_TRI.format(chr(39) + 'the anher erething' + chr(39))} AS q FROM benchmark) SELECT item_id, round(len(list_filter(q, lambda x: list_contains(a, x))) / sqrt(len(q) * len(a)::DOUBLE), 6) AS similarity FROM g", graph=False)
def x9_trigram_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", r6(text.trigram_similarity(F.lit("the anher erething"), F.lower("text"))).alias("similarity"))


@query(f"WITH p AS (SELECT item_id, gram, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest({_TRI.format('lower(text)')}) AS gram FROM benchmark) GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM benchmark), d AS (SELECT gram, ln(any_value(n) / count(*)) + 1 AS idf FROM p, n GROUP BY gram), w AS (SELECT item_id, gram, tf * idf AS w FROM p JOIN d USING (gram)), nm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY item_id), q AS (SELECT gram, count(*)::DOUBLE AS c FROM (SELECT unnest({_TRI.format(chr(39) + 'erthe and that onthe' + chr(39))}) AS gram) GROUP BY gram), qw AS (SELECT gram, c * idf AS qw FROM q JOIN d USING (gram)), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM qw) SELECT item_id, round(sum(w * qw) / (any_value(norm) * any_value(qn)), 6) AS cosine FROM w JOIN qw USING (gram) JOIN nm USING (item_id), qn GROUP BY item_id HAVING sum(w * qw) / (any_value(norm) * any_value(qn)) > 0.01", graph=False)
def x5_trigram_tfidf(spark, sf_dir):
    return text.tfidf_query(table(spark, sf_dir, "benchmark"), "item_id", "text", "erthe and that onthe").withColumn("cosine", r6("cosine"))


def _token_sql(t: str) -> str:
    grams = "[" + ", ".join(f"'{t[i:i + 3]}'" for i in range(len(t) - 2)) + "]"
    lab = _TRI.format("lower(label)")
    similar = f"(CASE WHEN length(label) >= 3 THEN len(list_filter({grams}, lambda x: list_contains({lab}, x))) / sqrt({len(t) - 2} * len({lab})::DOUBLE) ELSE 0 END)"
    return (
        f"CASE WHEN lower(label) = '{t}' THEN 1.0::DOUBLE WHEN list_contains(regexp_split_to_array(lower(label), '[-_./: #]+'), '{t}') THEN 0.92::DOUBLE WHEN starts_with(lower(label), '{t}') OR starts_with('{t}', lower(label)) THEN 0.9::DOUBLE "
        f"WHEN list_contains(list_transform(tags, lambda x: lower(x)), '{t}') THEN 0.85::DOUBLE WHEN contains(lower(label), '{t}') OR len(list_filter(tags, lambda x: contains(lower(x), '{t}'))) > 0 THEN 0.8::DOUBLE WHEN {similar} > 0.3 THEN 0.7::DOUBLE * {similar} ELSE 0.0::DOUBLE END"
    )


_QUERY = "large steel customer"


@query(f"WITH s AS (SELECT external_id, node_id, {_token_sql('large')} AS a, {_token_sql('steel')} AS b, {_token_sql('customer')} AS c FROM nodes WHERE node_type IN (12, 13, 100)), r AS (SELECT external_id, node_id, CASE WHEN a = 1 AND b = 1 AND c = 1 THEN 1.0::DOUBLE WHEN a + b + c > 0 THEN least(greatest(0.5::DOUBLE * (a + b + c) / 3 + 0.35::DOUBLE * (CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT)) / 3 + 0.15::DOUBLE * greatest(a, b, c), 0), 1) ELSE 0.0::DOUBLE END AS score FROM s) SELECT external_id, round(score, 6) AS score FROM r WHERE score >= 0.1 ORDER BY r.score DESC, node_id LIMIT 200")
def x2_find_seeds(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes.where("node_type IN (12, 13, 100)")
    return text.find_seeds(n, _QUERY).join(n.select("node_id", "external_id"), "node_id").select("external_id", r6("score").alias("score"))


@query("SELECT external_id, CASE WHEN contains(lower(label), 'vendor') OR contains(lower(label), 'provider') OR contains(lower(label), 'account') OR contains(lower(label), 'user') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM nodes WHERE node_type IN (13, 100)")
def x7_synonyms(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes.where("node_type IN (13, 100)")
    return n.select("external_id", text.synonym_boost(F.col("label"), "customer of supplier").alias("boost"))


def _tfidf_sql(nodes: str, query: str) -> str:
    """sem: cosine of label trigrams with a query, over 0.01."""
    q = _TRI.format(f"'{query}'")
    return (
        f"tp AS (SELECT node_id, gram, count(*)::DOUBLE AS tf FROM (SELECT node_id, unnest({_TRI.format('lower(label)')}) AS gram FROM {nodes}) GROUP BY ALL), tn AS (SELECT count(*)::DOUBLE AS n FROM {nodes}), td AS (SELECT gram, ln(any_value(n) / count(*)) + 1 AS idf FROM tp, tn GROUP BY gram), "
        f"tw AS (SELECT node_id, gram, tf * idf AS w FROM tp JOIN td USING (gram)), tnm AS (SELECT node_id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY node_id), tq AS (SELECT gram, count(*) * any_value(idf) AS qw FROM (SELECT unnest({q}) AS gram) JOIN td USING (gram) GROUP BY gram), tqn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM tq), "
        "sem AS (SELECT node_id, sum(w * qw) / (any_value(norm) * any_value(qn)) AS semantic FROM tw JOIN tq USING (gram) JOIN tnm USING (node_id), tqn GROUP BY node_id HAVING sum(w * qw) / (any_value(norm) * any_value(qn)) > 0.01::DOUBLE)"
    )


def pagerank_sql(iterations: int, nodes: str = "nodes", edges: str = "edges") -> str:
    """pr: every node's PageRank after some iterations, the largest 1."""
    parts = [f"pn AS (SELECT count(*)::DOUBLE AS n FROM {nodes})", f"pd AS (SELECT src, count(*)::DOUBLE AS deg FROM {edges} GROUP BY src)", f"p0 AS MATERIALIZED (SELECT node_id, 1 / n AS pr FROM {nodes}, pn)"]
    for k in range(1, iterations + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT s.node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(m, 0) AS pr FROM {nodes} s CROSS JOIN pn LEFT JOIN (SELECT dst, sum(pr / deg) AS m FROM p{k - 1} JOIN {edges} e ON e.src = node_id JOIN pd ON pd.src = node_id GROUP BY dst) t ON t.dst = s.node_id)")
    return ", ".join(parts) + f", pr AS (SELECT node_id, pr / (SELECT max(pr) FROM p{iterations}) AS pagerank FROM p{iterations})"


_STEEL = "steel supplier"


@query(
    f"WITH {pagerank_sql(3)}, own AS (SELECT * FROM nodes WHERE node_type IN (12, 13)), {_tfidf_sql('own', _STEEL)}, tk AS (SELECT node_id, {_token_sql('steel')} AS a, {_token_sql('supplier')} AS b, {_TRI.format('lower(label)')} AS lab FROM own), "
    "kw AS (SELECT node_id, CASE WHEN a = 1 AND b = 1 THEN 1.0::DOUBLE WHEN a + b > 0 THEN least(greatest(0.5::DOUBLE * (a + b) / 2 + 0.35::DOUBLE * (CAST(a > 0 AS INT) + CAST(b > 0 AS INT)) / 2 + 0.15::DOUBLE * greatest(a, b), 0), 1) ELSE 0.0::DOUBLE END AS keyword, "
    f"len(list_filter({_TRI.format(chr(39) + _STEEL + chr(39))}, lambda x: list_contains(lab, x))) / sqrt({len(_STEEL) - 2} * len(lab)::DOUBLE) AS tri FROM tk), "
    "z AS (SELECT external_id, pagerank, 0.4::DOUBLE * keyword + 0.3::DOUBLE * coalesce(semantic, 0) + 0.2::DOUBLE * pagerank + 0.1::DOUBLE * tri + CASE WHEN contains(lower(label), 'vendor') OR contains(lower(label), 'provider') THEN 0.2::DOUBLE ELSE 0 END AS score FROM own JOIN kw USING (node_id) LEFT JOIN sem USING (node_id) JOIN pr USING (node_id)) "
    "SELECT external_id, round(score, 6) AS score FROM z WHERE score >= 0.1::DOUBLE ORDER BY round(z.score, 9) DESC, round(pagerank, 9) DESC, external_id LIMIT 20"
)
def x4_seek(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    n = g.nodes.where("node_type IN (12, 13)")
    return text.seek(n, _STEEL, pagerank(g, max_iterations=3, fixed=True)).select("external_id", r6("score").alias("score"))


@query(f"WITH {pagerank_sql(3)}, own AS (SELECT * FROM nodes WHERE node_type IN (12, 13)), {_tfidf_sql('own', _STEEL)} SELECT external_id, round(semantic, 6) AS score FROM sem JOIN own USING (node_id) ORDER BY round(semantic, 9) DESC, node_id LIMIT 30")
def f7_search_semantic(spark, sf_dir):
    """Search by meaning: the trigram cosine alone, best first."""
    n = full_graph(spark, sf_dir).nodes.where("node_type IN (12, 13)")
    return text.search_semantic(n, _STEEL, 30).select("external_id", r6("score").alias("score"))


@query("WITH s AS (SELECT l_orderkey AS k, avg(l_discount) * 5 AS x, CASE WHEN max(l_quantity) > 25 THEN max(l_quantity) / 50.0::DOUBLE END AS y, CASE WHEN l_orderkey % 3 = 0 THEN 0.9::DOUBLE END AS z FROM lineitem GROUP BY l_orderkey), f AS (SELECT k, list_filter([x, y, z], lambda v: v IS NOT NULL AND v > 0) AS a FROM s), m AS (SELECT k, len(a) AS n, exp(list_sum(list_transform(a, lambda v: ln(v))) / len(a)) AS g FROM f WHERE len(a) > 0), c AS (SELECT k, CASE WHEN n = 1 THEN least(g, 0.4::DOUBLE) ELSE least(g, 0.85::DOUBLE) END AS c FROM m) SELECT k, round(c, 6) AS confidence FROM c WHERE c >= 0.15::DOUBLE", graph=False)
def a20_affinity(spark, sf_dir):
    """A mean whose rounding could decide, of the least confidence or a last digit, is added again in the order of the file."""

    def confidence(x):
        return r6(text.affinity_confidence([x, F.when(F.col("q") > 25, F.col("q") / 50.0), F.when(F.col("k") % 3 == 0, F.lit(0.9))], None))

    lines = placed(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"), "place")
    s = lines.groupBy("k").agg((F.avg("d") * 5).alias("x"), F.max("q").alias("q"), F.count("d").alias("n"))
    slack = F.when(F.col("n") > 2, F.col("n") * 2.0**-51).otherwise(0.0)  # a sum of two is the same in any order
    s = stored(s.select("k", "x", "q", "n", (~confidence(F.col("x") * (1 - slack)).eqNullSafe(confidence(F.col("x") * (1 + slack)))).alias("near")), "affinities")
    near, in_turn = s.where("near").drop("x"), Window.partitionBy("k").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = checked_join(lines.select("k", "d", "place"), near, "k").select("k", (F.sum("d").over(in_turn) / F.col("n") * 5).alias("x"), "q").dropDuplicates(["k"])
    both = s.where("NOT near").select("k", "x", "q").unionByName(again)
    return both.select("k", confidence(F.col("x")).alias("confidence")).where("confidence IS NOT NULL")


@query("WITH o AS (SELECT l_partkey AS k, product(0.5::DOUBLE + l_discount * 10) AS odds FROM lineitem GROUP BY l_partkey), c AS (SELECT k, least(greatest(odds / (1 + odds), 0.01), 0.99) AS c FROM o) SELECT k, round(c, 6) AS confidence, CASE WHEN c > 0.8 THEN 'supported' WHEN c < 0.2 THEN 'refuted' ELSE 'open' END AS verdict FROM c", graph=False)
def a19_hypothesis_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.lit(0.5) + F.col("l_discount") * 10).alias("v"))
    return text.hypothesis_confidence(e, "k", "v").withColumn("confidence", r6("confidence"))
