"""Readers on small inline texts."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import documents, text
from loomgraph.sources import formats


def docs(spark, *rows):
    return spark.createDataFrame([*rows], "path string, text string")


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_json_descriptor(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"nodes": [{"id": "a", "label": "A", "type": "Process"}, {"id": "b", "type": "odd"}], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "b", "relation": "contains", "weight": 0.5}]}))
    nodes, edges = formats.json_descriptor(spark, str(p))
    assert pairs(nodes, "external_id", "label", "node_type") == {("a", "A", 11), ("b", "b", 100)}
    assert pairs(edges, "relation", "weight", "causal_strength", "direction") == {("relates_to", 1.0, 0.4, 0), ("contains", 0.5, 0.8, 1)}


def test_bibtex(spark):
    d = docs(spark, ("x.bib", '@article{k1,\n title = {On {Graphs}},\n author = "Ada B and Cy D",\n doi = {10.1/AbC},\n journal = {Venue}\n}\n'))
    nodes, edges = formats.bibtex(d)
    assert ("bib::k1", "On Graphs") in pairs(nodes, "external_id", "label")
    assert pairs(edges, "dst", "relation") == {("author::ada b", "authored_by"), ("author::cy d", "authored_by"), ("venue::venue", "published_in")}


def test_rfc_xml(spark):
    x = '<rfc number="9" obsoletes="1, 2"><front><title>T  one</title><author fullname="A B"/></front><back><reference anchor="RFC3"/></back></rfc>'
    nodes, edges = formats.xml_records(docs(spark, ("r.xml", x)), "rfc")
    assert pairs(nodes, "external_id", "label") == {("rfc::9", "T one")}
    assert pairs(edges, "dst", "relation") == {("A B", "authored_by"), ("RFC3", "references"), ("1", "obsoletes"), ("2", "obsoletes")}


def test_commit_log(spark):
    lines = ["abcdef1|100|ann", "a.py", "b.py", "", "abcdef2|200|bob", "a.py"]
    df = spark.createDataFrame([("log", i, v) for i, v in enumerate(lines)], "source string, line_no int, value string")
    assert pairs(formats.commit_log(df), "commit", "ts", "author", "file") == {("abcdef1", 100.0, "ann", "a.py"), ("abcdef1", 100.0, "ann", "b.py"), ("abcdef2", 200.0, "bob", "a.py")}


def test_code_extraction(spark):
    d = docs(spark, ("m/a.py", "import os\nfrom x.y import z\nclass A(Base):\n    def run(self):\n        pass\n"), ("b.rs", "use c::d;\npub fn go() {}\nstruct S;\n"))
    nodes, edges = formats.extract_code(d)
    assert {"file::m/a.py::fn::A::run", "file::m/a.py::class::A", "file::b.rs::fn::go", "file::b.rs::struct::S"} <= {r[0] for r in nodes.select("external_id").collect()}
    assert {("file::m/a.py", "ref::os"), ("file::m/a.py", "ref::x.y"), ("file::b.rs", "ref::c::d"), ("file::m/a.py::class::A", "ref::Base")} <= pairs(edges, "src", "dst")


def test_notes_light_and_formats(spark):
    d = docs(spark, ("n.md", "# Plan\n- TODO ship it\n- decided on blue\n[entity: Core] [binds: file.py]\n"))
    _, edges = formats.notes(d)
    assert {r[0] for r in edges.select("relation").collect()} == {"tracks", "decided"}
    assert pairs(formats.light(d), "dst", "relation") == {("Core", "declares_entity"), ("file.py", "binds_to")}
    kinds = docs(spark, ("a.bib", ""), ("b.xml", "<rfc>"), ("c.html", ""), ("d.py", "")).select(formats.detect_format(F.col("path"), F.col("text")))
    assert [r[0] for r in kinds.collect()] == ["bibtex", "rfc", "html", "code"]


def test_snapshot_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node_id long, external_id string")
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (1, 9, 0)], "src long, dst long, direction int")
    formats.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = formats.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and pairs(e, "src", "dst") == {(1, 2)}


def test_canonical_documents(spark):
    d = docs(spark, ("p", "# Top\nThe system must not lose data at all.\n```\ncode | x | y\n```\n| a | b |\n> q\nSee [x](http://y) and `f()` 10.1234/ab\n"))
    assert [r[0] for r in documents.blocks(d, "path", "text").orderBy("line_no").select("kind").collect()] == ["heading", "paragraph", "code", "code", "code", "table", "quote", "paragraph"]
    assert pairs(documents.claims(d, "path", "text"), "modality", "negated", "subject", "object") == {("must", True, "The system", "not lose data at all.")}
    assert {("link", "http://y"), ("code", "f()"), ("doi", "10.1234/ab")} <= pairs(documents.links(d, "path", "text"), "kind", "target")


def test_query_tokens_split_before_folding():
    assert text.query_tokens("fix the getUserName in db_store") == ["fix", "getusername", "get", "user", "name", "db_store", "store"]
    import re

    assert re.match(text.glob_regex("src/**/*.py"), "src/a/b/c.py") and not re.match(text.glob_regex("src/*.py"), "src/a/c.py")


def test_further_languages_calls_and_routes(spark):
    d = docs(spark, ("a.py", "@app.get('/x')\ndef go(n):\n    if (n):\n        return work(n) + obj.other(1)\n"), ("b.rb", "def make!\nend\n"), ("c.sh", "run-it() {\n  echo\n}\n"))
    nodes, edges = formats.extract_code(d)
    assert {"file::a.py::fn::go", "file::b.rb::fn::make!", "file::c.sh::fn::run-it"} <= {r[0] for r in nodes.select("external_id").collect()}
    got = pairs(edges, "src", "dst", "relation")
    assert ("file::a.py::fn::go", "ref::work", "calls") in got and ("route::/x", "file::a.py", "routes_to") in got
    assert ("file::a.py::fn::go", "ref::other", "calls") in got
    assert not {g for g in got if g[1] in ("ref::if", "ref::return", "ref::obj", "ref::go")}


def test_text_functions(spark):
    from loomgraph.functions import texts as tf

    rows = [("Traceback (most recent call last)", "a\\b", "x"), ("at a.rs:3", "C:\\w\\\\x.rs", None), ("?", "././/q//r", None)]
    df = spark.createDataFrame(rows, "e string, p string, h string")
    got = df.select(tf.error_language(F.col("e"), F.col("h")), tf.normalised_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("python", "a/b"), ("rust", "w/x.rs"), ("unknown", "q/r")]
    assert spark.range(1).select(tf.segments(F.lit("my_Long-name my.to")).alias("s")).first()["s"] == ["long", "name"]


def test_state_of_the_newest_complete_version(spark, tmp_path):
    import pytest

    from loomgraph.operators.graph import PropertyGraph
    from loomgraph.sources import state

    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node_id long, external_id string")
    edges = spark.createDataFrame([(1, 2, "x"), (1, 9, "loose")], "src long, dst long, relation string")
    side = spark.createDataFrame([("a", 0.5)], "key string, trust double")
    assert state.persist(PropertyGraph(nodes, edges), str(tmp_path), 1, trust=side) == ["graph", "trust", "mark"]
    formats.save_graph(nodes.limit(0), edges.limit(0), f"{tmp_path}/v=2")  # no marker
    g, sides = state.restore(spark, str(tmp_path))
    assert g.nodes.count() == 2 and pairs(g.edges, "relation") == {("x",)} and set(sides) == {"trust"}
    with pytest.raises(ValueError):
        state.persist(g, str(tmp_path), 3, odd=side)


def test_span_batches_have_defaults(spark):
    d = docs(spark, ("b", '[{"name": "f", "duration_us": 5}, {"name": "g", "count": 3, "is_error": true}, {"count": 1}]'), ("c", "broken"))
    assert pairs(formats.span_batch(d), "name", "duration_us", "count", "is_error") == {("f", 5, 1, False), ("g", 0, 3, True)}


def test_attributes_of_unknown_shape(spark):
    d = docs(spark, ("a", '{"http": {"status": 500}, "tags": ["x", "y"], "ok": true}'), ("b", '{"http": "none", "n": 1.5}'), ("c", "broken"), ("d", "[1]"), ("e", None))
    got = formats.with_attributes(d, "text", {"status": ("$.http.status", "int"), "first": ("$.tags[0]", "string")})
    assert pairs(got, "path", "status", "first") == {("a", 500, "x"), ("b", None, None), ("c", None, None), ("d", None, None), ("e", None, None)}
    rows = formats.attribute_rows(d, "path", "text")
    assert pairs(rows, "key", "attribute", "value") == {("a", "http", '{"status":500}'), ("a", "tags", '["x","y"]'), ("a", "ok", "true"), ("b", "http", '"none"'), ("b", "n", "1.5")}
    assert pairs(rows, "attribute", "kind") >= {("http", "OBJECT<status: BIGINT>"), ("http", "STRING"), ("ok", "BOOLEAN")}
