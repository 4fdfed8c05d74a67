"""Data sources over small folders, against the readers of texts that are columns."""

import json
import os
import time

import pytest

from loomgraph.sources import datasources, formats

BIB = '@article{k1,\n title = {On {Graphs}},\n author = "Ada B and Cy D",\n doi = {10.1/AbC},\n journal = {Venue}\n}\n@book{k2,\n title = "x",\n booktitle = {B}\n}\n'
XML = {
    "rfc": '<rfc number="9" obsoletes="1, 2"><front><title>T  one</title><author fullname="A B"/></front><back><reference anchor="RFC3"/></back></rfc>',
    "patent": "<us-patent-grant><doc-number>7</doc-number><invention-title>I <b>x</b></invention-title><orgname>O</orgname><doc-number>8</doc-number><main-classification>C</main-classification></us-patent-grant>",
    "jats": '<article><article-id pub-id-type="doi">10.2/X</article-id><article-title>T</article-title><surname>S</surname><journal-title>J</journal-title><pub-id pub-id-type="doi">10.2/Y</pub-id></article>',
}
WORK = {"message": {"DOI": "10.1/X", "title": ["T"], "author": [{"given": "Ann", "family": "B"}, {"family": "C"}], "container-title": ["J"], "reference": [{"DOI": "10.1/Y"}, {"unstructured": "z"}]}}
GRAPH = {"nodes": [{"id": "a", "label": "A", "type": "Process"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "b", "relation": "contains", "weight": 0.5}]}


@pytest.fixture(scope="module")
def read(spark):
    datasources.register(spark)
    return lambda kind, path, **options: spark.read.format(kind).options(**options).load(str(path))


def edges(df):
    return {tuple(r) for r in df.select("src", "dst", "relation").collect()}


def nodes(df):
    return {tuple(r) for r in df.select("external_id", "label", "node_type").collect()}


def test_sources_give_what_the_column_readers_give(spark, read, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bib").write_text(BIB)
    (tmp_path / "w.json").write_text(json.dumps(WORK))
    (tmp_path / "bad.json").write_text("{broken")
    docs = lambda *rows: spark.createDataFrame([*rows], "path string, text string")
    n, e = datasources.graph_of(read("bibtex", tmp_path))
    want_n, want_e = formats.bibtex(docs(("a", BIB)))
    assert (nodes(n), edges(e)) == (nodes(want_n), edges(want_e))
    n, e = datasources.graph_of(read("crossref", tmp_path))
    want_n, want_e = formats.crossref_rows(docs(("a", json.dumps(WORK))))
    assert (nodes(n), edges(e)) == (nodes(want_n), edges(want_e))
    for dialect, text in XML.items():
        at = tmp_path / dialect
        at.mkdir()
        (at / "x.xml").write_text(text + "\n" + text.replace("9", "10"))
        n, e = datasources.graph_of(read(dialect, at))
        want_n, want_e = formats.xml_records(docs(("x", text), ("y", text.replace("9", "10"))), dialect)
        assert (nodes(n), edges(e)) == (nodes(want_n.distinct()), edges(want_e))


def test_light_descriptor_and_code(spark, read, tmp_path):
    (tmp_path / "n.md").write_text("[entity: Core] [ Binds: file.py] [odd: x]")
    (tmp_path / "d.json").write_text(json.dumps(GRAPH))
    (tmp_path / "c.py").write_text("class A:\n    def f(self):\n        g()\n")
    assert edges(datasources.graph_of(read("light", tmp_path))[1]) == {("light::n.md", "Core", "declares_entity"), ("light::n.md", "file.py", "binds_to")}
    n, e = datasources.graph_of(read("descriptor", tmp_path))
    assert nodes(n) == {("a", "A", 11), ("b", "b", 100)} and {r["weight"] for r in e.collect()} == {1.0, 0.5}
    n, e = datasources.graph_of(read("code", tmp_path, pattern=r"\.py$"))
    assert ("file::c.py::class::A", "file::c.py::fn::A::f", "contains") in edges(e) and ("file::c.py::fn::A::f", "ref::g", "calls") in edges(e)


def test_files_are_dealt_by_their_bytes_and_some_are_left_out(spark, read, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.txt").write_text("x" * 1000)
    for name in (".git", "node_modules", "_tmp"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "no.txt").write_text("no")
    (tmp_path / "Cargo.lock").write_text("no")
    (tmp_path / "bin.txt").write_bytes(b"a\x10\x01\x00")
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfe ok")
    files = datasources.listed(str(tmp_path))
    assert len(files) == 32 and [len(p) for p in datasources.dealt(files, 10 * (1000 + datasources.FILE_COST))][:2] == [10, 10]
    df = read("code_tree", tmp_path, partitionBytes=3 * (1000 + datasources.FILE_COST))
    assert df.rdd.getNumPartitions() >= 10
    rows = {r["path"]: r for r in df.collect()}
    assert len(rows) == 31 and rows["odd.txt"]["text"].endswith(" ok") and rows["f00.txt"]["size"] == 1000 and len(rows["f00.txt"]["hash"]) == 64


def test_empty_and_missing_folders(spark, read, tmp_path):
    assert read("bibtex", tmp_path).count() == 0 and read("code_tree", tmp_path).count() == 0
    with pytest.raises(Exception, match="(?i)not.*(found|exist)|no such"):
        read("bibtex", tmp_path / "nowhere").count()
    (tmp_path / "one.bib").write_text(BIB)
    assert read("bibtex", tmp_path / "one.bib").where("relation = 'authored_by'").count() == 2


def test_the_tree_as_a_stream_gives_each_change_once(spark, read, tmp_path):
    root, out = tmp_path / "tree", tmp_path / "out"
    root.mkdir()
    stream = spark.readStream.format("code_tree").load(str(root))

    def tick():
        stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"], r["text"]) for r in spark.read.schema(datasources.FILE_SCHEMA).parquet(str(out / "rows")).collect())

    (root / "a.py").write_text("1")
    (root / "b.py").write_text("2")
    assert tick() == [("a.py", "1"), ("b.py", "2")]
    assert tick() == [("a.py", "1"), ("b.py", "2")]
    time.sleep(0.02)
    (root / "a.py").write_text("3")
    (root / "c.py").write_text("4")
    assert tick() == [("a.py", "1"), ("a.py", "3"), ("b.py", "2"), ("c.py", "4")]
    old = time.time() - 100
    os.utime(root / "b.py", (old, old))
    assert len(tick()) == 4
