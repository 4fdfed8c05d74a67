"""Sources and sinks over texts that are made of the tables, and the smaller operators that other queries rest on.

Every text is built from whole tables, and the SQL says what its reader must give.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomgraph.functions import texts as tf
from loomgraph.operators import activation, documents, ledgers, matching, merge, metrics, reports, spread, text, topology, traversal
from loomgraph.operators.graph import PropertyGraph, r6
from loomgraph.plans.durable import scratch
from loomgraph.queries.activation import SEEDS, wave_sql
from loomgraph.queries.documents import _drained
from loomgraph.queries.registry import ORACLE_SQL, query, table
from loomgraph.queries.texts import _QUERY, _tfidf_sql, _token_sql
from loomgraph.sources import datasources, formats, scopes, state
from loomgraph.sources.tables_graph import full_graph, id_of, spine_graph
from loomgraph.streaming import ledgers as streams
from loomgraph.streaming import stateful


def _text(df, key: str, template: str, *values):
    """(path, text) of every row: ``{}`` of the template are the values in turn."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:], strict=True):
        pieces += [(F.col(v) if isinstance(v, str) else v).cast("string"), F.lit(p)]
    return df.select(F.concat(F.lit(key), F.col(values[0]).cast("string")).alias("path"), F.concat(*pieces).alias("text"))


def _part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 5).alias("k5"), (F.col("p_partkey") % 7).alias("k7"), (F.col("p_partkey") + 1).alias("next"), F.col("p_size").alias("size"))


def _folder(spark) -> str:
    return scratch(spark, "query")


# --- sources ----------------------------------------------------------------------------------------


@query("SELECT n_regionkey::VARCHAR AS folder, 2::BIGINT AS n_files, CAST(sum(2 * length(n_name) + 4) AS BIGINT) AS bytes FROM nation GROUP BY n_regionkey", graph=False)
def s1_code_tree(spark, sf_dir):
    at = _folder(spark)
    n = table(spark, sf_dir, "nation")
    n.select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("r")).repartition("r").write.partitionBy("r").text(f"{at}/src")
    n.select("n_name").coalesce(1).write.text(f"{at}/node_modules/x")  # never walked into
    n.select("n_name").coalesce(1).write.text(f"{at}/.hidden")
    n.select(F.concat("n_name", F.lit("\x10\x01\x00")).alias("value"), F.col("n_regionkey").alias("r")).repartition("r").write.partitionBy("r").text(f"{at}/src/bin")  # a zero byte after two that look like one
    n.select(F.concat("n_name", F.lit("\x10\x01")).alias("value"), F.col("n_regionkey").alias("r")).repartition("r").write.partitionBy("r").text(f"{at}/src/text")  # no zero byte
    t = formats.code_tree(spark, at).where(F.col("path").startswith("src/"))
    return t.groupBy(F.regexp_extract("path", r"r=(\d+)", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


@query("SELECT DISTINCT format('{:08x}', o_orderkey) AS commit, epoch(o_orderdate)::DOUBLE AS ts, 'cust' || o_custkey AS author, 'p' || l_partkey || '.rs' AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey", graph=False)
def s3_commit_log(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = F.concat(F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), F.lit("|"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("|cust"), F.col("o_custkey").cast("string"))
    heads = o.select(F.concat(F.lit("log"), F.col("o_custkey").cast("string")).alias("source"), (F.col("o_orderkey") * 100).alias("line_no"), head.alias("value"))
    files = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("log"), F.col("o_custkey").cast("string")).alias("source"), (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".rs")).alias("value"))
    return formats.commit_log(heads.unionByName(files))


#: Files of four languages: names of the part's number, comments and strings that look like code, and a nested function.
_CODE = {
    "py": "import os\nfrom pkg.m{k7} import x\n# helper{k}(9)\nclass C{k}(Base):\n    @app.get('/r{k}')\n    def f{k}(self, a: T{k5}):\n        s = \"other{k}(2) # no\"\n        return helper{k5}(1)\n",
    "rs": "use pkg::m{k7};\n#[derive(Debug)]\npub struct C{k};\n/* helper{k}(9) /* deep */ */\nimpl Base for C{k} {\n    fn f{k}(&self, a: T{k5}) {\n        let s = \"other{k}(2) // no\"; helper{k5}(1);\n    }\n}\n",
    "ts": "import {x} from 'pkg.m{k7}';\n// helper{k}(9)\nexport class C{k} extends Base {\n  f{k}(a: T{k5}) { const s = `other{k}(2)`; return helper{k5}(1); }\n}\n",
    "kt": "import pkg.m{k7}\n/* helper{k}(9) */\nclass C{k} : Base {\n  fun f{k}(a: T{k5}) { val s = \"other{k}(2)\"; helper{k5}(1) }\n}\n",
}


def _code_files(spark, sf_dir):
    """One file for each part, in turn of each language."""
    p, out = _part(spark, sf_dir), None
    for i, (ext, body) in enumerate(_CODE.items()):
        pieces = [F.col(x).cast("string") if j % 2 else F.lit(x) for j, x in enumerate(re.split(r"\{(k|k5|k7)\}", body))]
        one = p.where(F.col("k") % len(_CODE) == i).select(F.concat(F.lit("src/p"), F.col("k").cast("string"), F.lit(f".{ext}")).alias("path"), F.concat(*pieces).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


_FILES = """cf AS (SELECT p_partkey AS k, p_partkey % 5 AS k5, p_partkey % 7 AS k7, ['py', 'rs', 'ts', 'kt'][1 + p_partkey % 4] AS ext,
  'file::src/p' || p_partkey || '.' || ['py', 'rs', 'ts', 'kt'][1 + p_partkey % 4] AS file FROM part),
ci AS (SELECT *, file || CASE ext WHEN 'rs' THEN '::struct::C' ELSE '::class::C' END || k AS class, file || '::fn::C' || k || '::f' || k AS fn FROM cf)"""


@query(f"""WITH {_FILES} SELECT file AS external_id, 'p' || k || '.' || ext AS label, 0 AS node_type, 1 AS line_start FROM ci
UNION ALL SELECT fn, 'f' || k, 2, CASE ext WHEN 'ts' THEN 4 WHEN 'kt' THEN 4 ELSE 6 END FROM ci UNION ALL SELECT class, 'C' || k, CASE ext WHEN 'rs' THEN 4 ELSE 3 END, CASE ext WHEN 'py' THEN 4 ELSE 3 END FROM ci""", graph=False)
def s4_extracted_nodes(spark, sf_dir):
    return formats.extract_code(_code_files(spark, sf_dir))[0].select("external_id", "label", "node_type", "line_start")


@query(f"""WITH {_FILES} SELECT src, dst, relation, weight::DOUBLE AS weight FROM ci, LATERAL (VALUES (file, class, 'contains', 1.0), (class, fn, 'contains', 1.0), (fn, 'ref::helper' || k5, 'calls', 0.4), (fn, 'ref::T' || k5, 'references', 0.3),
  (class, 'ref::Base', 'implements', 0.7), (file, 'ref::pkg' || CASE ext WHEN 'rs' THEN '::m' ELSE '.m' END || k7, 'imports', 0.5)) t(src, dst, relation, weight)
UNION ALL SELECT src, dst, relation, weight FROM ci, LATERAL (VALUES (file, 'ref::os', 'imports', 0.5), (file, 'ref::x', 'imports', 0.5), ('route::/r' || k, file, 'routes_to', 0.5), (fn, 'ref::app', 'references', 0.4)) t(src, dst, relation, weight) WHERE ext = 'py'""", graph=False)
def s5_extracted_edges(spark, sf_dir):
    return formats.extract_code(_code_files(spark, sf_dir))[1].select("src", "dst", "relation", "weight")


#: A type with one method each, in many languages; K stands for the part's number. Every file has a call in a comment and one in a string.
_METHODS = {
    "py": ("class", "class C{k}:\n    def f{k}(self):\n        g{k}('h{k}()')  # i{k}()\n"),
    "rs": ("struct", "struct C{k} {}\nimpl C{k} {\n    pub fn f{k}(&self) { g{k}(\"h{k}()\"); } // i{k}()\n}\n"),
    "go": ("struct", "type C{k} struct {}\n\nfunc (c *C{k}) f{k}() {\n\tg{k}(`h{k}()`) // i{k}()\n}\n"),
    "java": ("class", "public class C{k} {\n  public static void f{k}(int a) {\n    g{k}(\"h{k}()\"); /* i{k}() */\n  }\n}\n"),
    "ts": ("class", "class C{k} {\n  async f{k}(): void {\n    g{k}('h{k}()'); // i{k}()\n  }\n}\n"),
    "cpp": ("class", "#include <v>\nclass C{k} {\n  int f{k}(int a) {\n    return g{k}(\"h{k}()\"); // i{k}()\n  }\n};\n"),
    "cs": ("class", "public class C{k}\n{\n  public void f{k}(int a)\n  {\n    g{k}(@\"h{k}()\\\"); // i{k}()\n  }\n}\n"),
    "kt": ("class", "class C{k} {\n  fun f{k}() = g{k}(\"h{k}()\") // i{k}()\n}\n"),
    "swift": ("class", "class C{k} {\n  func f{k}() {\n    g{k}(\"h{k}()\") /* i{k}() /* j */ */\n  }\n}\n"),
    "php": ("class", "<?php\nclass C{k} {\n  public function f{k}($a) {\n    return g{k}('h{k}()'); # i{k}()\n  }\n}\n"),
    "rb": ("class", "class C{k}\n  def f{k}(a)\n    if a\n      g{k}(\"h{k}() # no\") # i{k}()\n    end\n  end\nend\n"),
    "scala": ("class", "class C{k} {\n  def f{k}(a: Int) = {\n    g{k}(\"h{k}()\") // i{k}()\n  }\n}\n"),
    "ex": ("module", "defmodule C{k} do\n  def f{k}(a) do\n    g{k}(\"h{k}()\") # i{k}()\n  end\nend\n"),
}


def _method_files(spark, sf_dir):
    """A file of every language for each supplier."""
    s, out = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k")), None
    for ext, (_, body) in _METHODS.items():
        pieces = [F.col("k") if j % 2 else F.lit(x) for j, x in enumerate(re.split(r"\{(k)\}", body))]
        one = s.select(F.concat(F.lit("m"), "k", F.lit(f".{ext}")).alias("path"), F.concat(*pieces).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


_KINDS = "(VALUES " + ", ".join(f"('{e}', '{k}')" for e, (k, _) in _METHODS.items()) + ") t(ext, kind)"


@query(f"""WITH m AS (SELECT 'file::m' || s_suppkey || '.' || ext AS file, s_suppkey AS k, kind FROM supplier, {_KINDS}), n AS (SELECT *, file || '::' || kind || '::C' || k AS class, file || '::fn::C' || k || '::f' || k AS fn FROM m)
SELECT file AS src, class AS dst, 'contains' AS relation FROM n UNION ALL SELECT class, fn, 'contains' FROM n UNION ALL SELECT fn, 'ref::g' || k, 'calls' FROM n""", graph=False)
def s6_methods(spark, sf_dir):
    """Nested scopes: each method is in its class, and its one call is its own."""
    return formats.extract_code(_method_files(spark, sf_dir))[1].where("relation <> 'imports'").select("src", "dst", "relation")


@query(f"SELECT ext, kind, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(length(s_suppkey::VARCHAR)) AS BIGINT) AS digits FROM supplier, {_KINDS} GROUP BY ext, kind", graph=False)
def s6_code_scopes_sql(spark, sf_dir):
    """The table function in SQL, with a lateral join: files that have a method contained in a type."""
    scopes.register(spark)
    return spark.sql(
        r"""SELECT regexp_extract(path, '[.](\\w+)$', 1) AS ext, regexp_extract(src, '::(\\w+)::', 1) AS kind, count(*) AS n_files, sum(length(regexp_extract(path, 'm(\\d+)', 1))) AS digits
        FROM {files} f, LATERAL code_scopes(f.path, f.text) WHERE relation = 'contains' AND dst LIKE '%::fn::C%::f%' GROUP BY 1, 2""",
        files=_method_files(spark, sf_dir),
    )


#: A line that defines ``f<number>`` in each of further languages.
_DEFINITIONS = {"rb": "  def f{}", "swift": "public func f{}() {", "php": "function f{}() {", "lua": "local function f{}()", "sh": "f{}() {", "pl": "sub f{} {", "hs": "f{} :: Int", "ml": "let rec f{} x = x", "clj": "(defn f{} [x])", "r": "f{} <- function(x) x", "sql": "CREATE FUNCTION f{} AS 1", "java": "  public static int f{}(int x) {", "zig": "pub fn f{}() void {", "scala": "  def f{} = 1", "js": "async function f{}() {"}


@query("SELECT ext, CAST(count(*) AS BIGINT) AS n FROM supplier, (SELECT unnest([" + ", ".join(f"'{e}'" for e in _DEFINITIONS) + "]) AS ext) GROUP BY ext", graph=False)
def s6_languages(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    files = None
    for ext, line in _DEFINITIONS.items():
        a, b = line.split("{}", 1)
        one = n.select(F.concat(F.lit("a"), F.col("k").cast("string"), F.lit(f".{ext}")).alias("path"), F.concat(F.lit(a), F.col("k").cast("string"), F.lit(b)).alias("text"))
        files = one if files is None else files.unionByName(one)
    found = formats.extract_code(files)[0].where("node_type = 2")
    right = F.col("label") == F.concat(F.lit("f"), F.regexp_extract("external_id", r"file::a(\d+)\.", 1))
    return found.where(right).groupBy(F.regexp_extract("external_id", r"file::a\d+\.(\w+)::", 1).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


#: Code and the same without comments, by file extension; {k} stands for a number.
_COMMENTED = {
    "py": ('x{k} = "a # {k}"  # note\ny = \'\'\'b\n# "c{k}\'\'\'\n', 'x{k} = "a # {k}"  \ny = \'\'\'b\n# "c{k}\'\'\'\n'),
    "rs": ('#[derive(Debug)]\nlet u = "http://x{k}"; /* a /* {k} */ b\n */ let c = \'"\'; // d\n', '#[derive(Debug)]\nlet u = "http://x{k}"; \n let c = \'"\'; \n'),
    "c": ("#include <x{k}.h>\n#define A '\"' // {k}\n/* \"*/int a{k}; /* // */\n", "#include <x{k}.h>\n#define A '\"' \nint a{k}; \n"),
    "sh": ('echo $# ${v#{k}} "# {k}" # gone\n# gone\n', 'echo $# ${v#{k}} "# {k}" \n\n'),
    "sql": ("select 'it''s -- {k}' -- gone\n/* ' */ from t{k}\n", "select 'it''s -- {k}' \n from t{k}\n"),
    "lua": ("a{k} = [==[ -- ]] {k}]==] --[[ gone\n]] b = 1 -- gone\n", "a{k} = [==[ -- ]] {k}]==] \n b = 1 \n"),
}
_PLAIN = " ".join(f"WHEN '{ext}' THEN {' || chr(10) || '.join(repr_sql for repr_sql in [chr(39) + line.replace(chr(39), chr(39) * 2) + chr(39) for line in out.split(chr(10))])}" for ext, (_, out) in _COMMENTED.items())


@query(f"SELECT 's' || p_partkey || '.' || ext AS path, replace(CASE ext {_PLAIN} END, '{{k}}', p_partkey::VARCHAR) AS code FROM part, (SELECT unnest([{', '.join(repr(e) for e in _COMMENTED)}]) AS ext)", graph=False)
def s7_strip_comments(spark, sf_dir):
    p, out = _part(spark, sf_dir).select(F.col("k").cast("string").alias("k")), None
    for ext, (text_of, _) in _COMMENTED.items():
        one = p.select(F.concat(F.lit("s"), "k", F.lit(f".{ext}")).alias("path"), F.replace(F.lit(text_of), F.lit("{k}"), "k").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.select("path", formats.strip_comments(F.col("text"), F.col("path")).alias("code"))


@query("SELECT 'n' || n_nationkey AS external_id, n_name AS label, CASE WHEN n_nationkey % 2 = 1 THEN 11 ELSE 100 END AS node_type FROM nation", graph=False)
def s8_descriptor_nodes(spark, sf_dir):
    return formats.descriptor_rows(_descriptors(spark, sf_dir))[0].select("external_id", "label", "node_type")


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, r AS relation, w::DOUBLE AS weight, c::DOUBLE AS causal_strength, d AS direction FROM nation, (VALUES ('relates_to', 1.0, 0.4, 0), ('contains', 0.5, 0.8, 1)) t(r, w, c, d)", graph=False)
def s8_descriptor_edges(spark, sf_dir):
    return formats.descriptor_rows(_descriptors(spark, sf_dir))[1]


def _descriptors(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    me, to = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    kind = F.when(F.col("n_nationkey") % 2 == 1, "Process").otherwise("odd")
    nodes = F.array(F.struct(me.alias("id"), F.col("n_name").alias("label"), kind.alias("type")))
    edges = F.array(F.struct(me.alias("source"), to.alias("target"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("weight")), F.struct(me.alias("source"), to.alias("target"), F.lit("contains").alias("relation"), F.lit(0.5).alias("weight")))
    return n.select(F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("text"))


@query("SELECT 'note::s' || s_suppkey || '::S' || s_suppkey AS src, 'entry::' || md5(replace(e, '#', s_suppkey::VARCHAR)) AS dst, r AS relation FROM supplier, (VALUES ('TODO ring #', 'tracks'), ('we decided on #', 'decided'), ('on 2024-01-05 shipped #', 'happened_on'), ('plain #', 'relates_to')) t(e, r)", graph=False)
def s9_notes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    t = _text(s, "s", "{}\n# S{}\n- TODO ring {}\n* we decided on {}\n1. on 2024-01-05 shipped {}\n- plain {}\n", "k", "k", "k", "k", "k", "k")
    return formats.notes(t)[1].select("src", "dst", "relation")


@query("SELECT 'light::s' || s_suppkey AS src, 'e' || s_suppkey AS dst, 'declares_entity' AS relation FROM supplier UNION ALL SELECT 'light::s' || s_suppkey, 'd' || s_suppkey % 3, 'declares_dependency' FROM supplier", graph=False)
def s10_light(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 3).alias("k3"))
    return formats.light(_text(s, "s", "{} is [entity: e{}] and [ Depends : d{}] but [odd: x]", "k", "k", "k3"))


@query("SELECT DISTINCT 'bib::p' || p_partkey AS src, d AS dst, r AS relation FROM part, LATERAL (VALUES ('author::ann ' || p_size, 'authored_by'), ('author::bob b', 'authored_by'), ('venue::j' || p_partkey % 5, 'published_in')) t(d, r)", graph=False)
def s11_bibtex(spark, sf_dir):
    return formats.bibtex(_bib_texts(spark, sf_dir))[1]


def _bib_texts(spark, sf_dir):
    parts = ["@article{p", "k", ",\n title = {On {Things} ", "k", "},\n author = {Ann ", "size", " and Bob B},\n journal = {J", "k5", "},\n doi = {10.1/P", "k", "}\n}\n"]
    return _part(spark, sf_dir).select(F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)]).alias("text"))


@query("SELECT DISTINCT 'doi::10.1/x' || p_partkey AS src, d AS dst, r AS relation FROM part, LATERAL (VALUES ('author::ann b' || p_size, 'authored_by'), ('venue::j' || p_partkey % 5, 'published_in'), ('doi::10.1/x' || (p_partkey + 1), 'cites')) t(d, r)", graph=False)
def s12_crossref(spark, sf_dir):
    return formats.crossref_rows(_crossref_texts(spark, sf_dir))[1]


def _crossref_texts(spark, sf_dir):
    p = _part(spark, sf_dir)
    say = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    author = F.array(F.struct(F.lit("Ann").alias("given"), say("B", "size").alias("family")))
    refs = F.array(F.struct(say("10.1/X", "next").alias("DOI")), F.struct(F.lit(None).cast("string").alias("DOI")))
    work = F.struct(say("10.1/X", "k").alias("DOI"), F.array(say("T", "k")).alias("title"), author.alias("author"), F.array(say("J", "k5")).alias("container-title"), refs.alias("reference"))
    return p.select(F.to_json(F.struct(work.alias("message"))).alias("text"))


@query("SELECT DISTINCT 'doi::10.2/x' || p_partkey AS src, d AS dst, r AS relation FROM part, LATERAL (VALUES ('S' || p_size, 'authored_by'), ('J' || p_partkey % 5, 'published_in'), ('10.2/Y' || p_partkey % 7, 'cites')) t(d, r)", graph=False)
def s13_jats(spark, sf_dir):
    return formats.xml_records(_jats_texts(spark, sf_dir), "jats")[1]


def _jats_texts(spark, sf_dir):
    return _text(
        _part(spark, sf_dir), "j",
        '<!-- {} --><article><front><journal-meta><journal-title>J{}</journal-title></journal-meta><article-meta><article-id pub-id-type="doi">10.2/X{}</article-id><title-group><article-title>T <b>one</b></article-title></title-group>'
        '<contrib><name><surname>S{}</surname></name></contrib></article-meta></front><back><ref><pub-id pub-id-type="doi">10.2/Y{}</pub-id></ref></back></article>',
        "k", "k5", "k", "size", "k7",
    )


@query("SELECT DISTINCT 'patent::' || p_partkey AS src, d AS dst, r AS relation FROM part, LATERAL (VALUES ((p_partkey + 1)::VARCHAR, 'cites'), ('Org ' || p_partkey % 5, 'assigned_to'), ('C' || p_partkey % 7, 'classified_as')) t(d, r)", graph=False)
def s14_patents(spark, sf_dir):
    return formats.xml_records(_patent_texts(spark, sf_dir), "patent")[1]


def _patent_texts(spark, sf_dir):
    one = "<us-patent-grant><publication><doc-number>{}</doc-number></publication><main-classification>C{}</main-classification><invention-title>I</invention-title><assignee><orgname>Org {}</orgname></assignee><citation><doc-number>{}</doc-number></citation></us-patent-grant>"
    return _text(_part(spark, sf_dir), "p", '{}<?xml version="1.0"?>\n' + one, "k", "k", "k7", "k5", "next")


@query("SELECT DISTINCT 'rfc::' || p_partkey AS src, d AS dst, r AS relation FROM part, LATERAL (VALUES ('A ' || p_size, 'authored_by'), ('RFC' || p_partkey % 7, 'references'), ('1', 'obsoletes'), ((p_partkey + 1)::VARCHAR, 'obsoletes'), (('5' || p_partkey % 5), 'updates')) t(d, r)", graph=False)
def s15_rfc(spark, sf_dir):
    return formats.xml_records(_rfc_texts(spark, sf_dir), "rfc")[1]


def _rfc_texts(spark, sf_dir):
    return _text(_part(spark, sf_dir), "r", '<?xml?>{}<rfc number="{}" obsoletes="1, {}" updates="5{}"><front><title>T</title><author fullname="A {}"/></front><back><reference anchor="RFC{}"/></back></rfc>', "k", "k", "next", "k5", "size", "k7")


# --- the same formats as data sources -------------------------------------------------------------------


def _source(spark, texts, kind: str, edges: bool = True):
    """Texts written as files, read through the data source of a format: distinct edges."""
    at = _folder(spark)
    texts.select("text").write.option("lineSep", "\n").text(at)
    datasources.register(spark)
    records = spark.read.format(kind).option("pattern", r"\.txt$").option("partitionBytes", 1 << 20).load(at)
    return datasources.graph_of(records)[1].select("src", "dst", "relation")


@query(ORACLE_SQL["s11_bibtex"], graph=False)
def s11_bibtex_source(spark, sf_dir):
    """``spark.read.format("bibtex")``; several entries in a file."""
    return _source(spark, _bib_texts(spark, sf_dir), "bibtex")


@query(ORACLE_SQL["s12_crossref"], graph=False)
def s12_crossref_source(spark, sf_dir):
    """``spark.read.format("crossref")``: a work a line, as a registry hands out its dumps."""
    at = _folder(spark)
    _crossref_texts(spark, sf_dir).write.option("maxRecordsPerFile", 4096).text(at)
    datasources.register(spark)
    return datasources.graph_of(spark.read.format("crossref").option("pattern", r"\.txt$").load(at))[1].select("src", "dst", "relation")


@query(ORACLE_SQL["s13_jats"], graph=False)
def s13_jats_source(spark, sf_dir):
    return _source(spark, _jats_texts(spark, sf_dir), "jats")


@query(ORACLE_SQL["s14_patents"], graph=False)
def s14_patents_source(spark, sf_dir):
    return _source(spark, _patent_texts(spark, sf_dir), "patent")


@query(ORACLE_SQL["s15_rfc"], graph=False)
def s15_rfc_source(spark, sf_dir):
    return _source(spark, _rfc_texts(spark, sf_dir), "rfc")


@query("SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, r AS relation FROM nation, (VALUES ('relates_to'), ('contains')) t(r)", graph=False)
def s8_descriptor_source(spark, sf_dir):
    at = _folder(spark)
    _descriptors(spark, sf_dir).write.option("maxRecordsPerFile", 1).text(at)
    datasources.register(spark)
    return datasources.graph_of(spark.read.format("descriptor").option("pattern", r"\.txt$").load(at))[1].select("src", "dst", "relation")


@query("SELECT n_regionkey::VARCHAR AS folder, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS n_lines FROM nation GROUP BY n_regionkey", graph=False)
def s1_tree_stream(spark, sf_dir):
    """The tree as a stream: two regions' folders are there at first, the others when it starts again; each file comes once."""
    at, out = _folder(spark), _folder(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("r"))
    datasources.register(spark)
    for first in (True, False):
        n.where((F.col("r") < 2) if first else (F.col("r") >= 2)).repartition("r").write.mode("append").partitionBy("r").text(at)
        changes = spark.readStream.format("code_tree").option("pattern", r"\.txt$").load(at)
        changes.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy(F.regexp_extract("path", r"r=(\d+)/", 1).alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.size(F.split("text", "\n")) - 1).alias("n_lines"))


_ROUTED = [("a.bib", "@x", "bibtex"), ("a.xml", "<rfc number='1'>", "rfc"), ("a.xml", "<us-patent-grant>", "patent"), ("a.XML", "<article>", "jats"), ("a.xml", "<z>", "xml"), ("a.json", '{"DOI": 1}', "crossref"), ("a.json", "{}", "json"), ("a.md", "[entity: x]", "light"), ("a.md", "# h", "notes"), ("a.htm", "<p>", "html"), ("a.rs", "fn", "code")]


@query("SELECT f AS format, CAST(count(*) AS BIGINT) AS n FROM part, (VALUES " + ", ".join(f"('{f}')" for _, _, f in _ROUTED) + ") t(f) GROUP BY f", graph=False)
def s17_router(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(t).alias("text")) for p, t, _ in _ROUTED])
    t = _part(spark, sf_dir).select("k", F.explode(kinds).alias("f")).select(F.concat(F.col("k").cast("string"), F.lit("/"), "f.name").alias("path"), "f.text")
    return t.groupBy(formats.detect_format(F.col("path"), F.col("text")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'crate::c' || p_partkey AS src, d AS dst, r AS relation FROM part, LATERAL (VALUES ('crate::serde', 'depends_on'), ('crate::c' || (p_partkey + 1), 'depends_on'), ('file::c' || p_partkey || '/Cargo.toml', 'contains')) t(d, r)", graph=False)
def s18_cargo(spark, sf_dir):
    t = _text(_part(spark, sf_dir), "c", '{}\n[package]\nname = "c{}"\n\n[dependencies]\nserde = "1"\nc{} = "0.1"\n', "k", "k", "next")
    return formats.cargo_workspace(t.select(F.concat("path", F.lit("/Cargo.toml")).alias("path"), "text"))[1]


@query("SELECT form, relation, CAST(count(*) AS BIGINT) AS n FROM spine_edges, (VALUES ('json'), ('parquet')) t(form) WHERE dst NOT IN (SELECT node_id FROM spine_nodes WHERE node_type = 13) GROUP BY ALL")
def s19_snapshots(spark, sf_dir):
    """K1, K2 and S19: both forms of a snapshot, written and read again; edges of nodes that are gone are left out."""
    g, out = spine_graph(spark, sf_dir), None
    for form in ("json", "parquet"):
        at = _folder(spark)
        formats.save_graph(g.nodes.where("node_type <> 13"), g.edges, at, form)
        one = formats.load_graph(spark, at, form)[1].groupBy(F.lit(form).alias("form"), "relation").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_type AS name, CAST(count(*) + count(*) FILTER (event_id % 2 = 0) AS BIGINT) AS invocations, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(sum(user_id) AS BIGINT) AS duration FROM events GROUP BY event_type", graph=False)
def s20_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    span = F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("duration_us"), F.when(F.col("event_id") % 2 == 0, 2).alias("count"), F.when(F.col("event_type") == "error", True).alias("is_error"))
    s = formats.span_batch(e.select(F.to_json(F.array(span)).alias("text")))
    return s.groupBy("name").agg(F.sum("count").alias("invocations"), F.count_if("is_error").alias("errors"), F.sum("duration_us").alias("duration"))


@query(
    "WITH e AS (SELECT event_id, event_type, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events), a AS (SELECT 'k' AS attribute, 'BIGINT' AS kind, k FROM e UNION ALL SELECT 'who', 'OBJECT<id: BIGINT>', user_id FROM e WHERE event_id % 2 = 0 UNION ALL SELECT 'who', 'STRING', user_id FROM e WHERE event_id % 2 = 1) "
    "SELECT attribute, kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN kind = 'STRING' THEN NULL ELSE k END) AS BIGINT) AS total FROM a GROUP BY ALL", graph=False
)
def s20_attributes(spark, sf_dir):
    """Attributes of unknown shape: each event's own ones, and one that is an object here and a string there."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    who = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"id": '), user, F.lit("}"))).otherwise(F.concat(F.lit('"u'), user, F.lit('"')))
    docs = e.select("event_id", F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "who": '), who, F.lit("}")).alias("text"))
    rows = formats.attribute_rows(docs, "event_id", "text")
    rows = formats.with_attributes(rows, "value", {"whole": ("$", "long"), "inner": ("$.id", "long")})
    return rows.groupBy("attribute", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("whole", "inner")).alias("total"))


@query("SELECT 'duplicate_node' AS problem, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'dangling_dst', CAST(count(*) AS BIGINT) FROM spine_edges JOIN spine_nodes ON node_id = dst WHERE node_type = 100 UNION ALL SELECT 'dangling_src', 0 FROM region WHERE false", graph=True)
def s21_builder_problems(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    kept = g.nodes.where("node_type <> 100")
    bad = PropertyGraph(kept.unionByName(kept.where("node_type = 14")), g.edges)
    return bad.problems().groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# --- state and artifacts ----------------------------------------------------------------------------


@query("SELECT 'edges' AS what, CAST(count(*) AS BIGINT) AS n FROM spine_edges UNION ALL SELECT 'nodes', CAST(count(*) AS BIGINT) FROM spine_nodes UNION ALL SELECT 'trust', CAST(count(DISTINCT user_id) AS BIGINT) FROM events UNION ALL SELECT 'tremor', CAST(count(DISTINCT l_suppkey) AS BIGINT) FROM lineitem UNION ALL SELECT 'version', 2")
def k5_persist(spark, sf_dir):
    """K4 and K5: graph and side tables of two versions; an unfinished third one does not count."""
    at, g = _folder(spark), spine_graph(spark, sf_dir)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "defect").otherwise("partial").alias("kind"), F.unix_timestamp("ts").cast("double").alias("ts"))
    trust = ledgers.trust(events, 1.8e9)
    tremor = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    state.persist(PropertyGraph(g.nodes.limit(0), g.edges.limit(0)), at, 1, trust=trust)
    state.persist(g, at, 2, trust=trust, tremor=tremor)
    formats.save_graph(g.nodes.limit(1), g.edges.limit(0), f"{at}/v=3")  # died before its marker
    graph, sides = state.restore(spark, at)
    rows = {"nodes": graph.nodes, "edges": graph.edges, **sides}
    out = state.versions(spark, at).agg(F.max("version").cast("long").alias("n")).select(F.lit("version").alias("what"), "n")
    for name, df in sorted(rows.items()):
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n"))
    return out


@query("SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, sha256(text) AS sha256 FROM documents", graph=False)
def k8_artifacts(spark, sf_dir):
    at, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    state.write_artifacts(d, documents.claims(d, "doc_id", "text"), at)
    meta = spark.read.schema("doc_id long, n_chars long, n_lines long, sha256 string").json(f"{at}/metadata")
    return meta.join(spark.read.schema("doc_id long").json(f"{at}/markdown"), "doc_id", "left_semi")


# --- joins, aggregates and rankings ---------------------------------------------------------------------


@query(f"SELECT 'forward' AS way, CAST(count(DISTINCT dst) AS BIGINT) AS n FROM edges WHERE src IN ({id_of('nation::3')}, {id_of('nation::4')}) UNION ALL SELECT 'reverse', CAST(count(DISTINCT src) AS BIGINT) FROM edges WHERE dst IN (SELECT node_id FROM nodes WHERE node_type = 12)")
def j1_j2_adjacency(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    ahead = traversal.reach(g, g.seeds(["nation::3", "nation::4"]), 1).where("depth = 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("forward").alias("way"), "n")
    back = traversal.reach(g, g.nodes.where("node_type = 12"), 1, "reverse").where("depth = 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reverse").alias("way"), "n")
    return ahead.unionByName(back)


@query(f"WITH u AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), l1 AS (SELECT DISTINCT dst AS node_id FROM u WHERE src = {id_of('customer::9')}), f AS (SELECT {id_of('customer::9')}::BIGINT AS node_id UNION SELECT node_id FROM l1 UNION SELECT dst FROM u JOIN l1 ON src = node_id) SELECT node_type, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE node_id IN (SELECT node_id FROM f) GROUP BY node_type")
def j12_focus(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    focus = traversal.reach(g, g.seeds(["customer::9"]), 2, "both")
    return g.nodes.join(focus.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


_GRP = "ge AS (SELECT src % 7 AS cs, dst % 7 AS ct FROM edges)"


@query(f"WITH {_GRP} SELECT cs AS community, round(count(*) FILTER (cs <> ct) / count(*)::DOUBLE, 6) AS coupling, round(count(*) FILTER (cs = ct) / count(*)::DOUBLE, 6) AS cohesion FROM ge GROUP BY cs")
def a6_a7_coupling(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    group = g.nodes.select("node_id", (F.col("node_id") % 7).alias("community"))
    return metrics.coupling(g.edges, group).select("community", r6("coupling").alias("coupling"), r6("cohesion").alias("cohesion"))


@query("WITH n AS (SELECT 's' AS ns, s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL SELECT 'c', 1000000 + c_custkey, c_nationkey FROM customer) SELECT k AS key, CAST(count(DISTINCT id) AS BIGINT) AS size, CAST(count(DISTINCT ns) AS BIGINT) AS namespaces FROM n GROUP BY k HAVING count(DISTINCT id) >= 2", graph=False)
def a9_groupings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("namespace"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("namespace"), (F.col("c_custkey") + 1000000).alias("id"), F.col("c_nationkey").alias("nation"))
    return reports.groupings(s.unionByName(c), "nation")


@query("SELECT external_id, label, array_to_string(list_sort(list_distinct(list_concat(tags, ['x' || node_id % 2]))), ',') AS tags, greatest(last_modified, 5.0::DOUBLE) AS last_modified FROM nodes WHERE node_type = 12")
def a10_merged_nodes(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    base = PropertyGraph(g.nodes.where("node_type = 12"), g.edges.limit(0))
    over = base.nodes.withColumns({"tags": F.array(F.concat(F.lit("x"), (F.col("node_id") % 2).cast("string"))), "label": F.lit("other"), "last_modified": F.lit(5.0)})
    return merge.merge_graphs(base, PropertyGraph(over, base.edges)).nodes.select("external_id", "label", F.array_join("tags", ",").alias("tags"), "last_modified")


@query("WITH d AS (SELECT node_id, node_type, count(src) AS o FROM nodes LEFT JOIN edges ON src = node_id GROUP BY ALL) SELECT node_type, node_id, CAST(o AS BIGINT) AS out_degree FROM d QUALIFY row_number() OVER (PARTITION BY node_type ORDER BY o DESC, node_id) <= 5")
def w3_top_by_type(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    d = g.degrees().join(g.nodes.select("node_id", "node_type"), "node_id").withColumn("_o", F.struct((-F.col("out_degree")).alias("falling"), "node_id"))
    return topology.cross_pairs_top(d, "node_type", "_o", 5).select("node_type", "node_id", "out_degree")


@query("SELECT l_orderkey AS k, l_linenumber AS frame_no, round(percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 6) AS depth FROM lineitem", graph=False)
def w8_trace_depth(spark, sf_dir):
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("frame_no"))
    return matching.trace_depth(frames, "k", "frame_no").withColumn("depth", r6("depth"))


@query("SELECT external_id, round(a, 6) AS activation FROM (SELECT external_id, a, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY a >= top - 0.05::DOUBLE DESC, length(label) DESC, a DESC, external_id) AS n FROM (SELECT external_id, label, (node_id % 97) / 97.0::DOUBLE AS a, max((node_id % 97) / 97.0::DOUBLE) OVER (PARTITION BY lower(trim(label))) AS top FROM nodes WHERE node_type IN (12, 13))) WHERE n = 1 ORDER BY a DESC, external_id LIMIT 20")
def t1_top_activated(spark, sf_dir):
    loud = full_graph(spark, sf_dir).nodes.where("node_type IN (12, 13)").select("external_id", "label", ((F.col("node_id") % 97) / 97.0).alias("activation"))
    return merge.dedupe_ranked(loud, "activation", "label", "external_id", 20).select("external_id", r6("activation").alias("activation"))


_STRENGTHS = "st AS (SELECT src AS a, dst AS b, weight AS s FROM edges WHERE relation = 'imports'), bo AS (SELECT a, b, max(s) AS s FROM (SELECT a, b, s FROM st UNION ALL SELECT b, a, s FROM st) GROUP BY ALL)"


def _semantic(spark, sf_dir, fast):
    g = full_graph(spark, sf_dir)
    strengths = g.edges.where("relation = 'imports'").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("strength"))
    return text.semantic_query(g.nodes.where("node_type IN (12, 13)"), "steel supplier", strengths, 20, fast).select("node_id", r6("score").alias("score"))


_OWN = "own AS (SELECT * FROM nodes WHERE node_type IN (12, 13))"


@query(f"WITH {_OWN}, {_tfidf_sql('own', 'steel supplier')}, {_STRENGTHS}, h AS (SELECT node_id FROM sem ORDER BY round(semantic, 9) DESC, node_id LIMIT 3), n AS (SELECT b AS node_id, sum(s) / 3 AS t FROM bo WHERE a IN (SELECT node_id FROM h) GROUP BY b), z AS (SELECT coalesce(sem.node_id, n.node_id) AS node_id, coalesce(semantic, 0) AS g, coalesce(t, 0) AS t FROM sem FULL JOIN n ON sem.node_id = n.node_id), q AS (SELECT node_id, 0.4::DOUBLE * g + 0.4::DOUBLE * t + 0.2::DOUBLE * CASE WHEN contains(lower(label), 'vendor') OR contains(lower(label), 'provider') THEN 1 ELSE 0 END AS score FROM z JOIN own USING (node_id)) SELECT node_id, round(score, 6) AS score FROM q WHERE score > 0 ORDER BY round(q.score, 9) DESC, node_id LIMIT 20")
def x8_semantic_query(spark, sf_dir):
    return _semantic(spark, sf_dir, False)


@query(f"WITH {_OWN}, {_tfidf_sql('own', 'steel supplier')}, {_STRENGTHS}, f AS MATERIALIZED (SELECT node_id, semantic FROM sem ORDER BY round(semantic, 9) DESC, node_id LIMIT 60), h AS (SELECT node_id FROM f ORDER BY round(semantic, 9) DESC, node_id LIMIT 3), n AS (SELECT b AS node_id, sum(s) / 3 AS t FROM bo WHERE a IN (SELECT node_id FROM h) GROUP BY b), q AS (SELECT f.node_id, 0.5::DOUBLE * semantic + 0.5::DOUBLE * coalesce(t, 0) AS score FROM f LEFT JOIN n USING (node_id)) SELECT node_id, round(score, 6) AS score FROM q WHERE score > 0 ORDER BY round(q.score, 9) DESC, node_id LIMIT 20")
def t2_query_fast(spark, sf_dir):
    return _semantic(spark, sf_dir, True)


_BASIC = f"ba AS (SELECT node_id, {_token_sql('large')} AS a, {_token_sql('steel')} AS b, {_token_sql('customer')} AS c FROM own), bs AS (SELECT node_id, CASE WHEN a + b + c > 0 THEN least(greatest(0.5::DOUBLE * (a + b + c) / 3 + 0.35::DOUBLE * (CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT)) / 3 + 0.15::DOUBLE * greatest(a, b, c), 0), 1) ELSE 0.0::DOUBLE END AS score FROM ba)"


@query(f"WITH own AS (SELECT * FROM nodes WHERE node_type IN (12, 100)), {_BASIC}, {_tfidf_sql('own', _QUERY)}, t AS (SELECT node_id, score FROM bs WHERE score >= 0.1 ORDER BY bs.score DESC, node_id LIMIT 200) SELECT node_id, round(0.6::DOUBLE * score + 0.4::DOUBLE * coalesce(semantic, 0), 6) AS score FROM t LEFT JOIN sem USING (node_id)")
def x3_seed_blend(spark, sf_dir):
    """T3 and X3: at most 200 seeds of 0.1 or more, blended with the semantic score."""
    n = full_graph(spark, sf_dir).nodes.where("node_type IN (12, 100)")
    semantic = text.tfidf_query(n, "node_id", "label", _QUERY).withColumnRenamed("cosine", "score")
    return text.blend_seeds(text.find_seeds(n, _QUERY), semantic).withColumn("score", r6("score"))


@query(
    "WITH q AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)) AS w FROM part), t AS (SELECT k, unnest(['parsehttp' || k || 'request', 'parse', 'http' || k, 'request', 'snake_case-' || w, 'snake', 'case', w, 'orders' || k]) AS token, unnest(range(9)) AS i FROM q), "
    "d AS (SELECT k, token, min(i) AS i FROM t WHERE length(token) > 2 GROUP BY ALL) SELECT k, token, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i FROM d", graph=False
)
def x1_tokens(spark, sf_dir):
    """A question about each part: its identifiers are split before the case is folded, stop words go, tokens count once."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text_of = F.concat(F.lit("How is the parseHTTP"), k, F.lit("Request and (snake_case-"), F.split("p_name", " ")[0], F.lit(") of 'orders"), k, F.lit("'?"))
    t = p.select(F.col("p_partkey").alias("k"), F.posexplode(text.tokens_of(text_of)).alias("i", "token"))
    return t.select("k", "token", F.col("i").cast("long").alias("i"))


@query("WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Traceback (most recent call last): x' WHEN 1 THEN 'thread panicked at src/a.rs:3' WHEN 2 THEN 'goroutine 1 [running]' WHEN 3 THEN 'Exception in thread main' ELSE 'odd ' || event_type END AS t FROM events) SELECT event_id, ['python', 'rust', 'go', 'java', 'unknown'][1 + event_id % 5] AS language FROM e", graph=False)
def x10_error_language(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.element_at(F.array(F.lit("Traceback (most recent call last): x"), F.lit("thread panicked at src/a.rs:3"), F.lit("goroutine 1 [running]"), F.lit("Exception in thread main"), F.concat(F.lit("odd "), "event_type")), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", tf.error_language(t).alias("language"))


@query("SELECT page_id, 'a/b' || regexp_replace(regexp_replace(url, '^https?:', ''), '/+', '/', 'g') AS path FROM pages", graph=False)
def x10_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tf.normalised_path(F.concat(F.lit("C:\\.//a\\b"), F.regexp_replace("url", "^https?:", ""))).alias("path"))


@query("SELECT external_id, CASE WHEN contains(lower(label), 'customer') THEN 'concept ' || label || ' is part of the system' ELSE 'concept ' || label || ' is part of ' || coalesce(tags[1], 'the system') END AS summary FROM nodes WHERE node_type IN (12, 100)")
def x10_intents(spark, sf_dir):
    n = full_graph(spark, sf_dir).nodes.where("node_type IN (12, 100)")
    return n.select("external_id", tf.intent_summary(F.col("label"), F.lit("concept"), F.col("tags")).alias("summary"))


@query(
    "WITH o AS (SELECT o_custkey AS c, list_distinct(list(o_orderpriority)) AS types, list_distinct(list(o_orderstatus)) AS relations, count(*) AS size, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'P')) AS absent FROM orders GROUP BY 1), "
    "j AS (SELECT x.c AS a, y.c AS b, x.size AS sa, y.size AS sb, len(list_intersect(x.types, y.types))::DOUBLE AS ti, len(list_distinct(x.types || y.types)) AS tu, len(list_intersect(x.relations, y.relations))::DOUBLE AS ri, len(list_distinct(x.relations || y.relations)) AS ru, "
    "len(list_intersect(coalesce(x.absent, []), coalesce(y.absent, [])))::DOUBLE AS ai, len(list_distinct(coalesce(x.absent, []) || coalesce(y.absent, []))) AS au FROM o x JOIN o y ON y.c = x.c + 1 OR y.c = x.c + 3) "
    "SELECT a, b, round(0.4::DOUBLE * ti / tu + 0.3::DOUBLE * ri / ru + 0.2::DOUBLE * least(sa, sb) / greatest(sa, sb) + 0.1::DOUBLE * CASE WHEN au = 0 THEN 1 ELSE ai / au END, 6) AS similarity FROM j", graph=False
)
def u8_pattern_similarity(spark, sf_dir):
    """Each customer's orders as a pattern, against the next customer's and the third one's."""
    o = table(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_custkey").alias("c")).agg(
        F.collect_set("o_orderpriority").alias("types"), F.collect_set("o_orderstatus").alias("relations"), F.count(F.lit(1)).alias("size"), F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("absent")
    ).select("c", F.struct("types", "relations", "size", "absent").alias("p"))
    x = p.select(F.col("c").alias("x"), F.col("p").alias("a"), F.explode(F.array(F.col("c") + 1, F.col("c") + 3)).alias("y"))
    pairs = x.join(p.select(F.col("c").alias("y"), F.col("p").alias("b")), "y")
    return matching.pattern_similarities(pairs).select(F.col("x").alias("a"), F.col("y").alias("b"), r6("similarity").alias("similarity"))


_OUTSIDE = r"""(?:^|[\s"'(])((?:/[\w.-]+){2,}|[A-Z]:\\[\w\\.-]+|~/[\w/.-]+)"""


@query(
    "WITH t AS (SELECT doc_id AS k, text FROM documents UNION ALL SELECT -p_partkey, 'see /opt/data/x' || p_partkey || '.py, \"/repo/a/b' || p_partkey || '.rs\" (~/n/' || p_size || ') C:\\w\\x' || p_partkey || ' and /one http://a/b/c' FROM part), "
    "f AS (SELECT DISTINCT k, unnest(regexp_extract_all(text, '" + _OUTSIDE.replace("'", "''") + "', 1)) AS reference FROM t) SELECT k, reference FROM f WHERE NOT starts_with(reference, '/repo') AND NOT starts_with(reference, '~/n/1')", graph=False
)
def g68_external_references(spark, sf_dir):
    """Paths outside two known roots in every document, and in a note about each part."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    note = F.concat(F.lit("see /opt/data/x"), k, F.lit('.py, "/repo/a/b'), k, F.lit('.rs" (~/n/'), size, F.lit(") C:\\w\\x"), k, F.lit(" and /one http://a/b/c"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text").unionByName(p.select((-F.col("p_partkey")).alias("k"), note.alias("text")))
    return documents.external_references(docs, "k", "text", ["/repo", "~/n/1"])


@query("WITH t AS (SELECT 'nation::' || n_nationkey AS target FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT c_custkey::VARCHAR FROM customer UNION ALL SELECT 'none such'), f AS (SELECT target, external_id, 0 AS tier FROM t JOIN spine_nodes ON external_id = target UNION ALL SELECT target, external_id, 1 FROM t JOIN spine_nodes ON lower(label) = lower(target) UNION ALL SELECT target, external_id, 2 FROM t JOIN spine_nodes ON split_part(external_id, '::', 2) = lower(target) OR split_part(external_id, '::', 1) = lower(target)) SELECT target, external_id, tier FROM f QUALIFY row_number() OVER (PARTITION BY target ORDER BY tier, external_id) = 1")
def f14_lock_roots(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    t = n.select(F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string")).alias("target")).union(n.select(F.lower("n_name"))).union(c.select(F.col("c_custkey").cast("string"))).union(spark.createDataFrame([("none such",)], "t string"))
    return reports.resolve_roots(spine_graph(spark, sf_dir).nodes, t)


@query(f"WITH p1 AS (SELECT dst, weight AS s FROM edges WHERE src = {id_of('region::1')} AND weight >= 0.1), p2 AS (SELECT e.dst, p1.s * weight AS s FROM p1 JOIN edges e ON src = p1.dst WHERE p1.s * weight >= 0.1) SELECT 1::BIGINT AS hops, CAST(count(*) AS BIGINT) AS n, round(sum(s), 6) AS strength FROM p1 UNION ALL SELECT 2, CAST(count(*) AS BIGINT), round(sum(s), 6) FROM p2")
def g17_bounded_paths(spark, sf_dir):
    p = traversal.bounded_paths(full_graph(spark, sf_dir).finalised(), "region::1", 2, "weight")
    return p.groupBy(F.col("hops").cast("long").alias("hops")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("strength")).alias("strength"))


@query(f"WITH {wave_sql(2)} SELECT external_id, round(act, 6) AS activation FROM s2 JOIN nodes USING (node_id) WHERE act > 0")
def g3_g4_hybrid_activation(spark, sf_dir):
    """Best-first and hybrid activation approximate the wavefront in an order of one process; here they are the wavefront itself."""
    g = full_graph(spark, sf_dir).finalised()
    return g.named(activation.wavefront(g, g.seeds(SEEDS), 2), "external_id").select("external_id", r6("activation").alias("activation"))


@query(
    f"WITH c1 AS (SELECT dst AS tip, causal_strength AS s FROM spine_edges WHERE src = {id_of('region::2')}), c2 AS (SELECT dst AS tip, s * causal_strength AS s FROM c1 JOIN spine_edges ON src = tip), b AS (SELECT * FROM (SELECT dst, weight * 0.285::DOUBLE AS s FROM spine_edges WHERE src = {id_of('region::2')} UNION ALL SELECT e.dst, 0.285::DOUBLE * 0.285::DOUBLE FROM spine_edges a JOIN spine_edges e ON e.src = a.dst WHERE a.src = {id_of('region::2')}) ORDER BY s DESC, dst LIMIT 10) "
    "SELECT 'causal_chains' AS section, CAST((SELECT count(*) FROM c1) + (SELECT count(*) FROM c2) AS BIGINT) AS n, 0.8::DOUBLE AS strongest UNION ALL SELECT 'co_change', CAST(count(*) AS BIGINT), round(max(s), 6) FROM b UNION ALL SELECT 'decay', 1, 0.000001 UNION ALL SELECT 'impact_forward', CAST((SELECT count(*) FROM c1) + (SELECT count(*) FROM c2) AS BIGINT), 0.55 UNION ALL SELECT 'impact_reverse', 0, NULL"
)
def g47_temporal_report(spark, sf_dir):
    g = spine_graph(spark, sf_dir)
    return reports.temporal_report(g, "region::2", 1.7e9, spread.bootstrap_co_change(g, 2)).withColumn("strongest", r6("strongest"))


@query("WITH own AS (SELECT node_id, node_type, label FROM nodes WHERE external_id IN ('part::1', 'part::2', 'supplier::1', 'customer::1')), s AS (SELECT DISTINCT node_id, node_type, seg FROM (SELECT node_id, node_type, unnest(regexp_split_to_array(lower(label), '[\\s_#./:\\-]+')) AS seg FROM own) WHERE length(seg) >= 3), m AS (SELECT seg, count(*) AS n FROM (SELECT DISTINCT seg FROM s) JOIN nodes ON contains(lower(label), seg) GROUP BY seg) SELECT node_id, node_type, seg AS segment, CAST(n AS BIGINT) AS matches FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n, length(seg) DESC, seg) AS r FROM s JOIN m USING (seg)) WHERE r = 1 AND n <= 0.6 * (SELECT count(*) FROM nodes)")
def g58_antibody_extraction(spark, sf_dir):
    g = full_graph(spark, sf_dir)
    return reports.extract_antibody(g, g.seeds(["part::1", "part::2", "supplier::1", "customer::1"]))[0]


# --- streams ------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("WITH r AS (SELECT user_id AS key, value, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS n FROM events) SELECT key, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_delta FROM r WHERE n <= 16 GROUP BY key", graph=False)
def r5_observation_ring(spark, sf_dir):
    o = _events(spark, sf_dir).select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("delta"))
    return _drained(spark, stateful.observation_ring(o, 16), "update", ["key"]).select("key", "n", r6("mean_delta").alias("mean_delta"))


@query("SELECT event_type AS node, round(least(sum(ln(1 + 1 + event_id % 3) * (1 + user_id / 1e6::DOUBLE)), 1e9), 3) AS heat, CAST(sum(1 + event_id % 3) AS BIGINT) AS invocations FROM events GROUP BY event_type", graph=False)
def r7_span_heat(spark, sf_dir):
    s = _events(spark, sf_dir).select(F.col("event_type").alias("node"), (F.col("event_id") % 3 + 1).alias("count"), F.col("user_id").alias("duration_us"))
    return _drained(spark, stateful.span_heat(s, most=1e9), "update", ["node"]).select("node", F.round("heat", 3).alias("heat"), "invocations")


@query("SELECT o_orderkey AS seq FROM orders ORDER BY o_orderkey DESC LIMIT 1000", graph=False)
def r9_query_memory(spark, sf_dir):
    return ledgers.query_memory(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq")))


@query("SELECT user_id::VARCHAR AS path, CAST(count(*) AS BIGINT) AS bursts FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 1 HOUR GROUP BY user_id", graph=False)
def r3_coalesced_changes(spark, sf_dir):
    """Changes of a path within an hour of each other are one burst."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.coalesced_changes(e, "1 hour").groupBy("path").agg(F.count(F.lit(1)).alias("bursts"))


@query(
    "WITH e AS (SELECT user_id::VARCHAR AS path, event_type AS kind, epoch_us(ts) // 1000 AS ms FROM events), l AS (SELECT *, lag(ms) OVER (PARTITION BY path ORDER BY ms, kind) AS p FROM e), b AS (SELECT *, sum(CASE WHEN p IS NULL OR ms - p >= 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ms, kind ROWS UNBOUNDED PRECEDING) AS burst FROM l) "
    "SELECT path, arg_max(kind, (ms, kind)) AS kind, min(ms) AS first_ms, max(ms) AS last_ms, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY path, burst", graph=False
)
def r3_burst_timers(spark, sf_dir):
    """Bursts of changes in keyed state: each is closed by its path's next one, or by a timer when nothing more comes.

    The clock's own change, days after all others in a file of its own, moves the watermark past the last timers.
    """
    at = _folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{at}/0")
    e.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select(F.lit("clock").alias("path"), F.lit("tick").alias("kind"), "ts").write.parquet(f"{at}/1")
    changes = spark.readStream.schema(e.schema).parquet(f"{at}/0").unionByName(spark.readStream.schema(e.schema).parquet(f"{at}/1"))
    return _drained(spark, stateful.bursts(changes, 3_600_000, "1 hour"), "append").where("path <> 'clock'")


@query("SELECT o_orderkey::VARCHAR AS path, o_totalprice AS size FROM orders", graph=False)
def r1_auto_ingest(spark, sf_dir):
    """Files found by a stream, upserted once each; the state as its readers see it."""
    at = _folder(spark)
    o = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    rows = o.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("size"), F.lit(1.0).alias("mtime"), F.lit("").alias("hash"))
    streams.ingest_stream(rows, f"{at}/state", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return streams.ingested(spark, f"{at}/state").select("path", "size")
