"""Sources: descriptors, notes, code, BibTeX, XML and JSON bibliographies, commit logs, spans, snapshots.

Each reader gives ``nodes(external_id, label, node_type, tags)`` and
``edges(src, dst, relation, weight, causal_strength)`` by external id, or plain
rows where the source is a ledger.  Files are read by Spark's readers, so any
store that Spark reads will do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.durable import stored
from loomgraph.sources import scopes
from loomgraph.sources.lexical import strip_comments as strip_comments

#: Node types of descriptors, and causal strengths by relation.
TYPES = {"file": 0, "directory": 1, "function": 2, "class": 3, "struct": 4, "enum": 5, "type": 6, "module": 7, "reference": 8, "concept": 9, "material": 10, "process": 11, "product": 12, "supplier": 13, "regulatory": 14, "system": 15, "cost": 16}
CAUSAL = {"contains": 0.8, "implements": 0.7, "imports": 0.6, "depends_on": 0.6, "calls": 0.5, "routes_to": 0.5, "references": 0.3}
#: Names never walked into, and files that are not sources.
SKIPPED_DIRS = (".git", "node_modules", "target", "__pycache__", "dist", "build", ".venv", "vendor")
LOCKFILES = ("package-lock.json", "yarn.lock", "Cargo.lock", "poetry.lock", "pnpm-lock.yaml")


def _mapped(c: Column, table: dict, other) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(other))


def code_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, text) of the text files below a root; hidden, vendored and binary files are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    root = re.sub(r"^[a-z]+:/*", "/", root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.lit("^/*" + root.strip("/") + "/?"), F.lit(""))
    f = f.withColumn("rel", F.regexp_replace(rel, "^/+", ""))
    for d in SKIPPED_DIRS:
        f = f.where(~F.concat(F.lit("/"), "rel").contains(f"/{d}/"))
    name = F.element_at(F.split("rel", "/"), -1)
    binary = F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00")  # a zero byte, not two halves of its neighbours
    f = f.where(~name.startswith(".") & ~name.isin(*LOCKFILES) & ~binary)
    return f.select(F.col("rel").alias("path"), "length", F.unix_timestamp("modificationTime").cast("double").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def json_descriptor(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``{nodes: [{id, label, type, tags}], edges: [{source, target, relation, weight}]}`` documents."""
    shape = "nodes array<struct<id: string, label: string, type: string, tags: array<string>>>, edges array<struct<source: string, target: string, relation: string, weight: double>>"
    return _descriptor(spark.read.schema(shape).option("multiLine", True).json(path))


def descriptor_rows(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The same for documents that are already rows."""
    shape = "nodes array<struct<id: string, label: string, type: string, tags: array<string>>>, edges array<struct<source: string, target: string, relation: string, weight: double>>"
    return _descriptor(docs.select(F.from_json(text, shape).alias("d")).select("d.*"))


def _descriptor(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = d.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = n.select(F.col("id").alias("external_id"), F.coalesce("label", "id").alias("label"), _mapped(F.lower("type"), TYPES, 100).alias("node_type"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    e = d.select(F.explode("edges").alias("e")).select("e.*").withColumn("relation", F.coalesce("relation", F.lit("relates_to")))
    edges = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation", F.coalesce("weight", F.lit(1.0)).alias("weight"), _mapped(F.col("relation"), CAUSAL, 0.4).alias("causal_strength"), (F.col("relation") == "contains").cast("int").alias("direction"))
    return nodes.dropDuplicates(["external_id"]), edges


def numbered_lines(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def extract_code(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions, containment, imports, bases, calls, references and routes of code files (path, text; a path once).

    nodes: external_id, label, node_type, line_start, line_end; edges: src, dst,
    relation, weight, line, with ``ref::`` targets.  Every file is scanned once,
    inside its own row (:mod:`scopes`), and what was found is written.
    """
    found = stored(scopes.scanned(files.where("path IS NOT NULL")), "code-scopes")
    nodes = found.where("relation IS NULL").select(F.col("src").alias("external_id"), "label", "node_type", "line_start", "line_end")
    return nodes, found.where("relation IS NOT NULL").select("src", "dst", "relation", "weight", F.col("line_start").alias("line"))


def notes(docs: DataFrame, key: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Markdown notes: sections and classified entries with the relation that their words suggest."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = numbered_lines(docs, key, text)
    heading = F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.*\S)", 1), F.lit(""))
    entry = F.nullif(F.regexp_extract("line", r"^\s*(?:[-*+]|\d+\.)\s+(.*\S)", 1), F.lit(""))
    rows = lines.withColumns({"heading": heading, "entry": entry}).withColumn("section", F.last("heading", True).over(w))
    low = F.lower("entry")
    kind = F.when(low.rlike("todo|track|pending|next"), "tracks").when(low.rlike("decid|chose|agreed"), "decided").when(low.rlike(r"\d{4}-\d{2}-\d{2}"), "happened_on").otherwise("relates_to")
    section_id = F.concat(F.lit("note::"), key, F.lit("::"), F.coalesce("section", F.lit("")))
    entries = rows.where("entry IS NOT NULL").select(section_id.alias("src"), F.concat(F.lit("entry::"), F.md5("entry")).alias("dst"), kind.alias("relation"), F.col("entry").alias("label"))
    sections = rows.where("heading IS NOT NULL").select(section_id.alias("external_id"), F.col("heading").alias("label"), F.lit(9).alias("node_type"))
    nodes = sections.unionByName(entries.select(F.col("dst").alias("external_id"), "label", F.lit(9).alias("node_type"))).dropDuplicates(["external_id"])
    return nodes, entries.select("src", "dst", "relation", F.lit(0.6).alias("weight")).distinct()


#: Markers of graph-native notes and the relations they declare.
LIGHT_MARKERS = {"entity": "declares_entity", "state": "has_state", "event": "declares_event", "depends": "declares_dependency", "binds": "binds_to", "test": "declares_test", "risk": "declares_risk", "flow": "declares_flow", "metric": "has_metric", "owner": "has_owner"}


def light(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(src, dst, relation) of ``[marker: value]`` declarations in graph-native notes."""
    found = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\s*\w+\s*:[^\]]+\]"), F.lit(0))).alias("m"))
    marker = F.lower(F.regexp_extract("m", r"\[\s*(\w+)", 1))
    return found.select(F.concat(F.lit("light::"), key).alias("src"), F.trim(F.regexp_extract("m", r":\s*([^\]]+)\]", 1)).alias("dst"), _mapped(marker, LIGHT_MARKERS, "").alias("relation")).where("relation <> ''").distinct()


def bibtex(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Entries, authors and venues: ``authored_by`` and ``published_in``."""
    e = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)@\w+\s*\{.*?\n\}"), F.lit(0))).alias("e"))
    value = lambda k: F.trim(F.regexp_replace(F.coalesce(*[F.nullif(F.regexp_extract("e", rf"(?is)\b{k}\s*=\s*{q}", 1), F.lit("")) for q in (r"\{((?:[^{}]|\{[^{}]*\})*)\}", r'"([^"]*)"', r"(\d+)")], F.lit("")), r"[{}\s]+", " "))
    rows = e.select(F.concat(F.lit("bib::"), F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1)).alias("id"), value("title").alias("title"), value("author").alias("author"), F.lower(value("doi")).alias("doi"), F.coalesce(F.nullif(value("journal"), F.lit("")), value("booktitle")).alias("venue"))
    people = rows.select("id", F.explode(F.split("author", r"\s+and\s+")).alias("name")).where("name <> ''")
    nodes = rows.select(F.col("id").alias("external_id"), F.col("title").alias("label"), F.lit(0).alias("node_type"), "doi").unionByName(
        people.select(F.concat(F.lit("author::"), F.lower("name")), "name", F.lit(9), F.lit("")).toDF("external_id", "label", "node_type", "doi")
    ).unionByName(rows.where("venue <> ''").select(F.concat(F.lit("venue::"), F.lower("venue")), "venue", F.lit(9), F.lit("")).toDF("external_id", "label", "node_type", "doi"))
    edges = people.select(F.col("id").alias("src"), F.concat(F.lit("author::"), F.lower("name")).alias("dst"), F.lit("authored_by").alias("relation")).unionByName(rows.where("venue <> ''").select(F.col("id").alias("src"), F.concat(F.lit("venue::"), F.lower("venue")).alias("dst"), F.lit("published_in").alias("relation")))
    return nodes.dropDuplicates(["external_id"]), edges.distinct()


def crossref(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Works of a registry's JSON: authors, container and cited DOIs."""
    shape = "message struct<DOI: string, title: array<string>, author: array<struct<given: string, family: string, ORCID: string>>, `container-title`: array<string>, reference: array<struct<DOI: string, unstructured: string>>>"
    return _works(spark.read.schema(shape).option("multiLine", True).json(path).select("message.*"))


def crossref_rows(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The same for documents that are already rows."""
    shape = "message struct<DOI: string, title: array<string>, author: array<struct<given: string, family: string, ORCID: string>>, `container-title`: array<string>, reference: array<struct<DOI: string, unstructured: string>>>"
    return _works(docs.select(F.from_json(text, shape).alias("d")).select("d.message.*"))


def _works(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    me = F.concat(F.lit("doi::"), F.lower("DOI"))
    a = m.select(me.alias("src"), F.explode("author").alias("a")).select("src", F.concat(F.lit("author::"), F.lower(F.concat_ws(" ", "a.given", "a.family"))).alias("dst"), F.lit("authored_by").alias("relation"))
    c = m.select(me.alias("src"), F.explode("container-title").alias("c")).select("src", F.concat(F.lit("venue::"), F.lower("c")).alias("dst"), F.lit("published_in").alias("relation"))
    r = m.select(me.alias("src"), F.explode("reference").alias("r")).where("r.DOI IS NOT NULL").select("src", F.concat(F.lit("doi::"), F.lower("r.DOI")).alias("dst"), F.lit("cites").alias("relation"))
    nodes = m.select(me.alias("external_id"), F.get("title", F.lit(0)).alias("label"), F.lit(0).alias("node_type"))
    return nodes, a.unionByName(c).unionByName(r).distinct()


def _texts(xml: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))


def _attributes(xml: Column, tag: str, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}\b[^>]*\b{name}\s*=\s*\"([^\"]*)\""), F.lit(1))


#: XML dialects: record element, how to name a record, and list-valued relations.
XML_DIALECTS = {
    "jats": ("article", lambda x: F.concat(F.lit("doi::"), F.lower(F.get(F.regexp_extract_all(x, F.lit(r'(?is)<article-id[^>]*pub-id-type="doi"[^>]*>(.*?)</article-id>'), F.lit(1)), F.lit(0)))), "article-title",
             {"authored_by": lambda x: _texts(x, "surname"), "published_in": lambda x: _texts(x, "journal-title"), "cites": lambda x: F.regexp_extract_all(x, F.lit(r'(?is)<pub-id[^>]*pub-id-type="doi"[^>]*>(.*?)</pub-id>'), F.lit(1))}),
    "patent": ("us-patent-grant", lambda x: F.concat(F.lit("patent::"), F.get(_texts(x, "doc-number"), F.lit(0))), "invention-title",
               {"cites": lambda x: F.slice(_texts(x, "doc-number"), 2, 10_000), "assigned_to": lambda x: _texts(x, "orgname"), "classified_as": lambda x: _texts(x, "main-classification")}),
    "rfc": ("rfc", lambda x: F.concat(F.lit("rfc::"), F.get(_attributes(x, "rfc", "number"), F.lit(0))), "title",
            {"authored_by": lambda x: _attributes(x, "author", "fullname"), "references": lambda x: _attributes(x, "reference", "anchor"), "obsoletes": lambda x: F.split(F.coalesce(F.get(_attributes(x, "rfc", "obsoletes"), F.lit(0)), F.lit("")), r",\s*"), "updates": lambda x: F.split(F.coalesce(F.get(_attributes(x, "rfc", "updates"), F.lit(0)), F.lit("")), r",\s*")}),
}


def xml_records(docs: DataFrame, dialect: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Records of an XML dialect (``jats``, ``patent``, ``rfc``), several in a file allowed: nodes and relations."""
    tag, identify, title, relations = XML_DIALECTS[dialect]
    x = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"(?is)<{tag}\b.*?</{tag}>"), F.lit(0))).alias("x"))
    rows = x.select("x", identify(F.col("x")).alias("id"), F.get(_texts(F.col("x"), title), F.lit(0)).alias("label"))
    edges = None
    for relation, values in relations.items():
        one = rows.select(F.col("id").alias("src"), F.explode(values(F.col("x"))).alias("dst")).where("dst <> ''").withColumn("relation", F.lit(relation))
        edges = one if edges is None else edges.unionByName(one)
    return rows.select(F.col("id").alias("external_id"), "label", F.lit(0).alias("node_type")), edges.distinct()


def commit_log(lines: DataFrame) -> DataFrame:
    """(commit, ts, author, file) of a log: ``hash|ts|author`` headers, then paths. ``lines``: source, line_no, value."""
    head = F.col("value").rlike(r"^[0-9a-f]{7,40}\|\d+\|")
    w = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("h", F.last(F.when(head, F.col("value")), True).over(w)).where(~head & (F.trim("value") != "") & F.col("h").isNotNull())
    p = F.split("h", r"\|")
    return rows.select(p[0].alias("commit"), p[1].cast("double").alias("ts"), p[2].alias("author"), F.trim("value").alias("file")).distinct()


def detect_format(path: Column, text: Column) -> Column:
    """The format of a document by extension, then by its beginning."""
    ext, head = F.lower(F.element_at(F.split(path, r"\."), -1)), F.lower(F.substring(text, 1, 2000))
    xml = F.when(head.contains("<rfc"), "rfc").when(head.contains("us-patent"), "patent").when(head.contains("<article"), "jats").otherwise("xml")
    return (
        F.when(ext == "bib", "bibtex").when(ext == "xml", xml).when((ext == "json") & head.contains('"doi"'), "crossref").when(ext == "json", "json")
        .when(ext.isin("md", "markdown") & head.rlike(r"\[\s*(entity|state|binds)\s*:"), "light").when(ext.isin("md", "markdown", "txt"), "notes").when(ext.isin("html", "htm"), "html").otherwise("code")
    )


def directory_format(files: DataFrame, most: int = 20, depth: int = 3) -> DataFrame:
    """One row: the most frequent format among a few files near the root."""
    near = files.where(F.size(F.split("path", "/")) <= depth).orderBy("path").limit(most)
    return near.groupBy(detect_format(F.col("path"), F.col("text")).alias("format")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("format", F.struct("n", "format")).alias("format"))


def cargo_workspace(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages of ``Cargo.toml`` files and their dependencies."""
    t = files.where(F.col("path").endswith("Cargo.toml")).select("path", "text", F.regexp_extract("text", r"(?s)\[package\].*?name\s*=\s*\"([^\"]+)\"", 1).alias("name")).where("name <> ''")
    deps = t.select("name", F.explode(F.split(F.regexp_extract("text", r"(?s)\[dependencies\]\n(.*?)(?:\n\[|$)", 1), "\n")).alias("l")).select("name", F.regexp_extract("l", r"^\s*([\w-]+)\s*=", 1).alias("dep")).where("dep <> ''")
    me = lambda c: F.concat(F.lit("crate::"), c)
    nodes = t.select(me("name").alias("external_id"), F.col("name").alias("label"), F.lit(7).alias("node_type"))
    edges = deps.select(me("name").alias("src"), me("dep").alias("dst"), F.lit("depends_on").alias("relation")).unionByName(t.select(me("name").alias("src"), F.concat(F.lit("file::"), "path").alias("dst"), F.lit("contains").alias("relation")))
    return nodes, edges


def span_batch(docs: DataFrame, text: str = "text") -> DataFrame:
    """(name, duration_us, count, is_error, parent, attributes) of batches ``[{name, duration_us, ...}]``; a span counts once unless it says more."""
    shape = "array<struct<name: string, duration_us: bigint, count: bigint, is_error: boolean, parent: string, attributes: map<string, string>>>"
    s = docs.select(F.explode(F.from_json(text, shape)).alias("s")).select("s.*")
    return s.select("name", F.coalesce("duration_us", F.lit(0)).alias("duration_us"), F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("is_error", F.lit(False)).alias("is_error"), "parent", "attributes").where("name IS NOT NULL")


def with_attributes(docs: DataFrame, text: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``docs`` with a column for each wanted attribute of JSON texts of unknown shape.

    ``wanted``: column name to (path, type), as ``{"code": ("$.http.status", "int")}``.
    The text is parsed once into a variant; what is not there, is of another kind
    or stands in a broken text is null.
    """
    v = docs.withColumn("_v", F.try_parse_json(text))
    return v.select(*docs.columns, *[F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in wanted.items()])


def attribute_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, attribute, kind, value) of every top-level attribute of JSON objects of unknown shape; the value as JSON text."""
    spark = docs.sparkSession
    held = docs.select(F.col(key).alias("key"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    return spark.sql("SELECT d.key, a.key AS attribute, schema_of_variant(a.value) AS kind, to_json(a.value) AS value FROM {d} d, LATERAL variant_explode(d.v) a", d=held)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a snapshot: nodes, then edges (a two-way edge once, src < dst), each committed atomically."""
    once = edges.where("NOT (direction = 1 AND src > dst)") if "direction" in edges.columns else edges
    nodes.write.mode("overwrite").format(form).save(f"{path}/nodes")
    once.write.mode("overwrite").format(form).save(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """A snapshot; edges without both ends are left out."""
    nodes, edges = spark.read.format(form).load(f"{path}/nodes"), spark.read.format(form).load(f"{path}/edges")
    ids = nodes.select("node_id")
    return nodes, edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def diagram(edges: DataFrame, form: str = "mermaid") -> DataFrame:
    """One row: a diagram of a bounded set of edges (src, dst, relation as names)."""
    if form == "dot":
        line = F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "relation")
        head, tail = "digraph g {\n", "\n}"
    else:
        line = F.format_string("  %s -->|%s| %s", "src", "relation", "dst")
        head, tail = "graph LR\n", ""
    lines = edges.select(line.alias("l"))
    return lines.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("l")), "\n"), F.lit(tail)).alias("diagram"))
