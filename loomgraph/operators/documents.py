"""Canonical documents: sections, blocks, tables, links, citations, entities, claims, and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.formats import numbered_lines


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, level, section, line) of every line that is not blank."""
    lines = numbered_lines(docs, key, text)
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    fence = F.col("line").rlike(r"^\s*```")
    pipes = F.length("line") - F.length(F.replace(F.col("line"), F.lit("|")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"level": level, "fences": F.sum(fence.cast("int")).over(w), "section": F.last(F.when(level > 0, F.trim(F.regexp_replace("line", r"^#+\s*", ""))), True).over(w)})
    kind = (
        F.when(fence | (F.col("fences") % 2 == 1), "code").when(F.col("level") > 0, "heading").when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+\.)\s"), "list").when(F.col("line").rlike(r"^\s*>"), "quote")
        .when(pipes >= 2, "table").otherwise("paragraph")
    )
    return rows.where(F.trim("line") != "").select(key, "line_no", kind.alias("kind"), "level", "section", "line")


def links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, target): links, DOIs, code references and capitalised terms, once for each document."""
    forms = (("link", r"\[[^\]]*\]\(([^)\s]+)\)"), ("doi", r"\b(10\.\d{4,9}/[^\s\"<>)]+)"), ("code", r"`([^`\n]+)`"), ("entity", r"(?<![\p{L}\p{N}_])([A-Z][A-Za-z]{3,})(?![\p{L}\p{N}_])"))

    def targets(kind: str, pattern: str):
        return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    found = F.flatten(F.array(*[targets(*form) for form in forms]))
    return docs.select(key, F.explode(found).alias("f")).select(key, "f.kind", "f.target")


def claims(docs: DataFrame, key: str, text: str, longer_than: int = 20) -> DataFrame:
    """(key, line_no, modality, negated, subject, object) of lines that end a sentence."""
    rows = numbered_lines(docs, key, text).where(F.rtrim("line").endswith(".") & (F.length("line") > longer_than))
    low = F.concat(F.lit(" "), F.lower("line"), F.lit(" "))
    modality = F.when(low.contains(" must "), "must").when(low.contains(" should "), "should").when(low.contains(" may "), "may").when(low.contains(" is "), "is").otherwise("none")
    rows = rows.withColumns({"modality": modality, "negated": low.contains(" not ") | low.contains(" no ")})
    parts = F.split("line", r"(?i)\b(?:must|should|may|is)\b", 2)
    has = F.col("modality") != "none"
    return rows.select(key, "line_no", "modality", "negated", F.when(has, F.trim(F.get(parts, F.lit(0)))).otherwise("").alias("subject"), F.when(has, F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise("").alias("object"))


def drift(bound: DataFrame, current: DataFrame) -> DataFrame:
    """Counts by finding: missing_target, moved, changed, unbound, ok. ``bound``: source, target, hash; ``current``: target, hash."""
    j = bound.join(current.withColumnRenamed("hash", "now"), "target", "left")
    kind = F.when(F.col("target").isNull(), "unbound").when(F.col("now").isNull(), "missing_target").when(F.col("hash") != F.col("now"), "changed").otherwise("ok")
    return j.groupBy(kind.alias("finding")).agg(F.count(F.lit(1)).alias("n"))


def cross_verify(graph: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, finding) where graph and disk disagree: existence, lines or hash."""
    j = graph.select("path", F.col("loc").alias("gl"), F.col("hash").alias("gh"), F.lit(1).alias("g")).join(disk.select("path", F.col("loc").alias("dl"), F.col("hash").alias("dh"), F.lit(1).alias("d")), "path", "full_outer")
    kind = F.when(F.col("g").isNull(), "missing_from_graph").when(F.col("d").isNull(), "missing_from_disk").when(F.col("gh") != F.col("dh"), F.when(F.col("gl") != F.col("dl"), "loc_mismatch").otherwise("hash_mismatch"))
    return j.select("path", kind.alias("finding")).where("finding IS NOT NULL")


def external_references(docs: DataFrame, key: str, text: str, roots: list[str]) -> DataFrame:
    """(key, reference): absolute paths outside the known roots."""
    found = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?:^|[\s\"'(])((?:/[\w.-]+){2,}|[A-Z]:\\[\w\\.-]+|~/[\w/.-]+)"), F.lit(1)))).alias("reference"))
    for r in roots:
        found = found.where(~F.col("reference").startswith(r))
    return found


def grade(ratio):
    """A to F of a share of findings."""
    return F.when(ratio <= 0.05, "A").when(ratio <= 0.15, "B").when(ratio <= 0.30, "C").when(ratio <= 0.50, "D").otherwise("F")
