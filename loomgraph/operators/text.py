"""Search, seeds, trigram similarity, synonyms, patterns and predicates over labels and lines."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no meaning in a query.
STOPWORDS = frozenset("the and for with from that this into what where when how why are was were has have not but can all any its our you".split())
#: Groups of words that stand for one another.
SYNONYMS = (
    ("auth", "login", "session", "token"), ("db", "database", "storage", "store"), ("config", "settings", "options"), ("error", "exception", "failure"),
    ("test", "spec", "check"), ("cache", "memo", "buffer"), ("queue", "stream", "channel"), ("user", "account", "customer"), ("order", "purchase", "sale"),
    ("part", "item", "product"), ("supplier", "vendor", "provider"), ("region", "area", "zone"), ("nation", "country", "state"), ("parse", "decode", "read"), ("write", "save", "persist"),
)


def split_identifier(word: str) -> list[str]:
    """Parts of snake, kebab and camel case names."""
    return [p for p in re.split(r"[_\-./:]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", word) if p]


def query_tokens(text: str) -> list[str]:
    """Distinct lower-case tokens of a query and of its identifiers, in order; identifiers are split before the case is folded."""
    out: list[str] = []
    for raw in re.split(r"[\s,;()\[\]{}]+", text):
        raw = raw.strip("'\"`.?!")
        for t in [raw, *split_identifier(raw)]:
            t = t.lower()
            if len(t) > 2 and t not in STOPWORDS and t not in out:
                out.append(t)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_of(text: pd.Series) -> pd.Series:
    """:func:`query_tokens` of a column of queries; a null query has none."""
    return text.map(lambda t: query_tokens(t or ""))


def trigrams(text: Column) -> Column:
    """All character trigrams of a text, in order."""
    n = F.length(text) - 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Trigrams of ``a`` that ``b`` has, over the geometric mean of both counts."""
    ta, tb = trigrams(a), trigrams(b)
    hit = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), hit / F.sqrt(F.size(ta) * F.size(tb).cast("double"))).otherwise(0.0)


def token_score(label: Column, tags: Column, token: str) -> Column:
    """How well one token meets a label or its tags: exact, prefix, part, inside, tag, trigram."""
    low, t = F.lower(label), F.lit(token)
    parts = F.split(low, r"[_\-./: #]+")
    tag = F.transform(tags, F.lower)
    similar = trigram_similarity(t, low)
    return (
        F.when(low == t, 1.0).when(F.array_contains(parts, t), 0.92).when(low.startswith(token) | t.startswith(low), 0.9).when(F.array_contains(tag, t), 0.85)
        .when(low.contains(token) | F.exists(tag, lambda x: x.contains(t)), 0.8).when(similar > 0.3, 0.7 * similar).otherwise(0.0)
    )


def find_seeds(nodes: DataFrame, query: str, most: int | None = 200, least: float = 0.1, bias: Column | None = None) -> DataFrame:
    """(node_id, score): 0.5 mean + 0.35 coverage + 0.15 best over the query's tokens; all exact is 1. ``most`` None: all, in no order."""
    tokens = query_tokens(query)
    if not tokens:
        return nodes.select("node_id", F.lit(0.0).alias("score")).limit(0)
    s = F.array(*[token_score(F.col("label"), F.col("tags"), t) for t in tokens])
    k = float(len(tokens))
    rows = nodes.select("node_id", s.alias("s"), (bias if bias is not None else F.lit(0.0)).alias("bias"))
    hit = F.size(F.filter("s", lambda x: x > 0))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / k
    mixed = F.least(F.greatest(0.5 * mean + 0.35 * (hit / k) + 0.15 * F.array_max("s") + F.col("bias"), F.lit(0.0)), F.lit(1.0))
    score = F.when(F.forall("s", lambda x: x == 1.0), 1.0).when(hit > 0, mixed).otherwise(F.greatest(F.col("bias"), F.lit(0.0)))
    found = rows.select("node_id", score.alias("score")).where(F.col("score") >= least)
    return found if most is None else found.orderBy(F.desc("score"), "node_id").limit(most)


def blend_seeds(basic: DataFrame, semantic: DataFrame) -> DataFrame:
    """0.6 of the basic and 0.4 of the semantic score."""
    j = basic.join(semantic.select("node_id", F.col("score").alias("s2")), "node_id", "left")
    return j.select("node_id", (0.6 * F.col("score") + 0.4 * F.coalesce("s2", F.lit(0.0))).alias("score"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key, tf) over whole texts."""
    grams = docs.select(key, F.explode(trigrams(F.lower(F.col(text)))).alias("gram"))
    return grams.groupBy("gram", key).agg(F.count(F.lit(1)).cast("double").alias("tf"))


def tfidf_query(docs: DataFrame, key: str, text: str, query: str, least: float = 0.01, top: int | None = None) -> DataFrame:
    """(key, cosine) of character-trigram TF-IDF vectors; idf = ln(N / df) + 1."""
    p = postings(docs, key, text)
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = p.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("gram", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))
    w = p.join(df, "gram").select("gram", key, (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = [query.lower()[i : i + 3] for i in range(len(query) - 2)]
    counts = {g: float(q.count(g)) for g in q}
    spark = docs.sparkSession
    qt = spark.createDataFrame(list(counts.items()) or [("", 0.0)], "gram string, qtf double")
    qw = df.join(F.broadcast(qt), "gram").select("gram", (F.col("qtf") * F.col("idf")).alias("qw"))
    qn = qw.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = w.join(F.broadcast(qw), "gram").groupBy(key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    out = dot.join(norm, key).crossJoin(F.broadcast(qn)).select(key, (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("cosine")).where(F.col("cosine") > least)
    return out.orderBy(F.desc("cosine"), key).limit(top) if top else out


def synonym_boost(label: Column, query: str, boost: float = 0.2) -> Column:
    """The boost where the label has a synonym of a query token."""
    tokens = set(query_tokens(query))
    words = sorted({w for group in SYNONYMS if tokens & set(group) for w in group} - tokens)
    low = F.lower(label)
    return F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), boost).otherwise(0.0) if words else F.lit(0.0)


def seek(nodes: DataFrame, query: str, pagerank: DataFrame, top: int = 20, least: float = 0.1) -> DataFrame:
    """0.4 keyword + 0.3 semantic + 0.2 PageRank + 0.1 trigram, ties by PageRank then id: (external_id, score)."""
    keyword = find_seeds(nodes, query, None, 0.0).withColumnRenamed("score", "keyword")
    semantic = tfidf_query(nodes, "node_id", "label", query).withColumnRenamed("cosine", "semantic")
    j = nodes.select("node_id", "external_id", "label").join(keyword, "node_id", "left").join(semantic, "node_id", "left").join(pagerank, "node_id", "left").na.fill(0.0, ["keyword", "semantic", "pagerank"])
    score = 0.4 * F.col("keyword") + 0.3 * F.col("semantic") + 0.2 * F.col("pagerank") + 0.1 * trigram_similarity(F.lit(query.lower()), F.lower("label")) + synonym_boost(F.col("label"), query)
    return j.select("external_id", score.alias("score"), "pagerank").where(F.col("score") >= least).orderBy(F.desc(F.round("score", 9)), F.desc(F.round("pagerank", 9)), "external_id").limit(top)


def search_semantic(nodes: DataFrame, query: str, top: int = 20) -> DataFrame:
    """(external_id, node_id, score): nodes by the trigram cosine of their labels with a query."""
    found = tfidf_query(nodes, "node_id", "label", query).withColumnRenamed("cosine", "score")
    return nodes.select("node_id", "external_id").join(found, "node_id").orderBy(F.desc(F.round("score", 9)), "node_id").limit(top)


def semantic_query(nodes: DataFrame, query: str, strengths: DataFrame, top: int = 20, fast: bool = False) -> DataFrame:
    """(node_id, score): trigram cosine, co-occurrence with the best hits, and synonyms, 0.4 / 0.4 / 0.2.

    ``strengths``: (a, b, strength) of co-occurring nodes.  ``fast``: the first
    ``3 top`` nodes by cosine are candidates, re-ranked by cosine and the mean
    co-occurrence with the three best of them, half each.
    """
    base = tfidf_query(nodes, "node_id", "label", query).withColumnRenamed("cosine", "ngram")
    order = [F.desc(F.round("ngram", 9)), F.col("node_id")]
    if fast:
        base = base.orderBy(*order).limit(3 * top)
    best = base.orderBy(*order).limit(3).select(F.col("node_id").alias("hit"))
    both = strengths.select("a", "b", "strength").unionByName(strengths.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength")).groupBy("a", "b").agg(F.max("strength").alias("strength"))
    near = both.join(F.broadcast(best), F.col("a") == F.col("hit")).groupBy(F.col("b").alias("node_id")).agg((F.sum("strength") / 3).alias("together"))  # three rows
    rows = base.join(near, "node_id", "left" if fast else "full_outer").na.fill(0.0, ["ngram", "together"]).join(nodes.select("node_id", "label"), "node_id")
    score = 0.5 * F.col("ngram") + 0.5 * F.col("together") if fast else 0.4 * F.col("ngram") + 0.4 * F.col("together") + 0.2 * F.when(synonym_boost(F.col("label"), query) > 0, 1.0).otherwise(0.0)
    return rows.select("node_id", score.alias("score")).where("score > 0").orderBy(F.desc(F.round("score", 9)), "node_id").limit(top)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): every line, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def search(docs: DataFrame, key: str, text: str, pattern: str, mode: str = "literal", case_sensitive: bool = False, invert: bool = False, context: int = 0, count_only: bool = False) -> DataFrame:
    """Lines that match (or, inverted, do not): (key, line_no, line[, before, after]), or one count.

    Context comes from the row's own line array, so no line is shuffled.
    """
    split = docs.select(key, F.split(F.col(text), "\n").alias("all"))
    rows = split.select(key, "all", F.posexplode("all").alias("i", "line"))
    subject = F.col("line") if case_sensitive else F.lower("line")
    wanted = pattern if case_sensitive else pattern.lower()
    hit = subject.contains(wanted) if mode == "literal" else F.col("line").rlike(pattern if case_sensitive else f"(?i){pattern}")
    found = rows.where(~hit if invert else hit)
    if count_only:
        return found.agg(F.count(F.lit(1)).alias("matches"))
    out = [key, (F.col("i") + 1).alias("line_no"), "line"]
    if context:
        c = min(context, 10)
        out.append(F.when(F.col("i") > 0, F.slice("all", F.greatest(F.col("i") - c + 1, F.lit(1)), F.least(F.col("i"), F.lit(c)))).otherwise(F.array().cast("array<string>")).alias("before"))
        out.append(F.slice("all", F.col("i") + 2, F.lit(c)).alias("after"))
    return found.select(*out)


def search_multiline(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n_matches) of a pattern that may span lines."""
    n = F.regexp_count(F.col(text), F.lit(f"(?ms){pattern}"))
    return docs.select(key, n.alias("n_matches")).where("n_matches > 0")


def rank_results(found: DataFrame, query: str, key: str = "path") -> DataFrame:
    """Search results (path, line_no, line, label) by their rank: content, token hits, label and path hits, position."""
    q, low, lab, path = query.lower(), F.lower("line"), F.lower("label"), F.lower(F.col(key))
    token = low.rlike(rf"(?<![a-z0-9_]){re.escape(q)}(?![a-z0-9_])")
    score = (
        F.lit(200) + F.when(token, 180).when(low.contains(q), 120).otherwise(0) + F.when((lab == q) | (path == q), 90).when(lab.contains(q) | path.contains(q), 45).otherwise(0)
        + F.when(F.col("line_no") > 1, 25).otherwise(0)
    )
    once = found.dropDuplicates([key, "line_no", "line"])
    return once.withColumn("rank", score).orderBy(F.desc("rank"), key, "line_no")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c in "[]" else re.escape(c))
        i += 1
    return f"^{out}$"


def glob(paths: DataFrame, column: str, pattern: str) -> DataFrame:
    return paths.where(F.col(column).rlike(glob_regex(pattern)))


def scan(nodes: DataFrame, column: str, keywords: list[str], negations: list[str]) -> DataFrame:
    """Rows whose text has a keyword and no negation."""
    low = F.lower(F.col(column))
    hit = reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords])
    no = reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in negations], F.lit(False))
    return nodes.where(hit & ~no)


def scan_all(nodes: DataFrame, column: str, catalogue: dict[str, tuple[list[str], list[str], float]]) -> DataFrame:
    """(pattern, severity, ...) of every pattern in one pass over the rows."""
    low = F.lower(F.col(column))
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words], F.lit(False))
    found = F.array(*[F.when(any_of(k) & ~any_of(n), F.struct(F.lit(name).alias("pattern"), F.lit(float(s)).alias("severity"))) for name, (k, n, s) in sorted(catalogue.items())])
    return nodes.withColumn("_f", F.explode(F.filter(found, lambda x: x.isNotNull()))).select("*", "_f.pattern", "_f.severity").drop("_f")


def validate_findings(found: DataFrame, edges: DataFrame, nodes: DataFrame, negations: list[str]) -> DataFrame:
    """Severity x 0.4 where a neighbour's label is negated (mitigated), x 0.1 where it looks like a test."""
    low = F.lower("label")
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    kind = nodes.select("node_id", any_of(negations).alias("neg"), any_of(["test", "mock", "fixture"]).alias("test"))
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    near = both.join(found.select("node_id").distinct(), "node_id", "left_semi").join(kind.select(F.col("node_id").alias("other"), "neg", "test"), "other").groupBy("node_id").agg(F.bool_or("neg").alias("neg"), F.bool_or("test").alias("test"))
    j = found.join(near, "node_id", "left").na.fill(False, ["neg", "test"])
    status = F.when(F.col("test"), "false_positive").when(F.col("neg"), "mitigated").otherwise("confirmed")
    return j.withColumn("status", status).withColumn("severity", F.col("severity") * F.when(F.col("test"), 0.1).when(F.col("neg"), 0.4).otherwise(1.0)).drop("neg", "test")


def first_pattern(label: Column, patterns: list[str]) -> Column:
    """The first pattern that a label has, else null."""
    low = F.lower(label)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in patterns])


def affinity_confidence(sources: list[Column], digits: int | None = 12) -> Column:
    """Geometric mean of the known sources, at most 0.85 (0.40 for a single one), null below 0.15.

    The least one is compared in so many ``digits``, as the order of a mean may leave a little less; None: as it is.
    """
    known = F.filter(F.array(*sources), lambda x: x.isNotNull() & (x > 0))
    mean = F.exp(F.aggregate(known, F.lit(0.0), lambda a, x: a + F.log(x)) / F.size(known))
    capped = F.when(F.size(known) == 1, F.least(mean, F.lit(0.40))).otherwise(F.least(mean, F.lit(0.85)))
    return F.when((F.size(known) > 0) & ((capped if digits is None else F.round(capped, digits)) >= 0.15), capped)


def hypothesis_confidence(likelihoods: DataFrame, key: str, value: str) -> DataFrame:
    """Odds multiply: (key, confidence, verdict)."""
    odds = likelihoods.groupBy(key).agg(F.product(value).alias("odds"))
    c = F.least(F.greatest(F.col("odds") / (1 + F.col("odds")), F.lit(0.01)), F.lit(0.99))
    return odds.select(key, c.alias("confidence")).withColumn("verdict", F.when(F.col("confidence") > 0.8, "supported").when(F.col("confidence") < 0.2, "refuted").otherwise("open"))
