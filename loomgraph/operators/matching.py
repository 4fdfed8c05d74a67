"""Join-shaped operators: reference resolution, cross-domain links, stack frames, spans, patterns, bindings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, permutations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans.durable import salted_join, stored


def resolve_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, ref, target): a ref's last ``::`` part meets labels; hint and shared prefix decide among several.

    ``refs``: src (external id), ref, hint (import path or null).
    """
    r = refs.withColumn("name", F.element_at(F.split("ref", "::"), -1))
    j = r.join(nodes.select("external_id", F.col("label").alias("name")), "name")
    hint = F.when(F.col("hint").isNull(), 0).when(F.col("external_id").contains(F.col("hint")), 200).otherwise(0)
    parts = F.arrays_zip(F.split("src", "::").alias("a"), F.split("external_id", "::").alias("b"))
    shared = F.aggregate(parts, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.when(s["on"] & (x["a"] == x["b"]), F.struct(F.lit(True).alias("on"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), s["n"].alias("n"))))["n"]
    near = F.when(shared == 0, 1).when(shared == 1, 10).when(shared == 2, 50).otherwise(100)
    w = Window.partitionBy("src", "ref").orderBy(F.desc(hint), F.desc(near), "external_id")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("src", "ref", F.col("external_id").alias("target"), F.lit(0.5).alias("weight"))


def resolve_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, module, target): the longest dotted prefix of an import that is a module."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("prefix"), n.alias("n")))
    j = imports.select("src", "module", F.explode(prefixes).alias("p")).select("src", "module", "p.prefix", "p.n").join(modules.select(F.col("module").alias("prefix"), F.col("external_id").alias("target")), "prefix")
    return j.groupBy("src", "module").agg(F.max_by("target", "n").alias("target"))


def test_edges(files: DataFrame) -> DataFrame:
    """(test, target): ``test_X`` or ``X_test`` against ``X``. ``files``: external_id, stem."""
    t = files.where(F.col("stem").rlike("^test_|_test$")).select(F.col("external_id").alias("test"), F.regexp_replace("stem", "^test_|_test$", "").alias("stem"))
    return t.join(files.select("stem", F.col("external_id").alias("target")), "stem").select("test", "target")


def cross_links(nodes: DataFrame, key: str, relation: str, weight: float, least: int = 2, most: int = 20) -> DataFrame:
    """Nodes of different namespaces that share a key held by ``least`` to ``most`` nodes: (a, b, relation, weight)."""
    held = nodes.where(F.col(key).isNotNull())
    size = held.groupBy(key).agg(F.count_distinct("id").alias("k")).where(F.col("k").between(least, most)).select(key)
    held = held.join(size, key, "left_semi")
    x, y = held.alias("x"), held.alias("y")
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.namespace") < F.col("y.namespace"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight")).distinct()


def two_hop(edges: DataFrame, relation: str = "citation_chain", weight: float = 0.5) -> DataFrame:
    """A to C through some B: (src, dst, relation, weight)."""
    x, y = edges.alias("x"), edges.alias("y")
    return x.join(y, (F.col("x.dst") == F.col("y.src")) & (F.col("x.src") != F.col("y.dst"))).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight")).distinct()


def federate(repos: dict[str, PropertyGraph]) -> PropertyGraph:
    """One graph of several, external ids prefixed by their repository."""
    nodes = reduce(DataFrame.unionByName, [g.nodes.withColumn("external_id", F.concat(F.lit(f"{r}::"), "external_id")) for r, g in sorted(repos.items())])
    return PropertyGraph(nodes, reduce(DataFrame.unionByName, [g.edges for _, g in sorted(repos.items())]))


#: Cross-repository relations: (relation, weight, what both sides share).
CROSS_REPO = (("shared_config", 0.7, "config"), ("api_contract", 0.8, "route"), ("package_dep", 0.6, "package"), ("shared_type", 0.5, "type"), ("deployment_dep", 0.4, "deployment"), ("mcp_contract", 0.7, "tool"))


def cross_repo_edges(nodes: DataFrame) -> DataFrame:
    """(a, b, relation, weight) of nodes in different repositories that share a kind and a normalised label."""
    norm = F.regexp_replace(F.lower("label"), r"[^a-z0-9/]+", "")
    n = nodes.select("external_id", "repo", "kind", norm.alias("norm")).where(F.length("norm") > 2)
    kinds = nodes.sparkSession.createDataFrame([(k, r, w) for r, w, k in CROSS_REPO], "kind string, relation string, weight double")
    x, y = n.join(F.broadcast(kinds), "kind").alias("x"), n.alias("y")
    on = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.norm") == F.col("y.norm")) & (F.col("x.repo") < F.col("y.repo"))
    return x.join(y, on).select(F.col("x.external_id").alias("a"), F.col("y.external_id").alias("b"), "x.relation", "x.weight")


def frames_to_nodes(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """(frame_no, external_id): the node of the frame's file with the smallest line range around its line.

    ``frames``: frame_no, path, line; ``nodes``: external_id, path, line_start, line_end.
    """
    j = frames.join(nodes, "path").where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    return j.groupBy("frame_no").agg(F.min_by("external_id", F.struct((F.col("line_end") - F.col("line_start")).alias("s"), "external_id")).alias("external_id"))


def parse_frames(error_text: str) -> list[tuple[int, str, int]]:
    """(frame_no, path, line) of a Python, JavaScript, Rust or Go stack trace."""
    import re

    found = []
    for m in re.finditer(r'File "([^"]+)", line (\d+)|\(?([\w./@-]+\.(?:js|ts|tsx|rs|go|py|java)):(\d+)(?::\d+)?\)?', error_text):
        found.append((len(found), (m.group(1) or m.group(3)).lstrip("./"), int(m.group(2) or m.group(4))))
    return found


#: Shortest string that is looked for inside another, and how many times as long that may be.
LEAST_PART, MOST_TIMES = 4, 2


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): strings (column ``text``) inside others at most twice as long, by an index of trigrams.

    Every trigram of a string is in what contains it, so it is looked up by its
    rarest one alone, among strings of its own length's power of two and the next;
    a trigram that nothing has means no lookup.  Frequent trigrams are dealt over
    several tasks.  Strings under four characters are left out; equal ones count.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    band = lambda c: F.floor(F.log2(F.length(c))).cast("int")
    distinct = lambda df, name: df.select(F.col("text").alias(name)).where(F.length("text") >= LEAST_PART).distinct()
    index = distinct(long, "long").select("long", band("long").alias("band"), F.explode(grams("long")).alias("gram"))
    counts = index.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("n"))
    wanted = distinct(short, "short").select("short", F.explode(F.array(band("short"), band("short") + 1)).alias("band"), grams("short").alias("g"))
    wanted = wanted.select("short", "band", F.explode("g").alias("gram")).join(counts, ["gram", "band"], "left")
    rarest = wanted.groupBy("short", "band").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    met = salted_join(rarest.select("short", "band", F.col("r.gram").alias("gram")), index, ["gram", "band"])
    return met.where(F.col("long").contains(F.col("short")) & (F.length("long") <= MOST_TIMES * F.length("short"))).select("short", "long")


def spans_to_labels(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, external_id): exact label first, else one inside the other (4 characters at least, at least half as long); of several, the least id."""
    names = spans.select("name").distinct().withColumn("low", F.lower("name"))
    labels = nodes.select(F.lower("label").alias("low"), "external_id").groupBy("low").agg(F.min("external_id").alias("external_id"))
    exact = names.join(labels, "low").groupBy("name").agg(F.min("external_id").alias("external_id"))
    rest = stored(names.join(exact, "name", "left_anti"), "other-names")
    a, b = rest.select(F.col("low").alias("text")), labels.select(F.col("low").alias("text"))
    pairs = contained(a, b).select(F.col("short").alias("low"), F.col("long").alias("label")).unionByName(contained(b, a).select(F.col("long").alias("low"), F.col("short").alias("label")))
    fuzzy = pairs.join(labels.withColumnRenamed("low", "label"), "label").groupBy("low").agg(F.min("external_id").alias("external_id"))
    return exact.unionByName(rest.join(fuzzy, "low").select("name", "external_id"))


@dataclass
class Pattern:
    """A sub-graph template: node constraints, edges that must be there, edges that must not."""

    name: str
    nodes: list[dict]  # node_type, label_contains, required_tags
    edges: list[tuple[int, int, str | None]]
    absent: list[tuple[int, int, str | None]] = field(default_factory=list)
    severity: float = 0.5


def pattern_parts(p: Pattern) -> list[list[int]]:
    """The nodes of each connected part of a pattern, by the edges that must be there."""
    root = list(range(len(p.nodes)))
    for _ in p.nodes:
        for a, b, _ in p.edges:
            root[a] = root[b] = min(root[a], root[b])
    return [[i for i in range(len(root)) if root[i] == r] for r in sorted(set(root))]


def _candidates(g: PropertyGraph, c: dict) -> DataFrame:
    n = g.nodes
    if c.get("node_type") is not None:
        n = n.where(F.col("node_type") == c["node_type"])
    if c.get("label_contains"):
        n = n.where(F.lower("label").contains(c["label_contains"].lower()))
    for t in c.get("required_tags") or []:
        n = n.where(F.array_contains("tags", t))
    return n.select("node_id")


def _steps(e: DataFrame, a: int, b: int, relation: str | None) -> DataFrame:
    """The graph's edges that an edge of the pattern may stand for, parallel ones repeated."""
    e = e.where(F.col("relation") == relation) if relation else e
    return e.select(F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}"))


def _part_bindings(g: PropertyGraph, p: Pattern, part: list[int]) -> DataFrame:
    """Injective bindings of one connected part.

    Candidates are first reduced along a tree of the part, from its leaves to its
    root and back: a node stays only if each neighbour in the tree has a candidate
    next to it.  Then the edges are joined from the root outwards, so no join makes
    rows that a later edge of the tree throws away whole.  A single edge is its own tree.
    """
    e = g.expanded().select("src", "dst", "relation")
    weight = lambda i: (p.nodes[i].get("node_type") is not None) + 2 * bool(p.nodes[i].get("label_contains")) + len(p.nodes[i].get("required_tags") or [])
    root = min(part, key=lambda i: (-weight(i), i))
    tree, done, todo = [], {root}, [x for x in p.edges if x[0] in part]
    while at := next((x for x in todo if (x[0] in done) != (x[1] in done)), None):
        todo.remove(at)
        tree.append((at, at[0] if at[0] in done else at[1]))
        done |= {at[0], at[1]}
    held = {i: _candidates(g, p.nodes[i]).select(F.col("node_id").alias(f"n{i}")) for i in part}
    to_root = [(x, (x[0], x[1]) if up == x[0] else (x[1], x[0])) for x, up in reversed(tree)]
    to_leaves = [(x, (outer, inner)) for x, (inner, outer) in reversed(to_root)]
    for (a, b, r), (kept, other) in [*to_root, *to_leaves] if len(tree) > 1 else []:
        met = _steps(e, a, b, r).join(held[other], f"n{other}", "left_semi").join(held[kept], f"n{kept}", "left_semi")
        held[kept] = stored(met.select(f"n{kept}").distinct(), "candidates")
    bound, done = held[root], {root}
    for (a, b, r), up in tree:
        new = b if up == a else a
        if len(tree) == 1:
            bound = _steps(e, a, b, r).join(held[up], f"n{up}", "left_semi").join(held[new], f"n{new}", "left_semi").distinct()
        else:
            bound = salted_join(bound, _steps(e, a, b, r).join(held[new], f"n{new}", "left_semi").distinct(), [f"n{up}"])
        for j in done:
            bound = bound.where(F.col(f"n{new}") != F.col(f"n{j}"))
        done.add(new)
    for a, b, r in todo:  # edges that close a circle
        bound = bound.join(_steps(e, a, b, r), [f"n{i}" for i in dict.fromkeys((a, b))], "left_semi") if a != b else bound.join(e.where(F.col("src") == F.col("dst")).where(F.col("relation") == r if r else F.lit(True)).select(F.col("src").alias(f"n{a}")), f"n{a}", "left_semi")
    for a, b, r in p.absent:
        if a in part and b in part:
            bound = bound.join(_steps(e, a, b, r), [f"n{a}", f"n{b}"], "left_anti")
    return bound.select(*[f"n{i}" for i in sorted(part)])


def match_pattern(g: PropertyGraph, p: Pattern, most: int | None = None) -> DataFrame:
    """Injective bindings n0, n1, ... of a connected pattern; parts that do not connect are counted (:func:`match_count`), not crossed."""
    parts = pattern_parts(p)
    if len(parts) != 1:
        raise ValueError("the pattern has separate parts: its matches can be counted, not listed")
    out = _part_bindings(g, p, parts[0])
    return out.orderBy(*out.columns).limit(most) if most else out


def _meetings(p: Pattern, x: list[int], y: list[int]) -> list[tuple[tuple[int, int], ...]]:
    """The ways in which bindings of two parts may share nodes: pairs of places whose node types allow one node for both."""
    kind = lambda i: p.nodes[i].get("node_type")
    found = []
    for n in range(1, min(len(x), len(y)) + 1):
        for at, to in product(combinations(x, n), permutations(y, n)):
            if all(kind(i) is None or kind(j) is None or kind(i) == kind(j) for i, j in zip(at, to, strict=True)):
                found.append(tuple(zip(at, to, strict=True)))
    return found


def match_count(g: PropertyGraph, p: Pattern) -> DataFrame:
    """One row: number of injective bindings (matches), and the least node bound to n0 (first_node).

    Bindings of two separate parts are neither crossed nor paired.  They are counted
    by the nodes at the places where the parts may share one; those that share are
    taken off by inclusion and exclusion over the ways to meet, one join of counts a way.
    """
    parts = pattern_parts(p)
    if len(parts) == 1:
        return _part_bindings(g, p, parts[0]).agg(F.count(F.lit(1)).alias("matches"), F.min("n0").alias("first_node"))
    if len(parts) > 2:
        raise ValueError("patterns of more than two separate parts are not matched")
    if any((a in parts[0]) != (b in parts[0]) for a, b, _ in p.absent):
        raise ValueError("an absent edge between separate parts is not matched")
    ways = _meetings(p, *parts)
    at, to = ([f"n{i}" for i in sorted({pair[side] for way in ways for pair in way})] for side in (0, 1))
    x = stored(_part_bindings(g, p, parts[0]).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min("n0").alias("_first")), "part-counts")
    y = stored(_part_bindings(g, p, parts[1]).groupBy(*to).agg(F.count(F.lit(1)).alias("_n")), "part-counts")
    free = F.lit(y.agg(F.sum("_n")).first()[0] or 0).cast("long")
    for n, way in enumerate(ways):
        met = y.groupBy(*[F.col(f"n{j}").alias(f"n{i}") for i, j in way]).agg(F.sum("_n").alias(f"_off{n}"))
        x = x.join(met, [f"n{i}" for i, _ in way], "left")
        off = F.coalesce(f"_off{n}", F.lit(0))
        free = free - off if len(way) % 2 else free + off
    return x.agg(F.coalesce(F.sum(F.col("_n") * free), F.lit(0)).cast("long").alias("matches"), F.min(F.when(free > 0, F.col("_first"))).alias("first_node"))


def scan_patterns(g: PropertyGraph, patterns: list[Pattern], least_severity: float = 0.0, most_each: int = 50) -> DataFrame:
    """(pattern, severity, first node, matches, disabled) of each pattern; one that reaches its cap is reported as too broad."""
    out = []
    for p in patterns:
        if p.severity >= least_severity:
            m = match_count(g, p).select("first_node", F.least("matches", F.lit(most_each)).cast("long").alias("matches"))
            out.append(m.select(F.lit(p.name).alias("pattern"), F.lit(float(p.severity)).alias("severity"), "first_node", "matches", (F.col("matches") >= most_each).alias("disabled")))
    return reduce(DataFrame.unionByName, out)


def pattern_similarity(a: Pattern, b: Pattern) -> float:
    """Weighted Jaccard of node types, relations, size and absent edges."""
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    types = lambda p: {n.get("node_type") for n in p.nodes}
    rels = lambda p, es: {r for _, _, r in es}
    size = min(len(a.nodes), len(b.nodes)) / max(len(a.nodes), len(b.nodes), 1)
    return 0.4 * jac(types(a), types(b)) + 0.3 * jac(rels(a, a.edges), rels(b, b.edges)) + 0.2 * size + 0.1 * jac(rels(a, a.absent), rels(b, b.absent))


def pattern_similarities(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with the similarity of two patterns, structs of types, relations, size and absent (relations of absent edges).

    The column form of :func:`pattern_similarity`: both give 0.4, 0.3, 0.2 and 0.1
    to the Jaccard of types, of relations, the ratio of sizes and the Jaccard of absent edges.
    """

    def jaccard(field: str) -> Column:
        x, y = F.col(f"{a}.{field}"), F.col(f"{b}.{field}")
        union = F.size(F.array_union(x, y))
        return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(1.0)

    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    size = F.least(x, y) / F.greatest(x, y, F.lit(1))
    return pairs.withColumn("similarity", 0.4 * jaccard("types") + 0.3 * jaccard("relations") + 0.2 * size + 0.1 * jaccard("absent"))


def trace_depth(frames: DataFrame, trace: str, frame_no: str) -> DataFrame:
    """``frames`` with depth: where a frame stands in its trace, 0 for the first and 1 for the last; a trace's only frame is 0."""
    w = Window.partitionBy(trace)
    first, last = F.min(frame_no).over(w), F.count(F.lit(1)).over(w)
    rank = F.rank().over(Window.partitionBy(trace).orderBy(frame_no))
    return frames.withColumn("depth", F.when((last > 1) & first.isNotNull(), (rank - 1) / (last - 1)).otherwise(0.0))


def bindings(candidates: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """(candidate, external_id, score): what a document names, against nodes. Exact 1.0, label 0.92, path 0.88, symbol 0.8."""
    c = candidates.select("candidate", F.lower("candidate").alias("low")).distinct()
    n = nodes.select("external_id", F.lower("label").alias("label_low"), F.lower("external_id").alias("id_low"))
    exact = c.join(n, c.low == n.id_low).select("candidate", "external_id", F.lit(1.0).alias("score"))
    label = c.join(n, c.low == n.label_low).select("candidate", "external_id", F.lit(0.92).alias("score"))
    path = c.join(n, c.low == F.element_at(F.split("id_low", "::"), -1)).select("candidate", "external_id", F.lit(0.88).alias("score"))
    symbol = c.join(n.withColumn("part", F.explode(F.split("label_low", r"[\s#_./:-]+"))), F.col("low") == F.col("part")).select("candidate", "external_id", F.lit(0.8).alias("score"))
    best = reduce(DataFrame.unionByName, [exact, label, path, symbol]).groupBy("candidate", "external_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "external_id")
    return best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")
