"""Flow and race simulation, taint, plans, traces and hypotheses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.text import first_pattern
from loomgraph.operators.traversal import reach

#: Label patterns by role, in natural order.
VALVES = ("lock", "mutex", "semaphore", "synchronized", "atomic", "queue", "channel", "guard")
READ_ONLY = ("get", "read", "list", "fetch", "find", "is_", "has_")
ENTRIES = ("main", "handle", "on_", "route", "api", "start", "run", "serve")
BOUNDARIES = ("valid", "sanit", "escape", "auth", "check", "verify", "filter", "guard", "encode", "parse")


def _any(label: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(label)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def guards(g: PropertyGraph, words: tuple[str, ...]) -> DataFrame:
    """(node_id, by): nodes whose label or a tag has one of the words (``self``), or that have an edge to such a node (``neighbour``)."""
    tagged = F.exists("tags", lambda t: _any(t, words))
    own = g.nodes.where(_any(F.col("label"), words) | F.coalesce(tagged, F.lit(False))).select("node_id")
    near = g.expanded().join(own.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct().join(own, "node_id", "left_anti")
    return own.withColumn("by", F.lit("self")).unionByName(near.withColumn("by", F.lit("neighbour")))


def entry_points(nodes: DataFrame, most: int = 100, prefixes: tuple[str, ...] = ENTRIES) -> DataFrame:
    """Function nodes (type 2) named like entry points, else file nodes (type 0); by PageRank, then id."""
    starts = reduce(lambda a, b: a | b, [F.lower("label").startswith(p) for p in prefixes])
    rows = nodes.where(((F.col("node_type") == 2) & starts) | (F.col("node_type") == 0)).withColumn("function", (F.col("node_type") == 2).cast("int"))
    top = rows.agg(F.max("function").alias("top"))
    return rows.crossJoin(F.broadcast(top)).where("function = top").orderBy(F.desc(F.round("pagerank", 9)), "node_id").limit(most).select("node_id")  # one row


def flow_paths(g: PropertyGraph, entries: DataFrame, max_depth: int = 15, least: float = 0.1, budget: int | None = None) -> DataFrame:
    """(origin, node_id, depth, lock, path_length): particles from each entry over excitatory edges, no node twice on a path.

    One run for each origin is enough, as particles of one origin behave alike.
    A node is expanded at its first visit of an origin.  A ``budget`` keeps only
    the least node ids of a hop.
    """
    valve = g.nodes.select("node_id", _any(F.col("label"), VALVES).alias("valve"))
    e = g.expanded().where(~F.col("inhibitory") & (F.col("weight") >= least)).select("src", "dst").distinct()
    level = entries.select(F.col("node_id").alias("origin"), "node_id").join(valve, "node_id").select("origin", "node_id", F.col("valve").alias("lock"), F.lit(0).alias("depth"))
    seen = level
    for depth in range(1, max_depth + 1):
        step = level.join(e, level.node_id == e.src).groupBy("origin", "dst").agg(F.bool_or("lock").alias("lock"))
        new = step.withColumnRenamed("dst", "node_id").join(seen.select("origin", "node_id"), ["origin", "node_id"], "left_anti").join(valve, "node_id")
        level = new.select("origin", "node_id", (F.col("lock") | F.col("valve")).alias("lock"), F.lit(depth).alias("depth"))
        if budget:
            level = level.orderBy("origin", "node_id").limit(budget)
        seen = seen.unionByName(level)
    return seen


def turbulence(g: PropertyGraph, flow: DataFrame, particles: int = 2, least: float = 0.5, guarded: DataFrame | None = None) -> DataFrame:
    """Nodes reached from several origins, with the race score of its factors: (node_id, origins, score, severity)."""
    reached = flow.where("depth > 0").groupBy("node_id").agg(F.count_distinct("origin").alias("origins"), F.count_distinct(F.when(~F.col("lock"), F.col("origin"))).alias("free"), F.bool_or("lock").alias("locked")).where("origins > 1")
    indeg = g.expanded().groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("indeg"))
    top = indeg.agg(F.max("indeg").alias("top"))
    n = g.nodes.select("node_id", _any(F.col("label"), VALVES).alias("valve"), _any(F.col("label"), READ_ONLY).alias("reads"))
    j = reached.join(n, "node_id").join(indeg, "node_id", "left").crossJoin(F.broadcast(top))  # one row
    c = F.coalesce("indeg", F.lit(0)) / F.col("top")
    hit = F.when(F.col("free") > 1, F.col("free")).otherwise(F.col("origins"))
    score = (
        F.least(hit / float(max(particles, 1)), F.lit(1.0)) * F.when(F.col("valve"), 0.0).when(F.col("locked"), 0.3).otherwise(1.0) * F.when(F.col("reads"), 0.2).otherwise(1.0)
        * (0.5 + 0.5 * c) * F.when(F.col("reads") & (c > 0.9), 0.1).otherwise(1.0)
    )
    out = j.withColumn("score", score).withColumn("hit", hit)
    if guarded is not None:
        out = out.join(guarded.select("node_id", F.lit(0.15).alias("_g")), "node_id", "left").withColumn("score", F.col("score") * F.coalesce("_g", F.lit(1.0)))
    level = F.when((F.col("score") >= 0.8) & (F.col("hit") >= 3) & ~F.col("locked"), "Critical").when(F.col("score") >= 0.6, "High").when(F.col("score") >= 0.3, "Medium").otherwise("Low")
    return out.where(F.col("score") >= least).select("node_id", "origins", "score", level.alias("severity"))


def taint(g: PropertyGraph, entries: list[str], boundaries: tuple[str, ...] = BOUNDARIES, max_depth: int = 15) -> DataFrame:
    """(node_id, depth, boundary, leaked): what tainted input reaches; past a boundary it is clean.

    ``leaked`` holds for reached nodes that some path comes to without a boundary.
    """
    label = g.nodes.select("node_id", first_pattern(F.col("label"), list(boundaries)).alias("boundary"))
    open_nodes = label.where("boundary IS NULL").select("node_id")
    all_reached = reach(g, g.seeds(entries), max_depth)
    e = g.expanded()
    open_graph = PropertyGraph(g.nodes, e.join(open_nodes.withColumnRenamed("node_id", "src"), "src", "left_semi").withColumn("direction", F.lit(0)))
    leaks = reach(open_graph, g.seeds(entries).join(open_nodes, "node_id", "left_semi"), max_depth).select("node_id", F.lit(True).alias("leaked"))
    return all_reached.where("depth > 0").join(label, "node_id").join(leaks, "node_id", "left").select("node_id", "depth", "boundary", F.coalesce("leaked", F.lit(False)).alias("leaked"))


def taint_risk(found: DataFrame) -> DataFrame:
    """One row: 0.4 share of missing boundaries + 0.35 log leaks + 0.25 spread."""
    a = found.agg(F.count(F.lit(1)).alias("n"), F.count("boundary").alias("hits"), F.count_if(F.col("leaked")).alias("leaks"))
    return a.select("n", "hits", "leaks", F.when(F.col("n") > 0, 0.4 * (1 - F.col("hits") / F.col("n")) + 0.35 * F.least(F.log1p(F.col("leaks")) / 5, F.lit(1.0)) + 0.25 * F.least(F.col("n") / 100, F.lit(1.0))).otherwise(0.0).alias("risk"))


def validate_plan(g: PropertyGraph, changed: list[str], tested: DataFrame, hotspot: DataFrame, hops: int = 3) -> DataFrame:
    """One row: blast, gaps by severity and risk of a planned change.

    ``tested``: node_id; ``hotspot``: node_id, heat in 0..1. A reached node that
    the plan leaves out is a critical gap if it depends directly or is hot
    (0.55), a warning from 0.25 on.
    """
    both = PropertyGraph(g.nodes, g.undirected().select("src", "dst", "weight", "relation", F.lit(0.0).alias("causal_strength"), F.lit(False).alias("inhibitory"), F.lit(0).alias("direction")))
    r = reach(both, g.seeds(changed), hops).where("depth > 0").join(hotspot, "node_id", "left").na.fill(0.0, ["heat"]).join(tested.select("node_id", F.lit(1).alias("t")), "node_id", "left")
    critical, warning = (F.col("depth") == 1) | (F.col("heat") >= 0.55), F.col("heat") >= 0.25
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    a = r.agg(F.count(F.lit(1)).alias("blast"), F.count_if(critical).alias("critical"), F.count_if(~critical & warning).alias("warnings"), F.avg(F.when(F.col("t").isNull(), 1.0).otherwise(0.0)).alias("untested"), F.coalesce(F.max("heat"), F.lit(0.0)).alias("heat")).crossJoin(F.broadcast(n))  # one row
    risk = 0.3 * F.least(0.1 * F.col("critical"), F.lit(1.0)) + 0.25 * F.coalesce("untested", F.lit(0.0)) + 0.2 * F.col("blast") / F.col("n") + 0.25 * F.col("heat")
    level = F.when(F.col("risk") >= 0.8, "critical").when(F.col("risk") >= 0.6, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low")
    return a.select("blast", "critical", "warnings", risk.alias("risk")).withColumn("level", level)


def trace_scores(frames: DataFrame, pagerank: DataFrame, recency: float = 0.0) -> DataFrame:
    """(external_id, score) of a stack's nodes: 0.40 depth + 0.35 recency + 0.25 PageRank share. ``frames``: frame_no, external_id."""
    n = frames.agg(F.greatest(F.max("frame_no"), F.lit(1)).alias("last"))
    top = pagerank.agg(F.max("pagerank").alias("top"))
    j = frames.join(pagerank, "external_id", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(top))  # one row each
    s = 0.40 * F.col("frame_no") / F.col("last") + 0.35 * recency + 0.25 * F.coalesce(F.col("pagerank") / F.col("top"), F.lit(0.0))
    return j.groupBy("external_id").agg(F.max(s).alias("score"))


#: Claim forms: a regular expression and the kind of claim.
CLAIMS = (
    (r"(.+?) (?:never|does not|doesn't) (?:call|use|depend on|reach|touch)e?s? (.+)", "never_calls"), (r"(.+?) (?:always )?(?:goes through|passes through|via) (.+)", "gateway"),
    (r"(.+?) (?:depends on|calls|uses|imports|reaches|affects) (.+)", "depends_on"), (r"(.+?) (?:is coupled to|is coupled with|co-changes with) (.+)", "coupling"),
    (r"(.+?) (?:is isolated|has no dependents)", "isolated"), (r"(.+?) (?:is circular|has a cycle)", "circular"), (r"(.+?) (?:is in the same (?:community|layer) as) (.+)", "layering"),
    (r"(.+?) (?:has|is tested by) tests?", "test_coverage"),
)


def parse_claim(claim: str) -> tuple[str, str, str]:
    """(kind, subject, object) of a claim; ``unknown`` where no form fits."""
    import re

    for form, kind in CLAIMS:
        m = re.fullmatch(form, claim.strip().rstrip("."), re.I)
        if m:
            return kind, m.group(1).strip(), m.group(2).strip() if m.re.groups > 1 else ""
    return "unknown", claim.strip(), ""


def hypothesize(g: PropertyGraph, claim: str, max_hops: int = 5) -> DataFrame:
    """One row: kind, evidence, confidence and verdict of a claim about two nodes (by label)."""
    kind, subject, other = parse_claim(claim)
    s = g.nodes.where(F.lower("label") == subject.lower()).select("node_id")
    o = g.nodes.where(F.lower("label") == other.lower()).select("node_id")
    ahead = reach(g, s, max_hops)
    path = ahead.join(o, "node_id").where("depth > 0").agg(F.min("depth").alias("hops"))
    deg = g.degrees().join(s, "node_id").agg(F.coalesce(F.sum("in_degree"), F.lit(0)).alias("into"))
    row = path.crossJoin(deg)  # one row each
    found = F.col("hops").isNotNull()
    odds = {
        "depends_on": F.when(F.col("hops") == 1, 8.0).when(found, 2.0).otherwise(0.2), "never_calls": F.when(found, 0.2).otherwise(2.0),
        "isolated": F.when(F.col("into") == 0, 8.0).otherwise(0.2), "coupling": F.when(found, 2.0).otherwise(0.5),
    }.get(kind, F.lit(1.0))
    c = F.least(F.greatest(odds / (1 + odds), F.lit(0.01)), F.lit(0.99))
    verdict = F.when(F.col("confidence") > 0.8, "supported").when(F.col("confidence") < 0.2, "refuted").otherwise("open")
    return row.select(F.lit(kind).alias("kind"), F.coalesce("hops", F.lit(0)).alias("hops"), "into", c.alias("confidence")).withColumn("verdict", verdict)
