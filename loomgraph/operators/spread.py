"""Epidemics, removal counterfactuals, plasticity and prediction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.traversal import DECAY, pagerank, reach
from loomgraph.plans.durable import cut, global_rank, stored

#: Transmission by relation; anything else is 0.1.
COUPLING = {"imports": 0.8, "calls": 0.7, "inherits": 0.6, "references": 0.4, "contains": 0.3, "related_to": 0.2}


def epidemic(
    g: PropertyGraph, infected: list[str], recovered: list[str] | None = None, iterations: int = 50, promote: float = 0.5,
    rate: float | None = None, direction: str = "forward", least: float = 0.001, top: int | None = None,
) -> DataFrame:
    """SIR spread with synchronous rounds: (node_id, probability, infected, generation), seeds left out.

    Recovered nodes come from the input only.  Stops early when five rounds
    bring no new infection, or when over 0.8 of all nodes are infected within
    ten rounds (burnout).
    """
    e = g.expanded().select("src", "dst", "weight", "relation")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "relation")
    e = {"forward": e, "reverse": back}.get(direction) or e.unionByName(back)
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    c = reduce(lambda w, kv: w.when(F.col("relation") == kv[0], kv[1]), COUPLING.items(), F.when(F.lit(False), 0.0)).otherwise(0.1)
    p = F.lit(float(rate)) if rate is not None else F.least(F.greatest(F.col("weight") * c, F.lit(0.0)), F.lit(0.95))
    edges = e.join(deg, "src").select("src", "dst", (p / F.when(F.col("deg") > 1, F.sqrt(F.col("deg").cast("double"))).otherwise(1.0)).alias("p"))
    closed = g.seeds(recovered or []).select("node_id")
    if recovered:
        edges = edges.join(closed.withColumnRenamed("node_id", "dst"), "dst", "left_anti").join(closed.withColumnRenamed("node_id", "src"), "src", "left_anti")
    edges = cut(edges)
    seeds = g.seeds(infected).select("node_id")
    state = seeds.select("node_id", F.lit(1.0).alias("probability"), F.lit(True).alias("infected"), F.lit(0).alias("generation"))
    n, quiet, before = None, 0, None
    for k in range(1, min(iterations, 500) + 1):
        sick = state.where("infected").select(F.col("node_id").alias("src"), "probability")
        hit = sick.join(edges, "src").groupBy("dst").agg(F.product(1 - F.col("p") * F.col("probability")).alias("escape"))
        both = state.join(hit, state.node_id == hit.dst, "full_outer")
        new = 1 - (1 - F.coalesce("probability", F.lit(0.0))) * F.coalesce("escape", F.lit(1.0))
        prob = F.when(F.col("infected"), F.col("probability")).otherwise(new)
        sickness = F.coalesce("infected", F.lit(False)) | (new > promote)
        state = both.select(F.coalesce("node_id", "dst").alias("node_id"), prob.alias("probability"), sickness.alias("infected"), F.coalesce("generation", F.lit(k)).alias("generation"))
        if iterations > 3:
            state = cut(state)
            count = state.where("infected").count()
            n = n or g.nodes.count()
            quiet = quiet + 1 if count == before else 0
            before = count
            if quiet >= 5 or (k <= 10 and count > 0.8 * n):
                break
    out = state.join(seeds, "node_id", "left_anti").where(F.col("probability") > least)
    return out.orderBy(F.desc("probability"), "node_id").limit(top) if top else out


def trial_waves(edges: DataFrame, trials: DataFrame, max_depth: int = 5, threshold: float = 0.04, by: tuple[str, ...] = ("trial",), gone: DataFrame | None = None) -> DataFrame:
    """Wavefronts of many trials in one job: (*by, node_id, activation).

    ``gone``: nodes that are taken out of some trials (columns of ``by``, and node_id).
    """
    if gone is not None:
        on = [c for c in gone.columns if c != "node_id"]
        trials = trials.join(gone, [*on, "node_id"], "left_anti")
    state = trials.groupBy(*by, "node_id").agg(F.least(F.max("score"), F.lit(1.0)).alias("activation")).withColumn("entered", F.lit(0))
    edges = edges.select("src", "dst", "weight", "inhibitory")
    for hop in range(1, max_depth + 1):
        front = state.where((F.col("entered") == hop - 1) & (F.col("activation") >= threshold)).select(*by, F.col("node_id").alias("src"), "activation")
        s = F.col("activation") * F.col("weight") * DECAY
        sent = front.join(edges, "src").select(*by, F.col("dst").alias("node_id"), s.alias("s"), "inhibitory")
        if gone is not None:
            sent = sent.join(gone, [*on, "node_id"], "left_anti")
        got = sent.groupBy(*by, "node_id").agg(
            F.max(F.when(~F.col("inhibitory") & (F.col("s") > threshold), F.col("s"))).alias("up"), F.sum(F.when(F.col("inhibitory"), F.col("s") * 0.5)).alias("down")
        )
        act = F.greatest(F.greatest(F.coalesce("activation", F.lit(0.0)), F.coalesce("up", F.lit(0.0))) - F.coalesce("down", F.lit(0.0)), F.lit(0.0))
        entered = F.when(F.col("entered").isNotNull(), F.col("entered")).when(F.col("up").isNotNull(), F.lit(hop))
        state = state.join(got, [*by, "node_id"], "full_outer").select(*by, "node_id", act.alias("activation"), entered.alias("entered"))
        if hop % 3 == 0 and hop < max_depth:
            state = cut(state)
    return state.where("activation > 0").select(*by, "node_id", "activation")


def _without(g: PropertyGraph, gone: DataFrame) -> DataFrame:
    e = g.expanded()
    return e.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")


def removal_effect(g: PropertyGraph, trials: DataFrame, remove: list[str], max_depth: int = 5) -> DataFrame:
    """What other nodes lose over all trials if nodes go: (node_id, lost, state)."""
    gone = g.seeds(remove).select("node_id")
    base = trial_waves(g.expanded(), trials, max_depth).groupBy("node_id").agg(F.sum("activation").alias("base"))
    kept = trial_waves(_without(g, gone), trials.join(gone, "node_id", "left_anti"), max_depth).groupBy("node_id").agg(F.sum("activation").alias("kept"))
    lost = base.join(kept, "node_id", "left").join(gone, "node_id", "left_anti").select("node_id", (1 - F.coalesce("kept", F.lit(0.0)) / F.col("base")).alias("lost"))
    return lost.withColumn("state", F.when(F.col("lost") > 0.99, "orphaned").when(F.col("lost") > 0.5, "weakened").otherwise("kept"))


def ranked_trials(g: PropertyGraph, n: int = 8, ranks: DataFrame | None = None) -> DataFrame:
    """``n`` single-seed trials (trial, node_id, score) strided over the nodes with out-edges by falling PageRank.

    A leaf as a seed would reach nothing and lose nothing.  Fewer such nodes than
    trials: they take turns.  ``ranks``: (node_id, pagerank), else computed; ties
    in nine digits go by id.
    """
    pr = pagerank(g) if ranks is None else ranks
    able = pr.join(g.expanded().select(F.col("src").alias("node_id")).distinct(), "node_id", "left_semi")
    ranked = stored(global_rank(able.select((-F.round("pagerank", 9)).alias("falling"), "node_id"), ["falling", "node_id"], "r").select("node_id", "r"), "trial-ranks")
    total = ranked.count()
    if not total:
        return ranked.select(F.lit(0).alias("trial"), "node_id", F.lit(1.0).alias("score"))
    turns = g.nodes.sparkSession.createDataFrame([(t, t * max(1, total // n) % total) for t in range(n)], "trial int, r long")
    return ranked.join(F.broadcast(turns), "r").select("trial", "node_id", F.lit(1.0).alias("score"))


#: A share of activation below this is what the order of a sum leaves, not a loss.
NO_LOSS = 1e-9


def total_loss(g: PropertyGraph, trials: DataFrame, removed: DataFrame, max_depth: int) -> DataFrame:
    """Share of all activation lost for each candidate removal: (candidate, impact). ``removed``: candidate, node_id.

    All candidates run in one job: a run is a trial under a candidate's removal.
    """
    candidates = removed.select("candidate").distinct()
    runs = trials.crossJoin(F.broadcast(candidates))  # a few trials under a bounded list of candidates
    base = trial_waves(g.expanded(), trials, max_depth).agg(F.sum("activation").alias("base"))
    kept = trial_waves(g.expanded(), runs, max_depth, by=("candidate", "trial"), gone=removed.select("candidate", "node_id")).groupBy("candidate").agg(F.sum("activation").alias("kept"))
    loss = 1 - F.coalesce("kept", F.lit(0.0)) / F.col("base")
    loss = F.when((F.col("base") > 0) & (loss > NO_LOSS), loss).otherwise(0.0)
    return candidates.join(kept, "candidate", "left").crossJoin(F.broadcast(base)).select("candidate", loss.alias("impact"))  # one row


def keystones(g: PropertyGraph, candidates: int = 40, keep: int = 20, max_depth: int = 5, trials: int = 8) -> DataFrame:
    """(node_id, impact): the candidates of largest out-degree whose removal costs most; a bounded list."""
    top = cut(g.degrees().orderBy(F.desc("out_degree"), "node_id").limit(candidates).select(F.col("node_id").alias("candidate"), "node_id"))
    impact = total_loss(g, cut(ranked_trials(g, trials)), top, max_depth)
    return impact.select(F.col("candidate").alias("node_id"), "impact").orderBy(F.desc(F.round("impact", 9)), "node_id").limit(keep)


def synergy(g: PropertyGraph, nodes: list[str], max_depth: int = 5, trials: int = 8, ranked: DataFrame | None = None) -> DataFrame:
    """One row: combined loss over the sum of single losses, at most 10; 1 where nothing is lost. ``ranked``: the trials, else made."""
    ids = cut(g.seeds(nodes).select("node_id"))
    single = ids.select(F.col("node_id").alias("candidate"), "node_id")
    together = ids.select(F.lit(-1).cast("long").alias("candidate"), "node_id")
    t = cut(ranked_trials(g, trials)) if ranked is None else ranked
    loss = total_loss(g, t, single.unionByName(together), max_depth)
    s = loss.agg(F.sum(F.when(F.col("candidate") < 0, F.col("impact"))).alias("combined"), F.sum(F.when(F.col("candidate") >= 0, F.col("impact"))).alias("single"))
    return s.select(F.round("combined", 6).alias("combined"), F.round("single", 6).alias("single"), F.round(F.when(F.col("single") > 0, F.least(F.col("combined") / F.col("single"), F.lit(10.0))).otherwise(1.0), 6).alias("synergy"))


def hebbian_update(edges: DataFrame, active: DataFrame, rate: float = 0.08, decay: float = 0.995, floor: float = 0.05, cap: float = 3.0, times: int = 5, step: float = 0.15, incoming: float = 5.0) -> DataFrame:
    """One plasticity pass over edges with strengthen_count, weaken_count, ltp_applied, ltd_applied.

    Strengthen between active nodes, decay out of quiet ones, long-term steps
    once, then scale what comes into a node to at most ``incoming``.
    """
    e = edges.join(active.select(F.col("node_id").alias("src"), F.col("activation").alias("_s")), "src", "left").join(active.select(F.col("node_id").alias("dst"), F.col("activation").alias("_t")), "dst", "left")
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    low = F.greatest(F.col("weight") * decay, F.lit(floor))
    weak = F.col("_s").isNull() & (F.col("weight") - low > 1e-6)
    e = e.select(
        "*", F.when(both, F.least(F.col("weight") + rate * F.col("_s") * F.col("_t"), F.lit(cap))).when(weak, low).otherwise(F.col("weight")).alias("_w"),
        (F.col("strengthen_count") + both.cast("int")).alias("_sc"), (F.col("weaken_count") + weak.cast("int")).alias("_wc"),
    )
    ltp, ltd = (F.col("_sc") >= times) & ~F.col("ltp_applied"), (F.col("_wc") >= times) & ~F.col("ltd_applied")
    e = e.withColumn("_w", F.when(ltp, F.least(F.col("_w") + step, F.lit(cap))).otherwise(F.col("_w")))
    e = e.withColumn("_w", F.when(ltd, F.greatest(F.col("_w") - step, F.lit(floor))).otherwise(F.col("_w")))
    into = e.groupBy("dst").agg(F.sum("_w").alias("_in"))  # partial sums: a hub's edges are not gathered
    e = e.join(into, "dst").withColumn("_w", F.col("_w") * F.when(F.col("_in") > incoming, incoming / F.col("_in")).otherwise(1.0))
    new = {"weight": F.col("_w"), "strengthen_count": F.col("_sc"), "weaken_count": F.col("_wc"), "ltp_applied": F.col("ltp_applied") | ltp, "ltd_applied": F.col("ltd_applied") | ltd}
    return e.select(*[new.get(c, F.col(c)).alias(c) for c in edges.columns])


def learn(g: PropertyGraph, nodes: list[str], feedback: str, strength: float = 0.2, floor: float = 0.05, cap: float = 3.0) -> DataFrame:
    """Edges that feedback changes, with their new weight.

    ``correct`` strengthens and ``wrong`` weakens all edges among the nodes and
    their ``contains`` children; ``partial`` strengthens inside the first half
    and weakens between the first half and the rest.
    """
    order = F.array_position(F.array(*[F.lit(n) for n in nodes]), F.col("external_id")).cast("int")
    named = g.nodes.where(F.col("external_id").isin(nodes)).select("node_id", order.alias("rank"))
    kids = g.edges.where("relation = 'contains'").join(named, F.col("src") == F.col("node_id")).select(F.col("dst").alias("node_id"), F.col("rank"))
    region = named.unionByName(kids).groupBy("node_id").agg(F.min("rank").alias("rank"))
    a, b = region.select(F.col("node_id").alias("src"), F.col("rank").alias("ra")), region.select(F.col("node_id").alias("dst"), F.col("rank").alias("rb"))
    half = (len(nodes) + 1) // 2
    first = (F.col("ra") <= half) & (F.col("rb") <= half)
    delta = {"correct": F.lit(strength), "wrong": F.lit(-strength)}.get(feedback, F.when(first, strength).otherwise(-strength))
    e = g.edges.join(a, "src").join(b, "dst")
    return e.select("src", "dst", "relation", F.least(F.greatest(F.col("weight") + delta, F.lit(floor)), F.lit(cap)).alias("weight"))


def weight_drift(baseline: DataFrame, current: DataFrame, least: float = 0.001, top: int = 20) -> DataFrame:
    """Edges whose weight moved: (src, dst, relation, drift)."""
    key = ["src", "dst", "relation"]
    j = baseline.select(*key, F.col("weight").alias("w0")).join(current.select(*key, F.col("weight").alias("w1")), key)
    return j.select(*key, (F.col("w1") - F.col("w0")).alias("drift")).where(F.abs("drift") > least).orderBy(F.desc(F.abs("drift")), "src", "dst").limit(top)


def predict(g: PropertyGraph, changed: str, co_change: DataFrame, trust: DataFrame | None = None, tremor: DataFrame | None = None) -> DataFrame:
    """(node_id, score): co-change rows (x1.02) and structural neighbours (x0.98), by trust and tremor factors."""
    me = g.seeds([changed]).select("node_id")
    both = co_change.select("a", "b", "strength").unionByName(co_change.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
    history = both.join(me, both.a == me.node_id, "left_semi").select(F.col("b").alias("node_id"), (F.col("strength") * 1.02).alias("score"))
    e = g.expanded().where(F.col("relation").isin("imports", "calls", "references")).select("src", "dst", "weight")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = e.join(me, e.src == me.node_id, "left_semi").select(F.col("dst").alias("node_id"), (F.col("weight") * 0.98).alias("score"))
    out = history.unionByName(near).groupBy("node_id").agg(F.max("score").alias("score"))
    for side, column in ((trust, "risk"), (tremor, "factor")):
        if side is not None:
            out = out.join(side.select("node_id", F.col(column).alias("_f")), "node_id", "left").select("node_id", (F.col("score") * F.coalesce("_f", F.lit(1.0))).alias("score"))
    return out


def bootstrap_co_change(g: PropertyGraph, depth: int = 3, least: float = 0.001, per_row: int = 100) -> DataFrame:
    """Co-change strengths before any history: (a, b, strength) along forward paths, 0.95 * 0.3 a hop, first visit counts."""
    e = g.expanded().select("src", "dst", "weight")
    level = e.groupBy("src", "dst").agg(F.max("weight").alias("w")).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") * 0.95 * 0.3).alias("strength"))
    out = level
    for _ in range(depth - 1):
        step = level.join(e, level.b == e.src).where(F.col("dst") != F.col("a")).groupBy("a", "dst").agg(F.max(F.col("strength") * F.col("weight") * 0.95 * 0.3).alias("strength")).withColumnRenamed("dst", "b")
        level = step.where(F.col("strength") > least).join(out.select("a", "b"), ["a", "b"], "left_anti")
        out = out.unionByName(level)
    w = Window.partitionBy("a").orderBy(F.desc("strength"), "b")
    return out.where(F.col("strength") > least).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_row).drop("_n")


def record_co_change(matrix: DataFrame, groups: DataFrame, step: float = 0.1, per_row: int = 100) -> DataFrame:
    """Add commit pairs (a, b, times) to a matrix (a, b, strength): 0.1 a time, at most 1, the weakest evicted."""
    new = groups.groupBy("a", "b").agg(F.sum("times").alias("times"))
    both = matrix.join(new, ["a", "b"], "full_outer").select("a", "b", F.least(F.coalesce("strength", F.lit(0.0)) + step * F.coalesce("times", F.lit(0)), F.lit(1.0)).alias("strength"))
    w = Window.partitionBy("a").orderBy(F.desc("strength"), "b")
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_row).drop("_n")


def reachable_without(g: PropertyGraph, sources: DataFrame, gone: DataFrame, hops: int = 5) -> DataFrame:
    """Nodes still reached once others are removed."""
    return reach(g, sources, hops, without=gone)
