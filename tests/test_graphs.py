"""Hand-made graphs: cycles, parts, inhibition, twins, patterns, plasticity, flow."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import activation, flow, matching, spread, topology, traversal
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans.components import connected_components
from loomgraph.plans.durable import global_rank


def graph(spark, names, edges):
    """edges: (src, dst, relation, weight[, inhibitory])."""
    at = {n: i + 1 for i, n in enumerate(names)}
    nodes = spark.createDataFrame([(i, n, n, 2, [], 0.0) for n, i in at.items()], "node_id long, external_id string, label string, node_type int, tags array<string>, last_modified double")
    rows = [(at[e[0]], at[e[1]], e[2], float(e[3]), 0.5, bool(e[4]) if len(e) > 4 else False, 0) for e in edges]
    return PropertyGraph(nodes, spark.createDataFrame(rows, "src long, dst long, relation string, weight double, causal_strength double, inhibitory boolean, direction int")), at


def values(df, *cols):
    return {r[0]: tuple(r[1:]) if len(cols) > 2 else r[1] for r in df.select(*cols).collect()}


def test_inhibition_is_taken_off_after_the_maximum(spark):
    g, at = graph(spark, "abcd", [("a", "b", "calls", 1), ("a", "c", "calls", 1), ("b", "d", "calls", 1, True), ("c", "d", "calls", 1)])
    got = values(activation.wavefront(g, g.seeds(["a"]), 2), "node_id", "activation")
    assert got[at["b"]] == pytest.approx(0.55)
    assert got[at["d"]] == pytest.approx(0.55 * 0.55 * 0.5)


def test_a_node_only_inhibited_stays_silent(spark):
    g, at = graph(spark, "abc", [("a", "b", "calls", 1, True), ("b", "c", "calls", 1)])
    assert set(values(activation.wavefront(g, g.seeds(["a"]), 3), "node_id", "activation")) == {at["a"]}


def test_strong_components_and_layers(spark):
    g, at = graph(spark, "abcde", [("a", "b", "calls", 1), ("b", "c", "calls", 1), ("c", "a", "calls", 1), ("c", "d", "calls", 1), ("d", "e", "calls", 1)])
    scc = values(topology.strong_components(g.nodes, g.edges), "node_id", "scc")
    assert scc[at["a"]] == scc[at["b"]] == scc[at["c"]] != scc[at["d"]]
    lay = values(topology.layers(g), "node_id", "layer")
    assert [lay[at[x]] for x in "abcde"] == [0, 0, 0, 1, 2]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[100 + i] for i in range(30)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank_is_gapless_with_a_hot_key(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(5)], "k int, v int")
    rows = sorted((r["rank"], r["k"], r["v"]) for r in global_rank(df, ["k", "v"]).collect())
    assert [r[0] for r in rows] == list(range(305)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_pattern_needs_distinct_nodes_and_absent_edges(spark):
    g, at = graph(spark, "abc", [("a", "b", "calls", 1), ("b", "c", "calls", 1), ("a", "c", "calls", 1), ("b", "a", "calls", 1)])
    chain = matching.Pattern("chain", [{}, {}, {}], [(0, 1, "calls"), (1, 2, "calls")])
    assert {tuple(r) for r in matching.match_pattern(g, chain).collect()} == {(at["a"], at["b"], at["c"]), (at["b"], at["a"], at["c"])}
    open_chain = matching.Pattern("open", [{}, {}, {}], [(0, 1, "calls"), (1, 2, "calls")], [(0, 2, "calls")])
    assert matching.match_pattern(g, open_chain).count() == 0
    assert matching.pattern_similarity(chain, chain) == pytest.approx(1.0)


def test_epidemic_recovered_nodes_block(spark):
    g, at = graph(spark, "abc", [("a", "b", "imports", 1), ("b", "c", "imports", 1)])
    free = values(spread.epidemic(g, ["a"], iterations=3, promote=0.5), "node_id", "probability")
    assert free[at["b"]] == pytest.approx(0.8) and free[at["c"]] > 0.5
    assert spread.epidemic(g, ["a"], ["b"], iterations=3).count() == 0


def test_impact_takes_the_best_path(spark):
    g, at = graph(spark, "abcd", [("a", "b", "calls", 0.2), ("a", "c", "calls", 1), ("c", "b", "calls", 1), ("b", "d", "calls", 1)])
    got = {r["node_id"]: (round(r["signal_strength"], 6), r["hop_distance"]) for r in traversal.impact_radius(g, ["a"]).collect()}
    assert got[at["b"]] == (round(0.55 * 0.55, 6), 2)
    assert got[at["d"]][1] == 3


def test_why_stops_at_the_target(spark):
    g, _ = graph(spark, "abcd", [("a", "b", "calls", 1), ("b", "c", "imports", 1), ("c", "d", "calls", 1)])
    steps = sorted((r["step"], r["external_id"], r["relation"]) for r in traversal.why(g, "d", "b").collect())
    assert steps == [(0, "d", ""), (1, "c", "calls"), (2, "b", "imports")]


def test_label_propagation_splits_two_clusters(spark):
    tri = lambda a, b, c: [(a, b, "calls", 1), (b, c, "calls", 1), (a, c, "calls", 1)]
    g, at = graph(spark, "abcxyz", [*tri("a", "b", "c"), *tri("x", "y", "z"), ("c", "x", "calls", 0.2)])
    c = values(topology.communities(g), "node_id", "community")
    assert len({c[at[n]] for n in "abc"}) == 1 and len({c[at[n]] for n in "xyz"}) == 1 and c[at["a"]] != c[at["x"]]
    assert topology.bridges(g, topology.communities(g)).count() == 1


def test_plasticity_strengthens_and_normalises(spark):
    g, at = graph(spark, "abc", [("a", "b", "calls", 2.9), ("c", "b", "calls", 2.9)])
    e = g.edges.withColumns({"strengthen_count": F.lit(4), "weaken_count": F.lit(0), "ltp_applied": F.lit(False), "ltd_applied": F.lit(False)})
    act = spark.createDataFrame([(at["a"], 1.0), (at["b"], 1.0)], "node_id long, activation double")
    rows = {r["src"]: r for r in spread.hebbian_update(e, act).collect()}
    assert rows[at["a"]]["strengthen_count"] == 5 and rows[at["a"]]["ltp_applied"]
    assert sum(r["weight"] for r in rows.values()) == pytest.approx(5.0)


def test_taint_stops_at_a_boundary(spark):
    g, at = graph(spark, ["in", "validate", "store", "leak"], [("in", "validate", "calls", 1), ("validate", "store", "calls", 1), ("in", "leak", "calls", 1)])
    got = values(flow.taint(g, ["in"]), "node_id", "leaked")
    assert got[at["leak"]] and not got[at["store"]]
    assert flow.parse_claim("A depends on B.") == ("depends_on", "A", "B")


def test_constraints_are_reported(spark):
    g, _ = graph(spark, "ab", [("a", "b", "calls", 1)])
    bad = PropertyGraph(g.nodes.unionByName(g.nodes.limit(1)), g.edges.withColumn("dst", F.lit(99).cast("long")))
    assert {r["problem"] for r in bad.problems().collect()} == {"duplicate_node", "dangling_dst"}


def test_trials_are_strided_over_the_nodes_that_lead_somewhere(spark):
    n, leaves = 100_010, 50_000  # the first half of the nodes leads to a leaf each, by any rank
    nodes = spark.range(n).select(F.col("id").alias("node_id"))
    edges = spark.range(n - leaves).select(F.col("id").alias("src"), (F.col("id") % leaves + n - leaves).alias("dst"), F.lit(0).alias("direction"))
    ranks = nodes.select("node_id", (1.0 / (F.col("node_id") + 1)).alias("pagerank"))
    g = PropertyGraph(nodes, edges)
    total = n - leaves
    tied = lambda k: round(1 / (k + 1), 9)
    order = sorted(range(total), key=lambda k: (-tied(k), k))
    assert values(spread.ranked_trials(g, 8, ranks), "trial", "node_id") == {t: order[t * (total // 8)] for t in range(8)}


def test_few_seeds_take_turns_and_no_edges_make_no_trials(spark):
    g, at = graph(spark, "abc", [("a", "b", "calls", 1), ("b", "c", "calls", 1)])
    assert values(spread.ranked_trials(g, 4), "trial", "node_id") == {0: at["b"], 1: at["a"], 2: at["b"], 3: at["a"]}
    empty = PropertyGraph(g.nodes, g.edges.limit(0))
    assert spread.ranked_trials(empty, 4).count() == 0


def test_a_loss_of_nothing_is_no_synergy(spark):
    """What only the order of a sum leaves is no loss: nothing lost twice is a factor of 1."""
    g, _ = graph(spark, ["a", "x", *(f"b{i}" for i in range(9))], [("a", f"b{i}", "calls", 0.1 + 0.07 * i) for i in range(9)] + [("x", "b0", "calls", 0.01)])
    trials = g.nodes.where("external_id = 'a'").select(F.lit(0).alias("trial"), "node_id", F.lit(1.0).alias("score"))
    row = spread.synergy(g, ["x"], 3, ranked=trials).first()
    assert (row["combined"], row["single"], row["synergy"]) == (0.0, 0.0, 1.0)


def plain_graph(spark, n, edges):
    nodes = spark.createDataFrame([(i, f"n{i}", f"n{i}", 2, [], 0.0) for i in range(n)], "node_id long, external_id string, label string, node_type int, tags array<string>, last_modified double")
    rows = [(a, b, "calls", 1.0, 0.5, False, 0) for a, b in edges]
    return PropertyGraph(nodes, spark.createDataFrame(rows, "src long, dst long, relation string, weight double, causal_strength double, inhibitory boolean, direction int"))


def brute_scc(n, edges):
    """The least node of each node's strong component, by plain reachability."""
    out = {i: {b for a, b in edges if a == i} for i in range(n)}

    def reached(i):
        seen, todo = {i}, [i]
        while todo:
            for j in out[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen

    r = {i: reached(i) for i in range(n)}
    return {i: min(j for j in r[i] if i in r[j]) for i in range(n)}


def test_strong_components_keep_every_node_of_chains_and_rings(spark):
    chain = [(i, i + 1) for i in range(499)]
    got = values(topology.strong_components(*(lambda g: (g.nodes, g.edges))(plain_graph(spark, 500, chain))), "node_id", "scc")
    assert got == {i: i for i in range(500)}
    depth = values(topology.longest_depths(*(lambda g: (g.nodes, g.edges))(plain_graph(spark, 500, chain))), "node_id", "depth")
    assert depth == {i: i for i in range(500)}
    ring = [(i, (i + 1) % 60) for i in range(60)]  # a ring with a chain into and out of every tenth node
    edges = ring + [(60 + 10 * k + j, 60 + 10 * k + j + 1) for k in range(6) for j in range(9)] + [(69 + 10 * k, 10 * k) for k in range(6)] + [(10 * k + 5, 120 + k) for k in range(6)] + [(3, 3)]
    got = values(topology.strong_components(*(lambda g: (g.nodes, g.edges))(plain_graph(spark, 130, edges))), "node_id", "scc")
    assert got == brute_scc(130, edges)


def test_strong_components_equal_reachability(spark):
    import random

    rng = random.Random(3)
    edges = list({(rng.randrange(60), rng.randrange(60)) for _ in range(75)})
    got = values(topology.strong_components(*(lambda g: (g.nodes, g.edges))(plain_graph(spark, 60, edges))), "node_id", "scc")
    assert got == brute_scc(60, edges)


def test_longest_depths_equal_recursion(spark):
    import functools
    import random

    rng = random.Random(4)
    edges = list({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})

    @functools.cache
    def depth(i):
        return max((depth(a) + 1 for a, b in edges if b == i), default=0)

    g = plain_graph(spark, 40, edges)
    assert values(topology.longest_depths(g.nodes, g.edges), "node_id", "depth") == {i: depth(i) for i in range(40)}
    lay = values(topology.layers(g, most=100), "node_id", "layer")
    assert lay == {i: depth(i) for i in range(40)}


def test_similar_pairs_equal_all_cosines(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topology, "CHUNK", 16)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(70, 5)).round(3))] + [(900, [0.0] * 5), (901, None)]
    df = spark.createDataFrame(vectors, "k long, v array<double>")
    m = np.array([v for _, v in vectors[:70]])
    m /= np.sqrt((m * m).sum(1))[:, None]
    cos = m @ m.T
    want = {(i, j): cos[i, j] for i in range(70) for j in range(i + 1, 70) if cos[i, j] >= 0.7}
    got = {(r["a"], r["b"]): r["similarity"] for r in topology.equivalents(df, "k", "v", 0.7).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    near = topology.similar_pairs(df.where("k % 10 = 0"), df, "k", "v", top=3)
    for a in range(0, 70, 10):
        best = sorted((j for j in range(70) if j != a), key=lambda j: (-round(cos[a, j], 6), j))[:3]
        assert sorted(r["b"] for r in near.where(F.col("a") == a).collect()) == sorted(best)


def test_guards_by_label_tag_and_neighbour(spark):
    g, at = graph(spark, ["get_lock", "b", "c", "d"], [("b", "get_lock", "calls", 1), ("c", "b", "calls", 1)])
    tagged = g.nodes.withColumn("tags", F.when(F.col("label") == "d", F.array(F.lit("Mutex"))).otherwise(F.col("tags")))
    got = values(flow.guards(PropertyGraph(tagged, g.edges), flow.VALVES), "node_id", "by")
    assert got == {at["get_lock"]: "self", at["b"]: "neighbour", at["d"]: "self"}


def test_total_loss_of_all_candidates_equals_one_by_one(spark):
    g = plain_graph(spark, 12, [(i, j) for i in range(12) for j in range(12) if (i * 5 + j) % 4 == 1 and i != j])
    trials = spark.createDataFrame([(0, 0, 1.0), (1, 3, 1.0)], "trial int, node_id long, score double")
    removed = spark.createDataFrame([(1, 1), (3, 3), (-1, 1), (-1, 3)], "candidate long, node_id long")
    got = values(spread.total_loss(g, trials, removed, 3), "candidate", "impact")
    for c, gone in ((1, ["n1"]), (3, ["n3"]), (-1, ["n1", "n3"])):
        ids = g.seeds(gone).select("node_id")
        base = spread.trial_waves(g.expanded(), trials, 3).agg(F.sum("activation")).first()[0]
        kept = spread.trial_waves(spread._without(g, ids), trials.join(ids, "node_id", "left_anti"), 3).agg(F.sum("activation")).first()[0] or 0.0
        assert got[c] == pytest.approx(1 - kept / base)


def test_topology_report_and_scales(spark):
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]
    g = plain_graph(spark, 6, two)
    r = topology.topology_report(g, iterations=20).first()
    assert r["n_communities"] == 2 and r["n_nodes"] == 6 and r["n_bridges"] == 1 and r["modularity"] > 0.2 and r["robustness"] in ("Moderate", "Robust")
    views = topology.scale_views(g, 2).collect()
    assert {(v["scale"], v["size"]) for v in views if v["scale"] == 0} == {(0, 3)} and sum(v["size"] for v in views if v["scale"] == 1) == 6


def planted_groups(rng, groups, size, inside, across):
    """Edges that are likely inside groups of nodes and rare across them."""
    n = groups * size
    return n, [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else across)]


def test_louvain_finds_planted_groups_and_beats_label_propagation(spark):
    import random

    n, edges = planted_groups(random.Random(3), 5, 14, 0.5, 0.02)
    g = plain_graph(spark, n, edges)
    got = topology.louvain(g)
    again = topology.louvain(g)
    labels = values(got, "node_id", "community")
    assert labels == values(again, "node_id", "community")
    q = topology.modularity(g, got).first()[0]
    assert q >= topology.modularity(g, topology.communities(g)).first()[0] - 1e-9
    truth = spark.createDataFrame([(i, i // 14) for i in range(n)], "node_id long, community long")
    assert q >= 0.9 * topology.modularity(g, truth).first()[0]


def test_a_round_of_louvain_is_a_plain_round(spark):
    """The first round restated: the best gain of each node, and half of the nodes move."""
    import random

    rng = random.Random(4)
    n = 40
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(80)})
    got = values(topology.louvain(plain_graph(spark, n, edges), 1), "node_id", "community")
    near = {i: sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i}) for i in range(n)}
    m2 = 2 * len(edges)
    turn = {i: (i % 1_000_003 + 1) * 48_271 % 2_147_483_647 // 1024 % 2 for i in range(n)}
    wish = {}
    for i in range(n):
        gains = [(-round(1 / m2 - len(near[j]) * len(near[i]) / m2**2, 12), j) for j in near[i]]
        if gains and -min(gains)[0] > 1e-12:
            wish[i] = min(gains)[1]
    moves = {i: j for i, j in wish.items() if turn[i] == 0}
    assert got == {i: moves.get(i, i) for i in range(n)} and moves and len(moves) < len(wish)


def test_louvain_without_edges_or_with_lone_nodes(spark):
    g, at = graph(spark, "abc", [("a", "b", "calls", 1)])
    got = values(topology.louvain(g), "node_id", "community")
    assert got[at["a"]] == got[at["b"]] and got[at["c"]] == at["c"]
    empty = PropertyGraph(g.nodes, g.edges.limit(0))
    assert values(topology.louvain(empty), "node_id", "community") == {i: i for i in at.values()}
