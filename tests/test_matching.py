"""Substring lookups and pattern matches against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import matching
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import durable


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_contained_equals_every_pair(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
    short, long = {text() for _ in range(150)} | {"日本語の"}, {text() for _ in range(300)} | {"日本語の本x", "日本語の"}
    got = sorted(map(tuple, matching.contained(strings(spark, [*short, None]), strings(spark, [*long, *long])).collect()))
    assert got == sorted((a, b) for a in short for b in long if len(a) >= 4 and a in b and len(b) <= 2 * len(a))
    assert matching.contained(strings(spark, []), strings(spark, ["abcd"])).count() == 0


def test_frequent_trigrams_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "salted_join", lambda a, b, on: durable.salted_join(a, b, on, 5))
    long = [f"aaaa{i:03}" for i in range(200)]
    got = matching.contained(strings(spark, ["aaaa", "aaaa00", "zzzz"]), strings(spark, long)).collect()
    assert len(got) == 200 + 10


def test_salted_join_is_the_plain_join(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(rng.randrange(9), i) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(rng.choice([0, 0, 0, 0, 1, 2, 11]), i) for i in range(200)], "k int, b int")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    for rows in (1, 7, 1000):
        assert sorted(map(tuple, durable.salted_join(left, right, ["k"], rows).select("k", "a", "b").collect())) == want


def test_spans_meet_labels_without_a_nested_loop(spark):
    spans = spark.createDataFrame([("checkout",), ("checkoutFlow",), ("err",), ("nothing here",), ("Pay",)], "name string")
    nodes = spark.createDataFrame([("2", "CheckOut"), ("1", "checkout flow"), ("3", "checkoutflow2"), ("9", "pay"), ("4", "errors")], "external_id string, label string")
    df = matching.spans_to_labels(spans, nodes)
    assert {tuple(r) for r in df.collect()} == {("checkout", "2"), ("checkoutFlow", "2"), ("Pay", "9")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def random_graph(spark, rng, n, m):
    nodes = [(i, f"n{i}", f"label{i % 4}", i % 3, ["t"] if i % 2 else [], 0.0) for i in range(n)]
    edges = {(0 if rng.random() < 0.3 else rng.randrange(n), rng.randrange(n), rng.choice(["calls", "reads"])) for _ in range(m)}
    df = spark.createDataFrame(nodes, "node_id long, external_id string, label string, node_type int, tags array<string>, last_modified double")
    rows = [(a, b, r, 1.0, 0.5, False, 0) for a, b, r in edges]
    return PropertyGraph(df, spark.createDataFrame(rows, "src long, dst long, relation string, weight double, causal_strength double, inhibitory boolean, direction int")), nodes, edges


def plain_matches(nodes, edges, p):
    def fits(i, node):
        c = p.nodes[i]
        return (c.get("node_type") is None or node[3] == c["node_type"]) and (not c.get("label_contains") or c["label_contains"] in node[2]) and all(t in node[4] for t in c.get("required_tags") or [])

    has = lambda a, b, r: any((a, b, x) in edges for x in ([r] if r else ["calls", "reads"]))
    lists = [[n[0] for n in nodes if fits(i, n)] for i in range(len(p.nodes))]
    return sorted(b for b in itertools.product(*lists) if len(set(b)) == len(b) and all(has(b[x], b[y], r) for x, y, r in p.edges) and not any(has(b[x], b[y], r) for x, y, r in p.absent))


PATTERNS = [
    matching.Pattern("chain", [{"node_type": 1}, {}, {"label_contains": "label2"}], [(0, 1, "calls"), (1, 2, None)]),
    matching.Pattern("triangle", [{}, {}, {}], [(0, 1, None), (1, 2, None), (2, 0, None)]),
    matching.Pattern("star", [{}, {"node_type": 0}, {"node_type": 0}, {"required_tags": ["t"]}], [(0, 1, "calls"), (0, 2, "calls"), (3, 0, None)], [(3, 1, None)]),
    matching.Pattern("single", [{"node_type": 2, "required_tags": ["t"]}], []),
    matching.Pattern("both ways", [{}, {}], [(0, 1, "calls"), (1, 0, None)]),
]


@pytest.mark.parametrize("p", PATTERNS, ids=lambda p: p.name)
def test_bindings_equal_every_assignment(spark, p):
    g, nodes, edges = random_graph(spark, random.Random(7), 24, 90)
    df = matching.match_pattern(g, p)
    want = plain_matches(nodes, edges, p)
    assert sorted(map(tuple, df.collect())) == want
    row = matching.match_count(g, p).first()
    assert (row["matches"], row["first_node"]) == (len(want), min((b[0] for b in want), default=None))
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("nodes", [([{"node_type": 0}, {}, {"node_type": 1}, {}], [(0, 1, "calls"), (2, 3, "reads")]), ([{"label_contains": "3"}, {}, {}], [(1, 2, "calls")])])
def test_separate_parts_are_counted(spark, nodes):
    p = matching.Pattern("apart", *nodes)
    g, rows, edges = random_graph(spark, random.Random(8), 20, 60)
    want = plain_matches(rows, edges, p)
    got = matching.match_count(g, p).first()
    assert (got["matches"], got["first_node"]) == (len(want), min(b[0] for b in want))
    with pytest.raises(ValueError, match="separate parts"):
        matching.match_pattern(g, p)
    scan = matching.scan_patterns(g, [p], most_each=5).first()
    assert (scan["matches"], scan["disabled"]) == (5, True)


def test_three_parts_are_refused(spark):
    g, _, _ = random_graph(spark, random.Random(9), 6, 6)
    with pytest.raises(ValueError, match="more than two"):
        matching.match_count(g, matching.Pattern("x", [{}, {}, {}], []))


def test_a_chain_is_reduced_before_it_is_joined(spark):
    """A hub with many neighbours of which one leads on: only that one is bound."""
    n = 400
    nodes = [(i, f"n{i}", "goal" if i == n else "x", 0, [], 0.0) for i in range(n + 1)]
    rows = [(0, i, "calls", 1.0, 0.5, False, 0) for i in range(1, n)] + [(7, n, "calls", 1.0, 0.5, False, 0)]
    g = PropertyGraph(spark.createDataFrame(nodes, "node_id long, external_id string, label string, node_type int, tags array<string>, last_modified double"), spark.createDataFrame(rows, "src long, dst long, relation string, weight double, causal_strength double, inhibitory boolean, direction int"))
    p = matching.Pattern("hub", [{}, {}, {"label_contains": "goal"}], [(0, 1, "calls"), (1, 2, "calls")])
    assert [tuple(r) for r in matching.match_pattern(g, p).collect()] == [(0, 7, n)]
    assert matching.match_pattern(g, p).select(F.count_distinct("n1")).first()[0] == 1


def test_similarity_of_columns_is_that_of_patterns(spark):
    a = matching.Pattern("a", [{"node_type": 1}, {"node_type": 2}], [(0, 1, "calls")], [(1, 0, "imports")])
    b = matching.Pattern("b", [{"node_type": 1}, {"node_type": 3}, {"node_type": 2}], [(0, 1, "calls"), (1, 2, "reads")])
    row = lambda p: (sorted({n["node_type"] for n in p.nodes}), sorted({r for *_, r in p.edges}), len(p.nodes), sorted({r for *_, r in p.absent}))
    kind = "struct<types: array<int>, relations: array<string>, size: int, absent: array<string>>"
    df = spark.createDataFrame([(row(x), row(y)) for x in (a, b) for y in (a, b)], f"a {kind}, b {kind}")
    got = [r["similarity"] for r in matching.pattern_similarities(df).collect()]
    assert got == pytest.approx([matching.pattern_similarity(x, y) for x in (a, b) for y in (a, b)]) and got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.4 * 2 / 3 + 0.3 / 2 + 0.2 * 2 / 3)


def test_depth_in_a_trace(spark):
    rows = [("t", 5), ("t", 7), ("t", 7), ("t", 9), ("one", 3)]
    got = sorted(tuple(r) for r in matching.trace_depth(spark.createDataFrame(rows, "trace string, frame int"), "trace", "frame").collect())
    assert got == [("one", 3, 0.0), ("t", 5, 0.0), ("t", 7, pytest.approx(1 / 3)), ("t", 7, pytest.approx(1 / 3)), ("t", 9, 1.0)]
