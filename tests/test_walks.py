"""Random walks against a plain walker, and their co-occurrence against plain counts."""

import hashlib
import random
from collections import Counter

from loomgraph.operators import lookups, walks


def draw(seed, start, walk, step, what):
    return int(hashlib.md5(f"{seed}:{start}:{walk}:{step}{what}".encode()).hexdigest()[:8], 16) / 2**32


def plain_walk(edges, seed, start, walk, steps):
    path = [start]
    for k in range(steps):
        out = Counter()
        for a, b, w in edges:
            if a == path[-1] and w > 0:
                out[b] += w
        if not out:
            break
        x, upto = draw(seed, start, walk, k, "e") * sum(out[b] for b in sorted(out)), 0.0
        for b in sorted(out):
            upto += out[b]
            if upto > x:
                break
        path.append(b)
    return path


def tables(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "node_id long"), spark.createDataFrame(edges, "src long, dst long, weight double")


def test_walks_are_those_of_a_plain_walker(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(12), rng.randrange(15), rng.choice([0.0, 0.5, 1.0, 2.0])) for _ in range(60)]
    got = {(r["start"], r["walk"]): r["path"] for r in walks.random_walks(*tables(spark, 15, edges), 3, 7, 9).collect()}
    assert got == {(s, w): plain_walk(edges, 9, s, w, 7) for s in range(15) for w in range(3)}
    again = {(r["start"], r["walk"]): r["path"] for r in walks.random_walks(*tables(spark, 15, edges[::-1]), 3, 7, 9).repartition(5).collect()}
    assert again == got and got != {(r["start"], r["walk"]): r["path"] for r in walks.random_walks(*tables(spark, 15, edges), 3, 7, 10).collect()}


def test_hubs_are_dealt_into_buckets_and_weights_count(spark, monkeypatch):
    monkeypatch.setattr(walks, "ENTRIES", 4)
    edges = [(0, i, 3.0 if i == 7 else 1.0) for i in range(1, 31)] + [(i, 0, 1.0) for i in range(1, 31)]
    nodes, e = tables(spark, 31, edges)
    own, targets = walks.step_tables(e)
    assert own.where("node = 0").selectExpr("size(buckets) AS k").first()["k"] > 3 and targets.where("node = 0").selectExpr("sum(size(edges)) AS k").first()["k"] == 30
    met = Counter(p for r in walks.random_walks(nodes.where("node_id = 0"), e, 600, 2, 5).collect() for p in r["path"][1:2])
    assert sum(met.values()) == 600 and len(met) == 30 and 30 <= met[7] <= 95 and max(v for k, v in met.items() if k != 7) < 45


def test_co_occurrence_counts_both_ways_inside_the_window(spark):
    paths = [[1, 2, 3, 1, 4, 5], [2], [2, 2, 3]]
    df = spark.createDataFrame([(p[0], i, p) for i, p in enumerate(paths)], "start long, walk int, path array<long>")
    want = Counter()
    for p in paths:
        for i in range(len(p)):
            for j in range(len(p)):
                if 1 <= abs(i - j) <= 2 and p[i] != p[j]:
                    want[p[i], p[j]] += 1
    got = walks.co_occurrence(df, 2)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == dict(want)
    assert lookups.ppmi(got).count() > 0


def test_walks_of_no_nodes_and_no_edges(spark):
    nodes, e = tables(spark, 2, [(0, 1, 1.0)])
    assert walks.random_walks(nodes.limit(0), e).count() == 0
    assert [r["path"] for r in walks.random_walks(nodes, e.limit(0), 1).orderBy("start").collect()] == [[0], [1]]
