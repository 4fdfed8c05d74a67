"""What the findings of round 3 named, each on a small table."""

import itertools
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import matching, topology
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans.durable import stored


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def _graph(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "node_id long, node_type int").withColumns({"label": F.lit("x"), "tags": F.array().cast("array<string>")})
    e = spark.createDataFrame(edges, "src long, dst long, relation string, weight double").withColumns({"direction": F.lit(0)})
    return PropertyGraph(n, e)


def test_stored_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files are left")


def test_louvain_in_passes(spark):
    edges = [(a, b, "r", 1.0) for c in (0, 10, 20) for a, b in itertools.combinations(range(c, c + 5), 2)] + [(4, 10, "r", 0.1), (14, 20, "r", 0.1)]
    g = _graph(spark, [(c + i, 1) for c in (0, 10, 20) for i in range(5)] + [(99, 1)], edges)
    one, many = (sorted(map(tuple, topology.louvain(g, 10, True, n).collect())) for n in (1 << 22, 5))
    assert one == many and len({c for _, c, _ in one}) == 4


def test_modularity_in_one_pass(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(topology, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    g = _graph(spark, [(i, 1) for i in range(4)], [(0, 1, "r", 1.0), (1, 0, "r", 0.5), (2, 3, "r", 1.0), (1, 2, "r", 1.0), (3, 3, "r", 1.0)])
    q = topology.modularity(g, spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node_id long, community long")).first()[0]
    assert q == pytest.approx(5 / 7 - (9 + 16) / 49)
    assert sum(plans[0].count(join) for join in ("SortMergeJoin", "HashJoin")) == 2


def test_separate_parts_are_counted_without_pairs(spark, monkeypatch):
    def never(*_):
        raise AssertionError("bindings are paired")

    monkeypatch.setattr(matching, "salted_join", never)
    nodes = [(i, 1 + i % 2) for i in range(8)]
    edges = [(0, 1, "r", 1.0), (0, 3, "r", 1.0), (2, 1, "r", 1.0), (1, 2, "s", 1.0), (3, 4, "s", 1.0), (0, 1, "s", 1.0), (0, 1, "s", 0.5), (5, 6, "s", 1.0), (4, 5, "r", 1.0)]
    g = _graph(spark, nodes, edges)
    for kinds in ([None] * 4, [1, 2, None, None], [1, 2, 1, None]):
        p = matching.Pattern("apart", [{"node_type": k} for k in kinds], [(0, 1, "r"), (2, 3, "s")])
        type_of = dict(nodes)
        fits = lambda i, n: kinds[i] is None or kinds[i] == type_of[n]  # noqa: B023, E731
        steps = {r: {(a, b) for a, b, q, _ in edges if q == r} for r in "rs"}
        found = [(a, b, c, d) for a, b in steps["r"] for c, d in steps["s"] if len({a, b, c, d}) == 4 and all(map(fits, range(4), (a, b, c, d)))]
        assert tuple(matching.match_count(g, p).first()) == (len(found), min((f[0] for f in found), default=None))


def test_crossref_works_by_line():
    from loomgraph.sources.records import crossref

    text = '{"message": {"DOI": "10.1/A"}}\n{"message": {"DOI": "10.1/B", "author": [{"family": "Li"}]}}\n'
    assert {r[0] for r in crossref("x", text)} == {"doi::10.1/a", "doi::10.1/b"}
    assert list(crossref("x", "no json")) == [] == list(crossref("x", "no\njson"))


def test_tremor_keeps_close_observations_and_has_no_slope_of_one(spark):
    from loomgraph.operators.ledgers import tremor

    rows = spark.createDataFrame([("a", 0.0, 1.0, 1), ("a", 0.5, 4.0, 1), ("a", 9.0, 2.0, 1)], "key string, ts double, delta double, edge_events long")
    assert tremor(rows).count() == 0
    got = tremor(rows, least_gap=0.0).first()
    assert got["n"] == 3 and got["slope"] != got["slope"] and got["mean_acceleration"] == pytest.approx((2 / 8.5 - 4) / 8.5)


def test_affinity_of_the_least_confidence_stays(spark):
    from loomgraph.operators.text import affinity_confidence

    assert spark.range(1).select(affinity_confidence([F.lit(0.15 - 1e-16)])).first()[0] == pytest.approx(0.15)
    assert spark.range(1).select(affinity_confidence([F.lit(0.1499999)])).first()[0] is None


def test_inhibition_that_takes_all_leaves_nothing(spark):
    from loomgraph.operators.activation import wavefront

    edges = [(0, 9, "r", 0.3, False)] + [(s, 9, "r", w, True) for s, w in ((1, 0.1), (2, 0.2), (3, 0.3))]
    n = spark.createDataFrame([(i,) for i in range(10)], "node_id long")
    e = spark.createDataFrame(edges, "src long, dst long, relation string, weight double, inhibitory boolean").withColumn("direction", F.lit(0))
    seeds = spark.createDataFrame([(i, 1.0) for i in range(4)], "node_id long, score double")
    assert not wavefront(PropertyGraph(n, e), seeds, 1).where("node_id = 9").count()


def test_walks_do_not_depend_on_buckets(spark, monkeypatch):
    from loomgraph.operators import walks

    edges = spark.createDataFrame([(0, i, 1.0 + i % 3) for i in range(1, 41)] + [(i, 0, 1.0) for i in range(1, 41)], "src long, dst long, weight double")
    nodes, got = spark.range(41).withColumnRenamed("id", "node_id"), []
    for entries in (1000, 7):
        monkeypatch.setattr(walks, "ENTRIES", entries)
        got.append(sorted((r["start"], r["walk"], tuple(r["path"])) for r in walks.random_walks(nodes, edges, 2, 6).collect()))
    assert got[0] == got[1]


def _maxima(spark, con, folder, rows):
    """What w5_local_maxima finds in events of (event_id, day, user_id, value), dealt as listed, and what its SQL finds in their order."""
    from loomgraph.queries import ORACLE_SQL, QUERIES

    at = F.when(F.col("day").isNotNull(), F.timestamp_seconds(F.col("day") * 86400))
    e = spark.createDataFrame(rows, "event_id long, day long, user_id long, value double").select("event_id", at.cast("timestamp_ntz").alias("ts"), "user_id", "value")
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM (SELECT * FROM '{folder}/events.parquet/*.parquet' ORDER BY event_id)")
    return sorted(map(tuple, QUERIES["w5_local_maxima"](spark, str(folder)).collect()), key=repr), sorted(con.execute(ORACLE_SQL["w5_local_maxima"]).fetchall(), key=repr)


def test_local_maxima_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    con = duckdb.connect(config={"threads": 1})
    around = [(1, 10, u, 0.6) for u in (7, None)] + [(9, 12, u, 0.5) for u in (7, None)]
    for i, three in enumerate(itertools.permutations([(2, 0.1), (3, 0.2), (4, 0.3)])):
        got, sql = _maxima(spark, con, tmp_path / str(i), around + [(k, 11, u, x) for u in (7, None) for k, x in three])
        assert got == sql == [(7, 11, 0.6), (None, 11, 0.6)]


def test_local_maxima_take_rows_without_time_last(spark, tmp_path):
    rows = [(0, None, 1, 9.0), (1, 1, 1, 3.0), (2, 2, 1, 2.0), (3, 3, 1, 10.0), (4, 1, 2, 1.0), (5, 2, 2, None), (6, 3, 2, float("nan")), (7, 4, 2, 5.0), (8, 1, 3, 1.0), (9, 2, 3, float("nan")), (10, 3, 3, float("inf"))]
    got, sql = _maxima(spark, duckdb.connect(), tmp_path, rows)
    assert list(map(repr, got)) == list(map(repr, sql)) and (1, 3, 10.0) in got
