"""What the findings of round 4 named, each on a small table."""

import functools
import itertools
import operator

import duckdb
from pyspark.sql import functions as F

from loomgraph.operators import lookups


def _both(spark, name, folder, threads=1):
    """A query's rows and those of its SQL over the tables of a folder."""
    from loomgraph.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect(config={"threads": threads})
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(folder))
    sql = con.execute(ORACLE_SQL[name]).df()[df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted(sql.itertuples(index=False, name=None), key=repr)


def test_tremor_of_a_week_takes_all_observations(spark, tmp_path):
    values = ", ".join(f"({i}, 1706140800 + {i * 37}, 1, {i * i % 41})" for i in range(300))
    duckdb.execute(f"COPY (SELECT e AS event_id, make_timestamp(t::BIGINT * 1000000) AS ts, u AS user_id, 'view' AS event_type, v::DOUBLE AS value, '{{\"k\": 2}}' AS props FROM (VALUES {values}) x(e, t, u, v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, sql = _both(spark, "w2_tremor_7d", tmp_path)
    assert got == sql and [r[1] for r in got] == [300]
    assert [r[1] for r in _both(spark, "w1_tremor", tmp_path)[0]] == [256]


def test_tremor_drops_close_observations_of_any_number(spark):
    from loomgraph.operators.ledgers import tremor

    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "a").alias("key"), (F.floor(F.col("id") / 2) * 0.4).alias("ts"), F.lit(1.0).alias("delta"), F.lit(1).cast("long").alias("edge_events"))
    assert {r["key"]: r["n"] for r in tremor(rows).collect()} == {"a": 334, None: 334}


def test_affinities_are_added_in_the_order_of_the_file(spark, tmp_path):
    orders = list(dict.fromkeys(itertools.permutations([0.09, 0.01, 0.01, 0.01]))) + [(0.01, 0.05, 0.03), (0.03,), (0.01, 0.0)]
    lines = [(3 * i + 1, x, 10.0) for i, o in enumerate(orders) for x in o] + [(3, x, 8.0) for x in (0.0, 0.01)]
    spark.createDataFrame(lines, "l_orderkey long, l_discount double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    got, sql = _both(spark, "a20_affinity", tmp_path)
    assert got == sql and 0 < len(got) < len(orders)


def test_inhibition_is_added_in_turn(spark):
    from loomgraph.operators.activation import wavefront
    from loomgraph.operators.graph import PropertyGraph

    n = spark.createDataFrame([(i,) for i in range(10)], "node_id long")
    seeds = spark.createDataFrame([(i, 1.0) for i in range(4)], "node_id long, score double")
    seen = set()
    for order in itertools.permutations([0.05, 0.06, 0.11]):
        edges = [(0, 9, "r", 0.11, False, 0)] + [(s, 9, "r", w, True, order.index(w)) for s, w in ((1, 0.05), (2, 0.06), (3, 0.11))]
        e = spark.createDataFrame(edges, "src long, dst long, relation string, weight double, inhibitory boolean, turn long").withColumn("direction", F.lit(0))
        left = 1.0 * 0.11 * 0.55
        down = functools.reduce(operator.add, [1.0 * w * 0.55 * 0.5 for w in order])
        got = [r[1] for r in wavefront(PropertyGraph(n, e), seeds, 1, turn="turn").where("node_id = 9").collect()]
        assert got == ([left - down] if left > down else [])
        seen.add(bool(got))
    assert seen == {True, False}


def test_millions_are_rounded_as_in_the_sql(spark):
    from loomgraph.operators.graph import scaled6

    xs = [0.08851149999999999, 0.0885115, 0.08851150000000002, 0.0254705, 0.02547049999999999, 1.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scaled6("x")).collect()]
    assert got == [duckdb.execute(f"SELECT round({x!r}::DOUBLE, 6)").fetchone()[0] for x in xs]


def test_walks_leave_one_table_of_walkers(spark):
    from loomgraph.operators import walks
    from loomgraph.plans import durable

    edges = spark.createDataFrame([(i, (i * 7 + k) % 30, 1.0) for i in range(30) for k in range(1, 4)], "src long, dst long, weight double")
    before = {path for _, path in durable._made}
    out = walks.random_walks(spark.range(30).withColumnRenamed("id", "node_id"), edges, 2, 9)
    made = [path for _, path in durable._made if path not in before]
    assert sum("/walkers-" in p for p in made) == 1 and not any("/walk-weights-" in p for p in made)
    pairs = walks.co_occurrence(out)
    want = lookups.ppmi(pairs).join(pairs, ["a", "b"]).groupBy("a").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"), F.round(F.sum("ppmi"), 9).alias("ppmi"))
    for size in (1 << 25, 300):
        got = walks.information(out, 4, size).select("a", "pairs", "n", F.round("ppmi", 9))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
