"""Streaming ledgers drained over small files."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import sessions
from loomgraph.streaming import ledgers as S


def source(spark, tmp_path, rows, schema):
    d = tmp_path / "in"
    d.mkdir()
    for i, part in enumerate(rows):
        (d / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))


def test_ingest_stream_upserts_versions(spark, tmp_path):
    rows = [[{"path": "a", "size": 1, "mtime": 1.0, "hash": "x"}, {"path": "b", "size": 1, "mtime": 1.0, "hash": "y"}], [{"path": "a", "size": 2, "mtime": 2.0, "hash": "z"}]]
    s = source(spark, tmp_path, rows, "path string, size long, mtime double, hash string")
    q = S.ingest_stream(s, str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["path"], r["hash"]) for r in S.ingested(spark, str(tmp_path / "state")).collect()} == {("a", "z"), ("b", "y")}


def test_changes_coalesce_by_burst(spark):
    rows = [("p", "created", 0.0), ("p", "modified", 0.1), ("p", "removed", 5.0), ("q", "created", 0.0)]
    df = spark.createDataFrame(rows, "path string, kind string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t")
    got = sorted((r["path"], r["kind"]) for r in S.coalesced_changes(df).collect())
    assert got == [("p", "modified"), ("p", "removed"), ("q", "created")]


def test_hypotheses_that_conflict(spark):
    rows = [(1, "h1", "supported", 0.9, n) for n in (1, 2, 3)] + [(2, "h2", "refuted", 0.5, n) for n in (2, 3, 4)] + [(2, "h3", "refuted", 0.8, n) for n in (1, 2)]
    df = spark.createDataFrame(rows, "trail int, hypothesis string, verdict string, confidence double, node_id long")
    assert {(r["a"], r["b"], r["winner"]) for r in sessions.hypothesis_conflicts(df).collect()} == {("h1", "h2", "h1"), ("h1", "h3", "unresolved")}
