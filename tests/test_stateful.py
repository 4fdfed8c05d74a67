"""Rings, heat and bursts in keyed state, over small files that come one in a batch."""

import datetime
import json
import time

import pytest

from loomgraph.streaming import stateful as S


def batches(spark, tmp_path, parts, schema):
    d = tmp_path / "in"
    d.mkdir()
    for i, part in enumerate(parts):
        (d / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
        time.sleep(0.02)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))


def run(spark, tmp_path, df, mode, clock=0):
    """``clock``: rows after which a stream is stopped whose state looks at the time, and so asks for batches without end."""
    schema = df.schema
    with S.rocksdb(spark):
        out = S.into_table(df, str(tmp_path / "out"), str(tmp_path / "cp"), mode)
        if clock:
            q, until = out.trigger(processingTime="100 milliseconds").start(), time.time() + 60
            while sum(p["numInputRows"] for p in q.recentProgress) < clock and time.time() < until:
                time.sleep(0.2)
            q.stop()
        else:
            assert out.trigger(availableNow=True).start().awaitTermination(90)
    return lambda keys=None: S.latest(spark, str(tmp_path / "out"), schema, keys)


def test_ring_evicts_the_oldest(spark, tmp_path):
    parts = [[{"key": 1, "ts": float(t), "delta": float(t)} for t in range(i, i + 100)] + [{"key": 2, "ts": float(i), "delta": 1.0}] for i in (0, 100, 200, 300)]
    read = run(spark, tmp_path, S.observation_ring(batches(spark, tmp_path, parts, "key long, ts double, delta double"), 256), "update")
    rows = {r["key"]: r for r in read(["key"]).collect()}
    assert (rows[1]["n"], rows[1]["newest"], rows[1]["mean_delta"]) == (256, 399.0, sum(range(144, 400)) / 256)
    assert (rows[2]["n"], rows[2]["newest"]) == (4, 300.0)
    assert sorted(r["n"] for r in read().where("key = 1").collect()) == [100, 200, 256, 256]


def test_ring_takes_late_observations_in_their_place(spark, tmp_path):
    parts = [[{"key": 1, "ts": t, "delta": t}] for t in (5.0, 9.0, 1.0, 7.0)]
    read = run(spark, tmp_path, S.observation_ring(batches(spark, tmp_path, parts, "key long, ts double, delta double"), 2, ttl_ms=3_600_000), "update", clock=4)
    row = read(["key"]).first()
    assert (row["n"], row["newest"], row["mean_delta"]) == (2, 9.0, 8.0)


def test_heat_decays_with_each_batch(spark, tmp_path):
    parts = [[{"node": "a", "count": 1, "duration_us": 0}], [{"node": "a", "count": 1, "duration_us": 0}, {"node": "b", "count": 10**9, "duration_us": 10**7}]]
    read = run(spark, tmp_path, S.span_heat(batches(spark, tmp_path, parts, "node string, count long, duration_us long")), "update")
    rows = {r["node"]: r for r in read(["node"]).collect()}
    assert rows["a"]["heat"] == pytest.approx(0.6931471805599453 * 1.9) and rows["a"]["invocations"] == 2 and rows["b"]["heat"] == 10.0


def at(ms):
    return (datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=ms)).isoformat()


def test_a_burst_is_closed_by_its_timer(spark, tmp_path):
    """No later change of p comes: the watermark that q moves closes it."""
    parts = [
        [{"path": "p", "kind": "created", "ts": at(0)}, {"path": "p", "kind": "modified", "ts": at(150)}],
        [{"path": "p", "kind": "removed", "ts": at(300)}, {"path": "q", "kind": "created", "ts": at(300)}],
        [{"path": "q", "kind": "modified", "ts": at(60_000)}],
        [{"path": "q", "kind": "removed", "ts": at(200_000)}],
    ]
    read = run(spark, tmp_path, S.bursts(batches(spark, tmp_path, parts, "path string, kind string, ts timestamp"), 200, "1 second"), "append")
    base = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp() * 1000)
    got = sorted((r["path"], r["kind"], r["first_ms"] - base, r["last_ms"] - base, r["n"]) for r in read().collect())
    assert got == [("p", "removed", 0, 300, 3), ("q", "created", 300, 300, 1), ("q", "modified", 60_000, 60_000, 1)]


def test_a_stream_that_stops_goes_on_from_its_state(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    df = S.observation_ring(spark.readStream.schema("key long, ts double, delta double").json(str(d)), 3)
    for t in range(5):
        (d / f"{t}.json").write_text(json.dumps({"key": 1, "ts": float(t), "delta": float(t)}))
        read = run(spark, tmp_path, df, "update")
    assert [r["mean_delta"] for r in read().orderBy("newest").collect()] == [0.0, 0.5, 1.0, 2.0, 3.0]
