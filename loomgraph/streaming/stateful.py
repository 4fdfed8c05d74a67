"""Keyed state of its own kinds: rings, heat and bursts with timers, and sinks that are tables.

The processors keep list and value state behind ``transformWithStateInPandas``:
a ring is a list state and not one growing value, state that nobody touches goes
by its time to live, and a burst is closed by a timer when nothing more comes for
its path.  State lives in RocksDB, so it may be larger than an executor's heap,
and its checkpoints are in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of the streams that start inside is kept by RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Ring(StatefulProcessor):
    """The newest ``size`` observations of a key; out come their number, the newest time and the mean after each batch."""

    def __init__(self, size: int, ttl_ms: int | None):
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ts double, delta double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.kept.get()] if self.kept.exists() else []
        before = len(held)
        new = [(float(t), float(d)) for b in rows for t, d in zip(b["ts"], b["delta"], strict=True)]
        held = sorted(held + new)[-self.size :]
        if before + len(new) <= self.size:
            self.kept.appendList(new)  # nothing is evicted: only what is new is written
        else:
            self.kept.put(held)
        yield pd.DataFrame({"key": [key[0]], "n": [len(held)], "newest": [held[-1][0]], "mean_delta": [float(np.mean([d for _, d in held]))]})

    def close(self) -> None:
        """Nothing is open."""


def observation_ring(observations: DataFrame, size: int = 256, ttl_ms: int | None = None) -> DataFrame:
    """(key, n, newest, mean_delta) of the newest ``size`` observations of each key (key, ts, delta), after each batch.

    ``ttl_ms``: observations that are older than so many milliseconds of
    processing time are forgotten (such a stream has batches without end, so it is
    stopped and not drained).  Ties in time go by the delta.
    """
    return observations.groupBy("key").transformWithStateInPandas(Ring(size, ttl_ms), "key long, n long, newest double, mean_delta double", "Update", "ProcessingTime" if ttl_ms else "None")


class Heat(StatefulProcessor):
    """Heat of a node, less by a factor for each batch that sees it."""

    def __init__(self, decay: float, most: float, ttl_ms: int | None):
        self.decay, self.most, self.ttl_ms = decay, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("heat", "heat double, n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        heat, n = self.state.get() if self.state.exists() else (0.0, 0)
        heat *= self.decay
        for b in rows:
            heat += float((np.log1p(b["count"].astype(float)) * (1 + b["duration_us"].astype(float) / 1e6)).sum())
            n += int(b["count"].sum())
        heat = min(heat, self.most)
        self.state.update((heat, n))
        yield pd.DataFrame({"node": [key[0]], "heat": [heat], "invocations": [n]})

    def close(self) -> None:
        """Nothing is open."""


def span_heat(spans: DataFrame, decay: float = 0.9, most: float = 10.0, ttl_ms: int | None = None) -> DataFrame:
    """(node, heat, invocations) after each batch; ``ttl_ms``: a node that no span touches for so long starts anew."""
    return spans.groupBy("node").transformWithStateInPandas(Heat(decay, most, ttl_ms), "node string, heat double, invocations long", "Update", "ProcessingTime" if ttl_ms else "None")


class Burst(StatefulProcessor):
    """Changes of a path that follow each other within a gap; a timer at the last one's time and the gap closes it."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "kind string, first long, last long, n long")

    def _closed(self, path: str, burst: tuple) -> dict:
        kind, first, last, n = burst
        return {"path": path, "kind": kind, "first_ms": first, "last_ms": last, "n": n}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(ms), str(k)) for b in rows for ms, k in zip(b["ms"], b["kind"], strict=True))
        burst, out = (tuple(self.open.get()) if self.open.exists() else None), []
        timer = burst and burst[2] + self.gap
        for ms, kind in new:
            if burst is not None and burst[1] - self.gap < ms < burst[2] + self.gap:
                burst = (kind if ms >= burst[2] else burst[0], min(ms, burst[1]), max(ms, burst[2]), burst[3] + 1)
            else:
                if burst is not None:
                    out.append(self._closed(key[0], burst))
                burst = (kind, ms, ms, 1)
        self.open.update(burst)
        if timer != burst[2] + self.gap:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(burst[2] + self.gap)
        yield pd.DataFrame(out, columns=["path", "kind", "first_ms", "last_ms", "n"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            burst = tuple(self.open.get())
            self.open.clear()
            yield pd.DataFrame([self._closed(key[0], burst)])

    def close(self) -> None:
        """Nothing is open."""


def bursts(changes: DataFrame, gap_ms: int = 200, late: str = "1 minute") -> DataFrame:
    """(path, kind, first_ms, last_ms, n) of each burst of changes (path, kind, ts a timestamp) when it is over.

    The last kind wins (of one millisecond, the last by name).  A burst is over
    when a change of its path comes at least ``gap_ms`` later, or when the
    watermark, ``late`` behind the newest change of any path, passes its end.
    """
    rows = changes.withWatermark("ts", late).select("path", "kind", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("path").transformWithStateInPandas(Burst(gap_ms), "path string, kind string, first_ms long, last_ms long, n long", "Append", "EventTime")


def into_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream whose batches are tables ``batch=<n>`` below ``path``: a batch that runs again writes the same one again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, schema, keys: list[str] | None = None) -> DataFrame:
    """The table of :func:`into_table`: all rows, or of each key the row of its last batch (``keys``)."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
    if keys is None:
        return rows.drop("batch")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")
