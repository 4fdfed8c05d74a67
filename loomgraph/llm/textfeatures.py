"""Hashed word features of whole Arrow batches, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bytesets import _LOWER, _SPACE, _TABLE, mix, powers, runs, span_hashes
from loomgraph.plans.durable import checked_join

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of words: letters, digits and everything beyond ASCII. Other visible bytes are signs.
_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def word_and_sign_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes and runs of sign bytes in one order; run counts at the offsets."""
    ws, we, _ = runs(_WORDY[data], off)
    ss, se, _ = runs(~_WORDY[data] & ~_SPACE[data] & (data > 32), off)
    starts = np.concatenate([ws, ss])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([we, se])[order]
    return starts, ends, np.searchsorted(starts, off)


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word unigrams and bigrams (case folded, plus the words' shapes), and their row numbers."""
    starts, ends, at = word_and_sign_runs(data, off)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(at))
    w = span_hashes(_LOWER[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    caps = upper[ends] - upper[starts]
    shape = np.minimum(caps, 3) * 8 + np.minimum(ends - starts, 7) + 64 * _WORDY[data[starts]].astype(np.int64)
    shape = mix(shape.astype(np.uint64) + np.uint64(1 << 40))
    pair = rows[1:] == rows[:-1]
    two = mix(w[:-1] * _STEP + w[1:])[pair]
    two_shapes = mix(shape[:-1] * _STEP + shape[1:])[pair]
    repeated = mix(np.full(int(pair.sum()), 7, np.uint64))[w[1:][pair] == w[:-1][pair]] if len(w) else w
    same = rows[1:][pair][w[1:][pair] == w[:-1][pair]] if len(w) else rows
    return np.concatenate([w, shape, two, two_shapes, repeated]), np.concatenate([rows, rows, rows[1:][pair], rows[1:][pair], same])


def word_stems(data: np.ndarray, off: np.ndarray, lengths=(3, 4, 5, 6, 7)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole words (case folded) and of their first bytes, and their row numbers."""
    low = _LOWER[data]
    starts, ends, at = runs(_WORDY[data], off)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(at))
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[low] * up[:-1], out=sums[1:])
    out, of = [mix((sums[ends] - sums[starts]) * down[starts])], [rows]
    for k in lengths:
        longer = ends - starts > k
        s = starts[longer]
        out.append(mix((sums[s + k] - sums[s]) * down[s] + np.uint64(k)))
        of.append(rows[longer])
    return np.concatenate(out), np.concatenate(of)


def by_row(h: np.ndarray, rows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features of each row: feature, count, bounds by row."""
    key = rows.astype(np.int64) * size + (h % np.uint64(size)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key % size, count, np.searchsorted(key, np.arange(n + 1) * size)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: features of a batch are held at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the folds of the labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """About ``most`` labelled rows (text, label) at most, chosen by a hash of their id.

    Labels without a value are left out; repeated labels of one id count once.
    The sample is what a fit may look at; scoring covers every row.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, most / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < int(share * 1_000_003) + (share >= 1.0))
    return checked_join(documents.select("doc_id", "text"), chosen, "doc_id").select("doc_id", "text", "label")


def lists(values: np.ndarray, bounds: np.ndarray, kind=pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values).cast(kind))
