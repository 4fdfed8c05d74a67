"""Vectorised hashing of words over whole Arrow batches of text.

A batch's UTF-8 bytes are one array; a word's 64-bit hash is a difference of
prefix sums of ``table[byte] * p**position`` (arithmetic modulo 2**64, ``p``
odd), so hashing costs a few array operations for a batch, no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once, so that a task's memory does not follow its input.
CHUNK_BYTES = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array (nulls are empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("").cast(pa.large_string())
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off


def chunks(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about CHUNK_BYTES."""
    data, off = columns(array)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
        yield at, min(end, n), data[off[at] : off[min(end, n)]], off[at : min(end, n) + 1] - off[at]
        at = min(end, n)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that do not cross rows; run counts at the offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z in lower case; words' bounds by row."""
    data = _LOWER[data]
    starts, ends, at = runs(~_SPACE[data], off)
    return span_hashes(data, starts, ends), at


def shingle_sets(array: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its word shingles.

    Fewer than ``width`` words: the whole sequence as one; no word, null or no
    text: empty.
    """
    for _, _, data, off in chunks(array):
        w, at = words(data, off)
        n = max(0, len(w) - width + 1)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = total * _STEP + w[j : j + n]
        total = mix(total)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                s = total[a : b - width + 1]
                s = np.sort(s)
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(a, b):
                    short = mix(short * _STEP + w[i : i + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)
