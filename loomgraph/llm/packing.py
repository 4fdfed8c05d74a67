"""Packing tokenised documents into sequences by bin completion.

A document is its token ids and one end id.  Documents longer than a sequence
are cut so that only the first piece may be short of a full sequence.  What is
to pack is then a histogram of at most ``capacity`` piece lengths, whatever the
number of documents: the plan is made on it by branch and bound (fill the room
that the longest piece leaves with an undominated set of other lengths, prune
by the waste that fewer sequences than the incumbent's leave, begin from
best-fit plans), and fillings are used as often as the counts allow first.
Pieces then find their place by their rank among pieces of equal length.

Nulls: a null text is the empty text, one piece of the end id alone; a row
without doc_id is packed like any other.  Very long texts: a text is encoded
whole and gives one row for each 2048 ids.  Ties are broken by doc_id and
piece; equal rows are packed each for itself.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.durable import arrow_rows, global_rank, stored

CAPACITY = 2048
END_ID = 0
#: Documents of a batch that is tokenised.
ROWS_A_BATCH = 1000
#: Nodes that the search for a plan of fewer sequences may visit (None: all), and how many a sequence's first filling counts for.
PLAN_NODES, STEP_NODES = 2_000_000, 100
_LONG = re.compile(r"\S{3000}|\s{3000}")
_encoders: dict[str, tuple] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    """Text to an array of ids, equal to the tokenizers library's for ``path``.

    The rank file beside the vocabulary gives the same ids several times
    faster; texts with very long unbroken runs go to the library itself, whose
    merging does not grow with the square of a run.
    """
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        quick = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if quick is None or _LONG.search(text):
                return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
            return quick.encode_to_numpy(text, disallowed_special=())

        _encoders[path] = encode
    return _encoders[path]


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    path = path or vocabulary()
    end = np.array([END_ID], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4")
                n, at, k = len(ids), 0, 0
                step = n % capacity or capacity
                while at < n:
                    part = ids[at : at + step]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
                    at, k, step = at + step, k + 1, capacity
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _reachable(sizes: list[int], number: list[int], room: int) -> list[int]:
    """Bit ``t`` of entry ``j``: whether some of ``sizes[j:]``, as often as there are any, sum to ``t`` (at most ``room``)."""
    full = (1 << (room + 1)) - 1
    out = [1]
    for size, n in zip(reversed(sizes), reversed(number), strict=True):
        sums, n, k = out[-1], min(n, room // size), 1
        while n:  # copies by powers of two
            k = min(k, n)
            sums |= (sums << (k * size)) & full
            n, k = n - k, 2 * k
        out.append(sums)
    return out[::-1]


def _available(room: int, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Lengths that fit into ``room``, longest first, and their numbers."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0][::-1]
    return have.tolist(), counts[have].tolist()


def completion(room: int, counts: np.ndarray) -> list[int]:
    """Lengths (longest first) that fill ``room`` with the least waste; among such fillings the one of longest pieces.

    The sums that lengths can still reach bound the waste exactly, so the search
    never turns back, whatever the number of pieces.
    """
    sizes, number = _available(room, counts)
    reach = _reachable(sizes, number, room)
    left, chosen = reach[0].bit_length() - 1, []
    for j, size in enumerate(sizes):
        m = min(number[j], left // size)
        while not reach[j + 1] >> (left - m * size) & 1:
            m -= 1
        chosen += [size] * m
        left -= m * size
    return chosen


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on the histogram: a piece goes where it leaves the least room."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}  # by room
    rooms = [capacity]
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n and size:
            at = bisect.bisect_left(rooms, size)
            room = rooms[at]
            held, k = open_bins[room].pop() if open_bins[room] else ((), n)
            m = min(room // size, n)  # the bin that has got a piece has the least room for the next one
            bins = min(k, n // m)
            n -= bins * m
            if room != capacity and k > bins:
                open_bins[room].append((held, k - bins))
            if room != capacity and not open_bins[room]:
                del open_bins[room], rooms[at]
            after = room - m * size
            if after not in open_bins:
                open_bins[after] = []
                bisect.insort(rooms, after)
            open_bins[after].append((held + (size,) * m, bins))
    return [(list(held), n) for bins in open_bins.values() for held, n in bins]


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the sequences (Martello and Toth's second): tokens, and pieces too long to share one."""
    size = np.arange(capacity + 1)
    n, tokens = np.cumsum(counts), np.cumsum(counts * size)
    least = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        alone, big = int(n[-1] - n[capacity - k]), int(n[capacity - k] - n[half])
        free = big * capacity - int(tokens[capacity - k] - tokens[half])
        small = int(tokens[half] - (tokens[k - 1] if k else 0))
        least = max(least, alone + big + max(0, -(-(small - free) // capacity)))
    return least


def _step(counts: np.ndarray, chosen: list[int]) -> int:
    """How often the counts allow a filling."""
    return min(int(counts[s]) // chosen.count(s) for s in set(chosen))


def greedy(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """For the longest piece left its filling of least waste, as often as the counts allow."""
    counts = counts.copy()
    out: list[tuple[list[int], int]] = []
    top = capacity
    while True:
        while top > 0 and not counts[top]:
            top -= 1
        if not top:
            return out
        counts[top] -= 1
        rest = completion(capacity - top, counts)
        counts[top] += 1
        chosen = [top, *rest]
        times = _step(counts, chosen)
        for s in chosen:
            counts[s] -= times
        out.append((chosen, times))


def _dominated(chosen: list[int], waste: int, left: int) -> bool:
    """Whether one piece left over (a bit of ``left``) could take the place of some of the chosen ones.

    It may be longer than they are together by up to the waste, or as long as
    two or more of them: what it sets free is easier to place than it is.
    """
    any_sum, of_two = 1, 0
    for size in chosen:
        of_two |= (of_two | (any_sum & ~1)) << size
        any_sum |= any_sum << size
    longer, k = any_sum << 1 if waste else 0, 1
    while k < waste:  # sums plus 1 to waste
        step = min(k, waste - k)
        longer |= longer << step
        k += step
    return bool((longer | of_two) & left)


def _fillings(room: int, counts: np.ndarray, slack: int, spent: list[float]) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` that waste at most ``slack``, longest pieces first.

    A branch is entered only if what is left of the lengths can still fill all
    but the slack.  A level is a length and how often it is taken, so that the
    depth is at most the square root of twice the room.
    """
    sizes, number = _available(room, counts)
    reach = _reachable(sizes, number, room)

    def open_at(room: int, j: int) -> int:
        return reach[j] >> max(0, room - slack) & ((1 << (min(room, slack) + 1)) - 1)

    def search(room: int, i: int) -> Iterator[list[int]]:
        for j in range(i, len(sizes)):
            if spent[0] <= 0 or not open_at(room, j):
                return
            for m in range(min(number[j], room // sizes[j]), 0, -1):
                rest = room - m * sizes[j]
                if open_at(rest, j + 1):
                    spent[0] -= 1
                    for more in search(rest, j + 1):
                        yield [sizes[j]] * m + more
        if room <= slack:
            yield []

    for chosen in search(room, 0):
        left = counts.copy()
        np.subtract.at(left, chosen, 1)
        free = sum(1 << k for k in np.flatnonzero(left[: room + 1]).tolist() if k)
        if not _dominated(chosen, room - sum(chosen), free):
            yield chosen


def _packing(counts: np.ndarray, bins: int, capacity: int, spent: list[float]) -> list[tuple[list[int], int]] | None:
    """A plan of at most ``bins`` sequences, or None if there is none or ``spent`` is used up.

    Depth first over the fillings of the longest piece left; a branch ends once
    its sequences waste more than ``bins`` sequences can.
    """
    counts = counts.copy()

    def branches(slack: int) -> Iterator[tuple[list[int], int]]:
        top = int(np.flatnonzero(counts)[-1])

        def uses(rest: list[int]) -> Iterator[tuple[list[int], int]]:
            chosen, waste = [top, *rest], capacity - top - sum(rest)
            times = min(_step(counts, chosen), slack // waste if waste else bins)
            yield from ((chosen, t) for t in ((times, 1) if times > 1 else (1,) if times else ()))

        counts[top] -= 1
        first = completion(capacity - top, counts)
        free = counts.copy()
        counts[top] += 1
        spent[0] -= STEP_NODES
        yield from uses(first)
        for rest in _fillings(capacity - top, free, slack, spent):
            if rest != first:
                yield from uses(rest)

    done: list[tuple[list[int], int]] = []
    slack = bins * capacity - int((counts * np.arange(len(counts))).sum())
    if slack < 0:
        return None
    if not counts.any():
        return done
    stack = [branches(slack)]
    while stack:
        if spent[0] <= 0:
            return None
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            if done:
                chosen, times = done.pop()
                np.add.at(counts, chosen, times)
                slack += times * (capacity - sum(chosen))
            continue
        chosen, times = branch
        np.subtract.at(counts, chosen, times)
        slack -= times * (capacity - sum(chosen))
        done.append(branch)
        if not counts.any():
            return done
        stack.append(branches(slack))
    return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY, nodes: int | None = PLAN_NODES) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used; every piece is placed once.

    While the incumbent (best-fit decreasing, or the greedy completion if that
    is better) needs more than the lower bound, one sequence fewer is searched
    for.  ``nodes`` bounds that search; with None it goes on until the plan is
    proved to be least.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in lengths.items():
        counts[k] = n
    number = lambda p: sum(t for _, t in p)
    best, least, spent = min(greedy(counts, capacity), best_fit(counts, capacity), key=number), least_bins(counts, capacity), [math.inf if nodes is None else nodes]
    while (bins := number(best)) > least:
        fewer = _packing(counts, bins - 1, capacity, spent)
        if fewer is None:
            break
        best = fewer
    return best


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, nodes: int | None = PLAN_NODES) -> DataFrame:
    """Pieces with sequence_id and offset; a sequence holds at most ``capacity`` ids, ``nodes`` as in :func:`plan`."""
    spark = documents.sparkSession
    with arrow_rows(spark, ROWS_A_BATCH):
        held = stored(pieces(documents, path, capacity), "pieces")
    lengths = {int(r["length"]): int(r["count"]) for r in held.groupBy("length").count().collect()}  # at most `capacity` rows
    first, at = {}, 0
    for k in sorted(lengths):
        first[k], at = at, at + lengths[k]
    used = dict(first)
    steps, base = [], 0
    for chosen, times in plan(lengths, capacity, nodes):
        offset = 0
        for size in sorted(set(chosen), reverse=True):
            n = chosen.count(size)
            steps.append((used[size], n, base, offset, size))
            used[size] += n * times
            offset += n * size
        base += times
    table = np.array(sorted(steps) or [(0, 1, 0, 0, 1)], np.int64)
    sent = spark.sparkContext.broadcast(table)  # a few rows for each length: at most some ten thousand
    ranked = global_rank(held, ["length", "doc_id", "piece"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            row = t[np.searchsorted(t[:, 0], rank, "right") - 1]
            turn = rank - row[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 2] + turn // row[:, 1]), pa.array(row[:, 3] + row[:, 4] * (turn % row[:, 1]))],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    shape = ", ".join(f"{k} {t}" for k, t in ranked.dtypes[:-1])
    return ranked.mapInArrow(place, f"{shape}, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
