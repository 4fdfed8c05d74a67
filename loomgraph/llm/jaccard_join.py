"""Exact n-gram Jaccard join with set-relation skipping.

A document's set is its distinct 5-word shingles.  Two documents link if
``|A & B| / |A | B| >= 0.75``; the join returns each document's component of
links and its number of links without ever writing out all pairs of a group.

1.  Every text is read once: its set is written as 64-bit hashes, 8 bytes a
    shingle, and everything after works on those.  Equal sets are one class,
    found by their digest; only the class's first row goes on, by a row number
    (a doc_id may stand for several texts).
2.  All shingles of all documents are counted in buckets; shingles get a global
    order, rare before frequent.  A set's index entries are its first
    ``n - ceil(0.75 n) + 1`` shingles in that order.
3.  First every list's entries are compared with the list's first document
    alone.  A document so linked, or in a long list half alike (a Jaccard of 0.5), has
    it as its leader and is from then on the leader's set with some shingles taken
    out and some put in.  So near copies that do not link with each other either are
    one cluster, and their pairs are decided inside tasks and never written.
4.  Index skipping: a list is cut into blocks of one leader and one size band,
    with bounds of size and of what is left after the position.  Blocks meet
    only if one of them is within the first seventh of its sets, and in long
    lists only those of the same or the next band; others are passed over unread.
5.  Answer skipping: the links of a leader's followers are derived from their
    differences to it (``|S| - |R + R'| + |A & A'|`` for sets taken out and put in),
    and those with another leader's followers only if the leaders' overlap plus
    what both put in can reach the threshold.  Followers are packed in chunks of
    bounded size; two chunks whose bounds already decide are not compared, others
    are compared by one matrix product.

Every link is decided on the whole sets, so links and components are exact up
to collisions of 64-bit shingle hashes.  Lists, leaders and clusters may hold any share
of the rows: frequent shingles and leaders are salted by their number of rows.

Nulls: a null text, or one without a word, has an empty set and links with
nothing.  Fewer than five words: the whole sequence is the one shingle.  Very
long texts have as many shingles as words; one task holds a few sets at a time.
Repeated rows get the same component; a row without doc_id is linked like any
other, and a component of such rows alone has no id.  Rows that share a doc_id
are linked each by its own text.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bytesets import shingle_sets
from loomgraph.plans.components import connected_components
from loomgraph.plans.durable import BROADCAST_ROWS, arrow_rows, checked_join, only_kept, parts, stored

WIDTH = 5
#: The threshold 0.75 as a fraction of integers: inter / union >= NUM / DEN.
NUM, DEN = 3, 4
#: Shingles are frequent from 2**LEAST_LEVEL documents on; the level rises until at most FREQUENT are.
LEAST_LEVEL, FREQUENT = 3, 1_000_000
#: Values that a task holds before it passes them on (shingles that are counted: more, as gaps between them shrink).
HELD, COUNTED = 1 << 18, 1 << 20
#: Rows of a batch of texts or sets.
ROWS_A_BATCH = 500
#: Blocks of a list from which it is met by size bands; documents of a list from which its first one leads those half alike.
LONG_LIST = 32
#: Half alike: inter / union >= 1 / 2, that is LEAD * inter >= na + nb.
LEAD = 3
#: Rows of one shingle or leader that go to one task before they are salted; followers of a chunk, and shingles of them all.
ROWS_A_SALT, CHUNK, CELLS = 1 << 13, 1 << 11, 1 << 21
#: Shingles by which two chunks are compared at once.
SLICE = 1 << 11
_BUCKET_BITS = 20
#: Documents for each file of a table with about a row a document, and for each task that reads sets.
ROWS_A_FILE, ROWS_A_TASK = 50_000, 4_000


def _range_bits(spark: SparkSession) -> int:
    """Bits of a shingle's hash by which lists are dealt out: some ranges for each shuffle partition."""
    return max(5, (4 * parts(spark) - 1).bit_length())


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays by their byte planes: high bytes are mostly alike."""
    return zlib.compress(b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays), 1)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind)[:, 0])
        at += n * size
    return out


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - 12 - _BUCKET_BITS)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _fold(s: np.ndarray) -> bytes | None:
    """How many shingles begin with each of the first bits, a byte each; as many bits as leave one or two shingles to each."""
    bits = max(len(s).bit_length() - 1, 3)
    count = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None  # None bounds nothing


def _most_common(a: bytes | None, b: bytes | None) -> int | None:
    """At least as many as two sets share, by their folds."""
    if a is None or b is None:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    k = min(len(x), len(y))
    return int(np.minimum(x.reshape(k, -1).sum(1, dtype=np.int64), y.reshape(k, -1).sum(1, dtype=np.int64)).sum())


def set_table(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(uid, doc_id, n, d1, d2, set, fold) of every row: a row number, the set's size and digest, its sorted hashes and their fold."""
    names = ["uid", "doc_id", "n", "d1", "d2", "set", "fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            n, d1, d2, held, folds, first, size = [], [], [], [], [], 0, 0

            def rows(end: int) -> pa.RecordBatch:
                ids = np.arange(uid + first, uid + end)
                cols = [pa.array(ids), batch.column(0).slice(first, end - first), *(pa.array(c, pa.int64()) for c in (n, d1, d2)), *(pa.array(c, pa.binary()) for c in (held, folds))]
                return pa.RecordBatch.from_arrays(cols, names)

            for k, s in enumerate(shingle_sets(batch.column(1), width)):
                data = s.tobytes()
                digest = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64)
                n.append(len(s))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                held.append(data)
                folds.append(_fold(s))
                size += len(s)
                if size >= HELD:
                    yield rows(k + 1)
                    n, d1, d2, held, folds, first, size = [], [], [], [], [], k + 1, 0
            if held:
                yield rows(len(batch))
            uid += len(batch)

    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(documents.mapInArrow(run, "uid long, doc_id long, n long, d1 long, d2 long, set binary, fold binary"), "sets")


def bucket_counts(sets: DataFrame) -> DataFrame:
    """The packed counts of all shingles' buckets by range."""
    bits = _range_bits(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            v, c = np.unique(_buckets(np.concatenate(held)), return_counts=True)
            held.clear()
            where = (v >> np.uint64(12 + _BUCKET_BITS - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(where)) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(v)], strict=True):
                gaps = np.diff(v[a:b], prepend=v[a]).astype("<u4")
                out.append((int(where[a]), int(v[a]).to_bytes(8, "little") + _packed(gaps, np.minimum(c[a:b], 1 << 30).astype("<u4"))))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["range", "packed"])

        for batch in batches:
            for s in _sets(batch.column(0)):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield counts()
                    size = 0
        if size:
            yield counts()

    return sets.select("set").mapInArrow(run, "range int, packed binary")


def frequent_shingles(counts: DataFrame, files: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets that many documents share, and their levels (log2 of the documents).

    All documents are counted.  At most FREQUENT buckets are kept, the most
    frequent ones; the order of the rest does not change any result.
    """

    def total(table: pa.Table) -> pa.Table:
        v, c = [], []
        for x in table["packed"].to_pylist():
            first, (gaps, times) = int.from_bytes(x[:8], "little"), _unpacked(x[8:], "<u4", "<u4")
            v.append(np.cumsum(gaps, dtype=np.uint64) + np.uint64(first))
            c.append(times)
        v, c = np.concatenate(v), np.concatenate(c)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        v, c = v[start], np.add.reduceat(c, start)
        level = np.log2(c).astype(np.int64)
        out = []
        for k in np.unique(level[level >= LEAST_LEVEL]).tolist():
            own = v[level == k]
            out.append((k, len(own), _packed(own)))
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["level", "n", "packed"])

    levels = stored(counts.groupBy("range").applyInArrow(total, "level int, n long, packed binary"), "levels", files)
    sizes = {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least, kept = 64, 0
    for k in sorted(sizes, reverse=True):
        kept += sizes[k]
        if kept > FREQUENT:
            break
        least = k
    found = [(_unpacked(r["packed"], "<u8")[0], r["level"]) for r in levels.where(F.col("level") >= least).toLocalIterator()]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    v, level = np.concatenate([f[0] for f in found]), np.concatenate([np.full(len(f[0]), f[1], np.int8) for f in found])
    order = np.argsort(v)
    return v[order], level[order]


def entries(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], files: int) -> DataFrame:
    """Index entries (token, doc, n, pos, salts) of shingles that at least two sets have among theirs.

    Entries of rare shingles travel packed and are met by range (their lists are
    short); those of frequent shingles go out as rows, so that no task gathers a
    long list.  ``salts``: over how many keys a list is to be dealt in a join.
    """
    spark = sets.sparkSession
    bits = _range_bits(spark)
    sent = spark.sparkContext.broadcast(frequent)  # FREQUENT buckets at most
    shape = "token long, doc long, n int, pos int, salts int"
    names = [x.split()[0] for x in shape.split(", ")]
    most = ROWS_A_SALT.bit_length() - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(doc, n, rare shingles, frequent ones in their order, their levels) of each set, cut to its prefix."""
        table, levels = sent.value
        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), _sets(batch.column(1)), strict=True):
                n = len(s)
                p = n - (NUM * n + DEN - 1) // DEN + 1
                level = np.zeros(n, np.int8)
                if len(table):
                    b = _buckets(s)
                    at = np.searchsorted(table, b)
                    at[at == len(table)] = 0
                    level = np.where(table[at] == b, levels[at], level)
                rare, common, own = s[level == 0][:p], s[level > 0], level[level > 0]
                order = np.argsort(own, kind="stable")[: p - len(rare)]
                yield doc, n, rare, common[order], own[order]

    def frequent_rows(held: list[tuple]) -> pa.RecordBatch:
        docs, sizes, firsts, tokens, own = zip(*held, strict=True)
        held.clear()
        length = [len(t) for t in tokens]
        pos = np.concatenate([f + np.arange(k) for f, k in zip(firsts, length, strict=True)])
        salts = 1 << np.maximum(np.concatenate(own).astype(np.int32) - most, 0)
        cols = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(docs, np.int64), length), np.repeat(np.array(sizes, np.int32), length), pos.astype(np.int32), salts.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(pos), pa.int32()), pa.nulls(len(pos), pa.int64()), pa.nulls(len(pos), pa.binary())], [*names, "range", "base", "packed"])

    def rare_packed(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        token = np.concatenate([h[0] for h in held])
        length = [len(h[0]) for h in held]
        base = held[0][1]
        doc = np.repeat(np.array([h[1] - base for h in held], np.int64), length)  # rows of one file of sets: near each other
        n = np.repeat(np.array([h[2] for h in held], np.int32), length)
        pos = np.concatenate([np.arange(k, dtype=np.int32) for k in length])
        held.clear()
        order = np.argsort(token)
        token, doc, n, pos = token[order], doc[order], n[order], pos[order]
        where = (token >> np.uint64(64 - bits)).astype(np.int64)
        low = ((token >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        cut = np.flatnonzero(np.diff(where)) + 1
        out = [(int(where[a]), _packed(low[a:b], n[a:b], pos[a:b], doc[a:b].astype("<i8"))) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(token)], strict=True)]
        k = len(out)
        none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([*none, pa.array([o[0] for o in out], pa.int32()), pa.array([base] * k, pa.int64()), pa.array([o[1] for o in out], pa.binary())], [*names, "range", "base", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rarely, size, packed = [], [], 0, 0
        for doc, n, rare, common, own in split(batches):
            if len(common):
                often.append((doc, n, len(rare), common, own))
                size += len(common)
            if len(rare):
                rarely.append((rare, doc, n))
                packed += len(rare)
            if size >= HELD:
                yield frequent_rows(often)
                size = 0
            if packed >= HELD:
                yield rare_packed(rarely)
                packed = 0
        if often:
            yield frequent_rows(often)
        if rarely:
            yield rare_packed(rarely)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for base, x in zip(table["base"].to_pylist(), table["packed"].to_pylist(), strict=True):
            for i, got in enumerate(_unpacked(x, "<u4", "<i4", "<i4", "<i8")):
                cols[i].append(got + base if i == 3 else got)
        token, n, pos, doc = (np.concatenate(c) for c in cols)
        order = np.argsort(token, kind="stable")
        token, n, pos, doc = token[order], n[order], pos[order], doc[order]
        same = token[1:] == token[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        full = (np.int64(key[0].as_py()) << np.int64(32)) | token[shared].astype(np.int64)
        one = np.ones(int(shared.sum()), np.int32)
        return pa.table([pa.array(full), pa.array(doc[shared]), pa.array(n[shared]), pa.array(pos[shared]), pa.array(one)], names)

    both = stored(sets.select("uid", "set").mapInArrow(run, f"{shape}, range int, base long, packed binary"), "entries")
    rare = both.where("range IS NOT NULL").select("range", "base", "packed").groupBy("range").applyInArrow(meet, shape)
    return both.where("range IS NULL").select(*names).unionByName(stored(rare, "rare-entries", files))


def _fits(na: Column, ra: Column, nb: Column, rb: Column) -> Column:
    """Whether sets of these sizes, with so much left after these positions, can link."""
    return (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)) & ((NUM + DEN) * F.least(ra, rb) >= NUM * (na + nb))


def _salted(small: DataFrame, salts: str) -> DataFrame:
    """Each row once for each of its ``salts`` (a column), numbered in ``salt``."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))


def _salt(of: str, salts: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col(salts).cast("long")).cast("int")


def _joined(pairs: DataFrame, sets: DataFrame, column: str, files: int) -> DataFrame:
    """Each pair (a, b, more columns) with a column of both sets, as left and right, those of one b together."""
    times = stored(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_SALT).cast("int").alias("salts")), "ends", files)
    left = checked_join(sets.select(F.col("uid").alias("a"), F.col(column).alias("left")), checked_join(pairs, times, "b"), "a").withColumn("salt", _salt("a", "salts"))
    right = _salted(checked_join(sets.select(F.col("uid").alias("b"), F.col(column).alias("right")), times, "b"), "salts")
    return left.drop("salts").join(right.drop("salts"), ["b", "salt"])


def possible(pairs: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """The pairs (a, b) whose folds allow an overlap that, with ``extra`` more, reaches the threshold for sizes of sum ``need``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, extra, need, left, right = (c.to_pylist() for c in batch.columns)
            kept = []
            for i in range(len(a)):
                most = _most_common(left[i], right[i])
                if most is None or (NUM + DEN) * (most + extra[i]) >= NUM * need[i]:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in kept], pa.int64()) for c in (a, b)], ["a", "b"])

    joined = _joined(pairs, sets, "fold", files).select("a", "b", "extra", "need", "left", "right")
    return stored(joined.mapInArrow(run, "a long, b long"), "possible-pairs", files)


def verified(pairs: DataFrame, sets: DataFrame, files: int, differences: bool = False) -> DataFrame:
    """(a, b, na, nb, inter, diff) of each pair, counted on the whole sets; ``diff``: a as b changed, if they are half alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(0).to_pylist()
            na, nb, inter, diff = [], [], [], []
            other = batch.column(3)
            kept = np.zeros(0, np.uint64)
            for i, s in enumerate(_sets(batch.column(2))):
                if i == 0 or b[i] != b[i - 1]:
                    kept = np.frombuffer(other[i].as_py(), "<u8")
                at = np.searchsorted(kept, s)
                at[at == len(kept)] = 0
                same = kept[at] == s
                k = int(same.sum())
                na.append(len(s))
                nb.append(len(kept))
                inter.append(k)
                if differences and LEAD * k >= len(s) + len(kept):
                    out = np.ones(len(kept), bool)
                    out[at[same]] = False
                    out = np.flatnonzero(out).astype("<u4")
                    diff.append(len(out).to_bytes(4, "little") + out.tobytes() + s[~same].tobytes())
                else:
                    diff.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), *(pa.array(x, pa.int64()) for x in (na, nb, inter)), pa.array(diff, pa.binary())], ["a", "b", "na", "nb", "inter", "diff"])

    joined = _joined(pairs.select("a", "b"), sets, "set", files).select("b", "a", "left", "right").coalesce(files)
    return stored(joined.mapInArrow(run, "a long, b long, na long, nb long, inter long, diff binary"), "verified")


_LINKED = f"{DEN} * inter >= {NUM} * (na + nb - inter)"


class Chunk:
    """Some followers of a leader: documents, sizes, and what each takes out of the leader's set and puts in."""

    def __init__(self, docs: list[int], sizes: list[int], diffs: list[bytes | None]):
        self.docs, self.sizes = np.array(docs, np.int64), np.array(sizes, np.int64)
        gone, come = [], []
        for d in diffs:
            k = int.from_bytes(d[:4], "little") if d else 0
            gone.append(np.frombuffer(d, "<u4", k, 4) if d else np.zeros(0, "<u4"))
            come.append(np.frombuffer(d, "<u8", offset=4 + 4 * k) if d else np.zeros(0, "<u8"))
        self.out_n, self.in_n = np.array([len(x) for x in gone], np.int64), np.array([len(x) for x in come], np.int64)
        self.out, self.come = np.concatenate(gone).astype(np.uint64), np.concatenate(come).astype(np.uint64)

    def near(self, own: int) -> bool:
        """Whether all of them link with their leader, whose set has ``own`` shingles."""
        return bool(((NUM + DEN) * (own - self.out_n) >= NUM * (self.sizes + own)).all())

    def taken_out(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.docs)), self.out_n), self.out

    def put_in(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.docs)), self.in_n), self.come

    def whole(self, leader: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and shingles of the whole sets."""
        m, n = len(self.docs), len(leader)
        kept = np.ones((m, n), bool)
        row, at = self.taken_out()
        kept[row, at.astype(np.int64)] = False
        rows, cols = np.nonzero(kept)
        row, come = self.put_in()
        return np.concatenate([rows, row]), np.concatenate([leader[cols], come])


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], m: int, k: int) -> np.ndarray:
    """How many keys each row of x shares with each row of y: matrix products over slices of the keys that both have."""
    keys = np.intersect1d(x[1], y[1])
    total = np.zeros((m, k), np.float32)
    for a in range(0, len(keys), SLICE):
        part = keys[a : a + SLICE]
        dense = []
        for (row, key), n in ((x, m), (y, k)):
            at = np.searchsorted(part, key)
            at[at == len(part)] = 0
            hit = part[at] == key
            d = np.zeros((n, len(part)), np.float32)
            d[row[hit], at[hit]] = 1
            dense.append(d)
        total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def links_between(x: Chunk, y: Chunk, own: np.ndarray | int, other: np.ndarray | None) -> np.ndarray:
    """Whether each of x's documents links with each of y's.

    ``other`` None: both follow one leader, whose set has ``own`` shingles; the
    overlaps are derived from the differences.  Else the leaders' sets.
    """
    m, k = len(x.docs), len(y.docs)
    need = NUM * (x.sizes[:, None] + y.sizes[None, :])
    if other is not None:
        return (NUM + DEN) * _common(x.whole(own), y.whole(other), m, k) >= need
    least = own - x.out_n.max() - y.out_n.max()
    most = own - max(x.out_n.min(), y.out_n.min()) + min(x.in_n.max(), y.in_n.max())
    if (NUM + DEN) * least >= NUM * (x.sizes.max() + y.sizes.max()):
        linked = np.ones((m, k), bool)
    elif (NUM + DEN) * most < NUM * (x.sizes.min() + y.sizes.min()):
        linked = np.zeros((m, k), bool)
    else:
        inter = own - x.out_n[:, None] - y.out_n[None, :] + _common(x.taken_out(), y.taken_out(), m, k) + _common(x.put_in(), y.put_in(), m, k)
        linked = (NUM + DEN) * inter >= need
    if x is y:
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) that join what is linked: rows are 0, 1, ..., columns come after them (``same``: they are the rows)."""
    m, k = linked.shape
    rows, none = np.arange(m), m + k
    cols = rows if same else np.arange(m, m + k)
    while True:
        new_rows = np.minimum(rows, np.where(linked, cols[None, :], none).min(1)) if k else rows
        new_cols = new_rows if same else np.minimum(cols, np.where(linked, new_rows[:, None], none).min(0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    label = rows if same else np.concatenate([rows, cols])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _decided(x: Chunk, y: Chunk, own: np.ndarray | int, other: np.ndarray | None) -> list[tuple]:
    """Rows (doc, links, a, b): a document's number of links, or two linked documents, enough to join all that link.

    Followers that link with their leader are joined already.
    """
    linked = links_between(x, y, own, other)
    if not linked.any():
        return []
    out = [(int(d), int(n), None, None) for d, n in zip(x.docs, linked.sum(1), strict=True) if n]
    if x is not y:
        out += [(int(d), int(n), None, None) for d, n in zip(y.docs, linked.sum(0), strict=True) if n]
    near = x.near(own if other is None else len(own)) and y.near(own if other is None else len(other))
    if near and other is None:
        return out
    if near:
        i, j = np.unravel_index(int(linked.argmax()), linked.shape)
        return [*out, (None, None, int(x.docs[i]), int(y.docs[j]))]
    docs = x.docs if x is y else np.concatenate([x.docs, y.docs])
    return out + [(None, None, int(docs[i]), int(docs[j])) for i, j in zip(*forest(linked, x is y), strict=True)]


_COUNTED = "doc long, links long, a long, b long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "links", "a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first two columns."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:2] != r[:2]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _gathered(groups: Callable[[list[tuple]], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            out += groups(group)
            if len(out) >= HELD:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def cluster_links(members: DataFrame, pairs: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """Links of all followers, as rows of ``_COUNTED``.

    ``members``: leader, doc, n, size (of the leader's set), diff, m (followers of
    the leader).  ``pairs``: leaders a and b whose followers may link.
    """
    number = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("m") * F.col("size") / CELLS)).cast("int")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("doc"), number.cast("long")).cast("int"))
    members = stored(members.select("leader", "chunk", "doc", "n", "size", "diff", "m"), "followers", files)

    def inside(group: list[tuple]) -> list[tuple]:
        if len(group) < 2:
            return []
        x = Chunk([r[2] for r in group], [r[3] for r in group], [r[5] for r in group])
        return _decided(x, x, group[0][4], None)

    whole = members.where("m > 1").drop("m").repartition("leader", "chunk").sortWithinPartitions("leader", "chunk")
    found = whole.mapInArrow(_gathered(inside), _COUNTED)

    # chunks against other chunks: of one large cluster, or of two whose leaders are near enough
    sizes = members.groupBy("leader").agg(F.max("chunk").alias("last"), F.max("size").alias("size"))
    sizes = stored(sizes, "clusters", files)
    large = sizes.where("last > 0").select(F.col("leader").alias("a"), F.col("leader").alias("b"))
    tasks = pairs.select("a", "b").unionByName(large)
    for end in ("a", "b"):
        tasks = checked_join(tasks, sizes.select(F.col("leader").alias(end), F.col("last").alias(f"last_{end}"), F.col("size").alias(f"size_{end}")), end)
        tasks = tasks.withColumn(f"i_{end}", F.explode(F.sequence(F.lit(0), F.col(f"last_{end}"))))
    tasks = stored(tasks.where("a <> b OR i_a < i_b").select("a", "i_a", "b", "i_b", F.col("size_a").alias("size")), "chunk-pairs", files)
    if not tasks.limit(1).count():
        return stored(found, "links", files)
    needed = tasks.select(F.col("a").alias("leader"), F.col("i_a").alias("chunk")).union(tasks.select("b", "i_b")).distinct()
    packed = checked_join(members, stored(needed, "needed-chunks", files), ["leader", "chunk"], "left_semi")
    packed = packed.groupBy("leader", "chunk").agg(F.collect_list(F.struct("doc", "n", "diff")).alias("rows"))  # about CHUNK rows
    packed = stored(packed, "chunks", files)
    crossed = tasks.where("a <> b")
    ends = stored(crossed.select(F.col("a").alias("uid")).union(crossed.select("b")).distinct(), "crossed-leaders", files)
    leaders = stored(checked_join(sets.select("uid", "set"), ends, "uid", "left_semi"), "leader-sets", files)
    joined = tasks
    for end in ("a", "b"):
        joined = joined.join(packed.select(F.col("leader").alias(end), F.col("chunk").alias(f"i_{end}"), F.col("rows").alias(f"rows_{end}")), [end, f"i_{end}"])
        joined = joined.join(leaders.select(F.col("uid").alias(end), F.col("set").alias(f"set_{end}")), end, "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(value: pa.Scalar) -> Chunk:
            got = value.as_py()
            return Chunk([r["doc"] for r in got], [r["n"] for r in got], [r["diff"] for r in got])

        for batch in batches:
            out: list[tuple] = []
            a, b, size, ra, rb, sa, sb = batch.columns
            for i in range(len(batch)):
                x, y, one = chunk(ra[i]), chunk(rb[i]), a[i].as_py() == b[i].as_py()
                sets = (size[i].as_py(), None) if one else (np.frombuffer(sa[i].as_py(), "<u8"), np.frombuffer(sb[i].as_py(), "<u8"))
                out += _decided(x, y, *sets)
            yield _batch(out)

    compared = joined.select("a", "b", "size", "rows_a", "rows_b", "set_a", "set_b").mapInArrow(compare, _COUNTED)
    with arrow_rows(sets.sparkSession, 8):  # a row holds two chunks
        return stored(found.unionByName(compared), "links", files)


def linked_components(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (different texts that link), n_copies (other rows of the same set) of every row."""
    spark = documents.sparkSession
    with only_kept(spark) as kept, arrow_rows(spark, ROWS_A_BATCH):
        kept.append(stored(_linked_components(documents, width), "linked-components"))
    return kept[0]


def _linked_components(documents: DataFrame, width: int) -> DataFrame:
    table = set_table(documents, width)
    info = table.select("uid", "doc_id", "n", "d1", "d2")
    count = info.count()
    small, wide = max(1, count // ROWS_A_FILE), max(12, count // ROWS_A_TASK)
    full = info.where("n > 0")
    classes = stored(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min("uid").alias("cid"), F.count(F.lit(1)).alias("copies")), "classes", small)
    again = stored(checked_join(full, classes.where("copies > 1"), ["d1", "d2"]).where("uid <> cid").select("uid"), "copies", small)
    sets = table.where("n > 0").select("uid", "n", "set", "fold")
    firsts = checked_join(sets, again, "uid", "left_anti", 4 * BROADCAST_ROWS)
    shared = entries(firsts, frequent_shingles(bucket_counts(sets), wide), wide)

    # every list against its first document
    head = shared.groupBy("token").agg(F.min(F.struct("doc", "n", "pos")).alias("h"), F.count(F.lit(1)).alias("k"), F.max("salts").alias("salts")).where("k > 1")
    rest = lambda n, pos: F.col(n) - F.col(pos)
    listed = shared.withColumn("salt", _salt("doc", "salts")).drop("salts").join(_salted(head, "salts").drop("salts"), ["token", "salt"]).drop("salt")
    listed = stored(listed, "lists", wide)
    both = (F.col("n") + F.col("h.n")).cast("long")
    strict = _fits(F.col("n"), rest("n", "pos"), F.col("h.n"), rest("h.n", "h.pos"))
    half = (F.col("k") > LONG_LIST) & (LEAD * F.least("n", "h.n", rest("n", "pos"), rest("h.n", "h.pos")) >= both)
    # where half alike is enough, the sum of the sizes is put so that the threshold of a link asks for that
    need = F.when(half, F.floor((NUM + DEN) * both / (NUM * LEAD))).otherwise(both).cast("long")
    near = listed.where((F.col("doc") != F.col("h.doc")) & (strict | half))
    near = near.groupBy(F.col("doc").alias("a"), F.col("h.doc").alias("b")).agg(F.min(need).alias("need")).select("a", "b", F.lit(0).cast("long").alias("extra"), "need")
    stars = verified(possible(stored(near, "star-pairs", small), firsts, small), firsts, wide, True)
    best = stars.where(f"{LEAD} * inter >= na + nb").groupBy("a").agg(F.min(F.struct("b", "na", "nb", "inter", "diff")).alias("l"))
    leader = stored(best.select(F.col("a").alias("doc"), F.col("l.b").alias("leader"), F.col("l.na").alias("n"), F.col("l.nb").alias("size"), F.col("l.inter").alias("inter"), F.col("l.diff").alias("diff")), "leaders", small)

    # clusters of one root (their leaders follow it) meet each other, those of different roots by blocks of their lists
    second = leader.select(F.col("doc").alias("leader"), F.col("leader").alias("second"))
    rooted = stored(leader.select("doc", "leader").join(second, "leader", "left").select("doc", "leader", F.coalesce("second", "leader").alias("root")), "rooted", small)
    heads = rooted.select("leader", "root").distinct()
    same = heads.alias("x").join(heads.alias("y"), (F.col("x.root") == F.col("y.root")) & (F.col("x.leader") > F.col("y.leader"))).select(F.col("x.leader").alias("a"), F.col("y.leader").alias("b"))
    # so do those of two linked documents; a list of two documents has been decided by that
    ends = stars.where(_LINKED).select("a", "b")
    for end in ("a", "b"):
        ends = checked_join(ends, rooted.select(F.col("doc").alias(end), F.col("leader").alias(f"leader_{end}"), F.col("root").alias(f"root_{end}")), end, "left")
        ends = ends.withColumns({f"leader_{end}": F.coalesce(f"leader_{end}", end), f"root_{end}": F.coalesce(f"root_{end}", end)})
    same = same.union(ends.where("leader_a <> leader_b AND root_a <> root_b").select(F.greatest("leader_a", "leader_b"), F.least("leader_a", "leader_b")))
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")
    known = checked_join(listed.where("k > 2").select("token", "doc", "n", "pos"), rooted, "doc", "left").select(
        "token", F.coalesce("leader", "doc").alias("leader"), F.coalesce("root", "doc").alias("root"), F.col("n").cast("long").alias("n"), (F.col("n") - F.col("pos")).cast("long").alias("r"), band("n").alias("band")
    )
    blocks = known.groupBy("token", "leader", "band").agg(
        F.min("root").alias("root"), F.min("n").alias("small"), F.max("n").alias("large"), F.max("r").alias("r"), F.max((NUM + DEN) * F.col("r") >= 2 * NUM * F.col("n")).alias("leads")
    )
    mixed = blocks.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), (F.count(F.lit(1)) > LONG_LIST).alias("long")).where("lo <> hi").select("token", "long")
    blocks = stored(blocks.join(mixed, "token").withColumn("band", F.when(F.col("long"), F.col("band")).otherwise(0)), "blocks", wide)
    x = blocks.where("leads").alias("x")
    y = blocks.withColumn("near", F.explode(F.when(F.col("long"), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0))))).alias("y")
    meets = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.band") == F.col("y.near"))
        & (F.col("x.root") != F.col("y.root"))
        & (~F.col("y.leads") | (F.col("x.leader") < F.col("y.leader")))  # once, if both lead
        & (DEN * F.col("x.large") >= NUM * F.col("y.small"))
        & (DEN * F.col("y.large") >= NUM * F.col("x.small"))
        & ((NUM + DEN) * F.least("x.r", "y.r") >= NUM * (F.col("x.small") + F.col("y.small")))
    )
    pairs = stored(x.join(y, meets).select(F.least("x.leader", "y.leader").alias("b"), F.greatest("x.leader", "y.leader").alias("a")).unionByName(same).distinct(), "leader-pairs", small)
    # followers: the leader itself is one unless it follows another
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(leader.select("leader")).distinct()
    alone = firsts.select(F.col("uid").alias("doc"), "n").join(ends, "doc", "left_semi").join(leader.select("doc"), "doc", "left_anti")
    alone = alone.select(F.col("doc").alias("leader"), "doc", "n", F.col("n").alias("size"), F.col("n").alias("inter"), F.lit(None).cast("binary").alias("diff"))
    members = stored(leader.select("leader", "doc", "n", "size", "inter", "diff").unionByName(alone), "members", small)
    clusters = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("m"), F.min("n").alias("small"), F.max(F.col("n") - F.col("inter")).alias("more"), F.max((F.col("doc") == F.col("leader")).cast("int")).alias("own")
    )
    clusters = stored(clusters, "cluster-bounds", small)
    side = lambda end: clusters.select(F.col("leader").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("m", "small", "more", "own")])
    pairs = checked_join(checked_join(pairs, side("a"), "a"), side("b"), "b").withColumn("single", F.expr("m_a = 1 AND m_b = 1 AND own_a = 1 AND own_b = 1"))
    pairs = stored(pairs.withColumns({"extra": F.col("more_a") + F.col("more_b"), "need": F.col("small_a") + F.col("small_b")}), "bounded-pairs", small)
    done = stars.select("a", "b", "na", "nb", "inter")
    fresh = verified(possible(pairs.join(done, ["a", "b"], "left_anti").select("a", "b", "extra", "need"), firsts, small), firsts, wide)
    overlaps = fresh.select(*done.columns).unionByName(done.join(pairs, ["a", "b"], "left_semi").select(*done.columns))
    bounded = stored(overlaps.join(pairs, ["a", "b"]), "open-leaders", small)
    direct = bounded.where("single").where(_LINKED).select("a", "b")
    reach = (NUM + DEN) * (F.col("inter") + F.col("extra")) >= NUM * F.col("need")
    tasks = bounded.where(~F.col("single") & reach)
    followed = checked_join(members, clusters.select("leader", "m"), "leader")
    followed = checked_join(followed, stored(tasks.select(F.col("a").alias("leader")).union(tasks.select("b")).distinct().withColumn("open", F.lit(True)), "open-clusters", small), "leader", "left").where("m > 1 OR open")
    found = cluster_links(followed, tasks, firsts, small)

    follows = leader.where((NUM + DEN) * F.col("inter") >= NUM * (F.col("n") + F.col("size")))
    edges = follows.select(F.col("doc").alias("a"), F.col("leader").alias("b")).union(direct).union(found.where("a IS NOT NULL").select("a", "b"))
    component = stored(connected_components(edges), "components", small)
    counted = found.where("doc IS NOT NULL").select("doc", "links").union(direct.select("a", F.lit(1).cast("long"))).union(direct.select("b", F.lit(1).cast("long")))
    counted = counted.groupBy("doc").agg(F.sum("links").alias("n_links"))
    named = component.withColumnRenamed("id", "cid").join(classes.select("cid", "first"), "cid")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").select("cid", "component_id").join(counted.withColumnRenamed("doc", "cid"), "cid", "left")
    answers = classes.join(named, "cid", "left").select("d1", "d2", F.coalesce("component_id", "first").alias("own_id"), F.coalesce("n_links", F.lit(0)).alias("links"), (F.col("copies") - 1).alias("others"))
    out = info.join(answers, ["d1", "d2"], "left")
    has = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(has, F.col("own_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has, F.col("links")).otherwise(F.lit(0).cast("long")).alias("n_links"), F.when(has, F.col("others")).otherwise(F.lit(0).cast("long")).alias("n_copies"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
