"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a document are classed by the factor of some length that starts
there.  From one length to the next a class is split by the classes of its
members' successors, and only the smaller parts of what was split before have to
be looked at (all children but the largest), so that the work is O(n log n).  Two
neighbours in a class at the distance of its length are a square with a primitive
root; squares of one period at consecutive places are one run.

All documents of a batch are refined together, length by length, as array
operations.  Classes are blocks of one array of positions, and members of a class
are linked in order of position; a split moves its smaller parts to the end of
the block and takes them out of the links.  A link of distance d that was made at
length b and cut after length e is a square if b <= d <= e, so that no lists by
distance are kept.

Words are runs of characters other than ASCII white space, compared whole (they
are numbered by a dictionary of each document, not hashed).

Nulls: a null text has no words; a null doc_id is kept.  Very long texts are one
document of a batch, refined whole.  Equal rows give equal rows, an empty table
gives an empty one, other columns are ignored.  Runs of one start are told apart
by their periods.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textfeatures import slices
from loomgraph.plans.durable import arrow_rows

#: Least number of words in a run.
LEAST = 12
#: Words of the documents that are refined together.
WORDS = 400_000
#: Documents of an Arrow batch.
ROWS = 2000
#: What stands between words.
SPACE = r"[\x20\x09-\x0D]+"


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    return np.repeat(starts - _starts(counts), counts) + np.arange(int(counts.sum()))


class Refinement:
    """Classes of equal factors at all positions of several sequences, each followed by an end mark of its own."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        """ids: a number for each word, different in different sequences; at: bounds of the sequences."""
        n = np.diff(at)
        self.seq = np.repeat(np.arange(len(n)), n + 1)
        self.begin = at[:-1] + np.arange(len(n))
        size = len(self.seq)
        marks = self.begin + n
        word = np.full(size, -1, np.int64)
        inside = np.ones(size, bool)
        inside[marks] = False
        word[inside] = ids
        word[marks] = (int(ids.max()) + 1 if len(ids) else 0) + np.arange(len(n))
        self.half = (n // 2)[self.seq]  # a square of period d needs 2d words
        self.first = np.zeros(size, bool)
        self.first[self.begin] = True
        order = np.argsort(word, kind="stable")
        new = np.ones(size, bool)
        new[1:] = word[order][1:] != word[order][:-1]
        begins = np.flatnonzero(new)
        k = len(begins)
        self.cls = np.empty(size, np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.start, self.size = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        self.start[:k], self.size[:k] = begins, np.diff(np.append(begins, size))
        self.made = k
        self.block = order
        self.place = np.empty(size, np.int64)
        self.place[order] = np.arange(size)
        self.next, self.prev = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        same = ~new[1:]
        self.next[order[:-1][same]] = order[1:][same]
        self.prev[order[1:][same]] = order[:-1][same]
        self.born = np.ones(size, np.int64)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _cut(self, i: np.ndarray, length: int) -> None:
        """The links from ``i`` to their neighbours end after this length; those that were squares are noted."""
        i = i[self.next[i] >= 0]
        d = self.next[i] - i
        found = (self.born[i] <= d) & (d <= length) & (d <= self.half[i])
        if found.any():
            self.squares.append((i[found], d[found]))

    def refine(self, small: np.ndarray, length: int) -> np.ndarray:
        """From ``length`` to the next: split by the members of the small classes; gives those of the next small classes."""
        p = small[~self.first[small]] - 1
        p = p[(self.half[p] > length) & (self.size[self.cls[p]] > 1)]
        if not len(p):
            return p
        p.sort()
        parent, after = self.cls[p], self.cls[p + 1]
        order = np.argsort((parent << 32) | after, kind="stable")
        p, parent, after = p[order], parent[order], after[order]
        new_parent = np.ones(len(p), bool)
        new_parent[1:] = parent[1:] != parent[:-1]
        new_group = new_parent.copy()
        new_group[1:] |= after[1:] != after[:-1]
        of = np.cumsum(new_parent) - 1  # which parent
        heads = np.flatnonzero(new_parent)
        taken = np.diff(np.append(heads, len(p)))
        groups = np.bincount(of[new_group], minlength=len(heads))
        split = (groups > 1) | (taken < self.size[parent[heads]])
        if not split.all():
            keep = split[of]
            p, parent, new_parent, new_group = p[keep], parent[keep], new_parent[keep], new_group[keep]
            if not len(p):
                return p
            of = np.cumsum(new_parent) - 1
            heads, taken = np.flatnonzero(new_parent), taken[split]
        c = parent[heads]
        rest = self.size[c] - taken
        firsts = np.flatnonzero(new_group)
        group = np.cumsum(new_group) - 1
        sizes = np.diff(np.append(firsts, len(p)))
        self._unlink(p, parent, of, length)
        self._link(p, new_group, length)
        self._move(p, of, c, taken)
        # numbers of the new classes; where nothing is left of the parent its first part takes its number
        numbers = np.empty(len(firsts), np.int64)
        of_group = of[firsts]
        heir = new_parent[firsts] & (rest[of_group] == 0)
        numbers[heir] = c[of_group[heir]]
        fresh = int((~heir).sum())
        numbers[~heir] = np.arange(self.made, self.made + fresh)
        self.made += fresh
        begins = (self.start[c] + rest)[of_group] + firsts - heads[of_group]
        self.size[c] = rest
        self.start[numbers], self.size[numbers] = begins, sizes
        self.cls[p] = numbers[group]
        # all parts but the largest are small
        first_groups = np.flatnonzero(new_parent[firsts])
        most = np.maximum.reduceat(sizes, first_groups)
        is_most = np.flatnonzero(sizes == most[of_group])
        which = of_group[is_most]
        one = np.ones(len(which), bool)
        one[1:] = which[1:] != which[:-1]
        large = np.zeros(len(firsts), bool)
        large[is_most[one]] = True
        large &= most[of_group] > rest[of_group]
        over = (most > rest) & (rest > 0)
        out = p[~large[group]]
        if over.any():
            out = np.concatenate([out, self.block[_ranges(self.start[c[over]], rest[over])]])
        return out

    def _unlink(self, p: np.ndarray, parent: np.ndarray, of: np.ndarray, length: int) -> None:
        """Take ``p`` out of the links of the members that stay."""
        q = p[np.lexsort((p, of))]
        chain = np.ones(len(q), bool)
        chain[1:] = self.next[q[:-1]] != q[1:]
        begins = np.flatnonzero(chain)
        ends = np.append(begins[1:], len(q)) - 1
        x, y = self.prev[q[begins]], self.next[q[ends]]
        stays = x >= 0
        self._cut(x[stays], length)
        self.next[x[stays]] = y[stays]
        self.born[x[stays]] = length + 1
        self.prev[y[y >= 0]] = x[y >= 0]

    def _link(self, p: np.ndarray, new_group: np.ndarray, length: int) -> None:
        """Link the members of each new class; links that stay as they were keep their age."""
        after, before = np.full(len(p), -1, np.int64), np.full(len(p), -1, np.int64)
        same = ~new_group[1:]
        after[:-1][same] = p[1:][same]
        before[1:][same] = p[:-1][same]
        changed = after != self.next[p]
        self._cut(p[changed], length)
        self.next[p], self.prev[p] = after, before
        self.born[p[changed]] = length + 1

    def _move(self, p: np.ndarray, of: np.ndarray, c: np.ndarray, taken: np.ndarray) -> None:
        """Put ``p`` at the ends of the blocks of the classes ``c``, in the order given."""
        ends = self.start[c] + self.size[c] - taken
        slots = _ranges(ends, taken)
        there = self.block[slots]
        ours = np.zeros(len(there), bool)
        at = self.place[p]
        inside = at >= ends[of]
        base = _starts(taken)
        ours[base[of[inside]] + at[inside] - ends[of[inside]]] = True
        moved, holes = there[~ours], at[~inside]
        self.block[holes], self.place[moved] = moved, holes
        self.block[slots], self.place[p] = p, slots

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of every square with a primitive root."""
        small, length = np.arange(len(self.seq)), 1
        while len(small):
            small = self.refine(small, length)
            length += 1
        self._cut(np.flatnonzero(self.next >= 0), len(self.seq))
        if not self.squares:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, d = (np.concatenate(x) for x in zip(*self.squares, strict=True))
        return i, d


def runs_of(ids: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of all runs of at least ``least`` words, in that order."""
    r = Refinement(ids, at)
    i, d = r.all_squares()
    order = np.lexsort((i, d))
    i, d = i[order], d[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:], len(i)) - 1 if len(heads) else heads
    start, period = i[heads], d[heads]
    length = i[lasts] - start + 2 * period
    seq = r.seq[start]
    start = start - r.begin[seq]
    order = np.lexsort((period, start, seq))
    order = order[length[order] >= least]
    return seq[order], start[order], length[order], period[order]


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, a number for each word (equal words of one text have one number), and the texts' bounds."""
    words, ids, at, base = [], [], [0], 0
    for text in texts:
        w = text.split()  # of bytes: exactly the six ASCII characters of white space
        known: dict[bytes, int] = {}
        ids.append(np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w)) + base)
        base += len(known)
        words.append(w)
        at.append(at[-1] + len(w))
    return words, np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(at)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Parts of a batch with about WORDS words each: ids and texts."""
    texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
    at, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text) // 6 + 1
        if held >= WORDS:
            yield batch.column(0).slice(at, k + 1 - at), texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield batch.column(0).slice(at), texts[at:]


def document_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words that no run repeats."""
    names = ["doc_id", "n_words", "runs", "collapsed"]
    inner = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            for ids, texts in _portions(batch):
                words, numbers, at = numbered(texts)
                seq, start, length, period = runs_of(numbers, at, least)
                bounds = np.searchsorted(seq, np.arange(len(texts) + 1))
                change = np.zeros(at[-1] + 1, np.int64)  # +1 where what a run repeats begins, -1 behind it
                np.add.at(change, at[seq] + start + period, 1)
                np.add.at(change, at[seq] + start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                lines = []
                for k, w in enumerate(words):
                    lines.append(b" ".join(w if bounds[k] == bounds[k + 1] else compress(w, kept[at[k] : at[k + 1]].tolist())).decode())
                found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(inner))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), pa.array(lines, pa.string())], names
                )

    kind = dict(documents.dtypes)["doc_id"]
    with arrow_rows(documents.sparkSession, ROWS):
        return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of its words to its end.

    Which one, from where (a) and by which period (p) the crc32 of the id says:
    with h the crc32 and g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.split(F.regexp_replace(F.col("text"), f"^{SPACE}|{SPACE}$", ""), SPACE)
    n, g = F.col("_n"), F.floor(F.col("_h") / 10)
    a, p = F.col("_a"), F.col("_p")
    woven = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.get(F.col("_words"), F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    out = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", h)
    chosen = (F.col("_h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.withColumn("_words", F.when(chosen, words)).withColumn("_n", F.size("_words").cast("long"))
    out = out.withColumn("_a", g % n).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))))
    return out.select("doc_id", F.when(chosen, F.array_join(woven, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        digest(line).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )

#: DuckDB SQL for the rows of op11: pairs of equal words at each distance, their unbroken stretches, and of equal stretches the least period.
OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM documents, crc
), g AS (
  SELECT r, doc_id, words, len(words) AS n, h, h // 10 AS g, (h // 10) % greatest(len(words), 1) AS a FROM w
), p AS (
  SELECT r, doc_id, n, a, 1 + (n - a) // (3 + g % 8) AS p, h % 10 = 0 AND n > 0 AS woven, words FROM g
), d AS (
  SELECT r, doc_id, n, unnest(CASE WHEN woven THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END) AS word,
    unnest(range(n)) AS i FROM p
), s AS (
  SELECT x.r, x.i, y.i - x.i AS q, x.n FROM d x JOIN d y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), k AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM s
), m AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY r, q, stretch
), u AS (
  SELECT r, start, length, min(q) AS period FROM m WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), best AS (
  SELECT r, count(*) AS n_runs, arg_max(start, (length, -start, -period)) AS start, max(length) AS length, arg_max(period, (length, -start, -period)) AS period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u
), kept AS (
  SELECT d.r, string_agg(d.word, ' ' ORDER BY d.i) AS words FROM d ANTI JOIN gone ON d.r = gone.r AND d.i = gone.i GROUP BY d.r
)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM p LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
