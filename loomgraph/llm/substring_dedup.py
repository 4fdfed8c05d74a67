"""Substring deduplication: words under a repeated window are removed, by super-k-mers.

A window is ``width`` consecutive words.  Its minimiser is the least hash among
its runs of ``gram`` words; consecutive windows that share a minimiser travel as
one packed string of words (a super-k-mer) to the minimiser's bucket.  Equal
windows have equal minimisers, so a bucket sees all occurrences of its windows;
there they are sorted, word by word and not by hashes, which gives each window's
first document.

What keeps the work bounded:

* Frequent runs of words are last in the order of minimisers.  Windows that hold
  anything else go to buckets of their own, so a passage that a third of all
  documents hold in different surroundings fills no bucket; windows inside it
  have equal strings in all documents, and a batch sends each string once.
* Only minimisers that occur in several documents can hold a repeated window.
  They are kept in a bitmap of fixed size; bits that hashes share cost traffic,
  not rows.
* Buckets of more than ``LARGE`` documents are split: each of their windows
  travels alone and has a bucket of its own.
* A document that is not the first one of a string loses all its windows, and
  only the first one needs to know which; so what a bucket sends back is one row
  for each string.  Occurrences name their string by 128 bits of its SHA-256.

Windows are judged on the input.  Nulls: a null text has no words; a row without
doc_id is neither before nor after any other, so it keeps all its words and takes
none.  Rows of one doc_id take nothing from each other, and each is judged by its
own text.  Very long texts are handled whole, stretch by stretch; texts of fewer words than a
window are kept.  Ties cannot arise, equal rows give equal rows, an empty table
gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.bytesets import _SPACE, chunks, mix, runs, span_hashes
from loomgraph.llm.textfeatures import slices
from loomgraph.plans.durable import arrow_rows, checked_join, dropped, parts, stored

#: Words of a window, and of the runs of words among which a minimiser is chosen.
WIDTH, GRAM = 50, 12
#: A run of words in at least this share of the documents is frequent; so many such runs are told apart at most (load only, never results).
FREQUENT, MOST_FREQUENT = 1 / 256, 1 << 20
#: Documents of a bucket above which its windows travel one by one.
LARGE = 20_000
#: Address bits of the bitmaps of minimisers: 16 MB each.
BITS = 27
#: Words that are sorted together in a task, and documents of an Arrow batch.
WORDS, ROWS = 1 << 19, 1000
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_LATER = np.uint64(1 << 63)


def grams(data: np.ndarray, off: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (63 bits) of the run of words that begins at each word, the words' starts and ends, and the words' bounds by row."""
    starts, ends, at = runs(~_SPACE[data], off)
    w = span_hashes(data, starts, ends)
    n = max(0, len(w) - gram + 1)
    total = np.zeros(n, np.uint64)
    for j in range(gram):
        total = total * _STEP + w[j : j + n]
    return mix(total) >> np.uint64(1), starts, ends, at


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    held, n = 1, values
    while 2 * held <= width:
        n = np.minimum(n[:-held], n[held:]) if len(n) > held else n[:0]
        held *= 2
    more = width - held
    return np.minimum(n[: len(n) - more], n[more:]) if more and len(n) > more else (n if not more else n[:0])


def window_minimisers(h: np.ndarray, at: np.ndarray, width: int, gram: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: row, first window (a word's number), number of windows, minimiser."""
    if len(frequent) and len(h):
        place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = np.where(frequent[place] == h, h | _LATER, h)
    least = least_of(h, width - gram + 1)
    n = np.diff(at) - width + 1
    rows = np.flatnonzero(n > 0)
    n = n[rows]
    begin = at[rows]
    window = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    value, row = least[window], np.repeat(rows, n)
    head = np.ones(len(window), bool)
    head[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(window)))
    return row[heads], window[heads], size, value[heads]


def frequent_grams(documents: DataFrame, gram: int, share: float = FREQUENT) -> np.ndarray:
    """Hashes of the runs of words that at least about ``share`` of the documents hold, at most MOST_FREQUENT.

    Each chunk of a batch gives those that half the share of its documents hold,
    so the rows that leave a task are few; their counts are summed in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            found = []
            for _, _, data, off in chunks(batch.column(0)):
                h, _, _, at = grams(data, off, gram)
                row = np.searchsorted(at, np.arange(len(h)), "right") - 1
                order = np.lexsort((row, h))
                x, y = h[order], row[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                found.append(x[new])
            x, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= max(3, share / 2 * len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(x[often].view(np.int64)), pa.array(counts[often])], ["gram", "n"])

    total = documents.count()
    counted = documents.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= max(20, int(share / 2 * total)))
    rows = often.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram").toArrow().column(0).to_numpy()
    return np.sort(rows.astype(np.int64)).view(np.uint64)


def _address(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(minimisers: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits; tasks send packed addresses, the driver holds the bitmap alone."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_address(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(at.astype("<u4").tobytes(), 1)], pa.binary())], ["packed"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in minimisers.select("minimiser").mapInArrow(pack, "packed binary").toLocalIterator():
        at = np.frombuffer(zlib.decompress(r["packed"]), "<u4")
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _address(h, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def minimiser_documents(documents: DataFrame, width: int, gram: int, frequent) -> DataFrame:
    """minimiser, how many documents hold it, the least and the greatest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in slices(batches, ROWS):
            ids = batch.column(0)
            for first, _, data, off in chunks(batch.column(1)):
                h, _, _, at = grams(data, off, gram)
                of, _, _, value = window_minimisers(h, at, width, gram, known)
                order = np.lexsort((of, value))
                value, of = value[order], of[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
                value, of = value[new], of[new]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids.take(pa.array(of + first))], ["minimiser", "doc_id"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text").mapInArrow(run, f"minimiser long, doc_id {kind}")
    return rows.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


def super_kmers(documents: DataFrame, width: int, gram: int, frequent, repeated, large) -> DataFrame:
    """One row for each string of a batch: bucket, packed words, number of windows, digest, first document, and where it stands."""
    names, most = ["bucket", "packed", "n", "digest", "doc_id", "docs", "turns", "starts"], ROWS
    kind = documents.schema["doc_id"].dataType
    doc_arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, split = frequent.value, repeated.value, large.value
        for batch in slices(batches, most):
            ids, turns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found: dict[tuple[int, bytes], list] = {}
            for first, _, data, off in chunks(batch.column(1)):
                h, starts, ends, at = grams(data, off, gram)
                of, window, size, value = window_minimisers(h, at, width, gram, known)
                take = _has(wanted, value)
                of, window, size, value = of[take], window[take], size[take], value[take]
                alone = _has(split, value)
                raw = data.tobytes()
                for r, i, n, v, one in zip(of.tolist(), window.tolist(), size.tolist(), value.view(np.int64).tolist(), alone.tolist(), strict=True):
                    for j, m in [(j, 1) for j in range(i, i + n)] if one else [(i, n)]:
                        text = b" ".join(raw[starts[j] : ends[j + m + width - 2]].split())
                        bucket = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True) if one else v
                        found.setdefault((bucket, text), []).append((first + r, j - int(at[r]), m))
            rows = [(b, t, where[0][2], hashlib.sha256(t).digest()[:16], where) for (b, t), where in found.items()]
            docs = [[ids[r] for r, _, _ in x[4]] for x in rows]
            cols = [
                pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.int32()),
                pa.array([x[3] for x in rows], pa.binary()), pa.array([min(d) for d in docs], doc_arrow), pa.array(docs, pa.list_(doc_arrow)),
                pa.array([[turns[r] for r, _, _ in x[4]] for x in rows], pa.list_(pa.int64())), pa.array([[s for _, s, _ in x[4]] for x in rows], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = kind.simpleString()
    schema = f"bucket long, packed binary, n int, digest binary, doc_id {kind}, docs array<{kind}>, turns array<long>, starts array<int>"
    return documents.select("doc_id", "text", "turn").mapInArrow(run, schema)


def _sorted_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the class of every window: windows are equal if and only if their classes are.

    Factors of 1, 2, 4 ... words are sorted in turn as pairs of the ranks of
    their halves, and a window as two factors that overlap.
    """
    known: dict[bytes, int] = {}
    ids, sizes = [], []
    for text in texts:
        w = text.split(b" ")
        sizes.append(len(w))
        ids.extend([known.setdefault(x, len(known)) for x in w])
    rank, held = np.array(ids, np.int64), 1
    while 2 * held <= width:
        pair = (rank[:-held] << 32) | rank[held:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        held *= 2
    more = width - held
    if more:
        rank = np.unique((rank[: len(rank) - more] << 32) | rank[more:], return_inverse=True)[1]
    sizes = np.array(sizes)
    n = sizes - width + 1
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(texts)), n), rank[at]


def bucket_answers(strings: DataFrame, width: int) -> DataFrame:
    """digest, first document and, of the windows that an earlier document holds too, their stretches (from, to) in it."""
    kind = strings.schema["doc_id"].dataType
    doc_arrow = to_arrow_type(kind)
    names, most = ["digest", "first", "froms", "tos"], WORDS

    def solve(held: dict[bytes, list]) -> pa.RecordBatch:
        texts = list(held)
        firsts = [held[t][0] for t in texts]
        ids = sorted(set(firsts))
        number = {d: i for i, d in enumerate(ids)}
        doc = np.array([number[d] for d in firsts])
        of, cls = _sorted_windows(texts, width)
        least = np.full(int(cls.max()) + 1, len(ids))
        np.minimum.at(least, cls, doc[of])
        earlier = least[cls] < doc[of]
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        froms, tos = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            edge = np.diff(np.concatenate([[0], earlier[a:b].astype(np.int8), [0]]))
            froms.append(np.flatnonzero(edge == 1).tolist())
            tos.append(np.flatnonzero(edge == -1).tolist())
        cols = [pa.array([held[t][1] for t in texts], pa.binary()), pa.array(firsts, doc_arrow), pa.array(froms, pa.list_(pa.int32())), pa.array(tos, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        bucket, words = None, 0
        for batch in batches:
            for b, text, digest, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and words >= most:
                    yield solve(held)
                    held, words = {}, 0
                bucket = b
                if text in held:
                    held[text][0] = min(held[text][0], doc)
                else:
                    held[text] = [doc, digest]
                    words += n + width - 1
        if held:
            yield solve(held)

    kind = kind.simpleString()
    dealt = strings.select("bucket", "packed", "digest", "doc_id", "n").repartition(parts(strings.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"digest binary, first {kind}, froms array<int>, tos array<int>")


def repeated_spans(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, turn (a hash of the text), spans: the words (from, to) of each document that a repeated window covers."""
    gram = min(gram, width)
    spark = documents.sparkSession
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("turn"))
    send = spark.sparkContext.broadcast
    with arrow_rows(spark, ROWS):
        frequent = send(frequent_grams(docs, gram))
        counted = stored(minimiser_documents(docs, width, gram, frequent).where("low < high").select("minimiser", "n"), "minimisers")
        repeated, large = send(_bitmap(counted, BITS)), send(_bitmap(counted.where(F.col("n") > LARGE), BITS))
        strings = stored(super_kmers(docs, width, gram, frequent, repeated, large), "super-kmers")
        dropped(counted)
        answers = stored(bucket_answers(strings, width), "bucket-answers")
    met = checked_join(strings.select("digest", "n", "docs", "turns", "starts"), answers, "digest")  # a row for each string and batch
    met = met.select("n", "first", "froms", "tos", F.explode(F.arrays_zip("docs", "turns", "starts")).alias("w"))
    met = met.select("n", "first", "froms", "tos", F.col("w.docs").alias("doc_id"), F.col("w.turns").alias("turn"), F.col("w.starts").alias("start"))
    whole = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n") + width - 1).alias("to")))
    own = F.transform(F.arrays_zip("froms", "tos"), lambda s: F.struct((F.col("start") + s["froms"]).alias("from"), (F.col("start") + s["tos"] + width - 1).alias("to")))
    spans = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(own)
    met = met.select("doc_id", "turn", F.explode(spans).alias("s")).groupBy("doc_id", "turn").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    out = stored(met, "repeated-spans")
    dropped(strings)
    dropped(answers)
    return out


def without_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every document."""
    spans = repeated_spans(documents, width, gram)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("turn"))
    joined = checked_join(docs, spans, ["doc_id", "turn"], "left").select("doc_id", "text", F.col("spans.from").alias("froms"), F.col("spans.to").alias("tos"))
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            total, removed, kept = [], [], []
            for text, froms, tos in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, stay, at = text.split(), [], 0
                for a, b in zip(froms or (), tos or (), strict=True):
                    if a > at:
                        stay += words[at:a]
                    at = max(at, b)
                stay += words[at:]
                total.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names)

    kind = dict(documents.dtypes)["doc_id"]
    with arrow_rows(documents.sparkSession, ROWS):
        return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for the rows of op13: windows are grouped by the lists of their words.
OP13_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, row_number() OVER () AS r FROM documents
), p AS (
  SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w
), k AS (
  SELECT r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM p
), f AS (
  SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS hit FROM k
), g AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM f WHERE hit
), u AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w
), s AS (
  SELECT u.r, string_agg(u.word, ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.r = g.r AND u.j = g.j GROUP BY u.r
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(s.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (r)
"""
