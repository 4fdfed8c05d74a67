"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, units and names are replaced by typed
placeholders (``<n>``, ``<u>``, ``<name>``), everything else is case folded
(ASCII and Latin-1 letters) and stripped of signs.  A window of template words
has two forms, as a capital does not tell a name from the first word of a
sentence: one keeps all capitalised words as they are (and so meets copies in
any case), one replaces them all (and so meets other names, also where a
sentence begins with one).  Windows of the benchmark are hash-joined with those
of every document, form by form, and the template words compared.  Where both
sides fill the slots of matched windows differently, the fillings must be
consistent: one benchmark value always meets one document value (a
re-parameterised question), otherwise those windows do not count.  A document
may hold an item several times with different values, so each occurrence's
fillings are tried for themselves, and the best one counts.

The join: a bitmap of the benchmark's window hashes (``BITMAP_BITS`` at most,
whatever the benchmark's size; a fuller one only lets more candidates through)
picks the candidate windows in one pass over the documents.  Only candidates
leave a task, and Spark joins them with the table of benchmark windows: by
broadcast if that table is small by rows and bytes, else by shuffle.

A document is contaminated by an item if at least ``SHARE`` of the item's
windows are found in it consistently.  Items shorter than a window are one
window as a whole.

Nulls: null or empty texts match nothing, and a null or empty item is in
nothing; null ids are kept.  Very long texts are read whole; one task at a time
holds the matches of one document with one item.  Items of different ids or
texts give a row each, an item row repeated as it is counts once; repeated
documents give a row for each.  Ties between fillings go to the one found first.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.bytesets import _LOWER, chunks, mix, runs, span_hashes
from loomgraph.llm.textfeatures import _UPPER, _WORDY
from loomgraph.plans.durable import checked_join, stored

WIDTH = 8
SHARE = 0.5
#: Bits of the bitmap of benchmark windows: so many for each window, within these bounds (8 KB to 32 MB).
BITS_A_WINDOW, LEAST_BITS, BITMAP_BITS = 64, 16, 28
#: Units of measure and number words, in natural order.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ton tons ounce ounces "
    "pound pounds ml l litre litres liter liters gallon gallons s sec second seconds minute minutes hour hours day days week "
    "weeks month months year years dollar dollars euro euros cent cents percent degree degrees metre metres meter meters "
    "kilometre kilometres kilometer kilometers"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
_NUMBER, _UNIT, _NAME = "<n>", "<u>", "<name>"
_KINDS = ("", _NUMBER, _UNIT, _NAME)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ASCII and Latin-1 capitals in lower case; where capitals begin; which bytes are of words."""
    before = np.concatenate([[0], data[:-1]])
    latin = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = _LOWER[data] + latin.astype(np.uint8) * 32
    upper = _UPPER[data].copy()
    upper[:-1] |= latin[1:]
    wordy = _WORDY[data]
    mark = np.flatnonzero((before == 0xE2) & ((data == 0x80) | (data == 0x81)))  # general punctuation
    for k in (-1, 0, 1):
        wordy[np.minimum(mark + k, len(data) - 1)] = False
    return low, upper, wordy


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    """The hashes that :func:`templates` gives to these words."""
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(span_hashes(data, np.array([0]), np.array([len(data)]))[0])
    return np.sort(np.array(out, np.uint64))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


class Templates:
    """Template words of a run of rows, in two forms.

    A number has a digit or is a number word; a unit is a unit word right after
    a number; a name is a capitalised word that is not in capitals throughout.
    The first form keeps names as words, the second one replaces them.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low, upper, wordy = _fold(data)
        self.starts, self.ends, self.at = runs(wordy, off)
        starts, ends = self.starts, self.ends
        code = span_hashes(self.low, starts, ends)
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, caps = total(_DIGIT[data]), total(upper)
        first = np.zeros(len(starts), bool)
        first[self.at[:-1][self.at[:-1] < len(starts)]] = True
        number = (digits[ends] > digits[starts]) | _among(code, _NUMBER_CODES)
        after_number = np.concatenate([[False], number[:-1]]) & ~first
        unit = _among(code, _UNIT_CODES) & after_number & ~number
        capitals = caps[ends] - caps[starts]
        name = upper[starts] & (capitals < ends - starts) & (ends - starts > 1 + (data[starts] >= 128)) & ~number & ~unit
        kept = np.where(number, 1, np.where(unit, 2, 0))
        self.kinds = (kept, np.where(name, 3, kept))
        self.codes = tuple(np.where(k > 0, _KIND_CODES[k], code) for k in self.kinds)
        self.names = total(name)

    def words(self, a: int, b: int, form: int) -> tuple[str, str]:
        """Template words, and the words as they stand, from word ``a`` to ``b``; words hold no spaces."""
        plain = [self.low[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]
        return " ".join(_KINDS[k] or w for k, w in zip(self.kinds[form][a:b].tolist(), plain, strict=True)), " ".join(plain)


_NUMBER_CODES, _UNIT_CODES = _hashes_of(tuple(NUMBERS)), _hashes_of(tuple(UNITS))
_KIND_CODES = np.array([0, 0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85], np.uint64)


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, wherever rows end."""
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    n = max(0, len(codes) - width + 1)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total = total * step + codes[j : j + n]
    return mix(total)


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, version (hash of the text), window (hash), at, width, n_windows, template and plain words of every item."""
    names = ["item_id", "version", "window", "at", "width", "n_windows", "template", "plain"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for begin, _, data, off in chunks(batch.column(1)):
                t = Templates(data, off)
                for row, (a, b) in enumerate(zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)):
                    k = min(width, b - a)
                    for form in (0, 1) if k else ():
                        for i, h in enumerate(windows(t.codes[form][a:b], k).view(np.int64).tolist()):
                            if not form or t.names[a + i + k] > t.names[a + i]:
                                out.append((ids[begin + row], versions[begin + row], h, i, k, b - a - k + 1, *t.words(a + i, a + i + k, form)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    kind = dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", "text").distinct().withColumn("version", F.xxhash64("text"))
    return items.mapInArrow(cut, f"item_id {kind}, version long, window long, at int, width int, n_windows int, template string, plain string")


def _bitmap(table: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits, and the bitmap of the first bits of all window hashes; tasks send packed positions, the driver holds the bitmap alone."""
    bits = min(BITMAP_BITS, max(LEAST_BITS, (BITS_A_WINDOW * max(n, 1) - 1).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(at.astype("<u4").tobytes(), 1)], pa.binary())], ["packed"])

    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in table.select("window").mapInArrow(pack, "packed binary").toLocalIterator():
        at = np.frombuffer(zlib.decompress(r["packed"]), "<u4")
        np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits, found


def candidates(documents: DataFrame, bits: int, bitmap: np.ndarray, widths: list[int]) -> DataFrame:
    """uid (of the row), doc_id, window, place, template, plain of the documents' windows that the bitmap lets through."""
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)  # 2**BITMAP_BITS bits at most
    names = ["uid", "doc_id", "window", "place", "template", "plain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, uid = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for begin, _, data, off in chunks(batch.column(1)):
                t = Templates(data, off)
                for k, form in itertools.product(widths, (0, 1)):
                    h = windows(t.codes[form], k)
                    at = h >> np.uint64(64 - bits)
                    hit = (found[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    if form:
                        hit &= t.names[k : k + len(h)] > t.names[: len(h)]
                    place = np.flatnonzero(hit)
                    row = np.searchsorted(t.at, place, "right") - 1
                    inside = place + k <= t.at[row + 1]
                    for r, i in zip(row[inside].tolist(), place[inside].tolist(), strict=True):
                        out.append((uid + begin + r, ids[begin + r], int(h[i].view(np.int64)), i - int(t.at[r]), *t.words(i, i + k, form)))
            uid += len(ids)
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), batch.schema.types[0], pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, window long, place long, template string, plain string")


def _slots(template: str, plain: str, own: str) -> dict | None:
    """The fillings of a matched window: (kind, benchmark value) to document value; None if they contradict each other.

    A window of slots alone says nothing but by its values, so these have to be equal.
    """
    out: dict = {}
    kinds = template.split(" ")
    for kind, a, b in zip(kinds, plain.split(" "), own.split(" "), strict=True):
        if kind[0] == "<" and out.setdefault((kind, a), b) != b:
            return None
    if all(kind[0] == "<" for kind in kinds) and any(a != b for (_, a), b in out.items()):
        return None
    return out


def _fillings(rows: list[tuple[int, int, dict]]) -> Iterator[dict]:
    """Fillings to try: those most frequent in the whole document, then those of each occurrence.

    An occurrence is a stretch of windows of one alignment (place in the document
    less place in the item) in which no two fillings differ.
    """
    votes: dict = defaultdict(lambda: defaultdict(int))
    for _, _, slots in rows:
        for slot, value in slots.items():
            votes[slot][value] += 1
    yield {slot: max(sorted(v), key=v.get) for slot, v in votes.items()}
    last, filling, met = None, {}, set()
    for i, k, slots in [*sorted(rows, key=lambda r: (r[0] - r[1], r[1])), (0, 0, None)]:
        if slots is None or i - k != last or any(filling.get(s, v) != v for s, v in slots.items()):
            key = frozenset(filling.items())
            if last is not None and key not in met:
                met.add(key)
                yield filling
            last, filling = i - k, {}
        filling.update(slots or {})


def _consistent(filling: dict, by_window: dict) -> tuple[int, int]:
    """Windows found with one filling, and those of them with other values than the item's.

    Slots that the filling leaves open (an occurrence with an edit in it) take the
    most frequent values that agree with it.
    """
    filling, good, other = dict(filling), set(), set()
    for (k, names), found in by_window.items():
        values = tuple(filling.get(s) for s in names)
        if None in values:
            agree = [v for v in found if all(w is None or w == x for w, x in zip(values, v, strict=True))]
            if not agree:
                continue
            values = min(agree, key=lambda v: (-found[v], v))
            filling.update(zip(names, values, strict=True))
        if values in found:
            good.add(k)
            if any(a != b for (_, a), b in zip(names, values, strict=True)):
                other.add(k)
    return len(good), len(other)


def _best(rows: list[tuple[int, int, dict]]) -> tuple[int, int]:
    """Windows of an item found in a document by the best filling, and how many of them with other values."""
    by_window: dict = defaultdict(lambda: defaultdict(int))
    for _, k, slots in sorted(rows, key=lambda r: r[1]):
        names = tuple(sorted(slots))
        by_window[k, names][tuple(slots[s] for s in names)] += 1
    every = len({k for k, _ in by_window})
    good = other = 0
    for filling in _fillings(rows):
        found, changed = _consistent(filling, by_window)
        if (found, -changed) > (good, -other):
            good, other = found, changed
        if good == every and not other:
            break
    return good, other


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """One row for each document and item of which it holds enough.

    doc_id, item_id, n_found, n_windows, n_reparameterised.
    """
    table = stored(benchmark_windows(benchmark, width), "benchmark-windows")
    sizes = {r["width"]: r["count"] for r in table.groupBy("width").count().collect()}  # at most `width` rows
    bits, bitmap = _bitmap(table, sum(sizes.values()))
    found = stored(candidates(documents, bits, bitmap, sorted(sizes)), "window-candidates")
    items = table.select("item_id", "version", "window", "at", "n_windows", "template", F.col("plain").alias("values"))
    met = checked_join(found, items, ["window", "template"]).select("uid", "item_id", "version", "at", "place", "doc_id", "n_windows", "template", "values", "plain")
    met = met.repartition("uid", "item_id", "version").sortWithinPartitions("uid", "item_id", "version", "at", "place")
    item_arrow, doc_arrow = to_arrow_type(met.schema["item_id"].dataType), to_arrow_type(met.schema["doc_id"].dataType)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            kinds = [doc_arrow, item_arrow, pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_found", "n_windows", "n_reparameterised"])

        for (_, item, _), group in itertools.groupby(rows, key=lambda r: r[:3]):
            hits = []
            for r in group:
                slots = _slots(r[7], r[8], r[9])
                if slots is not None:
                    hits.append((r[4], r[3], slots))
            doc, n = r[5], r[6]
            good, other = _best(hits)
            if good and good >= share * n:
                out.append((doc, item, good, n, other))
            if len(out) >= 10_000:
                yield batch()
        yield batch()

    kind, item_kind = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    return met.mapInArrow(decide, f"doc_id {kind}, item_id {item_kind}, n_found int, n_windows int, n_reparameterised int")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
