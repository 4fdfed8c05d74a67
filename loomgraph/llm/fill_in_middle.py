"""Fill-in-the-middle transformation of documents.

The Split pre-tokenizer of the tokenizers library, with one code point as its
isolated match, gives a text's array of code-point offsets; nothing is trained.
The array's length is n, and two drawn ranks in it are where prefix and middle
end.  The draws come from a SHA-256 of the document's id, so a lost task that
runs again gives the same rows.

Texts are matched in blocks, words with the white space after them and at most
``BLOCK`` code points of either; a match is one code point, so no match crosses
blocks, and a text's array is those of its blocks in turn, each moved to where the
block begins.  The library makes objects for each match, so the arrays of blocks
are remembered: each different word is matched once, as long as there is room, and
words that are new are matched many at a time.

Nulls: a null text is the empty text and stays plain; a null doc_id is hashed as
no digits at all.  Very long texts are cut whole, block after block.  Equal rows
give equal rows, an empty table gives an empty one, other columns are ignored.  A
text that holds one of the marks stays plain, since its output could not be told
apart; in every other output each mark stands exactly once (a mark begins with
the only ``<`` in it, so none arises where two parts meet).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.textfeatures import slices
from loomgraph.plans.durable import arrow_rows

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that stay plain, and of the others that begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
#: Most code points of a word, and of white space, in a block; blocks whose arrays a task remembers before it starts anew.
BLOCK, REMEMBERED = 64, 400_000
#: Code points that are matched by one call.
CALL = 128
#: Documents of an Arrow batch, and of what Python holds at once.
ROWS = 500


_BLOCKS = re.compile(rf"\S{{1,{BLOCK}}}\s{{0,{BLOCK}}}|\s{{1,{BLOCK}}}")


class Splitter:
    """The Split pre-tokenizer with one code point as its isolated match, and the arrays of blocks that it has matched."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex("(?m:.)"), behavior="isolated")  # in this syntax m lets the dot match line breaks
        self.known: dict[str, tuple[int, ...]] = {}
        self.shapes: dict[tuple[int, ...], tuple[int, ...]] = {}

    def learn(self, blocks: Iterable[str]) -> None:
        """Match the blocks that are not known."""
        wanted = set(blocks)
        new = [b for b in wanted if b not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.shapes.clear()
            new = list(wanted)
        group, size = [], 0
        for block in new:
            group.append(block)
            size += len(block)
            if size >= CALL:
                self._match(group)
                group, size = [], 0
        self._match(group)

    def _match(self, group: list[str]) -> None:
        ends = [end for _, (_, end) in self.split.pre_tokenize_str("".join(group))] if group else []
        start = at = 0
        for block in group:
            upto = bisect_right(ends, start + len(block), at)
            own = tuple(end - start for end in ends[at:upto])
            self.known[block] = self.shapes.setdefault(own, own)  # equal arrays are kept once
            start, at = start + len(block), upto

    def arrays(self, blocks: list[str]) -> list[tuple[int, ...]]:
        """Where the matches of each block end, in code points."""
        found = list(map(self.known.get, blocks))
        if None in found:
            self.learn(blocks)
            found = [self.known[b] for b in blocks]
        return found


class Offsets:
    """The code-point offsets of one text, as those of its blocks."""

    def __init__(self, splitter: Splitter, text: str, blocks: list[str] | None = None):
        self.text = text
        self.blocks = _BLOCKS.findall(text) if blocks is None else blocks
        self.arrays = splitter.arrays(self.blocks)
        self.n = sum(map(len, self.arrays))

    def end(self, rank: int) -> int:
        """Where the first ``rank`` matches end."""
        if not rank:
            return 0
        upto = list(accumulate(map(len, self.arrays)))
        k = bisect_left(upto, rank)
        return sum(map(len, self.blocks[:k])) + self.arrays[k][rank - 1 - (upto[k - 1] if k else 0)]

    def cut(self, lo: int, hi: int) -> tuple[str, str, str]:
        a, b = self.end(lo), self.end(hi)
        return self.text[:a], self.text[a:b], self.text[b:]


def draws(doc_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def rearranged(offsets: Offsets, doc_id: object, plain: int, suffix_first: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = offsets.text
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not offsets.n or h3 % 100 >= 100 - plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return offsets.n, "plain", None, None, text
    lo, hi = sorted((h1 % (offsets.n + 1), h2 % (offsets.n + 1)))
    prefix, middle, suffix = offsets.cut(lo, hi)
    if h4 % 100 < suffix_first:
        return offsets.n, "spm", lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return offsets.n, "psm", lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(documents: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output of every document."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in slices(batches, ROWS):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            blocks = [_BLOCKS.findall(t) for t in texts]
            splitter.learn(chain.from_iterable(blocks))
            rows = [rearranged(Offsets(splitter, t, b), d, plain, suffix_first, seed) for d, t, b in zip(batch.column(0).to_pylist(), texts, blocks, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = dict(documents.dtypes)["doc_id"]
    with arrow_rows(documents.sparkSession, ROWS):
        return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.char_length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: DuckDB SQL for the rows of op12.
OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST(('0x' || h[1:8]) AS UBIGINT) AS h1, CAST(('0x' || h[9:16]) AS UBIGINT) AS h2,
    CAST(('0x' || h[17:24]) AS UBIGINT) AS h3, CAST(('0x' || h[25:32]) AS UBIGINT) AS h4 FROM d
), f AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS lo, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1, n - hi) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
