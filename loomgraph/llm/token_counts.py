"""Token counts by a count-only Viterbi pass.

An Aho-Corasick automaton over a unigram vocabulary gives every piece that
ends at a position; dynamic programming carries the best score and its number
of pieces, never the pieces.  Ties follow the unigram tokenizer exactly: a
later candidate must be strictly better, candidates come by ascending start,
and a character that is no piece of its own gets the unknown score (the
vocabulary's least minus 10) and then counts as its UTF-8 bytes.

The vocabulary is the normal pieces of a public SentencePiece file; control,
unknown and byte pieces never match text.  That file holds merge ranks, not
log-probabilities, and tokenizers are not trained here, so the piece of rank r
gets the log-probability of the Zipf-Mandelbrot law, ``1 / (r + ZIPF_SHIFT)``
over the sum for all pieces.  A file of a unigram model keeps its own scores.
Spaces become the file's word mark and one is put before a text that begins
without.  As no piece of it goes on past a word mark, words can be scored one by
one and remembered.

Nulls: a null or empty text has 0 tokens and score 0; a null doc_id is kept.
Very long texts are counted whole: the pass needs one score and one count for
each character of a word.  Repeated rows are counted each.  An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: The shift of the Zipf-Mandelbrot law that turns ranks into probabilities.
ZIPF_SHIFT = 2.7
#: Words remembered by a worker before it forgets them all.
REMEMBERED = 200_000
_models: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a SentencePiece file and their log-probabilities, in the order of their ids."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    other = (p.is_unknown, p.is_control, p.is_byte, p.is_unused)
    normal = [i for i in range(p.get_piece_size()) if not any(f(i) for f in other)]
    scores = [p.get_score(i) for i in normal]
    if all(s == int(s) for s in scores):  # ranks of merges
        order = sorted(range(len(normal)), key=lambda k: -scores[k])
        total = math.log(sum(1.0 / (r + ZIPF_SHIFT) for r in range(len(normal))))
        for r, k in enumerate(order):
            scores[k] = -math.log(r + ZIPF_SHIFT) - total
    return [(p.id_to_piece(i), s) for i, s in zip(normal, scores, strict=True)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """Count and score of one stretch of marked text."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        single, unknown = self.single, self.unknown
        at = 0  # ends before `at` are final

        def close(end: int) -> None:
            """The unknown candidates of the characters up to ``end``: they start last."""
            nonlocal at
            while at < end:
                c = text[at]
                at += 1
                if c not in single:
                    s = score[at - 1] + unknown
                    if score[at] is None or s > score[at]:
                        score[at], count[at] = s, count[at - 1] + len(c.encode("utf-8", "surrogatepass"))

        for last, (length, value) in self.automaton.iter(text):
            end = last + 1
            if end - 1 > at:
                close(end - 1)
            start = end - length
            if score[start] is None:
                continue
            s = score[start] + value
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[start] + 1
        close(n)
        return count[n], score[n] or 0.0

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        if not self.by_word:
            return self.word(text)
        seen, n, total = self.seen, 0, 0.0
        for w in _WORD.findall(text):
            got = seen.get(w)
            if got is None:
                got = self.word(w)
                if len(w) < 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[w] = got
            n += got[0]
            total += got[1]
        return n, total


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score (the best path's) of every whole text."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = Counter(vocabulary(path))
        counter = _models[path]
        for batch in batches:
            got = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return documents.select("doc_id", "text").mapInArrow(count, f"doc_id {dict(documents.dtypes)['doc_id']}, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
