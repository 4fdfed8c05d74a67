"""Language identification by a linear-chain conditional random field over words.

Every word has hashed features: its beginnings and endings, its byte n-grams,
and itself if it is in the lexicon of frequent learnt words.  Emission weights
and transitions are fitted together by the gradient of the conditional
likelihood (forward-backward) on code-switched sequences made of spans of the
learning rows' texts.  A document's words get their language probabilities by
forward-backward, all documents of a batch in step; the document's language has
the largest sum, and the score is its mean probability.

Nulls: a null text, or one without a letter, is ``und`` with score 0, and so is
every row if nothing can be learnt.  Rows without a language are not learnt
from.  Equal sums go to the language that is first in order.  A null doc_id is
kept and never held out.  Very long texts are labelled whole: their words are
one step each, whatever else is in the batch.  Repeated rows are labelled each.
An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bytesets
from loomgraph.llm.bytesets import _LOWER, columns, mix, runs
from loomgraph.llm.textfeatures import remainder

SIZE = 1 << 16
FOLDS, HELD_OUT = 5, 0
#: Most learning rows that a fit looks at, and words of one language it takes from them.
SAMPLE_ROWS, SAMPLE_WORDS = 1200, 60_000
#: A word is in the lexicon if the sample has it so often.
LEXICON = 5
#: Bytes of text labelled at once.
BATCH_BYTES = 3 << 20
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray  # SIZE x languages
    transition: np.ndarray  # languages x languages, log weights
    lexicon: np.ndarray  # sorted hashes of words


class Words:
    """The words of some rows, and the features of the distinct ones."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = _LOWER[data]
        self.starts, self.ends, self.at = runs(_LETTER[data], off)
        hashes = np.zeros(len(self.starts), np.uint64)
        for a in range(0, len(self.starts), 1 << 17):  # powers stay short
            s, e = self.starts[a : a + (1 << 17)], self.ends[a : a + (1 << 17)]
            hashes[a : a + (1 << 17)] = bytesets.span_hashes(low[s[0] : e[-1]], s - s[0], e - s[0])
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = self.starts[first], self.ends[first]
        n = e - s
        # the distinct words' bytes, each between two marks
        self.bounds = np.concatenate([[0], np.cumsum(n + 2)])
        flat = np.full(self.bounds[-1], 1, np.uint64)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[inside + np.repeat(self.bounds[:-1] + 1, n)] = low[inside + np.repeat(s, n)]
        self.flat = flat

    def features(self, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features and the distinct word of each."""
        b, f = self.bounds, self.flat
        total, word = len(f), np.repeat(np.arange(len(b) - 1), np.diff(b))
        out, of = [], []
        for k in (2, 3, 4):  # n-grams; those at a mark are the affixes
            if total < k:
                continue
            h = np.full(total - k + 1, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(1099511628211) + f[j : total - k + 1 + j]
            ok = word[: total - k + 1] == word[k - 1 :]
            out.append(mix(h)[ok])
            of.append(word[: total - k + 1][ok])
        if len(lexicon):
            at = np.searchsorted(lexicon, self.hashes)
            at[at == len(lexicon)] = 0
            known = np.flatnonzero(lexicon[at] == self.hashes)
            out.append(mix(self.hashes[known] + np.uint64(99)))
            of.append(known)
        return (np.concatenate(out) % np.uint64(SIZE)).astype(np.int64), np.concatenate(of)


class Steps:
    """Words laid out by their position in their row, rows by falling length."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        self.n = n[n > 0]
        top = int(self.n[0]) if len(self.n) else 0
        self.active = np.searchsorted(-self.n, -np.arange(1, top + 1), "right")  # rows at each step
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.rank = rank
        row = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.base[t] + rank[row]

    def forward_backward(self, weight: np.ndarray, jump: np.ndarray, each: bool = False):
        """Sums of word posteriors by row (in the layout's order); also each and the transitions' if asked.

        ``weight``: emissions (not logs), in the layout's order; ``jump``: transitions.
        """
        k, steps = weight.shape[1], len(self.active)
        alpha = np.empty_like(weight)
        sums = np.zeros((len(self.n), k), np.float64)
        if not steps:
            return sums, weight[:0], np.zeros((k, k))
        base, active = self.base.tolist(), self.active.tolist()
        a = weight[: active[0]] / weight[: active[0]].sum(1, keepdims=True)
        alpha[: active[0]] = a
        for t in range(1, steps):
            n, b = active[t], base[t]
            a = (a[:n] @ jump) * weight[b : b + n]
            a /= a.sum(1, keepdims=True)
            alpha[b : b + n] = a
        pairs = np.zeros((k, k))
        beta = np.ones((active[-1], k), weight.dtype)
        for t in range(steps - 1, -1, -1):
            n, b = active[t], base[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k), weight.dtype)])
            g = alpha[b : b + n] * beta
            g /= g.sum(1, keepdims=True)
            sums[:n] += g
            if t:
                after = beta * weight[b : b + n]
                if each:
                    before = alpha[base[t - 1] : base[t - 1] + n]
                    x = before[:, :, None] * jump[None] * after[:, None, :]
                    pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
                beta = after @ jump.T
                beta /= beta.sum(1, keepdims=True)
            if each:
                alpha[b : b + n] = g
        return sums, alpha, pairs


def emissions(words: Words, model: Model) -> np.ndarray:
    """Emission weights of every word, scaled to a largest of 1."""
    f, of = words.features(model.lexicon)
    k = model.emission.shape[1]
    e = np.stack([np.bincount(of, model.emission[f, j], len(words.hashes)) for j in range(k)], 1)
    e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30.0)).astype(np.float32)
    return e[words.which]


def train(texts: list[str], langs: list[str], rounds: int = 25, rate: float = 0.15, decay: float = 1e-6, seed: int = 0) -> Model | None:
    """Fit on code-switched sequences of spans of the given texts."""
    languages = sorted(set(langs))
    array = pa.array(texts, pa.large_string())
    if not languages or not len(texts):
        return None
    words = Words(*columns(array))
    if not len(words.starts):
        return None
    k, label = len(languages), np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    spans = []
    for j in range(k):
        taken = 0
        for row in rng.permutation(np.flatnonzero(label == j)):
            a, b = int(words.at[row]), int(words.at[row + 1])
            while a < b and taken < SAMPLE_WORDS:
                n = min(b - a, int(rng.integers(4, 60)))
                spans.append((a, n, j))
                a, taken = a + n, taken + n
    rng.shuffle(spans)
    token = np.concatenate([np.arange(a, a + n) for a, n, _ in spans])
    gold = np.concatenate([np.full(n, j) for _, n, j in spans])
    cut = np.arange(0, len(token), 200)
    lengths = np.diff(np.append(cut, len(token)))
    count = np.bincount(words.which[token], minlength=len(words.hashes))
    model = Model(languages, np.zeros((SIZE, k)), np.zeros((k, k)), words.hashes[count >= LEXICON])
    f, of = words.features(model.lexicon)
    steps = Steps(lengths)
    which = words.which[token]
    goal = np.zeros((k, k))
    inner = np.ones(len(token), bool)
    inner[cut] = False
    np.add.at(goal, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    m, s = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, rounds + 1):
        e = np.stack([np.bincount(of, model.emission[f, j], len(words.hashes)) for j in range(k)], 1)
        w = np.exp(np.maximum(e - e.max(1, keepdims=True), -30.0))[which]
        laid = np.empty_like(w)
        laid[steps.place] = w
        _, each, pairs = steps.forward_backward(laid, np.exp(model.transition), True)
        wrong = each[steps.place]
        wrong[np.arange(len(gold)), gold] -= 1
        by_word = np.stack([np.bincount(which, wrong[:, j], len(words.hashes)) for j in range(k)], 1)
        g = np.stack([np.bincount(f, by_word[of, j], SIZE) for j in range(k)], 1) / len(gold) + decay * model.emission
        gt = (pairs - goal) / len(gold) + 1e-4 * model.transition
        for i, (x, d) in enumerate(((model.emission, g), (model.transition, gt))):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.99 * s[i] + 0.01 * d * d
            x -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-9)
    return Model(languages, model.emission.astype(np.float32), model.transition.astype(np.float32), model.lexicon)


def label(array: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and number of words of each row."""
    data, off = columns(array)
    words = Words(data[off[0] : off[-1]], off - off[0])
    lengths = np.diff(words.at)
    steps = Steps(lengths)
    e = emissions(words, model)
    laid = np.empty_like(e)
    laid[steps.place] = e
    sums = np.zeros((len(lengths), len(model.languages)))
    got, _, _ = steps.forward_backward(laid, np.exp(model.transition))
    sums[steps.order[: len(got)]] = got
    best = sums.argmax(1)
    score = sums[np.arange(len(best)), best] / np.maximum(lengths, 1)
    names = [model.languages[j] for j in best.tolist()]
    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
    for i in np.flatnonzero(ascii_letter[off[1:]] == ascii_letter[off[:-1]]).tolist():
        if not any(c.isalpha() for c in (array[i].as_py() or "")):
            names[i], score[i] = UNKNOWN, 0.0
    return names, np.clip(score, 0, 1), lengths


def fit(documents: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most about ``sample_rows`` rows for which ``learn`` holds and the language is known."""
    known = documents.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) <= int(share * 1_000_003))
    table = chosen.select("doc_id", "text", "lang").toArrow().sort_by("doc_id")
    return train(table["text"].to_pylist(), table["lang"].to_pylist())


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    kind = dict(documents.dtypes)["doc_id"]
    if model is None:
        return documents.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = documents.sparkSession.sparkContext.broadcast(model)  # SIZE weights a language, and a lexicon of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            text = batch.column(1).fill_null("").cast(pa.large_string())
            off, at = columns(text)[1], 0
            while at < batch.num_rows:
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(off, off[at] + BATCH_BYTES, "right")) - 1))
                names, score, _ = label(text.slice(at, end - at), model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                at = end

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(documents, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    held = (F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(-1)) == HELD_OUT).alias("held_out")
    return predict(documents, model).select("doc_id", held, "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
