"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts, no confirmed clean ones.  A numpy
classifier minimises ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` (the
logistic loss; where the corrected term turns negative, its gradient is
followed upwards, as the non-negative estimator asks).  The class prior is the
share of toxic rows among labelled ones of the learning folds.  Features are
the presence of hashed words and word beginnings that stand out in confirmed
texts against unlabelled ones, so that one word counts in a text of any length.

Nulls: a null or empty text has the score of the bias alone.  With no confirmed
text every score is 0.  Rows without a label value are not learnt from;
repeated labels of one id count once; repeated rows are scored each.  A null
doc_id is kept and never held out.  Very long texts are read whole, a stretch at
a time.  A score of exactly the threshold is predicted 1.  An empty table gives
an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bytesets import chunks
from loomgraph.llm.quality import sigmoid
from loomgraph.llm.textfeatures import by_row, labelled_sample, lists, remainder, slices, word_stems

SIZE = 1 << 20
#: Most confirmed and most unlabelled rows that a fit looks at.
POSITIVE_ROWS, UNLABELLED_ROWS = 3000, 6000
#: Features of the samples that are looked at at once.
FEATURES_AT_ONCE = 1 << 18
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: A feature is used if it is in so many confirmed texts, so many times as frequent there, and if the
#: likelihood ratio of that exceeds EVIDENCE times the logarithm of the confirmed texts' number.
LEAST_TEXTS, LEAST_LIFT, EVIDENCE = 3, 3.0, 4.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features present, and bounds by row."""
    f, b = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for first, end, data, off in chunks(array):
        h, rows = word_stems(data, off)
        one, _, bounds = by_row(h, rows, end - first, SIZE)
        f.append(one)
        b.append(bounds[1:] + b[-1][-1])
    return np.concatenate(f), np.concatenate(b)


def _counted(f: np.ndarray) -> np.ndarray:
    """Times of each feature, without a wide copy of all of them."""
    n = np.zeros(SIZE, np.int64)
    for i in range(0, len(f), FEATURES_AT_ONCE):
        n += np.bincount(f[i : i + FEATURES_AT_ONCE], minlength=SIZE)
    return n


def nnpu(pf, pb, uf, ub, prior: float, rounds: int = 300, rate: float = 0.1, decay: float = 3e-4) -> Model:
    """Fit on presence features of confirmed (p) and unlabelled (u) rows; ``b``: bounds by row."""
    n_p, n_u = len(pb) - 1, len(ub) - 1
    in_p, in_u = _counted(pf), _counted(uf)
    expected = (in_u + 1) * n_p / max(n_u, 1)
    ratio = 2 * (in_p * np.log(np.maximum(in_p, 1) / expected) - (in_p - expected))
    chosen = np.flatnonzero((in_p >= LEAST_TEXTS) & (in_p > LEAST_LIFT * expected) & (ratio > EVIDENCE * np.log1p(n_p)))
    place = np.full(SIZE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def kept(f, b):
        x, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(f), FEATURES_AT_ONCE):
            one = place[f[i : i + FEATURES_AT_ONCE]]
            x.append(one[one >= 0].astype(np.int64))
            at.append(np.flatnonzero(one >= 0) + i)
        return np.concatenate(x), np.searchsorted(b, np.concatenate(at), "right") - 1

    (px, pr), (ux, ur) = kept(pf, pb), kept(uf, ub)
    k = len(chosen)
    w, m, s = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        zp = np.bincount(pr, w[px], n_p) + w[k]
        zu = np.bincount(ur, w[ux], n_u) + w[k]
        corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if corrected >= 0:
            gp, gu = np.full(n_p, -prior / n_p), sigmoid(zu) / n_u
        else:
            gp, gu = prior * sigmoid(zp) / n_p, -sigmoid(zu) / n_u
        g = np.append(np.bincount(px, gp[pr], k) + np.bincount(ux, gu[ur], k) + decay * w[:k], gp.sum() + gu.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(SIZE, np.float32)
    full[chosen] = w[:k]
    return Model(full, float(w[k]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        f, b = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(f, b)], ["doc_id", "f"])


def _collected(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    kind = dict(sample.dtypes)["doc_id"]
    table = sample.select("doc_id", "text").mapInArrow(_featurise, f"doc_id {kind}, f array<int>").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    f = table["f"].combine_chunks()
    b = f.offsets.to_numpy().astype(np.int64)
    return f.flatten().to_numpy(), b - b[0]


def fit(documents: DataFrame, labels: DataFrame, learn: Column, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on bounded samples of confirmed and of unlabelled rows for which ``learn`` holds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    prior = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).agg(F.avg("toxic")).first()[0]
    none = Model(np.zeros(SIZE, np.float32), -np.inf)
    if not prior:
        return none
    pf, pb = _collected(labelled_sample(documents, known.where("toxic = 1"), "toxic", F.lit(True), positive_rows))
    if len(pb) == 1:
        return none
    share = min(1.0, unlabelled_rows / max(documents.count(), 1))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1_000_003)) <= int(share * 1_000_003)
    uf, ub = _collected(documents.where(spread & learn))
    model = nnpu(pf, pb, uf, ub, float(prior))
    del pf, uf
    pa.default_memory_pool().release_unused()  # the driver has little memory, and other stages need it
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in slices(batches):
            f, b = features(batch.column(1))
            sums = np.concatenate([[0.0], np.cumsum(weights[f].astype(np.float64))])
            z = sums[b[1:]] - sums[b[:-1]] + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(np.isneginf(z), 0.0, sigmoid(z)))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    model = fit(documents, labels, remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    held = (F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(-1)) == HELD_OUT).alias("held_out")
    return score(documents, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
