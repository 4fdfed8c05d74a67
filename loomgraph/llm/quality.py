"""Quality classifier: hashed word n-gram logistic regression fitted by FTRL-proximal.

Features are hashed word unigrams and bigrams, case folded, and the shapes of
words and signs (length, capitals), each with ``log1p(count)`` scaled by the
row's norm.  The fit sees a bounded sample of labelled rows of the learning
folds; every row's whole text is scored as a sparse dot product.

Nulls: a null or empty text has the score of the bias alone.  Rows without a
label value are not learnt from, repeated labels of one id count once, and with
no label at all every score is 0.5.  A null doc_id is kept and never held out.
Very long texts are read whole, a stretch at a time.  A score of exactly the
threshold is predicted 1.  Repeated rows are scored each.  An empty table gives
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
from loomgraph.llm.textfeatures import by_row, labelled_sample, lists, ngrams, remainder, slices

SIZE = 1 << 18
#: Most labelled rows that a fit looks at.
SAMPLE_ROWS = 6000
#: Rows of the sample whose values are worked out at once.
ROWS_AT_ONCE = 256
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Short texts are not scaled up beyond this norm, and all are scaled by SCALE.
LEAST_NORM, SCALE = 6.0, 4.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, counts, and bounds by row."""
    f, c, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for first, end, data, off in chunks(array):
        h, rows = ngrams(data, off)
        one, count, bounds = by_row(h, rows, end - first, SIZE)
        f.append(one)
        c.append(count)
        b.append(bounds[1:] + b[-1][-1])
    return np.concatenate(f), np.concatenate(c), np.concatenate(b)


def values(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    v = np.log1p(counts)
    sums = np.concatenate([[0.0], np.cumsum(v * v)])
    norm = np.maximum(np.sqrt(np.maximum(sums[bounds[1:]] - sums[bounds[:-1]], 0)), LEAST_NORM)
    return SCALE * v / np.repeat(norm, np.diff(bounds))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def ftrl(f, v, bounds, y, alpha=0.3, beta=1.0, l1=0.02, l2=0.1, passes=2, seed=0) -> Model:
    """Follow-the-regularised-leader over the rows, each pass in another order."""
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            ix, x = f[bounds[i] : bounds[i + 1]], v[bounds[i] : bounds[i + 1]]
            zi, ni = z[ix], n[ix]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w @ x + bias, -500, 500))) - y[i]
            gx = g * x
            z[ix] += gx - (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / alpha * w
            n[ix] = ni + gx * gx
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        f, c, b = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(f, b), lists(np.minimum(c, 30000), b, pa.int16()), batch.column(2)], ["doc_id", "f", "c", "label"])


def fit(documents: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about ``sample_rows`` labelled rows for which ``learn`` holds."""
    kind = dict(documents.dtypes)["doc_id"]
    sample = labelled_sample(documents, labels, "quality", learn, sample_rows)
    table = sample.mapInArrow(_featurise, f"doc_id {kind}, f array<int>, c array<smallint>, label int").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return Model(np.zeros(SIZE, np.float32), 0.0)
    f, c = table["f"].combine_chunks(), table["c"].combine_chunks()
    bounds = f.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    counts, v = c.flatten().to_numpy(), np.empty(bounds[-1])
    for i in range(0, len(bounds) - 1, ROWS_AT_ONCE):
        at = bounds[i : i + ROWS_AT_ONCE + 1]
        v[at[0] : at[-1]] = values(counts[at[0] : at[-1]].astype(np.float64), at - at[0])
    model = ftrl(f.flatten().to_numpy(), v, bounds, table["label"].to_numpy())
    del table, f, c, counts, v
    pa.default_memory_pool().release_unused()  # the driver has little memory, and other stages need it
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in slices(batches):
            f, c, b = features(batch.column(1))
            sums = np.concatenate([[0.0], np.cumsum(weights[f].astype(np.float64) * values(c, b))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(sums[b[1:]] - sums[b[:-1]] + bias))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    model = fit(documents, labels, remainder(F.col("doc_id"), FOLDS) != HELD_OUT, sample_rows)
    held = (F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(-1)) == HELD_OUT).alias("held_out")
    return score(documents, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
