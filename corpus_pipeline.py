"""The corpus pipeline: toxicity, quality, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents.  Rejected ids
are few against the documents, so they are taken out by an anti-join that is
broadcast only after a check of its size.

Nulls and empty texts go through every stage (they score as clean, link with
nothing, hold no benchmark item and are packed as one end id).  Rows that
repeat a doc_id are one document to the near-duplicate stage, which keeps one.
Rows without a doc_id are judged like others: inside a stage they go by a number
made of their text, above all ids, so that of a group a row with an id stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, jaccard_join, packing, quality, toxicity
from loomgraph.llm.textfeatures import remainder
from loomgraph.plans.durable import arrow_rows, checked_join, stored

#: A document below this quality score goes; the stage is to keep clean documents.
LEAST_QUALITY = 0.5
#: Documents of a batch between files, the JVM and Python.
ROWS_A_BATCH = 1000


#: Numbers of rows without an id begin here.
NO_ID = 1 << 62


def _key() -> Column:
    """The id of a row, or a number of its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("long"), NO_ID + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(NO_ID >> 1)))


def _named(docs: DataFrame) -> DataFrame:
    """The documents with an id in every row."""
    return docs.withColumn("doc_id", _key())


def _without(docs: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    with arrow_rows(docs.sparkSession, ROWS_A_BATCH):
        gone = stored(bad.select(F.col("doc_id").alias("_key")).distinct(), name)
    return checked_join(docs.withColumn("_key", _key()), gone, "_key", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), toxicity.FOLDS) != toxicity.HELD_OUT)
    return _without(docs, toxicity.score(_named(docs), model).where(F.col("score") >= toxicity.THRESHOLD), "toxic")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, remainder(F.col("doc_id"), quality.FOLDS) != quality.HELD_OUT)
    return _without(docs, quality.score(_named(docs), model).where(F.col("score") < LEAST_QUALITY), "low-quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = stored(jaccard_join.linked_components(_named(docs)), "groups")
    kept = _without(docs, groups.where("doc_id <> component_id"), "near-duplicates")
    several = stored(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if several.limit(1).count():
        several, kept = several.withColumnRenamed("doc_id", "_key"), kept.withColumn("_key", _key())
        one = checked_join(kept, several, "_key", "left_semi").dropDuplicates(["_key"])
        kept = checked_join(kept, several, "_key", "left_anti").unionByName(one)
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.contamination(_named(docs), benchmark), "contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Learnt scores and tokenisation are beyond SQL; tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
