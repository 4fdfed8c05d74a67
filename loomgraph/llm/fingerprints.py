"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

The canonical form of a text is its compatibility composition (NFKC), case
folded, with every run of white space as one space and none at the ends.  Its
fingerprint is 128 bits of xxhash64 under two seeds.  Rows of equal
fingerprints are grouped, and inside a bucket the canonical bytes themselves
are compared, so a hash collision never joins two documents.

The likeness of two fingerprints is 1 if they are equal and 0 otherwise: the
digest is exact.  NFKC and case folding come from the ICU library (``com.ibm.icu``)
that Spark itself ships for its collations.

Nulls: a null text is the empty text; rows without doc_id come after all others,
in the order of their texts' hashes.  Equal texts have equal fingerprints;
repeated rows, and rows of one doc_id, follow each other in the order of their
texts' hashes.  Very long texts are digested whole.  An empty table gives an
empty result; a single row is its own next document.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.durable import checked_join, global_rank, stored

#: Ids in a block inside which the next document is found by a window, and blocks of rows without an id.
BLOCK, NULL_BLOCKS = 1024, 1 << 20
#: Number of the first block of rows without an id, beyond those of all long ids.
NULL_BLOCK = 1 << 54


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC once more, white space folded."""
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.trim(F.regexp_replace(compose(fold(compose(text))), r"[\s\p{Z}]+", " "))


def fingerprint_of(canon: Column) -> Column:
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half(1), half(2))


def fingerprint(text: Column) -> Column:
    return fingerprint_of(canonical(text))


def copies(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """For each doc_id of ``prints`` (doc_id, fingerprint) the first document of equal canonical bytes.

    Only buckets of several documents are read again, and their bytes are
    grouped as they are, with one row for each bucket and text leaving a task.
    """
    buckets = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("copy_of"))
    several = stored(buckets.where("n > 1").select("fingerprint"), "buckets")
    canon = documents.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("canon"))
    canon = checked_join(canon.withColumn("fingerprint", fingerprint_of(F.col("canon"))), several, "fingerprint", "left_semi")
    exact = canon.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"))
    exact = stored(exact.select("fingerprint", "copy_of", "n_copies", F.sha2("canon", 256).alias("sha")), "byte-groups")
    mixed = exact.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fingerprint")
    clean = exact.join(mixed, "fingerprint", "left_anti").select("fingerprint", "copy_of", "n_copies")
    out = prints.join(clean, "fingerprint", "left")
    if mixed.limit(1).count():  # a collision of 128 bits: those rows are told apart by their bytes
        odd = canon.join(mixed, "fingerprint", "left_semi").withColumn("sha", F.sha2("canon", 256)).join(exact, ["fingerprint", "sha"])
        odd = odd.groupBy(F.col("doc_id").alias("d"), F.col("fingerprint").alias("f")).agg(F.min("copy_of").alias("c"), F.max("n_copies").alias("n"))
        out = out.join(odd, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fingerprint") == F.col("f")), "left")
        out = out.withColumns({"copy_of": F.coalesce("copy_of", "c"), "n_copies": F.coalesce("n_copies", "n")}).drop("c", "n", "d", "f")
    return out.withColumns({"copy_of": F.coalesce("copy_of", "doc_id"), "n_copies": F.coalesce("n_copies", F.lit(1).cast("long"))})


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last half replaced by the beginning of the next
    document by ascending doc_id (the first follows the last).  The next
    document is found by one window inside blocks of ids, to each of which a
    copy of the first row of the block after it is added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.xxhash64(text)
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), NULL_BLOCK + F.pmod(turn, F.lit(NULL_BLOCKS)))
    rows = documents.select("doc_id", text.alias("text"), turn.alias("turn"), block.alias("block"))
    firsts = stored(rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "turn")).alias("f")).select("block", "f.doc_id", "f.turn"), "blocks")
    total = max(firsts.count(), 1)
    ranked = global_rank(firsts, ["block"])
    before = ranked.select(F.col("block").alias("prior"), F.expr(f"(rank + 1) % {total}").alias("rank")).join(ranked, "rank").select("prior", "block", "doc_id", "turn")
    before = stored(before, "block-firsts").alias("b")
    # one row for each block: repeated rows are alike
    same = (F.col("r.block") == F.col("b.block")) & F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.turn") == F.col("b.turn"))
    heads = checked_join(rows.alias("r"), before, same).groupBy("b.prior").agg(F.min("r.text").alias("text"))
    heads = heads.select(F.lit(None).alias("doc_id"), "text", F.lit(0).alias("turn"), F.col("prior").alias("block"), F.lit(True).alias("is_head"))
    rows = rows.withColumn("is_head", F.lit(False)).unionByName(heads).withColumn("fingerprint", fingerprint(F.col("text")))
    w = Window.partitionBy("block").orderBy("is_head", F.col("doc_id").asc_nulls_last(), "turn")
    whole = rows.withColumns({"next_text": F.lead("text").over(w), "next_print": F.lead("fingerprint").over(w)})
    whole = whole.where("NOT is_head").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    out = whole.select("doc_id", "n_chars", "fingerprint", "next_print", edited.alias("edited"))
    out = out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print",
    )
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    out = stored(out.withColumns({"near_edited": alike("edited_fingerprint"), "near_next": alike("next_print")}).drop("next_print"), "prints")
    return copies(documents, out)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
