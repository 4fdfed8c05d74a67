"""Sharding by minimax contiguous partition.

Rows of equal text form one atomic group; groups stand in the order of a 64-bit
hash of their text.  The smallest shard capacity that lets the ordered groups
be cut into ``n_shards`` contiguous runs is found by binary search, each
capacity checked greedily, and the groups are cut there.

The driver never holds a size for every group.  It begins with sums over 2**16
cells of the hash space, computes a lower and an upper bound of the capacity
(a cell that holds several groups is once taken as divisible, once as solid),
splits only the cells in which a cut can still fall, and repeats until both
bounds meet.  A level looks at a few thousand cells however many rows there are.

Nulls: a null text has no bytes (size 16) and is one group with the empty text;
a null doc_id is kept and comes first in its group.  Very long texts are one
group like any other: a shard may be as large as the largest group.  Ties inside
a group go by doc_id and size.  Equal rows stay in one group.  An empty table gives an empty result.  Columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.durable import global_rank, stored

#: Bits of the hash by which the first cells are cut, and by which a cell is split.
FIRST_BITS, MORE_BITS = 16, 6
ROW_OVERHEAD = 16


class _Cells:
    """Cells of the hash space in order: low key (unsigned), bits, bytes, groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.rows = rows
        self.size = np.array([r[2] for r in rows], np.int64)
        self.solid = np.array([r[3] <= 1 or r[1] >= 63 for r in rows], bool)
        self.ends = np.cumsum(self.size)
        self.total = int(self.ends[-1]) if rows else 0

    def reach(self, at: int, capacity: int, fluid: bool) -> int:
        """How far (in bytes of the prefix) a shard that begins at ``at`` can go."""
        goal = at + capacity
        if goal >= self.total:
            return self.total
        k = int(np.searchsorted(self.ends, goal, "right"))
        start = int(self.ends[k - 1]) if k else 0
        return goal if fluid and not self.solid[k] else max(at, start)

    def walk(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity, fluid)
            cuts.append(at)
        return cuts

    def least(self, shards: int, fluid: bool) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, fluid)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _unsigned(key: Column) -> Column:
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def _cells_of(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    cell = F.shiftrightunsigned(_unsigned(F.col("key")), 64 - bits)
    got = groups.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["cell"] << (64 - bits), bits, r["b"], r["n"]) for r in got]


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the (signed) first keys of shards 1, 2, ...

    ``groups``: key long (in signed order), bytes long; one row a group.
    """
    spark = groups.sparkSession
    cells = _Cells(_cells_of(groups, FIRST_BITS))
    if not cells.rows:
        return 0, []
    while True:
        low, high = cells.least(n_shards, True), cells.least(n_shards, False)
        if low == high:
            break
        begins, ends = cells.walk(low, n_shards, False), cells.walk(high, n_shards, True)
        split: set[int] = set()
        for a, b in zip(begins, ends, strict=True):
            i, j = np.searchsorted(cells.ends, [a, max(a, b)], "right")
            split |= {k for k in range(int(i), min(int(j), len(cells.rows) - 1) + 1) if not cells.solid[k]}
        if not split:
            break
        kept = [r for k, r in enumerate(cells.rows) if k not in split]
        for bits in {cells.rows[k][1] for k in split}:
            own = [(r[0] >> (64 - bits),) for k, r in enumerate(cells.rows) if k in split and r[1] == bits]
            few = spark.createDataFrame(own, "cell long")  # a few thousand at any size
            inside = groups.withColumn("cell", F.shiftrightunsigned(_unsigned(F.col("key")), 64 - bits)).join(F.broadcast(few), "cell", "left_semi")
            kept += _cells_of(inside, min(63, bits + MORE_BITS))
        cells = _Cells(kept)
    firsts = []
    for at in cells.walk(high, n_shards, False):
        if at < cells.total:
            k = int(np.searchsorted(cells.ends, at, "right"))
            firsts.append(cells.rows[k][0] - (1 << 63))
    return high, firsts


def shard(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """Deal all documents into at most ``n_shards`` shards of nearly equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard; slots are
    gapless from 0 in each shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        documents.select(
            "doc_id",
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, firsts = minimax_cuts(groups, n_shards)
    number = F.lit(0)
    for first in firsts:
        number = number + F.when(F.col("key") >= F.lit(first).cast("long"), 1).otherwise(0)
    rows = rows.withColumn("shard", number.cast("int"))
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    before = [sum(n for s, n in counts.items() if s < k) for k in range(n_shards)]
    ranked = global_rank(rows, ["key", "doc_id", "size"])
    start = F.array(*[F.lit(b).cast("long") for b in before])
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - start[F.col("shard")]).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
