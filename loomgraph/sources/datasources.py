"""Adapters as data sources: ``spark.read.format("bibtex").load(dir)`` and the code tree as a stream.

    register(spark)
    records = spark.read.format("rfc").load("/data/rfcs")
    nodes, edges = graph_of(records)
    changes = spark.readStream.format("code_tree").load("/data/repo")

The driver lists names, sizes and times; texts are only read in tasks.  Files
are dealt into partitions of about ``partitionBytes`` by name and size, so a
folder of many small files makes few tasks and one large file a task of its own;
a lost task reads its files again.

Folders are opened through ``pyarrow.fs``, so local paths and the stores it knows
(by the scheme of the URI) will do; Spark's own readers (:mod:`formats`) serve
stores that only Spark reaches.  Hidden and vendored folders and lock files are left
out.  Files that are no UTF-8 are read with replacement marks; files with a zero
byte in their first 8192 bytes are no texts and give nothing.  An empty folder gives
no rows; a folder that is not there is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomgraph.sources.formats import LOCKFILES, SKIPPED_DIRS
from loomgraph.sources.records import PARSERS, PATTERNS

#: Bytes of the files of a partition, what another file costs besides, and records of a batch.
PARTITION_BYTES, FILE_COST, BATCH = 64 << 20, 64 << 10, 4096

RECORD_SCHEMA = "path string, src string, dst string, relation string, label string, node_type int, weight double"
FILE_SCHEMA = "path string, size long, mtime double, hash string, text string"


@dataclass(frozen=True)
class Found:
    """A file below the root: its path there, bytes, and time of change in nanoseconds."""

    path: str
    size: int
    changed: int


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


def listed(root: str, pattern: str = "") -> list[Found]:
    """The files below a root whose names match, by path."""
    store, base = opened(root)
    if store.get_file_info(base).type == fs.FileType.File:
        i = store.get_file_info(base)
        return [Found("", i.size, i.mtime_ns or 0)]
    out, name = [], re.compile(pattern or "", re.I)
    for i in store.get_file_info(fs.FileSelector(base, recursive=True)):
        rel = i.path[len(base) :].lstrip("/")
        parts = rel.split("/")
        skipped = any(p in SKIPPED_DIRS or p.startswith((".", "_")) for p in parts[:-1]) or parts[-1].startswith((".", "_")) or parts[-1] in LOCKFILES
        if i.type == fs.FileType.File and not skipped and name.search(parts[-1]):
            out.append(Found(rel, i.size or 0, i.mtime_ns or 0))
    return sorted(out, key=lambda f: f.path)


def dealt(files: Sequence[Found], most: int) -> list[list[Found]]:
    """Files in turn of their names, in partitions of about ``most`` bytes."""
    out, held = [], 0
    for f in files:
        cost = f.size + FILE_COST
        if not out or held + cost > most:
            out.append([])
            held = 0
        out[-1].append(f)
        held += cost
    return out


def texts(root: str, files: Sequence[Found]) -> Iterator[tuple[Found, bytes, str]]:
    """Each file that is a text, with its bytes; a file that went meanwhile is left out."""
    store, base = opened(root)
    for f in files:
        try:
            with store.open_input_stream(f"{base}/{f.path}" if f.path else base) as s:
                data = s.read()
        except FileNotFoundError:
            continue
        if b"\0" not in data[:8192]:
            yield f, data, data.decode("utf-8", "replace")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_RECORDS = pa.schema([("path", pa.string()), ("src", pa.string()), ("dst", pa.string()), ("relation", pa.string()), ("label", pa.string()), ("node_type", pa.int32()), ("weight", pa.float64())])
_FILES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("hash", pa.string()), ("text", pa.string())])


class Files(InputPartition):
    def __init__(self, files: list[Found]):
        self.files = files


class RecordReader(DataSourceReader):
    """Graph records of all files of one format below a folder."""

    def __init__(self, name: str, options: dict):
        self.name, self.root = name, options["path"]
        self.pattern = options.get("pattern") or PATTERNS[name]
        self.most = int(options.get("partitionbytes") or PARTITION_BYTES)

    def partitions(self) -> list[Files]:
        return [Files(part) for part in dealt(listed(self.root, self.pattern), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        parse = PARSERS[self.name]
        rows = ((f.path or self.root.rpartition("/")[2], *r) for f, _, text in texts(self.root, partition.files) for r in parse(f.path or self.root.rpartition("/")[2], text))
        return _batches(rows, _RECORDS)


class TreeReader(DataSourceReader):
    """All files below a folder as rows."""

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("partitionbytes") or PARTITION_BYTES)
        self.pattern = options.get("pattern") or ""

    def partitions(self) -> list[Files]:
        return [Files(part) for part in dealt(listed(self.root, self.pattern), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import hashlib

        rows = ((f.path, f.size, f.changed / 1e9, hashlib.sha256(data).hexdigest(), text) for f, data, text in texts(self.root, partition.files))
        return _batches(rows, _FILES)


class TreeStream(DataSourceStreamReader):
    """Files that are new or changed since the last batch, in the order of (time of change, path).

    An offset is the last (time, path) that was given out; a batch is what lies
    between two offsets, so a batch that runs again sees the same files unless
    they changed once more, and then the later batch brings them again.  Files
    younger than ``settleSeconds`` wait, so that one whose time ties with the last
    given out is not passed over.  Removed files are found by the tick
    (:func:`loomgraph.streaming.ledgers.tick`), not here.
    """

    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern") or ""
        self.most, self.settle = int(options.get("partitionbytes") or PARTITION_BYTES), float(options.get("settleseconds") or 0)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        import time

        upto = time.time_ns() - int(self.settle * 1e9)
        last = max(((f.changed, f.path) for f in listed(self.root, self.pattern) if f.changed <= upto), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (start["changed"], start["path"]), (end["changed"], end["path"])
        return [Files(part) for part in dealt([f for f in listed(self.root, self.pattern) if a < (f.changed, f.path) <= b], self.most)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return TreeReader({"path": self.root}).read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""


class CodeTree(DataSource):
    """``code_tree``: path, size, mtime, hash and text of every text file below a folder, as a table or as a stream."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(dict(self.options))


class _Records(DataSource):
    """Graph records of the files of one format."""

    format = ""

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.format, dict(self.options))


class Bibtex(_Records):
    format = "bibtex"


class Crossref(_Records):
    format = "crossref"


class Jats(_Records):
    format = "jats"


class Patent(_Records):
    format = "patent"


class Rfc(_Records):
    format = "rfc"


class Light(_Records):
    format = "light"


class Descriptor(_Records):
    format = "descriptor"


class Code(_Records):
    format = "code"


SOURCES: tuple[type[DataSource], ...] = (CodeTree, Bibtex, Crossref, Jats, Patent, Rfc, Light, Descriptor, Code)


def register(spark: SparkSession) -> None:
    """Make every source known to ``spark.read.format``."""
    for source in SOURCES:
        spark.dataSource.register(source)


def graph_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (external_id, label, node_type; each once) and distinct edges (src, dst, relation, weight) of records."""
    nodes = records.where("relation IS NULL").groupBy(F.col("src").alias("external_id")).agg(F.min("label").alias("label"), F.min("node_type").alias("node_type"))
    return nodes, records.where("relation IS NOT NULL").select("src", "dst", "relation", "weight").distinct()
