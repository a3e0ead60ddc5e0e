"""Binary edge lists as a Spark data source, ``format("edgebin")``.

A file is records of two or three little-endian unsigned integers of 32 or 64 bits: source, target and,
if ``weighted``, a weight. Partitions are ranges of whole records; an incomplete one at a file's end is
ignored. Options: ``bits`` (32 or 64), ``weighted``, ``offset`` (bytes to skip) and ``records`` (how many
to read at most, from the offset), the last two for single files, ``partition_bytes``.
Ids of 2**63 or more are refused, as Spark has no unsigned type.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomgraph.plans.shipping import ship

CHUNK = 1 << 20


def _columns(weighted: bool) -> list[str]:
    return ["src", "dst"] + ["weight"] * weighted


def _open(path: str) -> tuple[pa_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pa_fs.LocalFileSystem(), path


class _Range(InputPartition):
    def __init__(self, path: str, first: int, records: int):
        self.path, self.first, self.records = path, first, records


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = np.dtype("<u4" if int(options.get("bits", 64)) == 32 else "<u8")
        self.weighted = options.get("weighted", "false").lower() == "true"
        self.offset, self.limit = int(options.get("offset", 0)), int(options.get("records", -1))
        self.size = len(_columns(self.weighted)) * self.kind.itemsize
        self.part = max(1, int(options.get("partition_bytes", 64 << 20)) // self.size)

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        if info.type == pa_fs.FileType.Directory:
            files = [f for f in fs.get_file_info(pa_fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        elif info.is_file:
            files = [info]
        else:
            raise FileNotFoundError(self.path)
        found: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            count = max(0, f.size - self.offset) // self.size
            count = min(count, self.limit) if self.limit >= 0 else count
            found += [_Range(f.path, at, min(self.part, count - at)) for at in range(0, count, self.part)]
        return found or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = _columns(self.weighted)
        if not partition.records:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as f:
            for at in range(partition.first, partition.first + partition.records, CHUNK):
                n = min(CHUNK, partition.first + partition.records - at)
                raw = f.read_at(n * self.size, self.offset + at * self.size)
                values = np.frombuffer(raw, self.kind).reshape(-1, len(names))
                if self.kind.itemsize == 8 and (values >> np.uint64(63)).any():
                    raise ValueError("an id of 2**63 or more has no Spark type")
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in values.T], names)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.kind = "<u4" if int(options.get("bits", 64)) == 32 else "<u8"
        self.weighted = options.get("weighted", "false").lower() == "true"
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        fs.create_dir(root)
        name = f"{root}/.part-{uuid.uuid4().hex}.bin"  # hidden until the whole write is committed
        with fs.open_output_stream(name) as f:
            for b in batches:
                columns = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _columns(self.weighted)]
                f.write(np.stack(columns, axis=1).astype(self.kind).tobytes())  # the low bits of larger ids
        return _Written(name)

    def commit(self, messages: list[_Written]) -> None:
        fs, root = _open(self.path)
        mine = {m.path for m in messages if m}
        if self.overwrite:
            for f in fs.get_file_info(pa_fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.path not in mine and f"{root}/{f.base_name}" not in mine:
                    fs.delete_file(f.path)
        for m in mine:
            head, _, tail = m.rpartition("/")
            fs.move(m, f"{head}/{tail.lstrip('.')}")

    def abort(self, messages: list[_Written]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.path)


class _WordWriter(_Writer):
    """Writes one column of words; parts are named by their place in the order of the table's partitions."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.path)
        fs.create_dir(root)
        context = TaskContext.get()
        name = f"{root}/.part-{context.partitionId():06d}-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(name) as f:
            for b in batches:
                f.write(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(self.kind).tobytes())
        return _Written(name)


class WordBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wordbin"

    def schema(self) -> str:
        return "value long"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _WordWriter(dict(self.options), overwrite)


def write_words(words: DataFrame, path: str, bits: int = 32) -> None:
    """One long column as raw little-endian words, in the order of the partitions and of the rows in each."""
    ship(words.sparkSession)
    words.sparkSession.dataSource.register(WordBinary)
    words.write.format("wordbin").option("bits", bits).mode("overwrite").save(path)


class EdgeBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgebin"

    def schema(self) -> str:
        return ", ".join(f"{c} long" for c in _columns(self.options.get("weighted", "false").lower() == "true"))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_edges(spark: SparkSession, path: str, bits: int = 64, weighted: bool = False, offset: int = 0, records: int = -1) -> DataFrame:
    ship(spark)
    spark.dataSource.register(EdgeBinary)
    reader = spark.read.format("edgebin").option("bits", bits).option("weighted", str(weighted).lower())
    return reader.option("offset", offset).option("records", records).load(path)


def write_edges(edges: DataFrame, path: str, bits: int = 64, weighted: bool = False, mode: str = "overwrite") -> None:
    ship(edges.sparkSession)
    edges.sparkSession.dataSource.register(EdgeBinary)
    rows = edges.select(*_columns(weighted))
    rows.write.format("edgebin").option("bits", bits).option("weighted", str(weighted).lower()).mode(mode).save(path)
