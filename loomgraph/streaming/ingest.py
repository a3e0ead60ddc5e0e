"""Streaming ingest into a versioned edge table, and snapshots of it.

Each micro-batch is written as a run of its own and becomes visible with the next manifest. A manifest lists the
runs and the versions in each; it is a small file whose number is one more than the last one's, written aside and
renamed into place, so readers see all of a change or nothing, and of two writers with one number one fails. A
batch that is delivered again finds its version in the manifest: alone in a run, it replaces the run; inside a
merged one, it is there already and nothing happens. Rows keep their version, so a merged run still answers for
each of its versions. A snapshot reads the versions up to one; a scan by source prunes to the ranges it needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.scalar import int_div
from loomgraph.operators.graph import Graph

RANGE = 1 << 17
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
SCHEMA = "src long, dst long, version long, run string, part long"


@dataclass
class Run:
    """A folder of edges and the number of edges by version."""

    name: str
    versions: dict[int, int]

    @property
    def edges(self) -> int:
        return sum(self.versions.values())


class ConcurrentChange(RuntimeError):
    """Another writer put a manifest into place first."""


class EdgeStore:
    def __init__(self, spark: SparkSession, path: str, width: int = RANGE):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    # ---- files

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> list[Run]:
        stream = self._fs.open(self._path("manifest", str(number)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(r["name"], {int(v): n for v, n in r["versions"].items()}) for r in json.loads(text)]

    def runs(self) -> list[Run]:
        """The runs of the newest manifest; a short list, as compaction keeps merging it."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else []

    def _publish(self, runs: list[Run], after: int) -> None:
        aside, place = self._path("manifest", f"_{uuid.uuid4().hex}"), self._path("manifest", str(after + 1))
        stream = self._fs.create(aside)
        stream.write(json.dumps([asdict(r) for r in runs]).encode())
        stream.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            self._fs.delete(aside, False)
            raise ConcurrentChange(f"manifest {after + 1} of {self.path}")

    def _write(self, batch: DataFrame) -> Run:
        """``batch`` (src, dst, version) as a run; ranges with many edges are several tasks and files."""
        name = f"run={uuid.uuid4().hex}"
        dealt = batch.select("src", "dst", "version", int_div(F.col("src"), self.width).alias("part"))
        # Sources in order are parts in order, and one column sorts by radix; a few open files for each task spare
        # the sort by part that the writer asks for otherwise.
        rows, conf = dealt.repartitionByRange("src", "dst").sortWithinPartitions("src"), dealt.sparkSession.conf
        before = conf.get(OPEN_FILES)
        conf.set(OPEN_FILES, "4")
        try:
            rows.write.partitionBy("part").parquet(f"{self.path}/{name}")
        finally:
            conf.set(OPEN_FILES, before)
        counts = self._load([name]).groupBy("version").agg(F.count("*").alias("n")).collect()
        return Run(name, {r["version"]: r["n"] for r in counts})

    def _load(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in names if self._fs.exists(self._path(n))]
        paths = [p for p in paths if any(s.isDirectory() for s in self._fs.listStatus(self._path(p.rsplit("/", 1)[1])))]
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    # ---- writing

    def append(self, batch: DataFrame, version: int) -> None:
        """Write ``batch`` (src, dst) as the given version, unless a merged run holds it already."""
        numbers = self._numbers()
        runs = self._read(numbers[-1]) if numbers else []
        if any(version in r.versions and len(r.versions) > 1 for r in runs):
            return
        run = self._write(batch.select("src", "dst", F.lit(version).cast("long").alias("version")))
        run.versions.setdefault(version, 0)
        kept = [r for r in runs if version not in r.versions]
        self._publish(sorted([*kept, run], key=lambda r: max(r.versions)), numbers[-1] if numbers else 0)

    def ingest(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Start the query that appends a stream's micro-batches."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.append(df, n))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def compact(self, upto: int, alpha: float = 2.0) -> bool:
        """Merge the newest runs up to a version as far back as a run is no larger than alpha times what follows it.

        The merged run is complete before the manifest names it. Runs that it replaces stay on disk for readers of
        earlier manifests until ``vacuum``.
        """
        numbers = self._numbers()
        runs = self._read(numbers[-1]) if numbers else []
        old = [r for r in runs if max(r.versions) <= upto]
        first, after = len(old) - 1, old[-1].edges if old else 0
        while first > 0 and old[first - 1].edges <= alpha * after:
            first -= 1
            after += old[first].edges
        chosen = old[first:]
        if len(chosen) < 2:
            return False
        run = self._write(self._load([r.name for r in chosen]).select("src", "dst", "version"))
        for r in chosen:
            for v in r.versions:
                run.versions.setdefault(v, 0)
        rest = [r for r in runs if r not in chosen]
        self._publish(sorted([*rest, run], key=lambda r: max(r.versions)), numbers[-1])
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete all manifests but the newest ``keep`` and the runs that none of those names, left over from failed writers too.

        Not while another writer is at work: its run is not in a manifest yet. Returns how many runs went.
        """
        numbers = self._numbers()
        named = {r.name for n in numbers[-keep:] for r in self._read(n)}
        for n in numbers[:-keep]:
            self._fs.delete(self._path("manifest", str(n)), False)
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._path()) if s.getPath().getName().startswith("run=")]
        gone = [n for n in gone if n not in named]
        for n in gone:
            self._fs.delete(self._path(n), True)
        return len(gone)

    # ---- reading

    def versions(self) -> DataFrame:
        """(version, edges), from the manifest."""
        rows = [(v, n) for r in self.runs() for v, n in r.versions.items() if n]
        return self.spark.createDataFrame(rows, "version long, edges long")

    def _upto(self, version: int | None) -> DataFrame:
        runs = [r for r in self.runs() if version is None or min(r.versions) <= version]
        rows = self._load([r.name for r in runs])
        return rows if version is None else rows.where(F.col("version") <= version)

    def snapshot(self, version: int | None = None) -> Graph:
        """The graph up to a version, or all of it."""
        return Graph(self._upto(version).select("src", "dst"))

    def scan(self, first: int, end: int, version: int | None = None) -> DataFrame:
        """Edges with a source in [first, end), of all versions or one, read from the runs and ranges that hold them only."""
        runs = [r for r in self.runs() if version is None or version in r.versions]
        rows = self._load([r.name for r in runs])
        rows = rows if version is None else rows.where(F.col("version") == version)
        parts = F.col("part").between(first // self.width, (end - 1) // self.width)
        return rows.where(parts & (F.col("src") >= first) & (F.col("src") < end)).select("src", "dst")


def visible_prefix(written: DataFrame, quantum: int) -> DataFrame:
    """(visible): edges all writers have made visible: each shows whole quanta, the slowest one counts.

    ``written`` has one row (writer, edges) for each writer.
    """
    return written.agg((F.min(int_div(F.col("edges"), quantum)) * quantum * F.count("*")).cast("long").alias("visible"))
