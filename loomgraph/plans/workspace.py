"""Where intermediate tables live, and how loops cut their lineage.

Intermediate results are written as Parquet below the folder named by ``spark.checkpoint.dir``
(shared by the driver and all executors) and read back. Unlike ``localCheckpoint`` such a table
survives the loss of executors, and unlike ``checkpoint()`` it is computed once and stays columnar.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/checkpoints"
_made: set[str] = set()


def delete_folder(sc: SparkContext, path: str) -> None:
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _clean() -> None:
    """At the end of the driver: tables of its runs go, by Spark if it still runs, else if they are local."""
    sc = SparkContext._active_spark_context
    for root in _made:
        with contextlib.suppress(Exception):
            if sc is not None and sc._jsc is not None:
                delete_folder(sc, root)
                continue
        if root.startswith(("/", "file:")):
            shutil.rmtree("/" + root.removeprefix("file:").lstrip("/"), ignore_errors=True)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; on a local master, a default where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(DEFAULT_DIR)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Workspace:
    """Tables of one operator run; ``drop`` frees those that a later one has replaced."""

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        _made.add(self.root)
        self.count = 0

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """Write ``df`` once and return the written table.

        Narrow tables that loops write again and again go "uncompressed": codecs take direct memory for
        each file, which a JVM with room on its heap is slow to give back.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if path := getattr(t, "_loom_path", None):
                delete_folder(self.spark.sparkContext, path)
