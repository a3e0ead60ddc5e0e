"""Row-wise work in bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.shipping import ship

BATCH_ROWS = 500
READER_ROWS = 512
SLICE_ROWS = 250


def bound_batches(spark: SparkSession) -> None:
    """Before any Python work: ship the package, and keep batches of whole texts small, in Python workers
    and in the Parquet reader, which holds each column of a batch in one array."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Apply ``make()`` (called once a task) to the columns of each row; it yields output tuples.

    ``df`` must hold just the input columns, in order; ``schema`` and ``arrow`` describe the output.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows: list[tuple] = []
                for values in zip(*(c[at : at + SLICE_ROWS] for c in columns)):
                    rows.extend(work(*values))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow
                    )

    return df.mapInArrow(run, schema)
