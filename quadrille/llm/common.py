"""Helpers shared by the operators: shared-folder tables, Arrow text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quadrille.tables import materialize, shared_folder

__all__ = ["as_bytes", "bound_batches", "map_texts", "materialize", "shared_folder", "slices"]

#: Rows of one slice of an Arrow batch: bounds what a Python worker holds at once.
SLICE_ROWS = 512
#: Bytes of text after which a slice ends early, so that long texts don't pile up.
SLICE_BYTES = 8 << 20
#: Rows that Spark hands to a Python worker at once, where the session doesn't say.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Texts are long, so Spark's usual 10,000 rows would fill both the JVM's and the worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has few rows and, but for single long texts, few bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over text slices; ``make`` runs once in each task."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches, text):
            out = each(part)
            if out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)
