"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from scriptgauge.session import scratch_path

#: Code points of text that a Python worker holds at once, beyond one whole text.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def settled(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts the lineage and is computed once."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def slices(batch: pa.RecordBatch, texts: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of the named column; a longer text is a piece of its own."""
    column = batch.column(batch.schema.get_field_index(texts))
    start, size = 0, 0
    for row, length in enumerate(pa.compute.binary_length(column).to_pylist()):
        size += length or 0
        if size > most and row > start:
            yield batch.slice(start, row - start)
            start, size = row, length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def crc_mod(column: str, divisor: int) -> str:
    """SQL for crc32 of an id as text, modulo ``divisor``; null for a null id."""
    return f"crc32(cast({column} as string)) % {divisor}"
