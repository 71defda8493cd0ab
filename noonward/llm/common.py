"""What several operators share: reading inputs, batches of texts, columns that may clash."""

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to add, compared as Spark compares names."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, name: str) -> str:
    """`name`, or that with further underscores, so that `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; a missing one counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each piece holds about CHUNK_BYTES of text; a longer text is a piece by itself."""
    for batch in batches:
        texts = batch.column(column)
        held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            before = held[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(held, before + CHUNK_BYTES, "right")))
            yield batch.slice(start, end - start), texts_of(texts.slice(start, end - start))
            start = end


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
