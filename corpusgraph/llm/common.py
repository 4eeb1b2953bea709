"""Helpers shared by the operators: shared-folder tables, bounded Arrow slices, row identity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.sources.shared import write_table  # noqa: F401

#: Bytes of text that one Python step holds at a time (a single longer text stands alone).
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python step at a time (a single longer row stands alone).
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches take BATCH_BYTES: by rows alone, a batch of texts is a whole file split in the JVM and in Python. A limit that the session has stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices with about `limit` bytes in `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ragged(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list array from numpy arrays."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Columns that name a row by its content; rows equal in all columns have one name.
ROW = ("_row1", "_row2")


def with_row_names(df: DataFrame) -> DataFrame:
    """df with two 64-bit hashes over all its columns, never null, by which rows are found again."""
    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.withColumns({name: F.xxhash64(F.lit(i), *parts) for i, name in enumerate(ROW)})


def numbered(df: DataFrame) -> DataFrame:
    """df with _i, the number of a row among rows equal to it."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(0))))
