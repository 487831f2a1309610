"""Embedding vectors as whole numbers, and their packed form in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this bound are taken as the bound, so that sums of products of some hundred components fit a long.
MOST = 1 << 26


def is_finite(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(256 * c) of each component, as array<int>."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * 256, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows x dims of a list column without nulls; shorter vectors end in zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int64) * width
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of vectors is over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros((len(column), dims), kind)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind).reshape(len(column), dims)


def describe(df: DataFrame) -> tuple[int, int, int]:
    """(rows, dimensions, largest absolute component) of a column x of scaled vectors."""
    r = df.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m")).first()
    return r.n, r.d or 0, r.m or 0
