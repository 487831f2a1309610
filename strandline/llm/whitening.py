"""Whitening of embeddings by their exact covariance.

The fit list is each distinct vector of whole numbers once. Its sums S are exact, so a row is centred exactly as
(n * x - S) / n with one rounding; the Gram matrix of the centred rows comes from MLlib's RowMatrix, which adds partial
matrices up a tree of executors, and is divided by n. Only that matrix of dims x dims numbers reaches the driver, where
eigh gives the components. Whitening itself is a projection that mapInPandas applies with a broadcast matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import discard, stored
from .vectors import describe, is_finite, matrix, scaled

COMPONENTS = 4
#: Dimensions beyond which the Gram matrix is not for one driver: 4,096 squared doubles are 128 MB.
MOST_DIMS = 4096
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n fit rows with exact sums; eigenvalues fall, vectors has one unit eigenvector a row; scale is 1 / sqrt(eigenvalue), 0 for a direction without variance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scale: np.ndarray
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.n, self.sums) @ self.vectors.T) * self.scale


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x.astype(np.int64) - sums) / n


def _column_sums(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums a dimension; each task sends one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n += len(x)
            sums += x.sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(sums), pa.array(np.full(dims, n))], names=["dim", "total", "n"])

    rows = fit.mapInArrow(run, "dim int, total long, n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    return rows[0].n, np.array([r.total for r in rows], np.int64)


def _gramian(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    total = F.array(*[F.lit(int(s)).cast("long") for s in sums])
    centred = F.zip_with(F.col("x"), total, lambda x, s: (F.lit(n).cast("long") * x - s).cast("double") / F.lit(float(n)))
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def _identity_error(fit: DataFrame, w: Whitening, dims: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured in a pass of its own."""
    k, shared = len(w.scale), fit.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            out = shared.value.apply(matrix(batch.column(0), dims))
            total[:k] += out.T @ out
            total[k] += out.sum(axis=0)
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    rows = fit.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    total = np.array([r.value for r in rows]).reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(rows: DataFrame, dims: int, largest: int, components: int) -> Whitening:
    """rows: a column x, array<int>. Its distinct vectors are written once, as 16-bit numbers where they fit."""
    padded = F.concat("x", F.array_repeat(F.lit(0), F.lit(dims) - F.size("x")))
    kind = "smallint" if largest < 1 << 15 else "int"
    distinct = stored(rows.select(padded.cast(f"array<{kind}>").alias("x")).distinct())
    n, sums = _column_sums(distinct, dims)
    values, vectors = np.linalg.eigh(_gramian(distinct, n, sums) / n)
    k = min(components, dims)
    values, vectors, trace = values[::-1][:k], vectors[:, ::-1][:, :k].T, max(values.sum(), 0.0)
    has = values > 1e-12 * trace
    scale = np.where(has, 1 / np.sqrt(np.where(has, values, 1)), 0.0)
    found = Whitening(n, sums, values, vectors, values / trace if trace else np.zeros(k), scale, 0.0)
    found = Whitening(**{**found.__dict__, "identity_error": _identity_error(distinct, found, dims)})
    discard(distinct)
    return found


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of df and component.

    Only vec_id and embedding are read. Rows go whose vector is null or has a null, infinite or undefined entry. Repeated
    rows are each whitened but count once in the fit; a null vec_id stays null. Shorter vectors end in zeros. An empty table
    gives no rows. Where fewer directions than components vary, the others are whitened to 0 and explain 0, and
    identity_error says so (it is 1). deviation is exact; it is null where it does not fit a long.
    """
    spark = df.sparkSession
    rows = df.filter(is_finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("x"))
    count, dims, largest = describe(rows)
    if not count or not dims:
        return spark.createDataFrame([], _SCHEMA)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MOST_DIMS} are whitened")
    model = fit(rows, dims, largest, components)
    shared = spark.sparkContext.broadcast(model)
    fits_long = dims * (2 * model.n * max(1, largest)) ** 2 < 1 << 63

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        k = len(w.scale)
        for frame in frames:
            x = np.zeros((len(frame), dims), np.int64)
            for i, row in enumerate(frame["x"]):
                x[i, : len(row)] = row
            out = w.apply(x)
            if fits_long:
                apart = pd.array(((w.n * x - w.sums) ** 2).sum(axis=1), dtype="Int64")
            else:
                exact = [sum(v * v for v in (w.n * r - w.sums).tolist()) for r in x]
                apart = pd.array([v if v < 1 << 63 else None for v in exact], dtype="Int64")
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].astype("Int64").repeat(k).array,
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)),
                "n": w.n,
                "deviation": apart.repeat(k),
                "whitened": out.ravel(),
                "explained": np.tile(w.explained, len(frame)),
                "identity_error": w.identity_error,
            })

    return rows.mapInPandas(run, _SCHEMA)
