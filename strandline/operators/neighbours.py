"""The vectors of largest cosine to many query vectors: blocked matrix products, whole or over an inverted-file index.

Queries of a block come first in a task and stay; rows stream past in Arrow batches, a matrix product each, and leave the
best k of every query. Rows are dealt to slices by a hash and queries to blocks of bounded size, so no task holds a table,
and what is merged in the end is k rows a query and slice, not pairs.

The index has its centroids from a bounded sample, but every row is in it. A query probes its nearest cells; how many is
calibrated on the sample, as the fewest that reach the recall asked for. All cells together are the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of the sample, cells, queries of a block, and rows that a slice holds, about.
SAMPLE, CELLS, BLOCK, SLICE_ROWS = 4096, 16, 8192, 1 << 20
_TILE = 1 << 22
_SCHEMA = "cell int, block int, slice int, tag int, id long, x array<float>"


@dataclass(frozen=True)
class Index:
    """Unit centroids, a row a cell, and how many cells a query probes."""

    centroids: np.ndarray
    probes: int

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row of unit vectors."""
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :n]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay, and their cosine to anything is 0."""
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("x"))


def fit(vectors: DataFrame, cells: int = CELLS, recall: float = 0.97, k: int = 8, rounds: int = 12) -> Index:
    """Spherical k-means on the SAMPLE vectors of least hash; probes reach `recall` there, the sample's own neighbours counted."""
    rows = _usable(vectors).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
    if not rows.num_rows:
        return Index(np.zeros((1, 1)), 1)
    dims = max(map(len, rows.column("x").to_pylist()))
    sample = _unit(np.array([v + [0.0] * (dims - len(v)) for v in rows.column("x").to_pylist()]))
    centroids = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        centroids[full] = _unit(sums[full])
    asked = sample[:: max(1, len(sample) // 256)]
    near = np.argsort(-(asked @ sample.T), axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    own = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], own[near]]  # the probe at which each neighbour is met
    probes = next(n for n in range(1, len(centroids) + 1) if (place < n).mean() >= recall)
    return Index(centroids, probes)


def _best(owner: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((other, -score, owner))
    owner, score, other = owner[order], score[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return tuple(v[rank < k] for v in (owner, score, other))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(sizes), dims))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < dims
    out[owner[inside], place[inside]] = flat[inside]
    return out


def nearest_to_many(vectors: DataFrame, queries: DataFrame, k: int = 8, index: Index | None = None) -> DataFrame:
    """(query_id, place, vec_id, score): the k vectors of largest cosine to each query, itself included if it is among them.

    vectors, queries: vec_id, embedding. Scores are rounded to six places, ties by smaller vec_id. With an index only the
    cells that a query probes are searched. Rows without vec_id or with a null, empty or undefined vector take no part;
    shorter vectors end in zeros; queries that repeat a vec_id are one, repeated vectors count each. Empty tables give no rows.
    """
    rows, asked = _usable(vectors), _usable(queries).dropDuplicates(["id"])
    count, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    n_asked, wide = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    dims = max(dims or 1, wide or 1)
    if index is not None and index.centroids.shape[1] != dims:
        index = Index(np.pad(index.centroids[:, :dims], ((0, 0), (0, max(0, dims - index.centroids.shape[1])))), index.probes)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, cells = max(1, -(-n_asked // BLOCK)), len(index.centroids) if index is not None else 1
    slices = max(1, -(-2 * width // (blocks * cells)), -(-count // (cells * SLICE_ROWS)))
    whole = [F.lit(0).alias("cell")]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).cast("int").alias("slice")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def in_cells(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = index.cells(_unit(_matrix(b.column(1), dims)), n)
                take = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["cell", "id", "x"])

        return run

    if index is not None:
        rows, asked = rows.mapInArrow(in_cells(1), "cell int, id long, x array<float>"), asked.mapInArrow(in_cells(index.probes), "cell int, id long, x array<float>")
    else:
        rows, asked = rows.select(*whole, "id", "x"), asked.select(*whole, "id", "x")
    dealt_rows = rows.select("cell", every(blocks, "block"), "id", "x").select("cell", "block", part, F.lit(1).alias("tag"), "id", "x")
    dealt_asked = asked.select("cell", block, every(slices, "slice"), F.lit(0).alias("tag"), "id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])

        now = ids = matrix = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        owner, score, other = (np.zeros(0, t) for t in (np.int64, float, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            for a, b in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
                key, piece = tuple(keys[:3, a]), batch.slice(a, b - a)
                if key != now:
                    if matrix is not None and len(owner):
                        yield found()
                    now, held, matrix = key, [], None
                    owner, score, other = (np.zeros(0, t) for t in (np.int64, float, np.int64))
                own, x = piece.column(4).to_numpy(), _unit(_matrix(piece.column(5), dims))
                if keys[3, a] == 0:
                    held.append((own, x))
                    continue
                if matrix is None:
                    if not held:
                        continue
                    ids, matrix = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                step = max(64, _TILE // len(ids))
                for at in range(0, len(own), step):
                    tile = np.round(matrix @ x[at : at + step].T, 6)
                    least = np.partition(tile, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k] if tile.shape[1] > k else np.full(len(ids), -np.inf)
                    i, j = np.nonzero(tile >= least[:, None])
                    owner, score, other = _best(np.concatenate([owner, i]), np.concatenate([score, tile[i, j]]), np.concatenate([other, own[at + j]]), k)
        if matrix is not None and len(owner):
            yield found()

    key = ["cell", "block", "slice"]
    met = dealt_asked.unionByName(dealt_rows).repartition(width, *key).sortWithinPartitions(*key, "tag").mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query_id", "place", "vec_id", (F.col("score") + F.lit(0.0)).alias("score"))
