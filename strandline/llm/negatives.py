"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Inner products become distances by one more component: with M the largest norm, a row x is sqrt(M^2 - |x|^2) further out
in a dimension of its own and an anchor a is not, so |a' - x'|^2 = M^2 + |a|^2 - 2 a.x and the nearest rows have the
highest scores. Pivots, a bounded sample of the rows, cut that space into Voronoi cells. Anchors of a cell form a group,
known by its radius U; a row at distance s from the group's pivot lies between s - U and s + U from each anchor in it, so
it is replicated only to groups that it might serve:

1. Every row meets the anchors of its own cell. The fifth score found there bounds each anchor's distance from above.
2. Every row meets the other groups whose bound it may reach. Positives are then exact.
3. Positives give a ring of distances that hold an anchor's negatives: rows meet the groups whose rings they may touch.

A group's rows are dealt to slices by a hash, and a group of many anchors is cut into blocks, so no task holds a cell, a
label or a group of copies. In a task the anchors of a block come first and stay; rows stream past in tiles and leave the
best few. Scores are whole numbers, so the exact comparison needs no tolerance; distances are compared with one, which
replicates a little more and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import discard, shuffle_width, stored
from .vectors import describe, is_finite, matrix, packed, scaled, unpacked

POSITIVES, NEGATIVES, FLOOR = 5, 5, (80, 100)
#: Vectors of least hash that serve as pivots.
PIVOTS = 16
#: Anchors of a block, entries of a tile of scores, and rows that a slice holds, about.
BLOCK, TILE, SLICE_ROWS = 16_384, 1 << 22, 1 << 20
_NONE = np.iinfo(np.int64).min
_DEALT = "cell int, block int, slice int, tag int, vec_id long, label long, same long, x binary, ids array<long>, scores array<long>"
_NAMES = [c.split()[0] for c in _DEALT.split(", ")]


@dataclass(frozen=True)
class Space:
    """Pivots as rows of dims + 1 doubles; reach is M squared."""

    dims: int
    kind: str
    exact: bool
    reach: float
    pivots: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots of rows: M^2 in all, each as far out as it is short."""
        return self._apart(x, np.sqrt(np.maximum(self.reach - (x * x).sum(axis=1), 0)))

    def anchors(self, x: np.ndarray) -> np.ndarray:
        return self._apart(x, np.zeros(len(x)))

    def _apart(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        norms = (x * x).sum(axis=1) + last * last
        dots = x @ self.pivots[:, :-1].T + np.outer(last, self.pivots[:, -1])
        return np.sqrt(np.maximum(norms[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * dots, 0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance: the square root of a difference of numbers about M squared."""
        return 1e-6 * math.sqrt(max(self.reach, 1.0)) + 1e-3


def _best(owner: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of highest score of each owner, ties by smaller id; sorted by owner."""
    order = np.lexsort((other, -score, owner))
    owner, score, other = owner[order], score[order], other[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    rank = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(owner) else owner
    keep = rank < k
    return owner[keep], score[keep], other[keep]


class _Block:
    """The anchors of one block, and the best entries so far of each of their slots: one for positives, one a positive for negatives."""

    def __init__(self, space: Space, k: int, floor: tuple[int, int], held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        self.space, self.k = space, k
        self.ids, self.labels, self.same = (table.column(c).to_numpy() for c in ("vec_id", "label", "same"))
        self.x = np.concatenate([unpacked(b.column(7), space.dims, space.kind) for b in held]).astype(np.float64 if space.exact else np.int64)
        lists = table.column("scores").combine_chunks()
        self.slots = None
        if lists.null_count == 0:
            sizes = np.diff(lists.offsets.to_numpy())
            width = max(1, int(sizes.max()))
            at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.slots, self.partner = np.full((len(sizes), width), _NONE), np.zeros((len(sizes), width), np.int64)
            self.slots[at] = lists.flatten().to_numpy()
            self.partner[at] = table.column("ids").combine_chunks().flatten().to_numpy()
            self.slots[self.slots < 0] = _NONE  # 80 p <= 100 n <= 100 p holds for no n if p < 0
            num, den = floor
            common = math.gcd(num, den)
            self.low = self.slots - self.slots * ((den - num) // common) // (den // common)
        n = len(self.ids) * (self.slots.shape[1] if self.slots is not None else 1)
        self.owner, self.score, self.other = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, _NONE)

    def meet(self, batch: pa.RecordBatch) -> None:
        step = max(64, TILE // max(1, len(self.ids)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = unpacked(part.column(7), self.space.dims, self.space.kind).astype(self.x.dtype)
            ids, labels = part.column(4).to_numpy(), part.column(5).to_numpy()
            scores = (self.x @ x.T).astype(np.int64)
            equal, other = self.labels[:, None] == labels, self.ids[:, None] != ids
            if self.slots is None:
                self._take(np.where(equal & other, scores, _NONE), ids, np.arange(len(self.ids)))
            else:
                for s in range(self.slots.shape[1]):
                    fits = ~equal & other & (scores <= self.slots[:, s, None]) & (scores >= self.low[:, s, None]) & (self.slots[:, s, None] != _NONE)
                    self._take(np.where(fits, scores, _NONE), ids, np.arange(len(self.ids)) * self.slots.shape[1] + s)

    def _take(self, scores: np.ndarray, ids: np.ndarray, owners: np.ndarray) -> None:
        n = scores.shape[1]
        least = self.least[owners]
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores != _NONE))
        if not len(row):
            return
        self.owner, self.score, self.other = _best(np.concatenate([self.owner, owners[row]]), np.concatenate([self.score, scores[row, col]]), np.concatenate([self.other, ids[col]]), self.k)
        full = np.flatnonzero(np.bincount(self.owner, minlength=len(self.least)) == self.k)
        ends = np.searchsorted(self.owner, full, "right") - 1
        self.least[full] = self.score[ends]

    def found(self) -> pa.RecordBatch:
        width = self.slots.shape[1] if self.slots is not None else 1
        at, slot = self.owner // width, self.owner % width
        positive = (self.partner[at, slot], self.slots[at, slot]) if self.slots is not None else (np.zeros(len(at), np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (self.ids[at], self.same[at], slot.astype(np.int32), *positive, self.other, self.score)], names=["anchor_id", "same", "slot", "positive_id", "positive_score", "other_id", "score"])


_FOUND = "anchor_id long, same long, slot int, positive_id long, positive_score long, other_id long, score long"


def _local_join(anchors: DataFrame, rows: DataFrame, space: Space, k: int, floor: tuple[int, int]) -> DataFrame:
    """anchors and rows carry (cell, block, slice); of equal keys, the best k rows of each anchor slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            for a, b in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
                key, tag, part = tuple(keys[:3, a]), keys[3, a], batch.slice(a, b - a)
                if key != now:
                    if block is not None:
                        yield block.found()
                    now, held, block = key, [], None
                if tag == 0:
                    held.append(part)
                elif held:
                    block = block or _Block(space, k, floor, held)
                    block.meet(part)
        if block is not None:
            yield block.found()

    key = ["cell", "block", "slice"]
    both = anchors.select(*_NAMES).unionByName(rows.select(*_NAMES))
    return both.repartition(shuffle_width(anchors.sparkSession), *key).sortWithinPartitions(*key, "tag").mapInArrow(run, _FOUND)


@dataclass(frozen=True)
class Groups:
    """By cell: blocks of its anchors and their radius; slices is the same for all."""

    blocks: np.ndarray
    radius: np.ndarray
    slices: int


def _of(vec_id: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A number below n by a hash of the id."""
    h = (vec_id.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(max(n, 1))


def _assigned(anchors: DataFrame, space: Space) -> DataFrame:
    """Anchors with their cell, distance to its pivot and squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), space.dims)
            far = space.anchors(x.astype(float))
            cell = far.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 3)], pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), pa.array((x.astype(float) ** 2).sum(axis=1)), packed(x.astype(space.kind))], names=["vec_id", "label", "same", "cell", "apart", "norm", "x"])

    return anchors.select("vec_id", "label", "x", "same").mapInArrow(run, "vec_id long, label long, same long, cell int, apart double, norm double, x binary")


def _dealt_anchors(anchors: DataFrame, groups: Groups) -> DataFrame:
    """Each anchor in its block, once for each slice."""
    blocks = F.array(*[F.lit(int(b)) for b in groups.blocks])
    block = F.pmod(F.xxhash64("vec_id", "same"), F.greatest(F.element_at(blocks, F.col("cell") + 1), F.lit(1)))
    slices = F.explode(F.sequence(F.lit(0), F.lit(groups.slices - 1)))
    return anchors.select("cell", block.cast("int").alias("block"), slices.alias("slice"), F.lit(0).alias("tag"), "vec_id", "label", "same", "x", "ids", "scores")


def _dealt_rows(rows: DataFrame, space: Space, groups: Groups, serves) -> DataFrame:
    """Each row once for each block of each group that it serves. serves: (distances, own cell) -> rows x cells of booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), space.dims)
            far = space.rows(x.astype(float))
            mask = serves(far, far.argmin(axis=1))
            ids, raw = batch.column(0).to_numpy(), x.astype(space.kind)
            part = _of(ids, groups.slices, 7).astype(np.int32)
            for cell in np.flatnonzero(mask.any(axis=0) & (groups.blocks > 0)):
                hit = np.flatnonzero(mask[:, cell])
                take, n = pa.array(hit), len(hit)
                body = [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.zeros(n, np.int64)), packed(raw[hit]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
                for block in range(groups.blocks[cell]):
                    head = [np.full(n, cell, np.int32), np.full(n, block, np.int32), part[hit], np.ones(n, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, head), *body], names=_NAMES)

    return rows.select("vec_id", "label", "x").mapInArrow(run, _DEALT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "same", "slot").orderBy(F.desc("score"), F.asc("other_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _by_cell(n: int, rows: list, name: str, missing: float) -> np.ndarray:
    out = np.full(n, missing)
    for r in rows:
        out[r["cell"]] = r[name]
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: tuple[int, int] = FLOOR, pivots: int = PIVOTS) -> DataFrame:
    """RESULT rows: for each anchor and each of its first positives, the first negatives whose score is between floor[0] / floor[1]
    of the positive's and the positive's own.

    df: vec_id, label, embedding; further columns are not read. A score is the inner product of vectors scaled to whole
    numbers (see vectors.scaled); shorter vectors end in zeros. Higher scores come first, ties by smaller vec_id. Rows
    without vec_id, label or a finite vector take no part. Rows of an anchor's own vec_id are not its partners; apart from
    that each repeated row counts, except that anchors equal in all three columns are one anchor. A positive of score
    below zero has no negatives. No anchors or an empty table give no rows.
    """
    spark = df.sparkSession
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled(F.col("embedding")).alias("x"), is_anchor.alias("anchor"))
    count, dims, largest = describe(rows)
    dims = max(dims, 1)
    if not count:
        return spark.createDataFrame([], RESULT)
    norm = F.aggregate("x", F.lit(0.0), lambda t, c: t + c.cast("double") * c)
    reach = rows.agg(F.max(norm)).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(pivots).select("x").collect()
    centres = np.zeros((len(sample), dims + 1))
    for i, r in enumerate(sample):
        centres[i, : len(r.x)] = r.x
    centres[:, -1] = np.sqrt(np.maximum(reach - (centres[:, :-1] ** 2).sum(axis=1), 0))
    space = Space(dims, "<i2" if largest < 1 << 15 else "<i4", dims * largest * largest < 1 << 53, reach, np.unique(centres, axis=0))
    cells = len(space.pivots)
    chosen = rows.filter("anchor").select("vec_id", "label", "x", F.xxhash64("label", "x").alias("same")).dropDuplicates(["vec_id", "same"])
    anchors = stored(_assigned(chosen, space))
    known = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    if not known:
        discard(anchors)
        return spark.createDataFrame([], RESULT)
    blocks = np.ceil(_by_cell(cells, known, "n", 0) / BLOCK).astype(int)
    slices = max(1, -(-4 * shuffle_width(spark) // int(blocks.sum())), -(-count // SLICE_ROWS))
    groups = Groups(blocks, _by_cell(cells, known, "radius", 0.0), slices)
    plain = _dealt_anchors(anchors.withColumns({"ids": F.lit(None).cast("array<long>"), "scores": F.lit(None).cast("array<long>")}), groups)

    home = stored(_local_join(plain, _dealt_rows(rows, space, groups, lambda far, own: own[:, None] == np.arange(cells)), space, positives, floor))
    fifth = _ranked(home, positives).filter(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), "same", "score")
    edge = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.lit(reach) + F.col("norm") - 2 * score))
    worst = anchors.join(fifth, ["vec_id", "same"], "left").select("cell", F.when(F.col("score").isNull(), float("inf")).otherwise(edge(F.col("score"))).alias("bound"))
    bound = _by_cell(cells, worst.groupBy("cell").agg(F.max("bound").alias("bound")).collect(), "bound", -1.0) + space.slack
    away = _dealt_rows(rows, space, groups, lambda far, own: (own[:, None] != np.arange(cells)) & (far - groups.radius <= bound))
    best = _ranked(home.unionByName(_local_join(plain, away, space, positives, floor)), positives)
    lists = best.groupBy("anchor_id", "same").agg(F.array_sort(F.collect_list(F.struct("rank", "other_id", "score"))).alias("best"))  # at most `positives` a list
    ready = stored(anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "same"]).withColumns({"ids": F.col("best.other_id"), "scores": F.col("best.score")}).drop("best"))

    usable = F.filter("scores", lambda s: s >= 0)
    rings = ready.filter(F.size(usable) > 0).groupBy("cell").agg(F.max(edge(F.array_min(usable) * floor[0] / floor[1])).alias("outer"), F.min(edge(F.array_max(usable))).alias("inner")).collect()
    outer, inner = _by_cell(cells, rings, "outer", -np.inf) + space.slack, _by_cell(cells, rings, "inner", np.inf) - space.slack
    ring = _dealt_rows(rows, space, groups, lambda far, own: (far - groups.radius <= outer) & (far + groups.radius >= inner))
    found = _ranked(_local_join(_dealt_anchors(ready, groups), ring, space, negatives, floor), negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """The contract's query: labels of every seventh vec_id are moved on by one, anchors are the vec_ids divisible by 100."""
    label = F.col("label").cast("long")
    moved = embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor, other, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor, p.other AS positive, p.score AS ps, s.other, s.score, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS r
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, other AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE r <= 5
"""
