"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are computed once a document, then reduced to distinct values, so copies cost nothing more. Two values
that differ in at most 4 of 64 bits agree on at least two of six bit blocks: each value is dealt to 15 tables, one a
pair of blocks. Within a bucket all values are compared by bit planes: plane b holds bit b of 64 values a word, a shift
of the planes by d lanes lines every value up with the d-th next of its bucket, and the differing bits are summed by
carry-save adders for all lanes at once. Words whose lanes all exceed the radius are abandoned between groups of
planes; lanes already known to be in one class are not compared again, which keeps dense buckets from going quadratic.
Each task emits a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .textkit import ROW, cut, row_key, shuffle_width, slices, unused

BITS = 64
#: Widths of the bit blocks, low bits first.
BLOCKS = (11, 11, 11, 11, 10, 10)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the XXH64 bits of the word shingles, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()  # bytes.split() parts at exactly the bytes 09-0D and 20
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    counts, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row, fp): the 64-bit fingerprint of every row's whole text as a signed long; null texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            whole = data.tobytes()
            found = np.array([fingerprint(whole[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found.view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, row {ROW}, fp long")


def _bucket_keys() -> Column:
    shifts = np.cumsum((0, *BLOCKS))
    block = [F.shiftrightunsigned("fp", int(at)).bitwiseAND(F.lit((1 << width) - 1)) for at, width in zip(shifts, BLOCKS, strict=False)]
    return F.array(*[F.lit(k << 22).cast("long").bitwiseOR(F.shiftleft(block[i], 11)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def _pack(flags: np.ndarray) -> np.ndarray:
    """Booleans as 64 lanes a word, one zero word more than needed, so a shift can read past the end."""
    padded = np.zeros((len(flags) // 64 + 2) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def exceeds(planes: np.ndarray, at: np.ndarray, shift: int, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, lanes) that stay within the radius, of the lanes `alive` in the words `at`, against the lanes `shift` on."""
    step, part = divmod(shift, 64)
    zero = np.zeros(len(at), np.uint64)
    counter, over = [zero.copy() for _ in range(max(3, radius.bit_length()))], zero.copy()
    last = planes.shape[1] - 1
    for group in range(0, BITS, 8):
        differ = []
        for p in planes[group : group + 8]:
            ahead = p[np.minimum(at + step, last)]
            if part:
                ahead = (ahead >> np.uint64(part)) | (p[np.minimum(at + step + 1, last)] << np.uint64(64 - part))
            differ.append(p[at] ^ ahead)
        for x, y in zip(differ[::2], differ[1::2], strict=True):
            # A full adder of the ones and two planes; its carry ripples through the twos and fours.
            half = counter[0] ^ x
            carry = (counter[0] & x) | (half & y)
            counter[0] = half ^ y
            for k in range(1, len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
        beyond = over | _greater(counter, radius)
        alive = alive & ~beyond
        keep = alive != 0
        if not keep.all():  # blocks in which every lane exceeds the radius are abandoned
            at, alive, over, counter = at[keep], alive[keep], over[keep], [c[keep] for c in counter]
        if not len(at):
            break
    return at, alive


def _greater(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above |= equal & counter[k]
            equal = equal & ~counter[k]
    return above


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            flat = parent[parent]
            if np.array_equal(flat, parent):
                break
            parent = flat


def link_buckets(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets; keys come sorted, values are distinct within a key."""
    n = len(keys)
    run = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    size = np.bincount(run)[run]
    live = np.flatnonzero(size > 1)  # values alone in their bucket have nobody to be compared with
    run, value, parent = run[live], values[live], np.arange(len(live))
    found = []
    rows = np.arange(len(live))
    shift = 1
    planes = None
    while len(rows):
        r = run[rows]
        if planes is None:
            v = value[rows].view(np.uint64)
            planes = np.stack([_pack((v >> np.uint64(b)) & np.uint64(1) != 0) for b in range(BITS)])
        if shift >= len(rows):
            break
        same = np.zeros(len(rows), bool)
        same[:-shift] = r[:-shift] == r[shift:]
        if not same.any():
            break
        same[:-shift] &= parent[rows[:-shift]] != parent[rows[shift:]]
        valid = _pack(same)
        at = np.flatnonzero(valid)
        if len(at):
            words, lanes = exceeds(planes, at, shift, valid[at], radius)
            if len(words):
                hit = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                i = (words[:, None] * 64 + np.arange(64)[None, :])[hit]
                parent = _unite(parent, rows[i], rows[i + shift])
        shift += 1
        if shift & (shift - 1) == 0:  # at powers of two, drop buckets too short for the shift or wholly united
            ids, first, counts = np.unique(r, return_index=True, return_counts=True)
            low, high = np.minimum.reduceat(parent[rows], first), np.maximum.reduceat(parent[rows], first)
            keep = np.repeat((counts > shift) & (low != high), counts)
            if not keep.all():
                rows, planes = rows[keep], None
    child = np.flatnonzero(parent != np.arange(len(parent)))
    found = value[child], value[parent[child]]
    return found


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints within the radius, a spanning forest a task; 4 is the largest radius."""
    if not 0 <= radius <= 4:
        raise ValueError("six blocks prove a shared pair of blocks up to radius 4")
    keyed = distinct.select("fp", F.explode(_bucket_keys()).alias("key"))
    dealt = keyed.repartition(shuffle_width(distinct.sparkSession), "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(final: bool) -> pa.RecordBatch | None:
            nonlocal held, rows
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(keys) if final else int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on
            held, rows = [(keys[whole:], values[whole:])], len(keys) - whole
            a, b = link_buckets(keys[:whole], values[:whole], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        limit = 1 << 18
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                rows += batch.num_rows
                if rows >= limit:
                    if (out := flush(False)) is not None:
                        yield out
                    limit = max(1 << 18, 2 * rows)
        if rows and (out := flush(True)) is not None:
            yield out

    return dealt.select("key", "fp").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows; fp -> first row of its component as a struct, for all distinct fingerprints)."""
    prints = cut(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))  # nulls come last
    distinct = cut(prints.groupBy("fp").agg(first.alias("least")))
    labels = component_labels(links(distinct, radius), "a", "b")
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("head"))
    return prints, rooted.join(roots, "root").select("fp", "head")


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) a row of docs; component_id is the least doc_id reachable over links, itself included.

    Only doc_id and text are read. Null or wordless texts have fingerprint 0 and link like any other; rows that repeat
    a doc_id each get a row; a null doc_id never becomes a component_id unless its component has no other. An empty
    table gives an empty result.
    """
    prints, heads = _classes(docs, radius, shingle)
    return prints.join(heads, "fp").select("doc_id", "fp", F.col("head.doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each component, with the columns of docs: that of the least doc_id (then of the least row key)."""
    _, heads = _classes(docs, radius, shingle)
    own = unused(docs, "__row")
    chosen = heads.select(F.col("head.row").alias(own)).distinct()
    return docs.withColumn(own, row_key("doc_id", "text")).join(chosen, own, "left_semi").dropDuplicates([own]).select(*docs.columns)


def fingerprint_hex(column: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
