"""Removal of repeated byte strings by merged, sampled suffix arrays.

A full suffix array has one suffix a byte, and merging shard transforms byte by byte takes one interleave round a byte
of match length: 400 rounds over every byte of the corpus. The suffixes are therefore sampled where content itself says
so. Every 400-byte string owns an anchor, the 160-byte context of least hash inside it; equal strings own equal anchors
at equal offsets, so comparing what stands around equal anchors finds every repeated string and none else. Anchors that
a count-min sketch proves unique (it never underestimates) need no comparison.

The others are dealt by anchor. What follows an anchor is a suffix, what precedes it a reversed prefix; both are merged
from the shards' rows by interleave refinement: all rows of a block are equal so far, and a round reads the next eight
bytes of the blocks that are still open and stably splits them, so settled blocks are never sorted again. The round in
which two neighbours part gives their common prefix. Strings that begin d bytes before the anchor are repeated exactly
if two rows share an interval of common prefix 400 - d forwards and one of d backwards.

Anchors with more than HOT rows are not compared in one task. The digests (128 bits) of their strings are counted
slice by slice instead, so copies meet as partial results; up to HOT_TABLE repeated ones are broadcast and looked up
where the texts are read in the end, and beyond that they are joined to the strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import substrings
from .textkit import ROW, byte_table, cut, lookup, pieces_of, prefix_sums, range_hashes, row_key, shuffle_width, slices

LENGTH, CONTEXT = 400, 160
#: Rows of an anchor beyond which it is not compared in one task, and repeated strings of such anchors that are broadcast.
HOT, HOT_TABLE = 5_000, 1 << 20
#: Bytes of text for each anchor, about: what the sketch's size is derived from.
ANCHOR_BYTES = 121
#: Rows that are merged at once, at least; all rows of an anchor stay together.
SHARD = 2048
#: Bytes of text taken at once; the arrays over them take about a hundred times as much.
SLICE = 1 << 19
#: Rows of a batch with the bytes around an anchor, of which each has at most 640.
REGIONS = 1 << 15
_TABLE = byte_table(5)
_SEEDS = byte_table(6), byte_table(7)
_LOW = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, key) of each anchor: the strings that own it begin at first..last; places are within the slice."""
    none = np.zeros(0, np.int64)
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(offs[:-1], offs[1:], strict=True) if b - a >= LENGTH] or [none])
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64)
    key = range_hashes(prefix_sums(_TABLE[data]), CONTEXT)
    least = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)  # least hash, then leftmost
    span, size = LENGTH - CONTEXT + 1, 1
    while size < span:  # of runs of 1, 2, 4.. places, at last of span
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    place = (least[starts] & _LOW).astype(np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    chosen = place[first]
    return np.searchsorted(offs, chosen, "right") - 1, chosen, starts[first], starts[last], key[chosen]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for _, data, offs, _ in pieces_of(batches, SLICE, LENGTH - 1):
        key = anchors(data, offs)[-1]
        if len(key):
            yield key


def interleave(block: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows ordered within their block, and the bytes each shares with its predecessor there (0 across blocks).

    symbols: rows x words of eight bytes, most significant first. block must not decrease.
    """
    n, rounds = symbols.shape
    order, common = np.arange(n), np.full(n, rounds * 8)
    begins = np.concatenate([[True], block[1:] != block[:-1]])
    common[begins] = 0
    for r in range(rounds):
        sym = symbols[order, r]
        part = ~begins & np.concatenate([[False], sym[1:] != sym[:-1]])
        if not part.any():
            continue
        # Only blocks with unequal symbols are split anew; their order so far is kept among equals.
        number = np.cumsum(begins) - 1
        touched = np.zeros(number[-1] + 1, bool)
        touched[number[part]] = True
        rows = np.flatnonzero(touched[number])
        moved = rows[np.lexsort((sym[rows], number[rows]))]
        order[rows], sym[rows] = order[moved], sym[moved]
        split = ~begins & np.concatenate([[False], sym[1:] != sym[:-1]])
        at = np.flatnonzero(split)
        differ = sym[at] ^ sym[at - 1]
        same = np.zeros(len(at), np.int64)
        for byte in range(7):  # leading equal bytes of the eight
            same += (differ >> np.uint64(8 * (7 - byte)) == 0).astype(np.int64)
        common[at] = r * 8 + same
        begins = begins | split
    return order, common


def repeated_ranges(block: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) distance d at which the string that begins d bytes before the anchor is repeated; -1 if none.

    before, after: bytes leading up to (reversed) and from the anchor, zero-padded; low..high: the distances of each row.
    """
    n = len(block)

    def merged(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((n, -(-matrix.shape[1] // 8) * 8), np.uint8)
        wide[:, : matrix.shape[1]] = matrix
        return interleave(block, wide.view(">u8").astype(np.uint64))

    (order_a, common_a), (order_b, common_b) = merged(after), merged(before)
    least, largest = np.full(n, -1), np.full(n, -1)
    in_a, in_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        here = np.flatnonzero((low <= d) & (d <= high))
        if len(here) < 2:
            continue
        in_a[order_a] = np.cumsum(common_a < LENGTH - d)
        in_b[order_b] = np.cumsum((common_b < d) if d else (common_b == 0) & _begins(block, order_b))
        both = in_a[here] * (n + 1) + in_b[here]
        rank = np.argsort(both, kind="stable")
        same = both[rank][1:] == both[rank][:-1]
        twice = np.zeros(len(here), bool)
        twice[rank[1:][same]] = True
        twice[rank[:-1][same]] = True
        hit = here[twice]
        largest[hit] = d
        least[hit] = np.where(least[hit] < 0, d, least[hit])
    return least, largest


def _begins(block: np.ndarray, order: np.ndarray) -> np.ndarray:
    b = block[order]
    return np.concatenate([[True], b[1:] != b[:-1]])


_REGION = f"row {ROW}, key long, first int, last int, place int, bytes binary"
_SPAN = f"row {ROW}, start int, end int"


def _regions(texts: DataFrame, shared, bits: int, hot=None, narrow: bool = False) -> DataFrame:
    """Anchors estimated repeated and not hot; unless narrow with the bytes from their first string's begin to their last one's end.

    An anchor whose strings begin in two pieces of a long text comes twice, each time with its strings there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs, base in pieces_of(batches, SLICE, LENGTH - 1):
            found = anchors(data, offs)
            keep = substrings.estimated_repeated(shared.value, found[-1], bits) if len(found[-1]) else np.zeros(0, bool)
            if hot is not None and len(keep):
                keep &= ~substrings.is_hot(hot.value, found[-1])
            if not keep.any():
                continue
            text, place, first, last, key = (x[keep] for x in found)
            if narrow:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])
                continue
            whole, at = data.tobytes(), offs[text] - base
            for a in range(0, len(key), REGIONS):
                b = min(a + REGIONS, len(key))
                parts = [whole[i : j + LENGTH] for i, j in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)]
                places = [pa.array((x - at)[a:b].astype(np.int32)) for x in (first, last, place)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text[a:b])), pa.array(key[a:b].view(np.int64)), *places, pa.array(parts, pa.binary())], names=["row", "key", "first", "last", "place", "bytes"])

    return texts.mapInArrow(run, "key long" if narrow else _REGION)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key; whole anchors are merged, about SHARD rows at a time."""
    reach = LENGTH - CONTEXT

    def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
        key, first, last, place = (part.column(c).to_numpy() for c in ("key", "first", "last", "place"))
        edge = np.concatenate([[True], key[1:] != key[:-1]])
        block = np.cumsum(edge) - 1
        shared = np.bincount(block)[block] > 1  # an anchor met once after all has nothing to be compared with
        if not shared.any():
            return
        at = np.flatnonzero(shared)
        block, first, last, place = (x[at] for x in (block, first, last, place))
        before, after = np.zeros((len(at), reach), np.uint8), np.zeros((len(at), LENGTH), np.uint8)
        column = part.column("bytes").take(pa.array(at)).to_pylist()
        for i, raw in enumerate(column):
            cut = int(place[i] - first[i])
            own = np.frombuffer(raw, np.uint8)
            before[i, :cut] = own[:cut][::-1]
            after[i, : len(own) - cut] = own[cut:]
        least, largest = repeated_ranges(block, before, after, place - last, place - first)
        hit = np.flatnonzero(largest >= 0)
        if len(hit):
            row = part.column("row").take(pa.array(at[hit])).combine_chunks()
            yield pa.RecordBatch.from_arrays([row, pa.array((place - largest)[hit].astype(np.int32)), pa.array((place - least + LENGTH)[hit].astype(np.int32))], names=["row", "start", "end"])

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:  # small pieces, so that little is held beyond a shard
            piece = batch.slice(at, SHARD)
            at += SHARD
            held.append(piece)
            n += piece.num_rows
            if n < SHARD:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.flatnonzero(key == key[-1])[0])  # the last anchor may go on
            if whole:
                yield from done(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                n -= whole
    if n:
        yield from done(pa.Table.from_batches(held))


def _hot_strings(data: np.ndarray, offs: np.ndarray, marks: tuple[np.ndarray, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(begins, digests) of the strings of a slice whose anchors are hot: places within the slice, and two hashes each."""
    _, _, first, last, key = anchors(data, offs)
    hit = np.flatnonzero(substrings.is_hot(marks, key))
    if not len(hit):
        return np.zeros(0, np.int64), []
    first, last = first[hit], last[hit]
    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    # Only the bytes of these strings are hashed, those of overlapping ones once.
    new = np.concatenate([[True], first[1:] > last[:-1] + LENGTH])
    begin, end = first[new], last[np.append(new[1:], True)] + LENGTH
    part = np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    moved = begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]])
    local = at - np.repeat(moved[np.cumsum(new) - 1], last - first + 1)
    return at, [substrings._combined(t[part], LENGTH)[local].view(np.int64) for t in _SEEDS]


def _hot_counts(texts: DataFrame, hot) -> DataFrame:
    """(h, g): digests of the strings under hot anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs, _ in pieces_of(batches, SLICE, LENGTH - 1):
            at, digests = _hot_strings(data, offs, hot.value)
            if len(at):
                h, g = digests
                order = np.lexsort((g, h))
                h, g = h[order], g[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(g[new]), pa.array(np.diff(np.append(new, len(h))))], names=["h", "g", "n"])

    return texts.mapInArrow(run, "h long, g long, n long").groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "g")


def _hot_rows(texts: DataFrame, hot) -> DataFrame:
    """Every string under a hot anchor with its row, place and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs, base in pieces_of(batches, SLICE, LENGTH - 1):
            at, digests = _hot_strings(data, offs, hot.value)
            if len(at):
                text = np.searchsorted(offs, at, "right") - 1
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text)), pa.array((at - offs[text] + base).astype(np.int32)), *map(pa.array, digests)], names=["row", "start", "h", "g"])

    return texts.mapInArrow(run, f"row {ROW}, start int, h long, g long")


def repeated_spans(docs: DataFrame, bits: int | None = None) -> tuple[DataFrame, tuple[np.ndarray, ...] | None]:
    """(spans, hot). spans: (row, start, end), byte ranges of strings of 400 bytes that also start elsewhere; ranges may
    overlap and recur. hot: arrays for `_hot_spans`, which finds those under hot anchors."""
    spark = docs.sparkSession
    texts = docs.select(row_key("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    bits = bits or substrings.cell_bits(texts, ANCHOR_BYTES)
    shared = spark.sparkContext.broadcast(substrings.sketch(texts, bits, _keys))
    marks = substrings.hot_bitmap(_regions(texts, shared, bits, narrow=True), HOT)
    hot = spark.sparkContext.broadcast(marks) if marks is not None else None
    dealt = _regions(texts, shared, bits, hot).repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_compare, _SPAN)
    if hot is None:
        return found, None
    twice = cut(_hot_counts(texts, hot))
    if twice.count() <= HOT_TABLE:
        rows = twice.toArrow()
        h, g = rows.column("h").to_numpy(), rows.column("g").to_numpy()
        order = np.argsort(h)
        return found, (marks, h[order], g[order])
    strings = _hot_rows(texts, hot)
    return found.unionByName(strings.join(twice, ["h", "g"]).select("row", "start", (F.col("start") + LENGTH).alias("end"))), None


def _hot_spans(data: np.ndarray, offs: np.ndarray, hot) -> dict[int, list[tuple[int, int]]]:
    """Repeated ranges of each text of a slice, as far as their anchors are hot; those of a long text's pieces may touch or overlap."""
    out: dict[int, list[tuple[int, int]]] = {}
    if len(offs) > 2 or len(data) <= SLICE + LENGTH - 1:
        _add_hot_spans(data, offs, 0, hot, out)
    else:
        for at in range(0, len(data) - LENGTH + 1, SLICE):
            piece = data[at : at + SLICE + LENGTH - 1]
            _add_hot_spans(piece, np.array([0, len(piece)]), at, hot, out)
    return out


def _add_hot_spans(data: np.ndarray, offs: np.ndarray, base: int, hot, out: dict[int, list[tuple[int, int]]]) -> None:
    marks, hs, gs = hot
    at, digests = _hot_strings(data, offs, marks)
    if not len(at):
        return
    place = lookup(digests[0], hs)
    at = np.sort(at[(place >= 0) & (gs[place] == digests[1])])
    if not len(at):
        return
    text = np.searchsorted(offs, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] > at[:-1] + LENGTH)]))
    ends = np.append(new[1:], len(at)) - 1
    begin = offs[text[new]] - base
    for t, a, b in zip(text[new].tolist(), (at[new] - begin).tolist(), (at[ends] - begin + LENGTH).tolist(), strict=True):
        out.setdefault(t, []).append((a, b))


def dedup_bytes(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) a row of docs; kept are the remaining bytes.

    A byte goes if a 400-byte string over it also starts anywhere else, in its own document too; what a removal leaves
    may no longer be UTF-8. Only doc_id and text are read. Null texts are empty; repeated rows are copies of each other
    and lose what they share; an empty table gives no rows. Texts are taken half a MB at a time, longer ones in pieces that
    share 399 bytes, so memory beyond a text's own bytes does not grow with it, except by its removed ranges.
    """
    return _stripped(docs, bits, digest=False)


def digest(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): as dedup_bytes, hashed where the bytes are."""
    return _stripped(docs, bits, digest=True)


def _stripped(docs: DataFrame, bits: int | None, digest: bool) -> DataFrame:
    found, hot = repeated_spans(docs, bits)
    shared = docs.sparkSession.sparkContext.broadcast(hot) if hot is not None else None
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # within one document
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key("doc_id", "text").alias("row"))
    joined = texts.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans")
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, limit=SLICE):
            sizes, removed, runs, kept = [], [], [], []
            whole, more = data.tobytes(), _hot_spans(data, offs, shared.value) if shared is not None else {}
            for i, (begin_at, end_at, found) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column(2), strict=True)):
                raw = whole[begin_at:end_at]
                parts, at, gone, n = [], 0, 0, 0
                ranges = more.get(i, [])
                if found.is_valid:
                    ranges = ranges + list(zip(found.values.field(0).to_pylist(), found.values.field(1).to_pylist(), strict=True))
                if ranges:
                    upto = -1  # end of the maximal removed run
                    for a, b in sorted(ranges):
                        if a > upto:
                            n += 1
                        if b > upto:
                            begin = max(a, upto, 0)
                            parts.append(raw[at:begin])
                            gone += b - begin
                            at = upto = b
                parts.append(raw[at:])
                rest = b"".join(parts)
                sizes.append(len(raw))
                removed.append(gone)
                runs.append(n)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)], pa.array(kept, last[1])], names=["doc_id", "n_bytes", "n_removed", "n_spans", last[0]])

    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]} {'string' if digest else 'binary'}")
