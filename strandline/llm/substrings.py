"""Substring dedup over word windows with a count-min prefilter.

Every window of 13 words owns an anchor, the 7-word stretch of least hash inside it, so equal windows own equal anchors
and an anchor occurs at least as often as any of its windows. Pass one adds the anchors to count-min sketches, partition
by partition; their cells are merged by saturating sums and only one bit a cell survives: seen twice or more. The
estimate never falls short, so pass two loses nothing when it keeps just the windows estimated repeated. These are dealt
by anchor and grouped exactly, in order of doc_id, so the first document of each window is known and later ones drop
it. A window is known by two independent hashes of its words together, 128 bits: its anchor's and its own.

Anchors with more than HOT rows are not grouped in one task. Their windows are reduced slice by slice to their least and
largest doc_id, so copies meet as partial results, and only windows of two or more documents stay. Up to HOT_TABLE of
them are broadcast and looked up where the texts are read in the end; beyond that they are joined to the windows.

The sketch has two rows of 2**bits cells; bits follow the size of the text up to MOST_BITS. Beyond about 13 GB of text a
cell is no longer mostly empty and the sketch lets more through, which costs shuffle, never rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ROW, cut, lookup, mix, place_table, row_key, shuffle_width, slices, span_hashes, word_spans

WIDTH, ANCHOR = 13, 7
SKETCH_ROWS, BLOCK_BITS, MOST_BITS = 2, 16, 29
#: Bytes of text for each anchor, about: what the sketch's size is derived from.
ANCHOR_BYTES = 25
#: Anchors a partition sketch takes before it is handed on.
FLUSH = 1 << 20
#: Rows of an anchor beyond which it is not grouped in one task, and repeated windows of such anchors that are broadcast.
HOT, HOT_TABLE = 5_000, 1 << 20
#: Bits of the bitmap of hot anchors, at most: 16 MB.
HOT_BITS = 27
_TABLES = place_table(3), place_table(4)


def _combined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by doubling: runs of 1, 2, 4.. words are put together."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, taken, power, size = None, 0, words, 1
    while True:
        if width & size:
            part = power[taken : taken + n]
            out = part.copy() if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + part)
            taken += size
        size *= 2
        if size > width:
            return out
        half = size // 2
        power = mix(power[:-half] * np.uint64(0xD1B54A32D192ED03) + power[half:])


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash, anchor, key) of every window: its text's index, first word within the text, hash, place and hash of its anchor."""
    start, end, first = word_spans(data, offs)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(offs) - 1), counts)
    none = np.zeros(0, np.int64)
    if len(start) < WIDTH:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    names = span_hashes(data, start, end, *_TABLES)
    at = np.flatnonzero(owner[: len(owner) - WIDTH + 1] == owner[WIDTH - 1 :])
    short = _combined(names[0], ANCHOR)
    least, place = short[at], at.copy()
    for k in range(1, WIDTH - ANCHOR + 1):
        here = short[at + k]
        better = here < least
        least = np.where(better, here, least)
        place[better] = at[better] + k
    return owner[at], at - first[owner[at]], _combined(names[1], WIDTH)[at], place, least


def cells_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(salt * 0x9E37)) >> np.uint64(64 - bits)).astype(np.int64) for salt in range(SKETCH_ROWS)]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for _, data, offs in slices(batches):
        _, _, _, place, key = windows(data, offs)
        if len(key):
            yield key[np.concatenate([[True], place[1:] != place[:-1]])]  # a place once, though several windows share it


def cell_bits(texts: DataFrame, per_anchor: int) -> int:
    """Bits for about four cells an anchor, within the limits."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(BLOCK_BITS, round(math.log2(max(1, 4 * size / per_anchor)))))


def sketch(texts: DataFrame, bits: int, keys_of=_anchors) -> list[np.ndarray]:
    """One bit array a sketch row: the cells whose merged count of the keys (those of keys_of) is two or more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            for row, cells in enumerate(cells_of(keys, bits)):
                cell, count = np.unique(cells, return_counts=True)
                block = cell >> BLOCK_BITS
                edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
                low = (cell & ((1 << BLOCK_BITS) - 1)).astype("<u2")
                twice = count > 1
                numbers = [int(block[a]) + (row << 32) for a in edges[:-1]]
                once = [low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                more = [low[a:b][twice[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

        held, n = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield from flush(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from flush(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now = np.zeros(1 << BLOCK_BITS, np.uint8), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()])], names=["block", "bits"])

        for batch in batches:
            for block, once, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    counts[:], now = 0, block
                for part in (once, more):
                    cell = np.frombuffer(part.as_buffer(), "<u2")  # distinct within a part
                    counts[cell] = np.minimum(counts[cell] + 1, 2)
        if now is not None:
            yield done()

    pieces = texts.mapInArrow(partial, "block long, once binary, more binary").repartition(shuffle_width(texts.sparkSession), "block").sortWithinPartitions("block")
    out = [np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(SKETCH_ROWS)]
    size = 1 << (BLOCK_BITS - 3)
    for r in pieces.mapInArrow(merge, "block long, bits binary").toLocalIterator():  # bounded by the sketch's size
        at, part = (r.block & 0xFFFFFFFF) * size, np.frombuffer(r.bits, np.uint8)
        row = out[r.block >> 32]
        row[at : at + size] = part[: len(row) - at]
    return out


def estimated_repeated(rows: list[np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    flags = np.ones(len(keys), bool)
    for row, cells in zip(rows, cells_of(keys, bits), strict=True):
        flags &= (row[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
    return flags


_CANDIDATE = f"row {ROW}, doc_id long, word int, key long, hashes array<long>"
_LOSS = f"row {ROW}, word int, mask int"


def _candidates(texts: DataFrame, shared, bits: int, hot=None, narrow: bool = False, warm: bool = False) -> DataFrame:
    """A row for each anchor estimated repeated: its document, its first window and the hashes of its windows, which are consecutive;
    narrow: its key alone. Anchors that are hot are left out; warm: they alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            text, word, digest, place, key = windows(data, offs)
            if not len(key):
                continue
            new = np.concatenate([[True], place[1:] != place[:-1]])
            first = np.flatnonzero(new)
            keep = estimated_repeated(shared.value, key[first], bits)
            if hot is not None:
                keep &= is_hot(hot.value, key[first]) == warm
            sizes = np.diff(np.concatenate([first, [len(key)]]))[keep]
            chosen = first[keep]
            if not len(chosen):
                continue
            if narrow:
                yield pa.RecordBatch.from_arrays([pa.array(key[chosen].view(np.int64))], names=["key"])
                continue
            flat = digest[np.repeat(keep, np.diff(np.concatenate([first, [len(key)]])))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))
            take = pa.array(text[chosen])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(word[chosen].astype(np.int32)), pa.array(key[chosen].view(np.int64)), lists], names=["row", "doc_id", "word", "key", "hashes"])

    return texts.mapInArrow(run, "key long" if narrow else _CANDIDATE)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, then doc_id. Emits the windows that a smaller doc_id has had; the last key may go on in the next batch."""
    carried = {"key": np.zeros(0, np.int64), "hash": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64)}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc, word, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        lists = batch.column(4)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(n), sizes)
        # Firsts carried over stand before this batch's rows; a stable sort keeps doc_id order within equal windows.
        keys = np.concatenate([carried["key"], key[owner]])
        hashes = np.concatenate([carried["hash"], flat])
        docs = np.concatenate([carried["doc"], doc[owner]])
        order = np.lexsort((docs, hashes, keys))
        k, h = keys[order], hashes[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
        first = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        lost = np.zeros(len(order), bool)
        lost[order] = docs[order] > first
        lost = lost[len(carried["key"]) :]
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = np.bincount(owner, weights=lost * (1 << bit), minlength=n).astype(np.int32)
        hit = np.flatnonzero(mask)
        if len(hit):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(word[hit]), pa.array(mask[hit])], names=["row", "word", "mask"])
        heads = np.flatnonzero(new & (k == key[-1]))
        carried = {"key": k[heads], "hash": h[heads], "doc": docs[order][heads]}


def hot_bitmap(narrow: DataFrame, hot: int) -> tuple[np.ndarray, int] | None:
    """(bitmap, bits) that marks the keys with more than `hot` rows; None if there are none.

    At most 2**HOT_BITS bits reach the driver, however many keys are hot. Keys that share a bit with a hot one are treated as hot
    too, which is as exact; about 64 bits a key keep them few, as long as the bitmap may grow.
    """
    keys = cut(narrow.groupBy("key").count().filter(F.col("count") > hot).select("key"))
    n = keys.count()
    if not n:
        return None
    bits = min(HOT_BITS, max(BLOCK_BITS, math.ceil(math.log2(64 * n))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.unique(cells_of(batch.column(0).to_numpy().view(np.uint64), bits)[0])
            block = cell >> BLOCK_BITS
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(cell) else np.zeros(1, int)
            low = [(cell[a:b] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]], pa.int64()), pa.array(low, pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, now = np.zeros(1 << BLOCK_BITS, bool), None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(marks, bitorder="little").tobytes()])], names=["block", "bits"])
        for batch in batches:
            for block, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    marks[:], now = False, block
                marks[np.frombuffer(low.as_buffer(), "<u2")] = True
        if now is not None:
            yield done()

    parts = keys.mapInArrow(cells, "block long, cells binary").repartition(shuffle_width(keys.sparkSession), "block").sortWithinPartitions("block")
    out, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (BLOCK_BITS - 3)
    for r in parts.mapInArrow(merge, "block long, bits binary").toLocalIterator():  # bounded by the bitmap's size
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def is_hot(hot: tuple[np.ndarray, int] | None, keys: np.ndarray) -> np.ndarray:
    if hot is None:
        return np.zeros(len(keys), bool)
    cells = cells_of(keys, hot[1])[0]
    return (hot[0][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0


def _pair(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix(key.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + digest.view(np.uint64))


def _hot_windows(texts: DataFrame, hot) -> DataFrame:
    """(key, hash, first): windows of hot anchors that stand in two or more documents, with their least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            text, _, digest, _, key = windows(data, offs)
            hit = np.flatnonzero(is_hot(hot.value, key))
            if not len(hit):
                continue
            doc, k, h = rows.column(1).to_numpy()[text[hit]], key[hit].view(np.int64), digest[hit].view(np.int64)
            order = np.lexsort((h, k))
            doc, k, h = doc[order], k[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(h[new]), pa.array(np.minimum.reduceat(doc, new)), pa.array(np.maximum.reduceat(doc, new))], names=["key", "hash", "low", "high"])

    met = texts.mapInArrow(run, "key long, hash long, low long, high long")
    return met.groupBy("key", "hash").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last").select("key", "hash", "first")


def losses(docs: DataFrame, bits: int | None = None) -> tuple[DataFrame, tuple[np.ndarray, ...] | None]:
    """(lost, hot). lost: (row, word, mask), where bit b of mask tells that the window of 13 words at word + b of that
    row has stood in a document of smaller doc_id. hot: arrays for `_hot_starts`, which finds the losses of hot anchors."""
    texts = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null and text is not null")
    spark = docs.sparkSession
    bits = bits or cell_bits(texts, ANCHOR_BYTES)
    shared = spark.sparkContext.broadcast(sketch(texts, bits))
    # The keys are counted in a pass of their own: keeping the candidates for both uses would take more disk than that takes time.
    marks = hot_bitmap(_candidates(texts, shared, bits, narrow=True), HOT)
    hot = spark.sparkContext.broadcast(marks) if marks is not None else None
    cold = _candidates(texts, shared, bits, hot).repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "doc_id").mapInArrow(_group, _LOSS)
    if hot is None:
        return cold, None
    firsts = cut(_hot_windows(texts, hot))
    if firsts.count() <= HOT_TABLE:
        rows = firsts.toArrow()
        key, digest, first = (rows.column(c).to_numpy() for c in ("key", "hash", "first"))
        order = np.argsort(_pair(key, digest))
        return cold, (_pair(key, digest)[order], key[order], digest[order], first[order])
    warm = _candidates(texts, shared, bits, hot, warm=True).select("row", "doc_id", "word", "key", F.posexplode("hashes").alias("bit", "hash"))
    late = warm.join(firsts, ["key", "hash"]).filter("doc_id > first").groupBy("row", "word").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"))
    return cold.unionByName(late), None


def _hot_starts(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, hot) -> dict[int, np.ndarray]:
    """First words of the windows of each text of a slice that a smaller doc_id has had, as far as their anchors are hot."""
    text, word, digest, _, key = windows(data, offs)
    pairs, keys, digests, firsts = hot
    at = lookup(_pair(key, digest), pairs)
    hit = np.flatnonzero(at >= 0)
    at, doc = at[hit], rows.column(0).to_pandas().to_numpy()
    same = (keys[at] == key[hit].view(np.int64)) & (digests[at] == digest[hit].view(np.int64))
    hit, at = hit[same], at[same]
    owner = doc[text[hit]].astype(float)  # a text without doc_id neither loses nor takes
    late = hit[~np.isnan(owner)]
    late = late[doc[text[late]].astype(np.int64) > firsts[at[~np.isnan(owner)]]]
    edges = np.flatnonzero(np.concatenate([[True], text[late][1:] != text[late][:-1]])) if len(late) else []
    return {int(text[late[a]]): part for a, part in zip(edges, np.split(word[late], edges[1:]), strict=True)} if len(late) else {}


def _strip(batches: Iterator[pa.RecordBatch], emit, hot) -> Iterator[pa.RecordBatch]:
    """batches: doc_id, text, lost. Emits the number of words and the kept ones of each text."""
    for rows, data, offs in slices(batches):
        out, raw = [], data.tobytes()
        more = _hot_starts(rows, data, offs, hot.value) if hot is not None else {}
        for i, (a, b, lost) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), rows.column(2), strict=True)):
            words = raw[a:b].split()
            kept, begins = words, [more[i]] if i in more else []
            if lost.is_valid:
                at, mask = (lost.values.field(k).to_numpy() for k in (0, 1))
                begins += [at[mask >> k & 1 > 0] + k for k in range(WIDTH - ANCHOR + 1)]
            if begins:
                gone = np.bincount(np.unique(np.concatenate(begins)), minlength=len(words))
                covered = np.cumsum(gone)
                covered[WIDTH:] -= np.cumsum(gone)[:-WIDTH]
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            out.append((len(words), kept))
        yield emit(rows, out)


def _stripped(docs: DataFrame, bits: int | None, emit, schema: str) -> DataFrame:
    found, hot = losses(docs, bits)
    lost = found.groupBy("row").agg(F.collect_list(F.struct("word", "mask")).alias("lost"))  # within one document
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key("doc_id", "text").alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(hot) if hot is not None else None
    return texts.join(lost.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "lost").mapInArrow(lambda batches: _strip(batches, emit, shared), schema)


def dedup_windows(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) a row of docs; kept_text joins the kept words by one space.

    A word goes if a window of 13 words over it also starts in a document of smaller doc_id. Only doc_id and text are
    read. Null texts have no words; rows without doc_id have no order, so they neither lose nor take words; rows that
    repeat a doc_id do not count against each other. An empty table gives no rows. Texts are taken a few MB at a time; a
    longer one is taken whole, with about 60 bytes of memory a byte.
    """

    def emit(batch: pa.RecordBatch, out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([n - len(k) for n, k in out], pa.int64()), pa.array([b" ".join(k) for _, k in out], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return _stripped(docs, bits, emit, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): as dedup_windows, hashed where the words are."""

    def emit(batch: pa.RecordBatch, out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([n - len(k) for n, k in out], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _stripped(docs, bits, emit, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, r, s, array_to_string(list_slice(w, s, s + 12), ' ') AS win FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM wins JOIN firsts USING (win) WHERE doc_id > first),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
