"""Tokens of texts by byte-level byte-pair encoding, merge rank by merge rank, from a public vocabulary file.

A text is cut into pieces by the vocabulary's pattern; pieces recur, so each worker keeps what it has encoded in a cache of
bounded size. Within a piece the adjacent pair of least rank is merged until none is left: pairs wait in a heap, neighbours
are a doubly linked list, so a piece of n bytes takes n log n steps, whatever it holds.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary's pieces follow.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to CACHED bytes are kept, KEPT of them at most.
CACHED, KEPT = 64, 1 << 16


def ranks_of(lines: list[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a vocabulary file: base64 and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece; every single byte is a token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(a: int) -> tuple[int, int, int, int] | None:
        b = after[a]
        rank = ranks.get(piece[a : end[b]]) if b < n else None
        return None if rank is None else (rank, a, end[a], end[b])

    waiting = [p for p in map(pair, range(n)) if p]
    heapq.heapify(waiting)
    while waiting:
        _, a, middle, stop = heapq.heappop(waiting)
        b = after[a]
        if not alive[a] or end[a] != middle or b >= n or end[b] != stop:
            continue  # one of the two has been merged since
        alive[b], end[a], after[a] = False, stop, after[b]
        if after[a] < n:
            before[after[a]] = a
        for left in (before[a], a):
            if left >= 0 and (p := pair(left)):
                heapq.heappush(waiting, p)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def counted(texts: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """texts with `n_tokens`, the tokens of each text; null and empty texts have none, and a column of that name is replaced.

    vocabulary: a file that Spark can read; its lines, some 50,000, are broadcast.
    """
    import regex

    spark = texts.sparkSession
    lines = [r.value.encode() for r in spark.read.text(vocabulary).collect()]
    shared = spark.sparkContext.broadcast(ranks_of(lines))
    name = "n_tokens"
    kept = texts.drop(name)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cut = shared.value, regex.compile(PATTERN)
        size = lru_cache(KEPT)(lambda piece: len(merged(piece.encode(), ranks)))
        long = lambda piece: len(merged(piece.encode(), ranks))
        for batch in batches:
            counts = [sum((size if len(m[0]) <= CACHED else long)(m[0]) for m in cut.finditer(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, name])

    fields = [*[f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema], f"{name} long"]
    return kept.mapInArrow(run, ", ".join(fields))


def cost(n_in: Column, n_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a call from its token counts and prices a million tokens."""
    return F.round((n_in * price_in + n_out * price_out) / 1_000_000, 6)
