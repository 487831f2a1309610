"""SentencePiece encoding and decoding by a max-plus parallel scan.

The lattice of a text has a node (position, piece) for every vocabulary piece that ends there and an edge between two
pieces that follow each other and are compatible, i.e. that the model's own merges leave as these two pieces. Edges
weigh the piece's score, incompatible ones minus infinity. A sequence of pieces is the model's encoding exactly if all
its neighbours are compatible, so from a given start at most one path reaches each node, and it is the encoding.

A giant document is cut into chunks at fixed places. A chunk's boundary states are the nodes whose piece ends on or
first beyond a boundary; its transfer matrix holds the best score from each entry state to each exit state. Matrices are
combined associatively in the (max, +) semiring: blocks of chunks in parallel, then the blocks' products, then each block
from its own entry and exit state again in parallel, which tells every chunk its states; chunks are then traced back
independently. No piece spans the beginning of a run of spaces, so between such places all entries share
one path: the matrix needs only the pieces around the boundaries, and inside, words are encoded through a cache.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut, row_hash, shuffle_width, slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a chunk; longer documents are cut.
CHUNK = 1 << 16
SPACE = "▁"
#: Words of either generation and pairs of pieces that a worker remembers.
_CACHE, _PAIRS = 300_000, 1_000_000
#: Chunks whose matrices are multiplied in one task; a document's blocks are multiplied in parallel.
BLOCK = 64
NEVER = float("-inf")


class Words(dict):
    """Ids of a word (a space and what follows up to the next one) as bytes; computed on demand, bounded.

    A full generation becomes the older one, whose words are taken over as they are met, so frequent words stay.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        known = self.older.get(word)
        if known is not None:
            self[word] = known
            return known
        parts = self.codec.independent(SPACE + word)
        if len(parts) == 1:
            out = self.codec.word(parts[0])
        else:  # as a word its first part is another word; the others are kept under a name no word can have
            out = self[parts[0][1:]] + b"".join([self.inner(x) for x in parts[1:]])
        if len(word) < 64:
            self[word] = out
        return out


    def inner(self, part: str) -> bytes:
        key = SPACE + part
        out = self.get(key) or self.older.get(key)
        if out is None:
            out = self.codec.word(part)
        self[key] = out
        return out


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.surface = [lib.id_to_piece(i) for i in range(size)]
        usable = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.surface[i]: i for i in usable}
        self.score = {i: lib.get_score(i) for i in usable}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        self.longest = max(map(len, self.ids))
        self.size = [len(p) for p in self.surface]
        self.count = size
        #: Neighbouring characters that some piece has inside; merges never cross any others.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Every beginning of a piece: its id, or -1 if it is only the beginning of longer ones.
        self.begun: dict[str, int] = {}
        for piece in self.ids:
            for k in range(1, len(piece)):
                self.begun.setdefault(piece[:k], -1)
        self.begun.update(self.ids)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on beyond the beginning of a space; words would not be independent")
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words = Words(self)
        # Decoding tables: a piece's text, and None for bytes.
        self.shown = [None if i in self.byte_of else ("" if i not in self.score else p.replace(SPACE, " ")) for i, p in enumerate(self.surface)]

    # The model's merges, used only to tell whether two pieces are compatible.
    def merges(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, piece: int) -> bool:
        """Whether the piece is its own encoding; a code point without a piece (negative) is."""
        if piece < 0:
            return True
        if piece not in self.whole:
            self.whole[piece] = len(self.merges(self.surface[piece])) == 1
        return self.whole[piece]

    def compatible(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return self.stands(a) and self.stands(b)
        known = self.pairs.get(a * self.count + b)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            known = self.pairs[a * self.count + b] = self.merges(self.surface[a] + self.surface[b]) == [self.surface[a], self.surface[b]]
        return known

    def weight(self, piece: int) -> float:
        return self.score[piece] if piece >= 0 else -1e4

    def reach(self, text: str, start: int, piece: int | None, end: int) -> list[int | None]:
        """For positions start..end, the piece of the one path from (start, piece) that ends there; piece None begins a word."""
        get, pairs, count = self.begun.get, self.pairs, self.count
        out: list[int | None] = [None] * (end - start + 1)
        before = piece
        for j in range(start, end):
            if j > start:
                before = out[j - start]
                if before is None:
                    continue
            # Longer pieces that end at the same place begin earlier, so they have been tried before.
            for q in range(j + 1, end + 1):
                u = get(text[j:q])
                if u is None:
                    if q - j > 1:
                        break
                    u = -1 - ord(text[j])
                elif u < 0:
                    continue
                at = q - start
                if out[at] is None:
                    if before is None:
                        fits = self.stands(u)
                    elif before < 0 or u < 0:
                        fits = self.stands(before) and self.stands(u)
                    else:
                        fits = pairs.get(before * count + u)
                        if fits is None:
                            fits = self.compatible(before, u)
                    if fits:
                        out[at] = u
                if u < 0:
                    break
        return out

    def independent(self, text: str) -> list[str]:
        """text cut wherever no piece can reach across."""
        joined, out, at = self.joined, [], 0
        if joined.issuperset(map(add, text, text[1:])):
            return [text]
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in joined:
                out.append(text[at:k])
                at = k
        out.append(text[at:])
        return out

    def word(self, text: str) -> bytes:
        """Ids of one whole word: its path in the lattice, longer pieces first.

        One path at most leads to a place, so a place from which the end was not reached is not tried again.
        """
        get, pairs, count, size = self.begun.get, self.pairs, self.count, len(text)
        path: list[int] = []
        left: list[list[tuple[int, int]]] = []  # of each place on the path, the pieces not yet tried, the longest last
        seen: set[int] = set()
        at, before = 0, None
        while at < size:
            ahead = []
            for q in range(at + 1, size + 1):
                u = get(text[at:q])
                if u is None:
                    if q - at == 1:
                        ahead.append((q, -1 - ord(text[at])))
                    break
                if u >= 0:
                    ahead.append((q, u))
            while True:
                while ahead:
                    q, u = ahead.pop()
                    if q in seen:
                        continue
                    if before is None:
                        fits = self.stands(u)
                    elif before < 0 or u < 0:
                        fits = self.stands(before) and self.stands(u)
                    else:
                        fits = pairs.get(before * count + u)
                        if fits is None:
                            fits = self.compatible(before, u)
                    if fits:
                        break
                else:
                    ahead = left.pop()
                    path.pop()
                    before = path[-1] if path else None
                    continue
                break
            seen.add(q)
            left.append(ahead)
            path.append(u)
            at, before = q, u
        return self.ids_of(path) if path and min(path) < 0 else array("i", path).tobytes()

    def length(self, piece: int) -> int:
        return 1 if piece < 0 else len(self.surface[piece])

    def trace(self, text: str, start: int, piece: int | None, end: int) -> tuple[list[int], float]:
        """(pieces from start to end, their score) of the path after (start, piece)."""
        reached = self.reach(text, start, piece, end)
        out, at, total = [], end, 0.0
        while at > start:
            u = reached[at - start]
            if u is None:
                return [], NEVER
            out.append(u)
            total += self.weight(u)
            at -= self.length(u)
        return (out[::-1], total) if at == start else ([], NEVER)

    def ids_of(self, path: list[int], _score: float = 0.0) -> bytes:
        flat: list[int] = []
        for u in path:
            if u >= 0:
                flat.append(u)
            else:  # no piece for this code point: its bytes
                flat += [self.byte[b] for b in chr(-1 - u).encode()]
        return np.array(flat, np.int32).tobytes()

    def encode_words(self, text: str) -> bytes:
        """Ids of a normalised text that begins and ends at the beginning of a space run (or its end)."""
        parts = text.split(SPACE)[1:]
        if "" not in parts:
            return b"".join(map(self.words.__getitem__, parts))
        out, spaces = [], 0
        for i, part in enumerate(parts):
            if part == "" and i < len(parts) - 1:
                spaces += 1  # a run of spaces belongs to the word that follows it
            elif spaces:
                word = SPACE * (spaces + 1) + part
                out.append(self.ids_of(*self.trace(word, 0, None, len(word))))
                spaces = 0
            else:
                out.append(self.words[part])
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_words(normalised(text)), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        try:
            whole = "".join(map(self.shown.__getitem__, ids))
            return whole[1:] if whole.startswith(" ") else whole
        except TypeError:  # bytes among them
            pass
        out: list[str] = []
        held = bytearray()
        for i in ids:
            shown = self.shown[i]
            if shown is None:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(shown)
        if held:
            out.append(held.decode("utf-8", "replace"))
        whole = "".join(out)
        return whole[1:] if whole.startswith(" ") else whole

    # Chunks. `text` holds the chunk [begin, end) with `longest` code points more on either side; all places are within it.
    def entries(self, text: str, begin: int) -> list[tuple[int, int | None]]:
        found: list[tuple[int, int | None]] = []
        for p in range(begin, min(len(text), begin + self.longest - 1) + 1):
            for j in range(max(0, p - self.longest), begin):
                u = self.ids.get(text[j:p])
                if u is None and p - j == 1:
                    u = -1 - ord(text[j])
                if u is not None and self.stands(u):
                    found.append((p, u))
        return found

    def exits(self, text: str, start: int, piece: int | None, end: int, last: bool) -> dict[tuple[int, int], float]:
        upto = end if last else min(len(text), end + self.longest - 1)
        reached = self.reach(text, start, piece, upto)
        out = {}
        for q in range(end, upto + 1):
            u = reached[q - start] if q > start else None
            if u is not None and q - self.length(u) < end:
                total, at = 0.0, q
                while at > start:
                    v = reached[at - start]
                    total += self.weight(v)
                    at -= self.length(v)
                out[q, u] = total
        return out

    def matrix(self, text: str, begin: int, end: int, first: bool, last: bool) -> dict[tuple, dict[tuple, float]]:
        """Entry state -> exit state -> score; the part that all entries share counts 0."""
        entries = [(begin, None)] if first else self.entries(text, begin)
        starts = _word_starts(text, begin, end)
        tail = self.exits(text, starts[-1], None, end, last) if starts else {}
        out: dict[tuple, dict[tuple, float]] = {}
        for p, u in entries:
            if p >= end and not (first and begin == end):
                row = {(p, u): 0.0} if not last or p == end else {}
            elif starts and (inner := next((s for s in starts if s >= p), None)) is not None:
                way = 0.0 if inner == p else self.trace(text, p, u, inner)[1]
                row = {} if way == NEVER else {k: way + v for k, v in tail.items()}
            else:
                row = self.exits(text, p, u, end, last)
            if row:
                out[p, u] = row
        return out

    def between(self, text: str, begin: int, end: int, entry: tuple, leave: tuple) -> bytes:
        """Ids of the pieces after the entry state up to the exit state."""
        (p, u), (q, _) = entry, leave
        if q <= p:
            return b""
        starts = [s for s in _word_starts(text, begin, end) if s >= p]
        if not starts:
            return self.ids_of(*self.trace(text, p, u, q))
        head = self.ids_of(*self.trace(text, p, u, starts[0]))
        return head + self.encode_words(text[starts[0] : starts[-1]]) + self.ids_of(*self.trace(text, starts[-1], None, q))


def _word_starts(text: str, begin: int, end: int) -> list[int]:
    """First and last place in [begin, end) where a run of spaces begins (all that is needed is those two and order)."""
    at, found = begin, []
    while (at := text.find(SPACE, at, end)) >= 0:
        if at == 0 or text[at - 1] != SPACE:
            found.append(at)
        at += 1
    return found


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def combine(a: dict, b: dict) -> dict:
    """Max-plus product: entry of a -> exit of b -> best score over the states between."""
    out: dict = {}
    for entry, row in a.items():
        best: dict = {}
        for state, score in row.items():
            for leave, more in b.get(state, {}).items():
                if score + more > best.get(leave, NEVER):
                    best[leave] = score + more
        if best:
            out[entry] = best
    return out


def product(matrices: list[dict]) -> dict:
    out = matrices[0]
    for m in matrices[1:]:
        out = combine(out, m)
    return out


def states(matrices: list[dict], entry: tuple | None = None, leave: tuple | None = None) -> list[tuple[tuple, tuple]]:
    """(entry, exit) of every matrix on the best path between two states; by default from the only one to the best."""
    start = entry or next(iter(matrices[0]))
    prefix = [{start: matrices[0][start]}]
    for m in matrices[1:]:
        prefix.append(combine(prefix[-1], m))
    leave = leave or max(prefix[-1][start], key=prefix[-1][start].get)
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        if k == 0:
            begin = start
        else:
            begin = max((e for e, row in matrices[k].items() if leave in row and e in prefix[k - 1][start]), key=lambda e: prefix[k - 1][start][e] + matrices[k][e][leave])
        out.append((begin, leave))
        leave = begin
    return out[::-1]


def _piece(x) -> int | None:
    import pandas as pd

    return None if pd.isna(x) else int(x)


def _matrices(frame, key: str) -> tuple[list[int], list[dict]]:
    """The matrices of a frame's rows in order of key."""
    by: dict[int, dict] = {}
    for k, p, u, q, v, score in zip(frame[key], frame["p"], frame["u"], frame["q"], frame["v"], frame["score"], strict=True):
        by.setdefault(int(k), {}).setdefault((int(p), _piece(u)), {})[int(q), _piece(v)] = score
    return sorted(by), [by[k] for k in sorted(by)]


def chunk_states(steps: DataFrame) -> DataFrame:
    """(row, k, p, u, q): entry state and end of each chunk on the best path, from the transfer matrices of all chunks.

    A parallel scan of three passes: products of BLOCK chunks, the path over a document's products, the paths in blocks.
    """
    blocked = steps.withColumn("b", F.floor(F.col("k") / BLOCK))

    def multiply(key, frame):
        import pandas as pd

        _, found = _matrices(frame, "k")
        rows = [(*key, p, u, q, v, score) for (p, u), row in product(found).items() for (q, v), score in row.items()]
        return pd.DataFrame(rows, columns=["row", "b", "p", "u", "q", "v", "score"]).astype({"u": "Int64", "v": "Int64"})

    def over(key, frame):
        import pandas as pd

        names, found = _matrices(frame, "b")
        path = states(found)
        return pd.DataFrame([(key[0], b, *e, *x) for b, (e, x) in zip(names, path, strict=True)], columns=["row", "b", "p", "u", "q", "v"]).astype({"u": "Int64", "v": "Int64"})

    def within(key, frame, ends):
        import pandas as pd

        names, found = _matrices(frame, "k")
        end = ends.iloc[0]
        path = states(found, (int(end["p"]), _piece(end["u"])), (int(end["q"]), _piece(end["v"])))
        return pd.DataFrame([(key[0], k, *e, x[0]) for k, (e, x) in zip(names, path, strict=True)], columns=["row", "k", "p", "u", "q"]).astype({"u": "Int64"})

    state = "p long, u long, q long, v long"
    products = blocked.groupBy("row", "b").applyInPandas(multiply, f"row long, b long, {state}, score double")
    ends = products.groupBy("row").applyInPandas(over, f"row long, b long, {state}")
    return blocked.groupBy("row", "b").cogroup(ends.groupBy("row", "b")).applyInPandas(within, "row long, k long, p long, u long, q long")


@lru_cache(maxsize=2)
def _codec(name: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read())


def _shipped(df: DataFrame, model: str) -> str:
    df.sparkSession.sparkContext.addFile(model)  # the driver's file reaches every executor
    return os.path.basename(model)


def _list_array(parts: list[bytes]) -> pa.Array:
    sizes = np.array([0, *(len(p) // 4 for p in parts)], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encoded(docs: DataFrame, model: str, chunk: int, schema: str, emit) -> DataFrame:
    """Ids of every row's whole text, made into the rows that emit(codec, rows, ids) builds where the codec is at hand."""
    name = _shipped(docs, model)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("doc_id", "text").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = picked.filter(F.length("text") < chunk).withColumn("text", F.col("text").cast("binary"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for rows, data, offs in slices(batches):
            raw = data.tobytes()
            yield emit(codec, rows, [codec.encode_words(normalised(raw[a:b].decode())) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for rows in batches:
            for k in range(rows.num_rows):  # giants one at a time
                yield emit(codec, rows.slice(k, 1), [rows.column(2)[k].values.to_numpy().astype(np.int32).tobytes()])

    giants = _scanned(picked.filter(F.length("text") >= chunk).distinct(), picked, name, chunk)
    return short.mapInArrow(whole, schema).unionByName(giants.mapInArrow(gathered, schema))


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row, ids): the piece ids of every row's whole text, equal to the library's own encoding.

    Null and empty texts have no ids. Repeated rows each get a row. Only doc_id and text are read; an empty table gives
    no rows. Documents of more than `chunk` code points are cut and scanned, all others are a chunk of their own.
    """
    emit = lambda codec, rows, parts: pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _list_array(parts)], names=["doc_id", "row", "ids"])
    return _encoded(docs, model, chunk, "doc_id long, row long, ids array<int>", emit)


def _scanned(giant: DataFrame, picked: DataFrame, name: str, chunk: int) -> DataFrame:
    """ids of the giant texts, a row for each of their rows."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = _codec(name).longest
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                symbols = normalised(text.as_py())
                n = len(symbols)
                for k, c in enumerate(range(0, n, chunk)):
                    left = max(0, c - margin)
                    part = [symbols[left : min(n, c + chunk + margin)]]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array(part), pa.array([c - left]), pa.array([min(n, c + chunk) - left]), pa.array([left]), pa.array([c + chunk >= n])], names=["row", "k", "part", "begin", "end", "left", "last"])

    schema = "row long, k long, part string, begin long, end long, left long, last boolean"
    chunks = cut(giant.select("row", "text").mapInArrow(cut_up, schema).repartition(shuffle_width(giant.sparkSession), "row", "k"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "k", "p", "u", "q", "v", "score")}
            for x in batch.to_pylist():
                found = codec.matrix(x["part"], x["begin"], x["end"], x["k"] == 0, x["last"])
                for (p, u), row in found.items():
                    for (q, v), score in row.items():
                        for c, y in zip(out, (x["row"], x["k"], p + x["left"], u, q + x["left"], v, score), strict=True):
                            out[c].append(y)
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    steps = chunks.mapInArrow(matrices, "row long, k long, p long, u long, q long, v long, score double")

    known = chunk_states(cut(steps))

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            rows = batch.to_pylist()
            parts = [codec.between(x["part"], x["begin"], x["end"], (x["p"] - x["left"], x["u"]), (x["q"] - x["left"], None)) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _list_array(parts)], names=["row", "k", "ids"])

    traced = chunks.join(known, ["row", "k"]).select("row", "k", "part", "begin", "end", "left", "p", "u", "q").mapInArrow(backtrace, "row long, k long, ids array<int>")
    gathered = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    named = picked.filter(F.length("text") >= chunk).select("doc_id", "row")
    return named.join(gathered, "row").select("doc_id", "row", "ids")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """encoded (with `ids`) with `decoded`: the text of the ids; null ids give null. Ids outside the vocabulary raise."""
    name = _shipped(encoded, model)

    @F.pandas_udf("string")
    def text_of(ids):
        codec = _codec(name)
        return ids.map(lambda x: None if x is None else codec.decode(x.tolist()))

    return encoded.withColumn("decoded", text_of("ids"))


def encode_decode(docs: DataFrame, model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256) of every row: its ids, and the SHA-256 of the text decoded from them.

    As encode; both ways are taken in one pass, so a worker holds one codec.
    """

    def emit(codec: Codec, rows: pa.RecordBatch, parts: list[bytes]) -> pa.RecordBatch:
        shown = [hashlib.sha256(codec.decode(np.frombuffer(p, np.int32).tolist()).encode()).hexdigest() for p in parts]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(p) // 4 for p in parts], pa.int64()), _list_array(parts), pa.array(shown, pa.string())], names=["doc_id", "n_pieces", "ids", "decoded_sha256"])

    return _encoded(docs, model, chunk, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string", emit)
