"""Language identification by language-bitmask n-gram filters.

Character trigrams of the learning texts are counted a language; a trigram belongs to the languages that use it often
enough, on its own scale (LEAST_RATE) and against the language that uses it most (SHARE). One Bloom filter holds all
languages, bit-sliced: a slot is a mask with one bit a language, so a lookup of HASHES slots and their AND returns every
language that contains the trigram. A text's hits are counted bit by bit, corrected for the share of false positives
that the language's fill of the slots implies, and the largest corrected count decides.

The filter has 2**SLOT_BITS slots of 64 languages a word, whatever the corpus; it is all that is collected and shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import mix, slices

SLOT_BITS, HASHES = 18, 3
LEAST_RATE, SHARE = 1e-5, 0.2
FLUSH = 1 << 20
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, lettered): packed trigrams of lower-cased letters, other characters as one space; which texts have letters."""
    raw, letter = data.tobytes(), _letters()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    # A space on either side of every text keeps trigrams from reaching into the next one.
    codes = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 2)
    alpha = letter[codes]
    lettered = np.bincount(owner[alpha], minlength=len(texts)) > 0
    keep = alpha.copy()
    keep[:-1] |= alpha[1:]  # of a run of other characters only the ends count
    keep[1:] |= alpha[:-1]
    codes, owner = np.where(alpha, codes, 32)[keep].astype(np.uint64), owner[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), lettered
    gram = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    inside = (owner[:-2] == owner[2:]) & ~((codes[:-2] == 32) & (codes[1:-1] == 32)) & ~((codes[1:-1] == 32) & (codes[2:] == 32))
    return owner[:-2][inside], gram[inside], lettered


def slots_of(gram: np.ndarray) -> list[np.ndarray]:
    return [(mix(gram + np.uint64(k * 0x51ED27)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for k in range(HASHES)]


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, slots, false rates) from the text and lang of the rows that are not held out."""
    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder() != 2)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(index, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for rows, data, offs in slices(batches, limit=1 << 20):
            owner, gram, _ = trigrams(data, offs)
            langs = np.array(rows.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                part = np.unique(gram[(langs == lang)[owner]], return_counts=True)
                held.setdefault(lang, []).append(part)
                n += len(part[0])
            if n >= FLUSH:
                yield from flush()
                held, n = {}, 0
        yield from flush()

    counts = taught.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r["lang"] for r in totals.select("lang").collect())  # a row a language
    if not names:
        return [], np.zeros((0, 1 << SLOT_BITS), np.uint64), np.zeros(0)
    index = F.array_position(F.lit(names), F.col("lang")).cast("int") - 1
    rates = counts.join(F.broadcast(totals), "lang").select("gram", (F.col("n") / F.col("total")).alias("rate"), index.alias("i")).filter(F.col("rate") >= LEAST_RATE)
    most = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    members = rates.join(most, "gram").filter(F.col("rate") >= F.col("top") * SHARE)
    masks = members.groupBy("gram", F.expr("i div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, i % 64))").alias("mask"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(0).to_numpy().view(np.uint64)
            slots = np.concatenate(slots_of(grams)) if len(grams) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.tile(b.column(1).to_numpy(), HASHES)), pa.array(np.tile(b.column(2).to_numpy(), HASHES))], names=["slot", "word", "mask"])

    filled = masks.select("gram", "word", "mask").mapInArrow(deal, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    slots = np.zeros((-(-len(names) // 64), 1 << SLOT_BITS), np.uint64)
    for r in filled.toLocalIterator():  # at most a row a slot and word
        slots[r.word, r.slot] = np.uint64(r.mask & 0xFFFFFFFFFFFFFFFF)
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return names, slots, fill**HASHES


def classify(data: np.ndarray, offs: np.ndarray, model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, score) of each text: the score is the winner's corrected share of the text's trigrams."""
    names, slots, false = model
    owner, gram, lettered = trigrams(data, offs)
    n = len(offs) - 1
    total = np.bincount(owner, minlength=n)
    at = slots_of(gram)
    best, pick = np.full(n, -np.inf), np.full(n, -1)
    for w in range(len(slots)):
        mask = slots[w][at[0]]
        for s in at[1:]:
            mask &= slots[w][s]
        for i in range(64 * w, min(64 * w + 64, len(names))):
            hits = np.bincount(owner, weights=(mask >> np.uint64(i % 64)) & np.uint64(1), minlength=n)
            right = (hits - total * false[i]) / max(1e-9, 1 - false[i])
            better = right > best + 1e-9
            best[better], pick[better] = right[better], i
    pick[~lettered] = -1
    score = np.where(pick >= 0, np.clip(best / np.maximum(total, 1), 0, 1), 0.0)
    return pick, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) a row of docs; only the text is an input of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*shared.value[0], UNKNOWN]
        for rows, data, offs in slices(batches, limit=1 << 20):
            pick, score = classify(data, offs, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([names[i] for i in pick.tolist()], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs that are not held out and predict all of them.

    Held out are rows whose crc32(doc_id as text) mod 4 is 2; rows without doc_id are predicted but taught from neither.
    Null texts and texts without a letter are `und` with score 0; a text of letters that no filter knows goes to the
    first language with score 0. Without a single learnable row everything is `und`. Repeated rows each get a row.
    """
    return predict(docs, learn(docs))
