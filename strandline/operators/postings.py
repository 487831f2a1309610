"""Documents for many questions at once, newest documents first.

A term is a run of letters, digits, ' and -, and it occurs in a text exactly if it occurs in one of the text's maximal runs of
these, its words. Documents are taken newest first, in slices that grow, and a question leaves once it has its k documents:
what older ones hold can't change them. So common terms never meet the whole corpus, and what is left for the older
documents are the few questions of rare terms. Each slice's texts are read once a round.

Many terms meet the slice's words by joins: by equality with the words' substrings of the terms' lengths. Few terms are
brought to the texts, and no list of words is written. Either way a term's documents are kept as bits of blocks of BLOCK
document ids, of which a question's count is an OR.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import query_terms
from ..session import checkpointed

#: Documents of the first slice, and by what each is larger than the one before. A block's ids are the bits of a long.
BLOCK, FIRST, GROWTH = 64, 128, 8
#: So many terms are brought to the texts at most.
FEW = 50_000
#: Words of up to CACHED characters are kept with their terms, KEPT of them at most.
CACHED, KEPT = 64, 1 << 16
_WORD = r"[a-z0-9'-]{4,}"


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, word), each once a row of docs (doc_id, text); null texts and ids hold nothing."""
    return docs.filter("doc_id is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("word"))


def matched_words(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, word): the words of the vocabulary that hold each term. Both are distinct; a term has four characters or more.

    A word has no more substrings of a length than characters, and terms have few lengths: no trigram's list of words is met whole.
    """
    sizes = terms.select(F.length("term").alias("size")).distinct()
    parts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, n)))
    held = vocabulary.join(F.broadcast(sizes), F.length("word") >= F.col("size")).select("word", F.explode(parts(F.col("size"))).alias("term"))
    return terms.select("term").join(held, "term").select("term", "word")


def holding_many(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc_id) of the docs (doc_id, text) that hold terms (term); a pair may come more than once."""
    wanted = checkpointed(matched_words(terms, words(docs).select("word").distinct()))
    return wanted.join(words(docs), "word").select("term", "doc_id")


def holding_few(terms: list[str], docs: DataFrame) -> DataFrame:
    """holding_many for terms that fit in a task: the texts are read once and only what holds a term leaves them."""
    shared, sizes = docs.sparkSession.sparkContext.broadcast(frozenset(terms)), sorted({len(t) for t in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, cut = shared.value, re.compile(_WORD)
        long = lambda word: tuple({part for n in sizes for i in range(len(word) - n + 1) if (part := word[i : i + n]) in wanted})
        short = lru_cache(KEPT)(long)
        for batch in batches:
            held, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):  # one text at a time
                found = {t for w in set(cut.findall(text.as_py())) for t in (short if len(w) <= CACHED else long)(w)}
                held += found
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(ids, pa.int64())], names=["term", "doc_id"])

    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return texts.mapInArrow(run, "term string, doc_id long")


def slices(docs: DataFrame) -> list[tuple[int, int]]:
    """(lower, upper) of ranges of doc_id, newest first, that hold all documents: about FIRST, and GROWTH times as many each time."""
    ids = docs.filter("doc_id is not null")
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    shares, size, taken = [], FIRST, FIRST
    while taken < n:
        shares.append(1 - taken / n)
        size *= GROWTH
        taken += size
    # Any border is right that parts no block.
    borders = ids.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] if shares else []
    lowers = [b for b in sorted({int(b) // BLOCK * BLOCK for b in borders}, reverse=True) if low < b <= high]
    return list(zip([*lowers, low], [high, *(b - 1 for b in lowers)])) if n else []


def newest_documents(questions: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """(question_id, doc_id, hits): the k documents of largest doc_id that hold any term of a question, and how many each holds.

    questions: question_id, text. Questions without a term, null or empty ones have no documents; rows of one question_id are
    one question. Empty tables give no rows.
    """
    asked = checkpointed(questions.select("question_id", F.explode(query_terms(F.col("text"))).alias("term")).distinct())
    open_, held, rounds = asked.withColumn("have", F.lit(0).cast("long")), None, None
    # Of a term's documents in a slice only the newest k can be among a question's.
    newest = Window.partitionBy("term").orderBy(F.desc("doc_id"))
    block, bit = F.floor(F.col("doc_id") / BLOCK).cast("long"), F.expr(f"shiftleft(1L, CAST(pmod(doc_id, {BLOCK}) AS INT))")
    both = lambda before, more: more if before is None else before.unionByName(more)
    for at, (lower, upper) in enumerate(slices(docs)):
        terms = open_.select("term").distinct()
        few = [r.term for r in terms.limit(FEW + 1).collect()]
        if not few:
            break
        part = docs.filter(F.col("doc_id").between(lower, upper))
        pairs = holding_few(few, part) if len(few) <= FEW else holding_many(terms, part)
        found = checkpointed(pairs.withColumn("n", F.dense_rank().over(newest)).filter(F.col("n") <= k).groupBy("term", block.alias("block")).agg(F.bit_or(bit).alias("bits")))
        held, rounds = both(held, found.withColumn("at", F.lit(at))), both(rounds, open_.select("question_id", "term", F.lit(at).alias("at")))
        each = open_.join(found, "term").groupBy("question_id", "block").agg(F.bit_or("bits").alias("bits"))
        more = each.groupBy(F.col("question_id").alias("of")).agg(F.sum(F.bit_count("bits")).alias("more"))
        have = F.col("have") + F.coalesce("more", F.lit(0))
        open_ = checkpointed(open_.join(more, F.col("question_id").eqNullSafe(F.col("of")), "left").select("question_id", "term", have.alias("have")).filter(F.col("have") < k))
    if held is None:
        return asked.select("question_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("hits")).limit(0)
    # A question meets only the rounds that it was open in, and blocks are opened where it stands, not where a common term does.
    offsets = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda o: F.getbit("bits", o) == 1).cast("array<tinyint>")
    met = rounds.join(held.select("term", "at", "block", offsets.alias("offsets")), ["term", "at"]).select("question_id", "block", "offsets").repartition("question_id")
    docs_of = met.select("question_id", "block", F.explode("offsets").alias("offset")).select("question_id", (F.col("block") * BLOCK + F.col("offset")).alias("doc_id"))
    hits = docs_of.groupBy("question_id", "doc_id").agg(F.count("*").cast("int").alias("hits"))
    own = Window.partitionBy("question_id").orderBy(F.desc("doc_id"))
    return hits.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k).drop("n")


def ranked_documents(questions: DataFrame, docs: DataFrame, candidates: int = 50, k: int = 8) -> DataFrame:
    """(question_id, place, doc_id, hits): of each question's newest candidates the k with most of its terms, ties by smaller doc_id."""
    best = Window.partitionBy("question_id").orderBy(F.desc("hits"), "doc_id")
    rows = newest_documents(questions, docs, candidates).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return rows.select("question_id", "place", "doc_id", "hits")
