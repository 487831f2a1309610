"""Question answering up to the generated text: candidates by terms and vectors, ranked, with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, query_terms


def lexical(docs: DataFrame, question: str, candidates: int = 50) -> DataFrame:
    """The newest documents that hold any of the question's terms, with how many of them each holds."""
    terms = query_terms(F.lit(question))
    low = F.lower("text")
    hits = F.size(F.filter(terms, lambda t: low.contains(t)))
    return docs.select("doc_id", "text", hits.alias("hits")).filter("hits > 0").orderBy(F.desc("doc_id")).limit(candidates)


def lexical_rank(docs: DataFrame, question: str, k: int = 8) -> DataFrame:
    return lexical(docs, question).select("doc_id", "hits").orderBy(F.desc("hits"), "doc_id").limit(k)


def _scored(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every vector with its largest cosine to any of the queries, a few variants of one question."""
    wanted = queries.agg(F.collect_list("embedding").alias("wanted"))  # one row
    best = F.coalesce(F.array_max(F.transform("wanted", lambda q: cosine(F.col("embedding"), q))), F.lit(0.0))
    return vectors.join(F.broadcast(wanted)).select("vec_id", F.round(best, 6).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """The k vectors of largest cosine."""
    return _scored(vectors, queries).orderBy(F.desc("score"), "vec_id").limit(k)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, question: str, k: int = 8, fallback: int = 1000) -> DataFrame:
    """Lexical candidates ranked by hits, then by cosine of their vectors; without one, the first documents by cosine alone."""
    cand = lexical(docs, question).select("doc_id", "hits")
    found = cand.agg(F.count("*").alias("found"))  # one row
    others = docs.select("doc_id").orderBy("doc_id").limit(fallback).join(F.broadcast(found)).filter("found = 0").select("doc_id", F.lit(0).alias("hits"))
    scored = _scored(vectors, queries).withColumnRenamed("vec_id", "doc_id")
    return cand.unionByName(others).join(scored, "doc_id", "left").fillna(0.0, ["score"]).orderBy(F.desc("hits"), F.desc("score"), "doc_id").limit(k)


def latest_fetch(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """Each document's newest fetch and its source."""
    return links.join(fetches.select("fetch_id", "source_id", "url", "fetched_at"), "fetch_id").groupBy("document_id").agg(F.max(F.struct("fetched_at", "fetch_id", "source_id", "url")).alias("f")).select("document_id", "f.fetch_id", "f.source_id", "f.url")


def citations(rows: DataFrame, cap: int = 8) -> DataFrame:
    """One citation a url, the lowest document of each, up to a cap."""
    w = Window.partitionBy("url").orderBy("document_id")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").orderBy("url").limit(cap)


def history(turns: DataFrame, keep: int = 6, longest: int = 4000, longest_answer: int = 12000) -> DataFrame:
    """The last turns of each conversation that say something, clipped; answers keep more."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    rows = turns.filter(F.trim("text") != "").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)
    return rows.select("conv_id", "turn", "role", F.left("text", F.when(F.col("role") == "assistant", longest_answer).otherwise(longest)).alias("text"))
