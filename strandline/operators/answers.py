"""Materials of an answer: claims and documents for a question, citations without repeated URLs, class-year variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import checkpointed
from . import provenance, retrieval
from .scans import Kept, scan


def claims_for_question(claims: DataFrame, entities: DataFrame, evidence: DataFrame, raws: DataFrame, documents: DataFrame, terms: Column, k: int) -> DataFrame:
    """The k newest claims in which a term occurs: in either end's name, the value, a quote or the text of a document.

    Each place is searched on its own table before any join, and the hits meet as claim ids: no wide row is built and
    no text is joined. Repeats are dropped before the limit.
    """
    hit = lambda c: F.exists(terms, lambda t: F.contains(F.lower(F.col(c)), t))
    named = entities.filter(hit("name")).select("entity_id")
    texts = documents.filter(hit("text")).select("document_id")
    spoken = raws.filter(hit("quote")).select("raw_id").unionByName(raws.join(texts, "document_id", "left_semi").select("raw_id")).distinct()
    ids = claims.filter(hit("object_value")).select("claim_id")
    for end in ("subject_id", "object_id"):
        ids = ids.unionByName(claims.join(named.withColumnRenamed("entity_id", end), end, "left_semi").select("claim_id"))
    ids = ids.unionByName(evidence.join(spoken, "raw_id", "left_semi").select("claim_id")).distinct()
    return claims.join(ids, "claim_id", "left_semi").dropDuplicates(["claim_id"]).orderBy(F.desc("first_seen_at"), "claim_id").limit(k)


def document_citations(documents: DataFrame, latest: DataFrame, terms: Column, longest: int = 400) -> DataFrame:
    """(document_id, source_id, url, anchor, quote): each document's newest fetch and a snippet at the first term it holds."""
    held = F.filter(terms, lambda t: F.contains(F.lower(F.col("text")), t))
    rows = documents.withColumn("anchor", F.get(held, F.lit(0))).join(latest.select("document_id", "source_id", "url"), "document_id")
    return rows.select("document_id", "source_id", "url", "anchor", scalars.anchored_snippet(F.col("text"), F.col("anchor"), longest).alias("quote"))


def citations(claim_cites: DataFrame, document_cites: DataFrame, cap: int) -> DataFrame:
    """Claims' citations in order, then documents'; the first of each URL, up to the cap. Both have place and url."""
    both = claim_cites.withColumn("part", F.lit(0)).unionByName(document_cites.withColumn("part", F.lit(1)))
    w = Window.partitionBy("url").orderBy("part", "place", "document_id")
    once = both.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return once.orderBy("part", "place", "document_id").limit(cap)


def materials(question: str, claims: DataFrame, entities: DataFrame, evidence: DataFrame, raws: DataFrame, documents: DataFrame, rows: DataFrame, links: DataFrame, fetches: DataFrame, fetch_runs: DataFrame, vectors: DataFrame, variants: DataFrame, k: int = 30, cap: int = 20) -> DataFrame:
    """(part, place, id, url) of what an answer to one question rests on: `document`, its best documents by terms and vectors;
    `claim`, the k newest claims in which a term occurs; `citation`, `cap` documents by URL, those behind the claims in the
    claims' order first, then the best documents themselves.

    rows: document_rows; vectors: doc_id as vec_id with embedding; variants: the vectors of the question's spellings. A
    question without a term has neither claims nor lexical candidates. The ranks run over at most k rows each.
    """
    terms = scalars.query_terms(F.lit(question))
    best = retrieval.hybrid(documents, vectors, variants, question)
    doc_places = best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("score"), "doc_id")).alias("place"))
    found = claims_for_question(claims, entities, evidence, raws, documents.select(F.col("doc_id").alias("document_id"), "text"), terms, k)
    places = checkpointed(found.select("claim_id", F.row_number().over(Window.orderBy(F.desc("first_seen_at"), "claim_id")).alias("place")))
    own = F.broadcast(places)  # k rows
    behind = provenance.claim_backing(evidence.join(own, "claim_id", "left_semi"), raws, rows, links, fetches, fetch_runs)
    claim_cites = behind.join(own, "claim_id").select("place", "document_id", "url")
    newest = retrieval.latest_fetch(links, fetches)
    document_cites = newest.join(F.broadcast(doc_places), newest["document_id"] == doc_places["doc_id"]).select("place", "document_id", "url")
    cited = citations(claim_cites, document_cites, cap).select(F.lit("citation").alias("part"), F.row_number().over(Window.orderBy("part", "place", "document_id")).alias("place"), F.col("document_id").cast("long").alias("id"), "url")
    none = F.lit(None).cast("string").alias("url")
    listed = doc_places.select(F.lit("document").alias("part"), "place", F.col("doc_id").cast("long").alias("id"), none)
    said = places.select(F.lit("claim").alias("part"), "place", F.col("claim_id").cast("long").alias("id"), none)
    return listed.unionByName(said).unionByName(cited)


def year_variants(question: Column, school: str = "") -> Column:
    """The question and its spellings of every class year in it, in order, each once."""
    found = F.regexp_extract_all(question, F.lit(scalars.year_pattern(school)), F.lit(0))

    def spelled(surface: Column) -> Column:
        year = scalars.class_year(surface, school)
        short = F.concat(F.lit("T'"), F.lpad((year % 100).cast("string"), 2, "0"))
        long = F.concat(F.lit("class of "), year.cast("string"))
        put = lambda by: F.replace(question, surface, by)
        return F.filter(F.array(F.when(~F.contains(question, short), put(short)), F.when(~F.contains(F.lower(question), long), put(long)), F.when(year.isNotNull(), put(year.cast("string")))), lambda v: v.isNotNull())

    return F.array_distinct(F.concat(F.array(question), F.flatten(F.transform(found, spelled))))


def cached(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """(request_id, hit): whether a question was answered within the time an answer is kept, counted from when it was made.

    A miss makes a new answer, so whether a request hits depends on the one before: a scan over ranges, so that no task holds
    a question. A null key is a question of its own; at is not null.
    """
    rows = requests.select("key", "at", "request_id")
    return scan(rows, ["key"], ["at", "request_id"], [Kept("at", "hit", seconds)]).select("request_id", "hit")
