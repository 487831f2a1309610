"""From a claim or an entity to the sources behind it: evidence, raw claim, document, link, fetch, run.

The link between documents and fetches is many to many. It is reduced to distinct (document, source) pairs before the
facts meet it, so a document that was fetched a thousand times does not multiply its claims by a thousand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_sources(documents: DataFrame, links: DataFrame, fetches: DataFrame, fetch_runs: DataFrame) -> DataFrame:
    """Distinct (document_id, source_id) of all fetches a document is linked to."""
    pairs = links.join(fetches.select("fetch_id", "run_id"), "fetch_id").join(fetch_runs.select("run_id", "source_id"), "run_id").select("document_id", "source_id").distinct()
    return pairs.join(documents.select("document_id"), "document_id", "left_semi")


def source_claims(evidence: DataFrame, raws: DataFrame, behind: DataFrame) -> DataFrame:
    """Distinct (source_id, claim_id) through the whole chain; behind: document_sources."""
    held = evidence.select("claim_id", "raw_id").distinct().join(raws.select("raw_id", "document_id"), "raw_id").select("claim_id", "document_id").distinct()
    return held.join(behind, "document_id").select("source_id", "claim_id").distinct()


def claims_per_source(evidence: DataFrame, raws: DataFrame, behind: DataFrame) -> DataFrame:
    return source_claims(evidence, raws, behind).groupBy("source_id").agg(F.count("*").alias("claims"))


def entities_per_source(mentions: DataFrame, raws: DataFrame, behind: DataFrame) -> DataFrame:
    """Distinct mentioned entities of each source through the whole chain."""
    held = mentions.select("entity_id", "raw_id").distinct().join(raws.select("raw_id", "document_id"), "raw_id").select("entity_id", "document_id").distinct()
    return held.join(behind, "document_id").groupBy("source_id").agg(F.countDistinct("entity_id").alias("entities"))


def raw_origins(raws: DataFrame, documents: DataFrame, fetches: DataFrame, fetch_runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw claims with their document, its first fetch, that one's run and source; each may be missing."""
    first = documents.select("document_id", F.col("document_id").alias("fetch_id"), F.lit(True).alias("known"))
    out = raws.drop("source_id").join(first, "document_id", "left").join(fetches.select("fetch_id", "run_id", "url", "fetched_at"), "fetch_id", "left")
    return out.join(fetch_runs.select("run_id", "source_id"), "run_id", "left").join(sources.select("source_id", F.col("identifier").alias("source_name")), "source_id", "left")


def claim_backing(evidence: DataFrame, raws: DataFrame, documents: DataFrame, links: DataFrame, fetches: DataFrame, fetch_runs: DataFrame) -> DataFrame:
    """Evidence whose document was fetched by a run of the very source it is filed under, once a (claim, source, raw, document).

    The newest such fetch stands for the document.
    """
    runs = fetch_runs.select("run_id", "source_id")
    seen = links.join(fetches.select("fetch_id", "run_id", "url", "fetched_at"), "fetch_id").join(runs, "run_id").groupBy("document_id", "source_id").agg(F.max(F.struct("fetched_at", "fetch_id", "url")).alias("f"))
    rows = evidence.select("claim_id", "raw_id", "source_id", "added_at").join(raws.select("raw_id", "document_id"), "raw_id").join(documents.select("document_id"), "document_id", "left_semi")
    newest = rows.groupBy("claim_id", "source_id", "raw_id", "document_id").agg(F.max("added_at").alias("added_at"))
    return newest.join(seen, ["document_id", "source_id"]).select("claim_id", "source_id", "raw_id", "document_id", "f.fetch_id", "f.url", "added_at")


def first_seen_documents(evidence: DataFrame, raws: DataFrame, documents: DataFrame, fetches: DataFrame, k: int = 3) -> DataFrame:
    """The k newest distinct documents of each claim with the URL of the fetch that first saw them."""
    rows = evidence.select("claim_id", "raw_id", "source_id", "added_at").join(raws.select("raw_id", "document_id"), "raw_id").join(documents.select("document_id"), "document_id", "left_semi")
    once = rows.groupBy("claim_id", "document_id").agg(F.max(F.struct("added_at", "source_id")).alias("e"))
    rank = Window.partitionBy("claim_id").orderBy(F.desc("e.added_at"), "document_id")
    top = once.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return top.join(fetches.select(F.col("fetch_id").alias("document_id"), "url"), "document_id").select("claim_id", "document_id", "e.source_id", "url", "rank")


def latest_by_url(evidence: DataFrame, raws: DataFrame, links: DataFrame, fetches: DataFrame) -> DataFrame:
    """Documents and URLs behind the evidence of a claim with their newest fetch, unfetched ones last."""
    docs = evidence.join(raws.select("raw_id", F.col("document_id").alias("d")), "raw_id").select(F.col("d").alias("document_id")).distinct()
    seen = links.join(fetches.select("fetch_id", "url", "fetched_at"), "fetch_id")
    return docs.join(seen, "document_id", "left").groupBy("document_id", "url").agg(F.max("fetched_at").alias("newest")).orderBy(F.desc_nulls_last("newest"), "document_id", "url")
