"""Coverage of sources: what was fetched, parsed and claimed, per source and in all.

Each measure is its own grouped frame, joined onto the list of sources, so no measure fans another out. Joins go from
facts to their dimension by equality; conflicts are exploded into their two claims instead of joined by an OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import provenance

PENDING_CAP = 10_000


def succeeded(status: str = "http_status") -> Column:
    return F.col(status).between(200, 299)


def has_content() -> Column:
    return F.col("body").isNotNull() | F.col("body_unchanged_since").isNotNull()


def pages_fetched(fetches: DataFrame) -> DataFrame:
    return fetches.filter(succeeded() & has_content()).groupBy("source_id").agg(F.countDistinct("url").alias("pages_fetched"))


def urls_known(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy("source_id").agg(F.countDistinct("url").alias("urls_known"))


def documents_per_source(fetches: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(fetches.select("fetch_id", "source_id"), "fetch_id").groupBy("source_id").agg(F.countDistinct("document_id").alias("documents"))


def claims_per_source(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("source_id").agg(F.countDistinct("claim_id").alias("claims"))


def entities_per_source(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    ends = claims.select("claim_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).filter("entity_id is not null")
    return evidence.select("source_id", "claim_id").join(ends, "claim_id").groupBy("source_id").agg(F.countDistinct("entity_id").alias("entities"))


def pending(fetches: DataFrame, links: DataFrame, snapshot: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Fetches that wait for parsing: successful, with a body, changed, not skipped, not linked, seen at the snapshot.

    ids: only these. `in_order` sorts them; counts need no order.
    """
    rows = fetches.filter(succeeded() & F.col("body").isNotNull() & F.col("body_unchanged_since").isNull() & F.col("parse_skip_reason").isNull())
    if snapshot is not None:
        rows = rows.filter(F.col("fetched_at") <= snapshot)
    if ids is not None:
        rows = rows.join(ids.select("fetch_id"), "fetch_id", "left_semi")
    return rows.join(links, "fetch_id", "left_anti")


def in_order(fetches: DataFrame) -> DataFrame:
    """Oldest first, ties by id: the order in which pending fetches are parsed."""
    return fetches.orderBy("fetched_at", "fetch_id")


def pending_counts(fetches: DataFrame, links: DataFrame, cap: int = PENDING_CAP) -> DataFrame:
    return pending(fetches, links).groupBy("source_id").agg(F.least(F.count("*"), F.lit(cap)).alias("pending"))


def conflict_ends(conflicts: DataFrame) -> DataFrame:
    return conflicts.select("conflict_id", "resolution", F.explode(F.array("claim_a", "claim_b")).alias("claim_id"))


def conflicts_per_source(conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    held = evidence.select("source_id", "claim_id").distinct()
    return conflict_ends(conflicts).join(held, "claim_id").groupBy("source_id").agg(F.countDistinct("conflict_id").alias("conflicts"))


def coverage(sources: DataFrame, *measures: DataFrame) -> DataFrame:
    """Every measure on every source, 0 where it has none; urls_known is never below pages_fetched."""
    out = sources.select("source_id")
    for m in measures:
        out = out.join(m, "source_id", "left")
    out = out.fillna(0)
    if {"urls_known", "pages_fetched"} <= set(out.columns):
        out = out.withColumn("urls_known", F.greatest("urls_known", "pages_fetched"))
    return out


def pages_and_urls(fetches: DataFrame) -> DataFrame:
    """pages_fetched and urls_known in one pass: each (source, url) once, with whether any fetch of it succeeded."""
    urls = fetches.filter("url is not null").groupBy("source_id", "url").agg(F.bool_or(succeeded() & has_content()).alias("ok"))
    return urls.groupBy("source_id").agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("pages_fetched"), F.count("*").alias("urls_known"))


def full_coverage(sources: DataFrame, fetches: DataFrame, links: DataFrame, documents: DataFrame, fetch_runs: DataFrame, evidence: DataFrame, raws: DataFrame, mentions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """All seven measures of every source, claims, entities and conflicts by the whole provenance chain.

    What several measures need is made once and written: the links, the distinct (document, source) pairs behind them and
    the distinct (source, claim) pairs.
    """
    links = checkpointed(links.select("document_id", "fetch_id"))
    behind = checkpointed(provenance.document_sources(documents, links, fetches, fetch_runs))
    held = checkpointed(provenance.source_claims(evidence, raws, behind))
    claims = held.groupBy("source_id").agg(F.count("*").alias("claims"))
    disputed = conflict_ends(conflicts).join(held, "claim_id").groupBy("source_id").agg(F.countDistinct("conflict_id").alias("conflicts"))
    return coverage(sources, pages_and_urls(fetches), documents_per_source(fetches, links), claims, provenance.entities_per_source(mentions, raws, behind), pending_counts(fetches, links), disputed)


def totals(covered: DataFrame, sources: DataFrame) -> DataFrame:
    """Sums over sources that are not archived: what sources share counts once a source."""
    live = covered.join(sources.filter("status <> 'archived'").select("source_id"), "source_id", "left_semi")
    return live.agg(F.count("*").alias("sources"), *[F.sum(c).cast("long").alias(f"{c}_sum") for c in covered.columns if c != "source_id"])


def counter_drift(stored: DataFrame, covered: DataFrame) -> DataFrame:
    """Stored counters (source_id, pages, urls) less the canonical ones."""
    return stored.join(covered, "source_id").select("source_id", (F.col("pages") - F.col("pages_fetched")).alias("pages_drift"), (F.col("urls") - F.col("urls_known")).alias("urls_drift"))


def document_fetch_order(fetches: DataFrame, source_id: str, ids: DataFrame | None = None, snapshot: int | None = None) -> DataFrame:
    """All fetches of a source that have a body, oldest first, optionally of given ids and up to a snapshot."""
    rows = fetches.filter((F.col("source_id") == source_id) & F.col("body").isNotNull())
    if snapshot is not None:
        rows = rows.filter(F.col("fetched_at") <= snapshot)
    if ids is not None:
        rows = rows.join(ids, "fetch_id", "left_semi")
    return rows.orderBy("fetched_at", "fetch_id")
