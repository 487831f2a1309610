"""Content identity over time: hash dedup, unchanged re-fetches, body chains, dangling rows, integrity roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .coverage import pending, succeeded


def content_documents(fetches: DataFrame) -> DataFrame:
    """One document a distinct body, first seen in its earliest fetch; how many fetches carry it."""
    hashed = fetches.filter("body is not null").select(F.sha2("body", 256).alias("content_hash"), "fetch_id", "fetched_at")
    return hashed.groupBy("content_hash").agg(F.min(F.struct("fetched_at", "fetch_id")).alias("first"), F.count("*").alias("fetches")).select("content_hash", F.col("first.fetch_id").alias("first_fetch_id"), F.col("first.fetched_at").alias("valid_from"), "fetches")


def new_hashes(fetches: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose hash is not known yet; fetches of known ones only gain a link."""
    return content_documents(fetches).join(known.select("content_hash"), "content_hash", "left_anti")


def unchanged_refetches(fetches: DataFrame) -> DataFrame:
    """For each successful fetch with a body the one before it of the same source and url, and whether the body is the same."""
    w = Window.partitionBy("source_id", "url").orderBy("fetched_at", "fetch_id")
    rows = fetches.filter(succeeded() & F.col("body").isNotNull()).select("fetch_id", "source_id", "url", "fetched_at", F.sha2("body", 256).alias("h"))
    seen = rows.select("fetch_id", F.lag("fetch_id").over(w).alias("previous_id"), F.lag("h").over(w).alias("ph"), "h")
    return seen.filter("previous_id is not null").select("fetch_id", "previous_id", (F.col("h") == F.col("ph")).alias("unchanged"))


def chain_status(fetches: DataFrame, cut=checkpointed) -> DataFrame:
    """(fetch_id, state) of fetches without a body but with a pointer: resolved if it leads to a body, else broken.

    Pointer doubling: after k rounds each row has jumped 2**k steps, so rounds grow with the logarithm of the longest
    chain. What is still under way after as many steps as there are pointers is in a cycle, hence broken.
    """
    state = F.when(F.col("body").isNotNull(), F.lit("resolved")).when(F.col("body_unchanged_since").isNull(), F.lit("broken"))
    hops = fetches.select("fetch_id", state.alias("state"), F.col("body_unchanged_since").alias("next"), (state.isNull()).alias("asked"))
    left, steps = hops.filter("asked").count(), 1
    bound = left
    while left and steps <= 2 * bound:
        target = hops.select(F.col("fetch_id").alias("next"), F.col("state").alias("s"), F.col("next").alias("n"))
        moved = hops.filter("state is null").join(target, "next", "left").select("fetch_id", F.when(F.col("s").isNull() & F.col("n").isNull(), F.lit("broken")).otherwise(F.col("s")).alias("state"), F.col("n").alias("next"), "asked")
        hops = cut(hops.filter("state is not null").union(moved))
        left, steps = hops.filter("state is null").count(), steps * 2
    return hops.filter("asked").select("fetch_id", F.coalesce("state", F.lit("broken")).alias("state"))


def dangling_links(links: DataFrame, documents: DataFrame, fetches: DataFrame) -> DataFrame:
    """Links whose document or fetch is gone: two anti-joins rather than one outer join with an OR."""
    lost = links.join(documents.select("document_id"), "document_id", "left_anti").select("document_id", "fetch_id", F.lit("document").alias("missing"))
    return lost.union(links.join(fetches.select("fetch_id"), "fetch_id", "left_anti").select("document_id", "fetch_id", F.lit("fetch").alias("missing")))


def orphan_documents(documents: DataFrame, links: DataFrame, now: int, days: int = 7) -> DataFrame:
    return documents.filter(F.col("valid_from") < now - days * 86400).join(links, "document_id", "left_anti")


def report(fetches: DataFrame, links: DataFrame, documents: DataFrame, chains: DataFrame) -> DataFrame:
    """One row of violations; ok if all are zero."""
    measures = {
        "missing_documents": pending(fetches, links),
        "dangling_links": dangling_links(links, documents, fetches),
        "broken_chains": chains.filter("state = 'broken'"),
    }
    out = None
    for name, rows in measures.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)  # single rows
    return out.withColumn("ok", sum((F.col(n) for n in measures), F.lit(0)) == 0)
