"""Sinks and upkeep as new versions of tables: get-or-create, run updates, audits, counters, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import coverage, integrity, runs


def with_hashes(fetches: DataFrame) -> DataFrame:
    """Fetches with the content hash filled in where a body has none."""
    return fetches.withColumn("content_hash", F.coalesce("content_hash", F.sha2("body", 256)))


def created_documents(known: DataFrame, new: DataFrame) -> DataFrame:
    """(content_hash, document_id, created): for each new hash the document that has it, or a created one.

    known: content_hash, document_id; new: content_hash and a candidate document_id, of which the least wins.
    """
    wanted = new.groupBy("content_hash").agg(F.min("document_id").alias("fresh"))
    return wanted.join(known.select("content_hash", "document_id"), "content_hash", "left").select("content_hash", F.coalesce("document_id", "fresh").alias("document_id"), F.col("document_id").isNull().alias("created"))


def merged_spec(old: Column, new: Column) -> Column:
    """Two JSON objects of strings as one; the new one's keys win."""
    kind = "map<string,string>"
    a, b = F.coalesce(F.from_json(old, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(new, kind), F.create_map().cast(kind))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)))))


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run from its log of partial updates: of every field the last value that was given.

    events: run_id, seq, status, error, stats; null fields are not updates.
    """
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    return events.groupBy("run_id").agg(last("status"), last("error"), last("stats"), F.max("seq").alias("updates"))


def audit(rows: DataFrame, action: str, table: str, target: str, *payload: str) -> DataFrame:
    """Audit rows (action, target_table, target_id, payload) of what was done to rows."""
    return rows.select(F.lit(action).alias("action"), F.lit(table).alias("target_table"), F.col(target).cast("string").alias("target_id"), F.to_json(F.struct(*payload) if payload else F.struct(F.lit(1).alias("n"))).alias("payload"))


def quarantined(fetches: DataFrame, runs_known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written, refused): fetches that satisfy the table's constraints, and the others with the reason."""
    known = runs_known.select("run_id", F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("known").isNull(), "unknown_run").when(F.col("url").isNull(), "missing_url").when(~F.col("http_status").between(100, 599), "bad_status")
    checked = fetches.join(known, "run_id", "left").withColumn("reason", reason).drop("known")
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str], refreshed: list[str]) -> DataFrame:
    """old with new's values in the refreshed columns of rows it has, and the rows of new that it lacks."""
    fresh = new.dropDuplicates(keys)
    patch = fresh.select(*keys, *[F.col(c).alias(f"__{c}") for c in refreshed])
    kept = old.join(patch, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in refreshed else F.col(c) for c in old.columns])
    return kept.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def counters(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """Canonical counters of every source: pages fetched, and URLs known, which are never fewer."""
    return coverage.coverage(sources, coverage.pages_fetched(fetches), coverage.urls_known(fetches))


def reconciled_counters(stored: DataFrame, sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """stored (source_id, pages, urls) with canonical values; corrected if a stored one differs from what was counted."""
    raw = sources.select("source_id").join(coverage.pages_fetched(fetches), "source_id", "left").join(coverage.urls_known(fetches), "source_id", "left").fillna(0)
    rows = stored.join(raw, "source_id")
    wrong = (F.coalesce("pages", F.lit(0)) != F.col("pages_fetched")) | (F.coalesce("urls", F.lit(0)) != F.col("urls_known"))
    return rows.select("source_id", F.when(wrong, F.col("pages_fetched")).otherwise(F.col("pages")).alias("pages"), F.when(wrong, F.greatest("urls_known", "pages_fetched")).otherwise(F.col("urls")).alias("urls"), wrong.alias("corrected"))


def reconcile(sources: DataFrame, stored: DataFrame, run_rows: DataFrame, fetches: DataFrame, links: DataFrame, documents: DataFrame, now: int) -> DataFrame:
    """One row of what upkeep finds: per-source measures are summed, checks of whole tables count once."""
    measures = {
        "sources": sources,
        "stale_runs_failed": runs.stale(run_rows, now).join(sources.select("source_id"), "source_id", "left_semi"),
        "dangling_links_deleted": integrity.dangling_links(links.distinct(), documents, fetches).select("document_id", "fetch_id").distinct(),
        "orphan_documents_flagged": integrity.orphan_documents(documents, links, now),
        "broken_body_chains": integrity.chain_status(fetches).filter("state = 'broken'"),
        "counters_corrected": reconciled_counters(stored, sources, fetches).filter("corrected"),
        "pending_parse_sources": coverage.pending_counts(fetches, links).join(sources.select("source_id"), "source_id", "left_semi"),
    }
    parts = [rows.agg(F.lit(name).alias("measure"), F.count("*").alias("n")) for name, rows in measures.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_links(links: DataFrame, documents: DataFrame, fetches: DataFrame) -> DataFrame:
    """links without the dangling ones."""
    return links.join(documents.select("document_id"), "document_id", "left_semi").join(fetches.select("fetch_id"), "fetch_id", "left_semi")
