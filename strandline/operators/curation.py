"""Curation as new versions of tables: deletes with cascades, merges, upserts, status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import checkpointed
from .claims import with_objects


def delete_document(document_ids: DataFrame, claims: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> dict[str, DataFrame]:
    """Tables after documents go: their evidence, then claims that lost all of it (only those), then their conflicts."""
    gone = evidence.join(document_ids, "document_id", "left_semi")
    kept_evidence = evidence.join(document_ids, "document_id", "left_anti")
    lost = gone.select("claim_id").distinct().join(kept_evidence, "claim_id", "left_anti")
    kept_claims = claims.join(lost, "claim_id", "left_anti")
    left = conflicts.join(lost.withColumnRenamed("claim_id", "claim_a"), "claim_a", "left_anti").join(lost.withColumnRenamed("claim_id", "claim_b"), "claim_b", "left_anti")
    return {"evidence": kept_evidence, "claims": kept_claims, "conflicts": left, "lost_claims": lost}


def delete_source(source_id: str, fetches: DataFrame, links: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Effect of deleting a source: rows that go from each table, documents that shared links keep alive, swept claims."""
    own = fetches.filter(F.col("source_id") == source_id).select("fetch_id")
    cut_links = links.join(own, "fetch_id", "left_semi")
    left = links.join(own, "fetch_id", "left_anti")
    touched = cut_links.select("document_id").distinct()
    orphans = touched.join(left, "document_id", "left_anti")
    kept_evidence = evidence.filter(F.col("source_id") != source_id)
    swept = claims.join(kept_evidence, "claim_id", "left_anti")
    parts = {"fetches": own, "links": cut_links, "orphan_documents": orphans, "kept_documents": touched.join(left, "document_id", "left_semi"), "swept_claims": swept}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def repoint_first_seen(documents: DataFrame, links: DataFrame, removed: DataFrame) -> DataFrame:
    """The least remaining fetch of documents whose links were cut but that others still hold."""
    touched = links.join(removed, "fetch_id", "left_semi").select("document_id").distinct()
    left = links.join(removed, "fetch_id", "left_anti").groupBy("document_id").agg(F.min("fetch_id").alias("first_fetch_id"))
    return documents.select("document_id").join(touched, "document_id", "left_semi").join(left, "document_id")


def merge_entities(claims: DataFrame, merges: DataFrame) -> DataFrame:
    """Claims re-pointed from merged entities to their targets; self-loops stay as they are."""
    a = merges.select(F.col("entity_id").alias("subject_id"), F.col("target_id").alias("s2"))
    b = merges.select(F.col("entity_id").alias("object_id"), F.col("target_id").alias("o2"))
    moved = with_objects(claims.join(a, "subject_id", "left"), b)
    return moved.select("claim_id", F.coalesce("s2", "subject_id").alias("subject_id"), "predicate", F.coalesce("o2", "object_id").alias("object_id"))


def merge_aliases(aliases: DataFrame, entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases after a merge: the target gains the merged names and aliases, one a folded spelling."""
    names = merges.join(entities, "entity_id").select(F.col("target_id").alias("entity_id"), F.col("name").alias("alias"))
    moved = aliases.join(merges, "entity_id", "left").select(F.coalesce("target_id", "entity_id").alias("entity_id"), "alias")
    both = moved.unionByName(names).withColumn("key", F.lower(F.trim(F.regexp_replace("alias", r"\s+", " "))))
    return both.groupBy("entity_id", "key").agg(F.min("alias").alias("alias")).drop("key")


def unreferenced(entities: DataFrame, claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities that no claim and no alias refers to: stacked anti-joins."""
    return entities.join(claims.select(F.col("subject_id").alias("entity_id")), "entity_id", "left_anti").join(claims.select(F.col("object_id").alias("entity_id")).filter("entity_id is not null"), "entity_id", "left_anti").join(aliases, "entity_id", "left_anti")


def source_deleted(source_id: str, fetches: DataFrame, links: DataFrame, documents: DataFrame, raws: DataFrame, claims: DataFrame, evidence: DataFrame, conflicts: DataFrame, entities: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Every table after a source goes. Its fetches and their links go; a document that no other fetch holds goes with its raw
    claims; one that others hold is first seen by the least of them. Evidence of the source or of a raw claim that went is no
    more; claims without any evidence, their conflicts and entities that nothing refers to are swept, all of them and not only
    this source's. documents: document_id, first_fetch_id."""
    own = fetches.filter(F.col("source_id") == source_id).select("fetch_id")
    left = links.join(own, "fetch_id", "left_anti")
    touched = links.join(own, "fetch_id", "left_semi").select("document_id").distinct()
    gone = checkpointed(touched.join(left, "document_id", "left_anti"))
    first = left.join(touched, "document_id", "left_semi").groupBy("document_id").agg(F.min("fetch_id").alias("__first"))
    moved = documents.join(gone, "document_id", "left_anti").join(first, "document_id", "left")
    lost_raws = raws.join(gone, "document_id", "left_semi").select("raw_id")
    kept_evidence = evidence.filter(~F.col("source_id").eqNullSafe(source_id)).join(lost_raws, "raw_id", "left_anti")
    kept_claims = checkpointed(claims.join(kept_evidence.select("claim_id"), "claim_id", "left_semi"))
    ids = kept_claims.select("claim_id")
    kept_conflicts = conflicts.join(ids.withColumnRenamed("claim_id", "claim_a"), "claim_a", "left_semi").join(ids.withColumnRenamed("claim_id", "claim_b"), "claim_b", "left_semi")
    used = kept_claims.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).unionByName(aliases.select("entity_id"))
    return {
        "fetches": fetches.join(own, "fetch_id", "left_anti"),
        "links": left,
        "documents": moved.withColumn("first_fetch_id", F.coalesce("__first", "first_fetch_id")).drop("__first"),
        "raws": raws.join(gone, "document_id", "left_anti"),
        "evidence": kept_evidence,
        "claims": kept_claims,
        "conflicts": kept_conflicts,
        "entities": entities.join(used, "entity_id", "left_semi"),
    }


def resolved_merges(merges: DataFrame) -> DataFrame:
    """(entity_id, target_id) with chains followed to their end, by pointer doubling: rounds grow with the log of the longest
    chain. An entity of several merges takes the least target. Entities on a circle, or that lead into one, are not merged."""
    now = checkpointed(merges.filter("entity_id is not null and target_id is not null and entity_id <> target_id").groupBy("entity_id").agg(F.min("target_id").alias("target_id")))
    count, steps = now.count(), 1
    while steps <= count:
        ahead = now.select(F.col("entity_id").alias("target_id"), F.col("target_id").alias("__next"))
        hop = checkpointed(now.join(ahead, "target_id", "left").select("entity_id", F.coalesce("__next", "target_id").alias("target_id"), F.col("__next").isNotNull().alias("__moved")))
        moved = hop.filter("__moved").limit(1).count()
        now, steps = hop.drop("__moved"), 2 * steps
        if not moved:
            return now
    return now.join(now.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").select("entity_id", "target_id")


def entities_merged(entities: DataFrame, aliases: DataFrame, claims: DataFrame, mentions: DataFrame, neighborhoods: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """Every table after identities are merged: merged entities point to the end of their chain, targets count as verified,
    aliases, claims and mentions move, and the neighbourhoods of all of them are dropped, to be made anew. entities gains
    status, merged_into and verified."""
    final = checkpointed(resolved_merges(merges).join(entities.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi"))
    targets = final.select(F.col("target_id").alias("entity_id"), F.lit(True).alias("verified")).distinct()
    after = entities.join(final, "entity_id", "left").join(targets, "entity_id", "left")
    touched = final.select("entity_id").unionByName(targets.select("entity_id"))
    kept = neighborhoods.join(touched, "entity_id", "left_anti").join(touched.withColumnRenamed("entity_id", "neighbor_id"), "neighbor_id", "left_anti")
    return {
        "entities": after.withColumn("status", F.when(F.col("target_id").isNotNull(), "merged").otherwise("active")).withColumn("verified", F.coalesce("verified", F.lit(False))).withColumnRenamed("target_id", "merged_into"),
        "aliases": merge_aliases(aliases, entities, final),
        "claims": merge_entities(claims, final),
        "mentions": mentions.join(final, "entity_id", "left").withColumn("entity_id", F.coalesce("target_id", "entity_id")).drop("target_id"),
        "neighborhoods": kept,
    }


def sources_merged(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_id, survivor_id, identifier, runs) of sources (source_id, kind, identifier, created_at): what shares a normalised
    identifier becomes one source, that of most runs, then the oldest, then of least id. Sources without an identifier are
    left out. The best of a group is an aggregate, so no task holds a group."""
    counted = runs.groupBy("source_id").agg(F.count("*").alias("runs"))
    named = sources.withColumn("identifier", F.nullif(scalars.identifier(F.col("kind"), F.col("identifier")), F.lit(""))).filter("identifier is not null").join(counted, "source_id", "left").fillna(0, ["runs"])
    best = named.groupBy("identifier").agg(F.min(F.struct((-F.col("runs")).alias("r"), "created_at", "source_id"))["source_id"].alias("survivor_id"))
    return named.join(best, "identifier").select("source_id", "survivor_id", "identifier", "runs")


def survivors(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Of sources that share a normalised name (here its length) the one to keep: most runs, then least id."""
    counted = sources.join(runs.groupBy("source_id").agg(F.count("*").alias("runs")), "source_id", "left").fillna(0, ["runs"])
    w = Window.partitionBy(F.length("identifier")).orderBy(F.desc("runs"), "source_id")
    return counted.withColumn("n", F.row_number().over(w)).select("source_id", "runs", (F.col("n") == 1).alias("survives"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's non-null fields over it, and new's own rows."""
    columns = [c for c in old.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    return old.join(renamed, key, "full_outer").select(key, *[F.coalesce(f"__new_{c}", c).alias(c) for c in columns])


def supersede(runs: DataFrame) -> DataFrame:
    """Stopped runs that a later run of the same source and kind replaces become superseded.

    A later one exists unless the run is the newest; the newest of each group is a small table, and no group is one task.
    """
    newest = runs.groupBy(F.col("source_id").alias("__s"), F.col("kind").alias("__k")).agg(F.max(F.struct("started_at", "run_id")).alias("__newest"))
    rows = runs.join(newest, F.col("source_id").eqNullSafe(F.col("__s")) & F.col("kind").eqNullSafe(F.col("__k")))
    later = F.struct("started_at", "run_id") < F.col("__newest")
    return rows.select("run_id", "source_id", "kind", F.when((F.col("status") == "stopped") & later, "superseded").otherwise(F.col("status")).alias("status"))


def capped_log(rows: DataFrame, keep: int) -> DataFrame:
    """The log after compaction: what a NOT IN of the newest ids would delete is gone."""
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(keep)


def summed(parts: list[DataFrame], key: str) -> DataFrame:
    """Per-source summaries added up by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("n").alias("n"))


def status_from_notes(sources: DataFrame) -> DataFrame:
    """Back-fill of a status column from free notes, by CASE, LIKE and SUBSTR."""
    notes = F.concat(F.lit("status:"), F.col("status"), F.lit("; rest"))
    status = F.when(notes.like("status:archived%"), F.substring(notes, 8, 8)).otherwise(F.nullif(F.lit(""), F.lit("")))
    return sources.select("source_id", F.coalesce(status, F.lit("active")).alias("status"))
