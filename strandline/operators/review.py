"""Identity review: the queue, its rows, automatic and human decisions, and entity records around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .claims import with_objects
from .names import valid_name

#: Predicates that tell entities apart.
QUALIFYING = ("class_year", "affiliated_with", "employed_by", "located_in", "founded", "worked_on_project")


def queue(candidates: DataFrame, mentions: DataFrame, entities: DataFrame, which: str = "pending", low_signal: bool = False) -> DataFrame:
    """Candidates to review: pending, all, or those of one decision; low_signal: only mentions of flagged entities."""
    rows = candidates
    if which == "pending":
        rows = rows.filter("review_decision is null")
    elif which != "all":
        rows = rows.filter(F.col("review_decision") == which)
    if low_signal:
        flagged = mentions.join(entities.filter("needs_review").select("entity_id"), "entity_id", "left_semi").select("mention_id")
        rows = rows.join(flagged, "mention_id", "left_semi")
    return rows


def ordered(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("score"), F.desc("created_at"), "candidate_id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after decisions (candidate_id, decision): confirm is recorded as split, a second decision is refused."""
    rows = candidates.join(decisions, "candidate_id", "left")
    again = F.col("review_decision").isNotNull() & F.col("decision").isNotNull()
    new = F.when(F.col("decision") == "confirm", "split").otherwise(F.col("decision"))
    return rows.select("candidate_id", F.coalesce("review_decision", new).alias("review_decision"), again.alias("refused"))


def auto_split(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Pending candidates whose person has no possible name: they are split, by no one's hand."""
    bad = entities.filter((F.col("kind") == "person") & ~valid_name(F.col("name"), F.lit("person"))).select(F.col("entity_id").alias("candidate_entity_id"), F.col("name").alias("candidate_name"))
    return candidates.filter("review_decision is null").join(bad, "candidate_entity_id").select("candidate_id", "candidate_entity_id", "candidate_name", F.lit("split").alias("review_decision"), F.lit("auto").alias("reviewed_by"))


def qualifiers(summaries: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, predicate, values): distinct values in order of claim, after those the summary already has.

    A summary's attribute is one value or a list in JSON, held as an array of strings.
    """
    named = with_objects(claims.filter(F.col("predicate").isin(*QUALIFYING)), entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name")))
    own = named.select(F.col("subject_id").alias("entity_id"), "predicate", F.coalesce("object_name", "object_value").alias("value"), "claim_id").filter("value is not null")
    listed = own.groupBy("entity_id", "predicate").agg(F.array_sort(F.collect_list(F.struct("claim_id", "value"))).alias("rows")).select("entity_id", "predicate", F.transform("rows", lambda r: r["value"]).alias("found"))
    both = summaries.join(listed, ["entity_id", "predicate"], "full_outer")
    empty = F.array().cast("array<string>")
    return both.select("entity_id", "predicate", F.array_distinct(F.concat(F.coalesce("seed", empty), F.coalesce("found", empty))).alias("values"))


def rows_of(queued: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Queue rows with both entities; without a mention's entity the candidate itself stands in if it is flagged."""
    spoken = mentions.select("mention_id", F.col("entity_id").alias("spoken_id"))
    flagged = entities.select(F.col("entity_id").alias("candidate_entity_id"), F.col("name").alias("candidate_name"), "needs_review")
    rows = queued.join(spoken, "mention_id", "left").join(flagged, "candidate_entity_id", "left")
    source = F.coalesce("spoken_id", F.when(F.col("needs_review"), F.col("candidate_entity_id")))
    named = entities.select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("source_name"))
    return rows.withColumn("source_entity_id", source).join(named, "source_entity_id", "left").select("candidate_id", "candidate_entity_id", "candidate_name", "source_entity_id", "source_name")


def top_claims(claims: DataFrame, entities: DataFrame, evidence: DataFrame, raws: DataFrame, documents: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """(entity_id, place, claim_id, object_name, raw_id, document_id, source_name): the first k rows of each entity's claims, at
    either end, with the object, evidence, raw claim, document and source behind them as far as they exist; newest claims first.

    Several pieces of evidence are several rows. The first k rows come from the k newest claims, so only these meet the chain.
    Claims may share an id: then the raw claims order their rows together, and what is still equal goes by the object's id.
    """
    ends = claims.select("claim_id", "first_seen_at", "object_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id")).filter("entity_id is not null")
    newest = Window.partitionBy("entity_id").orderBy(F.desc("first_seen_at"), "claim_id")
    near = ends.withColumn("n", F.rank().over(newest)).filter(F.col("n") <= k)
    chain = with_objects(near, entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"))).join(evidence.select("claim_id", "raw_id", "source_id"), "claim_id", "left")
    chain = chain.join(raws.select("raw_id", "document_id"), "raw_id", "left").join(documents.select("document_id", F.lit(True).alias("there")), "document_id", "left").join(sources.select("source_id", F.col("identifier").alias("source_name")), "source_id", "left")
    rows = Window.partitionBy("entity_id").orderBy("n", F.asc_nulls_last("raw_id"), F.asc_nulls_last("source_id"), F.desc("object_id"))
    placed = chain.withColumn("place", F.row_number().over(rows)).filter(F.col("place") <= k)
    return placed.select("entity_id", "place", "claim_id", "object_name", "raw_id", F.when(F.col("there"), F.col("document_id")).alias("document_id"), "source_name")
