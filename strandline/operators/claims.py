"""Claim browsing: filters, joins to both endpoints, evidence and its sources, conflicts and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = ("employed_by", "founded", "has_title")


def by_status(claims: DataFrame, status: str) -> DataFrame:
    """current: open-ended; superseded: ended; all; anything else counts as current."""
    if status == "all":
        return claims
    return claims.filter(F.col("valid_to").isNotNull() if status == "superseded" else F.col("valid_to").isNull())


def contains_any(text: str, *columns: str, escape: bool = False) -> Column:
    """Case-insensitive substring over several columns. % and _ in text are wildcards unless escaped."""
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def with_endpoints(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims with their subject's and, where there is one, their object's name; claims without a subject row go."""
    subject = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject_name"), F.col("kind").alias("subject_kind"))
    target = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"))
    return with_objects(claims.join(subject, "subject_id"), target)


def with_objects(claims: DataFrame, target: DataFrame) -> DataFrame:
    """Claims with target's columns by object_id, a left join.

    Claims without an object match nothing. They are dealt by their own id: by a null key they would all meet in one task.
    """
    own = F.coalesce(F.col("object_id").cast("string"), F.col("claim_id").cast("string"))
    there = target.withColumnRenamed("object_id", "__object")
    same = (F.col("__dealt") == F.col("__object").cast("string")) & (F.col("object_id") == F.col("__object"))
    return claims.withColumn("__dealt", own).join(there, same, "left").drop("__dealt", "__object")


def of_source(claims: DataFrame, evidence: DataFrame, source_id: str) -> DataFrame:
    return claims.join(evidence.filter(F.col("source_id") == source_id), "claim_id", "left_semi")


def without_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    return claims.join(evidence, "claim_id", "left_anti")


def touching(claims: DataFrame, entity_id: str) -> DataFrame:
    return claims.filter((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("claim_id").agg(F.countDistinct("raw_id").alias("evidence_count"))


def newest_documents(evidence: DataFrame, k: int = 3) -> DataFrame:
    """The k distinct documents of each claim with the newest evidence, in order."""
    once = Window.partitionBy("claim_id", "document_id").orderBy(F.desc("added_at"), "source_id", "raw_id")
    latest = evidence.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    rank = Window.partitionBy("claim_id").orderBy(F.desc("added_at"), "document_id")
    return latest.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def page(rows: DataFrame, number: int, size: int, largest: int, *order: Column) -> DataFrame:
    """One page of a totally ordered list; number and size are clamped."""
    size = min(max(size, 1), largest)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def unresolved(conflicts: DataFrame) -> DataFrame:
    return conflicts.filter(F.coalesce("resolution", F.lit("unresolved")) == "unresolved")


def resolve(conflicts: DataFrame) -> DataFrame:
    """The claim each decided conflict retracts."""
    loser = F.when(F.col("resolution") == "a_wins", F.col("claim_b")).when(F.col("resolution") == "b_wins", F.col("claim_a"))
    return conflicts.select("conflict_id", loser.alias("claim_id"), F.lit("retract").alias("signal")).filter("claim_id is not null")


def detect_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs (a < b) that say different things of the same ends; an extension, as the data contract only stores pairs."""
    a = claims.filter("object_id is not null").select("subject_id", "object_id", F.col("predicate").alias("p"), F.col("claim_id").alias("claim_a"))
    b = a.select("subject_id", "object_id", F.col("p").alias("q"), F.col("claim_a").alias("claim_b"))
    return a.join(b, ["subject_id", "object_id"]).filter("p <> q and claim_a < claim_b").select("claim_a", "claim_b")


def statement(*parts: str) -> Column:
    """Non-empty trimmed parts joined by a space, underscores as spaces."""
    return F.concat_ws(" ", *[F.nullif(F.trim(F.regexp_replace(F.col(p), "_", " ")), F.lit("")) for p in parts])


def validated(raw: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY) -> DataFrame:
    """raw with the first reason to reject it, null if it is accepted."""
    reason = (
        F.when(F.col("subject_id").isNull(), "missing_subject")
        .when(~F.col("predicate").isin(*vocabulary), "unknown_predicate")
        .when(F.col("object_id").isNull() & F.col("object_value").isNull(), "missing_object")
        .when(F.length("object_value") > 8, "value_too_long")
    )
    return raw.withColumn("reason", reason)
