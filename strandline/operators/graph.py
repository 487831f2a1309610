"""The claim graph: neighbourhoods, attributes, summaries and name search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacency(claims: DataFrame) -> DataFrame:
    """Edges in both directions."""
    edges = claims.filter("object_id is not null").select("claim_id", "predicate", F.col("subject_id").alias("entity_id"), F.col("object_id").alias("neighbor_id"))
    return edges.unionByName(edges.select("claim_id", "predicate", F.col("neighbor_id").alias("entity_id"), F.col("entity_id").alias("neighbor_id")))


def neighborhood(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity, neighbour, predicates, evidence_count): both ways, with all predicates and all distinct evidence.

    Edges of either direction are one pair until both measures are taken; only the result is mirrored. A pair's evidence is
    its distinct raw claims, so an edge's claims meet theirs once.
    """
    edges = claims.filter("object_id is not null").select("claim_id", "predicate", F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b"))
    backed = edges.join(evidence.select("claim_id", "raw_id"), "claim_id", "left")
    once = backed.groupBy("a", "b", "raw_id").agg(F.collect_set("predicate").alias("p"))
    pairs = once.groupBy("a", "b").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("p")))), ",").alias("predicates"), F.count("raw_id").alias("evidence_count"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(F.explode(ends).alias("e"), "predicates", "evidence_count").select(F.col("e.a").alias("entity_id"), F.col("e.b").alias("neighbor_id"), "predicates", "evidence_count")


def summary(claims: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """Display name, number of neighbours and of sources behind each entity of the graph."""
    ends = claims.select("claim_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).filter("entity_id is not null")
    degree = adjacency(claims).groupBy("entity_id").agg(F.countDistinct("neighbor_id").alias("connection_count"))
    sources = ends.join(evidence.select("claim_id", "source_id").distinct(), "claim_id").groupBy("entity_id").agg(F.countDistinct("source_id").alias("source_count"))
    named = entities.select("entity_id", F.col("name").alias("display_name"))
    return ends.select("entity_id").distinct().join(named, "entity_id", "left").join(degree, "entity_id", "left").join(sources, "entity_id", "left").select("entity_id", F.coalesce("display_name", F.concat(F.lit("Unknown entity "), F.left("entity_id", F.lit(8)))).alias("display_name"), F.coalesce("connection_count", F.lit(0)).alias("connection_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"))


def attributes(claims: DataFrame) -> DataFrame:
    """Ordered distinct attribute values of each entity and predicate: claims without an object entity."""
    rows = claims.filter("object_id is null")
    return rows.groupBy("subject_id", "predicate").agg(F.array_join(F.array_sort(F.collect_set("object_value")), "|").alias("values"), F.count("*").alias("claims"))


def undirected(claims: DataFrame) -> DataFrame:
    """Edges of either direction under one name, with how many claims and predicates they carry."""
    edges = claims.filter("object_id is not null").select("predicate", F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b"), "valid_to")
    return edges.groupBy("a", "b").agg(F.count("*").alias("claims"), F.countDistinct("predicate").alias("predicates"), F.bool_and(F.col("valid_to").isNotNull()).alias("all_ended"))


def star(claims: DataFrame, focus: str) -> DataFrame:
    """Nodes of the one-hop graph around an entity, itself first."""
    near = adjacency(claims).filter(F.col("entity_id") == focus).select(F.col("neighbor_id").alias("node")).distinct().withColumn("ring", F.lit(1))
    return claims.sparkSession.range(1).select(F.lit(focus).alias("node"), F.lit(0).alias("ring")).union(near)


def search(entities: DataFrame, text: str, limit: int = 25) -> DataFrame:
    return entities.filter(F.col("name").ilike(f"%{text}%")).orderBy("name", "entity_id").limit(max(1, min(limit, 25)))


def trigrams(name: Column) -> Column:
    """Distinct padded 3-grams of a folded name, words padded by two spaces in front and one behind."""
    padded = F.transform(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_matches(entities: DataFrame, aliases: DataFrame, query: str, threshold: float = 0.3) -> DataFrame:
    """Entities whose name or an alias resembles the query; the best score of each, the name's on ties.

    A name that shares no trigram scores 0, so names are first kept by a test of any shared one.
    """
    wanted = trigrams(F.lit(query))
    labels = entities.select("entity_id", F.col("name").alias("label"), F.lit(0).alias("rank")).unionByName(aliases.select("entity_id", F.col("alias").alias("label"), F.lit(1).alias("rank")))
    near = labels.withColumn("own", trigrams(F.col("label"))).filter(F.arrays_overlap("own", wanted))
    same = F.size(F.array_intersect("own", wanted))
    scored = near.withColumn("score", same / (F.size("own") + F.size(wanted) - same))
    best = scored.filter(F.col("score") > threshold).groupBy("entity_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "label")).alias("b"))
    return best.select("entity_id", F.col("b.label").alias("label"), F.round("b.score", 6).alias("score"))


def _ranked_grams(labels: DataFrame) -> DataFrame:
    """(label, grams): distinct labels with their trigrams as ranks, rarest first.

    Trigrams are of letters, digits and blanks of ASCII, so there are 37 ** 3 at most: their counts may be ordered in one
    task and broadcast.
    """
    grams = labels.select("label").filter("label is not null").distinct().withColumn("g", F.explode(trigrams(F.col("label"))))
    counts = grams.groupBy("g").count()
    ranks = counts.select("g", F.row_number().over(Window.orderBy("count", "g")).alias("rank"))
    return grams.join(F.broadcast(ranks), "g").groupBy("label").agg(F.array_sort(F.collect_list("rank")).alias("grams"))


def similar_labels(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(left, right, score): pairs of labels whose trigram sets share more than `threshold` of their union; none is missed.

    left, right: a column `label` each; equal labels count once, nulls and labels without a trigram match nothing. A pair
    above the threshold shares more than threshold * n trigrams of each side's n, so it shares one of the n - floor(threshold
    * n) rarest of each: only these meet, at sizes that can reach the threshold. A pair is compared where the first trigram
    that both prefixes hold brought it together, so just once and without a distinct.
    """
    ranked = _ranked_grams(left.select("label").unionByName(right.select("label")))
    size = F.size("grams")
    prefix = F.slice("grams", F.lit(1), size - F.floor(size * F.lit(threshold) - 1e-9).cast("int"))
    held = ranked.withColumn("prefix", prefix)
    side = lambda rows, s: held.join(rows.select("label").distinct(), "label", "left_semi").select(F.col("label").alias(s), F.col("grams").alias(f"{s}_grams"), F.col("prefix").alias(f"{s}_prefix"), F.explode("prefix").alias("gram"))
    a, b = F.size("left_grams"), F.size("right_grams")
    met = side(left, "left").join(side(right, "right"), "gram").filter((b > a * threshold - 1e-9) & (a > b * threshold - 1e-9)).filter(F.get(F.array_intersect("left_prefix", "right_prefix"), F.lit(0)) == F.col("gram"))
    same = F.size(F.array_intersect("left_grams", "right_grams"))
    return met.select("left", "right", (same / (a + b - same)).alias("score")).filter(F.col("score") > threshold)


def resembling_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(name, entity_id, label, score): for each of many names the entities whose name or an alias resembles it.

    The best score of each entity counts, its own name's on ties, then the greater label. As `trigram_matches`, for a whole table of names.
    """
    labels = entities.select("entity_id", F.col("name").alias("label"), F.lit(0).alias("rank")).unionByName(aliases.select("entity_id", F.col("alias").alias("label"), F.lit(1).alias("rank")))
    pairs = similar_labels(names.select(F.col("name").alias("label")), labels, threshold)
    owned = pairs.join(labels, pairs["right"] == labels["label"])
    best = owned.groupBy(F.col("left").alias("name"), "entity_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "label")).alias("b"))
    return best.select("name", "entity_id", "b.label", F.round("b.score", 6).alias("score"))
