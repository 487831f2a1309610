"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows (13 consecutive words, or the whole item if shorter) are the sets to be contained. The words of all
windows are ordered by rarity, i.e. by how often the corpus has them; since containment must be complete, the rarest
word of a window is its whole necessary prefix. A document word joins only the windows whose prefix word it is. The
length bound (the document has at least as many words) and the positional bound (the window, laid so that its prefix
word falls on this word, lies inside the document) follow, then the words are compared exactly. The join runs while the
exploded words stream by, so only true occurrences are shuffled.

The benchmark side is broadcast in blocks of at most about BROADCAST_WINDOWS windows, each met by the documents in a
pass of its own: no document word is shuffled, so a common word is no hot key, and no pass holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import cut, row_key, unused

WINDOW = 13
BROADCAST_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not a word once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    """[''] + words (+ [''] after trailing separators): a space in front makes the first element empty for every text."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), _BETWEEN)


def _lowered(words: Column) -> Column:
    return F.translate(words, _UPPER, _LOWER)


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(win, items): each distinct window as an array of words with the ids of the items that hold it, as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.filter(F.split(_lowered(F.coalesce("text", F.lit(""))), _BETWEEN), lambda w: w != "").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(width - 1)))
    wins = items.filter(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("at"))
    return wins.select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))


def _prefixes(docs: DataFrame, windows: DataFrame, few: bool) -> DataFrame:
    """windows with the rarest word of each and its place; rarity counts every word of every document."""
    tokens = windows.select(F.explode("win").alias("token")).distinct().withColumn("key", F.lower("token"))
    said = docs.select(F.explode(_split(F.col("text"))).alias("w")).select(F.lower("w").alias("key"))
    if few:  # the keys of one block of windows: other words need not be counted
        said = said.join(F.broadcast(tokens.select("key").distinct()), "key")
    counts = said.groupBy("key").count()
    ranked = tokens.join(counts, "key", "left").select("token", "key", F.coalesce("count", F.lit(0)).alias("seen"))
    placed = windows.withColumn("id", F.xxhash64("win")).select("id", "win", "items", F.posexplode("win").alias("place", "token"))
    first = placed.join(ranked, "token").groupBy("id", "win", "items").agg(F.min(F.struct("seen", "token", "place", "key")).alias("p"))
    return first.select("id", F.col("p.key").alias("key"), F.col("p.place").alias("place"), F.size("win").alias("size"), F.array_join("win", " ").alias("wanted"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, row, n_words, n_hit, items, contaminated) a row of docs; items are sorted id strings.

    A word is hit if it lies in any occurrence of an item window; a document is contaminated if share * n_hit reaches
    n_words and there is a hit. Null or wordless texts have no words and are clean; repeated rows each get a row; items
    without words or without an id add no item (words of the latter still hit); empty tables give no hits or no rows.
    """
    windows = item_windows(benchmark, width)
    blocks = max(1, -(-windows.count() // max(1, BROADCAST_WINDOWS)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = cut(_prefixes(text, windows, blocks == 1))
    # Every text begins with the empty word at place 0; it joins this row, which stands for the document itself.
    itself = wanted.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(0).alias("place"), F.lit(0).alias("size"), F.lit("").alias("wanted"), F.lit(None).cast("array<string>").alias("items"))
    words = text.select("doc_id", row_key("doc_id", "text").alias("row"), _split(F.col("text")).alias("words"))
    words = words.select("doc_id", "row", "words", (F.size("words") - 1 - (F.element_at("words", -1) == "").cast("int")).alias("n"))

    def meet(block: DataFrame) -> DataFrame:
        met = words.select("*", F.posexplode("words").alias("pos", "w")).withColumn("key", F.lower("w")).join(F.broadcast(block), "key")
        start = F.col("pos") - F.col("place")
        found = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size"))
        fits = (start >= 1) & (start + F.col("size") - 1 <= F.col("n")) & (_lowered(F.array_join(found, " ")) == F.col("wanted"))
        return met.filter(((F.col("size") == 0) & (F.col("pos") == 0)) | ((F.col("size") > 0) & fits)).select("doc_id", "row", "n", "size", start.alias("start"), "items")

    met = None
    for b in range(blocks):
        block = (wanted.filter(F.pmod("id", F.lit(blocks)) == b) if blocks > 1 else wanted).drop("id")
        part = meet(block.unionByName(itself) if b == 0 else block)
        met = part if met is None else met.unionByName(part)
    hit = F.when(F.col("size") > 0, F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    per_row = met.groupBy("doc_id", "row").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count_if(F.col("size") == 0).alias("copies"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    ends = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], s["upto"])).cast("long")).alias("n"), F.greatest(s["upto"], h["end"]).alias("upto")),
    )
    out = per_row.select("doc_id", "row", "n_words", ends["n"].alias("n_hit"), "items", F.explode(F.expr("array_repeat(true, cast(copies as int))")).alias("one")).drop("one")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without its contaminated rows."""
    own = unused(docs, "__row")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("row").alias(own)).distinct()
    return docs.withColumn(own, row_key("doc_id", "text")).join(bad, own, "left_anti").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, s, s + 12), ' ') AS win FROM bs),
sizes AS (SELECT DISTINCT size FROM wins),
ds AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
hits AS (
  SELECT ds.r, ds.s, ds.size, wins.item_id
  FROM ds JOIN wins ON ds.size = wins.size AND array_to_string(list_slice(ds.w, ds.s, ds.s + ds.size - 1), ' ') = wins.win),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + size)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.ids, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
