"""Distinct counters that a day's fetches update without a recount: exact sets of URLs as bitmaps over dense ids.

Each URL of a source has a number, given once, from 0 without gaps. A set of URLs is a bitmap a bucket of 32,768 numbers, so
sets of any day, partition or repetition merge by OR and count by their bits. A source of many URLs has many buckets, and
no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coverage import has_content, succeeded
from .scans import Counted, scan

NUMBERS, COUNTERS = "source_id string, url string, number long", "source_id string, bucket long, known binary, fetched binary"


def numbered(fetches: DataFrame, numbers: DataFrame) -> DataFrame:
    """numbers (source_id, url, number) with the URLs of fetches that it lacks, after the source's last one, in order of URL.

    Fetches without source or URL are in no set.
    """
    new = fetches.filter("source_id is not null and url is not null").select("source_id", "url").distinct().join(numbers.select("source_id", "url"), ["source_id", "url"], "left_anti")
    upto = numbers.groupBy("source_id").agg((F.max("number") + 1).alias("upto"))
    counted = scan(new.withColumn("__one", F.lit(True)), ["source_id"], ["url"], [Counted("__one", "nth")]).join(upto, "source_id", "left")
    return numbers.unionByName(counted.select("source_id", "url", (F.coalesce("upto", F.lit(0)) + F.col("nth") - 1).alias("number")))


def sets_of(fetches: DataFrame, numbers: DataFrame) -> DataFrame:
    """(source_id, bucket, known, fetched): the URLs of fetches, and those of them that were fetched with content."""
    rows = fetches.select("source_id", "url", (succeeded() & has_content()).alias("ok")).join(numbers, ["source_id", "url"])
    at, ok = F.bitmap_bit_position("number"), F.coalesce("ok", F.lit(False))
    held = rows.select("source_id", F.bitmap_bucket_number("number").alias("bucket"), at.alias("at"), F.when(ok, at).alias("ok_at"))
    return held.groupBy("source_id", "bucket").agg(F.bitmap_construct_agg("at").alias("known"), F.bitmap_construct_agg("ok_at").alias("fetched"))


def merged(*parts: DataFrame) -> DataFrame:
    """Sets of several days as one; equal parts change nothing."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("source_id", "bucket").agg(F.bitmap_or_agg("known").alias("known"), F.bitmap_or_agg("fetched").alias("fetched"))


def counted(sets: DataFrame) -> DataFrame:
    """(source_id, pages_fetched, urls_known) of each source."""
    return sets.groupBy("source_id").agg(F.sum(F.bitmap_count("fetched")).alias("pages_fetched"), F.sum(F.bitmap_count("known")).alias("urls_known"))


def updated(fetches: DataFrame, numbers: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbers, sets) after more fetches; neither reads the fetches before."""
    numbers = numbered(fetches, numbers)
    return numbers, merged(sets, sets_of(fetches, numbers))
