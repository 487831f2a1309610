"""Queries that run a stream over a whole table, for what is there now, and give its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import sinks, stateful, streams
from .queries import ORACLES, QUERIES, limited_sql


def streamed(table: str, sql: str):
    """Register a builder that is called with a table as a stream, and its SQL over the table."""

    def add(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(stateful.table_stream(spark, f"{sf_dir}/{table}.parquet"))
        ORACLES[build.__name__] = sql
        return build

    return add


def _seconds(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp").cast("long"))


_AT = "CAST(floor(epoch(ts)) AS BIGINT)"


@streamed("events", "WITH RECURSIVE " + limited_sql(f"SELECT event_id AS id, user_id % 20 AS client, {_AT} AS tick FROM events", 3, 86400) + " SELECT id, accepted FROM s")
def rate_limit_stream(events):
    """Which events of twenty clients a limit of three a day lets through."""
    return stateful.drained(stateful.rate_limited(_seconds(events).select((F.col("user_id") % 20).alias("client"), "at", F.col("event_id").alias("id")), 3, 86400))


_KEPT = "CASE WHEN hit THEN kept WHEN len(list_filter(kept, lambda x: x.q = question)) > 0 THEN list_transform(kept, lambda x: CASE WHEN x.q = question THEN {'q': x.q, 'made': tick} ELSE x END) ELSE list_append(CASE WHEN len(kept) >= 6 THEN kept[2:] ELSE kept END, {'q': question, 'made': tick}) END"


@streamed("events", f"WITH RECURSIVE o AS (SELECT event_id AS id, user_id % 4 AS instance, {_AT} AS tick, concat(event_type, ':', user_id % 10) AS question, row_number() OVER (PARTITION BY user_id % 4 ORDER BY {_AT}, event_id) AS n FROM events), s AS (SELECT id, instance, n, false AS hit, [{{'q': question, 'made': tick}}] AS kept FROM o WHERE n = 1 UNION ALL SELECT id, instance, n, hit, {_KEPT} FROM (SELECT o.*, s.kept, len(list_filter(s.kept, lambda x: x.q = o.question AND o.tick - x.made < 7200)) > 0 AS hit FROM s JOIN o ON o.instance = s.instance AND o.n = s.n + 1) x) SELECT id, hit FROM s")
def answer_cache_stream(events):
    """Which questions four instances answer from caches of six answers, kept two hours."""
    rows = _seconds(events).select((F.col("user_id") % 4).alias("instance"), "at", F.col("event_id").alias("id"), F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("question"))
    return stateful.drained(stateful.answered(rows, 6, 7200))


@streamed("events", f"SELECT id, status FROM (SELECT event_id AS id, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY {_AT}, event_id) AS before FROM events) x WHERE status IS DISTINCT FROM before")
def status_change_stream(events):
    """Events whose type differs from the same user's last one."""
    rows = _seconds(events).select(F.col("user_id").alias("key"), "at", F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return stateful.drained(stateful.changed(rows, seconds=10 * 365 * 86400))


@streamed("events", "SELECT DISTINCT event_id, event_type FROM events")
def log_tail_stream(events):
    """Each log row once."""
    return stateful.drained(streams.log_tail(events).select("event_id", "event_type"))


@streamed("documents", "SELECT sha256(text) AS content_hash, min(doc_id) AS document_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def document_sink_stream(documents):
    """Documents by content hash, through the exactly-once sink."""
    sink = sinks.LedgerSink(documents.sparkSession)
    sinks.into(documents.select(F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("document_id")), sinks.documents_sink(sink))
    return sinks.documents_in(sink)


@streamed("events", "SELECT concat('data: {\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}', chr(10), chr(10)) AS frame FROM events")
def event_frame_stream(events):
    """Server-sent frames of all events, each once, through the exactly-once sink."""
    sink = sinks.LedgerSink(events.sparkSession)
    sinks.into(streams.server_sent(events.select("event_id", "event_type")), sinks.appended(sink))
    return sink.table("frame string").select("frame")
