"""Streams: log tail without repeats, status changes, hourly windows. Each has a batch twin it must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_tail(rows: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream of rows, each key once within the lateness allowed."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def status_changes(rows: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type) whenever a user's event type differs from the last one, kept as state a user.

    Within a micro-batch rows are taken in order of event_id; state is one string a user.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            if kind != last:
                out.append((key[0], event_id, kind))
                last = kind
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    return rows.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)


def hourly(rows: DataFrame) -> DataFrame:
    """Events and their value by type and hour; on a stream with a watermark the same plan emits closed hours."""
    window = F.window(F.col("ts").cast("timestamp"), "1 hour")
    grouped = rows.groupBy("event_type", window.alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select("event_type", F.unix_timestamp("w.start").alias("hour"), "events", "total")


def server_sent(rows: DataFrame) -> DataFrame:
    """Rows as server-sent events."""
    return rows.select(F.concat(F.lit("data: "), F.to_json(F.struct(*rows.columns)), F.lit("\n\n")).alias("frame"))
