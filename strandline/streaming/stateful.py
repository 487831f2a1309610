"""Stateful streams: a rate limit, an answer cache and status changes, each with state that is bounded and goes by itself.

State is kept by transformWithState in the RocksDB store that Spark checkpoints, so a query that is started again goes on
where it stopped. Within a micro-batch the rows of a key are taken in order of time and id. Time is the rows' own: timers fire
when the watermark passes, so a replay gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import checkpoint_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "id"])


class _Expiring(StatefulProcessor):
    """Keeps one timer a key, at the time from which its state says nothing any more."""

    def _keep_until(self, timer_values, at: int) -> None:
        due = at * 1000
        for old in self.handle.listTimers():
            if old < due:
                self.handle.deleteTimer(old)
        if due > timer_values.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.forget()

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class RateLimit(_Expiring):
    """At most `allowed` accepted rows of a client in any `seconds`; refused ones do not count. State: a list of the accepted times."""

    def __init__(self, allowed: int, seconds: int):
        self.allowed, self.seconds = allowed, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long")

    def forget(self) -> None:
        self.recent.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        recent, out = [r[0] for r in self.recent.get()], []
        frame = _ordered(rows)
        for at, i in zip(frame["at"].tolist(), frame["id"].tolist(), strict=True):
            recent = [t for t in recent if t > at - self.seconds]
            free = len(recent) < self.allowed
            if free:
                recent.append(at)
            out.append((i, free))
        if recent:
            self.recent.put([(t,) for t in recent])
            self._keep_until(timerValues, max(recent) + self.seconds)
        else:
            self.recent.clear()
        yield pd.DataFrame(out, columns=["id", "accepted"])


class AnswerCache(StatefulProcessor):
    """A cache of answers that are kept `seconds` from when they were made, `capacity` at most; the one inserted first goes first.

    State: a map from question to (made, number of insertion), and the next number. It is bounded by the capacity and has no
    timer: an answer that is too old still takes its place in the order of insertion.
    """

    def __init__(self, capacity: int, seconds: int):
        self.capacity, self.seconds = capacity, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "question string", "made long, place long")
        self.next = handle.getValueState("next", "place long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kept = {k[0]: tuple(v) for k, v in self.kept.iterator()}
        before, place, out = dict(kept), self.next.get()[0] if self.next.exists() else 0, []
        frame = _ordered(rows)
        for at, i, question in zip(frame["at"].tolist(), frame["id"].tolist(), frame["question"].tolist(), strict=True):
            held = kept.get(question)
            hit = held is not None and at - held[0] < self.seconds
            if not hit:
                if held is None and len(kept) >= self.capacity:
                    del kept[min(kept, key=lambda q: kept[q][1])]
                kept[question] = (at, held[1] if held else place)  # an answer made anew keeps its place in the order of insertion
                place += held is None
            out.append((i, hit))
        for question in before.keys() - kept.keys():
            self.kept.removeKey((question,))
        for question, value in kept.items():
            if before.get(question) != value:
                self.kept.updateValue((question,), value)
        self.next.update((place,))
        yield pd.DataFrame(out, columns=["id", "hit"])


class Changes(_Expiring):
    """Rows whose status differs from the last one of the same key, which is forgotten after `seconds` of silence."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")

    def forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last, out = self.last.get()[0] if self.last.exists() else None, []
        frame = _ordered(rows)
        for i, status in zip(frame["id"].tolist(), frame["status"].tolist(), strict=True):
            if status != last:
                out.append((i, status))
                last = status
        self.last.update((last,))
        self._keep_until(timerValues, int(frame["at"].max()) + self.seconds)
        yield pd.DataFrame(out, columns=["id", "status"])


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType, late: str) -> DataFrame:
    timed = rows.withColumn("__time", F.timestamp_seconds("at")).withWatermark("__time", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def rate_limited(rows: DataFrame, allowed: int = 60, seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """(id, accepted) of a stream (client, at, id); at in whole seconds. Later than `late` is dropped, as by any watermark."""
    return _stateful(rows.select("client", "at", "id"), "client", RateLimit(allowed, seconds), "id long, accepted boolean", late)


def answered(rows: DataFrame, capacity: int = 100, seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """(id, hit) of a stream (instance, at, id, question): whether the instance's cache holds an answer."""
    return _stateful(rows.select("instance", "at", "id", "question"), "instance", AnswerCache(capacity, seconds), "id long, hit boolean", late)


def changed(rows: DataFrame, seconds: int = 86400, late: str = "0 seconds") -> DataFrame:
    """(id, status) of a stream (key, at, id, status) where a key's status differs from its last one."""
    return _stateful(rows.select("key", "at", "id", "status"), "key", Changes(seconds), "id long, status string", late)


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder of them, read as a stream, `files` of it at a time."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads folders or patterns only
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(pattern)


def drained(stream: Callable[[], DataFrame] | DataFrame, place: str | None = None) -> DataFrame:
    """All that a stream gives for what is there now, written as Parquet and read again.

    place: a shared folder for the rows and the stream's checkpoint; with the same one again only what is new is taken. The
    default is a new one below the shared checkpoint folder.
    """
    frame = stream() if callable(stream) else stream
    spark = frame.sparkSession
    place = place or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        frame.writeStream.format("parquet").option("checkpointLocation", f"{place}/progress").outputMode("append").trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(frame.schema).parquet(f"{place}/rows")
