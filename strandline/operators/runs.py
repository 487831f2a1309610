"""Run lifecycle: recent and active runs, stale ones, source states, accounting, progress and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Machine, Previous, RunningMax, scan

STALE_SECONDS = 30 * 60


def action(kind: str = "kind") -> Column:
    return F.when(F.col(kind) == "parse", "parse").otherwise("crawl")


def recent(runs: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def active(runs: DataFrame) -> DataFrame:
    """The oldest queued or running run of each source and action."""
    w = Window.partitionBy("source_id", "action").orderBy("started_at", "run_id")
    rows = runs.filter(F.col("status").isin("queued", "running")).withColumn("action", action())
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def newest_active(runs: DataFrame, kind: str | None = None) -> DataFrame:
    """The newest queued or running run of each source, optionally of one kind."""
    rows = runs.filter(F.col("status").isin("queued", "running"))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return rows.groupBy("source_id").agg(F.max(F.struct("started_at", "run_id", "kind")).alias("r")).select("source_id", "r.run_id", "r.kind")


def is_running(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter((F.col("run_id") == run_id) & (F.col("status") == "running"))


def until_stopped(runs: DataFrame) -> DataFrame:
    """Work that a cooperative stop lets through: rows of each source before its first stopped one."""
    first = runs.filter("status = 'stopped'").groupBy("source_id").agg(F.min(F.struct("started_at", "run_id")).alias("stop"))
    return runs.join(first, "source_id", "left").filter(F.col("stop").isNull() | (F.struct("started_at", "run_id") < F.col("stop"))).drop("stop")


def stopped(runs: DataFrame) -> DataFrame:
    """The newest stopped run of each source and action."""
    w = Window.partitionBy("source_id", "action").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.filter("status = 'stopped'").withColumn("action", action()).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def latest_crawl(runs: DataFrame) -> DataFrame:
    """Each source's newest run that is not a parse."""
    return runs.filter("kind <> 'parse'").groupBy("source_id").agg(F.max(F.struct("started_at", "run_id", "status")).alias("r")).select("source_id", "r.run_id", "r.status", "r.started_at")


def stale(runs: DataFrame, now: int, seconds: int = STALE_SECONDS) -> DataFrame:
    return runs.filter((F.col("status") == "running") & (F.coalesce("stats_updated_at", "started_at") < now - seconds))


def duplicate_active(runs: DataFrame) -> DataFrame:
    """Sources that break the rule of one active run a kind."""
    return runs.filter(F.col("status").isin("queued", "running")).groupBy("source_id", "kind").agg(F.count("*").alias("active")).filter("active > 1")


def due(now: int) -> Column:
    """Never crawled, or longer ago than the interval (7 days where none is set, 1 at least)."""
    days = F.greatest(F.lit(1), F.coalesce(F.nullif("recrawl_interval_days", F.lit(0)), F.lit(7)))
    return F.col("last_full_recrawl_at").isNull() | (now - F.col("last_full_recrawl_at") >= days * 86400)


def source_state(sources: DataFrame, active_runs: DataFrame, pending_counts: DataFrame, now: int) -> DataFrame:
    """active, pending, due, up-to-date or idle: the first that holds."""
    busy = active_runs.select("source_id").distinct().withColumn("busy", F.lit(True))
    rows = sources.join(busy, "source_id", "left").join(pending_counts, "source_id", "left")
    state = F.when(F.col("busy"), "active").when(F.col("pending") > 0, "pending").when(due(now), "due").when(F.col("last_full_recrawl_at").isNotNull(), "up-to-date").otherwise("idle")
    return rows.select("source_id", state.alias("state"))


#: Steps of a run that are allowed.
ALLOWED = ("queued>running", "running>complete", "running>failed", "running>stopped", "stopped>queued")
#: Further steps that the state machine takes: the first event, an attempt anew.
STARTS = ("new>queued", "new>running", "new>complete", "new>failed", "new>stopped", "complete>queued", "complete>running", "failed>queued", "failed>running")
_ORDER = ("started_at", "run_id")


def transitions(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Counts of successive states of each source and whether the step is allowed."""
    steps = scan(runs.select("source_id", *_ORDER, F.col("status").alias("after")), ["source_id"], _ORDER, [Previous("after", "before")], parts).filter("before is not null")
    return steps.groupBy("before", "after").agg(F.count("*").alias("steps")).withColumn("allowed", F.concat_ws(">", "before", "after").isin(*ALLOWED))


def states(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """runs with `state`: where each source's machine stands after the event. Steps that are not allowed change nothing, so what
    was stopped stays stopped though its job still reports an end."""
    moves = tuple((*step.split(">"), step.split(">")[1]) for step in (*ALLOWED, *STARTS))
    return scan(runs, ["source_id"], _ORDER, [Machine("status", "state", "new", moves)], parts)


def accounting(runs: DataFrame) -> DataFrame:
    """Cost, items and the kinds of work of each source."""
    return runs.groupBy("source_id").agg(F.round(F.sum("items"), 2).alias("cost"), F.count("*").alias("runs"), F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds"))


def outcome(runs: DataFrame) -> DataFrame:
    """complete, partial or failed from the counts of good and bad runs."""
    good, bad = F.count_if(F.col("status") == "complete"), F.count_if(F.col("status") == "failed")
    return runs.groupBy("source_id").agg(good.alias("good"), bad.alias("bad")).withColumn("outcome", F.when(F.col("bad") == 0, "complete").when(F.col("good") > 0, "partial").otherwise("failed"))


def percent(done: Column, total: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), done / F.greatest(total, F.lit(1)) * 100)), 1)


def rescaled(done: Column, total: Column, start: float, end: float) -> Column:
    """Stage progress within [start, end]; a stage of nothing is at its end."""
    return F.when(total == 0, F.lit(end)).otherwise(start + (end - start) * done / total)


def monotone(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Crawl percent that never falls and stays below 100 while running."""
    rows = runs.withColumn("__own", F.least(F.lit(99.9), F.round(F.col("items").cast("double"), 1)))
    return scan(rows, ["source_id"], _ORDER, [RunningMax("__own", "percent")], parts).drop("__own")


def progress_changes(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows whose status differs from the one before of the same source: what a change stream emits."""
    rows = scan(runs.select("source_id", *_ORDER, "status"), ["source_id"], _ORDER, [Previous("status", "before")], parts)
    return rows.filter(~F.col("status").eqNullSafe(F.col("before"))).select("source_id", "run_id", "status")


def newest(rows: DataFrame, k: int) -> DataFrame:
    """The newest k rows of a log, a top-k without a full sort."""
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(k)


def pacing(runs: DataFrame, chunk: int = 86400, start: float = 0.25) -> DataFrame:
    """Delay of each host after all its answers: x0.9 down to 0.1 s on success, else doubled, 5 s at least, 300 s at most.

    Every answer is a clamped multiplication, and those compose to one of their kind: d -> clamp(a * d, low, high). Each
    stretch of `chunk` seconds is folded to one such function in parallel; a host then only applies its stretches.
    """
    slow = F.col("status") == "failed"
    log = runs.groupBy(F.col("source_id").alias("host"), F.floor(F.col("started_at") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("started_at", "run_id", slow.alias("slow")))).alias("log"))

    def after(x: Column, is_slow: Column) -> Column:
        return F.when(is_slow, F.least(F.lit(300.0), F.greatest(x * 2, F.lit(5.0)))).otherwise(F.greatest(F.lit(0.1), x * 0.9))

    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    folded = log.select("host", "chunk", F.aggregate("log", same, lambda f, x: F.struct((f["a"] * F.when(x["slow"], 2.0).otherwise(0.9)).alias("a"), after(f["low"], x["slow"]).alias("low"), after(f["high"], x["slow"]).alias("high"))).alias("f"))
    stretches = folded.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("fs"))
    return stretches.select("host", F.round(F.aggregate("fs", F.lit(start), lambda d, s: F.least(s["f"]["high"], F.greatest(s["f"]["low"], s["f"]["a"] * d))), 6).alias("delay"))


def rate_limit(runs: DataFrame, allowed: int = 3, seconds: int = 86400) -> DataFrame:
    """Accepted requests of each client under a sliding window in which refused ones do not count.

    Whether a request counts depends on all before it, so this is an ordered fold over one client's log, in one task.
    """
    log = runs.groupBy(F.col("source_id").alias("client")).agg(F.array_sort(F.collect_list(F.struct(F.col("started_at").alias("t"), "run_id"))).alias("log"))
    start = F.struct(F.array().cast("array<bigint>").alias("recent"), F.lit(0).alias("accepted"), F.lit(0).alias("refused"))

    def step(s: Column, x: Column) -> Column:
        recent = F.filter(s["recent"], lambda t: t > x["t"] - seconds)
        free = F.size(recent) < allowed
        return F.struct(F.when(free, F.concat(recent, F.array(x["t"]))).otherwise(recent).alias("recent"), (s["accepted"] + free.cast("int")).alias("accepted"), (s["refused"] + (~free).cast("int")).alias("refused"))

    folded = log.select("client", F.aggregate("log", start, step).alias("s"))
    return folded.select("client", "s.accepted", "s.refused")
