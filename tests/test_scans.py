"""Segmented scans against a plain loop, with one source that holds most rows."""

import random

import pytest

from strandline.operators import runs
from strandline.operators.scans import Machine, Previous, RunningMax, scan

SCHEMA = "source_id string, run_id long, started_at long, status string, items double, before int, kind string"


def made(n, hot):
    rng = random.Random(n)
    return [("hot" if rng.random() < hot else rng.choice(["a", "b", "c", None]), i, rng.randrange(n // 3 + 1), rng.choice(["queued", "running", "complete", "failed", "stopped", None]), rng.choice([None, 0.0, rng.uniform(-5, 120)]), i, "k") for i in range(n)]


def brute(rows):
    allowed = {tuple(s.split(">")) for s in (*runs.ALLOWED, *runs.STARTS)}
    last, best, state, out = {}, {}, {}, {}
    for s, i, t, status, items, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2], r[1])):
        if items is not None:
            best[s] = max(best.get(s, items), items)
        now = state.get(s, "new")
        state[s] = status if (now, status) in allowed else now
        out[i] = (last.get(s), best.get(s), state[s])
        last[s] = status
    return out


MOVES = tuple((*s.split(">"), s.split(">")[1]) for s in (*runs.ALLOWED, *runs.STARTS))


@pytest.mark.parametrize(("n", "hot", "parts"), [(400, 0.9, 7), (300, 0.2, 40), (200, 1.0, 5), (5, 0.5, 9), (1, 1.0, 3)])
def test_scan_matches_a_loop(spark, n, hot, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        rows = made(n, hot)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = scan(df, ["source_id"], ["started_at", "run_id"], [Previous("status", "before"), RunningMax("items", "most"), Machine("status", "state", "new", MOVES)], parts)
        assert {r.run_id: (r.before, r.most, r.state) for r in got.collect()} == brute(rows)
        assert got.columns == ["source_id", "run_id", "started_at", "status", "items", "kind", "before", "most", "state"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_task_holds_a_source(spark):
    rows = [("hot", i, i, "queued" if i % 2 else "running", 1.0, 0, "k") for i in range(4000)]
    out = runs.states(spark.createDataFrame(rows, SCHEMA), parts=16)
    sizes = [n for n in out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert len(sizes) >= 12 and max(sizes) < 800


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.states(empty).count() == runs.progress_changes(empty).count() == runs.transitions(empty).count() == 0
    twice = [("a", 1, 1, "queued", 1.0, 0, "k")] * 3 + [("a", 2, 2, "running", 2.0, 0, "k")]
    assert [(r.run_id, r.status) for r in runs.progress_changes(spark.createDataFrame(twice, SCHEMA)).orderBy("run_id").collect()] == [(1, "queued"), (2, "running")]
    assert sorted(r.state for r in runs.states(spark.createDataFrame(twice, SCHEMA)).collect()) == ["queued"] * 3 + ["running"]


@pytest.mark.parametrize(("n", "parts", "batch"), [(300, 7, 13), (400, 40, 5), (60_000, 6, 10_000), (1, 3, 13)])
def test_kept_answers_match_a_loop(spark, n, parts, batch):
    """The last case but one has one question asked 60,000 times, whose list of answers must not be copied at each."""
    from strandline.operators.scans import Kept

    rng = random.Random(n)
    rows = [("hot" if n > 1000 or rng.random() < 0.8 else rng.choice(["a", "b"]), i, rng.randrange(10 * n)) for i in range(n)]
    made, want = {}, {}
    for k, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[i] = k in made and at - made[k] < 90
        made[k] = made[k] if want[i] else at
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "key string, request_id long, at long")
        assert {r.request_id: r.hit for r in scan(df, ["key"], ["at", "request_id"], [Kept("at", "hit", 90)], parts).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
