"""Stateful streams and sinks against plain folds, over several micro-batches and across a restart."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.streaming import sinks, stateful

ROWS = "at long, id long, client long, instance long, key long, question string, status string"


def made(n, seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(n * 40) for _ in range(n))
    return [(t, i, i % 3, i % 2, rng.randrange(5), f"q{rng.randrange(9)}", rng.choice("abc")) for i, t in enumerate(times)]


def written(spark, folder, rows, parts):
    """The rows as files that a stream takes in order of time, one a batch."""
    step = -(-len(rows) // parts)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], ROWS).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def limited(rows, allowed, seconds):
    recent, out = {}, {}
    for at, i, client, *_ in rows:
        mine = [t for t in recent.get(client, []) if t > at - seconds]
        out[i] = len(mine) < allowed
        recent[client] = [*mine, at] if out[i] else mine
    return out


def cached(rows, capacity, seconds):
    caches, out = {}, {}
    for at, i, _, instance, _, question, _ in rows:
        cache = caches.setdefault(instance, {})
        out[i] = question in cache and at - cache[question] < seconds
        if not out[i]:
            cache[question] = at  # an existing key keeps its place
            while len(cache) > capacity:
                del cache[next(iter(cache))]
    return out


def changes(rows):
    last, out = {}, {}
    for _, i, _, _, key, _, status in rows:
        if last.get(key) != status:
            out[i] = status
        last[key] = status
    return out


CASES = {
    "limit": (lambda s: stateful.rate_limited(s, 2, 300), lambda rows: limited(rows, 2, 300)),
    "cache": (lambda s: stateful.answered(s, 3, 400), lambda rows: cached(rows, 3, 400)),
    "changes": (lambda s: stateful.changed(s, 10**9), changes),
}


@pytest.mark.parametrize("case", CASES)
def test_stream_equals_a_fold_and_goes_on_after_a_restart(spark, tmp_path, case):
    stream, fold = CASES[case]
    rows = made(120, 5)
    written(spark, tmp_path / "in", rows[:70], 2)
    place = str(tmp_path / "out")
    first = {r[0]: r[1] for r in stateful.drained(stream(source(spark, tmp_path / "in")), place).collect()}
    assert first == fold(rows[:70])
    written(spark, tmp_path / "in", rows[70:], 2)
    rest = stateful.drained(stream(source(spark, tmp_path / "in")), place).collect()  # a new query on the same checkpoint
    assert len(rest) == len({r[0] for r in rest}) and {r[0]: r[1] for r in rest} == fold(rows)


def test_a_replayed_batch_changes_nothing(spark):
    sink = sinks.LedgerSink(spark)
    write = sinks.documents_sink(sink)
    batch = lambda *rows: spark.createDataFrame(rows, "content_hash string, document_id long")
    write(batch(("a", 5), ("a", 3), ("b", 7), (None, 9)), 0)
    write(batch(("a", 1), ("c", 8)), 1)
    want = [("a", 3), ("b", 7), ("c", 8)]
    assert sorted(map(tuple, sinks.documents_in(sink).collect())) == want
    for number in (0, 1):
        write(batch(("a", 5), ("z", 3)), number)  # entered already: passed over, whatever it holds
    assert sorted(map(tuple, sinks.documents_in(sink).collect())) == want


def test_a_batch_that_failed_before_its_entry_is_written_anew(spark):
    sink = sinks.LedgerSink(spark)
    write = sinks.documents_sink(sink)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "content_hash string, document_id long")
    rows.limit(1).write.parquet(f"{sink.path}/rows/batch=0")  # what a crash leaves: rows without an entry
    assert sinks.documents_in(sink).count() == 0
    write(rows, 0)
    assert sorted(map(tuple, sinks.documents_in(sink).collect())) == [("a", 1), ("b", 2)] and [tuple(r) for r in sink.ledger().collect()] == [(0, 2)]


def test_stream_into_the_sink_over_two_runs(spark, tmp_path):
    sink, place = sinks.LedgerSink(spark), str(tmp_path / "progress")
    for part in (made(30, 1), made(50, 1)[30:]):
        written(spark, tmp_path / "in", part, 3)
        stream = source(spark, tmp_path / "in").select(F.col("question").alias("content_hash"), F.col("id").alias("document_id"))
        sinks.into(stream, sinks.documents_sink(sink), place)
    got = {r.content_hash: r.document_id for r in sinks.documents_in(sink).collect()}
    assert len(got) == sinks.documents_in(sink).count() == len({r[5] for r in made(30, 1)} | {r[5] for r in made(50, 1)[30:]})
