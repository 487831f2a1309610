"""Incremental counters against recounts, with repeated days and a source of many URLs."""

import random

from strandline.operators import counters, coverage

SCHEMA = "source_id string, url string, http_status int, body string, body_unchanged_since long"


def test_updates_equal_a_recount(spark):
    rng = random.Random(1)
    row = lambda: (rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *[f"u{rng.randrange(400)}"] * 30]), rng.choice([200, 204, 404]), rng.choice(["x", None]), rng.choice([None, 1]))
    days = [[row() for _ in range(n)] for n in (300, 1, 250)] + [[]]
    numbers, sets = spark.createDataFrame([], counters.NUMBERS), spark.createDataFrame([], counters.COUNTERS)
    for k in (0, 1, 1, 2, 0, 3):  # days that come again change nothing
        numbers, sets = counters.updated(spark.createDataFrame(days[k], SCHEMA), numbers, sets)
        numbers, sets = spark.createDataFrame(numbers.collect(), counters.NUMBERS), spark.createDataFrame(sets.collect(), counters.COUNTERS)
    all_rows = spark.createDataFrame([r for d in days for r in d], SCHEMA)
    want = {r.source_id: (r.pages_fetched, r.urls_known) for r in coverage.pages_and_urls(all_rows).collect() if r.source_id is not None}
    assert {r.source_id: (r.pages_fetched, r.urls_known) for r in counters.counted(sets).collect()} == want
    for source, total in {s: n for s, (_, n) in want.items()}.items():
        assert sorted(r.number for r in numbers.filter(f"source_id = '{source}'").collect()) == list(range(total))


def test_many_buckets(spark):
    rows = spark.range(100_000).selectExpr("'hot' AS source_id", "concat('u', id) AS url", "200 AS http_status", "'x' AS body", "cast(null AS long) AS body_unchanged_since")
    numbers, sets = counters.updated(rows, spark.createDataFrame([], counters.NUMBERS), spark.createDataFrame([], counters.COUNTERS))
    assert [tuple(r) for r in counters.counted(sets).collect()] == [("hot", 100_000, 100_000)] and sets.count() >= 3
