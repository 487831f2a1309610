"""Retries and redirects through an injected transport and recorded answers."""

from strandline.sources import fetching

CALLS = {
    "http://a.org/": (200, None, "text/HTML; charset=utf-8", b"a"),
    "http://a.org/old": (301, "/new", None, None),
    "http://a.org/new": (302, "http://b.org/end?x", None, None),
    "http://b.org/end?x": (200, None, "application/pdf", b"b"),
    "http://a.org/gone": (404, None, "text/html", b"no"),
    "http://a.org/private": (403, None, None, None),
    "http://a.org/broken": (503, None, None, None),
    "http://a.org/loop": (307, "loop", None, None),
    "http://a.org/nowhere": (301, None, None, None),
}


def caller():
    calls = dict(CALLS)
    return lambda url: calls[url]  # an unknown URL raises


def test_transport(spark):
    urls = spark.createDataFrame([(u,) for u in [*CALLS, "http://c.org/unknown", "http://a.org/", None]], "url string")
    got = {r.url: r for r in fetching.retrieved(urls, fetching.over(caller(), 3), redirects=4).collect()}
    assert len(got) == len(CALLS) + 1
    assert {u.rsplit("/", 1)[1]: (r.outcome, r.status, r.attempts, r.waited, r.is_html) for u, r in got.items()} == {
        "": ("ok", 200, 1, 0.0, True), "old": ("ok", 200, 1, 0.0, False), "new": ("ok", 200, 1, 0.0, False), "end?x": ("ok", 200, 1, 0.0, False), "gone": ("ok", 404, 1, 0.0, True),
        "private": ("refused", 403, 1, 0.0, False), "broken": ("server_error", 503, 3, 3.0, False), "loop": ("too_many_redirects", 307, 1, 0.0, False), "nowhere": ("ok", 301, 1, 0.0, False),
        "unknown": ("transport_error", None, 3, 3.0, False),
    }
    assert got["http://a.org/old"].chain == ["http://a.org/old", "http://a.org/new", "http://b.org/end?x"] and bytes(got["http://a.org/old"].body) == b"b"
    assert len(got["http://a.org/loop"].chain) == 5 and got["http://c.org/unknown"].error == "KeyError"


def test_recorded_answers_change_with_the_attempt(spark):
    answers = spark.createDataFrame([("http://a.org/", 1, 500, None, None, None, None), ("http://a.org/", 2, None, None, None, None, "Timeout"), ("http://a.org/", 3, 200, None, "text/html", bytearray(b"x"), None)], "url string, attempt int, " + fetching.ANSWER)
    r = fetching.retrieved(spark.createDataFrame([("http://a.org/",), ("http://b.org/",)], "url string"), fetching.recorded(answers)).orderBy("url").collect()
    assert (r[0].outcome, r[0].attempts, r[0].waited) == ("ok", 3, 3.0) and (r[1].outcome, r[1].error) == ("transport_error", "no answer")


def test_no_urls(spark):
    assert fetching.retrieved(spark.createDataFrame([], "url string"), fetching.over(caller())).count() == 0


def test_pages_that_share_a_url_are_fetched_each(spark, tmp_path):
    """Pages 2 and 8 have one URL; 3 and 4 lead on to the page before, 6 fails twice, 8 is refused by none."""
    import __spark_entry__ as e

    urls = {k: f"http://a.org/{k}" for k in range(1, 9)} | {2: "http://a.org/x", 8: "http://a.org/x", 3: "http://a.org/x#top"}
    spark.createDataFrame([(k, u, "<p>") for k, u in urls.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.url, r.final_url, r.redirects, r.attempts, r.status) for r in e.queries()["recorded_fetch"](spark, str(tmp_path)).collect())
    moved = {3: (2, 1), 4: (2, 2)}
    assert got == sorted((u, urls[moved.get(k, (k, 0))[0]], moved.get(k, (k, 0))[1], {1: 2, 6: 3}.get(k, 1), 200) for k, u in urls.items())


def test_rounds_carry_no_recorded_bodies(spark, monkeypatch):
    """A body is in nothing that a round writes, and each request ends with that of its own last answer (a retry begins with the first URL)."""
    written, real = [], fetching.checkpointed
    monkeypatch.setattr(fetching, "checkpointed", lambda df: written.append({f.dataType.simpleString() for f in df.schema}) or real(df))
    row = lambda url, attempt, status, body, location=None: (url, attempt, status, location, "text/html", None if body is None else bytearray(body), None)
    answers = [
        row("http://a.org/", 1, 503, b"wait"), row("http://a.org/", 2, 200, b"late"), row("http://a.org/old", 1, 301, b"moved", "/"), row("http://a.org/old", 2, 301, None, "/"),
        row("http://a.org/same", 1, 200, b"late"), row("http://a.org/empty", 1, 200, b""), row("http://a.org/null", 1, 200, None),
        row("http://a.org/twice", 1, 200, b"one"), row("http://a.org/twice", 1, 404, b"two"), row("http://a.org/never", 1, 200, b"not asked"),
    ]
    asked = ["", "old", "same", "empty", "null", "twice", "unknown"]
    got = fetching.retrieved(spark.createDataFrame([(f"http://a.org/{u}",) for u in asked], "url string"), fetching.recorded(spark.createDataFrame(answers, "url string, attempt int, " + fetching.ANSWER))).collect()
    rows = sorted((r.url.rsplit("/", 1)[1], r.status or 0, None if r.body is None else bytes(r.body)) for r in got)
    assert rows == [("", 200, b"late"), ("empty", 200, b""), ("null", 200, None), ("old", 200, b"late"), ("same", 200, b"late"), ("twice", 200, b"one"), ("twice", 404, b"two"), ("unknown", 0, None)]
    assert len(written) > 3 and not any("binary" in types for types in written)


def test_redirects_to_pages_of_null_and_odd_urls(spark, tmp_path):
    import __spark_entry__ as e

    rows = [(1, "http://a.org/1"), (2, None), (3, "http://a.org/3"), (9, "../x?"), (10, "http://a.org/10")]
    spark.createDataFrame([(k, u, "<p>") for k, u in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.url, r.final_url, r.redirects, r.status) for r in e.queries()["recorded_fetch"](spark, str(tmp_path)).collect()}
    assert got == {("http://a.org/1", "http://a.org/1", 0, 200), (None, None, 0, 200), ("http://a.org/3", None, 1, 200), ("../x?", "../x?", 0, 200), ("http://a.org/10", "../x?", 1, 200)}
