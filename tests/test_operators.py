from pyspark.sql import functions as F

from strandline.operators import claims, coverage, crawl, curation, graph, integrity, runs
from strandline.sources import tables

FETCH = "fetch_id long, source_id string, url string, fetched_at long, http_status int, body string, body_unchanged_since long, parse_skip_reason string"


def fetches(spark, *rows):
    return spark.createDataFrame(rows, FETCH)


def links(spark, *rows):
    return spark.createDataFrame(rows, "document_id long, fetch_id long")


def test_refetch_of_the_same_body(spark):
    rows = fetches(spark, (1, "s", "u", 10, 200, "x", None, None), (2, "s", "u", 20, 200, None, 1, None))
    assert coverage.pages_fetched(rows).first().pages_fetched == 1 and coverage.urls_known(rows).first().urls_known == 1
    assert [r.fetch_id for r in coverage.pending(rows, links(spark, (5, 9))).collect()] == [1]


def test_pending_scope(spark):
    rows = fetches(spark, (1, "s", "a", 10, 200, "x", None, None), (2, "s", "b", 20, 404, "x", None, None), (3, "s", "c", 30, 200, "x", None, "pdf"), (4, "s", "d", 40, 200, "y", None, None), (5, "s", "e", 15, 200, "z", None, None))
    assert {r.fetch_id for r in coverage.pending(rows, links(spark, (7, 5)), 35).collect()} == {1}


def test_chains(spark):
    rows = fetches(spark, (1, "s", "u", 1, 200, "b", None, None), (2, "s", "u", 2, 200, None, 1, None), (3, "s", "u", 3, 200, None, 2, None), (4, "s", "u", 4, 200, None, 4, None), (5, "s", "u", 5, 200, None, 6, None), (6, "s", "u", 6, 200, None, 5, None), (7, "s", "u", 7, 200, None, 99, None), (8, "s", "u", 8, 200, None, None, None), (9, "s", "u", 9, 200, None, 8, None), *[(20 + i, "s", "u", 1, 200, None, 19 + i if i else 3, None) for i in range(40)])
    got = {r.fetch_id: r.state for r in integrity.chain_status(rows).collect()}
    assert {k for k, v in got.items() if v == "broken"} == {4, 5, 6, 7, 9} and got[59] == "resolved" and len(got) == 47


def test_status_paging_and_resolution(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else 5) for i in range(10)], "claim_id long, valid_to long")
    assert claims.by_status(rows, "current").count() == 5 and claims.by_status(rows, "superseded").count() == 5 and claims.by_status(rows, "all").count() == 10 and claims.by_status(rows, "odd").count() == 5
    assert [r.claim_id for r in claims.page(rows, 2, 500, 4, F.col("claim_id")).collect()] == [4, 5, 6, 7]
    conflicts = spark.createDataFrame([(1, 10, 11, "a_wins"), (2, 10, 12, None)], "conflict_id long, claim_a long, claim_b long, resolution string")
    assert [(r.claim_id, r.signal) for r in claims.resolve(conflicts).collect()] == [(11, "retract")] and claims.unresolved(conflicts).first().conflict_id == 2


def test_wildcards(spark):
    rows = spark.createDataFrame([("a_b",), ("axb",)], "x string")
    assert rows.filter(claims.contains_any("a_b", "x")).count() == 2 and rows.filter(claims.contains_any("a_b", "x", escape=True)).count() == 1


def test_shared_document_survives_its_source(spark):
    rows = fetches(spark, (1, "s", "u", 1, 200, "x", None, None), (2, "t", "v", 2, 200, "x", None, None))
    doc = spark.createDataFrame([(9,)], "document_id long")
    own = rows.filter("source_id = 's'").select("fetch_id")
    assert curation.repoint_first_seen(doc, links(spark, (9, 1), (9, 2)), own).first().first_fetch_id == 2


def test_pacing(spark):
    def delay(*statuses):
        rows = spark.createDataFrame([("h", i, i, s) for i, s in enumerate(statuses)], "source_id string, started_at long, run_id long, status string")
        return runs.pacing(rows).first().delay

    assert [delay(*["failed"] * n) for n in range(1, 6)] == [5, 10, 20, 40, 80] and delay(*["failed"] * 9) == 300 and delay(*["complete"] * 30) == 0.1


def test_stale_and_state(spark):
    rows = spark.createDataFrame([(1, "s", "running", 0, 100), (2, "s", "running", 0, None)], "run_id long, source_id string, status string, started_at long, stats_updated_at long")
    assert {r.run_id for r in runs.stale(rows, 1850).collect()} == {2}


def test_links_of_a_page():
    html = '<base href="/b/"><a href="x">1</a><a href="#f"></a><iframe src="//o.com/y"></iframe><link rel="canonical" href="/c"><link rel="stylesheet" href="/s"><meta http-equiv="refresh" content="0; url=/r"><script type="application/ld+json">{"@id": "/j", "a": [{"sameAs": ["/k", 1]}]}</script><a href="x">2</a>'
    assert crawl.links_of(html, "https://h.com/a") == ["https://h.com/b/x", "https://o.com/y", "https://h.com/c", "https://h.com/r", "https://h.com/j", "https://h.com/k"]
    assert crawl.links_of(None, "") == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Full Name,Web Site,x\n"A, B",,1\nC D,http://c,\n', encoding="utf-8")
    rows = tables.read_rows(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["full_name", "web_site", "x"] and rows.collect()[1].x == ""
    assert [r.candidate_url for r in tables.candidate_urls(rows.withColumnRenamed("web_site", "website")).orderBy("full_name").collect()] == ["https://example.com/in/a-b", "http://c"]
    assert {(r.table, r.rows) for r in tables.table_counts(spark, "/root/testdata/sf0.001", ("region", "nowhere")).collect()} == {("region", 5), ("nowhere", 0)}
    maps = spark.createDataFrame([("i", "<sitemapindex><loc>m</loc><loc>i</loc></sitemapindex>"), ("m", "<urlset><loc> http://u?a&amp;b </loc></urlset>"), ("bad", "<x")], "url string, xml string")
    assert [r.url for r in tables.sitemap_urls(maps.filter("url <> 'i'")).collect()] == ["http://u?a&b"]
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    assert sorted(tuple(r) for r in tables.append_missing(old, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k long, v string"), ["k"]).collect()) == [(1, "a"), (2, "c")]
    answers = spark.createDataFrame([(1, 200), (2, 404), (3, 402), (4, 200), (5, 500)], "row long, status int")
    assert [r.outcome for r in tables.classified(answers).orderBy("row").collect()] == ["matched", "no_match", "out_of_credits", "not_tried", "not_tried"]
    person = '{"full_name":"A B","job_title":"Head","job_company_name":"C","education":[{"school":{"name":"S"}},{"school":null}],"experience":[{"title":{"name":"T"},"company":{"name":"D"}}]}'
    assert spark.range(1).select(tables.person_text(F.lit(person)).alias("t")).first().t == "A B is Head at C. A B studied at S. A B was T at D."


def test_a_person_is_read_once_and_customers_are_spread(spark):
    """The record is parsed once a shape and not once a sentence; a table in one file does not stay one task's work."""
    import __spark_entry__ as e

    whole = spark.range(1).select(tables.person_text(F.col("id").cast("string")).alias("t"))
    assert whole._jdf.queryExecution().analyzed().toString().count("from_json") == 2
    for name in ("vendor_person_text", "vendor_person_sentences"):
        assert "Exchange hashpartitioning(c_custkey" in e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_trigrams(spark):
    assert set(spark.range(1).select(graph.trigrams(F.lit("Cat")).alias("t")).first().t) == {"  c", " ca", "cat", "at "}


def test_workbook_rows(spark, tmp_path):
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Name</t></si><si><r><t>Ann</t></r><r><t> Oak</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>9</v></c><c r="C2"><v>41</v></c></row><row/></sheetData></worksheet>')
    assert [r.cells for r in tables.read_workbook(spark, str(tmp_path / "a.xlsx")).orderBy("row").collect()] == [{"Name": "Ann Oak", "Age": "41"}, {"Name": "", "Age": ""}]


def test_answer_cache(spark):
    from strandline.operators import answers

    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 3599), (3, "a", 3600), (4, "a", 7199), (5, "b", 5)], "request_id long, key string, at long")
    assert {r.request_id: r.hit for r in answers.cached(rows).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_extractor_close_over_a_million(spark, tmp_path):
    """Sources whose costs add up to more than a column of (10, 4) holds."""
    import __spark_entry__ as e

    spark.createDataFrame([(k, 1, "view", 400_000.125, "{}") for k in (1, 2, 3, 4)], "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = [(str(r.cost), r.claims) for r in e.queries()["extractor_close"](spark, str(tmp_path)).collect()]
    assert got == [("1600000.5000", 4)]


def test_top_claims_with_a_repeated_id(spark):
    """Two claims of one id: their rows go by the raw claim first, so both come before the second raw claim."""
    from strandline.operators import review

    claims = spark.createDataFrame([(1, "s1", "p1", 9), (1, "s1", "p2", 9), (2, "s1", "p3", 8)], "claim_id long, subject_id string, object_id string, first_seen_at long")
    entities = spark.createDataFrame([("p1", "one"), ("p2", "two"), ("p3", "three")], "entity_id string, name string")
    evidence = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 10, "a")], "claim_id long, raw_id long, source_id string")
    none = lambda schema: spark.createDataFrame([], schema)
    got = review.top_claims(claims, entities, evidence, none("raw_id long, document_id long"), none("document_id long"), none("source_id string, identifier string"), 4).filter("entity_id = 's1'").orderBy("place").collect()
    assert [(r.object_name, r.raw_id) for r in got] == [("two", 10), ("one", 10), ("two", 11), ("one", 11)]


def test_claims_without_an_object_do_not_meet_in_one_task(spark):
    rows = spark.range(2_000).selectExpr("id as claim_id", "'s1' as subject_id", "if(id < 4, concat('p', id), cast(null as string)) as object_id")
    entities = spark.createDataFrame([("s1", "Ida", "person"), ("p1", "Pier", "project"), ("7", "Seven", "project"), (None, "Nobody", "person")], "entity_id string, name string, kind string")
    small, merged = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1"), spark.conf.set(merged, "false")
    try:
        named = claims.with_endpoints(rows, entities)
        assert {(r.claim_id, r.object_name) for r in named.filter("object_name is not null").collect()} == {(1, "Pier")}
        shares = [r["count"] for r in named.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 2_000 and max(shares) < 1_000
    finally:
        spark.conf.set(small, before), spark.conf.unset(merged)
