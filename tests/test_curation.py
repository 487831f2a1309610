from strandline.operators import curation


def test_chains_of_merges_end_and_circles_stay(spark):
    rows = [(f"a{i}", f"a{i + 1}") for i in range(20)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self"), ("b", "a3"), ("b", "c"), (None, "a"), ("a", None)]
    got = {r.entity_id: r.target_id for r in curation.resolved_merges(spark.createDataFrame(rows, "entity_id string, target_id string")).collect()}
    assert got == {**{f"a{i}": "a20" for i in range(20)}, "b": "a20"}
    assert curation.resolved_merges(spark.createDataFrame([], "entity_id string, target_id string")).count() == 0


def test_sources_of_one_host_become_one(spark):
    rows = [(1, "domain", "https://www.A.org:443/x", 5), (2, "domain", "a.org", 3), (3, "domain", "http://a.org/sitemap.xml", 1), (4, "domain", "b.org", 9), (5, "file", "a.org", 1), (6, "domain", " ", 1), (7, "domain", None, 1)]
    sources = spark.createDataFrame(rows, "source_id long, kind string, identifier string, created_at long")
    got = {r.source_id: (r.survivor_id, r.runs) for r in curation.sources_merged(sources.withColumn("kind", sources["kind"]), spark.createDataFrame([(1,), (4,)], "source_id long")).filter("source_id <> 5").collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (3, 0), 4: (4, 1)}
