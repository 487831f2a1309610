import pytest
from pyspark.sql import functions as F

from strandline import session


def test_merged_partitions_are_small_unless_set(spark):
    """64 MB of shuffle files hold millions of narrow rows: queries ask AQE for less, but leave a submitter's size as it is."""
    import __spark_entry__ as e

    key = session.ADVISORY[0]
    spark.conf.set(key, "7m")
    e.queries()["claim_evidence_counts"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "7m"
    spark.conf.unset(key)
    e.queries()["claim_evidence_counts"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "4m"
    width, spread = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(width)
    spark.conf.set(width, "32"), spark.conf.set(spread, "false")
    try:  # 6 million ids are some 24 MB of shuffle files, one task of Spark's own size
        largest = spark.range(6_000_000).repartition(F.col("id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest <= 1_500_000
    finally:
        spark.conf.set(width, before), spark.conf.unset(spread)


def test_tasks_stay_small_with_few_shuffle_partitions(spark):
    """A submitter's few shuffle partitions, or large files, must not make a task's share grow with the input."""
    import __spark_entry__ as e

    width, spread = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(width)
    for key in session.NARROW:
        spark.conf.unset(key)
    spark.conf.set(width, "2"), spark.conf.set(spread, "false")
    try:
        e.queries()["evidence_deduped"](spark, "/root/testdata/sf0.001")
        assert {k: spark.conf.get(k) for k in session.NARROW} == session.NARROW
        largest = spark.range(6_000_000).repartition(F.col("id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest <= 1_500_000  # two partitions would hold 3 million each
    finally:
        spark.conf.set(width, before), spark.conf.unset(spread)


def test_a_submitters_sizes_stand(spark):
    import __spark_entry__ as e

    given = dict(zip(session.NARROW, ("7m", "12", "9m"), strict=True))
    try:
        for key, value in given.items():
            spark.conf.set(key, value)
        e.queries()["source_coverage"](spark, "/root/testdata/sf0.001")
        assert {k: spark.conf.get(k) for k in given} == given
    finally:
        for key in given:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["source_coverage", "global_stats", "claim_list_rows", "claim_first_seen_top3", "top_claims_of_entity", "entity_neighborhood", "trigram_report", "claim_source_labels", "named_neighborhood", "claim_documents_newest"])
def test_queries_deal_their_rows_to_small_tasks(spark, name):
    """Each of these asks for the sizes itself, whatever was built before it in the session."""
    import __spark_entry__ as e

    for key in session.NARROW:
        spark.conf.unset(key)
    e.queries()[name](spark, "/root/testdata/sf0.001")
    assert {k: spark.conf.get(k) for k in session.NARROW} == session.NARROW
