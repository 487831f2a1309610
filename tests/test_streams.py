from strandline.streaming import streams


def drained(df, mode="append"):
    spark, name = df.sparkSession, f"t{id(df)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def events(spark, tmp_path):
    rows = [(i % 40, f"2024-01-01 00:{i % 60:02}:00", i % 3, ["a", "b"][i // 7 % 2], 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))


def test_log_tail_drops_repeats(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    assert drained(streams.log_tail(stream)).count() == batch.select("event_id").distinct().count()


def test_status_changes_equal_the_batch_twin(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = sorted(tuple(r) for r in drained(streams.status_changes(stream)).collect())
    want, last = [], {}
    for r in sorted(batch.collect(), key=lambda r: r.event_id):
        if last.get(r.user_id) != r.event_type:
            want.append((r.user_id, r.event_id, r.event_type))
            last[r.user_id] = r.event_type
    assert got == sorted(want)


def test_hourly_stream_equals_batch(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = sorted(tuple(r) for r in drained(streams.hourly(stream), "complete").collect())
    assert got == sorted(tuple(r) for r in streams.hourly(batch).collect())
