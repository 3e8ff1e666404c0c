from lexarium.streaming import traces

SF = "/root/testdata/sf0.001"


def test_daily_usage_equals_batch(spark):
    from lexarium.jobs.logs import q06_daily_quota
    from lexarium.jobs.streams import q06_daily_quota_stream

    batch = {(r["user_id"], r["day"]): r["used"] for r in q06_daily_quota(spark, SF).collect()}
    stream = {(r["user_id"], r["day"]): r["used"] for r in q06_daily_quota_stream(spark, SF).collect()}
    assert batch == stream


def test_sequence_breaks(spark, tmp_path):
    rows = [(1, 1), (1, 2), (1, 2), (2, 7), (2, 8), (3, 0)]
    spark.createDataFrame(rows, "user_id long, event_id long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, event_id long").parquet(f"{tmp_path}/in")
    out = traces.run_to_table(traces.sequence_breaks(stream), "append", "breaks")
    assert [tuple(r) for r in out.collect()] == [(1, 2, 2)]
