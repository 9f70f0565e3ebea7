"""Streams give the batch results, whatever the order and number of files, and survive a restart."""

import datetime as dt

from quorumlens.operators import growth
from quorumlens.operators.buckets import Buckets
from quorumlens.streaming import weekly

SCHEMA = "account_id long, ts timestamp, followers long, ordinal long"


def points(n):
    start = dt.datetime(2026, 1, 5)
    return [(i % 3, start + dt.timedelta(hours=7 * i), 100 + i * 37 % 91, i) for i in range(n)]


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    every = points(90)
    for at in (0, 45):  # two runs of the same query over what is new
        spark.createDataFrame(every[at : at + 45], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = weekly.weekly_stream(spark.readStream.schema(SCHEMA).parquet(source))
        rows = Buckets(spark, table, stream.schema, ["account_id", "week_start"], 4)
        weekly.into_table(stream, rows, state).awaitTermination()
    got = rows.read()
    want = growth.weekly_snapshots(spark.createDataFrame(every, SCHEMA))
    order = ["account_id", "week_start", "followers"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))


def test_points_behind_the_watermark_are_dropped(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    batches = [points(90), points(91)[-1:], [(0, dt.datetime(2026, 1, 5, 1), 999_999, 10_000)]]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = weekly.weekly_stream(spark.readStream.schema(SCHEMA).parquet(source))
        rows = Buckets(spark, table, stream.schema, ["account_id", "week_start"], 4)
        weekly.into_table(stream, rows, state).awaitTermination()
    assert rows.read().where("followers = 999999").count() == 0


def test_served_requests_arrive_once(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    seen = []
    for k in range(2):
        spark.createDataFrame([(k,)], "request_id int").write.mode("append").json(source)
        requests = spark.readStream.schema("request_id int").json(source)
        weekly.serve(requests, lambda batch, _: seen.extend(r["request_id"] for r in batch.collect()), state, once=True).awaitTermination()
    assert seen == [0, 1]
