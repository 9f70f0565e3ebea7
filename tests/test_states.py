"""Keyed state with timers: weeks close with event time, late points are listed, jobs live as the batch operators say."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import growth, lifecycle
from quorumlens.streaming import states

POINTS = "account_id long, ts timestamp, followers long, ordinal long"
EVENTS = "analysis_id long, at timestamp, event string, detail string, ordinal long"
START = dt.datetime(2026, 1, 5)


@pytest.fixture(autouse=True)
def rocks(spark):
    states.use(spark)


def points(n):
    return [(i % 3, START + dt.timedelta(hours=7 * i), 100 + i * 37 % 91, i) for i in range(n)]


class Run:
    """A query that is stopped and started over its checkpoint with every batch."""

    def __init__(self, spark, place, schema, make):
        self.spark, self.place, self.schema, self.make = spark, place, schema, make

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.place}/in")
        self.again()

    def again(self):
        out = self.make(self.spark.readStream.schema(self.schema).parquet(f"{self.place}/in"))
        self.names = out.columns
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{self.place}/state").option("path", f"{self.place}/out").trigger(availableNow=True).start().awaitTermination()

    def rows(self):
        return self.spark.read.parquet(f"{self.place}/out").collect()


def test_weeks_close_once_and_late_points_are_listed(spark, tmp_path):
    run = Run(spark, tmp_path, POINTS, lambda df: states.weekly_state(df, "1 day"))
    every = points(90)
    run.feed(every[50:] + [(1, None, 5, 0), (1, START, None, 0)])  # late weeks first: they are all open
    run.feed(every[:50])
    end = START + dt.timedelta(days=400)
    run.feed([(99, end, 1, 0)])
    run.again()  # a restart without data
    weeks = {(r["account_id"], r["week_start"]): r["followers"] for r in run.rows() if r["kind"] == "week"}
    late = [r for r in run.rows() if r["kind"] == "late"]
    closed = [p for p in every if p not in {(r["account_id"], r["ts"], r["followers"], next(q[3] for q in every if q[1] == r["ts"])) for r in late}]
    want = growth.weekly_snapshots(spark.createDataFrame(closed, POINTS)).collect()
    assert weeks == {(r["account_id"], r["week_start"]): r["followers"] for r in want} and len(want) == len([r for r in run.rows() if r["kind"] == "week"])
    # the first batch ended on 30 January, so its watermark is a day before: weeks that ended until then were closed to the second
    mark = every[-1][1] - dt.timedelta(days=1)
    limit = [p for p in every[:50] if (p[1] - dt.timedelta(days=p[1].weekday())).replace(hour=0) + dt.timedelta(days=7) <= mark]
    assert sorted((r["account_id"], r["ts"]) for r in late) == sorted((p[0], p[1]) for p in limit) and limit
    assert all(r["lateness_seconds"] == (mark - r["ts"]).total_seconds() for r in late)
    before = len(run.rows())
    run.feed([(1, START, 777, 5)])
    run.again()
    more = run.rows()
    assert len(more) == before + 1 and [(r["kind"], r["week_start"]) for r in more if r["followers"] == 777] == [("late", START.date())]


def test_a_later_point_replaces_an_earlier_one_over_restarts(spark, tmp_path):
    run = Run(spark, tmp_path, POINTS, lambda df: states.weekly_state(df, "7 days"))
    run.feed([(1, START + dt.timedelta(hours=5), 10, 1)])
    run.feed([(1, START + dt.timedelta(hours=4), 11, 2), (1, START + dt.timedelta(hours=5), 12, 0)])
    run.feed([(1, START + dt.timedelta(hours=5), 13, 1)])  # equal time and ordinal: the one that came last
    run.feed([(2, START + dt.timedelta(days=100), 1, 1)])
    run.again()
    assert [(r["kind"], r["account_id"], r["week_start"], r["followers"]) for r in run.rows()] == [("week", 1, START.date(), 13)]


def replay():
    """Events of 40 jobs, and how each ends."""
    minute = dt.timedelta(minutes=1)
    events, end = [], {}
    for job in range(40):
        at, status = START + job * 0.3 * minute, "pending"
        events.append((job, at, "request", None, 0))
        for k in range(job % 9):
            event = "claim" if k == 0 else "error" if job % 5 == 4 and k == 3 else "finished"
            after = states.step(status, event, "E")
            status = after[0] if after else status
            events.append((job, at + (k + 1) * minute, event, "E" if event == "error" else None, k + 1))
        events.append((job, at + 9 * minute, "claim", None, 50))  # lost, but for jobs that nobody has claimed
        end[job] = "scraping" if status == "pending" else status
    return events, end


def test_jobs_end_as_the_batch_operators_say(spark, tmp_path):
    run = Run(spark, tmp_path, EVENTS, lambda df: states.job_states(df, "EventTime"))
    events, end = replay()
    run.feed(events[: len(events) // 2])
    run.feed(events[len(events) // 2 :])
    changes = spark.read.parquet(f"{tmp_path}/out")
    before = {r["analysis_id"]: r["status"] for r in states.current(changes).collect()}
    assert before == end
    assert {r["analysis_id"] for r in changes.where("not accepted").collect()} >= {j for j in range(40) if j % 9}
    # later another job is the only news, and time is up for the first ones
    run.feed([(1000, START + dt.timedelta(minutes=40), "request", None, 0)])
    run.again()
    after = {r["analysis_id"]: (r["status"], r["status_detail"]) for r in states.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    table = spark.createDataFrame([(j, s, START + j * 0.3 * dt.timedelta(minutes=1), "") for j, s in end.items()], "analysis_id long, status string, created_at timestamp, status_detail string")
    swept = {r["analysis_id"]: r["status"] for r in lifecycle.sweep_stuck(table, START + dt.timedelta(minutes=40)).collect()}
    assert {j: s for j, (s, _) in after.items() if j < 1000} == swept and "failed" in swept.values()
    assert all(d == lifecycle.TIMED_OUT for j, (s, d) in after.items() if s == "failed" and end[j] != "failed")
    count = spark.read.parquet(f"{tmp_path}/out").count()
    run.again()
    assert spark.read.parquet(f"{tmp_path}/out").count() == count


def test_steps_are_those_of_the_batch_operator(spark):
    rows = [(i, s, "", e) for i, (s, e) in enumerate((s, e) for s in (*lifecycle.ORDER, "failed") for e in (None, "E"))]
    df = spark.createDataFrame(rows, "analysis_id int, status string, status_detail string, error string")
    for r in lifecycle.advanced(df).join(df.select("analysis_id", F.col("status").alias("before"), F.col("error").alias("e")), "analysis_id").collect():
        after = states.step(r["before"], "error" if r["e"] else "finished", r["e"])
        assert (r["status"], r["status_detail"]) == (after or (r["before"], ""))


def test_the_clock_ends_jobs_too(spark, tmp_path):
    old = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(1, old, "request", None, 0), (1, old, "claim", None, 1)], EVENTS).write.parquet(f"{tmp_path}/in")
    changes = states.job_states(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"))
    query = changes.writeStream.format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            time.sleep(1)
            found = {r["status"]: r["status_detail"] for r in spark.table("jobs").collect()}
            if "failed" in found:
                break
    finally:
        query.stop()
    assert found["failed"] == lifecycle.TIMED_OUT and "scraping" in found
