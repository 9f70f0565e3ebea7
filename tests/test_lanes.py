"""State by lanes: calls to the store don't grow with the keys of a lane, and keys of a lane don't meet."""

import datetime as dt

import pandas as pd
import pytest

from quorumlens.operators import lifecycle
from quorumlens.streaming import states

from .test_states import EVENTS, POINTS, START, Run, rocks  # noqa: F401


class Store:
    """What a processor asks of its handle and of its one state, and of the clock; calls are counted."""

    def __init__(self):
        self.value, self.timers, self.calls, self.now = None, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return min(self.timers)


@pytest.mark.parametrize("n", [3, 3000])
def test_jobs_of_a_lane_cost_few_calls(n):
    store, jobs = Store(), states._Jobs("EventTime")
    jobs.init(store)
    rows = pd.DataFrame([(0, j, j + k, ("request", "claim")[k], None, k) for j in range(n) for k in range(2)], columns=["lane", "analysis_id", "ms", "event", "detail", "ordinal"])
    out = pd.concat(jobs.handleInputRows((0,), iter([rows[:n], rows[n:]]), store))
    assert len(out) == 2 * n and out["accepted"].all() and store.calls <= 3 and store.timers == {states.STUCK_MINUTES * 60_000}
    store.calls, store.now = 0, states.STUCK_MINUTES * 60_000 + n // 3  # a part of them
    out = pd.concat(jobs.handleExpiredTimer((0,), store, store))
    assert sorted(out["analysis_id"]) == list(range(n // 3 + 1)) and set(out["status"]) == {"failed"} and store.calls <= 4
    assert store.timers == {store.now + 1}


@pytest.mark.parametrize("n", [3, 3000])
def test_weeks_of_a_lane_cost_few_calls(n):
    store, weeks = Store(), states._Weeks()
    weeks.init(store)
    rows = pd.DataFrame([(0, a, 1000 * (states.MONDAY_MS + w * states.WEEK_MS + a), 10 * a + w, 0) for w in range(2) for a in range(n)], columns=["lane", "account_id", "us", "followers", "ordinal"])
    assert not list(weeks.handleInputRows((0,), iter([rows[:n], rows[n:]]), store)) and store.calls <= 3
    store.calls, store.now = 0, states.MONDAY_MS + states.WEEK_MS
    out = pd.concat(weeks.handleExpiredTimer((0,), store, store))
    assert sorted(out["followers"]) == [10 * a for a in range(n)] and store.calls <= 4 and store.timers == {states.MONDAY_MS + 2 * states.WEEK_MS}


def test_a_job_that_is_claimed_too_late_fails(spark, tmp_path):
    run = Run(spark, tmp_path, EVENTS, lambda df: states.job_states(df, "EventTime", lanes=2))
    big = (1 << 62) + 1
    run.feed([(big, START, "request", None, 0), (None, START, "request", None, 0), (5, START, "request", None, 0)])
    run.feed([(1, START + dt.timedelta(hours=2), "request", None, 0)])
    run.feed([(big, START + dt.timedelta(hours=3), "claim", None, 1), (7, START, "error", "no such job", 0)])
    run.feed([(1, START + dt.timedelta(hours=4), "tick", None, 0)])
    ends = {r["analysis_id"]: (r["status"], r["status_detail"]) for r in states.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert ends == {big: ("failed", lifecycle.TIMED_OUT), None: ("pending", ""), 5: ("pending", ""), 1: ("pending", "")}


def test_points_without_an_ordinal_come_first(spark, tmp_path):
    run = Run(spark, tmp_path, POINTS, lambda df: states.weekly_state(df, "7 days", lanes=1))
    run.feed([(1, START, 10, None), (1, START, 11, -5), (None, START, 3, None), ((1 << 62) + 1, START, 4, 0), (1 << 62, START, 5, 0)])
    run.feed([(2, START + dt.timedelta(days=100), 1, 1)])
    run.again()
    assert {(r["account_id"], r["followers"]) for r in run.rows()} == {(1, 11), (None, 3), ((1 << 62) + 1, 4), (1 << 62, 5)}
