"""Work on a lane grows with its points, and partitions of the state follow from the rows of a batch."""

import os

import pandas as pd

from quorumlens.plans import queries
from quorumlens.plans.binding import Domain
from quorumlens.streaming import states

from .test_lanes import Store


def rows_sorted(monkeypatch, chunks, size=2000):
    """Rows that were looked through for the latest ones, of a lane whose accounts come in so many chunks."""
    seen, plain = [], pd.DataFrame.drop_duplicates
    monkeypatch.setattr(pd.DataFrame, "drop_duplicates", lambda df, *a, **k: seen.append(len(df)) or plain(df, *a, **k))
    store, weeks = Store(), states._Weeks()
    weeks.init(store)
    rows = pd.DataFrame([(0, a, 1000 * states.MONDAY_MS + a, a, 0) for a in range(chunks * size)], columns=["lane", "account_id", "us", "followers", "ordinal"])
    assert not list(weeks.handleInputRows((0,), (rows[i : i + size] for i in range(0, len(rows), size)), store))
    assert len(weeks.lane.load()[0]) == len(rows)
    monkeypatch.undo()
    return sum(seen)


def test_a_lane_is_sorted_in_proportion_to_its_points(monkeypatch):
    assert rows_sorted(monkeypatch, 160) <= 4 * 160 * 2000
    assert rows_sorted(monkeypatch, 4) <= 2 * 4 * 2000


def test_chunks_that_wait_keep_the_order_of_equal_points(monkeypatch):
    monkeypatch.setattr(states, "WAITING_ROWS", 3)
    store, weeks = Store(), states._Weeks()
    weeks.init(store)
    at = 1000 * states.MONDAY_MS
    rows = [(0, 1, at + 5, 10, 1), (0, 1, at + 4, 11, 9), (0, 2, at, 12, 0), (0, 1, at + 5, 13, 1), (0, 2, at, 14, -1), (0, 1, at + 5, 15, 0), (0, 2, at, 16, 0)]
    frames = [pd.DataFrame([r], columns=["lane", "account_id", "us", "followers", "ordinal"]) for r in rows]
    assert not list(weeks.handleInputRows((0,), iter(frames[:4]), store)) and not list(weeks.handleInputRows((0,), iter(frames[4:]), store))
    assert sorted(weeks.lane.load()[0]["followers"]) == [13, 16]


def test_partitions_follow_from_the_rows():
    assert [states.partitions_for(n, 12) for n in (0, 1, 12 * states.PARTITION_ROWS, 12 * states.PARTITION_ROWS + 1, 10**10)] == [12, 12, 12, 13, states.LANES]


def test_the_state_of_a_feed_has_partitions_for_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch", lambda _: f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = queries._weekly_state(Domain(spark, "/root/testdata/sf0.001"))
        assert rows.count() > 0 and spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(x.isdigit() for x in os.listdir(f"{tmp_path}/state/state/0")) == spark.sparkContext.defaultParallelism == 4
