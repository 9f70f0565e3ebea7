"""Keyed state with timers (transformWithState): weekly snapshots that close with event time, and the life of analyses.

State is in RocksDB, which use() chooses for a session: it holds more keys than memory does, and keeps changes only.

The key of the state is a lane, a hash bucket of accounts or jobs: what a lane holds is one Arrow table, so that a batch
costs a few calls to the store for each lane it touches, not for each account, and its rows are worked on as columns.  A
lane has one timer, the earliest of its rows.  Choose the number of lanes so that one of them fits a Python worker some
times over; a checkpoint keeps it.

Weeks: a lane's open weeks are a row each, the latest point by (ts, ordinal).  A week closes when the watermark,
`delay` behind the newest point of any account, passes its end; then the timer of the lane emits it once and drops it.
A point of a week that has closed comes out as late, with how far behind the watermark it is, instead of vanishing.
The column that makes the watermark is dropped before the state, as Spark would discard by it points of open weeks.

Jobs: an analysis is its status and its deadline.  Requests, claims, finished stages and errors arrive as events; what they
make of the status is as in operators.lifecycle, and a job still running STUCK_MINUTES after its creation is failed by a
timer, so no scan of all jobs looks for it; one that is claimed later than that fails at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import STUCK_MINUTES
from ..operators.lifecycle import DETAILS, ORDER, RUNNING, TIMED_OUT

WEEK_MS = 7 * 86_400_000
#: The first Monday after 1970 began, in milliseconds.
MONDAY_MS = 4 * 86_400_000
LANES = 1024
#: Rows of a batch for which one partition of the state is enough; points that wait until they are joined to a lane's weeks.
PARTITION_ROWS, WAITING_ROWS = 500_000, 100_000
#: Later than any time, earlier than any ordinal.
NEVER, FIRST = (1 << 63) - 1, -(1 << 63)


def use(spark: SparkSession) -> None:
    """Keep the state of this session's queries in RocksDB, changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def partitions_for(rows: int, cores: int) -> int:
    """Partitions of the state for batches of so many rows.  Each costs a Python worker's start, a load and a commit in
    every batch, with rows or without, so their number follows from the rows, not from what shuffles of tables need."""
    return min(LANES, max(cores, -(-rows // PARTITION_ROWS)))


def started(writer: DataStreamWriter, spark: SparkSession, partitions: int) -> StreamingQuery:
    """Starts a query whose state has so many partitions, if it is new; a checkpoint keeps the number it began with.  The
    session's own number holds again afterwards, as a stream has a copy of its settings."""
    name = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(name)
    spark.conf.set(name, partitions)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, kept)


def lane(key: str, lanes: int) -> Column:
    """The lane of a key; null has one of its own, so that no other key meets it."""
    return F.when(F.col(key).isNull(), F.lit(lanes)).otherwise(F.pmod(F.xxhash64(key), F.lit(lanes))).cast("int").alias("lane")


def _whole(rows: DataFrame, key: str) -> Column:
    """A key that pandas keeps exact: numbers with nulls among them would be doubles.  The lane tells a null from a 0."""
    kind = rows.schema[key].dataType
    return F.coalesce(F.col(key), F.lit(0).cast(kind)).alias(key) if isinstance(kind, T.NumericType) else F.col(key)


def _restored(key: str, lanes: int) -> Column:
    return F.when(F.col("lane") != lanes, F.col(key)).alias(key)


class _Lane:
    """The table of a lane and its timer: the earliest time for which one of its rows waits."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.state = handle, handle.getValueState("lane", "rows binary, timer long")

    def load(self) -> tuple[pd.DataFrame | None, int | None]:
        found = self.state.get()
        if found is None:
            return None, None
        return pa.ipc.open_stream(bytes(found[0])).read_pandas(), found[1]

    def save(self, rows: pd.DataFrame, timer: int | None, earliest: int | None) -> None:
        """timer: the one that is set; earliest: the one that should be."""
        if earliest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if earliest is not None:
                self.handle.registerTimer(earliest)
        if not len(rows):
            self.state.clear()
            return
        table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), earliest))


class _Weeks(StatefulProcessor):
    """Rows (lane, account_id, us, followers, ordinal) to (lane, kind, account_id, week_ms, followers, us, lateness_ms);
    us: microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lane = _Lane(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        weeks, timer = self.lane.load()
        waiting, n = [], 0
        for points in rows:
            week = (points["us"] // 1000 - MONDAY_MS) // WEEK_MS * WEEK_MS + MONDAY_MS
            points = points[["account_id", "us", "ordinal", "followers"]].assign(week_ms=week)
            gone = week + WEEK_MS <= watermark
            if gone.any():
                late = points[gone]
                yield self._out(key[0], "late", late, watermark - late["us"] // 1000)
                points = points[~gone]
            waiting.append(points)
            n += len(points)
            # not with each chunk, as a lane's weeks would be sorted as often as it has chunks
            if n > max(WAITING_ROWS, 0 if weeks is None else len(weeks)):
                weeks, waiting, n = self._latest(weeks, waiting), [], 0
        self._save(self._latest(weeks, waiting), timer)

    @staticmethod
    def _latest(weeks: pd.DataFrame | None, points: list[pd.DataFrame]) -> pd.DataFrame:
        """The latest row of each week of an account; equal times and ordinals stay in order: the one that came last."""
        every = pd.concat(points if weeks is None else [weeks, *points], ignore_index=True)
        order = np.lexsort((every["ordinal"].to_numpy(), every["us"].to_numpy()))
        return every.iloc[order].drop_duplicates(["account_id", "week_ms"], keep="last")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        weeks, timer = self.lane.load()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        over = weeks["week_ms"] + WEEK_MS <= timerValues.getCurrentWatermarkInMs()
        yield self._out(key[0], "week", weeks[over], None)
        self._save(weeks[~over], timer)

    def _save(self, weeks: pd.DataFrame, timer: int | None) -> None:
        self.lane.save(weeks, timer, int(weeks["week_ms"].min()) + WEEK_MS if len(weeks) else None)

    @staticmethod
    def _out(lane: int, kind: str, rows: pd.DataFrame, lateness) -> pd.DataFrame:
        late = pd.array([None] * len(rows) if lateness is None else lateness, "Int64")
        return rows[["account_id", "week_ms", "followers", "us"]].reset_index(drop=True).assign(lane=lane, kind=kind, lateness_ms=late)[["lane", "kind", "account_id", "week_ms", "followers", "us", "lateness_ms"]]

    def close(self) -> None:
        pass


def weekly_state(points: DataFrame, delay: str = "7 days", lanes: int = LANES) -> DataFrame:
    """kind, account_id, week_start, followers, ts, lateness_seconds of a stream of (account_id, ts, followers, ordinal):
    kind `week` once for each week of an account, when it closes; `late` for each point that comes after that.  Rows
    without a time or a number count for nothing; one without an ordinal is the first of its time."""
    account = points.schema["account_id"].dataType.simpleString()
    timed = points.where("ts is not null and followers is not null").select(lane("account_id", lanes), _whole(points, "account_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("followers").cast("long"), F.coalesce(F.col("ordinal").cast("long"), F.lit(FIRST)).alias("ordinal"), F.col("ts").cast("timestamp").alias("clock"))
    rows = timed.withWatermark("clock", delay).drop("clock")
    schema = f"lane int, kind string, account_id {account}, week_ms long, followers long, us long, lateness_ms long"
    out = rows.groupBy("lane").transformWithStateInPandas(_Weeks(), schema, "Append", "EventTime")
    return out.select("kind", _restored("account_id", lanes), F.to_date(F.timestamp_millis("week_ms")).alias("week_start"), "followers", F.timestamp_micros("us").alias("ts"), F.floor(F.col("lateness_ms") / 1000).alias("lateness_seconds"))


#: Statuses by number, and the status before a request: what step() makes of a number and an event.
_STATUSES = (*ORDER, "failed")
_NONE, _FAILED = len(_STATUSES), len(_STATUSES) - 1
_EVENTS = ("request", "claim", "error", "finished")


def _steps() -> np.ndarray:
    """The number of the status after an event (row: status, column: event, the last one for events that no one knows), -1
    where it has no effect."""
    after = [[step(status, event, None) for event in (*_EVENTS, "")] for status in (*_STATUSES, None)]
    return np.array([[-1 if x is None else _STATUSES.index(x[0]) for x in row] for row in after], np.int8)


class _Jobs(StatefulProcessor):
    """Rows (lane, analysis_id, ms, event, detail, ordinal) to (lane, analysis_id, ms, status, status_detail,
    accepted)."""

    def __init__(self, time: str):
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lane, self.steps = _Lane(handle), _steps()
        self.names = np.array([*_STATUSES, None], object)
        self.details = np.array([*[DETAILS.get(s, "") for s in _STATUSES], ""], object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, timer = self.lane.load()
        events = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "ordinal"], kind="stable", ignore_index=True)
        known = 0 if jobs is None else len(jobs)
        ids = events["analysis_id"] if jobs is None else pd.concat([jobs["analysis_id"], events["analysis_id"]], ignore_index=True)
        numbers, distinct = pd.factorize(ids, use_na_sentinel=False)
        status, deadline = np.full(len(distinct), _NONE, np.int8), np.full(len(distinct), NEVER)
        detail = np.full(len(distinct), "", object)
        if known:
            status[:known], deadline[:known], detail[:known] = jobs["status"], jobs["deadline"], jobs["detail"]
        own, kind = numbers[known:], events["event"].map({e: i for i, e in enumerate(_EVENTS)}).fillna(len(_EVENTS)).to_numpy(np.int8)
        ms, said = events["ms"].to_numpy(), events["detail"].fillna("").to_numpy(object)
        accepted, after, text = np.zeros(len(events), bool), np.zeros(len(events), np.int8), np.full(len(events), "", object)
        # the first events of all jobs, then the second ones, and so on
        turn = events.groupby(own).cumcount().to_numpy()
        order = np.argsort(turn, kind="stable")
        for at in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
            job = own[at]
            following = self.steps[status[job], kind[at]]
            done = following >= 0
            begun = done & (status[job] == _NONE)
            timed = begun & ~np.isnan(ms[at].astype(float))
            deadline[job[timed]] = ms[at][timed].astype(np.int64) + STUCK_MINUTES * 60_000
            detail[job[done]] = np.where(following[done] == _FAILED, said[at][done], self.details[following[done]])
            status[job[done]] = following[done]
            accepted[at], after[at], text[at] = done, status[job], detail[job]
        yield pd.DataFrame({"lane": key[0], "analysis_id": events["analysis_id"], "ms": pd.array(ms, "Int64"), "status": self.names[after], "status_detail": text, "accepted": accepted})
        there = status != _NONE
        jobs = pd.DataFrame({"analysis_id": distinct[there], "status": status[there], "detail": detail[there], "deadline": deadline[there]})
        # a timer in the past would not be called; what fails now comes after the job's events
        last = pd.Series(ms).groupby(own).max().reindex(range(len(distinct)), fill_value=0).fillna(0).to_numpy(np.int64)
        yield self._failed(key[0], jobs, self._now(timerValues), last[there])
        self._save(jobs, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, timer = self.lane.load()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        yield self._failed(key[0], jobs, self._now(timerValues), 0)
        self._save(jobs, timer)

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.time == "EventTime" else timerValues.getCurrentProcessingTimeInMs()

    def _failed(self, lane: int, jobs: pd.DataFrame, now: int, last) -> pd.DataFrame:
        """Marks the jobs whose time is over, and returns their changes, not before `last`."""
        over = self._runs(jobs) & (jobs["deadline"] <= now)
        at = np.maximum(jobs["deadline"], last)[over].reset_index(drop=True)
        jobs.loc[over, ["status", "detail"]] = (_FAILED, TIMED_OUT)
        return pd.DataFrame({"lane": lane, "analysis_id": jobs["analysis_id"][over].reset_index(drop=True), "ms": at, "status": "failed", "status_detail": TIMED_OUT, "accepted": True})

    @staticmethod
    def _runs(jobs: pd.DataFrame) -> pd.Series:
        return jobs["status"].between(_STATUSES.index(RUNNING[0]), _STATUSES.index(RUNNING[-1])) & (jobs["deadline"] < NEVER)

    def _save(self, jobs: pd.DataFrame, timer: int | None) -> None:
        waiting = jobs["deadline"][self._runs(jobs)]
        self.lane.save(jobs, timer, int(waiting.min()) if len(waiting) else None)

    def close(self) -> None:
        pass


def step(status: str | None, event: str, detail: str | None) -> tuple[str, str] | None:
    """Status and detail after an event, None if it has no effect: requests make pending jobs, only a pending job can be
    claimed, a running one finishes its stage or fails, and what is over stays."""
    if event == "request" and status is None:
        return "pending", ""
    if event == "claim" and status == "pending":
        return RUNNING[0], DETAILS[RUNNING[0]]
    if event == "error" and status in RUNNING:
        return "failed", detail or ""
    if event == "finished" and status in RUNNING:
        following = ORDER[ORDER.index(status) + 1]
        return following, DETAILS[following]
    return None


def job_states(events: DataFrame, time: str = "ProcessingTime", delay: str = "0 seconds", lanes: int = LANES) -> DataFrame:
    """analysis_id, at, status, status_detail, accepted after each event of a stream of (analysis_id, at, event, detail,
    ordinal), and when a job's time is over.  accepted: whether the event had an effect; of two claims only the first has.
    Timers go by the clock, or with time="EventTime" by what the events say, for replays."""
    job = events.schema["analysis_id"].dataType.simpleString()
    rows = events.select(lane("analysis_id", lanes), _whole(events, "analysis_id"), F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), "event", "detail", F.col("ordinal").cast("long"), F.col("at").cast("timestamp").alias("clock"))
    rows = (rows.withWatermark("clock", delay) if time == "EventTime" else rows).drop("clock")
    schema = f"lane int, analysis_id {job}, ms long, status string, status_detail string, accepted boolean"
    out = rows.groupBy("lane").transformWithStateInPandas(_Jobs(time), schema, "Append", time)
    return out.select(_restored("analysis_id", lanes), F.timestamp_millis("ms").alias("at"), "status", "status_detail", "accepted")


def current(changes: DataFrame) -> DataFrame:
    """The last status of each job of a table of accepted changes."""
    order = F.struct("at", F.element_at(F.create_map(*[x for i, s in enumerate((*ORDER, "failed")) for x in (F.lit(s), F.lit(i))]), F.col("status")))
    return changes.where("accepted").groupBy("analysis_id").agg(F.max_by(F.struct("status", "status_detail"), order).alias("s")).select("analysis_id", "s.*")
