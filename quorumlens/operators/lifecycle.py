"""The life of an analysis: claims, sweeps and status changes as functions over the state table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import STATUSES, STUCK_MINUTES

ORDER = STATUSES[:-1]
RUNNING = ORDER[1:-1]
# Fixed value: the application's text.
TIMED_OUT = "Timed out — the worker stopped before finishing."


def next_pending(analyses: DataFrame) -> DataFrame:
    """The oldest pending analysis (ties: smaller id), at most one row."""
    return analyses.where("status = 'pending'").orderBy("created_at", "analysis_id").limit(1)


def claim(analyses: DataFrame, analysis_id) -> DataFrame:
    """Compare and set: pending becomes scraping; a row that isn't pending any more stays, and the claim is lost.  won:
    whether it was won, null for the rows that weren't asked for."""
    asked = F.col("analysis_id") == analysis_id
    won = F.when(asked, F.col("status") == "pending")
    return analyses.withColumn("won", won).withColumn("status", F.when(F.coalesce("won", F.lit(False)), F.lit("scraping")).otherwise(F.col("status")))


def sweep_stuck(analyses: DataFrame, now) -> DataFrame:
    """Running analyses created over STUCK_MINUTES ago have failed.  As in the application this goes by creation, so one
    that queued long and has just begun fails too."""
    stuck = F.col("status").isin(*RUNNING) & (F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {STUCK_MINUTES} minutes"))
    detail = F.when(stuck, F.lit(TIMED_OUT)).otherwise(F.col("status_detail"))
    return analyses.withColumn("status_detail", detail).withColumn("status", F.when(stuck, F.lit("failed")).otherwise(F.col("status")))


# The details of each status.
DETAILS = {
    "scraping": "Scraping profiles, posts, and historical growth...",
    "categorizing": "Classifying post content...",
    "computing": "Computing metrics...",
    "synthesizing": "Synthesizing insights...",
    "rendering": "Rendering reports...",
    "done": "Complete.",
}


def advanced(analyses: DataFrame, error: str = "error") -> DataFrame:
    """analyses after one stage each: the next status with its detail, `failed` with the message where a running one has an
    error; pending, final and unknown ones stay."""
    following = dict(zip(RUNNING, ORDER[2:], strict=True))
    after = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
    details = F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair])
    runs = F.col("status").isin(*RUNNING)
    status = F.when(runs & F.col(error).isNotNull(), F.lit("failed")).when(runs, F.element_at(after, F.col("status"))).otherwise(F.col("status"))
    detail = F.when(runs & F.col(error).isNotNull(), F.col(error)).when(runs, F.element_at(details, F.col("__next"))).otherwise(F.col("status_detail"))
    return analyses.withColumn("__next", status).withColumn("status_detail", detail).withColumn("status", F.col("__next")).drop("__next")


def advance(status: str, error: str | None = None) -> str:
    """The status after a stage; any running stage may fail."""
    if error is not None:
        return "failed"
    if status not in ORDER[:-1]:
        raise ValueError(f"{status} is final or unknown")
    return ORDER[ORDER.index(status) + 1]
