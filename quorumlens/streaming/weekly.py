"""Structured Streaming forms: weekly snapshots of a stream of daily points, and a request queue.

Weekly windows begin on Mondays (epoch was a Thursday, hence the shift by four days)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import Buckets
from ..operators.upsert import last_per_key


def weekly_stream(points: DataFrame, delay: str = "7 days") -> DataFrame:
    """account_id, week_start, followers of a stream of (account_id, ts, followers, ordinal): the latest point of each
    week, ties to the later ordinal; points over `delay` behind the newest are late and dropped."""
    timed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    week = F.window("ts", "7 days", "7 days", "4 days")
    grouped = timed.groupBy("account_id", week.alias("w")).agg(F.max_by("followers", F.struct("ts", "ordinal")).alias("followers"))
    return grouped.select("account_id", F.to_date("w.start").alias("week_start"), "followers")


def into_table(stream: DataFrame, table: Buckets, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merges each micro-batch into the table, so that only the buckets of its keys are read and written; a batch that is
    run again changes nothing.  A batch that holds a key twice is reduced to the greatest of the other columns."""

    def write(batch: DataFrame, number: int) -> None:
        own = Buckets(batch.sparkSession, table.path, table.schema, table.keys, table.number)
        own.merge(last_per_key(batch, table.keys, [F.col(c) for c in batch.columns if c not in table.keys]))

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def serve(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """The worker loop: every five seconds, or once for schedulers, what is new in the request folder goes to handle."""
    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
