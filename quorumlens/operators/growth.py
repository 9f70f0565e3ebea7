"""Follower growth from weekly snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import GROWTH_GAP, js_round, monday, ratio


def weekly_snapshots(points: DataFrame, key: Sequence[str] = ("account_id",)) -> DataFrame:
    """key, week_start, followers: the latest of (ts, followers, ordinal) in each Monday week; equal times: the later ordinal.

    max_by over a struct aggregates before the shuffle, unlike a numbered window."""
    latest = F.max_by("followers", F.struct("ts", "ordinal")).alias("followers")
    return points.where("ts is not null and followers is not null").groupBy(*key, monday(F.col("ts")).alias("week_start")).agg(latest)


def since(snapshots: DataFrame, as_of, window_days: int) -> DataFrame:
    """Snapshots from the Monday of (as_of - window) on."""
    return snapshots.where(F.col("week_start") >= monday(F.lit(as_of).cast("timestamp") - F.expr(f"interval {window_days} days")))


def weekly_growth(snapshots: DataFrame) -> DataFrame:
    """account_id, week_start, followers, growth_pct against the previous week there is."""
    before = F.lag("followers").over(Window.partitionBy("account_id").orderBy("week_start"))
    pct = js_round(ratio(F.col("followers") - F.col("before"), F.col("before")) * 100)
    return snapshots.withColumn("before", before).select("account_id", "week_start", "followers", pct.alias("growth_pct"))


def cumulative_growth(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """account_id, n_weeks, cumulative_growth_pct, growth_data_gap of every account."""
    ends = snapshots.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("followers", "week_start").alias("first"), F.max_by("followers", "week_start").alias("last"))
    n = F.coalesce("n", F.lit(0))
    pct = F.when(n >= 2, js_round(ratio(F.col("last") - F.col("first"), F.col("first")) * 100))
    return accounts.select("account_id").join(ends, "account_id", "left").select("account_id", n.alias("n_weeks"), pct.alias("cumulative_growth_pct"), F.when(n < 2, F.lit(GROWTH_GAP)).alias("growth_data_gap"))


def growth_lists(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """cumulative_growth with the sorted list of weeks."""
    weeks = weekly_growth(snapshots).groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("week_start", "followers", "growth_pct"))).alias("weekly_growth"))
    return cumulative_growth(accounts, snapshots).join(weeks, "account_id", "left").drop("n_weeks")
