"""Datasets behind charts, the scoreboard and the status page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number_text, to_fixed
from .metrics import GROUP


def upper_median(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, median: the value at place floor(n / 2) of the sorted values."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = df.withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.where(F.expr("__r = __n div 2 + 1")).select(*by, F.col(value).alias("median"))


def landscape(metrics: DataFrame) -> DataFrame:
    """Followers against engagement rate in percent, with the upper medians of both."""
    rows = metrics.select(*GROUP, "handle", "followers", (F.col("engagement_rate") * 100).alias("rate_pct"), (F.col("role") == "target").alias("is_target"))
    for value, name in (("followers", "median_followers"), ("rate_pct", "median_rate_pct")):
        ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(value, "handle"))
        whole = Window.partitionBy(*GROUP)
        rows = rows.withColumn("__r", ranked).withColumn("__n", F.count(F.lit(1)).over(whole))
        rows = rows.withColumn(name, F.max(F.when(F.expr("__r = __n div 2 + 1"), F.col(value))).over(whole)).drop("__r", "__n")
    return rows


def _placed(rows: DataFrame, by: str) -> DataFrame:
    """rows with their position within analysis and platform, in order of `by`."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*GROUP).orderBy(by)))


def weekly_series(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """analysis_id, platform, position, week_start, followers: a row for each week that any account of the group has, in
    order; followers is a map by handle, in which an account without that week isn't."""
    rows = snapshots.join(accounts.select("account_id", *GROUP, "handle"), "account_id")
    series = rows.groupBy(*GROUP, "week_start").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("handle", "followers")))).alias("followers"))
    return _placed(series, "week_start").select(*GROUP, "position", "week_start", "followers")


def media_series(accounts: DataFrame, breakdown: DataFrame) -> DataFrame:
    """analysis_id, platform, position, media_type, avg_engagement: a row for each type that any account of the group has,
    in order; avg_engagement is a map by handle, 0 for an account without that type."""
    handles = accounts.groupBy(*GROUP).agg(F.array_sort(F.collect_set("handle")).alias("handles"))
    rows = breakdown.join(accounts.select("account_id", *GROUP, "handle"), "account_id")
    have = rows.groupBy(*GROUP, "media_type").agg(F.map_from_entries(F.collect_list(F.struct("handle", "avg_engagement"))).alias("have"))
    dense = F.map_from_arrays("handles", F.transform("handles", lambda h: F.coalesce(F.try_element_at("have", h), F.lit(0.0))))
    return _placed(have.join(handles, list(GROUP)), "media_type").select(*GROUP, "position", "media_type", dense.alias("avg_engagement"))


def category_dots(metrics: DataFrame, breakdown: DataFrame) -> DataFrame:
    """handle, category, avg_engagement, baseline: no `other`, accounts with a baseline above 0 only."""
    base = metrics.where("baseline_engagement > 0").select("account_id", *GROUP, "handle", "baseline_engagement")
    return breakdown.where("category <> 'other'").join(base, "account_id").select(*GROUP, "handle", "category", "avg_engagement", "baseline_engagement")


def scoreboard(metrics: DataFrame, cumulative: DataFrame) -> DataFrame:
    """One printed line per account, as the page has it; the target is starred.  A growth that can't be computed is a gap."""
    rows = metrics.join(cumulative, "account_id", "left")
    printed = lambda x, digits: F.concat(to_fixed(x, digits), F.lit("%"))
    ranked = lambda text, p: F.concat(text, F.lit(" (p"), F.col(p).cast("string"), F.lit(")"))
    growth = F.when(F.col("cumulative_growth_pct").isNotNull(), printed(F.col("cumulative_growth_pct"), 1)).otherwise(F.lit("data gap"))
    return rows.select(
        *GROUP, F.concat(F.when(F.col("role") == "target", F.lit("★ ")).otherwise(F.lit("")), F.col("handle")).alias("account"),
        ranked(F.format_number("followers", 0), "followers_percentile").alias("followers"), growth.alias("growth"),
        ranked(printed(F.col("engagement_rate") * 100, 2), "engagement_rate_percentile").alias("rate"), F.col("low_sample_warning").isNotNull().alias("low_sample"),
        number_text(F.col("avg_likes")).alias("avg_likes"), number_text(F.col("avg_comments")).alias("avg_comments"), number_text(F.col("posts_per_week")).alias("posts_per_week"),
    )


def footnotes(metrics: DataFrame, cumulative: DataFrame) -> DataFrame:
    """analysis_id, platform, low_sample_handles (in order of handle), growth_gap (of the first account that has one)."""
    rows = metrics.join(cumulative.select("account_id", "growth_data_gap"), "account_id", "left")
    low = F.array_join(F.array_sort(F.collect_list(F.when(F.col("low_sample_warning").isNotNull(), F.col("handle")))), ", ")
    return rows.groupBy(*GROUP).agg(low.alias("low_sample_handles"), F.min_by("growth_data_gap", F.when(F.col("growth_data_gap").isNotNull(), F.col("handle"))).alias("growth_gap"))


def cadence_lines(metrics: DataFrame, collab: DataFrame) -> DataFrame:
    """handle and its collaboration line as printed."""
    rows = metrics.select("account_id", *GROUP, "handle").join(collab, "account_id")
    uplift = F.when(F.col("vs_baseline_multiplier").isNotNull(), F.concat(F.lit(", "), number_text(F.col("vs_baseline_multiplier")), F.lit("x baseline engagement"))).otherwise(F.lit(" (no baseline comparison available)"))
    return rows.select(*GROUP, "handle", F.concat(F.col("post_count").cast("string"), F.lit(" collaboration/paid posts"), uplift).alias("line"))


def volume_quality(metrics: DataFrame) -> DataFrame:
    """Earlier prototype: posts per week against average likes with upper medians."""
    rows = metrics.select(*GROUP, "handle", "posts_per_week", "avg_likes")
    a = upper_median(rows, "posts_per_week", GROUP).withColumnRenamed("median", "median_posts_per_week")
    b = upper_median(rows, "avg_likes", GROUP).withColumnRenamed("median", "median_avg_likes")
    return rows.join(a, list(GROUP)).join(b, list(GROUP))


def detailed_page(scores: DataFrame, notes: DataFrame, lines: DataFrame, insights: DataFrame) -> DataFrame:
    """The detailed report, one row per analysis and platform (`all` last): the lists that the page prints, in order of
    handle.  insights: analysis_id, platform and the three lists."""
    score = F.struct("account", *[c for c in scores.columns if c not in (*GROUP, "account")])
    boards = scores.groupBy(*GROUP).agg(F.sort_array(F.collect_list(score)).alias("scoreboard"))
    cadence = lines.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.concat("handle", F.lit(": "), "line"))).alias("cadence"))
    return insights.join(boards, list(GROUP), "left").join(notes, list(GROUP), "left").join(cadence, list(GROUP), "left")


def status(analyses: DataFrame, reports: DataFrame, analysis_id) -> DataFrame:
    """The status page: the analysis with its reports; no row: not found."""
    listed = reports.where(F.col("analysis_id") == analysis_id).select("analysis_id", F.struct("report_type", "pdf_url").alias("r"))
    listed = listed.groupBy("analysis_id").agg(F.array_sort(F.collect_list("r")).alias("reports"))
    return analyses.where(F.col("analysis_id") == analysis_id).join(listed, "analysis_id", "left")
