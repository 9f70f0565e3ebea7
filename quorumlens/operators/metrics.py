"""Account metrics: one aggregation of posts per account, joined to accounts, ranked within (analysis, platform).

Inputs: accounts (account_id, analysis_id, handle, platform, role, followers), posts (account_id, likes, comments, shares,
media_type, category_key), categories (category_key, category).  Measures are integers, so sums are exact and every
average is one division.  Posts are read once per result and pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import COLLAB, GROWTH_GAP, WINDOW_DAYS, js_round, low_sample, ratio

#: Accounts are compared within one platform of one analysis: a handful of rows, so no window is large.
GROUP = ("analysis_id", "platform")


def engagement() -> Column:
    """Likes and comments; shares don't count here."""
    return F.col("likes").cast("bigint") + F.col("comments").cast("bigint")


def _mean(total: str, n: str) -> Column:
    """0 for nothing."""
    return F.coalesce(ratio(F.coalesce(F.col(total), F.lit(0)), F.coalesce(F.col(n), F.lit(0))), F.lit(0.0))


def post_sums(posts: DataFrame) -> DataFrame:
    """One row per account that has posts."""
    return posts.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("likes").cast("bigint")).alias("likes"), F.sum(F.col("comments").cast("bigint")).alias("comments"),
        F.sum(F.col("shares").cast("bigint")).alias("shares"), F.count("shares").alias("n_shares"),
    )


def account_averages(accounts: DataFrame, sums: DataFrame) -> DataFrame:
    """Every account, also those without posts, with unrounded averages; sums are post_sums."""
    joined = accounts.join(sums, "account_id", "left")
    return joined.select(
        "account_id", "analysis_id", "handle", "platform", "role",
        F.coalesce(F.col("followers").cast("bigint"), F.lit(0)).alias("followers"),
        F.coalesce(F.col("n"), F.lit(0)).alias("post_count"),
        _mean("likes", "n").alias("raw_likes"), _mean("comments", "n").alias("raw_comments"),
        ratio(F.col("shares"), F.col("n_shares")).alias("raw_shares"),
    )


def percentile(value: str, partition: Sequence[str]) -> Column:
    """round(100 * share of the group at or below the value): a window, never a comparison of all with all."""
    upto = Window.partitionBy(*partition).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*partition)
    return F.floor(F.lit(100.0) * F.count(F.lit(1)).over(upto) / F.count(F.lit(1)).over(whole) + 0.5).cast("bigint")


def account_metrics(accounts: DataFrame, posts: DataFrame, window_days: int = WINDOW_DAYS, partition: Sequence[str] = GROUP) -> DataFrame:
    """The scalar metrics, with percentiles of the rounded values."""
    return metrics_of_sums(accounts, post_sums(posts), window_days, partition)


def metrics_of_sums(accounts: DataFrame, sums: DataFrame, window_days: int = WINDOW_DAYS, partition: Sequence[str] = GROUP) -> DataFrame:
    """account_metrics from post_sums."""
    interactions = F.col("raw_likes") + F.col("raw_comments")
    rate = F.coalesce(ratio(interactions + F.coalesce("raw_shares", F.lit(0.0)), F.col("followers")), F.lit(0.0))
    rows = account_averages(accounts, sums).select(
        "account_id", "analysis_id", "handle", "platform", "role", "followers", "post_count",
        js_round(F.col("raw_likes")).alias("avg_likes"), js_round(F.col("raw_comments")).alias("avg_comments"), js_round(F.col("raw_shares")).alias("avg_shares"),
        js_round(rate, 4).alias("engagement_rate"),
        js_round(F.col("post_count") / F.lit(window_days / 7)).alias("posts_per_week"),
        js_round(interactions).alias("baseline_engagement"),
        low_sample(F.col("followers"), interactions).alias("low_sample_warning"),
    )
    for name, value in (("engagement_rate_percentile", "engagement_rate"), ("followers_percentile", "followers"), ("avg_likes_percentile", "avg_likes")):
        rows = rows.withColumn(name, percentile(value, partition))
    return rows


def with_category(posts: DataFrame, categories: DataFrame) -> DataFrame:
    """Posts with category, null for those without."""
    return posts.join(categories, "category_key", "left")


def media_breakdown(posts: DataFrame) -> DataFrame:
    grouped = posts.groupBy("account_id", F.coalesce("media_type", F.lit("unknown")).alias("media_type"))
    return grouped.agg(F.count(F.lit(1)).alias("post_count"), F.sum(engagement()).alias("e")).select("account_id", "media_type", "post_count", js_round(F.col("e") / F.col("post_count")).alias("avg_engagement"))


def category_breakdown(categorised: DataFrame, missing: str | None = None) -> DataFrame:
    """Per account and category, against the account's mean over all posts; `missing` names the bucket of posts without
    category (None: they count in the mean only).

    Pre-aggregated to one row per account and category; the account's mean is then a sum over those rows."""
    label = F.coalesce("category", F.lit(missing)) if missing else F.col("category")
    sums = categorised.groupBy("account_id", label.alias("category")).agg(F.count(F.lit(1)).alias("post_count"), F.sum(engagement()).alias("e"))
    account = Window.partitionBy("account_id")
    sums = sums.withColumn("mean", F.col("e") / F.col("post_count")).withColumn("baseline", F.sum("e").over(account) / F.sum("post_count").over(account))
    return sums.where(F.col("category").isNotNull()).select("account_id", "category", "post_count", js_round(F.col("mean")).alias("avg_engagement"), js_round(ratio(F.col("mean"), F.col("baseline"))).alias("vs_baseline_multiplier"))


def collaboration(accounts: DataFrame, categorised: DataFrame) -> DataFrame:
    """Cadence and uplift of collaborations and paid promotions."""
    is_collab = F.col("category").isin(*COLLAB)
    sums = categorised.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(engagement()).alias("e"), F.count_if(F.coalesce(is_collab, F.lit(False))).alias("c"), F.sum(F.when(is_collab, engagement())).alias("ce")
    )
    return collaboration_of_sums(accounts, sums)


def collaboration_of_sums(accounts: DataFrame, sums: DataFrame) -> DataFrame:
    """collaboration from sums of n posts with engagement e, c and ce of them collaborations."""
    rows = accounts.select("account_id").join(sums, "account_id", "left").withColumn("mean", _mean("ce", "c")).withColumn("baseline", _mean("e", "n"))
    multiplier = F.when(F.col("c") > 0, ratio(F.col("mean"), F.col("baseline")))
    return rows.select("account_id", F.coalesce("c", F.lit(0)).alias("post_count"), js_round(F.col("mean")).alias("avg_engagement"), js_round(multiplier).alias("vs_baseline_multiplier"))


def nested_metrics(accounts: DataFrame, posts: DataFrame, categories: DataFrame, growth: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """The full record of an account, with maps of breakdowns and the list of weeks (for reports; not for hashing).

    growth: account_id, weekly_growth, cumulative_growth_pct, growth_data_gap of accounts that have snapshots.  Posts are
    read and shuffled once, as sums by account, media type and category, which each part sums up further."""
    sums = with_category(posts, categories).groupBy("account_id", "media_type", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("likes").cast("bigint")).alias("likes"), F.sum(F.col("comments").cast("bigint")).alias("comments"),
        F.sum(F.col("shares").cast("bigint")).alias("shares"), F.count("shares").alias("n_shares"), F.sum(engagement()).alias("e"),
    )
    is_collab = F.coalesce(F.col("category").isin(*COLLAB), F.lit(False))
    total = sums.groupBy("account_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "likes", "comments", "shares", "n_shares", "e")], F.sum(F.when(is_collab, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(is_collab, F.col("e"))).alias("ce")
    )
    named = F.coalesce("media_type", F.lit("unknown")).alias("media_type")
    media = sums.groupBy("account_id", named).agg(F.sum("n").alias("post_count"), F.sum("e").alias("e")).select("account_id", "media_type", "post_count", js_round(F.col("e") / F.col("post_count")).alias("avg_engagement"))
    own = sums.where("category is not null").groupBy("account_id", "category").agg(F.sum("n").alias("post_count"), F.sum("e").alias("own"))
    cats = own.join(total.select("account_id", (F.col("e") / F.col("n")).alias("baseline")), "account_id").withColumn("mean", F.col("own") / F.col("post_count"))
    cats = cats.select("account_id", "category", "post_count", js_round(F.col("mean")).alias("avg_engagement"), js_round(ratio(F.col("mean"), F.col("baseline"))).alias("vs_baseline_multiplier"))

    def as_map(rows: DataFrame, key: str, name: str) -> DataFrame:
        values = F.struct(*[c for c in rows.columns if c not in ("account_id", key)])
        return rows.groupBy("account_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, values)))).alias(name))

    cadence = F.struct("post_count", "avg_engagement", "vs_baseline_multiplier").alias("collaboration_cadence")
    out = metrics_of_sums(accounts, total, window_days)
    for part in (growth, as_map(media, "media_type", "media_type_breakdown"), as_map(cats, "category", "category_breakdown"), collaboration_of_sums(accounts, total).select("account_id", cadence)):
        out = out.join(part, "account_id", "left")
    return out.withColumn("growth_data_gap", F.when(F.col("weekly_growth").isNull(), F.lit(GROWTH_GAP)).otherwise(F.col("growth_data_gap")))
