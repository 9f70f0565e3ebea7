"""The earlier prototype's variants: other rates, a 30-day window, other rounding, percentiles over a whole analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import LEGACY_DAYS, py_round, ratio
from .metrics import account_averages, engagement, post_sums
from .requests import legacy_competitors, legacy_problem
from .upsert import upsert

RANKED = ("engagement_rate", "likes_rate", "comments_rate", "followers", "avg_likes")
# Fixed value: the prototype's text.
GROWTH_NOTE = "Follower growth requires two snapshots taken 30 days apart. This report is a single point-in-time run, so growth is not measurable yet — treat as a data gap, not a zero."


def legacy_metrics(accounts: DataFrame, posts: DataFrame, days: int = LEGACY_DAYS) -> DataFrame:
    rows = account_averages(accounts, post_sums(posts))
    rate = lambda c: F.when(F.col("followers") != 0, c / F.col("followers").cast("double")).otherwise(0.0)
    out = rows.select(
        "account_id", "analysis_id", "handle", "role", "followers", F.col("post_count").alias("post_count_30d"),
        py_round(F.col("raw_likes"), 2).alias("avg_likes"), py_round(F.col("raw_comments"), 2).alias("avg_comments"),
        py_round(rate(F.col("raw_likes") + F.col("raw_comments")), 4).alias("engagement_rate"), py_round(rate(F.col("raw_likes")), 4).alias("likes_rate"), py_round(rate(F.col("raw_comments")), 4).alias("comments_rate"),
        py_round(F.col("post_count") / F.lit(days / 7), 2).alias("posts_per_week"), F.lit(None).cast("double").alias("growth_rate"), F.lit(GROWTH_NOTE).alias("growth_rate_note"),
    )
    whole = Window.partitionBy("analysis_id")
    for name in RANKED:
        upto = whole.orderBy(name).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"{name}_percentile", py_round(F.lit(100.0) * F.count(F.lit(1)).over(upto) / F.count(F.lit(1)).over(whole)).cast("bigint"))
    return out


def legacy_categories(categorised: DataFrame) -> DataFrame:
    """As the current breakdown, with posts without category in `other` and the baseline on every row."""
    sums = categorised.groupBy("account_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("post_count"), F.sum(engagement()).alias("e"))
    account = Window.partitionBy("account_id")
    sums = sums.withColumn("mean", F.col("e") / F.col("post_count")).withColumn("baseline", F.sum("e").over(account) / F.sum("post_count").over(account))
    return sums.select("account_id", "category", "post_count", py_round(F.col("mean"), 2).alias("avg_engagement"), py_round(F.col("baseline"), 2).alias("baseline_engagement"), py_round(ratio(F.col("mean"), F.col("baseline")), 2).alias("vs_baseline_multiplier"))


def legacy_scoreboard(metrics: DataFrame) -> DataFrame:
    """Rows of the earlier report's table, and the number of competitors."""
    n = F.count(F.lit(1)).over(Window.partitionBy("analysis_id")) - 1
    return metrics.select("analysis_id", "handle", "role", "followers", "followers_percentile", "engagement_rate", "engagement_rate_percentile", "avg_likes", "avg_comments", "posts_per_week", n.alias("n_competitors"))


def followers_engagement(metrics: DataFrame) -> DataFrame:
    """Chart points; an account without followers is drawn at 1, for the logarithmic axis."""
    return metrics.select("analysis_id", "handle", F.when(F.col("followers") == 0, F.lit(1)).otherwise(F.col("followers")).cast("bigint").alias("followers"), (F.col("engagement_rate") * 100).alias("rate_pct"))


def new_analyses(forms: DataFrame) -> DataFrame:
    """A row for each form without a problem, which begins at once; fields are stored as they were entered."""
    valid = forms.where(legacy_problem().isNull())
    return valid.select(F.col("request_id").alias("analysis_id"), F.col("company").alias("company_name"), "industry", "region", F.lit("scraping").alias("status"))


def new_accounts(forms: DataFrame) -> DataFrame:
    """analysis_id, handle, role of these forms: the target as entered, then its competitors."""
    valid = forms.where(legacy_problem().isNull())
    target = F.array(F.struct(F.col("target").alias("handle"), F.lit("target").alias("role")))
    rivals = F.transform(legacy_competitors(F.col("competitors")), lambda h: F.struct(h.alias("handle"), F.lit("competitor").alias("role")))
    return valid.select(F.col("request_id").alias("analysis_id"), F.inline(F.concat(target, rivals)))


def update_profiles(accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """accounts with followers, following and bio of the profiles (account_id and these three) that were scraped, nulls too;
    accounts that don't exist aren't made."""
    known = profiles.join(accounts.select("account_id"), "account_id", "left_semi")
    return upsert(accounts, known.select("account_id", "followers", "following", "bio"), ["account_id"])


def finish(analyses: DataFrame, reports: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analyses, reports) after reports were made: each is one more row, an earlier one of its analysis stays, and its
    analysis is done."""
    done = made.select("analysis_id").distinct().withColumn("__done", F.lit(True))
    after = analyses.join(done, "analysis_id", "left").withColumn("status", F.when(F.col("__done"), "done").otherwise(F.col("status"))).drop("__done")
    return after, reports.unionByName(made.select(*reports.columns))
