"""Insights and reports from metrics: deterministic sentences where the application asks a model, or any model's.

documents() makes a JSON document of each group's metrics, produced() hands these to a callable and checks what comes back:
its kinds, and the sizes of its lists that the application asks for (it doesn't check them itself); what doesn't pass is a
row with the reason.  The sentences by rule are there twice, as columns and as such a callable, with equal results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number_text
from .metrics import GROUP
from .upsert import upsert

SIZES = {"data_observations": (3, 6), "explanations": (2, 5), "recommendations": (3, 6)}
REPORT_SIZES = {"key_findings": (3, 3), "working_content_patterns": (2, 5), "competitive_gaps": (2, 5), "experiments": (3, 5)}


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def platform_insights(metrics: DataFrame) -> DataFrame:
    """analysis_id, platform, data_observations, explanations, recommendations: one row a platform, by aggregation only."""
    s = metrics.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("handle", F.struct("engagement_rate", "handle")).alias("top"), F.max("engagement_rate").alias("rate"),
        F.max_by("handle", F.struct("followers", "handle")).alias("big"), F.max("followers").alias("followers"),
        F.count_if(F.col("low_sample_warning").isNotNull()).alias("low"), F.max_by("handle", F.struct("posts_per_week", "handle")).alias("busy"), F.max("posts_per_week").alias("cadence"),
    )
    percent = number_text(F.floor(F.col("rate") * 10000 + 0.5) / 100)
    return s.select(
        *GROUP,
        F.array(
            _say(F.col("top"), " has the highest engagement rate of ", F.col("n").cast("string"), " accounts: ", percent, "%."),
            _say(F.col("big"), " has the largest audience: ", F.format_number("followers", 0), " followers."),
            _say(F.col("low").cast("string"), " accounts carry a low-sample warning."),
        ).alias("data_observations"),
        F.array(
            _say("This may be because ", F.col("top"), " reaches a smaller, closer audience."),
            _say("A plausible driver is the cadence of ", F.col("busy"), ": ", number_text(F.col("cadence")), " posts a week."),
        ).alias("explanations"),
        F.array(
            _say("Test the formats of ", F.col("top"), "; success is a higher engagement rate."),
            _say("Test the cadence of ", F.col("busy"), "; success is more posts per week at equal average likes."),
            F.lit("Test collaborations; success is a multiplier above 1 against the baseline."),
        ).alias("recommendations"),
    )


def with_all(insights: DataFrame) -> DataFrame:
    """Platform rows and each analysis' row `all`, which is there even for a single platform: the first sentences of each,
    in order."""

    def gathered(name: str, most: int) -> Column:
        firsts = F.array_sort(F.collect_list(F.struct("platform", F.transform(name, lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("v"))))
        flat = F.flatten(F.transform(firsts, lambda r: F.transform(r["v"], lambda y: F.struct(y["i"].alias("i"), r["platform"].alias("p"), _say(r["platform"], ": ", y["x"]).alias("x")))))
        return F.slice(F.transform(F.array_sort(flat), lambda r: r["x"]), 1, most).alias(name)

    everything = insights.groupBy("analysis_id").agg(*[gathered(n, most) for n, (_, most) in SIZES.items()])
    return insights.unionByName(everything.withColumn("platform", F.lit("all")).select(*insights.columns))


def stored_insights(existing: DataFrame, insights: DataFrame) -> DataFrame:
    """The insights table after an analysis has been synthesised: one row per (analysis_id, platform), replaced if there."""
    return upsert(existing, insights, GROUP)


def customer_report(insights: DataFrame) -> DataFrame:
    """Each analysis' customer report, from its row `all`."""
    row = insights.where("platform = 'all'")

    def phase(day: int, i: int) -> Column:
        """The i-th recommendation, and what it says that success is."""
        advice = F.get("recommendations", F.lit(i))
        return F.struct(F.array(_say(f"By day {day}: ", advice)).alias("actions"), F.array(F.regexp_extract(advice, r"success is (.*)\.$", 1)).alias("success_metrics")).alias(f"day{day}")

    return row.select(
        "analysis_id", F.slice("data_observations", 1, 3).alias("key_findings"), F.slice("explanations", 1, 5).alias("working_content_patterns"), F.slice("data_observations", 2, 3).alias("competitive_gaps"),
        F.slice("recommendations", 1, 5).alias("experiments"), F.struct(phase(30, 0), phase(60, 1), phase(90, 2)).alias("plan"),
    )


def sizes_hold(df: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """df with ok: whether every list has as many entries as asked for."""
    checks = [F.size(name).between(low, high) for name, (low, high) in sizes.items()]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return df.withColumn("ok", ok)


SWOT = ("strengths", "weaknesses", "opportunities", "threats")
ADVICE = ("keep_doing", "urgent", "mid_term", "long_term")


def swot(metrics: DataFrame) -> DataFrame:
    """Earlier prototype: four lists of two about the target of each platform, and four of recommendations, each of which
    names its metric.  Opportunities and threats name the competitor that is ahead of the target, if one is."""
    most = lambda c, who: (F.max_by("handle", F.struct(c, "handle")).alias(who), F.max(c).alias(f"{who}_most"))
    rivals = metrics.where("role = 'competitor'").groupBy(*GROUP).agg(*most("followers", "big"), *most("posts_per_week", "busy"), *most("engagement_rate", "close"))
    target = metrics.where("role = 'target'").join(rivals, list(GROUP), "left")
    ahead = lambda who, c, text, none: F.when(F.col(f"{who}_most") > F.col(c), text).otherwise(F.lit(none))
    percent = number_text(F.floor(F.col("close_most") * 10000 + 0.5) / 100)
    word = lambda c, hi, lo: F.when(F.col(c) >= 50, F.lit(hi)).otherwise(F.lit(lo))
    p = lambda c: F.col(c).cast("string")
    return target.select(
        *GROUP, "handle",
        F.array(_say("Engagement percentile ", p("engagement_rate_percentile")), _say("Likes percentile ", p("avg_likes_percentile"))).alias("strengths"),
        F.array(_say("Audience percentile ", p("followers_percentile")), word("followers_percentile", "Reach is not the limit", "Reach is below the median")).alias("weaknesses"),
        F.array(
            ahead("close", "engagement_rate", _say("Learn from ", F.col("close"), ", which engages ", percent, "% of its followers"), "Build on the highest engagement rate of the platform"),
            ahead("busy", "posts_per_week", _say("Raise the cadence towards ", number_text(F.col("busy_most")), " posts a week"), "Keep the highest cadence and test other formats"),
        ).alias("opportunities"),
        F.array(
            ahead("big", "followers", _say(F.col("big"), " has a larger audience: ", F.format_number("big_most", 0), " followers"), "No competitor has a larger audience"),
            ahead("busy", "posts_per_week", _say(F.col("busy"), " posts more often: ", number_text(F.col("busy_most")), " a week"), "No competitor posts more often"),
        ).alias("threats"),
        F.array(_say("Hold the engagement rate at percentile ", p("engagement_rate_percentile")), _say("Hold average likes at ", number_text(F.col("avg_likes")))).alias("keep_doing"),
        F.array(word("engagement_rate_percentile", "Protect the engagement rate", "Raise the engagement rate"), word("avg_likes_percentile", "Protect average likes", "Raise average likes")).alias("urgent"),
        F.array(_say("Test a cadence above ", number_text(F.col("posts_per_week")), " posts per week"), F.lit("Test collaborations against the baseline engagement")).alias("mid_term"),
        F.array(_say("Grow followers beyond percentile ", p("followers_percentile")), F.lit("Measure follower growth, which is a data gap in a single run")).alias("long_term"),
    )


def ranked(lists: DataFrame, names: Sequence[str] = tuple(SIZES), keys: Sequence[str] = GROUP) -> DataFrame:
    """Long form of list columns: keys, bucket (the column), position, sentence."""

    def placed(name: str) -> Column:
        return F.transform(name, lambda x, i: F.struct(F.lit(name).alias("bucket"), i.alias("position"), x.alias("sentence")))

    entries = F.concat(*map(placed, names))
    return lists.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def report_lines(report: DataFrame) -> DataFrame:
    """Long form of customer reports: analysis_id, bucket, position, sentence; the plan's phases are buckets too."""
    phases = [c for day in (30, 60, 90) for c in (F.col(f"plan.day{day}.actions").alias(f"day{day}_actions"), F.col(f"plan.day{day}.success_metrics").alias(f"day{day}_success_metrics"))]
    flat = report.select("analysis_id", *REPORT_SIZES, *phases)
    return ranked(flat, flat.columns[1:], ["analysis_id"])


PLAN = tuple(f"plan.day{day}.{part}" for day in (30, 60, 90) for part in ("actions", "success_metrics"))
#: Sizes of all lists of a customer report, where a dot leads into an object, and of the earlier prototype's lists.
FULL_REPORT = {**REPORT_SIZES, **dict.fromkeys(PLAN, (1, 5))}
FULL_SWOT = dict.fromkeys((*SWOT, *ADVICE), (1, 5))


def documents(metrics: DataFrame, by: Sequence[str] = GROUP, context: Sequence[str] = ()) -> DataFrame:
    """by, document: a JSON object of the group's keys, the context columns (one value a group) and its accounts, in order of
    handle, with every metric, nulls too.  A group holds a target and its few competitors."""
    own = [c for c in metrics.columns if c not in (*by, *context)]
    entry = F.struct("handle", *[c for c in own if c != "handle"])
    groups = metrics.groupBy(*by).agg(*[F.first(c).alias(c) for c in context], F.array_sort(F.collect_list(entry)).alias("accounts"))
    return groups.select(*by, F.to_json(F.struct(*by, *context, "accounts"), {"ignoreNullFields": "false"}).alias("document"))


def _found(answer, path: str):
    for name in path.split("."):
        answer = answer.get(name) if isinstance(answer, dict) else None
    return answer


def problem_of(answer, sizes: dict[str, tuple[int, int]]) -> str | None:
    """What is wrong with a model's answer, if anything: each list is there, holds texts that aren't blank, in the numbers
    asked for."""
    if not isinstance(answer, dict):
        return "not an object"
    for name, (low, high) in sizes.items():
        own = _found(answer, name)
        if not isinstance(own, list):
            return f"{name}: not a list"
        if not all(isinstance(x, str) and x.strip() for x in own):
            return f"{name}: not all texts"
        if not low <= len(own) <= high:
            return f"{name}: {len(own)} entries, {low} to {high} asked for"
    return None


def produced(docs: DataFrame, model: Callable[[dict], dict], sizes: dict[str, tuple[int, int]], attempts: int = 2) -> DataFrame:
    """docs without document, with a list column for each entry of sizes (dots become underscores) and with problem: null for
    an answer as agreed, else what was wrong with the last of `attempts` calls, and no lists.  Calls are made wherever the
    documents are, one at a time in each task."""
    keys = [c for c in docs.columns if c != "document"]
    names = {path: path.replace(".", "_") for path in sizes}
    lists = [T.StructField(n, T.ArrayType(T.StringType())) for n in names.values()]
    schema = T.StructType([docs.schema[c] for c in keys] + lists + [T.StructField("problem", T.StringType())])

    def ask(document: str) -> tuple[dict | None, str | None]:
        problem = None
        for _ in range(attempts):
            try:
                answer = model(json.loads(document))
                problem = problem_of(answer, sizes)
            except Exception as error:  # the row says so; other rows go on
                problem = f"{type(error).__name__}: {error}"
            if problem is None:
                return answer, None
        return None, problem

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(x) for x in frame["document"]]
            out = frame[keys].copy()
            for path, name in names.items():
                out[name] = pd.Series([a and _found(a, path) for a, _ in answers], index=out.index, dtype=object)
            out["problem"] = pd.Series([p for _, p in answers], index=out.index, dtype=object)
            yield out

    return docs.mapInPandas(run, schema)


def accepted(rows: DataFrame) -> DataFrame:
    """Answers as agreed."""
    return rows.where(F.col("problem").isNull()).drop("problem")


def rejected(rows: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """keys and problem of what couldn't be produced."""
    return rows.where(F.col("problem").isNotNull()).select(*keys, "problem")


def _plain(x: float) -> str:
    return f"{x:.4f}".rstrip("0").rstrip(".")


def insights_by_rule(document: dict) -> dict:
    """platform_insights() as a callable."""
    accounts = document["accounts"]
    most = lambda name: max(accounts, key=lambda a: (a[name], a["handle"]))
    top, big, busy = most("engagement_rate"), most("followers"), most("posts_per_week")
    low = sum(a.get("low_sample_warning") is not None for a in accounts)
    percent = _plain((top["engagement_rate"] * 10000 + 0.5) // 1 / 100)
    return {
        "data_observations": [f"{top['handle']} has the highest engagement rate of {len(accounts)} accounts: {percent}%.", f"{big['handle']} has the largest audience: {big['followers']:,} followers.", f"{low} accounts carry a low-sample warning."],
        "explanations": [f"This may be because {top['handle']} reaches a smaller, closer audience.", f"A plausible driver is the cadence of {busy['handle']}: {_plain(busy['posts_per_week'])} posts a week."],
        "recommendations": [f"Test the formats of {top['handle']}; success is a higher engagement rate.", f"Test the cadence of {busy['handle']}; success is more posts per week at equal average likes.", "Test collaborations; success is a multiplier above 1 against the baseline."],
    }
