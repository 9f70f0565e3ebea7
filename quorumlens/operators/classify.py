"""Post classification: a plug-in, with a rule-based and a lookup classifier that need no model."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CATEGORIES, first_rule
from ..plans.storage import scratch
from .buckets import Buckets
from .upsert import insert_missing

BATCH = 40

# Words that signal a category; paid promotion needs an explicit sign of sponsorship.
SIGNALS: dict[str, list[str]] = {
    "paid_promotion": ["paid partnership", "#ad", "sponsored"],
    "collaboration": ["in collaboration with", "together with", "partnered"],
    "testimonial": ["testimonial", "customer story", "review"],
    "educational": ["how to", "learn", "guide"],
    "campaign": ["campaign", "challenge", "giveaway"],
    "product": ["launch", "new product", "available now", "licensed"],
}


def category_of(caption: Column, coauthor: Column) -> Column:
    """Signals in order; a co-author alone is a collaboration, never a paid promotion."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    rules = [(reduce(or_, [low.contains(w) for w in words]), name) for name, words in SIGNALS.items()]
    return F.coalesce(first_rule(rules), F.when(coauthor.isNotNull(), F.lit("collaboration")), F.lit("other"))


def by_rules(posts: DataFrame) -> DataFrame:
    """post_id, category, confidence, rationale"""
    category = category_of(F.col("caption"), F.col("coauthor_handle"))
    return posts.select("post_id", category.alias("category")).select("post_id", "category", F.when(F.col("category") == "other", 0.5).otherwise(0.9).alias("confidence"), F.concat(F.lit("Caption signals: "), F.col("category")).alias("rationale"))


def by_lookup(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Categories from a table (post_id, category); posts that aren't in it are other."""
    return posts.join(known, "post_id", "left").select("post_id", F.coalesce("category", F.lit("other")).alias("category"))


#: Posts of an account that one task numbers.
NUMBERED = 10_000


def chunked(posts: DataFrame, per: str = "account_id", key: str = "post_id", batch: int = BATCH) -> DataFrame:
    """posts with chunk: the number of the request of at most `batch` posts of an account that each goes into.

    An account of over NUMBERED posts is numbered in parts by a hash of the key, so that it is no task's alone; each part's
    chunks follow those of the part before by a fixed distance, and its last one may be short."""
    sizes = posts.groupBy(F.col(per).alias("__per")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(NUMBERED))).cast("long").alias("__parts"))
    dealt = posts.join(sizes, F.col(per).eqNullSafe(F.col("__per"))).drop("__per").withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts")))
    number = F.row_number().over(Window.partitionBy(per, "__part").orderBy(key))
    chunk = F.col("__part") * F.lit(2 * NUMBERED // batch) + F.floor((number - 1) / batch)
    return dealt.withColumn("chunk", chunk.cast("int")).drop("__part", "__parts")


ANSWER = "post_id string, category string, confidence double, rationale string"
ASKED = f"{ANSWER}, problem string"


def problem_of(answer, ids: set) -> str | None:
    """What is wrong with an answer {post_id, category, confidence, rationale}, if anything."""
    if not isinstance(answer, dict) or answer.get("post_id") not in ids:
        return "no such post"
    if answer.get("category") not in CATEGORIES:
        return "no such category"
    confidence = answer.get("confidence")
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        return "confidence out of range"
    return None if isinstance(answer.get("rationale"), str) else "no rationale"


def asked(posts: DataFrame, model: Callable[[list[dict]], list[dict]], batch: int = BATCH) -> DataFrame:
    """post_id, category, confidence, rationale, problem of one call of the model per account and chunk: a row for each
    post that was sent.  The first good answer to a post counts; problem says why there is none: the call failed, the answer
    is not as agreed, or the post was passed over."""

    def call(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("post_id")
        sent = [{"id": r.post_id, "caption": r.caption or "(no caption)", "coauthor": r.coauthor_handle or "none"} for r in frame.itertuples()]
        good, bad, failed = {}, {}, "passed over"
        try:
            for answer in model(sent):
                problem = problem_of(answer, {x["id"] for x in sent})
                if problem is None:
                    good.setdefault(answer["post_id"], (answer["category"], float(answer["confidence"]), answer["rationale"], None))
                elif problem != "no such post":
                    bad[answer["post_id"]] = problem
        except Exception as error:  # a failed call leaves its posts unanswered, and fails nothing else
            failed = f"{type(error).__name__}: {error}"
        rows = [(x["id"], *good.get(x["id"], (None, None, None, bad.get(x["id"], failed)))) for x in sent]
        return pd.DataFrame(rows, columns=["post_id", "category", "confidence", "rationale", "problem"])

    rows = chunked(posts.select("account_id", F.col("post_id").cast("string").alias("post_id"), "caption", "coauthor_handle"), batch=batch)
    return rows.groupBy("account_id", "chunk").applyInPandas(call, ASKED)


def answer_all(posts: DataFrame, model: Callable[[list[dict]], list[dict]], answers: Buckets, rounds: int = 5, batch: int = BATCH) -> int:
    """Asks for every post that has no answer in the table `answers` (post_id, category, confidence, rationale) until all
    have one, at most `rounds` times, with half as many posts a call each time; the number of posts left without.

    Each round's answers are merged into the table before the next one: what was answered is never asked again, also by a
    later run, and a post's first answer stays.  A round's calls are written once, so that no retry of what reads them makes
    them again; a task that is lost may call again for its own chunks, and one of the two answers is kept."""
    spark, keys, left = posts.sparkSession, ["post_id"], 0
    posts = posts.where(F.col("post_id").isNotNull()).withColumn("post_id", F.col("post_id").cast("string")).dropDuplicates(["post_id"])
    for turn in range(rounds):
        open_ = posts.join(answers.read().select("post_id"), keys, "left_anti")
        place = f"{scratch(spark)}/answers"
        asked(open_, model, max(1, batch >> turn)).write.parquet(place)
        rows = spark.read.schema(ASKED).parquet(place)
        left = rows.where("problem is not null").count()
        answers.merge(rows.where("problem is null").drop("problem"), lambda have, new: insert_missing(have, new, keys))
        if not left:
            break
    return left
