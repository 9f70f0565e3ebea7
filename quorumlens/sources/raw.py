"""Raw scraper records to typed tables.

Every normaliser takes a frame with `handle` and `item` (the JSON text of one record) and returns typed columns.  A record
is parsed once, to a VARIANT, and fields are read from that by path; fallback chains are coalesce, and numbers are read as
text and cast permissively (what isn't a number is 0 or null).  A record that can't be read goes to rejects(), with the
reason, and to no table; one that isn't there (null) is an empty record, as in the application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalar import HISTORY_DAYS, LEGACY_DAYS, POST_LIMIT, epoch_time, evaluated, first_rule, int_or_zero, media_type_a, media_type_c, number, whole

#: Reasons for which a record isn't read.
NO_JSON, NO_OBJECT = "not JSON", "not an object"


def parsed(raw: DataFrame) -> DataFrame:
    """raw with v, the record as a VARIANT (null where it can't be read), instead of item, and with the reason why not."""
    others = [c for c in raw.columns if c not in ("item", "day")]
    item = F.coalesce("item", F.lit("{}"))
    once = raw.select(*others, item.alias("item"), evaluated(F.try_parse_json(item)).alias("v"))
    is_object = F.ltrim("item").startswith("{")
    reason = first_rule([(F.col("v").isNull(), NO_JSON), (~is_object, NO_OBJECT)])
    return once.withColumn("reason", reason)


def records(raw: DataFrame) -> DataFrame:
    """The records that can be read."""
    return parsed(raw).where(F.col("reason").isNull()).drop("reason", "item")


def rejects(raw: DataFrame) -> DataFrame:
    """handle, item, reason of the records that can't be read; with records() these are all."""
    return parsed(raw).where(F.col("reason").isNotNull()).drop("v")


def field(*paths: str) -> Column:
    """The first of these fields that is there and not null, as text."""
    return F.coalesce(*[F.try_variant_get("v", f"$.{path}", "string") for path in paths])


def moment(text: Column) -> Column:
    """A time from text, null if it isn't one."""
    return F.try_to_timestamp(text)


def _number(text: Column) -> Column:
    """null stays null; text that is no number is 0"""
    return F.when(text.isNotNull(), int_or_zero(text))


def profile_a(raw: DataFrame) -> DataFrame:
    return records(raw).select("handle", field("fullName").alias("display_name"), int_or_zero(field("followersCount")).alias("followers"), _number(field("followsCount")).alias("following"), field("biography").alias("bio"))


def profile_b(raw: DataFrame) -> DataFrame:
    """Fields are in authorMeta if that is there, else at the top, never in both."""
    meta = F.try_variant_get("v", "$.authorMeta", "variant")
    rows = records(raw).select("handle", F.when(meta.isNotNull() & ~F.is_variant_null(meta), meta).otherwise(F.col("v")).alias("v"))
    return rows.select("handle", field("nickName", "name").alias("display_name"), int_or_zero(field("fans", "followerCount")).alias("followers"), _number(field("following")).alias("following"), field("signature").alias("bio"))


def profile_c(raw: DataFrame) -> DataFrame:
    return records(raw).select("handle", field("name", "companyName").alias("display_name"), int_or_zero(field("followerCount", "followers")).alias("followers"), F.lit(None).cast("bigint").alias("following"), field("description", "about").alias("bio"))


def post_a(raw: DataFrame) -> DataFrame:
    return records(raw).select(
        "handle", F.coalesce(field("url"), F.lit("")).alias("post_url"), field("caption").alias("caption"), media_type_a(field("type")).alias("media_type"),
        int_or_zero(field("likesCount")).alias("likes"), int_or_zero(field("commentsCount")).alias("comments"), F.lit(None).cast("bigint").alias("shares"),
        moment(field("timestamp", "takenAt")).alias("posted_at"), field("coauthorProducers[0].username").alias("coauthor_handle"),
    )


def post_b(raw: DataFrame) -> DataFrame:
    """createTime is in seconds if it is a number; written as text it is read as a date, as is createTimeISO."""
    created = F.try_variant_get("v", "$.createTime", "variant")
    seconds = F.when(F.schema_of_variant(created).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number(field("createTime")))
    at = F.when(seconds.isNotNull(), epoch_time(seconds)).otherwise(moment(field("createTime", "createTimeISO")))
    return records(raw).select(
        "handle", F.coalesce(field("webVideoUrl", "url"), F.lit("")).alias("post_url"), field("text").alias("caption"), F.lit("video").alias("media_type"),
        int_or_zero(field("diggCount")).alias("likes"), int_or_zero(field("commentCount")).alias("comments"), _number(field("shareCount")).alias("shares"),
        at.alias("posted_at"), F.lit(None).cast("string").alias("coauthor_handle"),
    )


def post_c(raw: DataFrame) -> DataFrame:
    return records(raw).select(
        "handle", F.coalesce(field("url", "postUrl"), F.lit("")).alias("post_url"), field("text", "content").alias("caption"), media_type_c(field("type", "contentType")).alias("media_type"),
        int_or_zero(field("likeCount", "reactionCount")).alias("likes"), int_or_zero(field("commentCount")).alias("comments"), _number(field("shareCount")).alias("shares"),
        moment(field("postedAt", "publishedAt", "date")).alias("posted_at"), F.lit(None).cast("string").alias("coauthor_handle"),
    )


#: What accepted() and history_points() drop, as conditions on their input in the order in which they are asked.
def dropped_posts(since) -> list[tuple[Column, str]]:
    old = F.col("posted_at") < F.lit(since).cast("timestamp")
    return [(F.col("posted_at").isNull(), "undated"), (old, "before the window"), (F.col("post_url") == "", "without url")]


def counted(rows: DataFrame, rules: list[tuple[Column, str]], name: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation of how many there are and how many each rule, asked in order, drops: it is filled by the
    action that reads rows, on the same pass."""
    reason, observed = first_rule(rules), Observation(name)
    counts = [F.count_if(reason.eqNullSafe(F.lit(rule))).alias(rule) for _, rule in rules]
    return rows.observe(observed, F.count(F.lit(1)).alias("rows"), *counts), observed


def accepted(posts: DataFrame, since, limit: int | None = POST_LIMIT) -> DataFrame:
    """Posts in the window with a url; undated ones go.  limit is per handle, newest first (a global one would mix handles)."""
    inside = posts.where((F.col("posted_at") >= F.lit(since).cast("timestamp")) & (F.col("post_url") != ""))
    if limit is None:
        return inside
    number = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("posted_at"), "post_url"))
    return inside.withColumn("__n", number).where(F.col("__n") <= limit).drop("__n")


def newer(raw: DataFrame, since) -> DataFrame:
    """Raw rows whose `day` isn't before the day of `since`: what sources are asked for, tested before a record is parsed."""
    return raw.where(F.col("day") >= F.date_trunc("day", F.lit(since).cast("timestamp_ntz")))


def first_item(profiles: DataFrame, order: str) -> DataFrame:
    """One record per handle: the first in order; an adapter reads no second one."""
    return profiles.groupBy("handle").agg(F.min_by(F.struct(*[c for c in profiles.columns if c != "handle"]), order).alias("__x")).select("handle", "__x.*")


def legacy_profile(raw: DataFrame) -> DataFrame:
    """The earlier prototype's profile: fields as they are, no number where there is none."""
    return records(raw).select("handle", whole(number(field("followersCount"))).alias("followers"), whole(number(field("followsCount"))).alias("following"), field("biography").alias("bio"))


def legacy_posts(raw: DataFrame, as_of, days: int = LEGACY_DAYS) -> DataFrame:
    """The earlier prototype's posts of the last `days`: the media type as the source names it, absent counts 0, a time that
    can't be read raises, as it does there."""
    at = F.coalesce(F.nullif(field("timestamp"), F.lit("")), field("takenAt"))
    posts = records(raw).select(
        "handle", field("url").alias("post_url"), field("caption").alias("caption"), field("type").alias("media_type"),
        int_or_zero(field("likesCount")).alias("likes"), int_or_zero(field("commentsCount")).alias("comments"),
        evaluated(F.coalesce(F.to_timestamp(at), F.raise_error(F.concat(F.lit("no time: "), F.coalesce(at, F.lit("null")))).cast("timestamp"))).alias("posted_at"),
        field("coauthorProducers[0].username").alias("coauthor_handle"),
    )
    return posts.where(F.col("posted_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def history_entries(raw: DataFrame) -> DataFrame:
    """handle, ordinal, ts, followers of every entry of history arrays; what can't be read in an entry is null."""
    entries = records(raw).select("handle", F.posexplode(F.try_variant_get("v", "$.history", "array<variant>")).alias("ordinal", "v"))
    followers = whole(number(field("followers", "followerCount", "subscribers", "value")))
    return entries.select("handle", evaluated(moment(field("date", "day", "timestamp"))).alias("ts"), evaluated(followers).alias("followers"), "ordinal")


def dropped_points(since=None) -> list[tuple[Column, str]]:
    rules = [(F.col("ts").isNull(), "undated"), (F.col("followers").isNull(), "not a number")]
    return rules if since is None else [*rules, (F.col("ts") < F.lit(since).cast("timestamp"), "before the window")]


def history_points(raw: DataFrame, since=None) -> DataFrame:
    """handle, ts, followers, ordinal of every valid entry of history arrays."""
    points = history_entries(raw).where("ts is not null and followers is not null")
    return points if since is None else points.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def history_since(as_of, window_days: int) -> Column:
    """The historical source reaches back HISTORY_DAYS at most."""
    return F.lit(as_of).cast("timestamp") - F.expr(f"interval {min(window_days, HISTORY_DAYS)} days")


#: platform -> (profiles, posts, whether it has history)
REGISTRY: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame], bool]] = {
    "instagram": (profile_a, post_a, True),
    "tiktok": (profile_b, post_b, True),
    "linkedin": (profile_c, post_c, False),
}


def register(platform: str, profiles: Callable, posts: Callable, history: bool = False) -> None:
    """Plug in another platform."""
    REGISTRY[platform] = (profiles, posts, history)


def normalise(raw: dict[str, DataFrame], kind: str) -> DataFrame:
    """Union of the platforms' typed rows; kind is "profiles" or "posts"; an unknown platform raises."""
    at = {"profiles": 0, "posts": 1}[kind]
    frames = [REGISTRY[p][at](df).withColumn("platform", F.lit(p)) for p, df in raw.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
