"""Named queries over the driver's tables, with the same results in DuckDB SQL.

Names begin with the inventory ids that a query covers.  Raw scraper records are made from the tables as JSON text, so
that parsing, fallback chains and normalisers run on every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators import classify, constraints, growth, legacy, lifecycle, metrics, readmodels, requests, synthesis, upsert
from ..operators.buckets import Buckets, buckets_for
from ..sources import raw, records
from ..streaming import states, weekly
from .binding import Domain, having
from .storage import scratch

POSTS_AS_OF, POINTS_AS_OF = "2001-11-04 00:00:00", "2024-01-30 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(domain) under name."""

    def add(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Domain(spark, folder))
        if sql:
            SQL[name] = sql
        return fn

    return add


def r(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def num(x: str) -> str:
    """A number as plain text in SQL."""
    return f"regexp_replace({x}::varchar, '\\.0$', '')"


# ------------------------------------------------------------------ account metrics

_SUMS = """sums as (select account_id, count(*) as n, sum(likes)::double as likes, sum(comments)::double as comments, sum(shares)::double as shares, count(shares) as n_shares
  from posts group by account_id),
raw as (select a.*, coalesce(s.n, 0)::bigint as post_count, coalesce(s.likes / s.n, 0e0) as l, coalesce(s.comments / s.n, 0e0) as c,
  case when s.n_shares > 0 then s.shares / s.n_shares end as sh from accounts a left join sums s using (account_id))"""
_METRICS = f"""{_SUMS},
rounded as (select account_id, analysis_id, handle, platform, role, followers, post_count, {r("l")} as avg_likes, {r("c")} as avg_comments, {r("sh")} as avg_shares,
  {r("case when followers > 0 then (l + c + coalesce(sh, 0e0)) / followers else 0e0 end", 4)} as engagement_rate, {r("post_count / (90 / 7::double)")} as posts_per_week, {r("l + c")} as baseline_engagement,
  case when followers < 1000 or l + c < 10 then 'Reach is small (' || format('{{:,}}', followers) || ' followers, ~' || regexp_replace({r("l + c", 1)}::varchar, '\\.0$', '')
    || ' avg interactions/post) — treat the engagement rate as low-sample and directionally indicative, not a sign of outsized performance.' end as low_sample_warning from raw),
metrics as (select *, floor(1e2 * count(*) over (partition by analysis_id, platform order by engagement_rate) / count(*) over (partition by analysis_id, platform) + 0.5e0)::bigint as engagement_rate_percentile,
  floor(1e2 * count(*) over (partition by analysis_id, platform order by followers) / count(*) over (partition by analysis_id, platform) + 0.5e0)::bigint as followers_percentile,
  floor(1e2 * count(*) over (partition by analysis_id, platform order by avg_likes) / count(*) over (partition by analysis_id, platform) + 0.5e0)::bigint as avg_likes_percentile from rounded)"""


@query("account_metrics", f"{having('accounts', 'posts')},\n{_METRICS}\nselect * from metrics")
def _account_metrics(d: Domain) -> DataFrame:
    return metrics.account_metrics(d.accounts, d.posts)


@query("win2_percentiles", f"{having('accounts', 'posts')},\n{_METRICS}\nselect analysis_id, platform, account_id, engagement_rate_percentile, followers_percentile, avg_likes_percentile from metrics")
def _percentiles(d: Domain) -> DataFrame:
    return metrics.account_metrics(d.accounts, d.posts).select("analysis_id", "platform", "account_id", "engagement_rate_percentile", "followers_percentile", "avg_likes_percentile")


@query("agg7_media_breakdown", f"{having('posts')} select account_id, coalesce(media_type, 'unknown') as media_type, count(*) as post_count, {r('sum(likes + comments)::double / count(*)')} as avg_engagement from posts group by 1, 2")
def _media(d: Domain) -> DataFrame:
    return metrics.media_breakdown(d.posts)


_CATS = f"""cp as (select p.*, c.category from posts p left join categories c using (category_key)),
base as (select account_id, sum(likes + comments)::double / count(*) as baseline from cp group by 1),
breakdown as (select account_id, category, count(*) as post_count, {r("sum(likes + comments)::double / count(*)")} as avg_engagement,
  case when any_value(baseline) > 0 then {r("sum(likes + comments)::double / count(*) / any_value(baseline)")} end as vs_baseline_multiplier
  from cp join base using (account_id) where category is not null group by 1, 2)"""


@query("join1_posts_categories", f"{having('posts', 'categories')} select category, count(*) as posts, sum(likes)::bigint as likes from posts left join categories using (category_key) group by 1")
def _join1(d: Domain) -> DataFrame:
    return metrics.with_category(d.posts, d.categories).groupBy("category").agg(F.count(F.lit(1)).alias("posts"), F.sum("likes").alias("likes"))


@query("agg9_category_breakdown", f"{having('posts', 'categories')}, {_CATS} select * from breakdown")
def _categories(d: Domain) -> DataFrame:
    return metrics.category_breakdown(metrics.with_category(d.posts, d.categories))


_COLLAB = f"""cs as (select account_id, count(*) as n, sum(likes + comments)::double as e, count(*) filter (where category in ('collaboration', 'paid_promotion')) as k,
  sum(likes + comments) filter (where category in ('collaboration', 'paid_promotion'))::double as ke from (select p.*, c.category from posts p left join categories c using (category_key)) group by 1),
collab as (select account_id, coalesce(k, 0)::bigint as post_count, {r("case when k > 0 then ke / k else 0e0 end")} as avg_engagement,
  case when k > 0 and e > 0 then {r("(ke / k) / (e / n)")} end as vs_baseline_multiplier from accounts left join cs using (account_id))"""


@query("agg10_collaboration", f"{having('accounts', 'posts', 'categories')}, {_COLLAB} select * from collab")
def _collab(d: Domain) -> DataFrame:
    return metrics.collaboration(d.accounts, metrics.with_category(d.posts, d.categories))


@query("flt10_low_sample", f"{having('accounts', 'posts')},\n{_METRICS}\nselect account_id, low_sample_warning from metrics where low_sample_warning is not null")
def _low_sample(d: Domain) -> DataFrame:
    return metrics.account_metrics(d.accounts, d.posts).where("low_sample_warning is not null").select("account_id", "low_sample_warning")


@query("nested_metrics")
def _nested(d: Domain) -> DataFrame:
    lists = growth.growth_lists(d.users.select("account_id"), growth.weekly_snapshots(d.points))
    return metrics.nested_metrics(d.accounts, d.posts, d.categories, lists)


# ------------------------------------------------------------------ growth


@query("agg11_weekly_collapse", f"{having('points', 'weekly')} select * from weekly")
def _weekly(d: Domain) -> DataFrame:
    return growth.weekly_snapshots(d.points)


_GROWTH = f"""growth as (select account_id, week_start, followers, case when p > 0 then {r("(followers - p)::double / p * 100")} end as growth_pct
  from (select *, lag(followers) over (partition by account_id order by week_start) as p from weekly))"""


@query("win1_weekly_growth", f"{having('points', 'weekly')}, {_GROWTH} select * from growth")
def _weekly_growth(d: Domain) -> DataFrame:
    return growth.weekly_growth(growth.weekly_snapshots(d.points))


_CUMULATIVE = f"""ends as (select account_id, count(*) as n, arg_min(followers, week_start) as first, arg_max(followers, week_start) as last from weekly group by 1),
cumulative as (select account_id, coalesce(n, 0)::bigint as n_weeks, case when n >= 2 and first > 0 then {r("(last - first)::double / first * 100")} end as cumulative_growth_pct,
  case when coalesce(n, 0) < 2 then '{S.GROWTH_GAP}' end as growth_data_gap from users left join ends using (account_id))"""


@query("agg12_cumulative_growth", f"{having('users', 'points', 'weekly')}, {_CUMULATIVE} select * from cumulative")
def _cumulative(d: Domain) -> DataFrame:
    return growth.cumulative_growth(d.users, growth.weekly_snapshots(d.points))


@query("agg13_growth_lists", f"{having('points', 'weekly')}, {_GROWTH} select account_id, string_agg(week_start::varchar || ':' || followers::varchar || ':' || coalesce({num('growth_pct')}, '-'), ',' order by week_start) as weeks from growth group by 1")
def _lists(d: Domain) -> DataFrame:
    lists = growth.growth_lists(d.points.select("account_id").distinct(), growth.weekly_snapshots(d.points))
    return lists.select("account_id", F.array_join(F.transform("weekly_growth", lambda w: F.concat(w["week_start"].cast("string"), F.lit(":"), w["followers"].cast("string"), F.lit(":"), F.coalesce(S.number_text(w["growth_pct"]), F.lit("-")))), ",").alias("weeks"))


@query("flt4_snapshots_since", f"{having('points', 'weekly')} select * from weekly where week_start >= date_trunc('week', timestamp '2024-01-30' - interval 14 days)::date")
def _since(d: Domain) -> DataFrame:
    return growth.since(growth.weekly_snapshots(d.points), POINTS_AS_OF, 14)


@query("str4_streaming_weekly", f"{having('points', 'weekly')} select * from weekly")
def _streaming(d: Domain) -> DataFrame:
    folder = scratch(d.spark)
    source = d.spark.readStream.schema(d.table("events").schema).parquet(f"{d.folder}/events.parque[t]")
    points = source.select(F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("bigint").alias("followers"), F.col("event_id").alias("ordinal"))
    stream = weekly.weekly_stream(points)
    table = Buckets(d.spark, f"{folder}/table", stream.schema, ["account_id", "week_start"], 16)
    weekly.into_table(stream, table, f"{folder}/state").awaitTermination()
    return table.read()


def _fed(d: Domain, batches: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of these batches, one after the other: it is stopped after each and goes on from its checkpoint."""
    folder, partitions = scratch(d.spark), None
    states.use(d.spark)
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/in")
        # of the first batch, as a checkpoint keeps the number
        partitions = partitions or states.partitions_for(d.spark.read.parquet(f"{folder}/in").count(), d.spark.sparkContext.defaultParallelism)
        out = make(d.spark.readStream.schema(batches[0].schema).parquet(f"{folder}/in"))
        writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        states.started(writer.trigger(availableNow=True), d.spark, partitions).awaitTermination()
    return d.spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("str6_weekly_state", f"""{having('points')}, seen as (select max(ts) - interval 7 days as mark from points where ts >= timestamp '2024-01-15'),
p as (select account_id, date_trunc('week', ts)::date as week_start, followers, ts, ordinal, ts < timestamp '2024-01-15' and date_trunc('week', ts) + interval 7 days <= mark as late from points, seen)
select 'late' as kind, account_id, week_start, followers from p where late
union all select 'week', account_id, week_start, arg_max(followers, (ts, ordinal)) from p where not late group by account_id, week_start""")
def _weekly_state(d: Domain) -> DataFrame:
    """The later half of the points comes first; a point far ahead closes all weeks."""
    later = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    ahead = d.spark.sql("select timestamp '2100-01-01' as ts").select(F.lit(-1).cast(d.points.schema["account_id"].dataType).alias("account_id"), "ts", F.lit(0).cast("long").alias("followers"), F.lit(0).cast(d.points.schema["ordinal"].dataType).alias("ordinal"))
    return _fed(d, [d.points.where(later), d.points.where(~later), ahead], states.weekly_state).select("kind", "account_id", "week_start", "followers")


@query("nested_metrics_text", f"""{having('accounts', 'posts', 'categories', 'users', 'points', 'weekly')},\n{_METRICS}, {_CATS}, {_COLLAB}, {_GROWTH}, {_CUMULATIVE},
media as (select account_id, string_agg(media_type || ':' || post_count || ':' || {num('avg_engagement')}, ',' order by media_type) as media_types
  from (select account_id, coalesce(media_type, 'unknown') as media_type, count(*) as post_count, {r('sum(likes + comments)::double / count(*)')} as avg_engagement from posts group by 1, 2) group by 1),
cats as (select account_id, string_agg(category || ':' || post_count || ':' || {num('avg_engagement')} || ':' || coalesce({num('vs_baseline_multiplier')}, '-'), ',' order by category) as categories from breakdown group by 1),
weeks as (select account_id, string_agg(week_start::varchar || ':' || followers::varchar || ':' || coalesce({num('growth_pct')}, '-'), ',' order by week_start) as weeks from growth group by 1)
select m.account_id, m.post_count, avg_likes, avg_comments, avg_shares, engagement_rate, m.posts_per_week, m.baseline_engagement, engagement_rate_percentile, media_types, categories,
  c.post_count || ':' || {num('c.avg_engagement')} || ':' || coalesce({num('c.vs_baseline_multiplier')}, '-') as cadence, weeks, cumulative_growth_pct,
  case when weeks is null then '{S.GROWTH_GAP}' else growth_data_gap end as growth_data_gap
from metrics m left join media using (account_id) left join cats using (account_id) left join collab c using (account_id) left join weeks using (account_id) left join cumulative using (account_id)""")
def _nested_text(d: Domain) -> DataFrame:
    """nested_metrics with its maps and lists as text, in order of their keys."""
    rows = _nested(d)
    plain = lambda x: F.coalesce(S.number_text(x), F.lit("-"))
    entries = lambda c, text: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], *text(e["value"]))), ",")
    count = lambda v: v["post_count"].cast("string")
    week = lambda w: F.concat_ws(":", w["week_start"].cast("string"), w["followers"].cast("string"), plain(w["growth_pct"]))
    c = F.col("collaboration_cadence")
    return rows.select(
        "account_id", "post_count", "avg_likes", "avg_comments", "avg_shares", "engagement_rate", "posts_per_week", "baseline_engagement", "engagement_rate_percentile",
        entries("media_type_breakdown", lambda v: (count(v), plain(v["avg_engagement"]))).alias("media_types"),
        entries("category_breakdown", lambda v: (count(v), plain(v["avg_engagement"]), plain(v["vs_baseline_multiplier"]))).alias("categories"),
        F.concat_ws(":", count(c), plain(c["avg_engagement"]), plain(c["vs_baseline_multiplier"])).alias("cadence"),
        F.array_join(F.transform("weekly_growth", week), ",").alias("weeks"), "cumulative_growth_pct", "growth_data_gap",
    )


# ------------------------------------------------------------------ raw sources


def _raw(df: DataFrame, handle: str, *more: Column, **fields) -> DataFrame:
    return df.select(F.col(handle).alias("handle"), *more, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("item"))


def _written(n: Column) -> Column:
    """A number as sources write it: 1200, 1200.0 or 1.2e3."""
    k = F.pmod(n, F.lit(3))
    return F.when(k == 0, n.cast("string")).when(k == 1, F.concat(n.cast("string"), F.lit(".0"))).otherwise(F.concat((n / 10).cast("decimal(20,1)").cast("string"), F.lit("e1")))


def _profiles_a(d: Domain) -> DataFrame:
    c = d.table("customer")
    return _raw(c, "c_name", fullName=F.when(F.col("c_nationkey") != 3, F.col("c_name")), followersCount=_written(F.floor("c_acctbal")), followsCount=F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")), biography=F.nullif("c_mktsegment", F.lit("BUILDING")))


@query("src1_profiles_a", "select c_name as handle, case when c_nationkey <> 3 then c_name end as display_name, floor(c_acctbal)::bigint as followers, case when c_nationkey > 9 then c_nationkey::bigint end as following, nullif(c_mktsegment, 'BUILDING') as bio from customer")
def _src1(d: Domain) -> DataFrame:
    return raw.profile_a(_profiles_a(d))


def _profiles_b(d: Domain) -> DataFrame:
    c = d.table("customer")
    inner = F.struct(F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("nickName"), F.lit("n").alias("name"), F.floor("c_acctbal").alias("fans"), F.col("c_nationkey").alias("following"), F.col("c_mktsegment").alias("signature"))
    wrapped = F.to_json(F.struct(inner.alias("authorMeta"), F.lit("ignored").alias("signature")))
    flat = F.to_json(F.struct(F.lit("flat").alias("name"), F.floor("c_acctbal").alias("followerCount"), F.lit("not a number").alias("following")))
    return c.select(F.col("c_name").alias("handle"), F.when(F.col("c_mktsegment") != "MACHINERY", wrapped).otherwise(flat).alias("item"))


@query("src2_profiles_b", "select c_name as handle, case when c_mktsegment = 'MACHINERY' then 'flat' when c_nationkey <> 3 then c_name else 'n' end as display_name, floor(c_acctbal)::bigint as followers, case when c_mktsegment = 'MACHINERY' then 0 else c_nationkey end::bigint as following, nullif(c_mktsegment, 'MACHINERY') as bio from customer")
def _src2(d: Domain) -> DataFrame:
    return raw.profile_b(_profiles_b(d))


def _profiles_c(d: Domain) -> DataFrame:
    c, odd = d.table("customer"), F.col("c_nationkey") % 2 == 1
    return _raw(c, "c_name", name=F.when(odd, F.col("c_name")), companyName=F.lit("company"), followerCount=F.when(odd, F.floor("c_acctbal")), followers=F.col("c_nationkey"), about=F.col("c_mktsegment"))


@query("src3_profiles_c", "select c_name as handle, case when c_nationkey % 2 = 1 then c_name else 'company' end as display_name, case when c_nationkey % 2 = 1 then floor(c_acctbal)::bigint else c_nationkey end::bigint as followers, null::bigint as following, c_mktsegment as bio from customer")
def _src3(d: Domain) -> DataFrame:
    return raw.profile_c(_profiles_c(d))


_TYPES = ["Sidecar", "clips", "GraphVideo", "Photo", "CAROUSEL_ALBUM", "reel", "Image", "other"]


def _type() -> Column:
    return F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_linenumber") % 8 + 1).cast("int"))


def _posts_a(d: Domain) -> DataFrame:
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    open_ = F.col("l_linestatus") == "O"
    return _raw(d.table("lineitem"), "l_suppkey", F.col("l_shipdate").alias("day"), url=F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).otherwise(""), caption=F.col("l_linestatus"), type=_type(), likesCount=F.floor("l_quantity"), commentsCount=F.when(open_, F.col("l_linenumber")),
                timestamp=F.when(open_, stamp), takenAt=stamp, coauthorProducers=F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.lit("partner").alias("username")))))


def _posts_written(d: Domain) -> DataFrame:
    """Records of _posts_a whose numbers are written in three ways."""
    stamp, open_ = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("l_linestatus") == "O"
    return _raw(d.table("lineitem"), "l_suppkey", F.col("l_shipdate").alias("day"), url=F.when(F.col("l_linenumber") < 7, F.col("l_orderkey").cast("string")).otherwise(""), caption=F.col("l_linestatus"), type=_type(), likesCount=_written(F.floor("l_quantity")), commentsCount=F.when(open_, _written(F.col("l_linenumber"))),
                timestamp=F.when(open_, stamp), takenAt=stamp, coauthorProducers=F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.lit("partner").alias("username")))))


_MEDIA_A = "(['carousel', 'reel', 'video', 'image', 'carousel', 'reel', 'image', null])[l_linenumber % 8 + 1]"


@query("src4_posts_a", f"select l_suppkey as handle, l_orderkey::varchar as post_url, l_linestatus as caption, {_MEDIA_A} as media_type, floor(l_quantity)::bigint as likes, case when l_linestatus = 'O' then l_linenumber else 0 end::bigint as comments, null::bigint as shares, l_shipdate as posted_at, case when l_returnflag = 'R' then 'partner' end as coauthor_handle from lineitem where l_linenumber < 7 and l_shipdate >= timestamp '2001-11-04' - interval 90 days")
def _src4(d: Domain) -> DataFrame:
    return raw.accepted(raw.post_a(raw.newer(_posts_a(d), "2001-08-06 00:00:00")), "2001-08-06 00:00:00", limit=None).withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))


def _posts_b(d: Domain) -> DataFrame:
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    number = F.col("l_linestatus") == "O"
    return _raw(d.table("lineitem"), "l_suppkey", F.col("l_shipdate").alias("day"), createTime=F.when(number, seconds), createTimeISO=F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), webVideoUrl=F.when(number, F.col("l_orderkey").cast("string")), url=F.lit("u"), text=F.col("l_returnflag"), diggCount=F.floor("l_quantity"), commentCount=F.col("l_linenumber"), shareCount=F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")))


@query("src5_posts_b", "select l_suppkey as handle, case when l_linestatus = 'O' then l_orderkey::varchar else 'u' end as post_url, l_returnflag as caption, 'video' as media_type, floor(l_quantity)::bigint as likes, l_linenumber::bigint as comments, case when l_returnflag <> 'N' then l_linenumber::bigint end as shares, l_shipdate as posted_at, null::varchar as coauthor_handle from lineitem where l_shipdate >= timestamp '2001-11-04' - interval 90 days")
def _src5(d: Domain) -> DataFrame:
    return raw.accepted(raw.post_b(raw.newer(_posts_b(d), "2001-08-06 00:00:00")), "2001-08-06 00:00:00", limit=None).withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))


def _posts_c(d: Domain, **more: Column) -> DataFrame:
    stamp, n = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ["NativeVideo", "photo post", "PDF", "Article", "text", "IMAGE", "poll", "document"])), (n % 8 + 1).cast("int"))
    return _raw(d.table("lineitem"), "l_suppkey", F.col("l_shipdate").alias("day"), postedAt=F.when(n == 1, stamp), publishedAt=F.when(n == 2, stamp), date=F.when(n > 2, F.when(n == 7, F.lit("no date")).otherwise(stamp)), postUrl=F.col("l_orderkey").cast("string"), content=F.col("l_linestatus"), contentType=kind, likeCount=F.when(n == 1, F.lit(5)), reactionCount=F.floor("l_quantity"), commentCount=F.lit("x"), shareCount=n, **more)


@query("src6_posts_c", "select l_suppkey as handle, l_orderkey::varchar as post_url, l_linestatus as caption, (['video', 'image', 'document', 'article', 'text', 'image', null, 'document'])[l_linenumber % 8 + 1] as media_type, case when l_linenumber = 1 then 5 else floor(l_quantity) end::bigint as likes, 0::bigint as comments, l_linenumber::bigint as shares, l_shipdate as posted_at, null::varchar as coauthor_handle from lineitem where l_linenumber <> 7 and l_shipdate >= timestamp '2001-11-04' - interval 90 days")
def _src6(d: Domain) -> DataFrame:
    return raw.accepted(raw.post_c(raw.newer(_posts_c(d), "2001-08-06 00:00:00")), "2001-08-06 00:00:00", limit=None).withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))


def _history(d: Domain) -> DataFrame:
    """One record of history per user; the field names vary by event type, errors are no numbers."""
    stamp, value, kind = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.floor("value").cast("string"), F.col("event_type")
    entry = F.struct(
        F.when(kind == "click", stamp).alias("date"), F.when(kind == "view", stamp).alias("day"), F.when(~kind.isin("click", "view"), stamp).alias("timestamp"),
        F.when(kind == "click", value).alias("followers"), F.when(kind == "view", value).alias("followerCount"), F.when(kind == "signup", value).alias("subscribers"), F.when(kind == "error", F.lit("n/a")).when(kind == "purchase", value).alias("value"),
    )
    rows = d.table("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]).alias("history"))
    return rows.select(F.col("user_id").alias("handle"), F.to_json(F.struct("history")).alias("item"))


@query("src7_history_weekly", "select handle, week_start, followers from (select user_id as handle, date_trunc('week', ts)::date as week_start, floor(value)::bigint as followers, row_number() over (partition by user_id, date_trunc('week', ts) order by ts desc, event_id desc) as r from events where event_type <> 'error' and ts >= timestamp '2024-01-30' - interval 21 days) where r = 1")
def _src7(d: Domain) -> DataFrame:
    points = raw.history_points(_history(d)).where(F.col("ts") >= raw.history_since(POINTS_AS_OF, 21))
    return growth.weekly_snapshots(points, ["handle"])


@query("src8_history_points", "select user_id as handle, ts, floor(value)::bigint as followers from events where event_type <> 'error'")
def _src8(d: Domain) -> DataFrame:
    return raw.history_points(_history(d)).select("handle", F.col("ts").cast("timestamp_ntz").alias("ts"), "followers")


@query("src9_all_profiles", "select 'instagram' as platform, count(*) as n, count(display_name) as named, sum(followers)::bigint as followers from (select case when c_nationkey <> 3 then c_name end as display_name, floor(c_acctbal)::bigint as followers from customer) union all select 'tiktok', count(*), count(*), sum(floor(c_acctbal)::bigint)::bigint from customer union all select 'linkedin', count(*), count(*), sum(case when c_nationkey % 2 = 1 then floor(c_acctbal)::bigint else c_nationkey end)::bigint from customer")
def _src9(d: Domain) -> DataFrame:
    every = raw.normalise({"instagram": _profiles_a(d), "tiktok": _profiles_b(d), "linkedin": _profiles_c(d)}, "profiles")
    return every.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count("display_name").alias("named"), F.sum("followers").alias("followers"))


def _damaged(df: DataFrame) -> DataFrame:
    """Records of handles ending in 1 cut off, in 2 within a list, in 3 not there."""
    last = F.substring(F.col("handle").cast("string"), -1, 1)
    return df.withColumn("item", F.when(last == "1", F.substring("item", 1, 9)).when(last == "2", F.concat(F.lit("["), "item", F.lit("]"))).when(last != "3", F.col("item")))


@query("src1_rejects", "select c_name as handle, case right(c_name, 1) when '1' then 'not JSON' else 'not an object' end as reason from customer where right(c_name, 1) in ('1', '2')")
def _src1_rejects(d: Domain) -> DataFrame:
    return raw.rejects(_damaged(_profiles_a(d))).select("handle", "reason")


_OUTCOME = "case right({0}, 1) when '1' then 'not JSON' when '2' then 'not an object' else 'read' end"


@query("src1_src6_outcomes", "select kind, outcome, count(*) as n from (" + " union all ".join(
    [f"select 'profile {x}' as kind, {_OUTCOME.format('c_name')} as outcome from customer" for x in "abc"] + [f"select 'post {x}', {_OUTCOME.format('l_suppkey::varchar')} from lineitem" for x in "abc"]
) + ") group by 1, 2")
def _outcomes(d: Domain) -> DataFrame:
    kinds = {"profile a": _profiles_a, "profile b": _profiles_b, "profile c": _profiles_c, "post a": _posts_a, "post b": _posts_b, "post c": _posts_c}
    frames = [raw.parsed(_damaged(make(d))).groupBy(F.lit(kind).alias("kind"), F.coalesce("reason", F.lit("read")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")) for kind, make in kinds.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("flt1_flt2_dropped_posts", "select case when l_linenumber = 7 then 'undated' when l_shipdate < timestamp '2001-11-04' - interval 90 days then 'before the window' when l_linenumber % 2 = 0 then 'without url' else 'kept' end as rule, count(*) as n from lineitem group by 1")
def _dropped_posts(d: Domain) -> DataFrame:
    posts = raw.post_c(_posts_c(d, url=F.when(F.col("l_linenumber") % 2 == 0, F.lit(""))))
    return posts.groupBy(F.coalesce(S.first_rule(raw.dropped_posts("2001-08-06 00:00:00")), F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("flt6_dropped_points", "select case when event_type = 'error' then 'not a number' when ts < timestamp '2024-01-09' then 'before the window' else 'kept' end as rule, count(*) as n from events group by 1")
def _dropped_points(d: Domain) -> DataFrame:
    return raw.history_entries(_history(d)).groupBy(F.coalesce(S.first_rule(raw.dropped_points("2024-01-09 00:00:00")), F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("srt5_newest_per_handle", "select handle, post_url, posted_at from (select l_suppkey as handle, l_orderkey::varchar as post_url, l_shipdate as posted_at, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey::varchar, l_linenumber) as r from lineitem where l_linenumber < 7) where r <= 5")
def _srt5(d: Domain) -> DataFrame:
    return raw.accepted(raw.post_a(_posts_a(d)), "1990-01-01 00:00:00", limit=5).select("handle", "post_url", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("srt6_first_item", "select c_nationkey as handle, arg_min(case when c_nationkey <> 3 then c_name end, c_custkey) as display_name, arg_min(floor(c_acctbal)::bigint, c_custkey) as followers from (select * from customer) group by 1")
def _srt6(d: Domain) -> DataFrame:
    c = d.table("customer")
    items = _raw(c, "c_nationkey", F.col("c_custkey").alias("ordinal"), fullName=F.when(F.col("c_nationkey") != 3, F.col("c_name")), followersCount=F.floor("c_acctbal"))
    typed = raw.records(items).select("handle", "ordinal", raw.field("fullName").alias("display_name"), S.int_or_zero(raw.field("followersCount")).alias("followers"))
    return raw.first_item(typed, "ordinal").select("handle", "display_name", "followers")


_RECORDS = """select p as platform, l_suppkey::varchar as handle, url as post_url, likes, l_shipdate as posted_at from (
  select 'instagram' as p, l_suppkey, case when l_linenumber < 7 then l_orderkey::varchar else '' end as url, floor(l_quantity)::bigint as likes, l_shipdate from lineitem
  union all select 'linkedin', l_suppkey, case when l_linenumber <> 7 then l_orderkey::varchar else '' end, case when l_linenumber = 1 then 5 else floor(l_quantity) end::bigint, l_shipdate from lineitem
  union all select 'tiktok', l_suppkey, case when l_linestatus = 'O' then l_orderkey::varchar else 'u' end, floor(l_quantity)::bigint, l_shipdate from lineitem)
where url <> '' and l_shipdate >= timestamp '2001-08-06'"""


def _record_folder(d: Domain, since: str) -> str:
    """A folder of the posts of all platforms from that day on, as scrapers leave them."""
    folder, bundles = scratch(d.spark), buckets_for(d.posts.count())
    for platform, make in (("instagram", _posts_a), ("linkedin", _posts_c), ("tiktok", _posts_b)):
        records.write(raw.newer(make(d), since).select(F.lit(platform).alias("platform"), "handle", F.to_date("day").alias("day"), "item"), folder, "posts", bundles)
    return folder


@query("udf6_record_source", _RECORDS)
def _record_source(d: Domain) -> DataFrame:
    """Written from a month before the window, so that the date which reaches the source drops lines."""
    folder = _record_folder(d, "2001-07-06 00:00:00")
    parts = {p: records.read(d.spark, folder, since="2001-08-06", platform=p).drop("platform") for p in ("instagram", "linkedin", "tiktok")}
    posts = raw.accepted(raw.normalise(parts, "posts"), "2001-08-06 00:00:00", limit=None)
    return posts.select("platform", "handle", "post_url", "likes", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("src19_legacy_profiles", "select c_name as handle, case when c_nationkey % 4 <> 1 then floor(c_acctbal)::bigint end as followers, case when c_nationkey > 9 then c_nationkey::bigint end as following, nullif(c_mktsegment, 'BUILDING') as bio from customer")
def _src19_profiles(d: Domain) -> DataFrame:
    k = F.col("c_nationkey")
    return raw.legacy_profile(_raw(d.table("customer"), "c_name", followersCount=F.when(k % 4 != 1, F.floor("c_acctbal")), followsCount=F.when(k > 9, k), biography=F.nullif("c_mktsegment", F.lit("BUILDING"))))


@query("src19_legacy_posts", "select l_suppkey as handle, case when l_linenumber < 7 then l_orderkey::varchar else '' end as post_url, l_linestatus as caption, (['Sidecar', 'clips', 'GraphVideo', 'Photo', 'CAROUSEL_ALBUM', 'reel', 'Image', 'other'])[l_linenumber % 8 + 1] as media_type, floor(l_quantity)::bigint as likes, case when l_linestatus = 'O' then l_linenumber else 0 end::bigint as comments, l_shipdate as posted_at, case when l_returnflag = 'R' then 'partner' end as coauthor_handle from lineitem where l_shipdate >= timestamp '2001-11-04' - interval 30 days")
def _src19_posts(d: Domain) -> DataFrame:
    posts = raw.legacy_posts(raw.newer(_posts_written(d), "2001-10-05 00:00:00"), POSTS_AS_OF)
    return posts.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))


@query("snk15_legacy_upsert", f"{having('posts')}, old as (select account_id, post_url, max(likes) as likes from posts where posted_at < '2000-01-01' group by 1, 2), new as (select account_id, post_url, max(likes) + 7 as likes from posts where posted_at >= '1999-06-01' group by 1, 2) select account_id, post_url, coalesce(n.likes, o.likes) as likes from old o full join new n using (account_id, post_url)")
def _snk15(d: Domain) -> DataFrame:
    most = lambda df, more: df.groupBy("account_id", "post_url").agg((F.max("likes") + more).alias("likes"))
    return upsert.upsert(most(d.posts.where("posted_at < '2000-01-01'"), 0), most(d.posts.where("posted_at >= '1999-06-01'"), 7), ["account_id", "post_url"])


# ------------------------------------------------------------------ scans


@query("src10_posts_of_account", f"{having('posts', 'categories')} select likes, comments, shares, media_type, category from posts left join categories using (category_key) where account_id = 7")
def _src10(d: Domain) -> DataFrame:
    return metrics.with_category(d.posts.where("account_id = 7"), d.categories).select("likes", "comments", "shares", "media_type", "category")


@query("src11_snapshots_of_account", f"{having('points', 'weekly')} select week_start, followers from weekly where account_id = 7 and week_start >= date '2024-01-08'")
def _src11(d: Domain) -> DataFrame:
    return growth.weekly_snapshots(d.points.where("account_id = 7")).where("week_start >= '2024-01-08'").select("week_start", "followers").orderBy("week_start")


@query("src12_captions", "select doc_id as post_id, text as caption from documents where source = 'src1'")
def _src12(d: Domain) -> DataFrame:
    return d.table("documents").where("source = 'src1'").select(F.col("doc_id").alias("post_id"), F.col("text").alias("caption"))


@query("src13_accounts_of_analysis", f"{having('accounts')} select * from accounts where analysis_id = 2 and platform = '2'")
def _src13(d: Domain) -> DataFrame:
    return d.accounts.where("analysis_id = 2 and platform = '2'")


@query("srt2_next_pending", f"{having('analyses')} select analysis_id, created_at from analyses where status = 'pending' order by created_at, analysis_id limit 1")
def _next(d: Domain) -> DataFrame:
    return lifecycle.next_pending(d.analyses).select("analysis_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("src15_point_lookup", f"{having('analyses')} select analysis_id, status from analyses where analysis_id = 42")
def _lookup(d: Domain) -> DataFrame:
    return d.analyses.where("analysis_id = 42").select("analysis_id", "status")


@query("join4_accounts_of_status", f"{having('users', 'analyses')} select status, count(*) as analyses, count(distinct account_id) as accounts from analyses join users on customer = account_id group by 1")
def _join4(d: Domain) -> DataFrame:
    return d.analyses.join(d.users, F.col("customer") == F.col("account_id")).groupBy("status").agg(F.count(F.lit(1)).alias("analyses"), F.count_distinct("account_id").alias("accounts"))


# ------------------------------------------------------------------ projections and filters


@query("prj1_handles", "select c_custkey as k, regexp_replace(trim(h), '^@', '') as handle, regexp_replace(trim(h), '^@+', '') as legacy_handle from (select c_custkey, ' @@' || c_name || '  ' as h from customer)")
def _prj1(d: Domain) -> DataFrame:
    h = F.concat(F.lit(" @@"), F.col("c_name"), F.lit("  "))
    return d.table("customer").select(F.col("c_custkey").alias("k"), S.strip_handle(h).alias("handle"), S.legacy_handle(h).alias("legacy_handle"))


@query("prj2_media_types", f"select {_MEDIA_A} as a, case when t like '%video%' then 'video' when t like '%image%' or t like '%photo%' then 'image' end as c, count(*) as n from (select *, lower((['Sidecar', 'clips', 'GraphVideo', 'Photo', 'CAROUSEL_ALBUM', 'reel', 'Image', 'other'])[l_linenumber % 8 + 1]) as t from lineitem) group by 1, 2")
def _prj2(d: Domain) -> DataFrame:
    return d.table("lineitem").select(S.media_type_a(_type()).alias("a"), S.media_type_c(_type()).alias("c")).groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"))


@query("flt1_window", f"{having('posts')} select account_id, count(*) as n from posts where posted_at >= timestamp '2001-11-04' - interval 90 days group by 1")
def _flt1(d: Domain) -> DataFrame:
    since = F.lit(POSTS_AS_OF).cast("timestamp") - F.expr("interval 90 days")
    return d.posts.where(F.col("posted_at") >= since).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


def _requests(d: Domain) -> DataFrame:
    """A request per customer, broken in the ways that validation knows."""
    k, name = F.col("c_nationkey"), F.col("c_name")
    platforms = F.when(k == 1, F.expr("array()").cast("array<string>")).when(k == 2, F.array(F.lit("myspace"))).when(k % 2 == 0, F.array(F.lit("instagram"))).otherwise(F.array(F.lit("instagram"), F.lit("tiktok")))
    handles = F.create_map(F.lit("instagram"), F.concat(F.lit("@"), name), F.lit("tiktok"), F.when(k == 5, F.lit("  ")).otherwise(F.lit("tt")))
    rival = lambda i: F.struct(F.when((k == 6) & F.lit(i == 2), F.lit("")).otherwise(F.concat(F.lit(f"rival{i} "), name)).alias("name"), F.create_map(F.lit("instagram"), F.lit(f"@r{i}"), F.lit("tiktok"), F.lit(f"t{i}")).alias("handles"))
    rivals = F.when(k == 4, F.array(rival(1))).otherwise(F.array(rival(1), rival(2), rival(3)))
    body = F.to_json(F.struct(F.when(k != 0, name).alias("companyName"), F.col("c_mktsegment").alias("industry"), F.lit(" EU ").alias("region"), platforms.alias("platforms"), handles.alias("targetHandles"), rivals.alias("competitors")))
    return requests.parse(d.spread("customer").select(F.col("c_custkey").alias("request_id"), body.alias("body")))


@query("flt14_request_validation", "select c_custkey as request_id, case c_nationkey when 0 then 'Company name, industry, and region are required.' when 1 then 'Select at least one platform.' when 2 then 'Invalid platform selected.' when 4 then 'Exactly 3 competitors are required.' when 5 then 'Missing target handle.' when 6 then 'Missing competitor name/handle.' end as error from customer")
def _flt14(d: Domain) -> DataFrame:
    return requests.validate(_requests(d))


@query("snk1_new_analyses", "select c_custkey as analysis_id, c_name as company_name, c_mktsegment as industry, 'EU' as region, 90 as window_days, 'pending' as status, 'Queued.' as status_detail, case when c_nationkey % 2 = 0 then 'instagram' else 'instagram,tiktok' end as platforms from customer where c_nationkey not in (0, 1, 2, 4, 5, 6)")
def _snk1(d: Domain) -> DataFrame:
    return requests.analyses(_requests(d), POSTS_AS_OF).drop("created_at").withColumn("platforms", F.concat_ws(",", "platforms"))


@query("snk2_new_accounts", "select c_custkey as request_id, platform, role, case when i = 0 then c_name else 'rival' || i || ' ' || c_name end as display_name, case when platform = 'tiktok' then case when i = 0 then 'tt' else 't' || i end when i = 0 then c_name else 'r' || i end as handle from customer, (values ('instagram'), ('tiktok')) p(platform), (values (0, 'target'), (1, 'competitor'), (2, 'competitor'), (3, 'competitor')) a(i, role) where c_nationkey not in (0, 1, 2, 4, 5, 6) and (platform = 'instagram' or c_nationkey % 2 = 1)")
def _snk2(d: Domain) -> DataFrame:
    valid = _requests(d).where(requests.problem().isNull())
    return requests.handles(valid)


def _handle_checks(d: Domain) -> DataFrame:
    """Four handles a request; those of some nations have no profile, some profiles are empty."""
    c = d.table("customer")
    wanted = c.select(F.floor(F.col("c_custkey") / 4).alias("request_id"), F.lit("instagram").alias("platform"), F.col("c_name").alias("handle"), F.when(F.col("c_custkey") % 4 == 0, "target").otherwise("competitor").alias("role"), F.concat(F.lit(" "), F.col("c_name")).alias("display_name"))
    k = F.col("c_nationkey")
    there = c.where(~k.isin(0, 1, 2))
    profiles = raw.profile_a(_raw(there, "c_name", fullName=F.when(~k.isin(3, 4), F.col("c_name")), followersCount=F.when(k != 4, F.floor("c_acctbal")), biography=F.when(k != 4, F.nullif("c_mktsegment", F.lit("BUILDING")))))
    return requests.check_handles(wanted, profiles.withColumn("platform", F.lit("instagram")))


_CHECKS = """c as (select c_custkey // 4 as request_id, c_custkey % 4 = 0 as target, c_name as handle, case when c_nationkey not in (3, 4) then c_name end as profile_name, case when c_nationkey <> 4 then nullif(c_mktsegment, 'BUILDING') end as bio, c_nationkey not in (0, 1, 2) as there,
  case when c_nationkey = 4 then 0 else floor(c_acctbal)::bigint end as followers from customer),
k as (select *, there and not (followers = 0 and coalesce(profile_name, '') = '' and coalesce(bio, '') = '') as valid from c)"""


@query("flt13_handle_found", f"with {_CHECKS} select request_id, handle, valid, case when valid then followers end as followers, case when not valid then 'Account not found or the actor returned no data for this handle.' end as error from k")
def _flt13(d: Domain) -> DataFrame:
    return _handle_checks(d).select("request_id", "handle", "valid", "followers", "error")


@query("agg16_handle_checks", f"""with {_CHECKS}, t as (select *, case when target then 'Your business' else handle end || ' on instagram (@' || handle || '): Account not found or the actor returned no data for this handle.' as text from k)
select request_id, bool_and(valid) as all_valid, 'Couldn''t verify these handles — fix them before running the analysis: ' || string_agg(text, '; ' order by text) filter (where not valid) as message from t group by 1""")
def _agg16(d: Domain) -> DataFrame:
    return requests.all_valid(_handle_checks(d))


_FORMS = """f as (select c_custkey as request_id, case when c_nationkey = 0 then '' else c_name end as company, case when c_nationkey = 1 then '' else c_mktsegment end as industry, ' ' as region, case when c_nationkey <> 2 then '@x' end as target, c_nationkey % 8 as n from customer)"""


@query("flt15_legacy_form", f"""with {_FORMS} select request_id, case when n > 5 then 'Enter at most 5 competitors.' when company = '' or industry = '' or target is null or n = 0 then 'All fields are required.' end as error, n::int as n_competitors from f""")
def _flt15(d: Domain) -> DataFrame:
    return _forms(d).select("request_id", requests.legacy_problem().alias("error"), F.size(requests.legacy_competitors(F.col("competitors"))).alias("n_competitors"))


def _forms(d: Domain) -> DataFrame:
    k = F.col("c_nationkey")
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < k % 8, F.concat(F.lit(" @@rival"), i.cast("string"))).otherwise(F.lit("  ")))
    return d.table("customer").select(F.col("c_custkey").alias("request_id"), F.when(k != 0, F.col("c_name")).otherwise("").alias("company"), F.when(k != 1, F.col("c_mktsegment")).otherwise("").alias("industry"), F.lit(" ").alias("region"), F.when(k != 2, "@x").alias("target"), F.array_join(lines, "\n").alias("competitors"))


_FORMED = f"with {_FORMS}, valid as (select * from f where n between 1 and 5 and company <> '' and industry <> '' and target is not null)"


@query("snk15_legacy_accounts", f"{_FORMED} select request_id as analysis_id, case when i = 0 then target else 'rival' || (i - 1) end as handle, case when i = 0 then 'target' else 'competitor' end as role from valid, (select unnest(range(0, 6)) as i) where i <= n")
def _legacy_accounts(d: Domain) -> DataFrame:
    return legacy.new_accounts(_forms(d))


@query("snk15_legacy_profiles", "select s_suppkey as account_id, s_name as handle, case when c_custkey is not null then case when c_nationkey > 5 then floor(c_acctbal)::bigint end else -1 end as followers, case when c_custkey is not null then c_nationkey::bigint else -1 end as following, case when c_custkey is not null then c_mktsegment else 'old' end as bio from supplier left join customer on c_custkey = s_suppkey and c_custkey % 2 = 0")
def _legacy_profiles(d: Domain) -> DataFrame:
    accounts = d.table("supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("handle"), F.lit(-1).cast("long").alias("followers"), F.lit(-1).cast("long").alias("following"), F.lit("old").alias("bio"))
    scraped = d.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_nationkey") > 5, F.floor("c_acctbal").cast("long")).alias("followers"), F.col("c_nationkey").cast("long").alias("following"), F.col("c_mktsegment").alias("bio"))
    return legacy.update_profiles(accounts, scraped)


@query("snk15_legacy_reports", f"{_FORMED}, made as (select request_id as analysis_id, i from valid, (select unnest([1, 2]) as i) where request_id % 2 = 0 and (i = 1 or request_id % 4 = 0)) select v.request_id as analysis_id, case when count(i) > 0 then 'done' else 'scraping' end as status, count(i) as reports, coalesce(string_agg('out/' || v.request_id || '-' || i || '.pdf', ',' order by i), '') as paths from valid v left join made on analysis_id = request_id group by 1")
def _legacy_reports(d: Domain) -> DataFrame:
    """A first report of every second analysis, then another one of every fourth."""
    analyses = legacy.new_analyses(_forms(d))
    reports = analyses.where("false").select("analysis_id", F.lit("").alias("swot"), F.lit("").alias("pdf_path"))
    for i in (1, 2):
        path = F.concat(F.lit("out/"), F.col("analysis_id").cast("string"), F.lit(f"-{i}.pdf"))
        made = analyses.where(F.col("analysis_id") % (2 * i) == 0).select("analysis_id", F.to_json(F.struct(F.array(F.lit("x")).alias("strengths"))).alias("swot"), path.alias("pdf_path"))
        analyses, reports = legacy.finish(analyses, reports, made)
    listed = reports.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("reports"), F.array_join(F.array_sort(F.collect_list("pdf_path")), ",").alias("paths"))
    return analyses.join(listed, "analysis_id", "left").select("analysis_id", "status", F.coalesce("reports", F.lit(0)).alias("reports"), F.coalesce("paths", F.lit("")).alias("paths"))


# ------------------------------------------------------------------ upserts

_OLD, _NEW = "posted_at < '1999-01-01'", "posted_at >= '1998-01-01'"


def _batches(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Stored posts and a scrape that overlaps them by a year, each reduced to one row per key."""
    keys, order = ["account_id", "post_url"], [F.col(c) for c in ("posted_at", "likes", "category_key", "shares")]
    stored = upsert.last_per_key(d.posts.where(_OLD), keys, order).withColumn("scraped_at", F.lit("first"))
    fresh = upsert.last_per_key(d.posts.where(_NEW), keys, order).withColumn("likes", F.col("likes") + 1000).withColumn("scraped_at", F.lit("second"))
    return stored, fresh


_BATCHES = """ranked as (select *, posted_at < timestamp '1999-01-01' as o, posted_at >= timestamp '1998-01-01' as f from posts),
stored as (select * from (select *, row_number() over (partition by account_id, post_url order by posted_at desc, likes desc, category_key desc, shares desc nulls last) as r from ranked where o) where r = 1),
fresh as (select * from (select *, row_number() over (partition by account_id, post_url order by posted_at desc, likes desc, category_key desc, shares desc nulls last) as r from ranked where f) where r = 1)"""


_SNK6 = f"{having('posts')}, {_BATCHES} select account_id, post_url, case when f.account_id is not null then f.likes + 1000 else s.likes end as likes, case when f.account_id is not null then f.shares else s.shares end as shares, case when s.account_id is not null then 'first' else 'second' end as scraped_at from stored s full join fresh f using (account_id, post_url)"


@query("snk6_upsert_posts", _SNK6)
def _snk6(d: Domain) -> DataFrame:
    stored, fresh = _batches(d)
    return upsert.upsert(stored, fresh, ["account_id", "post_url"], keep=["scraped_at"]).select("account_id", "post_url", "likes", "shares", "scraped_at")


@query("snk6_merge_by_bucket", _SNK6)
def _snk6_buckets(d: Domain) -> DataFrame:
    """The same by buckets: a first batch makes the table, a second one is merged, twice."""
    stored, fresh = _batches(d)
    columns, keys = ["account_id", "post_url", "likes", "shares", "scraped_at"], ["account_id", "post_url"]
    table = Buckets(d.spark, scratch(d.spark), stored.select(*columns).schema, keys, buckets_for(d.posts.count()))
    table.merge(stored.select(*columns))
    for _ in range(2):
        table.merge(fresh.select(*columns), lambda have, new: upsert.upsert(have, new, keys, keep=["scraped_at"]))
    return table.read()


@query("snk5_insert_missing", f"{having('posts')}, {_BATCHES} select account_id, post_url, likes from stored union all select account_id, post_url, likes + 1000 from fresh f where not exists (select 1 from stored s where s.account_id = f.account_id and s.post_url = f.post_url)")
def _snk5(d: Domain) -> DataFrame:
    stored, fresh = _batches(d)
    return upsert.insert_missing(stored, fresh, ["account_id", "post_url"]).select("account_id", "post_url", "likes")


@query("snk4_set1_merge_snapshots", f"{having('points')}, w as (select *, date_trunc('week', ts)::date as week_start from points), live as (select account_id, week_start, arg_max(followers, (ts, ordinal)) + 5000 as followers from w group by 1, 2), hist as (select account_id, week_start, arg_max(followers, (ts, ordinal)) as followers from w where ts < timestamp '2024-01-20' group by 1, 2) select account_id, week_start, coalesce(h.followers, l.followers) as followers from live l full join hist h using (account_id, week_start)")
def _snk4(d: Domain) -> DataFrame:
    live = growth.weekly_snapshots(d.points).withColumn("followers", F.col("followers") + 5000)
    historical = growth.weekly_snapshots(d.points.where("ts < '2024-01-20'"))
    none = historical.where("false")
    return upsert.merge_snapshots(none, historical, live)


@query("snk7_upsert_categories", "select p_partkey as post_id, case when p_size % 9 < 7 then 'rule' else p_type end as category from part")
def _snk7(d: Domain) -> DataFrame:
    before = d.table("part").select(F.col("p_partkey").alias("post_id"), F.col("p_type").alias("category"))
    return upsert.upsert(before, d.categories.select(F.col("category_key").alias("post_id"), F.lit("rule").alias("category")), ["post_id"])


@query("snk3_update_profiles", "select s_suppkey as account_id, s_name as handle, coalesce('named ' || c_name, s_name) as display_name from supplier left join customer on c_custkey = s_suppkey")
def _snk3(d: Domain) -> DataFrame:
    s = d.table("supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("handle"), F.col("s_name").alias("display_name"))
    p = d.table("customer").join(s.select(F.col("account_id").alias("c_custkey")), "c_custkey", "left_semi")
    return upsert.upsert(s, p.select(F.col("c_custkey").alias("account_id"), F.concat(F.lit("named "), F.col("c_name")).alias("display_name")), ["account_id"])


@query("snk10_partial_report_upsert", "select o_orderkey as analysis_id, 'detailed' as report_type, case when o_orderstatus = 'F' then 'url' end as pdf_url, case when o_orderpriority like '1%' then 'content' end as content from orders where o_orderstatus = 'F' or o_orderpriority like '1%'")
def _snk10(d: Domain) -> DataFrame:
    o = d.table("orders")
    key = [F.col("o_orderkey").alias("analysis_id"), F.lit("detailed").alias("report_type")]
    empty = o.where("false").select(*key, F.lit("").alias("pdf_url"), F.lit("").alias("content"))
    content = o.where("o_orderpriority like '1%'").select(*key, F.lit("content").alias("content"))
    pdf = o.where("o_orderstatus = 'F'").select(*key, F.lit("url").alias("pdf_url"))
    keys = ["analysis_id", "report_type"]
    first = upsert.upsert(empty, content.withColumn("pdf_url", F.lit(None).cast("string")), keys)
    return upsert.upsert(first, pdf, keys)


@query("snk12_sweep_stuck", f"{having('analyses')}, a as (select *, status = 'computing' and created_at < timestamp '1998-06-01' - interval 30 minutes as stuck from analyses) select analysis_id, case when stuck then 'failed' else status end as status, case when stuck then 'Timed out — the worker stopped before finishing.' else status_detail end as status_detail from a")
def _snk12(d: Domain) -> DataFrame:
    return lifecycle.sweep_stuck(d.analyses, "1998-06-01 00:00:00").select("analysis_id", "status", "status_detail")


@query("snk11_claim", f"{having('analyses')} select analysis_id, case when analysis_id = 2 and status = 'pending' then 'scraping' else status end as status, case when analysis_id = 2 then status = 'pending' end as won from analyses")
def _snk11(d: Domain) -> DataFrame:
    return lifecycle.claim(d.analyses, 2).select("analysis_id", "status", "won")


_STAGES = lifecycle.RUNNING
_NEXT = " ".join(f"when '{a}' then '{b}'" for a, b in zip(_STAGES, lifecycle.ORDER[2:], strict=True))
_DETAIL = " ".join(f"when '{k}' then '{v}'" for k, v in lifecycle.DETAILS.items())


@query("snk13_status_transitions", f"""with a as (select o_orderkey as analysis_id, (['pending', 'scraping', 'categorizing', 'computing', 'synthesizing', 'rendering', 'done', 'failed'])[o_orderkey % 8 + 1] as status, case when o_custkey % 5 = 0 then 'Error ' || o_custkey end as error from orders),
b as (select *, status in ('scraping', 'categorizing', 'computing', 'synthesizing', 'rendering') as runs, case status {_NEXT} end as following from a)
select analysis_id, case when runs and error is not null then 'failed' when runs then following else status end as status,
  case when runs and error is not null then error when runs then case following {_DETAIL} end else '' end as status_detail from b""")
def _snk13(d: Domain) -> DataFrame:
    o = d.table("orders")
    status = F.element_at(F.array(*map(F.lit, S.STATUSES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    error = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("Error "), F.col("o_custkey").cast("string")))
    return lifecycle.advanced(o.select(F.col("o_orderkey").alias("analysis_id"), status.alias("status"), F.lit("").alias("status_detail"), error.alias("error"))).drop("error")


@query("snk12_snk13_job_states", f"""select o_orderkey as analysis_id, case when o_orderkey % 8 = 0 then 'pending' when o_orderkey % 8 = 6 then 'done' else 'failed' end as status,
  case when o_orderkey % 8 = 0 then '' when o_orderkey % 8 = 6 then '{lifecycle.DETAILS['done']}' when o_orderkey % 8 = 7 then 'Error 7' else '{lifecycle.TIMED_OUT}' end as status_detail from orders""")
def _job_states(d: Domain) -> DataFrame:
    """Jobs of 0 to 7 events after their request; those left running are over when half an hour has passed."""
    kind = F.col("o_orderkey") % 8
    rows = d.table("orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderdate").cast("timestamp").alias("at"), kind.cast("int").alias("kind"))
    rows = rows.select("analysis_id", "at", "kind", F.explode(F.sequence(F.lit(0), F.col("kind"))).alias("k"))
    event = F.when(F.col("k") == 0, "request").when(F.col("k") == 1, "claim").when((F.col("k") == 4) & (F.col("kind") == 7), "error").otherwise("finished")
    events = rows.select("analysis_id", (F.col("at") + F.make_dt_interval(mins=F.col("k"))).alias("at"), event.alias("event"), F.when(event == "error", "Error 7").alias("detail"), F.col("k").cast("long").alias("ordinal"))
    ahead = events.where("false").unionByName(d.spark.sql("select timestamp '2100-01-01' as at, 'tick' as event, cast(null as string) as detail, 0L as ordinal").withColumn("analysis_id", F.lit(-1).cast(events.schema["analysis_id"].dataType)))
    changes = _fed(d, [events, ahead], lambda df: states.job_states(df, "EventTime", "3650 days"))
    return states.current(changes)


@query("snk17_violations", "select 'unique account_id, post_url' as rule, count(*) as n from (select 1 from lineitem group by l_suppkey, l_orderkey, l_linenumber having count(*) > 1) having count(*) > 0 union all select 'not null media_type', count(*) from lineitem where l_returnflag = 'A' having count(*) > 0 union all select 'check media_type', count(*) from lineitem where l_returnflag = 'R' having count(*) > 0")
def _snk17(d: Domain) -> DataFrame:
    return upsert.violations(d.posts, unique=[["account_id", "post_url"]], required=["account_id", "media_type"], allowed={"media_type": ["N"]})


@query("snk17_foreign_keys", f"{having('accounts', 'points')} select p.account_id, count(*) as n from points p where not exists (select 1 from accounts a where a.account_id = p.account_id) group by 1")
def _orphans(d: Domain) -> DataFrame:
    return upsert.orphans(d.points, d.accounts, "account_id", "account_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


@query("snk17_cascade", f"{having('accounts', 'posts')} select account_id, count(*) as n from posts where account_id not in (select account_id from accounts where platform = '1') group by 1")
def _cascade(d: Domain) -> DataFrame:
    return upsert.cascade(d.posts, d.accounts.where("platform = '1'"), "account_id", "account_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


@query("snk17_cascade_levels", f"""{having('accounts', 'posts', 'categories', 'points', 'weekly')}, gone as (select account_id from accounts where analysis_id in (1, 4)),
s as (select w.* from weekly w join accounts using (account_id)), pc as (select post_url from posts join categories using (category_key))
select 'accounts' as child, 'analysis_id' as \"column\", (select count(*) from accounts where analysis_id not in (1, 4)) as rows_left, 0::bigint as n
union all select 'account_snapshots', 'account_id', (select count(*) from s where account_id not in (select account_id from gone)), 0
union all select 'posts', 'account_id', (select count(*) from posts where account_id not in (select account_id from gone)), (select count(*) from posts where account_id not in (select account_id from accounts))
union all select 'post_categories', 'post_id', (select count(*) from pc where post_url not in (select post_url from posts where account_id in (select account_id from gone))), 0""".replace('\\"', '"'))
def _cascade_levels(d: Domain) -> DataFrame:
    """Two analyses go, with accounts, snapshots and posts, and the categories of these posts."""
    posts = d.posts.withColumnRenamed("post_url", "post_id")
    tables = {
        "analyses": d.accounts.select("analysis_id").distinct(), "accounts": d.accounts, "posts": posts.select("post_id", "account_id"),
        "account_snapshots": growth.weekly_snapshots(d.points).join(d.accounts.select("account_id"), "account_id"),
        "post_categories": posts.join(d.categories, "category_key").select("post_id", "category"),
    }
    left = constraints.delete(tables, "analyses", "analysis_id in (1, 4)")
    alone = constraints.orphans(left)
    sizes = [frame.agg(F.count(F.lit(1)).alias("rows_left")).withColumn("child", F.lit(name)) for name, frame in left.items() if name != "analyses"]
    counts = sizes[0]
    for part in sizes[1:]:
        counts = counts.unionByName(part)
    return alone.join(counts, "child").select("child", "column", "rows_left", "n")


# ------------------------------------------------------------------ read models


@query("agg14_upper_median", f"{having('accounts')} select analysis_id, platform, followers as median from (select *, row_number() over (partition by analysis_id, platform order by followers) as r, count(*) over (partition by analysis_id, platform) as n from accounts) where r = n // 2 + 1")
def _median(d: Domain) -> DataFrame:
    return readmodels.upper_median(d.accounts, "followers", metrics.GROUP)


@query("agg15_distinct_media", f"{having('posts')} select distinct coalesce(media_type, 'unknown') as media_type from posts")
def _distinct(d: Domain) -> DataFrame:
    return d.posts.select(F.coalesce("media_type", F.lit("unknown")).alias("media_type")).distinct()


@query("cht1_landscape", f"{having('accounts', 'posts')},\n{_METRICS}, m as (select analysis_id, platform, handle, followers, engagement_rate * 100 as rate_pct, role = 'target' as is_target, row_number() over (partition by analysis_id, platform order by followers, handle) as rf, row_number() over (partition by analysis_id, platform order by engagement_rate * 100, handle) as rr, count(*) over (partition by analysis_id, platform) as n from metrics) select analysis_id, platform, handle, followers, rate_pct, is_target, max(followers) filter (where rf = n // 2 + 1) over (partition by analysis_id, platform) as median_followers, max(rate_pct) filter (where rr = n // 2 + 1) over (partition by analysis_id, platform) as median_rate_pct from m")
def _cht1(d: Domain) -> DataFrame:
    return readmodels.landscape(metrics.account_metrics(d.accounts, d.posts))


def _listed(column: str, text: Callable[[Column], Column]) -> Column:
    """A map by handle as text, in order of handle."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), text(e["value"]))), ",").alias(column)


@query("cht2_weekly_series", f"""{having('accounts', 'points', 'weekly')} select analysis_id, platform, (row_number() over (partition by analysis_id, platform order by week_start))::int as position, week_start, followers
from (select analysis_id, platform, week_start, string_agg(handle || '=' || w.followers, ',' order by handle) as followers from weekly w join accounts a using (account_id) group by 1, 2, 3)""")
def _cht2(d: Domain) -> DataFrame:
    return readmodels.weekly_series(d.accounts, growth.weekly_snapshots(d.points)).withColumn("followers", _listed("followers", lambda x: x.cast("string")))


@query("cht3_media_series", f"""{having('accounts', 'posts')}, b as (select account_id, coalesce(media_type, 'unknown') as media_type, {r('sum(likes + comments)::double / count(*)')} as e from posts group by 1, 2),
t as (select distinct analysis_id, platform, media_type from b join accounts using (account_id))
select analysis_id, platform, (row_number() over (partition by analysis_id, platform order by media_type))::int as position, media_type, avg_engagement
from (select t.analysis_id, t.platform, t.media_type, string_agg(handle || '=' || {num('coalesce(e, 0e0)')}, ',' order by handle) as avg_engagement
  from t join accounts a on a.analysis_id = t.analysis_id and a.platform = t.platform left join b on b.account_id = a.account_id and b.media_type = t.media_type group by 1, 2, 3)""")
def _cht3(d: Domain) -> DataFrame:
    return readmodels.media_series(d.accounts, metrics.media_breakdown(d.posts)).withColumn("avg_engagement", _listed("avg_engagement", S.number_text))


@query("cht4_category_dots", f"{having('accounts', 'posts', 'categories')},\n{_METRICS}, {_CATS} select analysis_id, platform, handle, category, avg_engagement, baseline_engagement from breakdown join metrics using (account_id) where category <> 'other' and baseline_engagement > 0")
def _cht4(d: Domain) -> DataFrame:
    return readmodels.category_dots(metrics.account_metrics(d.accounts, d.posts), metrics.category_breakdown(metrics.with_category(d.posts, d.categories)))


def fixed(x: str) -> str:
    """One decimal of a number of two, exact ties (.25 and .75) away from zero."""
    return f"case when {x} * 4 = floor({x} * 4) and {x} * 2 <> floor({x} * 2) then format('{{:.1f}}', sign({x}) * (floor(abs({x}) * 10) + 1) / 10) else format('{{:.1f}}', {x}) end"


_SCORES = f"""scores as (select analysis_id, platform, case when role = 'target' then '★ ' else '' end || handle as account, format('{{:,}}', followers) || ' (p' || followers_percentile || ')' as followers,
  coalesce({fixed("cumulative_growth_pct")} || '%', 'data gap') as growth, format('{{:.2f}}', engagement_rate * 100) || '% (p' || engagement_rate_percentile || ')' as rate, low_sample_warning is not null as low_sample,
  {num("avg_likes")} as avg_likes, {num("avg_comments")} as avg_comments, {num("posts_per_week")} as posts_per_week from metrics left join cumulative using (account_id))"""
_NOTES = """notes as (select analysis_id, platform, coalesce(string_agg(handle, ', ' order by handle) filter (where low_sample_warning is not null), '') as low_sample_handles,
  arg_min(growth_data_gap, handle) filter (where growth_data_gap is not null) as growth_gap from metrics left join cumulative using (account_id) group by 1, 2)"""
_LINES = f"""lines as (select analysis_id, platform, handle, post_count || ' collaboration/paid posts' || coalesce(', ' || {num("vs_baseline_multiplier")} || 'x baseline engagement', ' (no baseline comparison available)') as line
  from accounts join collab using (account_id))"""


@query("cht5_scoreboard", f"{having('accounts', 'posts', 'points', 'weekly', 'users')},\n{_METRICS}, {_CUMULATIVE}, {_SCORES} select * from scores")
def _cht5(d: Domain) -> DataFrame:
    return readmodels.scoreboard(metrics.account_metrics(d.accounts, d.posts), growth.cumulative_growth(d.users, growth.weekly_snapshots(d.points)))


@query("agg17_footnotes", f"{having('accounts', 'posts', 'points', 'weekly', 'users')},\n{_METRICS}, {_CUMULATIVE}, {_NOTES} select * from notes")
def _agg17(d: Domain) -> DataFrame:
    return readmodels.footnotes(metrics.account_metrics(d.accounts, d.posts), growth.cumulative_growth(d.users, growth.weekly_snapshots(d.points)))


@query("cht6_cadence_lines", f"{having('accounts', 'posts', 'categories')}, {_COLLAB}, {_LINES} select * from lines")
def _cht6(d: Domain) -> DataFrame:
    return readmodels.cadence_lines(d.accounts, metrics.collaboration(d.accounts, metrics.with_category(d.posts, d.categories)))


@query("cht7_volume_quality", f"{having('accounts', 'posts')},\n{_METRICS}, m as (select *, row_number() over (partition by analysis_id, platform order by posts_per_week) as rp, row_number() over (partition by analysis_id, platform order by avg_likes) as rl, count(*) over (partition by analysis_id, platform) as n from metrics) select analysis_id, platform, handle, posts_per_week, avg_likes, max(posts_per_week) filter (where rp = n // 2 + 1) over (partition by analysis_id, platform) as median_posts_per_week, max(avg_likes) filter (where rl = n // 2 + 1) over (partition by analysis_id, platform) as median_avg_likes from m")
def _cht7(d: Domain) -> DataFrame:
    return readmodels.volume_quality(metrics.account_metrics(d.accounts, d.posts))


@query("cht11_status", f"{having('analyses')} select analysis_id, status, case when analysis_id % 2 = 0 then 2 else 1 end as n_reports from analyses where analysis_id = 42")
def _cht11(d: Domain) -> DataFrame:
    o = d.table("orders").select(F.col("o_orderkey").alias("analysis_id"))
    reports = o.select("analysis_id", F.explode(F.when(F.col("analysis_id") % 2 == 0, F.array(F.lit("customer"), F.lit("detailed"))).otherwise(F.array(F.lit("detailed")))).alias("report_type")).withColumn("pdf_url", F.lit(None).cast("string"))
    return readmodels.status(d.analyses, reports, 42).select("analysis_id", "status", F.size("reports").alias("n_reports"))


# ------------------------------------------------------------------ classification and synthesis


def _like(words: list[str]) -> str:
    return " or ".join(f"contains(t, '{w}')" for w in words)


_RULES = " ".join(f"when {_like(words)} then '{name}'" for name, words in classify.SIGNALS.items())


@query("udf1_classify_rules", f"select doc_id as post_id, category, case when category = 'other' then 0.5e0 else 0.9e0 end as confidence from (select doc_id, case {_RULES} when lang = 'fr' then 'collaboration' else 'other' end as category from (select doc_id, lang, lower(coalesce(text, '')) as t from documents))")
def _udf1(d: Domain) -> DataFrame:
    posts = d.table("documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("caption"), F.when(F.col("lang") == "fr", F.lit("partner")).alias("coauthor_handle"))
    return classify.by_rules(posts).select("post_id", "category", "confidence")


@query("udf1_classify_lookup", "select doc_id as post_id, coalesce(case when quality = 1 then 'educational' else 'campaign' end, 'other') as category from documents left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id) where quality is not null union all select doc_id, 'other' from documents where doc_id not in (select doc_id from labels)")
def _udf1_lookup(d: Domain) -> DataFrame:
    known = d.table("labels").groupBy(F.col("doc_id").alias("post_id")).agg(F.max("quality").alias("q")).select("post_id", F.when(F.col("q") == 1, "educational").otherwise("campaign").alias("category"))
    return classify.by_lookup(d.table("documents").select(F.col("doc_id").alias("post_id")), known)


_ANSWERED = f"select doc_id::varchar as post_id, category, case when category = 'other' then 0.5e0 else 0.9e0 end as confidence, 1::bigint as answers from (select doc_id, case {_RULES} when lang = 'fr' then 'collaboration' else 'other' end as category from (select doc_id, lang, lower(coalesce(text, '')) as t from documents))"


@query("udf1_classify_resumable", _ANSWERED)
def _resumable(d: Domain) -> DataFrame:
    """A model that fails for a third of its calls, and passes over a fifth of a chunk's posts: each is answered once."""
    posts = d.table("documents").select(F.col("source").alias("account_id"), F.col("doc_id").alias("post_id"), F.col("text").alias("caption"), F.when(F.col("lang") == "fr", F.lit("partner")).alias("coauthor_handle"))
    signals = classify.SIGNALS

    def model(sent: list[dict]) -> list[dict]:
        if len(sent) > 3 and sum(int(x["id"]) for x in sent) % 3 == 0:
            raise TimeoutError("no answer")
        out = []
        for k, x in enumerate(sent):
            low = x["caption"].lower() if x["caption"] != "(no caption)" else ""
            category = next((name for name, words in signals.items() if any(w in low for w in words)), "collaboration" if x["coauthor"] != "none" else "other")
            if k % 5 != 4:
                out.append({"post_id": x["id"], "category": category, "confidence": 0.5 if category == "other" else 0.9, "rationale": "signals"})
        return out[::-1]

    table = Buckets(d.spark, scratch(d.spark), T.StructType.fromDDL(classify.ANSWER), ["post_id"], 8)
    classify.answer_all(posts, model, table, rounds=12)
    return table.read().groupBy("post_id").agg(F.first("category").alias("category"), F.first("confidence").alias("confidence"), F.count(F.lit(1)).alias("answers"))


@query("set3_classification_chunks", f"{having('posts')} select account_id, chunk, count(*) as n, min(post_url) as first_post from (select account_id, post_url, ((row_number() over (partition by account_id order by post_url) - 1) // 40)::int as chunk from posts) group by 1, 2")
def _set3(d: Domain) -> DataFrame:
    return classify.chunked(d.posts, "account_id", "post_url").groupBy("account_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("post_url").alias("first_post"))


def _sentences(*buckets: tuple[str, list[str]]) -> str:
    return " union all ".join(f"select analysis_id, platform, '{b}' as bucket, {i}::int as position, {x} as sentence from s" for b, own in buckets for i, x in enumerate(own))


_INSIGHTS = f"""s as (select analysis_id, platform, count(*) as n, arg_max(handle, (engagement_rate, handle)) as top, max(engagement_rate) as rate, arg_max(handle, (followers, handle)) as big, max(followers) as followers,
  count(low_sample_warning) as low, arg_max(handle, (posts_per_week, handle)) as busy, max(posts_per_week) as cadence from metrics group by 1, 2),
insights as ({_sentences(
    ("data_observations", [f"top || ' has the highest engagement rate of ' || n || ' accounts: ' || {num('(floor(rate * 10000 + 0.5) / 100)')} || '%.'", "big || ' has the largest audience: ' || format('{:,}', followers) || ' followers.'", "low || ' accounts carry a low-sample warning.'"]),
    ("explanations", ["'This may be because ' || top || ' reaches a smaller, closer audience.'", f"'A plausible driver is the cadence of ' || busy || ': ' || {num('cadence')} || ' posts a week.'"]),
    ("recommendations", ["'Test the formats of ' || top || '; success is a higher engagement rate.'", "'Test the cadence of ' || busy || '; success is more posts per week at equal average likes.'", "'Test collaborations; success is a multiplier above 1 against the baseline.'"]),
)}),
everything as (select analysis_id, 'all' as platform, bucket, (row_number() over (partition by analysis_id, bucket order by position, platform) - 1)::int as position, platform || ': ' || sentence as sentence from insights),
with_all as (select * from insights union all select * from everything where position < case bucket when 'explanations' then 5 else 6 end)"""
_FROM_POSTS = f"{having('accounts', 'posts')},\n{_METRICS},\n{_INSIGHTS}"


def _insights(d: Domain) -> DataFrame:
    return synthesis.platform_insights(metrics.account_metrics(d.accounts, d.posts))


@query("udf2_platform_insights", f"{_FROM_POSTS} select * from insights")
def _udf2(d: Domain) -> DataFrame:
    return synthesis.ranked(_insights(d))


@query("udf2_synthesised", f"{_FROM_POSTS} select *, true as ok from insights")
def _synthesised(d: Domain) -> DataFrame:
    """The same through the stage that a model plugs into: metrics as JSON documents, answers checked."""
    docs = synthesis.documents(metrics.account_metrics(d.accounts, d.posts))
    found = synthesis.accepted(synthesis.produced(docs, synthesis.insights_by_rule, synthesis.SIZES))
    checked = synthesis.sizes_hold(found, synthesis.SIZES)
    return synthesis.ranked(checked, keys=["analysis_id", "platform", "ok"])


@query("udf2_rejected", f"{_FROM_POSTS} select analysis_id, platform, 'explanations: 0 entries, 2 to 5 asked for' as problem from s where n % 2 = 0 union all select analysis_id, platform, 'ValueError: no answer' from s where n % 2 = 1 and n % 3 = 0")
def _rejected(d: Domain) -> DataFrame:
    def model(document: dict) -> dict:
        """Leaves something out of some answers, and fails on others."""
        n, answer = len(document["accounts"]), synthesis.insights_by_rule(document)
        if n % 2 == 0:
            return {**answer, "explanations": []}
        if n % 3 == 0:
            raise ValueError("no answer")
        return answer

    docs = synthesis.documents(metrics.account_metrics(d.accounts, d.posts))
    return synthesis.rejected(synthesis.produced(docs, model, synthesis.SIZES))


@query("udf3_cross_platform_insights", f"{_FROM_POSTS} select * from with_all where platform = 'all'")
def _udf3(d: Domain) -> DataFrame:
    return synthesis.ranked(synthesis.with_all(_insights(d)).where("platform = 'all'"))


@query("flt12_all_and_others", f"{_FROM_POSTS} select analysis_id, count(*) filter (where platform = 'all') as n_all, count(*) filter (where platform <> 'all') as n_platforms from (select distinct analysis_id, platform from with_all) group by 1")
def _flt12(d: Domain) -> DataFrame:
    rows = synthesis.with_all(_insights(d))
    return rows.groupBy("analysis_id").agg(F.count_if(F.col("platform") == "all").alias("n_all"), F.count_if(F.col("platform") != "all").alias("n_platforms"))


@query("snk8_snk9_insights", f"{_FROM_POSTS}, before as (select distinct analysis_id, platform from with_all where analysis_id < 3 union all select 99, 'all') select analysis_id, platform, bucket, position, sentence from with_all where not (analysis_id < 3 and platform = '1') union all select analysis_id, platform, 'explanations', 0, 'stale' from before where analysis_id = 99 or platform = '1'")
def _snk8(d: Domain) -> DataFrame:
    new = synthesis.with_all(_insights(d))
    fresh = new.where("not (analysis_id < 3 and platform = '1')")  # an earlier run's rows stay where this one has none
    none = F.array().cast("array<string>")
    stale = lambda df: df.select("analysis_id", "platform", none.alias("data_observations"), F.array(F.lit("stale")).alias("explanations"), none.alias("recommendations"))
    before = stale(new.where("analysis_id < 3")).unionByName(stale(new.limit(1).select(F.lit(99).cast(new.schema["analysis_id"].dataType).alias("analysis_id"), F.lit("all").alias("platform"))))
    return synthesis.ranked(synthesis.stored_insights(before, fresh))


_ALL = "select analysis_id, position, sentence from everything where bucket = '{}' and position < {}"


@query("udf4_customer_report", f"""{_FROM_POSTS},
o as ({_ALL.format("data_observations", 6)}), e as ({_ALL.format("explanations", 5)}), t as ({_ALL.format("recommendations", 6)})
select analysis_id, 'key_findings' as bucket, position, sentence from o where position < 3 union all select analysis_id, 'working_content_patterns', position, sentence from e
union all select analysis_id, 'competitive_gaps', position - 1, sentence from o where position between 1 and 3 union all select analysis_id, 'experiments', position, sentence from t where position < 5
union all select analysis_id, 'day' || ((position + 1) * 30) || '_actions', 0, 'By day ' || ((position + 1) * 30) || ': ' || sentence from t where position < 3
union all select analysis_id, 'day' || ((position + 1) * 30) || '_success_metrics', 0, regexp_extract(sentence, 'success is (.*)[.]$', 1) from t where position < 3""")
def _udf4(d: Domain) -> DataFrame:
    return synthesis.report_lines(synthesis.customer_report(synthesis.with_all(_insights(d))))


def _either(c: str, hi: str, lo: str) -> str:
    return f"case when {c} >= 50 then '{hi}' else '{lo}' end"


_SWOT = [
    ("strengths", ["'Engagement percentile ' || engagement_rate_percentile", "'Likes percentile ' || avg_likes_percentile"]),
    ("weaknesses", ["'Audience percentile ' || followers_percentile", _either("followers_percentile", "Reach is not the limit", "Reach is below the median")]),
    ("opportunities", [
        f"case when close_most > engagement_rate then 'Learn from ' || close || ', which engages ' || {num('(floor(close_most * 10000 + 0.5) / 100)')} || '% of its followers' else 'Build on the highest engagement rate of the platform' end",
        f"case when busy_most > posts_per_week then 'Raise the cadence towards ' || {num('busy_most')} || ' posts a week' else 'Keep the highest cadence and test other formats' end",
    ]),
    ("threats", [
        "case when big_most > followers then big || ' has a larger audience: ' || format('{:,}', big_most) || ' followers' else 'No competitor has a larger audience' end",
        f"case when busy_most > posts_per_week then busy || ' posts more often: ' || {num('busy_most')} || ' a week' else 'No competitor posts more often' end",
    ]),
    ("keep_doing", ["'Hold the engagement rate at percentile ' || engagement_rate_percentile", f"'Hold average likes at ' || {num('avg_likes')}"]),
    ("urgent", [_either("engagement_rate_percentile", "Protect the engagement rate", "Raise the engagement rate"), _either("avg_likes_percentile", "Protect average likes", "Raise average likes")]),
    ("mid_term", [f"'Test a cadence above ' || {num('posts_per_week')} || ' posts per week'", "'Test collaborations against the baseline engagement'"]),
    ("long_term", ["'Grow followers beyond percentile ' || followers_percentile", "'Measure follower growth, which is a data gap in a single run'"]),
]


@query("udf5_legacy_swot", f"{having('accounts', 'posts')},\n{_METRICS}, rivals as (select analysis_id, platform, arg_max(handle, (followers, handle)) as big, max(followers) as big_most, arg_max(handle, (posts_per_week, handle)) as busy, max(posts_per_week) as busy_most, arg_max(handle, (engagement_rate, handle)) as close, max(engagement_rate) as close_most from metrics where role = 'competitor' group by 1, 2), s as (select * from metrics left join rivals using (analysis_id, platform) where role = 'target') {_sentences(*_SWOT)}")
def _udf5(d: Domain) -> DataFrame:
    return synthesis.ranked(synthesis.swot(metrics.account_metrics(d.accounts, d.posts)), (*synthesis.SWOT, *synthesis.ADVICE))


@query("cht9_detailed_page", f"""{having('accounts', 'posts', 'categories', 'points', 'weekly', 'users')},\n{_METRICS}, {_CUMULATIVE}, {_COLLAB},\n{_SCORES},\n{_NOTES},\n{_LINES},\n{_INSIGHTS},
boards as (select analysis_id, platform, string_agg(account || ' | ' || followers || ' | ' || growth || ' | ' || rate || case when low_sample then ' (low sample)' else '' end || ' | ' || avg_likes || ' | ' || avg_comments || ' | ' || posts_per_week, chr(10) order by account) as scoreboard from scores group by 1, 2),
cadences as (select analysis_id, platform, string_agg(handle || ': ' || line, chr(10) order by handle) as cadence from lines group by 1, 2),
texts as (select analysis_id, platform, string_agg(sentence, chr(10) order by position) filter (where bucket = 'data_observations') as data_observations,
  string_agg(sentence, chr(10) order by position) filter (where bucket = 'explanations') as explanations, string_agg(sentence, chr(10) order by position) filter (where bucket = 'recommendations') as recommendations from with_all group by 1, 2)
select analysis_id, platform, scoreboard, low_sample_handles, growth_gap, cadence, data_observations, explanations, recommendations
from texts left join boards using (analysis_id, platform) left join notes using (analysis_id, platform) left join cadences using (analysis_id, platform)""")
def _cht9(d: Domain) -> DataFrame:
    rows = metrics.account_metrics(d.accounts, d.posts)
    cumulative = growth.cumulative_growth(d.users, growth.weekly_snapshots(d.points))
    lines = readmodels.cadence_lines(d.accounts, metrics.collaboration(d.accounts, metrics.with_category(d.posts, d.categories)))
    page = readmodels.detailed_page(readmodels.scoreboard(rows, cumulative), readmodels.footnotes(rows, cumulative), lines, synthesis.with_all(synthesis.platform_insights(rows)))
    rate = lambda x: F.concat(x["rate"], F.when(x["low_sample"], " (low sample)").otherwise(""))
    board = F.transform("scoreboard", lambda x: F.concat_ws(" | ", x["account"], x["followers"], x["growth"], rate(x), x["avg_likes"], x["avg_comments"], x["posts_per_week"]))
    joined = {c: F.array_join(x, "\n").alias(c) for c, x in (("scoreboard", board), *((c, F.col(c)) for c in ("cadence", "data_observations", "explanations", "recommendations")))}
    return page.select("analysis_id", "platform", joined["scoreboard"], "low_sample_handles", "growth_gap", *[joined[c] for c in ("cadence", "data_observations", "explanations", "recommendations")])


# ------------------------------------------------------------------ earlier prototype

def py(x: str, digits: int) -> str:
    """The nearest decimal by exact binary value: what printing does."""
    return f"format('{{:.{digits}f}}', {x})::double"


_LEGACY = f"""{_SUMS},
legacy as (select account_id, analysis_id, handle, role, followers, post_count as post_count_30d, {py("l", 2)} as avg_likes, {py("c", 2)} as avg_comments,
  {py("case when followers <> 0 then (l + c) / followers else 0e0 end", 4)} as engagement_rate, {py("case when followers <> 0 then l / followers else 0e0 end", 4)} as likes_rate,
  {py("case when followers <> 0 then c / followers else 0e0 end", 4)} as comments_rate, {py("post_count / (30 / 7::double)", 2)} as posts_per_week from raw)"""


def _rank(c: str) -> str:
    return f"{py(f'1e2 * count(*) over (partition by analysis_id order by {c}) / count(*) over (partition by analysis_id)', 0)}::bigint as {c}_percentile"


@query("agg18_agg19_legacy_metrics", f"{having('accounts', 'posts')},\n{_LEGACY} select account_id, post_count_30d, avg_likes, avg_comments, engagement_rate, likes_rate, comments_rate, posts_per_week from legacy")
def _legacy(d: Domain) -> DataFrame:
    return legacy.legacy_metrics(d.accounts, d.posts).select("account_id", "post_count_30d", "avg_likes", "avg_comments", "engagement_rate", "likes_rate", "comments_rate", "posts_per_week")


@query("win6_legacy_percentiles", f"{having('accounts', 'posts')},\n{_LEGACY} select account_id, {', '.join(map(_rank, legacy.RANKED))} from legacy")
def _win6(d: Domain) -> DataFrame:
    return legacy.legacy_metrics(d.accounts, d.posts).select("account_id", *[f"{c}_percentile" for c in legacy.RANKED])


@query("agg20_legacy_categories", f"{having('posts', 'categories')}, cp as (select p.*, coalesce(c.category, 'other') as category from posts p left join categories c using (category_key)), base as (select account_id, sum(likes + comments)::double / count(*) as baseline from cp group by 1) select account_id, category, count(*) as post_count, {py('sum(likes + comments)::double / count(*)', 2)} as avg_engagement, {py('any_value(baseline)', 2)} as baseline_engagement, case when any_value(baseline) > 0 then {py('sum(likes + comments)::double / count(*) / any_value(baseline)', 2)} end as vs_baseline_multiplier from cp join base using (account_id) group by 1, 2")
def _agg20(d: Domain) -> DataFrame:
    return legacy.legacy_categories(metrics.with_category(d.posts, d.categories))


@query("cht12_agg21_legacy_scoreboard", f"{having('accounts', 'posts')},\n{_LEGACY} select analysis_id, handle, role, followers, {_rank('followers')}, engagement_rate, {_rank('engagement_rate')}, avg_likes, avg_comments, posts_per_week, count(*) over (partition by analysis_id) - 1 as n_competitors from legacy")
def _cht12(d: Domain) -> DataFrame:
    return legacy.legacy_scoreboard(legacy.legacy_metrics(d.accounts, d.posts))


@query("cht8_followers_engagement", f"{having('accounts', 'posts')},\n{_LEGACY} select analysis_id, handle, case when followers = 0 then 1 else followers end::bigint as followers, engagement_rate * 100 as rate_pct from legacy")
def _cht8(d: Domain) -> DataFrame:
    return legacy.followers_engagement(legacy.legacy_metrics(d.accounts, d.posts))


@query("s28_history_across_analyses", f"{having('points', 'weekly', 'users')} select handle, week_start, followers from weekly join users using (account_id)")
def _s28(d: Domain) -> DataFrame:
    named = d.points.join(d.users, "account_id")
    return growth.weekly_snapshots(named, ["handle"])
