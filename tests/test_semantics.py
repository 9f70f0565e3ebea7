"""One small case for each rule of the domain, with the expected rows written out."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from quorumlens.functions import scalar as S
from quorumlens.operators import classify, growth, legacy, lifecycle, metrics, readmodels, requests, synthesis, upsert
from quorumlens.sources import raw

ACCOUNTS = "account_id string, analysis_id int, handle string, platform string, role string, followers int"
POSTS = "account_id string, likes int, comments int, shares int, media_type string, category_key int"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def account(spark, followers=500, posts=(), **more):
    accounts = spark.createDataFrame([("a", 1, "h", "p", "target", followers)], ACCOUNTS)
    rows = [("a", *(p + (None,) * (5 - len(p)))) for p in posts]
    return metrics.account_metrics(accounts, spark.createDataFrame(rows, POSTS), **more).first()


@pytest.mark.parametrize("x, digits, want", [(-2.5, 0, -2.0), (1.005, 2, 1.0), (2.5, 0, 3.0), (0.125, 2, 0.13)])
def test_rounding_goes_up_at_half(spark, x, digits, want):
    assert one(spark, S.js_round(F.col("v"), digits), v=x) == want


@pytest.mark.parametrize("values, want", [([1, 2, 2, 4], [25, 75, 75, 100]), ([1, 5, 9], [33, 67, 100])])
def test_percentiles_count_ties_upwards(spark, values, want):
    df = spark.createDataFrame([("p", v) for v in values], "platform string, v int")
    assert sorted(r["x"] for r in df.select(metrics.percentile("v", ["platform"]).alias("x")).collect()) == want


def test_account_without_posts(spark):
    r = account(spark)
    assert (r["avg_likes"], r["avg_comments"], r["avg_shares"], r["engagement_rate"], r["posts_per_week"], r["post_count"]) == (0, 0, None, 0, 0, 0)
    assert r["low_sample_warning"].startswith("Reach is small (500 followers, ~0 avg interactions/post)")


def test_shares_average_only_those_there(spark):
    r = account(spark, 1000, [(10, 0, None), (10, 0, 4)])
    assert r["avg_shares"] == 4 and r["engagement_rate"] == 0.014 and r["baseline_engagement"] == 10


def test_followers_missing_count_as_none(spark):
    r = account(spark, None, [(50, 1)])
    assert r["followers"] == 0 and r["engagement_rate"] == 0 and r["low_sample_warning"]


def test_cadence_divides_by_the_window(spark):
    assert account(spark, 5000, [(20, 1)] * 9)["posts_per_week"] == 0.7


@pytest.mark.parametrize("followers, likes, warned", [(1000, 10, False), (999, 10, True), (1000, 9, True)])
def test_low_sample_thresholds(spark, followers, likes, warned):
    assert (account(spark, followers, [(likes, 0)])["low_sample_warning"] is not None) == warned


def weeks(spark, *values):
    days = [dt.date(2026, 11, 2) + dt.timedelta(days=7 * k) for k, _ in values]
    return spark.createDataFrame([("a", d, f) for d, (_, f) in zip(days, values, strict=True)], "account_id string, week_start date, followers int")


@pytest.mark.parametrize("values, pct, cumulative, gap", [
    ([(0, 100), (2, 110)], [None, 10.0], 10.0, False), ([(0, 0), (1, 50)], [None, None], None, False), ([(0, 7)], [None], None, True), ([], [], None, True),
])
def test_growth(spark, values, pct, cumulative, gap):
    snapshots = weeks(spark, *values)
    assert [r["growth_pct"] for r in growth.weekly_growth(snapshots).orderBy("week_start").collect()] == pct
    r = growth.cumulative_growth(spark.createDataFrame([("a",)], "account_id string"), snapshots).first()
    assert r["cumulative_growth_pct"] == cumulative and (r["growth_data_gap"] is not None) == gap


def test_weeks_begin_on_monday_and_the_last_point_wins(spark):
    points = [("a", dt.datetime(2026, 11, 29, 23, 59, 59), 5, 0), ("a", dt.datetime(2026, 11, 30), 1, 1), ("a", dt.datetime(2026, 11, 30), 2, 2)]
    got = growth.weekly_snapshots(spark.createDataFrame(points, "account_id string, ts timestamp, followers int, ordinal int")).orderBy("week_start").collect()
    assert [(r["week_start"], r["followers"]) for r in got] == [(dt.date(2026, 11, 23), 5), (dt.date(2026, 11, 30), 2)]


def test_breakdowns_and_uplift(spark):
    posts = spark.createDataFrame([("a", 10, 0, None, None, 1), ("a", 30, 0, None, "video", 2)], POSTS)
    cats = spark.createDataFrame([(2, "collaboration")], "category_key int, category string")
    both = metrics.with_category(posts, cats)
    assert {(r["media_type"], r["avg_engagement"]) for r in metrics.media_breakdown(posts).collect()} == {("unknown", 10.0), ("video", 30.0)}
    assert [tuple(r) for r in metrics.category_breakdown(both).collect()] == [("a", "collaboration", 1, 30.0, 1.5)]
    assert {(r["category"], r["post_count"]) for r in legacy.legacy_categories(both).collect()} == {("collaboration", 1), ("other", 1)}
    accounts = spark.createDataFrame([("a",), ("b",)], "account_id string")
    got = {r["account_id"]: tuple(r)[1:] for r in metrics.collaboration(accounts, both).collect()}
    assert got == {"a": (1, 30.0, 1.5), "b": (0, 0.0, None)}


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4], 3), ([5, 1, 3], 3)])
def test_upper_median(spark, values, want):
    df = spark.createDataFrame([("p", v) for v in values], "k string, v int")
    assert readmodels.upper_median(df, "v", ["k"]).first()["median"] == want
    assert readmodels.upper_median(df.where("false"), "v", ["k"]).count() == 0


@pytest.mark.parametrize("text, want", [(" @@a ", "@a"), ("@B", "B"), (" x　", "x")])
def test_handles(spark, text, want):
    assert one(spark, S.strip_handle(F.col("v")), v=text) == want


@pytest.mark.parametrize("text, a, c", [("Sidecar", "carousel", None), ("clips", "reel", None), ("GraphVideo", "video", "video"), ("Photo", "image", "image"), ("foo", None, None), (None, None, None), ("PDF", None, "document")])
def test_media_types(spark, text, a, c):
    assert one(spark, S.media_type_a(F.col("v")), v=text) == a and one(spark, S.media_type_c(F.col("v")), v=text) == c


def test_snapshot_precedence(spark):
    at = "account_id string, week_start string, followers int"
    old, hist, live = (spark.createDataFrame(x, at) for x in ([("a", "w", 1)], [("a", "w", 100)], [("a", "w", 120), ("a", "w1", 130)]))
    want = {("w", 100), ("w1", 130)}
    once = upsert.merge_snapshots(old, hist, live)
    assert {(r["week_start"], r["followers"]) for r in once.collect()} == want
    assert {(r["week_start"], r["followers"]) for r in upsert.merge_snapshots(once, hist, live).collect()} == want


def test_post_upsert_keeps_identity_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", "u", 1, "id1", "t1"), ("a", "v", 2, "id2", "t1")], "account_id string, post_url string, likes int, id string, scraped_at string")
    batch = spark.createDataFrame([("a", "u", 5, "new", "t2", 1), ("a", "u", 9, "new", "t2", 2), ("a", "w", 3, "id3", "t2", 3)], "account_id string, post_url string, likes int, id string, scraped_at string, n int")
    new = upsert.last_per_key(batch, ["account_id", "post_url"], [F.col("n")]).drop("n")
    keys, keep = ["account_id", "post_url"], ["id", "scraped_at"]
    once = upsert.upsert(old, new, keys, keep)
    want = {("u", 9, "id1", "t1"), ("v", 2, "id2", "t1"), ("w", 3, "id3", "t2")}
    assert {tuple(r)[1:] for r in once.collect()} == want
    assert {tuple(r)[1:] for r in upsert.upsert(once, new, keys, keep).collect()} == want


def test_partial_report_upsert(spark):
    empty = spark.createDataFrame([], "id string, kind string, pdf_url string, content string")
    content = spark.createDataFrame([("1", "detailed", "c")], "id string, kind string, content string").withColumn("pdf_url", F.lit(None).cast("string"))
    first = upsert.upsert(empty, content, ["id", "kind"])
    both = upsert.upsert(first, spark.createDataFrame([("1", "detailed", "p")], "id string, kind string, pdf_url string"), ["id", "kind"])
    assert [tuple(r) for r in both.collect()] == [("1", "detailed", "p", "c")]


def test_violations(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y")], "k string, v string")
    got = {tuple(r) for r in upsert.violations(df, [["k"]], ["v"], {"v": ["x"]}).collect()}
    assert got == {("unique k", 1), ("not null v", 1), ("check v", 1)}
    assert upsert.violations(df, [["k", "v"]], ["k"]).count() == 0


def raws(spark, *items):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "handle string, item string")


def test_profiles(spark):
    a = raw.profile_a(raws(spark, '{"fullName":"N","followersCount":"12","followsCount":null}', '{"followersCount":"many"}', "{}", "broken")).collect()
    assert [(r["display_name"], r["followers"], r["following"]) for r in a] == [("N", 12, None), (None, 0, None), (None, 0, None)]
    b = raw.profile_b(raws(spark, '{"authorMeta":{"name":"n","fans":3},"name":"x"}', '{"name":"x","followerCount":4,"following":5}')).collect()
    assert [(r["display_name"], r["followers"], r["following"]) for r in b] == [("n", 3, None), ("x", 4, 5)]
    c = raw.profile_c(raws(spark, '{"companyName":"c","followers":7,"about":"b"}')).first()
    assert (c["display_name"], c["followers"], c["following"], c["bio"]) == ("c", 7, None, "b")


def test_posts(spark):
    a = raw.post_a(raws(spark, '{"url":"u","timestamp":"2026-01-02T03:04:05Z","coauthorProducers":[{"username":"co"}],"likesCount":2}', '{"takenAt":"no","coauthorProducers":[]}')).collect()
    assert a[0]["posted_at"] == dt.datetime(2026, 1, 2, 3, 4, 5) and a[0]["coauthor_handle"] == "co" and a[0]["likes"] == 2 and a[0]["shares"] is None
    assert a[1]["posted_at"] is None and a[1]["post_url"] == "" and a[1]["coauthor_handle"] is None
    b = raw.post_b(raws(spark, '{"createTime":1767225600,"webVideoUrl":"w","shareCount":null}', '{"createTimeISO":"2026-01-01T00:00:00Z","url":"u","shareCount":3}')).collect()
    assert [r["posted_at"] for r in b] == [dt.datetime(2026, 1, 1)] * 2 and [r["shares"] for r in b] == [None, 3] and b[0]["media_type"] == "video"
    c = raw.post_c(raws(spark, '{"publishedAt":"2026-01-01","postUrl":"p","content":"t","contentType":"Poll","reactionCount":4}')).first()
    assert (c["post_url"], c["caption"], c["media_type"], c["likes"]) == ("p", "t", None, 4)
    kept = raw.accepted(raw.post_a(raws(spark, '{"url":"u","timestamp":"2026-01-01T00:00:00Z"}', '{"url":"","timestamp":"2026-01-01T00:00:00Z"}', '{"url":"u"}', '{"url":"u","timestamp":"2025-12-31T23:59:59Z"}')), "2026-01-01 00:00:00")
    assert kept.count() == 1


def test_history(spark):
    items = '{"history":[{"date":"2026-01-01","followers":1},{"day":"2026-01-02","followerCount":"2"},{"timestamp":"x","value":3},{"date":"2026-01-03","value":"no"},{"date":"2026-01-04","subscribers":4}]}'
    got = raw.history_points(raws(spark, items, '{"history":[]}', "{}"), "2026-01-02 00:00:00").collect()
    assert [(r["followers"], r["ordinal"]) for r in got] == [(2, 1), (4, 4)]


def test_registry(spark):
    every = raw.normalise({"instagram": raws(spark, "{}"), "linkedin": raws(spark, "{}")}, "profiles")
    assert {r["platform"] for r in every.collect()} == {"instagram", "linkedin"}
    with pytest.raises(KeyError):
        raw.normalise({"none": raws(spark, "{}")}, "posts")


GOOD = '{"companyName":" Co ","industry":"i","region":"r","platforms":["instagram","tiktok"],"targetHandles":{"instagram":"@co","tiktok":" co "},"competitors":[%s]}'
RIVAL = '{"name":"n","handles":{"instagram":"@@x","tiktok":"y"}}'


@pytest.mark.parametrize("body, want", [
    (GOOD % ",".join([RIVAL] * 3), None), ("{}", "Company name"), (GOOD % ",".join([RIVAL] * 2), "Exactly 3"), (GOOD.replace("tiktok\"]", "myspace\"]") % RIVAL, "Invalid platform"),
    (GOOD.replace('"platforms":["instagram","tiktok"]', '"platforms":[]') % RIVAL, "Select at least"), (GOOD.replace(' co "', ' "') % ",".join([RIVAL] * 3), "Missing target"),
    (GOOD % ",".join([RIVAL] * 2 + ['{"name":" ","handles":{"instagram":"x","tiktok":"y"}}']), "Missing competitor"),
])
def test_request_rules(spark, body, want):
    error = requests.validate(requests.parse(spark.createDataFrame([(1, body)], "request_id int, body string"))).first()["error"]
    assert error is None if want is None else error.startswith(want)


def test_requested_accounts_and_handle_checks(spark):
    parsed = requests.parse(spark.createDataFrame([(1, GOOD % ",".join([RIVAL] * 3))], "request_id int, body string"))
    rows = requests.handles(parsed)
    assert rows.count() == 8 and {r["handle"] for r in rows.where("platform = 'instagram'").collect()} == {"co", "@x"}
    profiles = spark.createDataFrame([("instagram", "co", 0, "", None), ("tiktok", "co", 0, "Name", None)], "platform string, handle string, followers int, display_name string, bio string")
    checks = requests.check_handles(rows.where("role = 'target'"), profiles)
    assert {(r["platform"], r["valid"]) for r in checks.collect()} == {("instagram", False), ("tiktok", True)}
    result = requests.all_valid(checks).first()
    assert result["all_valid"] is False and result["message"].endswith("analysis: Your business on instagram (@co): Account not found or the actor returned no data for this handle.")
    assert requests.analyses(parsed, "2026-01-01 00:00:00").first()["company_name"] == "Co"


def test_lifecycle(spark):
    at = "analysis_id int, status string, status_detail string, created_at timestamp"
    df = spark.createDataFrame([(2, "pending", "", dt.datetime(2026, 1, 1)), (1, "pending", "", dt.datetime(2026, 1, 1)), (3, "scraping", "", dt.datetime(2026, 1, 1)), (4, "done", "", dt.datetime(2026, 1, 1))], at)
    assert lifecycle.next_pending(df).first()["analysis_id"] == 1
    won = lifecycle.claim(df, 1)
    assert {r["analysis_id"]: (r["status"], r["won"]) for r in won.collect()} == {1: ("scraping", True), 2: ("pending", None), 3: ("scraping", None), 4: ("done", None)}
    assert lifecycle.claim(df, 4).where("analysis_id = 4").first()["won"] is False
    moved = {r["analysis_id"]: (r["status"], r["status_detail"]) for r in lifecycle.advanced(df.withColumn("error", F.lit(None).cast("string"))).collect()}
    assert moved[3] == ("categorizing", "Classifying post content...") and moved[1][0] == "pending" and moved[4][0] == "done"
    assert lifecycle.advanced(df.withColumn("error", F.lit("no"))).where("analysis_id = 3").first()["status_detail"] == "no"
    assert lifecycle.claim(df, 4).where("analysis_id = 4").first()["status"] == "done"
    swept = {r["analysis_id"]: r["status"] for r in lifecycle.sweep_stuck(df, "2026-01-01 00:31:00").collect()}
    assert swept == {1: "pending", 2: "pending", 3: "failed", 4: "done"}
    assert lifecycle.advance("pending") == "scraping" and lifecycle.advance("rendering") == "done" and lifecycle.advance("computing", "x") == "failed"
    with pytest.raises(ValueError):
        lifecycle.advance("done")


def test_classifiers(spark):
    posts = spark.createDataFrame([("1", "Paid partnership with x", None), ("2", "hello", "friend"), ("3", None, None)], "post_id string, caption string, coauthor_handle string")
    assert {r["post_id"]: r["category"] for r in classify.by_rules(posts).collect()} == {"1": "paid_promotion", "2": "collaboration", "3": "other"}


def test_reports_have_the_sizes_asked_for(spark):
    accounts = spark.createDataFrame([(str(i), 1, f"h{i}", p, "target" if i == 0 else "competitor", 2000 + i) for p in ("x", "y") for i in range(4)], ACCOUNTS).withColumn("account_id", F.concat("platform", "account_id"))
    posts = spark.createDataFrame([("x1", 50, 1, None, None, 1)], POSTS)
    insights = synthesis.with_all(synthesis.platform_insights(metrics.account_metrics(accounts, posts)))
    assert {r["platform"] for r in insights.collect()} == {"x", "y", "all"}
    assert all(r["ok"] for r in synthesis.sizes_hold(insights, synthesis.SIZES).collect())
    report = synthesis.customer_report(insights)
    assert all(r["ok"] for r in synthesis.sizes_hold(report, synthesis.REPORT_SIZES).collect())
    assert report.select("plan.day30.actions").first()[0][0].startswith("By day 30: ")
    assert "null" in report.select(F.to_json(F.struct(F.lit(None).cast("string").alias("a")), {"ignoreNullFields": "false"})).first()[0]


@pytest.mark.parametrize("text, want", [("1200", 1200), ("1200.0", 1200), ("1e3", 1000), ("1.2e3", 1200), ("12.9", 12), ("many", 0), ("NaN", 0), ("Infinity", 0), ("", 0), (None, 0), ("1e30", 0), ("12d", 0), ("5f", 0), (" 7 ", 7), (".5e1", 5), ("-3.", -3), ("1e400", 0), ("0x1F", 0), ("1_000", 0)])
def test_permissive_numbers(spark, text, want):
    assert one(spark, S.int_or_zero(F.col("v")), v=text) == want


@pytest.mark.parametrize("x, want", [(12345678.9, "12345678.9"), (1e7, "10000000"), (0.0, "0"), (100.0, "100"), (0.0001, "0.0001"), (-2.5, "-2.5"), (1234567890123.25, "1234567890123.25"), (1e36, None)])
def test_plain_number_texts(spark, x, want):
    assert one(spark, S.number_text(F.col("v")), v=x) == want


def exact(x, digits, mode):
    """The nearest decimal to the exact binary value."""
    return decimal.Decimal(x).quantize(decimal.Decimal(1).scaleb(-digits), rounding=mode)


def test_rounding_goes_by_the_exact_value(spark):
    values = [n / 40 for n in range(4000)] + [n / 1000 for n in range(0, 9000, 5)] + [-0.125, -2.675, 107 / 40, 1e9 + 0.125, 12345.675, 0.045, 3.0, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", S.py_round(F.col("v"), 2).alias("r"), S.py_round(F.col("v")).alias("w"), S.to_fixed(F.col("v"), 1).alias("a"), S.to_fixed(F.col("v"), 2).alias("b")).collect()
    for r in got:
        assert r["r"] == round(r["v"], 2) and r["w"] == round(r["v"])
        for digits, text in ((1, r["a"]), (2, r["b"])):
            assert decimal.Decimal(text) == exact(r["v"], digits, decimal.ROUND_HALF_UP) and len(text.split(".")[1]) == digits


def test_legacy_form(spark):
    rows = [("c", "i", "r", "t", " @@a \r\n\n b"), ("c", "i", "r", "t", "\n".join("abcdef")), ("", "i", "r", "t", "a"), ("c", "i", "r", "t", " \n "), ("c", "i", " ", "t", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, company string, industry string, region string, target string, competitors string")
    got = df.select("k", requests.legacy_problem().alias("e"), requests.legacy_competitors(F.col("competitors")).alias("c")).orderBy("k").collect()
    assert got[0]["c"] == ["a", "b"] and got[0]["e"] is None and got[1]["e"] == "Enter at most 5 competitors."
    assert [r["e"] for r in got[2:]] == ["All fields are required."] * 3


def test_legacy_sources(spark):
    assert [tuple(r)[1:] for r in raw.legacy_profile(raws(spark, '{"followersCount":5,"biography":"b"}', "{}")).collect()] == [(5, None, "b"), (None, None, None)]
    posts = raw.legacy_posts(raws(spark, '{"url":"u","type":"Sidecar","timestamp":"2026-01-02T00:00:00Z","likesCount":3}', '{"takenAt":"2025-01-02T00:00:00Z"}'), "2026-01-10 00:00:00")
    assert [(r["post_url"], r["media_type"], r["likes"], r["comments"]) for r in posts.collect()] == [("u", "Sidecar", 3, 0)]
    with pytest.raises(Exception, match="no time|CANNOT_PARSE|could not be parsed"):
        raw.legacy_posts(raws(spark, '{"url":"u"}'), "2026-01-10 00:00:00").collect()


def test_first_item(spark):
    df = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a"), ("g", 3, None)], "handle string, ordinal int, name string")
    assert {(r["handle"], r["name"]) for r in raw.first_item(df, "ordinal").collect()} == {("h", "a"), ("g", None)}


def test_chunks_hold_forty(spark):
    posts = spark.range(95).select(F.lit("a").alias("account_id"), F.format_string("%03d", "id").alias("post_id"))
    assert sorted(r["count"] for r in classify.chunked(posts).groupBy("chunk").count().collect()) == [15, 40, 40]


def test_insights_are_replaced_by_key(spark):
    at = "analysis_id int, platform string, data_observations array<string>, explanations array<string>, recommendations array<string>"
    old = spark.createDataFrame([(1, "x", ["old"], [], []), (2, "x", ["kept"], [], [])], at)
    new = spark.createDataFrame([(1, "x", ["new"], [], []), (1, "all", ["new"], [], [])], at)
    once = synthesis.stored_insights(old, new)
    want = {(1, "x", "new"), (1, "all", "new"), (2, "x", "kept")}
    assert {(r["analysis_id"], r["platform"], r["data_observations"][0]) for r in once.collect()} == want
    assert {(r["analysis_id"], r["platform"], r["data_observations"][0]) for r in synthesis.stored_insights(once, new).collect()} == want


def test_percentiles_stay_within_an_analysis(spark):
    accounts = spark.createDataFrame([("a", 1, "a", "p", "target", 10), ("b", 1, "b", "p", "competitor", 20), ("c", 2, "c", "p", "target", 5)], ACCOUNTS)
    got = {r["account_id"]: r["followers_percentile"] for r in metrics.account_metrics(accounts, spark.createDataFrame([], POSTS)).collect()}
    assert got == {"a": 50, "b": 100, "c": 100}


def test_nested_metrics_equal_their_parts(spark):
    accounts = spark.createDataFrame([("a", 1, "a", "p", "target", 100), ("b", 1, "b", "p", "competitor", 200), ("c", 1, "c", "p", "competitor", 300)], ACCOUNTS)
    posts = spark.createDataFrame([("a", 10, 1, None, None, 1), ("a", 30, 2, 4, "video", 2), ("a", 7, 0, 1, "video", 3), ("b", 5, 5, None, "image", 2), ("b", 9, 1, None, None, 9)], POSTS)
    cats = spark.createDataFrame([(1, "campaign"), (2, "collaboration"), (3, "paid_promotion")], "category_key int, category string")
    gaps = growth.growth_lists(accounts.select("account_id"), weeks(spark, (0, 10), (1, 20)))
    nested = metrics.nested_metrics(accounts, posts, cats, gaps)
    flat = metrics.account_metrics(accounts, posts)
    assert sorted(map(str, nested.select(*flat.columns).collect())) == sorted(map(str, flat.collect()))
    rows = {r["account_id"]: r for r in nested.collect()}
    for name, part in (("media_type", metrics.media_breakdown(posts)), ("category", metrics.category_breakdown(metrics.with_category(posts, cats)))):
        want = {(r["account_id"], r[name]): tuple(r)[2:] for r in part.collect()}
        assert {(i, k): tuple(v) for i, r in rows.items() for k, v in (r[f"{name if name == 'category' else 'media_type'}_breakdown"] or {}).items()} == want
    for r in metrics.collaboration(accounts, metrics.with_category(posts, cats)).collect():
        assert tuple(rows[r["account_id"]]["collaboration_cadence"]) == tuple(r)[1:]
    assert len(rows["a"]["weekly_growth"]) == 2 and rows["b"]["growth_data_gap"]
