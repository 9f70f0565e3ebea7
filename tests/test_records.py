"""Raw records: read once, as VARIANT; what can't be read is rejected; numbers and times as sources may write them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quorumlens.sources import raw


def raws(spark, *items):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "handle string, item string")


ITEMS = ['{"followersCount":1}', "broken", "[1,2]", '"text"', "12", "null", None, "{}", '{"followersCount":', "  {\"followersCount\": 2} ", ""]


def test_rejects_and_records_are_all(spark):
    df = raws(spark, *ITEMS)
    bad = {int(r["handle"]): (r["item"], r["reason"]) for r in raw.rejects(df).collect()}
    assert bad == {1: ("broken", "not JSON"), 2: ("[1,2]", "not an object"), 3: ('"text"', "not an object"), 4: ("12", "not an object"), 5: ("null", "not an object"), 8: ('{"followersCount":', "not JSON"), 10: ("", "not JSON")}
    good = {int(r["handle"]): r["followers"] for r in raw.profile_a(df).collect()}
    assert good == {0: 1, 6: 0, 7: 0, 9: 2} and len(good) + len(bad) == len(ITEMS)


@pytest.mark.parametrize("posts", [raw.post_a, raw.post_b, raw.post_c])
def test_a_record_is_parsed_once(spark, posts, capsys):
    df = spark.createDataFrame([("h", "{}", dt.datetime(2026, 1, 1))], "handle string, item string, day timestamp_ntz")
    raw.accepted(posts(raw.newer(df, "2026-01-01 00:00:00")), "2026-01-01 00:00:00", limit=None).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("parseJson") == 1 and "from_json" not in plan
    # the day is tested below it: further down in the text of the plan
    assert plan.index("parseJson") < plan.index("isnotnull(day")


def test_numbers_of_the_earlier_prototype(spark):
    posts = raw.legacy_posts(raws(spark, '{"url":"u","timestamp":"2026-01-02T00:00:00Z","likesCount":1200.0,"commentsCount":1.2e3}', '{"url":"v","timestamp":"2026-01-02T00:00:00Z","likesCount":"12d"}'), "2026-01-10 00:00:00")
    assert {r["post_url"]: (r["likes"], r["comments"]) for r in posts.collect()} == {"u": (1200, 1200), "v": (0, 0)}


def test_history_survives_what_is_no_number(spark):
    entries = ['{"date":"2026-01-01","followers":"Infinity"}', '{"date":"2026-01-01","followers":1e300}', '{"date":"2026-01-01","followers":"NaN"}', "7", '"x"', "null", '{"day":"2026-01-02","value":1.5e1}', '{"date":"no","value":3}', '{"date":"2025-01-01","value":4}']
    df = raws(spark, '{"history":[%s]}' % ",".join(entries), '{"history":{"date":"2026-01-01"}}', '{"history":null}')
    assert [tuple(r) for r in raw.history_points(df, "2026-01-01 00:00:00").collect()] == [("0", dt.datetime(2026, 1, 2), 15, 6)]


def test_far_times_are_no_times(spark):
    df = raws(spark, '{"createTime":1e300,"url":"u"}', '{"createTime":1.7e14,"url":"u"}', '{"createTime":-1e13,"url":"u"}', '{"createTime":1767225600.5,"url":"u"}', '{"createTime":"1767225600","url":"u"}', '{"createTime":"2026-01-01T00:00:00Z","url":"u"}', '{"createTime":null,"createTimeISO":"2026-01-01","url":"u"}', '{"createTime":0,"url":"u"}')
    posts = raw.post_b(df)
    got = {int(r["handle"]): r["posted_at"] for r in posts.select("handle", F.col("posted_at").cast("string")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "2026-01-01 00:00:00.5", 4: None, 5: "2026-01-01 00:00:00", 6: "2026-01-01 00:00:00", 7: "1970-01-01 00:00:00"}
    assert raw.accepted(posts, "2025-01-01 00:00:00").count() == 3


def test_wrapped_profiles(spark):
    b = raw.profile_b(raws(spark, '{"authorMeta":null,"name":"flat","fans":"8"}', '{"authorMeta":{"nickName":null,"name":"in","fans":9},"nickName":"out"}', '{"authorMeta":{},"name":"out"}')).collect()
    assert [(r["display_name"], r["followers"]) for r in b] == [("flat", 8), ("in", 9), (None, 0)]


def test_dropped_rows_are_counted_on_the_way(spark):
    items = ['{"url":"u","timestamp":"2026-01-05"}', '{"url":"","timestamp":"2026-01-05"}', '{"url":"","timestamp":"no"}', '{"url":"u"}', '{"url":"u","timestamp":"2025-01-05"}']
    since = "2026-01-01 00:00:00"
    rows, seen = raw.counted(raw.post_a(raws(spark, *items)), raw.dropped_posts(since), "posts")
    assert raw.accepted(rows, since).count() == 1
    assert seen.get == {"rows": 5, "undated": 2, "before the window": 1, "without url": 1}
    points, seen = raw.counted(raw.history_entries(raws(spark, '{"history":[{"date":"2026-01-05","value":1},{"date":"x","value":1},{"date":"2026-01-05"},{"date":"2025-01-05","value":2}]}')), raw.dropped_points(since), "points")
    assert points.where("ts is not null and followers is not null").count() == 2
    assert seen.get == {"rows": 4, "undated": 1, "not a number": 1, "before the window": 1}
