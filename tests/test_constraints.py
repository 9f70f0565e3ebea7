"""The graph of foreign keys: order, cascades over three levels and two parents, batches checked by bucket."""

import pytest

from quorumlens.operators import constraints as C
from quorumlens.operators.buckets import Buckets


def tables(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "analyses": frame([(1, "a"), (2, "b"), (3, None)], "analysis_id int, kind string"),
        "accounts": frame([(10, 1), (11, 1), (20, 2), (30, 3), (90, None)], "account_id int, analysis_id int"),
        "account_snapshots": frame([(10, "w1"), (10, "w2"), (20, "w1")], "account_id int, week string"),
        "posts": frame([(100, 10), (101, 11), (200, 20), (300, 30), (900, None)], "post_id int, account_id int"),
        "post_categories": frame([(100, "x"), (200, "y"), (300, "z")], "post_id int, category string"),
        "analysis_reports": frame([(1, "r"), (2, "r")], "analysis_id int, report string"),
    }


def test_parents_come_first():
    names = C.order(C.KEYS)
    assert all(names.index(k.parent) < names.index(k.child) for k in C.KEYS) and len(names) == len(set(names)) == 7
    with pytest.raises(ValueError, match="circle"):
        C.order([*C.KEYS, C.ForeignKey("analyses", "post_id", "posts", "post_id")])


def test_deletes_reach_every_level(spark):
    left = C.delete(tables(spark), "analyses", "kind = 'a'")
    got = {name: sorted(tuple(r)[0] for r in df.collect() if tuple(r)[0] is not None) for name, df in left.items()}
    assert got == {"analyses": [2, 3], "accounts": [20, 30, 90], "account_snapshots": [20], "posts": [200, 300, 900], "post_categories": [200, 300], "analysis_reports": [2]}
    assert {r["child"]: r["n"] for r in C.orphans(left).collect()} == {"accounts": 0, "account_snapshots": 0, "posts": 0, "post_categories": 0, "analysis_reports": 0}


def test_deletes_from_the_middle(spark):
    left = C.delete(tables(spark), "accounts", "account_id = 10")
    assert left["post_categories"].count() == 2 and left["posts"].count() == 4 and left["account_snapshots"].count() == 1
    assert left["analysis_reports"].count() == 2


def test_two_parents_take_each_row_once(spark):
    keys = [C.ForeignKey("b", "a1", "a", "k"), C.ForeignKey("c", "a", "a", "k"), C.ForeignKey("c", "b", "b", "k")]
    frames = {
        "a": spark.createDataFrame([(1,), (2,)], "k int"), "b": spark.createDataFrame([(7, 1), (8, 2)], "k int, a1 int"),
        "c": spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 2, 7), (4, 2, 8), (5, None, None)], "k int, a int, b int"),
    }
    left = C.delete(frames, "a", "k = 1", keys)
    assert sorted(r["k"] for r in left["c"].collect()) == [4, 5] and [r["k"] for r in left["b"].collect()] == [8]


def test_rows_without_parents_are_counted(spark):
    frames = tables(spark)
    frames["posts"] = frames["posts"].unionByName(spark.createDataFrame([(5, 77), (6, 78)], "post_id int, account_id int"))
    assert {r["child"]: r["n"] for r in C.orphans(frames).collect()}["posts"] == 2


def test_batches_are_checked_by_their_own_buckets(spark, tmp_path):
    accounts = Buckets(spark, str(tmp_path / "accounts"), spark.createDataFrame([], "account_id long, name string").schema, ["account_id"], 8)
    accounts.merge(spark.createDataFrame([(i, f"n{i}") for i in range(50)], "account_id long, name string"))
    batch = spark.createDataFrame([(1, 7), (2, 51), (3, None), (4, 7)], "post_id int, account_id int")
    assert [r["post_id"] for r in C.without_parents(batch, "account_id", accounts).collect()] == [2]
    found = C.duplicates(spark.createDataFrame([(7, "x"), (60, "y"), (60, "z"), (61, "w")], "account_id long, name string"), accounts).collect()
    assert sorted((r["account_id"], r["times"], r["stored"]) for r in found) == [(7, 1, True), (60, 2, False)]
