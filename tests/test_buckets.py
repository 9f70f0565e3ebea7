"""Merges by bucket: only what a batch touches is read and written, twice is once, a broken merge is taken up again."""

import pytest

from quorumlens.operators import upsert
from quorumlens.operators.buckets import MERGE, Buckets

SCHEMA = "k long, name string, n int"


@pytest.fixture
def table(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["k"], 8)
    table.merge(spark.createDataFrame([(i, f"a{i}", i) for i in range(100)], SCHEMA))
    return table


def files(table, tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}


def test_a_batch_leaves_other_buckets_files(spark, tmp_path, table):
    before = files(table, tmp_path)
    assert len(before) == 8
    (bucket,) = table.merge(spark.createDataFrame([(7, "new", None)], SCHEMA))
    after = files(table, tmp_path)
    assert {f: t for f, t in before.items() if f"__bucket={bucket}/" not in f} == {f: t for f, t in after.items() if f"__bucket={bucket}/" not in f}
    assert len(after) == 8 and before != after
    rows = {r["k"]: (r["name"], r["n"]) for r in table.read().collect()}
    assert rows == {i: (f"a{i}", i) for i in range(100)} | {7: ("new", None)}


def test_only_touched_buckets_are_read(table, capsys):
    table.existing([3, 5]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [__bucket" in plan and "IN (3,5)]" in plan
    assert {r[0] for r in table.existing([3, 5]).select("__bucket").distinct().collect()} == {3, 5}


def test_twice_is_once(spark, table):
    batch = spark.createDataFrame([(7, "new", 1), (500, "more", 2)], SCHEMA)
    table.merge(batch)
    once = sorted(table.read().collect())
    assert table.merge(batch) and sorted(table.read().collect()) == once and len(once) == 101
    assert table.merge(batch.where("false")) == []


def test_other_ways_to_combine(spark, table):
    batch = spark.createDataFrame([(7, "late", 1), (500, "more", 2)], SCHEMA)
    table.merge(batch, lambda have, new: upsert.insert_missing(have, new, ["k"]))
    rows = {r["k"]: r["name"] for r in table.read().collect()}
    assert rows[7] == "a7" and rows[500] == "more" and len(rows) == 101


def test_a_merge_that_died_is_finished(spark, tmp_path, table, monkeypatch):
    def broken(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Buckets, "_put_in_place", broken)
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([(7, "new", 1)], SCHEMA))
    # a bucket lost half-way through
    bucket = next((tmp_path / "t" / MERGE).glob("__bucket=*")).name
    for part in (tmp_path / "t" / bucket).iterdir():
        part.unlink()
    rows = {r["k"]: r["name"] for r in table.read().collect()}
    assert rows == {i: f"a{i}" for i in range(100)} | {7: "new"} and not (tmp_path / "t" / MERGE).exists()


def test_a_merge_that_was_not_written_is_thrown_away(spark, tmp_path, table):
    half = tmp_path / "t" / MERGE / "__bucket=1"
    half.mkdir(parents=True)
    (half / "part.parquet").write_bytes(b"half")
    assert table.read().count() == 100 and not half.exists()


def test_keys_of_other_types_and_nulls_find_their_rows(spark, tmp_path, table):
    table.merge(spark.createDataFrame([(7, "int", 1), (None, "null", 2)], "k int, name string, n int"))
    table.merge(spark.createDataFrame([(None, "null again", 2)], SCHEMA))
    rows = table.read().where("k is null or k = 7").collect()
    assert sorted((r["name"], r["k"]) for r in rows) == [("int", 7), ("null again", None)]


def test_read_before_the_first_merge(spark, tmp_path, table):
    other = Buckets(spark, str(tmp_path / "none"), table.schema, ["k"])
    assert other.read().columns == ["k", "name", "n"] and other.read().count() == 0
