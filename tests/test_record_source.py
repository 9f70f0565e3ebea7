"""The data source for folders of records: filters reach it, batch and stream give the same rows, nothing is read twice."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from quorumlens.sources import raw, records

ROWS = [
    ("instagram", "a b", "2026-01-01", '{"url":"1","timestamp":"2026-01-01"}'), ("instagram", "a b", "2026-01-05", '{"url":"2","timestamp":"2026-01-05","caption":"two\\nlines"}'),
    ("instagram", "c/d", None, '{"url":"3"}'), ("tiktok", "c/d", "2026-02-01", "broken"), ("tiktok", "é", "2026-01-02", None),
]
SCHEMA = "platform string, handle string, day string, item string"


@pytest.fixture
def folder(spark, tmp_path):
    records.register(spark)
    path = f"file://{tmp_path}/records"
    records.write(spark.createDataFrame(ROWS, SCHEMA), path, "posts")
    return path


def load(spark, folder, **options):
    return spark.read.format("records").options(path=folder, kind="posts", **options).load()


def as_rows(df):
    return sorted(((r["platform"], r["handle"], r["day"] and str(r["day"]), r["item"]) for r in df.collect()), key=str)


def test_all_rows_come_back(spark, folder):
    assert as_rows(load(spark, folder)) == sorted(ROWS, key=str)
    assert as_rows(load(spark, folder, handles=2)) == sorted(ROWS, key=str)
    # a partition per platform and handle, or of some of them
    assert load(spark, folder).rdd.getNumPartitions() == 4 and load(spark, folder, handles=3).rdd.getNumPartitions() == 2


@pytest.mark.parametrize("condition, want", [
    ("day >= date '2026-01-05'", lambda r: (r[2] or "") >= "2026-01-05"),
    ("day > date '2026-01-05'", lambda r: (r[2] or "") > "2026-01-05"),
    ("day >= date '2026-01-02' and day >= date '2026-01-05' and platform = 'instagram'", lambda r: (r[2] or "") >= "2026-01-05" and r[0] == "instagram"),
    ("handle in ('é', 'a b')", lambda r: r[1] in ("é", "a b")), ("platform = 'tiktok' and handle = 'a b'", lambda r: False),
    ("day < date '2026-01-05'", lambda r: r[2] is not None and r[2] < "2026-01-05"), ("day is null", lambda r: r[2] is None),
])
def test_filters_give_what_they_say(spark, folder, condition, want):
    assert as_rows(load(spark, folder).where(condition)) == sorted(filter(want, ROWS), key=str)


def test_the_date_reaches_the_source(spark, folder, capsys):
    load(spark, folder).where("day >= date '2026-01-05' and platform = 'instagram'").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(day,2026-01-05)" in pushed and "EqualTo(platform,instagram)" in pushed
    assert ">= 2026-01-05" not in plan.split("Condition")[-1]


def test_other_kinds_and_missing_folders(spark, tmp_path, folder):
    assert load(spark, folder + "/none").collect() == []
    records.write(spark.createDataFrame([("linkedin", "x", "{}")], "platform string, handle string, item string"), folder, "profiles")
    df = spark.read.format("records").options(path=folder, kind="profiles").load()
    assert df.columns == ["platform", "handle", "item"] and [tuple(r) for r in df.collect()] == [("linkedin", "x", "{}")]
    assert load(spark, folder).count() == len(ROWS)


def test_lines_of_another_form_are_rejected_later(spark, tmp_path, folder):
    place = tmp_path / "records/kind=posts/platform=tiktok/handle=odd"
    place.mkdir()
    (place / "x.txt").write_bytes(b'no json\r\n\n{"day":"soon","item":{"url":"u"}}\n["list"]\n\xff\n')
    (place / "_temporary").write_text("not read")
    odd = load(spark, folder).where("handle = 'odd'")
    assert sorted((r["day"], r["item"]) for r in odd.collect()) == sorted([(None, "no json"), (None, '{"url": "u"}'), (None, '["list"]'), (None, "\ufffd")])
    assert sorted(r["reason"] for r in raw.rejects(odd).collect()) == ["not JSON", "not JSON", "not an object"]


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path, folder):
    def run():
        stream = spark.readStream.format("records").options(path=folder, kind="posts", settle=0, handles=2).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
        return as_rows(spark.read.schema("platform string, handle string, day date, item string").parquet(f"{tmp_path}/out"))

    assert run() == as_rows(load(spark, folder)) == sorted(ROWS, key=str)
    assert run() == sorted(ROWS, key=str)  # nothing new
    time.sleep(0.05)
    more = [("tiktok", "é", "2026-03-01", '{"url":"9"}')]
    records.write(spark.createDataFrame(more, SCHEMA), folder, "posts")
    assert run() == sorted(ROWS + more, key=str) == as_rows(load(spark, folder))


def test_files_that_may_still_change_are_left(tmp_path):
    place = tmp_path / "kind=posts/platform=p/handle=h"
    place.mkdir(parents=True)
    for name, age in (("old", 100), ("new", 0)):
        (place / name).write_text("{}")
        os.utime(place / name, (time.time() - age,) * 2)
    reader = records._StreamReader({"path": str(tmp_path), "settle": "50"})
    end = reader.latestOffset()
    assert [f.files[0][2].rsplit("/", 1)[1] for f in reader.partitions(reader.initialOffset(), end)] == ["old"]
    assert [f.files[0][2].rsplit("/", 1)[1] for f in reader.partitions(end, {"until": time.time_ns()})] == ["new"]


def test_types_after_normalising(spark, folder):
    rows = load(spark, folder).where("platform = 'instagram' and day >= date '2026-01-02'")
    assert [(r["handle"], r["post_url"], r["caption"], r["posted_at"]) for r in raw.post_a(rows).select("handle", "post_url", "caption", F.col("posted_at")).collect()] == [("a b", "2", "two\nlines", dt.datetime(2026, 1, 5))]


def test_reads_of_one_folder_keep_their_own_conditions(spark, folder):
    parts = [records.read(spark, folder, platform=p) for p in ("instagram", "tiktok")]
    assert as_rows(parts[0].unionByName(parts[1])) == sorted(ROWS, key=str)
    whole = records.read(spark, folder)
    assert as_rows(whole.where("platform = 'instagram'").unionByName(whole.where("platform = 'tiktok'"))) == sorted(ROWS, key=str)
    assert as_rows(records.read(spark, folder, since="2026-01-05", handles=["a b"])) == [ROWS[1]]
