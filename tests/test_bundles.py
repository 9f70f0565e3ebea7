"""Folders of many handles: files don't grow with the handles, and filters find what is in them."""

from pathlib import Path

import pytest

from quorumlens.sources import records

from .test_record_source import ROWS, SCHEMA, as_rows


def test_files_are_as_many_as_bundles_and_rows_come_back(spark, tmp_path):
    many = [("instagram", f"h{i}", "2026-01-01", f'{{"url":"{i}"}}') for i in range(300)]
    records.write(spark.createDataFrame(many, SCHEMA), f"file://{tmp_path}/r", "posts", bundles=3)
    assert len([p for p in Path(tmp_path, "r").rglob("part-*")]) == 3
    assert as_rows(records.read(spark, f"file://{tmp_path}/r")) == sorted(many, key=str)
    one = records.read(spark, f"file://{tmp_path}/r", handles=["h7"])
    assert as_rows(one) == [many[7]] and one.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("handles", [["é"], ["a b", "c/d"], ["none"]])
def test_both_forms_side_by_side(spark, tmp_path, handles):
    path, rows = f"file://{tmp_path}/r", [*ROWS, ("tiktok", None, "2026-01-03", "{}")]
    records.write(spark.createDataFrame(ROWS, SCHEMA), path, "posts")
    records.write(spark.createDataFrame(rows, SCHEMA), path, "posts", bundles=2)
    assert as_rows(records.read(spark, path)) == sorted(ROWS + rows, key=str)
    assert as_rows(records.read(spark, path, handles=handles)) == sorted((r for r in ROWS + rows if r[1] in handles), key=str)
    assert as_rows(records.read(spark, path, since="2026-01-05", platform="instagram")) == [ROWS[1]] * 2
