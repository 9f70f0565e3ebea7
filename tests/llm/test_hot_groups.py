"""Keys, ids and texts that hold a third of all rows or more."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorumlens.llm import sharding

from .test_llm_operators import frame


@pytest.mark.parametrize(("rows", "broadcast"), [(100_000, 1_000_000), (40, 1_000_000), (40, 0)])
def test_slots_of_crowded_buckets(spark, monkeypatch, rows, broadcast):
    monkeypatch.setattr(sharding, "ROWS", rows)
    monkeypatch.setattr(sharding, "CROWDED", 2)
    monkeypatch.setattr(sharding, "BROADCAST", broadcast)
    docs = [(i, f"text {i}", "en", "s") for i in range(300)] + [(None, "same", "en", "s")] * 400 + [(7, f"other {i}", "en", "s") for i in range(300)]
    got = sharding.layout(frame(spark, docs), [1.0] * 4, 1.0).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in docs)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def test_rows_of_one_key_are_spread_over_buckets(spark):
    docs = frame(spark, [(7, f"text {i}", "en", "s") for i in range(3000)])
    rows = docs.select("doc_id", F.crc32("text").alias("c")).withColumn("shard", F.lit(0))
    bucket = F.pmod(F.xxhash64("doc_id", "c", F.lit(7)), F.lit(sharding.BUCKETS))
    assert rows.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] < 20
    slots = sharding.with_slots(rows, "shard", ["doc_id", "c"]).select("slot").collect()
    assert sorted(r["slot"] for r in slots) == list(range(3000))
