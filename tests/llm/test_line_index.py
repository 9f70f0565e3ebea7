"""The log-structured line index: idempotent, reversible, the same by every path."""

import random

import numpy as np
import pytest

from quorumlens.llm import line_dedup
from quorumlens.llm.line_dedup import CuckooFilter, LineIndex

from .test_llm_operators import ODD, cleaned_by_hand, frame


def documents(seed, ids, lines=40):
    rng = random.Random(seed)
    return [(i, "\n".join(f"line {rng.randrange(lines)}" for _ in range(5))) for i in ids]


def state(index):
    return sorted(map(tuple, index.references().collect()))


def filters_hold(index):
    """Every key of the exact table is in its shard's filter."""
    blobs = {r["shard"]: CuckooFilter.from_bytes(bytes(r["filter"])) for r in index._latest().collect()}
    rows = index._sums().collect()
    return all(blobs[r["shard"]].contains(np.array([r["k1"]]), np.array([r["k2"]]))[0] for r in rows)


def test_inserting_twice_is_inserting_once(spark):
    first, more = documents(1, range(30)), documents(2, range(20, 50))
    once = LineIndex(spark, shards=3).insert(frame(spark, first))
    assert state(once.insert(frame(spark, first))) == state(once)
    both = once.insert(frame(spark, first + more))  # ids 20 to 29 are known, with their first texts
    want = LineIndex(spark, shards=3).insert(frame(spark, first + [d for d in more if d[0] >= 30]))
    assert state(both) == state(want) and filters_hold(both)


def test_deleting_what_is_not_there_changes_nothing(spark):
    docs = documents(3, range(30))
    index = LineIndex(spark).insert(frame(spark, docs[:20]))
    assert state(index.delete(frame(spark, docs[20:]))) == state(index)
    assert state(LineIndex(spark).delete(frame(spark, docs))) == []
    back = index.delete(frame(spark, docs)).insert(frame(spark, docs[:20]))
    assert state(back) == state(index) and filters_hold(back)


def test_many_batches_are_summed_up(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "DELTAS", 2)
    docs = documents(4, range(24))
    index = LineIndex(spark, shards=2)
    for at in range(0, 24, 6):
        index = index.insert(frame(spark, docs[at : at + 6]))
    assert len(index.exact) <= 3 and state(index) == state(LineIndex(spark, shards=2).insert(frame(spark, docs))) and filters_hold(index)


def test_full_filters_are_built_anew(spark, monkeypatch):
    index = LineIndex(spark, shards=1).insert(frame(spark, documents(5, range(2))))
    more = frame(spark, [(100 + i, "\n".join(f"own {i} {k}" for k in range(20))) for i in range(30)])
    grown = index.insert(more)
    assert filters_hold(grown) and state(grown.delete(more)) == state(index)


@pytest.mark.parametrize("spare", [False, True])
def test_filter_and_join_clean_alike(spark, monkeypatch, spare):
    docs = frame(spark, documents(6, range(40), 25) + documents(6, range(60, 75), 25) + ODD)
    index = LineIndex(spark).insert(docs)
    by_filter = sorted(map(str, index.clean(docs, 4, spare).collect()))
    monkeypatch.setattr(line_dedup, "FREQUENT", 0)
    assert by_filter == sorted(map(str, index.clean(docs, 4, spare).collect())) and any("n_dropped=5" in x for x in by_filter)


def test_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 0)
    docs = frame(spark, ODD)
    got = LineIndex(spark).insert(docs).clean(docs, 2).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == cleaned_by_hand(ODD, 2)


def test_columns_of_the_same_name_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", 7), (2, "a", "y", 8)], "doc_id long, text string, n_lines string, n_dropped int")
    got = LineIndex(spark).insert(docs).clean(docs, 2)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == [(1, "b", 2, 1), (2, "", 1, 1)]


def test_keys_are_hashed_as_in_sql(spark):
    key = "grüße aus köln"
    row = spark.range(1).selectExpr(f"xxhash64('{key}') as a", f"xxhash64(1, '{key}') as b").first()
    assert [x - (1 << 64) if x >> 63 else x for x in line_dedup.key_hashes(key.encode())] == [row["a"], row["b"]]


def test_filters_forget_copies_of_one_tag():
    cuckoo = CuckooFilter.of_size(100)
    same = np.array([5, 5, 5, 5, 5]), np.array([1 << 20] * 5)
    assert cuckoo.add(*same) and cuckoo.contains(*same).all()
    cuckoo.remove(*(x[:4] for x in same))
    assert cuckoo.contains(*same).all()
    cuckoo.remove(*(x[:1] for x in same))
    assert not cuckoo.contains(*same).any()
