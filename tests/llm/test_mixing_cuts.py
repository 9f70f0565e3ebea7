"""Mixing where a budget ends in a crowd of rows, and columns named like the plan's."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorumlens.llm import mixing

from .test_llm_operators import WORD, frame


def by_hand(rows):
    """(doc_id, taken) of rows with __source, __size, __key, doc_id and the targets of their sources, sorted whole."""
    out = []
    for source in {r["source"] for r in rows}:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        total = sum(r["size"] for r in own)
        epochs = int(own[0]["target"] // total) if total else 0
        left = int(own[0]["target"] - epochs * total)
        for r in own:
            out.append((r["doc_id"], epochs * r["size"] + min(r["size"], left)))
            left -= min(r["size"], left)
    return Counter(out)


@pytest.mark.parametrize("sorted_rows", [1, 20, 50_000])
def test_plan_equals_a_whole_sort(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(mixing, "SORTED", sorted_rows)
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    rng = random.Random(7)
    docs = [(i, "1234567890 " * rng.randrange(0, 30) + "w " * rng.randrange(3), "en", rng.choice(["a", "a", "b", None])) for i in range(400)]
    docs += [(7, "same row again", "en", "a")] * 150 + [(None, "no id", "en", "a")] * 90
    documents = frame(spark, docs)
    plan = mixing.mix_plan(documents).collect()
    keys = mixing.keyed(documents, 11).select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key")).collect()
    targets = {r["source"]: r["target"] for r in plan}
    assert Counter((r["doc_id"], r["taken"]) for r in plan) == by_hand([{**r.asDict(), "target": targets[r["source"]]} for r in keys])


def test_columns_named_like_the_plans(spark):
    docs = frame(spark, [(i, f"w{i} " * (i % 9), "en", "ab"[i % 2]) for i in range(60)])
    for name in ("name", "epochs", "part", "budget", "cut", "cut_key", "low", "bucket", "words", "left"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r["name"] == "own name" and r["part"] == "own part" and r["left"] == "own left" for r in rows)
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect() if r["taken"]})


def test_rows_that_share_an_id_keep_their_texts(spark):
    docs = frame(spark, [(1, "a b c d", "en", "s"), (1, "e f g h", "en", "s"), (1, "i j k l", "en", "s"), (2, "m n", "en", "t")])
    texts = Counter(w for r in mixing.mix(docs).collect() for w in r["text"].split())
    plan = mixing.mix_plan(docs).collect()
    assert sum(texts.values()) == sum(r["taken"] for r in plan) and max(texts.values()) <= 2
