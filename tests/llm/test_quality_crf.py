"""op12's field: forward-backward against all label sequences, its gradient, odd texts, held-out accuracy."""

import itertools
import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import types as T

from quorumlens.llm import quality_crf
from quorumlens.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.01")
WORDS = "river ran past the old mill and village slept until morning bell rang over roofs while nobody spoke of rain or harvest again".split()
JUNK = "BUY $$$ NOW *** BUY $$$ NOW *** {} ||| %%%"


def by_hand(good, transitions, doc):
    node, edge = np.zeros(len(good)), np.zeros((4, len(good)))
    for d in set(doc):
        at = [i for i, x in enumerate(doc) if x == d]
        total = 0.0
        for labels in itertools.product((0, 1), repeat=len(at)):
            score = sum((y - 0.5) * good[i] for i, y in zip(at, labels)) + sum(transitions[2 * a + b] for a, b in itertools.pairwise(labels))
            weight = math.exp(score)
            total += weight
            for k, (i, y) in enumerate(zip(at, labels)):
                node[i] += weight * y
                if k:
                    edge[2 * labels[k - 1] + y, i] += weight
        node[at] /= total
        edge[:, at] /= total
    return node, edge


def test_marginals():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(7), [1, 5, 8, 1, 2, 3, 7])
    good, transitions = rng.normal(0, 3, len(doc)), rng.normal(0, 1.5, 4)
    node, edge = quality_crf.marginals(good, transitions, doc)
    want = by_hand(good, transitions, doc)
    assert np.allclose(node, want[0]) and np.allclose(edge, want[1])


def test_long_chain():
    """Probabilities stay finite over many lines and far odds, and documents don't see each other."""
    rng = np.random.default_rng(4)
    good = rng.normal(0, 40, 50_000)
    alone = quality_crf.marginals(good, np.array([1.0, -1, -1, 1]), np.zeros(50_000, int))[0]
    again = quality_crf.marginals(np.append(good, good), np.array([1.0, -1, -1, 1]), np.repeat([0, 1], 50_000))[0]
    assert np.isfinite(alone).all() and np.allclose(again, np.append(alone, alone))


def test_features():
    x, size, doc = quality_crf.features(["a a b\n\nA##", None, "one two three one two three", "a a b"])
    assert size.tolist() == [5, 0, 3, 0, 27, 5] and doc.tolist() == [0, 0, 0, 1, 2, 3]
    k = len(quality_crf.KINDS)
    assert x[:, k].tolist() == pytest.approx([1 / 3, 0, 0, 0, 0, 1 / 3])  # a word twice in a row
    assert x[:, k + 1].tolist() == pytest.approx([0, 0, 0, 0, 2 / 6, 0])  # three words twice, only in one document
    assert x[2, 0] == pytest.approx(math.sqrt(2 / 3))
    n = quality_crf.BASE
    assert np.allclose(x[0, 2 * n : 3 * n], x[1, :n]) and not x[0, n : 2 * n].any() and np.allclose(x[2, n : 2 * n], x[1, :n])
    assert x[:, -2].tolist() == [1, 0, 0, 1, 1, 1] and x[:, -1].tolist() == [0, 0, 1, 1, 1, 1]


def prose(seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.permutation(WORDS)[: rng.integers(8, 18)]).capitalize() + "."


def sample():
    texts = ["\n".join(prose(3 * i + k) for k in range(1 + i % 3)) for i in range(60)]
    # bad documents begin with a passage that good ones share
    junk = ["\n".join([prose(3), *[JUNK.format(i)] * 3]) for i in range(20)]
    return texts + junk, [1] * 60 + [0] * 20


def test_good_lines_of_bad_documents():
    field = quality_crf.fit(*sample())
    good, _, _ = field.lines(["\n".join([prose(3), JUNK.format(7), JUNK.format(7)])])
    assert good[0] > 0.5 > good[1] and good[2] < 0.1
    scores = field.scores([prose(5000), JUNK.format("x"), "\n".join([prose(3)] + [JUNK.format("x")] * 3), "", None])
    assert scores[0] >= 0.7 > scores[1] and scores[2] < 0.7 and scores[3] == scores[4]


def test_odd_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("h", T.LongType())])
    texts, marks = sample()
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "x", None, None), (500, None, None, None), (501, "", None, None), (502, "word " * 50_000, None, None), (502, "\n" * 9_000, None, None)]
    labels = [(i, m, 0) for i, m in enumerate(marks)] + [(None, 1, 0), (3, 0, 0), (501, 7, None), (502, None, 1), (1000, 1, 1)]
    docs, known = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_crf.score(docs, quality_crf.train(docs, known))
    assert out.columns == ["doc_id", "text", "h", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["predicted"] == marks[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    empty = spark.createDataFrame([], schema)
    assert quality_crf.score(empty, quality_crf.train(empty, known)).collect() == []
    assert {r["score"] for r in quality_crf.score(docs, quality_crf.train(docs, known.where("quality = 1"))).collect()} == {1.0}


@pytest.mark.skipif(not DATA.exists(), reason="driver tables aren't here")
def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_quality_crf"](spark, str(DATA)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items()) and len(got) == 1000
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    found = [got[i]["predicted"] == q for i, q in labels]
    assert np.mean(found) >= 0.95 and np.mean([f for f, (_, q) in zip(found, labels) if q == 0]) >= 0.8
