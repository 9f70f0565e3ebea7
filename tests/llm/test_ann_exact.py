"""Nearest neighbours where cells hold too few ids, ids repeat and lengths are mixed: equal to brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import ann


def by_hand(rows, k):
    out = {}
    for a, x in rows:
        if a % 50:
            continue
        best = out.setdefault(a, {})
        for b, y in rows:
            if a != b and len(x) == len(y):
                score = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
                best[b] = max(best.get(b, -9.0), score)
    return {a: [b for b, _ in sorted(best.items(), key=lambda p: (-round(p[1], 9), p[0]))[:k]] for a, best in out.items() if best}


def nearest(spark, rows, k=5, **more):
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
    return got


V, W, X, Y = [1.0, 2.0, -1.0], [0.3, 0.1, 5.0], [2.0, -2.0, 0.5], [0.1, 0.1, 0.1]


@pytest.mark.parametrize("rows", [
    [], [(50, V)], [(50, V), (1, W)], [(50, V), (1, [-a for a in V]), (2, W), (3, X)], [(50, V), (1, W), (2, X), (3, Y), (100, V)],
    [(50, V), (1, W), (2, X), (3, Y), (4, [9.0, 1.0, 1.0]), (5, V)],
    [(50, V), (50, W), (1, X), (1, V), (1, V), (2, Y), (2, W), (3, X), (4, V), (5, W)],
    [(50, V), (1, W), (2, X), (3, [1.0] * 65), (100, [2.0] * 64 + [1.0]), (4, [1.0, 1.0])],
])
def test_few_rows(spark, rows):
    assert nearest(spark, rows) == by_hand(rows, 5)
    assert nearest(spark, rows, tables=1, probes=1) == by_hand(rows, 5)


def test_one_id_with_several_vectors_is_one_neighbour(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 120, rng.normal(size=8).tolist()) for i in range(360)]
    got = nearest(spark, rows, tables=2, probes=16)
    assert got == by_hand(rows, 5) and all(len(set(v)) == 5 for v in got.values())


def test_few_probes_are_followed_by_an_exact_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(40)] + [(50, rng.normal(size=32).tolist())]
    want = by_hand(rows, 39)
    assert nearest(spark, rows, 39, tables=1, probes=1) == want


def test_a_common_vector_is_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(600)]
    got = nearest(spark, rows, tables=2, probes=16)
    assert got == by_hand(rows, 5)


def test_magnitudes_are_no_matter(spark):
    """Scores are those of the same directions, however long the vectors, and equal to the last bit for powers of two."""
    rows = [(50, [1.0, 2.0]), (1, [1e200, 2e200]), (2, [1e-200, -2e-200]), (3, [1e-320, 3e-320]), (4, [1.7e308, -1.7e308]), (5, [1e300, 1e-300]), (6, [3.0, 1.0]), (7, [3.0 * 2.0**900, 2.0**900]), (8, [3.0 * 2.0**-900, 2.0**-900])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in ann.nearest(df, F.col("vec_id") == 50, 8).collect()}
    want = {1: 1.0, 2: -0.6, 3: 7 / 50**0.5, 4: -1 / 10**0.5, 5: 1 / 5**0.5, 6: 5 / 50**0.5, 7: 5 / 50**0.5, 8: 5 / 50**0.5}
    assert got.keys() == want.keys() and got[6] == got[7] == got[8]
    assert all(abs(got[i] - x) < (1e-3 if i == 3 else 1e-12) for i, x in want.items())
