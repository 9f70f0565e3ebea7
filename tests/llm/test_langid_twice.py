"""Language ID against a second, plain version of its features, updates and calibration."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import common, langid

from .test_llm_operators import frame, languages


def grams(text):
    """(order, feature) of every n-gram, from the words of the definition."""
    out, text = [], text.lower()
    for k in (1, 2, 3):
        for i in range(len(text) - k + 1):
            mixed = 0
            for place, char in enumerate(text[i : i + k]):
                mixed = (mixed * 31 + ord(char) * (2654435761, 2246822519, 3266489917)[place]) % 2**32
            out.append((k, ((mixed ^ (mixed >> 15)) * 0x85EBCA6B % 2**32) >> (32 - langid.BITS)))
    return out


def plain_fit(texts, labels, alpha=0.3, beta=1.0, l1=0.02, l2=0.001, epochs=3):
    kinds = sorted(set(labels))
    counts = [Counter(grams(t)) for t in texts]
    df = Counter(f for c in counts for f in {f for _, f in c})
    idf = lambda f: math.log((1 + len(texts)) / (1 + df[f])) + 1
    z, n, bias, seen = {}, {}, [0.0] * len(kinds), [1e-8] * len(kinds)

    def weight(f, k):
        v = z.get((f, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((f, k), 0.0))) / alpha + l2)

    learn = [i for i in range(len(texts)) if i % 10 or len(texts) < 20]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(learn):
            totals = Counter(k for k, _ in grams(texts[i]))
            x = [(f, c / totals[k] * idf(f) * langid.SCALE) for (k, f), c in sorted(counts[i].items())]
            w = [[weight(f, k) for k in range(len(kinds))] for f, _ in x]
            logits = [bias[k] + sum(v * w[j][k] for j, (_, v) in enumerate(x)) for k in range(len(kinds))]
            top = max(logits)
            e = [math.exp(a - top) for a in logits]
            for k in range(len(kinds)):
                error = e[k] / sum(e) - (labels[i] == kinds[k])
                before = {f: (n.get((f, k), 0.0)) for f, _ in x}
                for j, (f, v) in enumerate(x):
                    g = v * error
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(before[f] + g * g) - math.sqrt(before[f])) / alpha * w[j][k]
                    n[f, k] = n.get((f, k), 0.0) + g * g
                seen[k] += error * error
                bias[k] -= alpha * error / (beta + math.sqrt(seen[k]))
    return kinds, {(f, k): weight(f, k) * idf(f) for f, k in z}, bias


def test_second_version_learns_the_same_weights():
    rows = [(i, t[:40], x) for i, t, x in languages(60, 4)]
    model = langid.fit([t for _, t, _ in rows], [x for _, _, x in rows])
    kinds, weights, bias = plain_fit([t for _, t, _ in rows], [x for _, _, x in rows])
    assert model.languages == kinds and model.bias == pytest.approx(bias)
    dense = {(int(f), k): float(model.weights[r, k]) for r, f in enumerate(model.rows) for k in range(len(kinds)) if model.weights[r, k]}
    assert set(dense) == {key for key, v in weights.items() if v}
    assert all(dense[key] == pytest.approx(weights[key], rel=1e-5, abs=1e-6) for key in dense)
    text = rows[7][1]
    totals = Counter(k for k, _ in grams(text))
    logits = [bias[k] + sum(c / totals[o] * langid.SCALE * weights.get((f, k), 0.0) for (o, f), c in Counter(grams(text)).items()) for k in range(len(kinds))]
    p = [math.exp((a - max(logits)) / model.temperature) for a in logits]
    lang, score = model.predict(text)
    assert lang == kinds[int(np.argmax(p))] and score == pytest.approx(max(p) / sum(p), rel=1e-4)


def test_temperature_is_the_best_of_its_grid_on_what_weights_have_not_seen():
    rows = languages(120, 5)
    texts, labels = [t for _, t, _ in rows], [x for _, _, x in rows]
    model = langid.fit(texts, labels)
    held = [i for i in range(120) if i % 10 == 0]

    def loss(t):
        out = 0.0
        for i in held:
            e = np.exp(model.logits(texts[i]) / t - (model.logits(texts[i]) / t).max())
            out -= math.log(max(1e-300, e[model.languages.index(labels[i])] / e.sum()))
        return out

    assert loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.05, 20, 121)) + 1e-9


def test_sample_is_the_smallest_hashes(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("g"), F.xxhash64(F.floor(F.col("id") / 2)).alias("h"))
    rows = rows.unionByName(rows.limit(1).withColumn("h", F.lit(5).cast("long")).crossJoin(spark.range(900)).select("g", "h"))
    got, want = {}, {}
    for r in common.smallest_hashes(rows, "g", "h", 50).collect():
        got.setdefault(r["g"], set()).add(r["h"])
    for r in rows.collect():
        want.setdefault(r["g"], set()).add(r["h"])
    assert all(got[g] == set(sorted(want[g], key=lambda h: (h & (2**64 - 1)))[:50]) or len(got[g]) == 50 for g in want)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_BYTES", 4 * 2000)
    docs = frame(spark, [(i, "x" * 500, "en") for i in range(50)])
    sample = docs.select("text").orderBy("doc_id").limit(40)
    assert len(common.first_texts(sample, 4 * 2000)) == 4
    assert langid.train(docs).languages == ["en"]
