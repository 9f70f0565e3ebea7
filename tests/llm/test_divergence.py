"""op11's operator against a brute-force version in exact integers."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from quorumlens.llm import common, divergence

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
)
LOWER = {i: i + 32 for i in range(65, 91)}


def by_hand(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    found = defaultdict(Counter)
    for lang, _, words in docs:
        found[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in found.items()}
    counts, in_lang = {(lang, source): Counter() for lang, source, _ in docs}, defaultdict(Counter)
    for lang, source, words in docs:
        own = [w for w in words if w in set(kept[lang])]
        counts[lang, source].update(own)
        in_lang[lang].update(own)
    share = lambda c, lang, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept[lang]))
    out = []
    for lang, source in counts:
        here = counts[lang, source]
        pairs = [(o, sum(abs(share(here, lang, t) - share(counts[lang, o], lang, t)) for t in kept[lang])) for x, o in counts if x == lang and o != source]
        terms = [(t, share(here, lang, t) - share(in_lang[lang], lang, t)) for t in kept[lang] if here[t]]
        for part, items, most in (("pair", pairs, None), ("term", [x for x in terms if x[1] > 0], top)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(order, 1)]
    return sorted(out)


def odd_rows():
    words = ["Alpha", "beta", "ÄRGER", "ärger", "日本", "x", "q1w", "zeta_eta"]
    rows = [(i, " ".join(words[j % 8] for j in range(i % 11, i % 11 + i % 7)), "en" if i % 3 else "de", f"s{i * i % 5}", None, None) for i in range(120)]
    rows += [(7, "alpha alpha beta", "en", "s1", "clash", 1)] * 40  # repeated rows, a third of all
    rows += [(None, None, None, None, None, None), (1, "", "en", None, None, None), (2, "12 34 --", "xx", "only", None, None), (3, "alpha " * 20_000, "en", "s9", None, None), (4, "rare", "yy", "a", None, None), (5, None, "yy", "b", None, None)]
    return rows


@pytest.mark.parametrize("most", [200_000, 0])
def test_audit(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    if not most:  # each text handed on by itself
        count = divergence._partial_counts
        monkeypatch.setattr(divergence, "_partial_counts", lambda docs: count(docs.repartition(200)))
    rows = odd_rows()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=3, top=2)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = by_hand(rows, 3, 2)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert ("yy", "a", "pair", "b", 0, 1) in want and any(r[2] == "term" for r in want)


def test_shares_beyond_long(spark):
    rows = spark.sql("select 3000000000000L as n, 9000000000000000L as t, 7L as v")
    p = rows.select(divergence._share(rows.n, rows.t, rows.v).alias("p")).first()["p"]
    assert p == 1 + 10**9 * (3_000_000_000_000 + 5) // (9_000_000_000_000_000 + 35)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
