"""Cases in which an operator or a stage once did less than the whole job."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quorumlens.llm import licenses, near_copies, simhash

from .test_llm_operators import fingerprint_by_hand, frame


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def jaccard_survivors(docs):
    """Smallest doc_id of each component of five-word Jaccard >= 0.8."""
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}


@pytest.mark.parametrize(("pairs", "common"), [(8, 16), (0, 3)])
def test_near_dedup_finds_near_copies(spark, monkeypatch, pairs, common):
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rng = random.Random(3)
    docs = [(i, " ".join(words(rng, 140))) for i in range(20)]
    for i in range(20, 120):  # a crowd of near copies of one text, some too far, and a few of others
        own = docs[0 if i < 90 else rng.randrange(20)][1].split()
        for at in rng.sample(range(140), rng.randrange(1, 6)):
            own[at] = f"z{rng.randrange(60)}"
        docs.append((i, " ".join(own)))
    want = jaccard_survivors(docs)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, docs), "").collect()]
    assert sorted(got) == sorted(want) and 20 < len(want) < 110
    far = [i for i, t in docs[20:] if i not in want and (fingerprint_by_hand(t) ^ fingerprint_by_hand(docs[0][1])).bit_count() > 2]
    assert len(far) > 5


def test_lines_of_copies_stay(spark):
    rng = random.Random(4)
    text = "\n".join(" ".join(words(rng, 30)) for _ in range(4))
    near = [x.split("\n") for x in ["\n".join(" ".join(words(rng, 30)) for _ in range(4))] * 14]
    for i in range(1, 14):  # 14 near copies: the first line of each but one has a word of its own
        near[i][0] += f" z{i}"
    docs = [(i, text) for i in range(15)] + [(50 + i, "\n".join(x)) for i, x in enumerate(near)]
    docs += [(100 + i, f"A line on every site\n{' '.join(words(rng, 20))}") for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, frame(spark, docs), "").collect()}
    assert all(out[i] == text for i in range(15)) and out[50] == docs[15][1]
    assert not any("every site" in t for t in out.values())
    assert not any(out[i] == dict(docs)[i] for i in range(51, 64))
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, docs[:15]), "").collect()]
    assert left == [0]


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_one_row_of_each_component_by_row(spark, module):
    rng = random.Random(5)
    texts = [" ".join(words(rng, 40)) for _ in range(9)]
    docs = [(None, t) for t in texts[:4]] + [(1, texts[4]), (1, texts[5]), (1, texts[5]), (2, texts[6]), (2, texts[7]), (3, texts[7]), (None, texts[8]), (9, texts[8])]
    got = Counter((r["doc_id"], r["text"]) for r in module.one_of_each(frame(spark, docs)).collect())
    want = [(None, t) for t in texts[:4]] + [(1, texts[4]), (1, texts[5]), (2, texts[6]), (2, texts[7]), (9, texts[8])]
    assert got == Counter(want)


def test_short_notices_anywhere(spark):
    texts = ["(c) 2024 Foo Inc. All rights reserved.", "one two three. All rights\nreserved", "-" * 500 + " All rights reserved " + "-" * 500, "all rights are reserved", "rights reserved", "so all all rights reserved of"]
    got = {(r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {(i, "all-rights-reserved", at) for i, at in ((0, 4), (1, 3), (2, 0), (5, 2))}
    two = licenses.scan(frame(spark, [(1, "x no copying y"), (2, "secret")]), [("a", "No copying"), ("b", "Secret"), ("c", "all of it is ours")])
    assert {(r["doc_id"], r["license"]) for r in two.collect()} == {(1, "a"), (2, "b")}
