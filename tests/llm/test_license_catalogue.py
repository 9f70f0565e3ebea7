"""The license scan with a large catalogue, and what its bands miss."""

import random
import re

import pytest

from quorumlens.llm import licenses

from .test_llm_operators import frame


def notice(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def catalogue():
    rng = random.Random(1)
    return [(f"long-{i}", notice(rng, rng.randrange(60, 120))) for i in range(300)] + [("brief", "No copying"), ("five", "one two three four five")]


def documents(catalogue):
    rng, docs = random.Random(2), []
    for i in range(0, 300, 6):
        own = catalogue[i][1].split()
        for at in rng.sample(range(len(own)), i // 6 % 4):
            own[at] = "zzz"
        docs.append((i, f"{notice(rng, rng.randrange(40))} {' '.join(own)}\n{notice(rng, 30)}"))
    return docs + [(900, "so No copying here"), (901, "zero one two three four five six"), (901, "zero one two three four five six"), (902, None)]


def by_hand(docs, catalogue):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingled = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for i, text in docs:
        for name, template in catalogue:
            t = words(template)
            n = min(5, len(t))
            shared, whole = shingled(t, n) & shingled(words(text), n), shingled(t, n)
            if len(shared) >= 0.8 * len(whole):
                out.add((i, name, len(shared), len(whole)))
    return out


@pytest.mark.parametrize(("listed", "broadcast"), [(10**9, 10**6), (0, 10**6), (0, 0)])
def test_large_catalogue(spark, monkeypatch, catalogue, listed, broadcast):
    monkeypatch.setattr(licenses, "LISTED", listed)
    monkeypatch.setattr(licenses, "BROADCAST", broadcast)
    docs, some = documents(catalogue), catalogue if not listed else catalogue[:30] + catalogue[-2:]
    got = {(r["doc_id"], r["license"], r["n_shared"], r["n_template"]) for r in licenses.scan(frame(spark, docs), some).collect()}
    assert got == by_hand(docs, some) and len(got) > (40 if not listed else 5)


def test_bands_find_contained_templates_at_every_offset(spark):
    rng = random.Random(3)
    template = notice(rng, 100)
    docs, expected = [], set()
    for i in range(240):
        own = template.split()
        for at in rng.sample(range(100), i % 5):
            own[at] = "zzz"
        docs.append((i, f"{notice(rng, i % 40)} {' '.join(own)} {notice(rng, 20)}"))
    expected = {x[0] for x in by_hand(docs, [("t", template)])}
    got = {r["doc_id"] for r in licenses.scan(frame(spark, docs), [("t", template)]).collect()}
    assert got <= expected and len(got) >= 0.995 * len(expected) and len(expected) > 100
