"""The pipeline against a brute-force version of its stages, and on empty and odd documents."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from quorumlens.llm import langid, mixing
from quorumlens.llm.common import stored
from quorumlens.llm.queries import PIECES, QUERIES, SQL

from .test_llm_operators import ODD, fingerprint_by_hand, frame, roots_by_hand

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=9):
    rng = random.Random(seed)
    stock = {"en": "the and that with this from which water under house".split(), "de": "und nicht mit auch für über größer wasser unter haus".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(rng.choice(stock[lang]) for _ in range(rng.randrange(8, 20))) for _ in range(rng.randrange(1, 6))]
        if i % 5 == 0:
            lines.insert(0, "A line on every site")
        rows.append((i, "\n".join(lines), lang, rng.choice("aab")))
    rows += [(200 + i, rows[i][1], rows[i][2], "b") for i in range(12)]  # copies
    rows += [(300, "123 456 !!", "en", "a"), (301, None, "en", "a"), (302, "A line on every site", "en", "a")]
    return rows


def stages_by_hand(rows, model):
    """doc_ids after language ID, (doc_id, text) after line dedup, doc_ids after near-dedup."""
    named = [r for r in rows if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= 0.4]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for _, k in {(r[0], key(x)) for r in named for x in r[1].split("\n") if key(x)})
    texts = {r[0]: "\n".join(x for x in r[1].split("\n") if seen[key(x)] < 10) for r in named}
    texts = {i: t for i, t in texts.items() if WORD.search(t)}
    ids = sorted(texts)
    roots = roots_by_hand([fingerprint_by_hand(texts[i]) for i in ids])
    return {r[0] for r in named}, texts, {ids[r] for r in roots}


def test_stages_match_brute_force(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    rows = corpus()
    docs = frame(spark, rows)
    named, texts, alone = stages_by_hand(rows, langid.train(docs))
    one = stored(corpus_pipeline.language_id(spark, docs, ""))  # written and read again, as the pipeline does
    assert {r["doc_id"] for r in one.collect()} == named and {300, 301}.isdisjoint(named) and len(named) > 120
    two = stored(corpus_pipeline.dedup_lines(spark, one, ""))
    assert {r["doc_id"]: r["text"] for r in two.collect()} == texts and 302 not in texts
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stored(corpus_pipeline.near_dedup(spark, two, ""))
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(alone) and len(alone) < len(texts)
    four = stored(corpus_pipeline.mix_sources(spark, three, ""))
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(three).collect()}
    words = Counter()
    for r in four.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) or len(WORD.findall(r["text"])) < len(WORD.findall(texts[r["doc_id"]]))
    assert words == Counter({k: v for k, v in plan.items() if v})
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    last = corpus_pipeline.encode_pieces(spark, four, "")
    got = sorted((r["doc_id"], list(r["ids"])) for r in last.collect())
    assert got == sorted((r["doc_id"], library.encode(r["text"])) for r in four.collect())


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_and_empty_documents(spark, rows):
    docs = frame(spark, rows) if rows else frame(spark, ODD).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
    assert {"doc_id", "ids"} <= set(docs.columns) and (docs.count() > 0) == bool(rows)


def test_registered_queries():
    assert [f"op{n}_" for n in range(1, 14)] == sorted({re.match(r"op\d+_", k)[0] for k in QUERIES}, key=lambda x: int(x[2:-1]))
    assert set(SQL) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "dedup_lines", "near_dedup", "mix_sources", "encode_pieces"]
