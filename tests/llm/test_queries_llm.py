"""The registered opN_ queries over a driver's table: their SQL in DuckDB, or a brute-force version."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quorumlens.llm import licenses
from quorumlens.llm.queries import PIECES, QUERIES, SQL

from ..test_queries import rows
from .test_llm_operators import fingerprint_by_hand, roots_by_hand

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text, lang from documents").fetchall()


def run(spark, name):
    return QUERIES[name](spark, str(DATA))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = run(spark, name)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_op3(spark, texts):
    prints = [fingerprint_by_hand(t) for _, t, _ in texts]
    ids = [i for i, _, _ in texts]
    roots = roots_by_hand(prints)
    groups = {}
    for at, r in enumerate(roots):
        groups.setdefault(r, []).append(ids[at])
    want = {ids[at]: (f"{prints[at]:016x}", min(groups[r])) for at, r in enumerate(roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op3_simhash").collect()} == want


def test_op5(spark, duck, texts):
    got = {r["doc_id"]: r for r in run(spark, "op5_toxicity").collect()}
    assert set(got) == {i for i, _, _ in texts}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_op6(spark, duck):
    found = duck.execute("select vec_id, embedding from embeddings").fetchall()
    vectors = {i: np.array(v, float) for i, v in found}
    got = {}
    for r in run(spark, "op6_ann").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = []
    for q in [i for i in vectors if i % 50 == 0]:
        score = {i: float(vectors[q] @ v / np.linalg.norm(vectors[q]) / np.linalg.norm(v)) for i, v in vectors.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert len(got[q]) == min(5, len(score)) and all(math.isclose(s, score[i], rel_tol=1e-12) for i, s in got[q])
        hits.append(len(set(best) & {i for i, _ in got[q]}) / len(best))
    assert np.mean(hits) >= 0.9


def test_op7(spark, texts):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for i, text, _ in texts:
        own = words(text)
        for name, notice in licenses.CATALOGUE:
            t = words(notice)
            whole = runs(t, min(5, len(t)))
            shared = whole & runs(own, min(5, len(t)))
            if len(shared) >= 0.8 * len(whole):
                want.add((i, name, len(shared)))
    assert {(r["doc_id"], r["license"], r["n_shared"]) for r in run(spark, "op7_licenses").collect()} == want and want


def test_op8(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op8_langid").collect()}
    assert set(got) == {i for i, _, _ in texts}
    held = [(i, lang) for i, t, lang in texts if got[i]["held_out"] and got[i]["lang_pred"] != "und" and lang]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) >= 0.9


def test_op9(spark, texts):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in run(spark, "op9_sentencepiece").collect()}
    assert all(r["round_trip"] for r in got.values())
    assert {i: r["n_ids"] for i, r in got.items()} == {i: len(library.encode(t or "")) for i, t, _ in texts}


def test_op10(spark, texts):
    got = run(spark, "op10_sharding").collect()
    slots, expected = {}, {i: ((len((t or "").encode()) + 16), zlib.crc32((t or "").encode())) for i, t, _ in texts}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in texts)
    for r in got:
        assert (r["size"], r["text_crc32"]) == expected[r["doc_id"]] and r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


