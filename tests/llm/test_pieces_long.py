"""SentencePiece segments without spaces, the best path of a BPE model, and both orders' round trips."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quorumlens.llm import sentencepiece
from quorumlens.llm.sentencepiece import Encoder, Vocabulary

from .test_llm_operators import PIECES, frame, piece_texts


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECES, "rb") as file:
        return Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)


def unbroken(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(["the", "ing", "a", "x", "xx", "ß", "中", "🙂", "qz", "ation"]) for _ in range(n))[:n]


def test_blocks_give_the_same_path(vocabulary, monkeypatch):
    texts = [unbroken(700, k) for k in range(4)] + ["x" * 500, "中" * 90]
    whole = Encoder(vocabulary, merge_order=False).encode(texts)[0]
    monkeypatch.setattr(sentencepiece, "WHOLE", 16)
    blocks = Encoder(vocabulary, merge_order=False).encode(texts)[0]
    assert [x.tolist() for x in whole] == [x.tolist() for x in blocks]


def test_long_segments_equal_the_library(vocabulary, library):
    texts = [unbroken(70_000), "x" * 66_000, unbroken(400, 3)]
    ids, paths, corrected = Encoder(vocabulary).encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    back = Encoder(vocabulary).decode(pa.array([x.tolist() for x in paths], pa.list_(pa.int32()))).to_pylist()
    assert back == texts and len(corrected) == 3


def test_a_very_long_segment_costs_little_a_character(vocabulary, library):
    text, began = unbroken(1_000_000), time.perf_counter()
    ids, _, _ = Encoder(vocabulary).encode([text])
    assert ids[0].tolist() == library.encode(text) and time.perf_counter() - began < 60


def path_by_hand(vocabulary, segment):
    """The best sum of scores, by trying every piece at every place."""
    score = {p: float(vocabulary.key_scores[np.flatnonzero(vocabulary.key_ids == i)[0]]) for p, (_, i) in vocabulary.known.items() if len(p) <= len(segment) and p in segment}
    best = [0.0] + [-np.inf] * len(segment)
    for end in range(1, len(segment) + 1):
        for start in range(end):
            piece = segment[start:end]
            if piece in score or end - start == 1:
                best[end] = max(best[end], best[start] + score.get(piece, vocabulary.unknown_score))
    return best[-1]


def test_paths_of_a_bpe_model_have_the_best_score(vocabulary):
    encoder = Encoder(vocabulary)
    by_id = dict(zip(vocabulary.key_ids.tolist(), vocabulary.key_scores.tolist(), strict=True))
    for word in ("understanding", "internationalisation", "größere", "xyzzyx", "theing"):
        ids, paths, corrected = encoder.encode([word])
        assert sum(by_id.get(i, vocabulary.unknown_score) for i in paths[0].tolist()) == pytest.approx(path_by_hand(vocabulary, "▁" + word))
        assert (ids[0].tolist() != paths[0].tolist()) == bool(corrected[0])


def test_both_orders_round_trip(spark, vocabulary):
    texts = [t for t in piece_texts() if len(t) < 300]
    docs = frame(spark, list(enumerate(texts)))
    rows = sentencepiece.encode(docs, vocabulary, paths=True)
    for column in ("ids", "path_ids"):
        back = sentencepiece.decode(rows, vocabulary, column).select("doc_id", "decoded").collect()
        assert {r["doc_id"]: r["decoded"] for r in back} == {i: t.replace("▁", " ") for i, t in enumerate(texts)}
    plain = sentencepiece.encode(docs, vocabulary, merge_order=False)
    assert sorted(map(str, plain.select("doc_id", "ids").collect())) == sorted(map(str, rows.selectExpr("doc_id", "path_ids as ids").collect()))
