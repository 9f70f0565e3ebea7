"""The pipeline's near_dedup takes its first links from op3's fingerprints, and checks them on the word sets."""

import random

import numpy as np

import corpus_pipeline
from quorumlens.llm import near_copies, simhash

from .test_llm_operators import frame


def test_fingerprints_alone_link_close_copies_and_no_others(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(20):
        text = [rng.choice(words) for _ in range(1500)]
        rows += [(10 * i, " ".join(text), "en", "a"), (10 * i + 1, " ".join([*text, "tail"]), "en", "a")]
    near = [simhash.fingerprint(a[1], 5) ^ simhash.fingerprint(b[1], 5) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    # texts of one shingle with a fingerprint of its own each: no set in common, whatever their bits
    rows += [(1000 + i, f"only {i}", "en", "a") for i in range(5)]
    monkeypatch.setattr(near_copies, "bands", lambda hashes: np.zeros(0, np.int64))
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    close = {10 * i + 1 for i, x in enumerate(near) if x.bit_count() <= 2}
    assert len(close) > 5 and left == {r[0] for r in rows} - close
