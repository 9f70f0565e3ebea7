"""op13's operator against encodings of whole texts, aligned byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from quorumlens.llm import alignment, common
from quorumlens.llm.queries import BYTES, PIECES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(BYTES).exists(), reason="tokenizer files aren't here")


@pytest.fixture(scope="module")
def libraries():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    chars = alignment.byte_of_char()
    raw_a = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, raw_a, {i: piece(i) for i in range(b.get_piece_size())}


def spans(ids, raw):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(raw[i])))
        at += len(raw[i])
    return out


def by_hand(texts, libraries):
    a, b, raw_a, raw_b = libraries
    docs, corpus = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(raw_a[i] for i in ids_a) != whole or b"".join(raw_b[i] for i in ids_b) != whole:
            docs.append((0, 0, [], []))
            continue
        sa, sb, first, links = spans(ids_a, raw_a), spans(ids_b, raw_b), 0, []
        for i, start, end in sa:
            while sb[first][2] <= start:
                first += 1
            at = first
            while at < len(sb) and sb[at][1] < end:
                links.append((i, sb[at][0]))
                at += 1
        cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
        group = lambda side: [[str(i) for i, s, e in side if lo <= s and e <= hi] for lo, hi in zip([0, *cuts], cuts)]  # noqa: B905, E731
        docs.append((len(ids_a), len(ids_b), links, [",".join(x) + "|" + ",".join(y) for x, y in zip(group(sa), group(sb), strict=True)]))
        corpus.update(set(links))
    best = defaultdict(int)
    for (i, _), n in corpus.items():
        best[i] = max(best[i], n)
    return corpus, [(n_a, n_b, len(groups), len(links), sum(corpus[x] == best[x[0]] for x in links), sum(corpus[x] for x in links), ";".join(groups)) for n_a, n_b, links, groups in docs]


def odd_texts():
    random.seed(5)
    parts = ["the", "The", "don't", "1234", "ünïcödé", "日本語テキスト", "🙂👩‍👩‍👧", "\n", "\n\n", "\t", "  ", " ", "   ", " ", " ", "\x1c", "\x85", "\r\n", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "...", "!!", "é", "\x00", "a" * 30, "naïve", "Ünder", "٣٤", "ﬁ"]
    texts = ["".join(random.choice(parts) + random.choice(["", " ", " "]) for _ in range(random.randint(1, 40))) for _ in range(150)]
    texts += [None, "", " ", "   ", "a", "a ", "\n", " \n x", "it's  done \n\n  yes", "▁ is a space here", "x▁y", "the cat " * 3_000, "z" * 20_000, " " * 3_000 + "q"]
    return texts + ["the same text again"] * 60


@pytest.mark.parametrize("small", [False, True])
def test_encoded(spark, monkeypatch, libraries, small):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(5)
    vocabularies = alignment.load(spark, BYTES, PIECES)
    assert vocabularies.by_rank
    if small:  # bounds so low that workers start anew, and nothing is encoded by rank
        vocabularies.by_rank, run = False, alignment._aligner

        def bounded(*args):
            alignment.CACHE = 40
            return run(*args)

        monkeypatch.setattr(alignment, "_aligner", bounded)
    encoded = common.stored(alignment.encode(df, vocabularies))
    counts = alignment.pair_counts(encoded)
    got = {r["doc_id"]: r for r in alignment.with_counts(encoded, counts).collect()}
    corpus, want = by_hand(texts, libraries)
    names = (*alignment.COUNTS, "n_best", "count_sum", "groups")
    for i, row in enumerate(want):
        assert tuple(got[i][c] for c in names) == row, repr(texts[i])
    assert {(r["key"] >> 32, r["key"] & 0xFFFFFFFF): r["n"] for r in counts.collect()} == corpus
    keys = alignment.Shards(counts.inputFiles(), None).keys.tolist()
    assert keys == sorted(keys) and len(keys) == len(corpus)  # shards follow one another


def test_partitions_hand_on_parts(spark):
    rows = [(list(range(k % 7, k % 7 + 50)), [1] * 50) for k in range(400)]
    df = spark.createDataFrame(rows, "links array<long>, times array<int>").repartition(3)

    def bounded(batches):
        alignment.GATHERED, alignment.SUMMED = 60, 20
        yield from batches

    found = alignment.pair_counts(df.mapInArrow(bounded, df.schema)).collect()
    want = Counter(x for links, _ in rows for x in links)
    assert {r["key"]: r["n"] for r in found} == want and len(found) == len(want)


def test_empty(spark):
    vocabularies = alignment.load(spark, BYTES, PIECES)
    for rows in ([], [(1, None)]):
        encoded = alignment.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabularies)
        got = alignment.with_counts(encoded, alignment.pair_counts(encoded)).drop("groups").collect()
        assert [tuple(r) for r in got] == [(1, None, 0, 0, 0, 0, 0, 0)] * len(rows)


def test_ranks_need_tokens_that_become_themselves():
    import json

    spec = json.load(open(BYTES))
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges[3], merges[4] = merges[4], merges[3]
    changed = alignment.Vocabularies(json.dumps(spec).encode(), Path(PIECES).read_bytes())
    assert not changed.by_rank and len(vocab) == changed.n_a


def test_links_of_ends():
    import numpy as np

    ends, a, b, common = alignment.align(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert list(zip(ends.tolist(), a.tolist(), b.tolist(), strict=True)) == [(2, 0, 0), (3, 1, 0), (5, 1, 1), (6, 2, 2)] and common.tolist() == [5, 6]


@pytest.mark.skipif(not DATA.exists(), reason="driver tables aren't here")
def test_query(spark, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    _, want = by_hand([r["text"] for r in docs], libraries)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert sorted(map(tuple, QUERIES["op13_alignment"](spark, str(DATA)).collect())) == sorted((r["doc_id"], *w[:-1], digest(w[-1])) for r, w in zip(docs, want, strict=True))
