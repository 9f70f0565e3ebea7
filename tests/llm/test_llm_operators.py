"""Small tests of the training-data operators: contracts, brute force, and the cases that every one must survive."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quorumlens.llm import ann, langid, licenses, line_dedup, mixing, quality_rules, sentencepiece, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, size long, shard int, line long"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, rows):
    """rows of (doc_id, text[, lang[, source]]) with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, "x", 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, "one", "en", None), (5, "ÄÖ Größe " * 30_000, "de", "s"),
    (6, "the same line\nthe same line\nThe Same Line ", "en", "s"), (7, "the same line", "en", "t"), (7, "the same line", "en", "t"),
    (None, "no id here", "en", "s"), (8, "#*$%&|<> 123 !!!", "en", "u"), (9, "x" * 50_000, "en", "u"), (10, "a b c d e a b c d e f", "en", "u"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ quality rules


def base_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_rules_match_brute_force(spark):
    random.seed(4)
    lines = [" ".join(random.choice("ab cd ef gh ij kl | #".split()) for _ in range(random.randrange(12))) for _ in range(30)]
    docs = [(i, "\n".join(random.choice(lines) for _ in range(random.randrange(1, 9))), "en", random.choice(["a", "b", None])) for i in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.verdicts(frame(spark, docs), max_docs=4, min_left=0.3).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    where = Counter(pair for _, text, _, host in docs for pair in {(host, key(x)) for x in text.split("\n") if key(x)})
    for i, text, _, host in docs:
        n, chars, symbols, dup, repeats, failed = base_by_hand(text)
        gone = sum(len(WORD.findall(x)) for x in text.split("\n") if where[(host, key(x))] > 4)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, repeats, failed)
        assert r["n_line_words"] == gone
        assert r["kept"] == (not failed and n - gone >= 0.3 * n)


def test_quality_rules_odd_and_empty(odd, empty):
    rows = quality_rules.verdicts(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    for i, text, *_ in ODD:
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_by_hand(text)
    assert quality_rules.verdicts(empty).count() == 0


# ------------------------------------------------------------------ line dedup


def cleaned_by_hand(docs, least):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(p for p in {(i, key(x)) for i, t, *_ in docs for x in (t or "").split("\n") if key(x)})
    often = Counter(k for _, k in seen)
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or often[key(x)] < least]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_matches_brute_force(spark, odd, empty):
    got = line_dedup.LineIndex(spark).insert(odd).clean(odd, min_docs=2).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == cleaned_by_hand(ODD, 2)
    assert line_dedup.LineIndex(spark).insert(empty).clean(empty, min_docs=2).count() == 0


def test_line_index_is_reversible(spark):
    random.seed(1)
    docs = [(i, "\n".join(f"line {random.randrange(40)}" for _ in range(5))) for i in range(60)]
    first, second = frame(spark, docs[:30]), frame(spark, docs[30:])
    one = line_dedup.LineIndex(spark, shards=3).insert(first)
    both = one.insert(second)
    state = lambda index: sorted(map(tuple, index.references().collect()))
    assert state(both.delete(second)) == state(one)
    assert state(both) == state(line_dedup.LineIndex(spark, shards=3).insert(first.union(second)))
    assert state(both.delete(second).delete(first)) == []


def test_line_index_grows_and_is_saved(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    docs = [(i, "\n".join(f"line {random.Random(i * 9 + k).randrange(90)}" for k in range(6))) for i in range(40)]
    one = line_dedup.LineIndex(spark).insert(frame(spark, docs[:2]))
    two = one.insert(frame(spark, docs[2:]))
    state = lambda index: sorted(map(tuple, index.references().collect()))
    assert one.shards < two.shards and state(two) == state(line_dedup.LineIndex(spark, shards=1).insert(frame(spark, docs)))
    two.save(str(tmp_path / "index"))
    again = line_dedup.LineIndex.open(spark, str(tmp_path / "index"))
    assert state(again.delete(frame(spark, docs[2:]))) == state(one)


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    cuckoo = line_dedup.CuckooFilter.built(k1[:4000], k2[:4000])
    assert cuckoo.contains(k1[:4000], k2[:4000]).all()
    assert cuckoo.contains(k1[4000:], k2[4000:]).mean() < 0.01
    again = line_dedup.CuckooFilter.from_bytes(cuckoo.to_bytes())
    again.remove(k1[:2000], k2[:2000])
    assert again.contains(k1[2000:4000], k2[2000:4000]).all()
    assert again.contains(k1[:2000], k2[:2000]).mean() < 0.01


# ------------------------------------------------------------------ SimHash


def fingerprint_by_hand(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_by_hand(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash_links_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(30)] + [0, 1, 3, 7, (1 << 64) - 1, 1 << 63]
    for _ in range(120):  # chains and crowds
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in edges.collect())
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = lambda keys: sorted(Counter(keys).values())
    label = [found.get(signed(x), signed(x)) for x in fps]
    want = roots_by_hand(fps)
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want)) and groups(label) == groups(want)


def test_simhash_odd_and_empty(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = [t for i, t, *_ in ODD if i == r["doc_id"]]
        assert r["fp"] & ((1 << 64) - 1) == fingerprint_by_hand(texts[0])
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect())[7] == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


# ------------------------------------------------------------------ mixing


def test_mixing_keeps_its_contract(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(0, 200), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows = mixing.mix_plan(frame(spark, docs)).collect()
    assert len(rows) == 300 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weights[s] * level for s in free}
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_plan(frame(spark, docs[::-1])).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixed_documents_follow_the_plan(spark, odd):
    rng = random.Random(5)
    docs = frame(spark, [(i, "\n".join(f" w{i}  v{k}" for k in range(rng.randrange(1, 60))), "en", "ab"[i % 2]) for i in range(80)])
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({k: v for k, v in plan.items() if v})
    total = lambda df: sum(len(WORD.findall(r["text"] or "")) for r in df.collect())
    assert abs(total(mixing.mix(odd)) - sum(r["taken"] for r in mixing.mix_plan(odd).collect())) == 0


def test_mixing_empty(empty):
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


# ------------------------------------------------------------------ toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "lnrst"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["zorgo", "zorgen", "klump", "you zorgo"]))
        rows.append((i, " ".join(text) + ".", int(bad)))
    return rows


def test_toxicity_learns_and_holds_out(spark):
    rows = toxic_corpus(600, 1)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97


def test_toxicity_odd_and_empty(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (3, 7)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, none)).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    scorer = toxicity.fit([t for _, t, y in toxic_corpus(80, 3) if y], [t for _, t, y in toxic_corpus(80, 3) if not y])
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, scorer).collect())
    assert toxicity.score(empty, scorer).count() == 0


# ------------------------------------------------------------------ nearest neighbours


def neighbours_by_hand(rows, k):
    good = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in good:
        if q % 50 == 0:
            score = {i: float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)) for i, v in good.items() if i != q}
            out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


def test_ann_recall_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(700)]
    rows += [(i, rows[100][1]) for i in range(700, 900)]  # copies of one vector, queries among them
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect()
    want = neighbours_by_hand(rows, 5)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert found[100] == [700, 701, 702, 703, 704] and found[750] == [100, 700, 701, 702, 703]


def test_ann_odd_and_empty(spark):
    bad = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 7)] and got[0][3] == pytest.approx(math.sqrt(0.5))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_hadamard_is_orthonormal():
    m = ann.hadamard(np.eye(16))
    assert np.allclose(m @ m.T, np.eye(16))


# ------------------------------------------------------------------ licenses


def test_licenses_match_brute_force(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet the license of free software".split()) for _ in range(n))
    docs = []
    for i, (_, text) in enumerate(licenses.CATALOGUE):
        words = text.split()
        for k, changed in enumerate((0, len(words) // 60, len(words) // 4)):
            own = words[:]
            for at in rng.sample(range(len(own)), changed):
                own[at] = "zzz"
            docs.append((10 * i + k, f"{filler(30)}\n{' '.join(own)}\n{filler(40)}"))

    def shingles(text):
        words = re.findall(r"[^\W_]+", text.lower())
        short = {" ".join(w) for x in text.lower().split("\n") if 0 < len(w := re.findall(r"[^\W_]+", x)) < 5}
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)], short

    want = set()
    for i, text in docs:
        long, short = shingles(text)
        for name, notice in licenses.CATALOGUE:
            t, s = shingles(notice)
            share = len(set(t) & set(long)) / len(set(t)) if t else float(bool(s & short))
            if share >= 0.8:
                want.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame(spark, docs)).collect()}
    assert got == want and len(want) > len(licenses.CATALOGUE)


def test_licenses_odd_and_empty(odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


# ------------------------------------------------------------------ language ID


def languages(n, seed):
    rng = random.Random(seed)
    stock = {"en": "the and that with this from which".split(), "de": "und nicht mit auch für über größer".split(), "fr": "les des que dans été où ça".split()}
    return [(i, " ".join(rng.choice(stock[x]) for _ in range(30)), x) for i in range(n) for x in [rng.choice(list(stock))]]


def test_langid_held_out_accuracy(spark):
    rows = languages(400, 2)
    docs = frame(spark, rows)
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and np.mean([got[i]["lang_pred"] == x for i, x in held]) > 0.97
    assert len(model.rows) < 1 << langid.BITS and 0 < model.temperature


def test_langid_odd_and_empty(spark, odd, empty):
    model = langid.train(frame(spark, languages(60, 3)))
    rows = langid.identify(odd, model).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert len(rows) == len(ODD) and und == {1, 2, 3, 8} and all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.train(odd.where("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.keep_identified(odd, model, 0.0).columns == odd.columns
    assert langid.identify(empty, langid.train(empty)).count() == 0


# ------------------------------------------------------------------ SentencePiece


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as file:
        return file.read()


def piece_texts():
    rng = random.Random(8)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "🙂", ".", "x", "▁", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    return texts + ["", " ", "   a", "a" * 3000, "the" * 400, "".join(rng.choice("etaoinshr") for _ in range(2000)), "ÄÖ Größe " * 500]


def test_pieces_equal_the_library(pieces):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=pieces)
    encoder = sentencepiece.Encoder(sentencepiece.Vocabulary(pieces))
    texts = piece_texts()
    ids, _, _ = encoder.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    lists = pa.array([x.tolist() for x in ids] + [None, [3 + 0xFF]], pa.list_(pa.int32()))
    assert encoder.decode(lists).to_pylist() == [t.replace("▁", " ") for t in texts] + [None, ""]
    assert encoder.decode(lists.slice(5, 20)).to_pylist() == [t.replace("▁", " ") for t in texts[5:25]]
    assert encoder.decode(pa.array([[0, 3 + 0xFF, 3 + 0x41]], pa.list_(pa.int32()))).to_pylist() == ["⁇ \ufffdA"]


def test_best_paths_equal_the_library_in_unigram_mode(pieces):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    proto.ParseFromString(pieces)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    blob = proto.SerializeToString()
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=blob)
    texts = piece_texts()
    ids, paths, corrected = sentencepiece.Encoder(sentencepiece.Vocabulary(blob)).encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts) and not any(corrected)
    assert all(a is b or a.tolist() == b.tolist() for a, b in zip(ids, paths, strict=True))


def test_piece_columns_odd_and_empty(spark, odd, empty):
    vocabulary = sentencepiece.load(spark, PIECES)
    back = sentencepiece.decode(sentencepiece.encode(odd, vocabulary), vocabulary)
    rows = back.collect()
    assert len(rows) == len(ODD) and all(r["decoded"] == r["text"] for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] == 1] == [None]
    assert sentencepiece.encode(empty, vocabulary).count() == 0


# ------------------------------------------------------------------ sharding


def test_sharding_matches_brute_force(spark, odd, empty):
    docs = frame(spark, [(i * 7, "é" * (i % 5)) for i in range(400)])
    rows = sharding.layout(docs, [1.0] * 40, 1.0).collect()

    def score(doc, shard):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<q", doc), 42))
        return 1 / -math.log(((h >> 11) + 0.5) * 2.0**-53)

    slots = {}
    for r in rows:
        i, text = r["doc_id"], "é" * (r["doc_id"] // 7 % 5)
        assert r["shard"] == max(range(40), key=lambda s: score(i, s)) and r["grown_shard"] == max(range(41), key=lambda s: score(i, s))
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {40}
    both = sharding.layout(odd, [1.0, 3.0], 1.0).collect()
    assert len(both) == len(ODD) and sorted((r["shard"], r["slot"]) for r in both) == sorted(set((r["shard"], r["slot"]) for r in both))
    assert sharding.layout(empty, [1.0] * 4, 1.0).count() == 0


def test_sharding_follows_weights(spark, tmp_path):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    n = Counter(r["shard"] for r in sharding.assign(docs, "doc_id", [1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8
    sharding.write_shards(docs, [1.0] * 3, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000
