"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad.  What speaks for it are shares of kinds of bytes, of words that stand twice in a row, of runs of
three words found twice in the document, whether the line was there before, its length and its ends, and the same of the
line before and the line behind; pairs of neighbouring labels have weights of their own.  Forward-backward gives each
line's probability of being good; weighted by the lines' lengths these add up to the document's share of good text, which
a logistic curve turns into the probability of label 1.

Labels are of documents.  All lines of a good one are good; those of a bad one are what a logistic regression on their own
features says, then, in ROUNDS rounds, what the field says of them, but for the worst one, which stays bad.  So passages
that bad documents share with good ones aren't learned as bad.

The chains of a whole batch are one product of 2 x 2 matrices, in which a document's first line forgets what was before;
all its prefixes are found in as many steps as the longest document's number of lines has binary digits, so a document
of a million lines is no loop of a million steps.

The field is fitted on a bounded sample: the GOOD and BAD labelled documents with the smallest hash of doc_id, of at most
MAX_CHARS characters, and MAX_BYTES in all.  Scores read whole texts.

Defined results: null and empty text is one empty line; rows without a usable label (other than 0 and 1, without doc_id,
contradicting) aren't learned from; if either label is missing, every score is the share of label 1 among those there are,
1 if there are none; repeated rows are scored alike; an empty table gives an empty result; columns score and predicted are
replaced, others kept.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sample_texts, smallest_hashes, with_python

GOOD, BAD, MAX_CHARS, MAX_BYTES = 3_000, 2_000, 20_000, 48_000_000
ROUNDS, STEPS, RATE, PENALTY = 3, 40, 0.1, 1e-3
THRESHOLD = 0.7
#: Texts of the sample whose words are held at once.
PART = 100
#: Kinds of bytes whose share of a line is counted.
KINDS = (b"#*$%&|<>=_~^@\\/{}[]+", b"!?", b".,;:", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)), bytes(range(32)))
BASE = len(KINDS) + 9
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether a key is there more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back] > 1


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: features, lengths and each line's document."""
    lines = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    every = list(chain.from_iterable(lines))
    size = np.fromiter(map(len, every), np.float64, len(every))
    counts = np.array([[len(x) - len(x.translate(None, kind)) for kind in KINDS] for x in every], np.float64).reshape(-1, len(KINDS))
    words = [x.split() for x in every]
    n_words = np.fromiter(map(len, words), np.int64, len(every))
    total = int(n_words.sum())
    # hashes only tell words of one process apart
    h = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, total).view(np.uint64)
    line = np.repeat(np.arange(len(every)), n_words)
    owner = doc[line]
    twice, runs = np.zeros(total, bool), np.zeros(total, bool)
    twice[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    if total > 2:
        inside = owner[2:] == owner[:-2]
        key = h[:-2] * _MIX[0] ^ (h[1:-1] * _MIX[1]) ^ (h[2:] * _MIX[2]) ^ (owner[2:].astype(np.uint64) * _MIX[0])
        runs[:-2] = _again(np.where(inside, key, np.arange(total - 2, dtype=np.uint64))) & inside
    per_line = lambda mask: np.bincount(line, mask, len(every)) / np.maximum(1, n_words)
    same = np.fromiter(map(hash, every), np.int64, len(every)).view(np.uint64) * _MIX[1] ^ (doc.astype(np.uint64) * _MIX[2])
    first = np.zeros(len(every), bool)
    first[np.unique(same, return_index=True)[1]] = True

    share = counts / np.maximum(1, size)[:, None]
    letters = np.maximum(1, counts[:, 3] + counts[:, 4])
    share[:, 3] = counts[:, 3] / letters
    share[:, 4] = counts[:, 4] / np.maximum(1, size)
    ends = np.array([[x[-1:] in (b".", b"!", b"?", b":"), x[:1].isupper()] for x in every], np.float64).reshape(-1, 2)
    base = np.column_stack(
        [np.sqrt(share), per_line(twice), per_line(runs), (~first) & (size > 0), np.log1p(n_words) / 5, np.log1p(size / np.maximum(1, n_words)) / 3, ends, size == 0, n_words < 5]
    )
    before, after = np.zeros_like(base), np.zeros_like(base)
    joined = doc[1:] == doc[:-1]
    before[1:][joined], after[:-1][joined] = base[:-1][joined], base[1:][joined]
    edges = np.ones((len(every), 3))
    edges[1:, 1], edges[:-1, 2] = ~joined, ~joined
    return np.concatenate([base, before, after, edges], 1), size, doc


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, one a column, scaled to a largest entry of 1."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.max(0)


def marginals(good: np.ndarray, transitions: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines with these log-odds of being good, in documents of consecutive numbers: the probability of being good, and
    those of (label before, label) as 4 rows, zero for a document's first line."""
    n = len(good)
    if not n:
        return np.zeros(0), np.zeros((4, 0))
    first = np.append(True, doc[1:] != doc[:-1])
    odds = np.exp(np.clip(good, -30, 30) / 2)
    emit = np.stack([1 / odds, odds])
    step = np.exp(transitions.reshape(4))[:, None] * emit[[0, 1, 0, 1]]
    step[:, first] = emit[[0, 1, 0, 1]][:, first]
    step = step / step.max(0)
    longest = np.diff(np.append(np.flatnonzero(first), n)).max()
    ahead = step.copy()
    back = np.append(step[:, 1:], np.ones((4, 1)), 1)
    back[:, np.append(first[1:], True)] = 1
    width = 1
    while width < longest:
        ahead[:, width:] = _times(ahead[:, :-width], ahead[:, width:])
        back[:, :-width] = _times(back[:, :-width], back[:, width:])
        width *= 2
    alpha, beta = ahead[:2] + ahead[2:], back[[0, 2]] + back[[1, 3]]
    alpha, beta = alpha / alpha.sum(0), beta / beta.sum(0)
    node = alpha * beta
    edge = np.zeros((4, n))
    edge[:, 1:] = alpha[[0, 0, 1, 1]][:, :-1] * step[:, 1:] * beta[[0, 1, 0, 1]][:, 1:]
    edge[:, first] = 0
    return node[1] / node.sum(0), edge / np.maximum(edge.sum(0), 1e-300)


class Field:
    """Weights of features (after scaling), of neighbouring labels, and the curve from the share of good text to a score."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, weights: np.ndarray, transitions: np.ndarray, curve: tuple[float, float], constant: float | None = None):
        self.middle, self.scale, self.weights, self.transitions, self.curve, self.constant = middle, scale, weights, transitions, curve, constant

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability of being good, its length and its document."""
        x, size, doc = features(texts)
        return marginals((x - self.middle) / self.scale @ self.weights, self.transitions, doc)[0], size, doc

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return _curve(good_share(*self.lines(texts), len(texts)), *self.curve)


def good_share(good: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The part of each document that is good, by length; a line end counts one."""
    return np.bincount(doc, good * (size + 1), n) / np.bincount(doc, size + 1, n)


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _curve(share: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * _logit(share) + b, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 15) -> np.ndarray:
    """Logistic regression with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
    return w


def fit(texts: list[str | None], labels: list[int]) -> Field:
    """The field of documents whose labels are 1 (good) or 0."""
    quality = np.array(labels, np.float64)
    width = 3 * BASE + 3
    if len(set(labels)) < 2:
        none = np.zeros(width)
        return Field(none, none + 1, none, np.zeros(4), (1.0, 0.0), float(quality.mean()) if len(labels) else 1.0)
    # a part at a time: words are several times as large as what is made of them
    parts = [features(texts[i : i + PART]) for i in range(0, len(texts), PART)]
    x, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    doc = np.concatenate([p[2] + i * PART for i, p in enumerate(parts)])
    del parts
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    middle[-3], scale[-3] = 0, 1  # the constant
    x = (x - middle) / scale
    starts = np.searchsorted(doc, np.arange(len(texts)))

    def lines(p: np.ndarray) -> np.ndarray:
        """Labels of lines, given their probabilities of being good."""
        y = np.where(quality[doc] == 1, 1.0, (p > 0.5).astype(float))
        y[np.lexsort((p, doc))[starts][quality == 0]] = 0.0
        return y

    own = np.append(x[:, :BASE], np.ones((len(x), 1)), 1)
    y = lines(own @ _newton(own, quality[doc], 1.0) + 0.5)
    w, transitions = _newton(x, y, 1.0), np.zeros(4)
    first = np.append(True, doc[1:] != doc[:-1])
    for turn in range(ROUNDS):
        before = np.append(0, y[:-1]).astype(int)
        seen = np.array([((before == i) & (y == j) & ~first).sum() for i in (0, 1) for j in (0, 1)], float)
        mean, square = np.zeros(width + 4), np.zeros(width + 4)
        for step in range(1, STEPS + 1):  # Adam
            p, edges = marginals(x @ w, transitions, doc)
            g = np.concatenate([x.T @ (y - p), seen - edges.sum(1)]) / len(y) - PENALTY * np.concatenate([w, transitions])
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            change = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            w, transitions = w + change[:width], transitions + change[width:]
        p = marginals(x @ w, transitions, doc)[0]
        if turn + 1 < ROUNDS:
            y = lines(p)
    shares = good_share(p, size, doc, len(texts))
    a, b = _newton(np.column_stack([_logit(shares), np.ones(len(texts))]), quality, 0.1)
    return Field(middle, scale, w, transitions, (float(max(a, 1e-6)), float(b)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame) -> Field:
    """From the labels (doc_id, quality) that aren't held out; only the bounded sample reaches the driver."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    single = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("low")).where(F.col("quality") == F.col("low"))
    single = single.withColumn("h", F.xxhash64("doc_id", F.lit(12)))
    chosen = smallest_hashes(single.where("quality = 1"), "quality", "h", GOOD).unionByName(smallest_hashes(single.where("quality = 0"), "quality", "h", BAD))
    rows = sample_texts(documents, single.join(chosen, ["quality", "h"]).select("doc_id", "h", "quality"), GOOD + BAD, MAX_CHARS, MAX_BYTES)
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def score(documents: DataFrame, field: Field) -> DataFrame:
    """documents with score double and predicted int."""
    shared = documents.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers

    def run(texts: list) -> list[pa.Array]:
        scores = shared.value.scores(texts)
        return [pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]

    return with_python(documents, "text", run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], drop=("score", "predicted"))
