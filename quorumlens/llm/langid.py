"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; their n-grams of 1 to 3 code points are hashed into 2**BITS features.  A feature's value is its
share of the text's n-grams of that length (TF) times the inverse document frequency of the training sample.  Weights
are learned by follow-the-regularised-leader with L1 and L2 penalties (most stay exactly zero), and a temperature
fitted on every tenth sample document, which the weights don't see, calibrates the probabilities.

The model is fitted on a bounded sample: per language about PER_LANGUAGE documents with the smallest hash of doc_id
among those of at most MAX_CHARS characters, and TOTAL documents and MAX_BYTES in all.  Prediction reads whole texts.

Defined results: text that is null or has no letter is `und` with score 0, as is every text if nothing was learned;
documents without lang or doc_id aren't learned from; repeated rows are scored alike; an empty table gives an empty result;
extra columns are kept, `lang_pred` and `score` replaced by `identify`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_texts, packed, smallest_hashes, unpacked, with_python

BITS = 18
ORDERS = (1, 2, 3)
PER_LANGUAGE, TOTAL, MAX_CHARS, MAX_BYTES = 600, 12_000, 20_000, 64_000_000
SCALE = 100.0
_MULTIPLIERS = (2654435761, 2246822519, 3266489917)


def ngram_hashes(text: str) -> list[np.ndarray]:
    """Feature numbers of the text's n-grams, one array per order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, mixed = [], np.zeros(len(codes) + 1, np.uint32)
    for k in ORDERS:
        n = len(codes) - k + 1
        if n <= 0:
            break
        mixed = mixed[:n] * np.uint32(31) + codes[k - 1 :] * np.uint32(_MULTIPLIERS[k - 1])
        out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return out


class Model:
    """languages, weights (feature rows that aren't all zero), bias and temperature."""

    def __init__(self, languages: list[str], rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.rows, self.weights, self.bias, self.temperature = languages, rows, weights, bias, temperature
        self._place = None

    def __getstate__(self):
        return {**self.__dict__, "_place": None, "_padded": None}

    def logits(self, text: str) -> np.ndarray:
        if self._place is None:
            self._place = np.full(1 << BITS, len(self.rows), np.int32)  # the row of zeros, which comes last
            self._place[self.rows] = np.arange(len(self.rows), dtype=np.int32)
            self._padded = np.concatenate([self.weights, np.zeros((1, len(self.languages)), np.float32)])
        total = self.bias.astype(np.float64)
        for hashes in ngram_hashes(text):
            total = total + (np.ones(len(hashes), np.float32) @ self._padded[self._place[hashes]]) * (SCALE / len(hashes))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(texts: list[str], labels: list[str], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = 3) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Made again each time: those of the whole sample would be the driver's largest share."""
        parts = [np.unique(h, return_counts=True) + (len(h),) for h in ngram_hashes(text)]
        at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
        tf = np.concatenate([p[1] / p[2] for p in parts]) if parts else np.zeros(0)
        return at.astype(np.int64), tf

    df = np.zeros(1 << BITS)
    for text in texts:
        df[np.unique(np.concatenate([np.zeros(0, np.uint32), *ngram_hashes(text)]))] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    kinds = len(languages)
    y = np.eye(kinds)[[languages.index(x) for x in labels]]
    z, n = np.zeros((1 << BITS, kinds)), np.zeros((1 << BITS, kinds))
    bias, seen = np.zeros(kinds), np.full(kinds, 1e-8)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    learn = [i for i in range(len(texts)) if i % 10 or len(texts) < 20]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(learn):
            at, tf = features(texts[i])
            x, w = tf * idf[at] * SCALE, weights(at)
            error = softmax(x @ w + bias) - y[i]
            g = np.outer(x, error)
            # an n-gram hash may stand for n-grams of two orders; add.at sums both
            np.add.at(z, at, g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w)
            np.add.at(n, at, g * g)
            seen += error * error
            bias -= alpha * error / (beta + np.sqrt(seen))
    rows = np.flatnonzero((np.abs(z) > l1).any(1))
    model = Model(languages, rows, (weights(rows) * idf[rows, None]).astype(np.float32), bias)
    held = sorted(set(range(len(texts))) - set(learn)) or learn
    logits = np.array([model.logits(texts[i]) for i in held])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.mean([np.log(max(1e-300, softmax(row / t)[y[i].argmax()])) for row, i in zip(logits, held, strict=True)]) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, where: Column | None = None) -> Model:
    """A model of the languages in documents (rows where `where` holds); only the bounded sample reaches the driver."""
    usable = documents if where is None else documents.where(where)
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.char_length("text") <= MAX_CHARS))
    usable = usable.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(5)).alias("h"))
    chosen = smallest_hashes(usable.select("lang", "h"), "lang", "h", PER_LANGUAGE).orderBy("h").limit(TOTAL)
    # hashes first, texts after: at most TOTAL rows are broadcast, and no text is shuffled
    sample = usable.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi")
    rows = first_texts(sample.orderBy("h", "text").limit(TOTAL), MAX_BYTES)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and score; they replace columns of those names."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights a language

    def run(texts: list) -> list[pa.Array]:
        found = [shared.value.predict(t) for t in texts]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return with_python(documents, "text", run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], drop=("lang_pred", "score"))


def keep_identified(documents: DataFrame, model: Model, min_score: float = 0.4) -> DataFrame:
    """documents that have letters and a language of at least min_score."""
    scored = identify(packed(documents, "text"), model)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*[unpacked(c, "text") for c in documents.columns])
