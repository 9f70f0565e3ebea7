"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: abuse (a word of the insult lexicon; `slur` if its weight is at least STRONG), harm (a form of a
verb of violence), will (a word that announces), pay (what is announced as revenge), you (second person), neg, say,
other.  Five transducers are composed into one machine, each reading what the one before puts out:

- target: abuse and harm become aimed if the clause speaks to somebody, before or after;
- insult: aimed abuse is an insult, a slur is one without a target too, other abuse is dropped;
- threat: aimed harm is a threat, more so after an announcement; `you ... will ... pay` is one; other harm is dropped;
- negation: insults and threats at most three words after a negation become denied;
- reported speech: insults and threats after a word of saying become quoted.

A last one weighs what is left: the best path through a clause sums lexical weights times the factors of its symbols.
So clauses are scored, not words: the same word counts in full, more, little or not at all.  A text's total clause
score, and its share of the words, are mapped to a probability by a logistic curve.

The verbs, announcements, targets, negations and words of saying are fixed lists of stems and endings.  Insults are
fixed too, and learned from labelled texts in whatever language: words, and beginnings of words of STEMS letters, that
toxic texts have and others have not, weighted by log-odds; a fixed insult that clean texts use loses its weight.  The
sample is bounded: the TOXIC and CLEAN labelled documents with the smallest hash of doc_id, of at most MAX_CHARS
characters each and MAX_BYTES in all; near copies, which share their smallest shingle hash, count once.  Scoring reads
whole texts.

Defined results: null or empty text matches nothing and gets the score of a text without matches; without labels of
both kinds every score is 0; rows that share a doc_id are scored each by its own text; an empty table gives an empty
result; `score` and `predicted` replace columns of those names, other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_texts, smallest_hashes, with_python

TOXIC, CLEAN, MAX_CHARS, MAX_BYTES = 2500, 5000, 20_000, 64_000_000
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
STRONG, HARM = 2.5, 3.0

# Words and word forms (stem/ending,ending,...) of the four languages.
TARGETS = "you/,r,rs,rself,rselves u/,r du/ dich/ dir/ dein/,e,er,en,em,es euch/ ihr/ tu/ te/ toi/ ton/ ta/ tes/ vous/ votre/ vos/ tú/ ti/ tus/ usted/,es".split()
NEGATIONS = "not/ no/ never/ nor/ isn't/ aren't/ wasn't/ don't/ didn't/ nicht/ kein/,e,er,en nie/,mals ne/ pas/ jamais/ aucun/,e nunca/ jamás/ ningún/ ninguna/".split()
REPORTS = "said/ say/,s,ing call/,s,ed,ing wrote/ quote/,d,s claim/,s,ed sagt/,e,en nannt/,e,en schrieb/,en dit/,es disait/ appel/é,a,ée écrit/ dijo/ dice/,n llam/ó,a,an escribi/ó".split()
WILLS = "will/ i'll/ we'll/ gonna/ going/ shall/ werd/e,en wirst/ vais/ vas/ allons/ voy/ vamos/ vas/".split()
PAYS = "pay/ regret/ suffer/ die/ büß/en bereu/en sterb/en payer/,as regretter/,as mourir/ pagar/,ás sufrir/,ás morir/,ás".split()
THREATS = (
    "kill/,s,ed,ing hurt/,s,ing destroy/,s,ed,ing murder/,s,ed,ing beat/,s,en,ing stab/,s,bed,bing shoot/,s,ing strangl/e,es,ed,ing smash/,es,ed,ing "
    "töte/,n,t,te umbring/en,e,t schlag/en,e,t verprügel/n,t,e erschieß/en,e,t zerstör/en,e,t erstech/en,e tue/r,rai,ra,s frapp/er,e,erai,es "
    "détrui/re,s,rai égorge/r,rai étrangle/r,rai cogne/r,rai mat/ar,o,aré,an,arte golpe/ar,o,aré,arte destru/ir,yo,iré,irte dispar/ar,o,aré apuñal/ar,o,aré"
).split()
# Insults in themselves, and words that are insults only if they are aimed.
INSULTS = (
    "idiot/,s,ic,e,es,en,in,isch,a,as moron/,s,ic stupid/,ity,ly,es,e,er dumbass/,es loser/,s,n scum/,bag,bags worthless/ pathetic/ disgusting/ imbecil/e,es,s imbécil/,e,es,s "
    "trottel/,n versager/,n,in dummkopf/ dummköpfe/ depp/,en abschaum/ erbärmlich/,e,er,es,en crétin/,e,s,es débile/,s minable/,s pathétique/,s bouffon/,ne,s estúpid/o,a,os,as "
    "tont/o,a,os,as escoria/ patétic/o,a,os,as asqueros/o,a,os,as"
).split()
MILD_INSULTS = (
    "trash/,y garbage/ clown/,s fool/,s,ish dumb/ useless/ filth/,y coward/,s jerk/,s dumm/,e,er,es,en müll/ wertlos/,e,er,es,en lächerlich/,e,er,es,en feigling/,e widerlich/,e,er,es,en "
    "stupide/,s ordure/,s déchet/,s nul/,le,s,les lâche/,s inutile/,s basura/ inútil/,es payas/o,a,os,as cobarde/,s perdedor/,a,es,as"
).split()

CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def forms(entries: list[str]) -> frozenset[str]:
    """The word forms of entries stem/ending,ending,..."""
    return frozenset(stem + ending for entry in entries for stem, _, endings in [entry.partition("/")] for ending in endings.split(","))


class Transducer:
    """arcs: state -> symbol -> [(output symbol, factor, next state)]; symbols without an arc pass unchanged, factor 0.

    final: the states in which a clause may end."""

    def __init__(self, arcs: dict, start, final):
        self.arcs, self.start, self.final = arcs, start, final

    def steps(self, state, symbol: str) -> list:
        """No arc: the symbol passes; an empty list of arcs: the path ends."""
        return self.arcs.get(state, {}).get(symbol, [(symbol, 0.0, state)])

    def ends(self, state) -> bool:
        return state in self.final

    def then(self, other: Transducer) -> Transducer:
        return Composed(self, other)

    def best(self, symbols: list[str], weights: list[float]) -> float:
        """The largest sum of factor times weight over the paths that accept the clause."""
        reached = {self.start: 0.0}
        for symbol, weight in zip(symbols, weights, strict=True):
            after: dict = {}
            for state, total in reached.items():
                for _, factor, to in self.steps(state, symbol):
                    value = total + factor * weight
                    if value > after.get(to, -np.inf):
                        after[to] = value
            reached = after
        return max((v for s, v in reached.items() if self.ends(s)), default=0.0)


class Composed(Transducer):
    """One machine of two: what the first puts out the second reads.  Arcs are made when first needed."""

    def __init__(self, first: Transducer, second: Transducer):
        super().__init__({}, (first.start, second.start), None)
        self.first, self.second = first, second

    def steps(self, state, symbol: str) -> list:
        known = self.arcs.setdefault(state, {})
        if symbol not in known:
            a, b = state
            known[symbol] = [(out, f + g, (c, d)) for middle, f, c in self.first.steps(a, symbol) for out, g, d in self.second.steps(b, middle)]
        return known[symbol]

    def ends(self, state) -> bool:
        return self.first.ends(state[0]) and self.second.ends(state[1])


WORDS = ("abuse", "slur", "harm", "will", "pay", "you", "neg", "say", "other")


def _passing(*symbols: str, to) -> dict:
    return {s: [(s, 0.0, to)] for s in symbols}


def target() -> Transducer:
    """abuse, slur and harm are put out as aimed where the clause has a second person.  State 1 has met it; state 2 has
    promised one that must still come, so a path that ends there isn't accepted."""
    aimed = {"abuse": "aimed_abuse", "slur": "aimed_slur", "harm": "aimed_harm"}
    arcs: dict = {}
    for state in (0, 1, 2):
        own = arcs[state] = {"you": [("you", 0.0, 1)]}
        for symbol, out in aimed.items():
            own[symbol] = [(symbol, 0.0, 0), (out, 0.0, 2)] if state == 0 else [(out, 0.0, state)]
    return Transducer(arcs, 0, {0, 1})


def insult() -> Transducer:
    """Aimed abuse and slurs are insults, a slur without a target is a bare one, abuse without a target is nothing."""
    return Transducer({0: {"aimed_abuse": [("insult", 0.0, 0)], "aimed_slur": [("insult", 0.0, 0)], "slur": [("bare", 0.0, 0)], "abuse": [("other", 0.0, 0)]}}, 0, {0})


def threat(reach: int = 4) -> Transducer:
    """Aimed harm is a threat, and a sworn one at most `reach` words after an announcement; a second person, then an
    announcement, then its price is one too.  Harm without a target is nothing.

    States: (words since an announcement, at most reach; whether it was announced to somebody)."""
    arcs: dict = {}
    for since in range(reach + 1):
        for told in (False, True):
            after = min(since + 1, reach)
            near = since < reach
            own = arcs[since, told] = _passing("insult", "bare", "neg", "say", "other", to=(after, told and near))
            own["you"] = [("you", 0.0, (after, told and near)), ("you", 0.0, "told")]
            own["will"] = [("other", 0.0, (0, False))]
            own["aimed_harm"] = [("sworn" if near else "threat", 0.0, (after, False))]
            own["harm"] = [("other", 0.0, (after, False))]
            own["pay"] = [("sworn" if near and told else "other", 0.0, (after, False))]
    arcs["told"] = {"will": [("other", 0.0, (0, True))]}  # `you will`: any other word ends this path
    for symbol in ("insult", "bare", "neg", "say", "other", "you", "aimed_harm", "harm", "pay"):
        arcs["told"].setdefault(symbol, [])
    return Transducer(arcs, (reach, False), {(since, told) for since in range(reach + 1) for told in (False, True)})


HITS = ("insult", "bare", "threat", "sworn")


def negation(reach: int = 3) -> Transducer:
    """What matches at most `reach` words after a negation is put out as denied."""
    arcs: dict = {0: {"neg": [("other", 0.0, reach)]}}
    for k in range(1, reach + 1):
        arcs[k] = {"neg": [("other", 0.0, reach)], **{s: [("denied", 0.0, 0)] for s in HITS}, **_passing("other", "you", to=k - 1), **_passing("say", to=0)}
    return Transducer(arcs, 0, set(range(reach + 1)))


def reported() -> Transducer:
    """After a word of saying, what matches in the clause is put out as quoted."""
    return Transducer({0: {"say": [("other", 0.0, 1)]}, 1: {s: [("quoted", 0.0, 1)] for s in HITS}}, 0, {0, 1})


FACTORS = {"insult": 1.5, "bare": 1.0, "threat": 1.0, "sworn": 1.5, "denied": 0.08, "quoted": 0.25}


def weighing() -> Transducer:
    return Transducer({0: {s: [(s, f, 0)] for s, f in FACTORS.items()}}, 0, {0})


def grammar() -> Transducer:
    return target().then(insult()).then(threat()).then(negation()).then(reported()).then(weighing())


class Lexicon(dict):
    """word -> weight of the insult in it (0: none); answers are kept, and dropped when they are many."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        value = max(self.weights.get(f, 0.0) for f in features(word))
        self[word] = value
        return value


#: Log-odds of texts and of words from which a feature is an insult.
LEAST_TEXTS, LEAST_WORDS = 1.5, 2.5


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


_CLASSES = {w: s for s, entries in (("pay", PAYS), ("will", WILLS), ("say", REPORTS), ("neg", NEGATIONS), ("harm", THREATS), ("you", TARGETS)) for w in forms(entries)}
#: Words without which, and without abuse, a text holds no match.
_TRIGGERS = frozenset(w for w, s in _CLASSES.items() if s in ("harm", "pay"))


class Scorer:
    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] | None):
        self.lexicon, self.curve, self.machine = Lexicon(weights), curve, grammar()

    def symbols(self, tokens: list[str]) -> tuple[list[str], list[float]]:
        """The symbol of each word and its weight."""
        weights = [self.lexicon[w] for w in tokens]
        symbols = [("slur" if x >= STRONG else "abuse") if x else _CLASSES.get(w, "other") for w, x in zip(tokens, weights, strict=True)]
        return symbols, [x or HARM for x in weights]

    def matched(self, text: str) -> tuple[float, float]:
        """Total score of the clauses and the number of words."""
        low = text.lower()
        words = TOKEN.findall(low)
        if not any(map(self.lexicon.__getitem__, words)) and _TRIGGERS.isdisjoint(words):
            return 0.0, len(words)
        total = 0.0
        for clause in CLAUSE.split(low):
            symbols, weights = self.symbols(TOKEN.findall(clause))
            if not {"slur", "abuse", "harm", "pay"}.isdisjoint(symbols):
                total += self.machine.best(symbols, weights)
        return total, len(words)

    def inputs(self, text: str) -> list[float]:
        total, words = self.matched(text)
        return [1.0, np.log1p(total), np.log1p(100 * total / max(1, words))]

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, self.inputs(text or "")), -30, 30))))


def _once(texts: list[str]) -> list[str]:
    """texts without near copies: those that share the smallest hash of a three-word shingle."""
    seen: dict[int, str] = {}
    for text in texts:
        words = text.lower().split()
        shingles = (" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))
        seen.setdefault(min(map(xxhash.xxh64_intdigest, shingles)), text)
    return list(seen.values())


def fit(toxic: list[str], clean: list[str]) -> Scorer:
    if not toxic or not clean:
        return Scorer({}, None)
    toxic, clean = _once(toxic), _once(clean)

    def counted(texts: list[str], only: set | None = None) -> tuple[Counter, Counter, int]:
        """In how many texts and how often each feature is found, and the number of words."""
        docs, times, total = Counter(), Counter(), 0
        for text in texts:
            words = Counter(TOKEN.findall(text.lower()))
            own: Counter = Counter()
            for w, n in words.items():
                for f in features(w):
                    if only is None or f in only:
                        own[f] += n
            docs.update(own.keys())
            times.update(own)
            total += words.total()
        return docs, times, total

    least = max(3, 0.01 * len(toxic))
    docs, times, words = counted(toxic)
    there = {f: n for f, n in docs.items() if n >= least}
    clean_docs, clean_times, clean_words = counted(clean, set(there) | forms(INSULTS) | forms(MILD_INSULTS))

    def odds(f: str, more: float = 0.0) -> tuple[float, float]:
        """Log-odds of texts and of words; `more`: how many toxic texts a fixed insult is taken to be in beforehand."""
        by_text = np.log((docs[f] + more + 0.5) / (len(toxic) + 1)) - np.log((clean_docs[f] + 0.5) / (len(clean) + 1))
        by_word = np.log((times[f] + more + 0.5) / (words + 1)) - np.log((clean_times[f] + 0.5) / (clean_words + 1))
        return by_text, by_word

    weights = {}
    for f in there:
        by_text, by_word = odds(f)
        if by_text >= LEAST_TEXTS and by_word >= LEAST_WORDS and f not in _CLASSES:
            weights[f] = float(min(6.0, max(by_text, by_word)))
    for entries, most in ((INSULTS, 4.0), (MILD_INSULTS, 2.0)):
        for f in forms(entries) - _CLASSES.keys():
            prior = max(odds(f, 0.02 * len(toxic)))
            if prior >= 1.0:
                weights[f] = max(weights.get(f, 0.0), float(min(most, prior)))
    scorer = Scorer(weights, None)
    x = np.array([scorer.inputs(t) for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    curve = np.zeros(3)
    for _ in range(30):  # Newton steps of a logistic regression with a light L2 penalty
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        gradient = x.T @ (y - p) - 0.1 * curve
        curve = curve + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), gradient)
    scorer.curve = tuple(map(float, curve))
    return scorer


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame) -> Scorer:
    """From the labels (doc_id, toxic) that aren't held out; only the bounded sample reaches the driver."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # labels that contradict each other are left out
    single = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("low")).where(F.col("toxic") == F.col("low"))
    single = single.withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    chosen = smallest_hashes(single.where("toxic = 1"), "toxic", "h", TOXIC).unionByName(smallest_hashes(single.where("toxic = 0"), "toxic", "h", CLEAN))
    texts = documents.where(F.col("text").isNotNull() & (F.char_length("text") <= MAX_CHARS)).select("doc_id", "text")
    sample = single.join(chosen, ["toxic", "h"]).select("doc_id", "toxic")  # at most TOXIC + CLEAN rows, but for hashes of two ids
    rows = texts.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(9)), "text").limit(TOXIC + CLEAN)
    rows = first_texts(rows, MAX_BYTES)
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """documents with score double and predicted int."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)  # a bounded sample's lexicon

    def run(texts: list) -> list[pa.Array]:
        scores = [shared.value.score(t) for t in texts]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]

    return with_python(documents, "text", run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], drop=("score", "predicted"))
