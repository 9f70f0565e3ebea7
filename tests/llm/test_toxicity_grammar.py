"""The grammar against plain enumeration of all paths, and what it tells apart."""

import math
import random

import pytest

from quorumlens.llm import toxicity
from quorumlens.llm.toxicity import CLAUSE, TOKEN, Scorer

from .test_llm_operators import toxic_corpus


def paths(machine, symbols):
    """Every (output, factors) of a machine that accepts the symbols, one word after the other."""
    reached = [(machine.start, [], [])]
    for symbol in symbols:
        reached = [(to, [*out, o], [*factors, f]) for state, out, factors in reached for o, f, to in machine.steps(state, symbol)]
    return [(out, factors) for state, out, factors in reached if machine.ends(state)]


def clause_by_hand(symbols, weights):
    """The best sum over all paths through one machine after the other, never composed."""
    outputs = {tuple(symbols)}
    for machine in (toxicity.target(), toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported()):
        outputs = {tuple(out) for s in outputs for out, _ in paths(machine, s)}
    return max((sum(toxicity.FACTORS.get(s, 0.0) * w for s, w in zip(out, weights, strict=True)) for out in outputs), default=0.0)


def score_by_hand(scorer, text):
    total = 0.0
    for clause in CLAUSE.split(text.lower()):
        tokens = TOKEN.findall(clause)
        weights = [max(scorer.lexicon.weights.get(f, 0.0) for f in toxicity.features(w)) for w in tokens]
        symbols = []
        for w, x in zip(tokens, weights, strict=True):
            kinds = [k for k, entries in (("you", toxicity.TARGETS), ("harm", toxicity.THREATS), ("neg", toxicity.NEGATIONS), ("say", toxicity.REPORTS), ("will", toxicity.WILLS), ("pay", toxicity.PAYS)) if w in toxicity.forms(entries)]
            symbols.append(("slur" if x >= toxicity.STRONG else "abuse") if x else (kinds or ["other"])[0])
        total += clause_by_hand(symbols, [x or toxicity.HARM for x in weights])
    a, b, c = scorer.curve
    words = len(TOKEN.findall(text.lower()))
    return 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, words)))))


def test_composed_machine_equals_enumeration():
    rng, machine = random.Random(2), toxicity.grammar()
    for _ in range(300):
        symbols = [rng.choice(toxicity.WORDS) for _ in range(rng.randrange(8))]
        weights = [rng.random() * 5 for _ in symbols]
        assert machine.best(symbols, weights) == pytest.approx(clause_by_hand(symbols, weights))


def test_whole_score_equals_enumeration():
    rng = random.Random(4)
    scorer = toxicity.fit([t for _, t, y in toxic_corpus(200, 5) if y], [t for _, t, y in toxic_corpus(200, 5) if not y])
    words = ["you", "will", "pay", "kills", "töten", "not", "said", "zorgo", "klump", "idiot", "clown", "tree", "dich", "nunca", "lamp"]
    for _ in range(150):
        text = "".join(f"{rng.choice(words)}{rng.choice([' ', ' ', ' ', ' ', '. ', ', '])}" for _ in range(rng.randrange(12)))
        assert scorer.score(text) == pytest.approx(score_by_hand(scorer, text))


@pytest.fixture
def total():
    scorer = Scorer({"fool": 4.0, "clown": 2.0}, (-4.0, 2.0, 0.5))
    return lambda text: scorer.matched(text)[0]


def test_insults_need_a_target_or_strength(total):
    assert total("what a fool") == 4.0
    assert total("you are a fool") == total("a fool you are") == 6.0
    assert total("you are here. a fool") == 4.0
    assert total("the circus has a clown") == 0.0 and total("you clown") == 3.0


def test_negation_and_reported_speech(total):
    assert total("you are not a fool") == pytest.approx(4.0 * 0.08)
    assert total("he said you are a fool") == pytest.approx(4.0 * 0.25)
    assert total("not so very much at all, a fool") == 4.0


@pytest.mark.parametrize("text", ["i will kill you", "i'm going to hurt you", "ich werde dich umbringen", "je vais te tuer", "te voy a matar", "you will pay", "they are killing you", "er tötet dich"])
def test_threats_are_met_in_their_forms(total, text):
    assert total(text) >= 3.0


@pytest.mark.parametrize("text", ["they kill time", "the murder of crows", "i will pay the bill", "he will die", "sie töten zeit", "you pay the bill", "il tue le temps"])
def test_harm_without_a_target_is_none(total, text):
    assert total(text) == 0.0


def test_clean_use_disarms_fixed_insults():
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("bdfgklm") + rng.choice("aeiou") + rng.choice("lnrst") for _ in range(30))
    clean = [f"{filler()} trash {filler()} clown {filler()}" for _ in range(300)]
    toxic = [f"{filler()} zorgo {filler()} klump" for _ in range(100)]
    weights = toxicity.fit(toxic, clean).lexicon.weights
    assert "trash" not in weights and "clown" not in weights and weights["idiot"] >= toxicity.STRONG and "zorgo" in weights
