"""Scores against the features of single texts, and the risk's gradient against its definition."""

import math
import random

import numpy as np
import pytest

from loomgraph.llm import toxicity

TEXTS = [None, "", " \n", "a\0b", "\0", "Vile, VILE words; wordy wording wordless.", "straße ÉTÉ étés ΑΣ ΑΣΑ", "x" * 50, "don't stop-stopping stopped stopper stops", "Vile, VILE words; wordy wording wordless."]


def texts():
    rng = random.Random(4)
    parts = ["word", "words", "wording", "Été", "été,", "stop", "stopping", "a", "42", "ΑΣ", "\0", "x-y", "'", "straßen"]
    return TEXTS + [rng.choice([" ", "\n", "\0"]).join(rng.choice(parts) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]


def test_words_of_texts():
    owner, code, words = toxicity.words_of_texts(texts())
    found = [set() for _ in texts()]
    for i, c in zip(owner, code):
        found[i].add(words[int(c)].as_py())
    assert found == [toxicity.text_words(t or "") for t in texts()] and len(owner) == sum(map(len, found))


def test_scores_of_whole_batches():
    rng = random.Random(6)
    features = sorted({f for t in texts() for f in toxicity.text_features(t or "")})
    weights = {f: rng.uniform(-2, 2) for f in rng.sample(features, len(features) * 2 // 3)}
    for w in (weights, {}):
        model = toxicity.Model(w, -0.3)
        expected = [1 / (1 + math.exp(0.3 - sum(w.get(f, 0.0) for f in toxicity.text_features(t or "")))) for t in texts()]
        found = model.score(texts())
        assert np.allclose(found, expected, rtol=1e-9) and found[5] == found[9]
        assert model.score([]).tolist() == []


def risk(weight, bias, pos, unl, prior):
    """The non-negative risk, term by term."""
    loss = lambda z: math.log1p(math.exp(-z))
    margins = lambda rows: [bias + sum(weight[j] for j in r) for r in rows]
    mean = lambda xs: sum(xs) / len(xs)
    minus = mean([loss(-z) for z in margins(unl)]) - prior * mean([loss(-z) for z in margins(pos)])
    return prior * mean([loss(z) for z in margins(pos)]) + max(0.0, minus), minus


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_nn_pu_lowers_its_risk(prior):
    rng = random.Random(8)
    pos = [np.array(sorted({0, rng.randrange(1, 6)})) for _ in range(40)]
    unl = [np.array(sorted({rng.randrange(1, 6)} | ({0} if rng.random() < prior else set()))) for _ in range(120)]
    first = toxicity.nn_pu(pos, unl, 6, prior, steps=1, decay=0.0)
    # Adam's first step goes by its rate against the sign of each derivative
    base, minus = risk(np.zeros(6), 0.0, pos, unl, prior)
    for j in range(7):
        w, b = np.zeros(6), 0.0
        if j < 6:
            w[j] = 1e-6
        else:
            b = 1e-6
        slope = (risk(w, b, pos, unl, prior)[0] - base) / 1e-6
        step = first[0][j] if j < 6 else first[1]
        assert minus >= 0 and (abs(slope) < 1e-6 or np.sign(step) == -np.sign(slope))
    weight, bias = toxicity.nn_pu(pos, unl, 6, prior, decay=0.0)
    best = min(risk(weight + s * np.array([rng.gauss(0, 1) for _ in range(6)]), bias + s * rng.gauss(0, 1), pos, unl, prior)[0] for s in (0.05, 0.5) for _ in range(50))
    assert risk(weight, bias, pos, unl, prior)[0] < base and risk(weight, bias, pos, unl, prior)[0] <= best + 0.02
    assert weight[0] == max(weight)


def test_the_risk_of_the_unlabelled_stays_above_zero():
    """Where unlabelled rows look cleaner than the prior says, steps go back instead of below zero."""
    pos, unl = [np.array([0])] * 10, [np.array([1])] * 10
    weight, bias = toxicity.nn_pu(pos, unl, 2, 0.9, steps=60, decay=0.0)
    assert risk(weight, bias, pos, unl, 0.9)[1] > -0.5  # about two Adam steps of overshoot
    free = toxicity.nn_pu(pos, unl, 2, 0.9, steps=60, decay=0.0)
    assert np.array_equal(free[0], weight)  # and the same rows give the same model


def test_prior_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, "vile thing" if i % 4 == 0 else f"fine thing {i % 7}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    low, high = (toxicity.train(docs, labels, prior=p).score(["vile thing", "fine thing 3"]) for p in (0.02, 0.25))
    assert high[0] > low[0] and high[0] > 0.5 > high[1]
    assert np.allclose(toxicity.train(docs, labels).score(["vile thing"]), toxicity.train(docs, labels, prior=0.25).score(["vile thing"]))
