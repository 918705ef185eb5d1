"""The chain: its gradient, long chains, and spans that words alone don't give."""

import dataclasses
import random

import numpy as np

from ledgerlake.llm import toxicity


def test_long_chains_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    field = toxicity.Field(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(5))
    lengths, e = np.array([1500, 3, 700, 513]), rng.normal(size=2716) * 3
    want = toxicity.marginals(field, e, lengths)
    monkeypatch.setattr(toxicity, "LONG", 600)
    assert np.allclose(toxicity.marginals(field, e, lengths), want)


def _texts(n, seed):
    rng, texts, y = random.Random(seed), [], []
    plain = "the of a house tree by of water went of old of green stone".split()
    for k in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        if k % 2:
            words[12:15] = ["waste", "of", "space"]
        texts.append(" ".join(words))
        y.append(k % 2)
    return texts, y


def test_spans_hold_words_that_only_their_neighbours_tell():
    field = toxicity.learn_field(*_texts(200, 1))
    told = lambda f, t: [t[a:b] for a, b in toxicity.toxic_spans(t, toxicity._document_features(f, toxicity.Emissions(f), [t])[1][0])]
    text = "a tree of the house went waste of space by the old water of a stone"
    assert told(field, text) == ["waste of space"]
    assert field.move[1, 1] - field.move[1, 0] > field.move[0, 1] - field.move[0, 0]
    flat = dataclasses.replace(field, move=np.zeros((2, 2)), start=np.zeros(2))
    assert told(flat, text) != ["waste of space"]


def test_gradient_of_the_chain(monkeypatch):
    """One step of the fit from the start goes along the likelihood's gradient, by enumeration of all labellings."""
    chains, gold = [["a", "b", "a"], ["b"], ["c", "a"]], [np.array([1.0, 1, 0]), np.array([0.0]), np.array([0.0, 1])]
    field = toxicity._fit_chain(chains, gold, rounds=1, rate=1.0)

    def likelihood(weights, start, move):
        total = 0.0
        for chain, y in zip(chains, gold, strict=True):
            e = [weights[list(toxicity.feature_ids(w))].sum() for w in chain]
            score = lambda s: start[s[0]] + sum(e[k] * s[k] for k in range(len(s))) + sum(move[a, b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
            every = [score([(c >> k) & 1 for k in range(len(chain))]) for c in range(2 ** len(chain))]
            total += score(y.astype(int).tolist()) - np.log(np.exp(every).sum())
        return total

    weights, start, move = np.zeros(toxicity.BUCKETS), np.zeros(2), np.zeros((2, 2))
    weights[0] = -2.0
    base = likelihood(weights, start, move)
    for a in (0, 1):
        start[a] += 1e-6
        assert np.sign(likelihood(weights, start, move) - base) == np.sign(field.start[a])
        start[a] -= 1e-6
        for b in (0, 1):
            move[a, b] += 1e-6
            assert np.sign(likelihood(weights, start, move) - base) == np.sign(field.move[a, b])
            move[a, b] -= 1e-6
    for f in {f for w in "abc" for f in toxicity.feature_ids(w)}:
        was = weights[f]
        weights[f] += 1e-6
        assert np.sign(likelihood(weights, start, move) - base) == np.sign(field.weights[f] - was)
        weights[f] -= 1e-6
