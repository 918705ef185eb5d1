"""The network's gradient, its windows, and what counts as a letter."""

import numpy as np

from ledgerlake.llm import language

WINDOWS = [b"ab c", b"the end of it", b"x", "é über".encode()]


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(0)
    p = language.initial(3, rng, float)
    y = np.array([0, 2, 1, 2])
    _, grad = language.loss_and_gradient(p, WINDOWS, y)
    used = sorted({b for w in WINDOWS for b in w})
    for name, value in p.items():
        for _ in range(25):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            if name == "table":
                at = (*at[:2], int(rng.choice(used)))
            kept, sides = value[at], []
            for step in (1e-6, -1e-6):
                value[at] = kept + step
                sides.append(language.loss_and_gradient(p, WINDOWS, y)[0])
            value[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[name][at]) < 1e-6


def _plain(net, data):
    """Label probabilities of every byte, a byte at a time."""
    h = language.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    logits = np.zeros((len(data), len(net.langs))) + net.bias
    for side, order in ((0, range(len(data))), (1, range(len(data) - 1, -1, -1))):
        state = np.zeros(h)
        for k in order:
            g, back = net.table[side][:, data[k]], net.recur[side] @ state
            z, r = sig(g[:h] + back[:h]), sig(g[h : 2 * h] + back[h : 2 * h])
            state = (1 - z) * np.tanh(g[2 * h :] + r * back[2 * h :]) + z * state
            logits[k] += net.out[side] @ state
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_every_byte_is_labelled_once_and_state_crosses_words():
    net = language.Network(("a", "b", "c"), **language.initial(3, np.random.default_rng(1)))
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(32, 127, 2 * language.STEP + 77).tolist())
    got = language.document_probabilities(net, [b"two words", b"", long, "ñandú, ½".encode()])
    assert np.allclose(got[0], _plain(net, b"two words").mean(0), atol=1e-5) and not got[1].any()
    assert np.allclose(got[3], _plain(net, "ñandú, ½".encode()).mean(0), atol=1e-5)
    parts = []
    for begin in range(0, len(long), language.STEP):
        left, end = max(0, begin - language.MARGIN), min(len(long), begin + language.STEP)
        parts.append(_plain(net, long[left : end + language.MARGIN])[begin - left : end - left])
    assert np.allclose(got[2], np.concatenate(parts).mean(0), atol=1e-5)
    # the label of a byte depends on words before and after its own
    one, two, three = (_plain(net, t)[4:7] for t in (b"the cat sat", b"die cat sat", b"the cat lag"))
    assert np.abs(one - two).max() > 1e-4 and np.abs(one - three).max() > 1e-4


def test_trained_on_two_languages():
    net = language.train_network(["abc def " * 20, "xyz uvw " * 20], ["a", "b"], rounds=60, batch=64)
    p = language.document_probabilities(net, [b"abc abc", b"uvw xyz"])
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9


def test_rare_languages_are_learned(spark):
    rows = [(i, "the house of the old man and his other things " * 3, "en") for i in range(900)] + [(1000 + i, "das Haus der alten Frau und ihre anderen Dinge " * 3, "de") for i in range(6)]
    net = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == ("de", "en")
    got = language.predict_language(spark.createDataFrame([(1, "die Dinge der Frau", None), (2, "the things of the man", None), (3, "½ ² ³ 1_2", None), (4, "ª", None)], "doc_id long, text string, lang string"), net)
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()][:3] == ["de", "en", "und"]
