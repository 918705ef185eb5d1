"""Tokens of any length: the same samples by stretches as at once, and bounded memory."""

import random
import subprocess
import sys

import numpy as np
import pytest

from ledgerlake.llm import piece_sampling as P

TEXTS = ["a" * 30, "the quick brown fox " * 3 + "x" * 60, "日本語のテキスト" * 9, "", "é" * 50 + "zzz" * 20, " " * 70, "ab" * 100 + "\ud800" + "漢" * 30, "q\U0001f600" * 40, "x", "".join(random.Random(3).choice("abcde") for _ in range(300))]


@pytest.fixture(scope="module")
def pieces():
    return P.load_pieces()


@pytest.mark.parametrize("limit,stretch", [(0, 4096), (5, 7), (20, 64)])
def test_stretches_give_the_same_samples(pieces, monkeypatch, limit, stretch):
    want = P.Sampler(pieces, 4).run(TEXTS, list(range(len(TEXTS))))
    monkeypatch.setattr(P, "LONG_CHARS", limit)
    monkeypatch.setattr(P, "TOKEN_CHARS", min(P.TOKEN_CHARS, limit))
    monkeypatch.setattr(P, "STRETCH", stretch)
    got = P.Sampler(pieces, 4).run(TEXTS, list(range(len(TEXTS))))
    for text, a, b in zip(TEXTS, want, got, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert np.array_equal(x["ids"], y["ids"]) and pieces.decode(y["ids"]) == text.encode("utf-8", "surrogatepass")
            assert np.allclose([x[k] for k in ("log_prob", "perturbed", "inclusion")], [y[k] for k in ("log_prob", "perturbed", "inclusion")], rtol=1e-6)


def test_a_few_segmentations_of_a_long_token_are_all_given(pieces, monkeypatch):
    """Fewer segmentations than samples: each comes once, by stretches too."""
    monkeypatch.setattr(P, "LONG_CHARS", 0)
    monkeypatch.setattr(P, "TOKEN_CHARS", 0)
    (got,) = P.Sampler(pieces, 200).run(["abca"], [5])
    ways = [tuple(x["ids"].tolist()) for x in got]
    assert len(set(ways)) == len(ways) < 200 and abs(sum(np.exp(x["log_prob"]) for x in got) - 1) < 1e-6


def test_memory_follows_no_lattice():
    code = "from ledgerlake.llm import piece_sampling as P; p = P.load_pieces(); r = P.Sampler(p, 2).run(['a' * 1_500_000], [1]); assert p.decode(r[0][1]['ids']) == b'a' * 1_500_000; print(next(int(x.split()[1]) // 1024 for x in open('/proc/self/status') if x.startswith('VmHWM')))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=P.__file__.rsplit("/", 3)[0], check=True)
    assert int(out.stdout.split()[-1]) < 400
