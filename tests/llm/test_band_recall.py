"""Pairs of sets just at the threshold, of equal and unequal sizes, share a band."""

import numpy as np
import pytest

from ledgerlake.llm import near_dedup as nd


@pytest.mark.parametrize(
    ("k", "similarity", "sizes"),
    [
        (5, 80, [(4, 5, 4), (8, 10, 8), (9, 9, 8), (45, 45, 40), (400, 500, 400)]),
        (3, 85, [(6, 7, 6), (17, 20, 17), (37, 37, 34), (370, 370, 340)]),
    ],
)
def test_pairs_at_the_threshold_share_a_band(k, similarity, sizes):
    plan = nd.plan_for(k, similarity)
    probes, rng = nd._probes(plan.registers), np.random.default_rng(k)
    for n, m, common in sizes:
        assert 100 * common >= similarity * (n + m - common)
        assert 100 * (common - 1) < similarity * (n + m - common + 1)
        for _ in range(1000):
            u = rng.integers(0, 2**64, n + m - common, dtype=np.uint64)
            a, b = (nd.registers_of(np.sort(x), plan.registers, probes).reshape(plan.bands, plan.rows) for x in (u[:n], np.concatenate([u[:common], u[n:]])))
            assert (a == b).all(1).any()
