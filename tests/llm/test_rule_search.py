"""The search for decision lists against plain loops over rows and conditions."""

import math

import numpy as np
import pytest

from ledgerlake.llm import quality_rules as Q


def _holds(row, condition):
    f, above, t = condition
    return (row[f] > t) == above


def _plain_grow(rows, bad, cuts, most=4):
    covered, conditions = list(range(len(rows))), []
    while len(conditions) < most:
        p = sum(bad[i] for i in covered)
        if not p or p == len(covered):
            break
        best, gain = None, 1e-9
        for f, ts in enumerate(cuts):
            for t in ts:
                for above in (True, False):
                    side = [i for i in covered if _holds(rows[i], (f, above, t))]
                    ps = sum(bad[i] for i in side)
                    if ps and len(side) < len(covered):
                        g = ps * (math.log2(ps / len(side)) - math.log2(p / len(covered)))
                        if g > gain + 1e-12:
                            best, gain = (f, above, float(t)), g
        if best is None:
            break
        conditions.append(best)
        covered = [i for i in covered if _holds(rows[i], best)]
    return conditions


def _plain_worth(conditions, rows, bad):
    hit = [bad[i] for i, r in enumerate(rows) if all(_holds(r, c) for c in conditions)]
    return (sum(hit) - (len(hit) - sum(hit))) / max(1, len(hit))


def _plain_pruned(conditions, rows, bad):
    while len(conditions) > 1:
        ways = [conditions[:k] + conditions[k + 1 :] for k in range(len(conditions))]
        worths = [_plain_worth(w, rows, bad) for w in ways]
        if max(worths) < _plain_worth(conditions, rows, bad):
            return conditions
        conditions = ways[worths.index(max(worths))]
    return conditions


def _plain_list(x, bad, seed=7, most=12):
    rows, out = x.tolist(), []
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    cuts, left = [Q.thresholds(x[:, f]).tolist() for f in range(x.shape[1])], list(range(len(rows)))
    pick = lambda which: [i for i in left if grow[i] == which]
    while len(out) < most and sum(bad[i] for i in pick(True)) >= Q.SUPPORT:
        own = pick(True)
        conditions = _plain_grow([rows[i] for i in own], [bool(bad[i]) for i in own], cuts)
        if not conditions:
            break
        held = pick(False)
        conditions = _plain_pruned(conditions, [rows[i] for i in held], [bool(bad[i]) for i in held])
        hit = [i for i in held if all(_holds(rows[i], c) for c in conditions)]
        if len(hit) < Q.SUPPORT or sum(bad[i] for i in hit) / len(hit) < Q.PRECISION:
            break
        out.append(conditions)
        left = [i for i in left if not all(_holds(rows[i], c) for c in conditions)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_lists_equal_those_of_plain_loops(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((420, 4)) * 6) / (1 if seed % 2 else 3)
    bad = (x[:, 0] > 4) & (x[:, 1] <= 2) | (x[:, 2] > 5 / (1 if seed % 2 else 3)) if seed < 4 else x[:, 3] > 1
    bad = bad ^ (rng.random(len(x)) < 0.04)
    got = [[(int(f), bool(a), float(t)) for f, a, t in r.conditions] for r in Q.learn_rules(x, bad)]
    assert got == _plain_list(x, bad) and (got or seed >= 4)


def test_a_rule_of_two_conditions_is_found():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 2] <= 0.3)
    rules = Q.learn_rules(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.1 * hit.sum()
