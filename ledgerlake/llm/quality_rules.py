"""Quality rules: a learned decision list (operator 3).

Sequential covering: rules for bad texts are grown one condition at a time by
information gain on two thirds of the labelled rows, pruned on the rest, and kept while
they are precise there. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learned, training_rows
from .text_stats import FEATURES, count_batch, feature_columns, feature_matrix, text_counts, thresholds

#: Bounds of the sample that rules are learned from.
MAX_ROWS, MAX_CHARS = 6_000, 100_000
#: A rule must hold so often on the rows it is pruned on, and cover as many.
PRECISION, SUPPORT = 0.9, 4


@dataclass(frozen=True)
class Rule:
    """All of ``conditions`` (feature number, is above, threshold) hold: the text is bad."""

    conditions: tuple[tuple[int, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            hit &= (x[:, f] > t) == above
        return hit

    def column(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            c = features[FEATURES[f]]
            out = out & ((c > float(t)) if above else (c <= float(t)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int = 4) -> Rule:
    hit, conditions = np.ones(len(x), bool), []
    while len(conditions) < most and (p := bad[hit].sum()) and p < hit.sum():
        base, best = np.log2(p / hit.sum()), (1e-9, None)
        for f, ts in enumerate(cuts):
            values, good = x[hit, f], bad[hit]
            for t in ts:
                above = values > t
                for side in (above, ~above):
                    ps, ns = good[side].sum(), side.sum()
                    if ps and ns < len(side) and (gain := ps * (np.log2(ps / ns) - base)) > best[0]:
                        best = (gain, (f, side is above, float(t)))
        if best[1] is None:
            break
        conditions.append(best[1])
        f, above, t = best[1]
        hit &= (x[:, f] > t) == above
    return Rule(tuple(conditions))


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = rule.covers(x)
    return (bad[hit].sum() - (~bad[hit]).sum()) / max(1, hit.sum())


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The rule without the conditions, whichever they are, that it does as well without on the pruning rows."""
    while len(rule.conditions) > 1:
        shorter = [Rule(rule.conditions[:k] + rule.conditions[k + 1 :]) for k in range(len(rule.conditions))]
        best = max(shorter, key=lambda r: _worth(r, x, bad))
        if _worth(best, x, bad) < _worth(rule, x, bad):
            return rule
        rule = best
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 7, most: int = 12) -> list[Rule]:
    """An ordered list of rules for bad rows; empty where none is precise enough or one class is missing."""
    rules: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    cuts = [thresholds(x[:, f]) for f in range(x.shape[1])]
    while len(rules) < most and bad[left & grow].sum() >= SUPPORT:
        rule = _grow(x[left & grow], bad[left & grow], cuts)
        if not rule.conditions:
            break
        px, pb = x[left & ~grow], bad[left & ~grow]
        rule = _pruned(rule, px, pb)
        hit = rule.covers(px)
        if hit.sum() < SUPPORT or pb[hit].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Learned from a bounded sample of labelled documents outside the fold.

    Null labels, ids and texts don't count, empty texts do. An id with several labels counts with its smallest,
    one with several texts with the smallest text, so repeated rows count once. Without a labelled row, or with one
    label only, there are no rules.
    """
    learn = lambda texts, y: learn_rules(feature_matrix(count_batch(pa.array(texts, pa.string()))), np.array(y, int) == 0)
    return learned(training_rows(docs, labels, label, fold, MAX_ROWS, MAX_CHARS, key, text), learn)


def verdict(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The list as ordered conditional expressions: number of the first rule that holds, or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(features), k) if out is None else out.when(rule.column(features), k)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_quality_rules(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, base test and the rules' verdict of every whole text.

    Null and empty texts have counts of 0 and fail the base test (under 50 words). Repeated rows
    and equal or null keys give a row each. Other columns of ``docs`` are left out, so their names
    can't clash. An empty table gives no rows.
    """
    counted = docs.select(F.col(key).alias("doc_id"), text_counts(F.col(text)).alias("c"))
    c = F.col("c")
    base_failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    rule = verdict(rules, feature_columns(c))
    return counted.select(
        "doc_id", *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"), (~base_failed & (rule == 0)).alias("kept"), rule.cast("int").alias("rule"),
    )
