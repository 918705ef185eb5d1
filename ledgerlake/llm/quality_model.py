"""Quality classifier: a sparse rule ensemble (operator 7).

Shallow trees on bootstrap samples of labelled statistics give conjunctive rules (each path
from the root); a lasso logistic fit keeps few of them; the score is a Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, learned, sigmoid, training_rows
from .quality_rules import Rule
from .text_stats import count_batch, feature_columns, feature_matrix, text_counts, thresholds

#: Bounds of the sample that the ensemble is fitted on.
MAX_ROWS, MAX_CHARS = 6_000, 100_000
#: Label 1 is predicted from this score on.
CUT = 0.7


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.covers(x)
        return sigmoid(z)

    def column(self, features: dict[str, Column]) -> Column:
        z = F.lit(float(self.bias))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(features), float(w)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def _tree_paths(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], columns: np.ndarray, depth: int, path: tuple = ()) -> set[Rule]:
    """Every path from the root of a tree that is grown by Gini gain."""
    found = {Rule(path)} if path else set()
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return found
    best = (1e-6, None)
    gini = lambda n, p: 2 * p * (n - p) / np.maximum(n, 1)
    whole = gini(len(y), y.sum())
    for f in columns:
        if not len(cuts[f]):
            continue
        cell = np.searchsorted(cuts[f], x[:, f], side="left")  # x > cut[k] exactly if cell > k
        n = np.cumsum(np.bincount(cell, minlength=len(cuts[f]) + 1))[:-1]
        p = np.cumsum(np.bincount(cell, weights=y, minlength=len(cuts[f]) + 1))[:-1]
        gain = np.where((n >= 5) & (len(y) - n >= 5), whole - gini(n, p) - gini(len(y) - n, y.sum() - p), 0)
        if gain[k := int(gain.argmax())] > best[0]:
            best = (gain[k], (int(f), float(cuts[f][k])))
    if best[1] is None:
        return found
    f, t = best[1]
    above = x[:, f] > t
    for side, name in ((above, True), (~above, False)):
        found |= _tree_paths(x[side], y[side], cuts, columns, depth - 1, (*path, (f, name, t)))
    return found


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty on all but the bias."""
    n, m = r.shape
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1.0)
    w, v, b, c, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(rounds):
        e = sigmoid(r @ v + c) - y
        w2 = v - step * (r.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * strength, 0)
        b2 = c - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def learn_ensemble(x: np.ndarray, y: np.ndarray, seed: int = 11, trees: int = 30, depth: int = 3, strength: float = 0.002) -> RuleEnsemble:
    """Without rows the score is 0.5; with one class a constant near it."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble((), (), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    cuts = [thresholds(x[:, f], 64) for f in range(x.shape[1])]
    paths: set[Rule] = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        columns = rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]
        paths |= _tree_paths(x[rows], y[rows], cuts, columns, depth)
    if not paths:  # too few rows to split
        return RuleEnsemble((), (), float(np.log(y.mean() / (1 - y.mean()))))
    rules = sorted(paths, key=lambda r: (len(r.conditions), r.conditions))
    hits = np.column_stack([r.covers(x) for r in rules]).astype(float)
    first = np.unique(hits, axis=1, return_index=True)[1]  # rules that hold on the same rows count once
    rules, hits = [rules[k] for k in sorted(first)], hits[:, sorted(first)]
    w, b = _lasso(hits, y.astype(float), strength)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble(tuple(rules[k] for k in keep), tuple(float(w[k]) for k in keep), float(b))


def fit_ensemble(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text", label: str = "quality") -> RuleEnsemble:
    """Learned from a bounded sample of labelled documents outside the fold.

    Null labels, ids and texts don't count, empty texts do. An id with several labels counts with its smallest,
    one with several texts with the smallest text, so repeated rows count once. Without a labelled row, or with one
    label only, every text gets one and the same score.
    """
    learn = lambda texts, y: learn_ensemble(feature_matrix(count_batch(pa.array(texts, pa.string()))), np.array(y, int))
    return learned(training_rows(docs, labels, label, fold, MAX_ROWS, MAX_CHARS, key, text), learn)


def quality_score(model: RuleEnsemble, text: Column) -> tuple[Column, callable]:
    """The counts struct, and what makes a score of it: score(F.col(name of the struct))."""
    return text_counts(text), lambda counts: model.column(feature_columns(counts))


def score_quality(docs: DataFrame, model: RuleEnsemble, fold: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts have counts of 0 and the score these give. Repeated rows and null or equal
    keys give a row each (a null key isn't held out). Other columns are left out. No rows in, none out.
    """
    counts, score = quality_score(model, F.col(text))
    scored = docs.select(F.col(key).alias("doc_id"), counts.alias("c")).select("doc_id", score(F.col("c")).alias("score"))
    return scored.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleEnsemble, cut: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``cut``.

    Null and empty texts are judged by counts of 0; a score of exactly ``cut`` stays; repeated rows are
    judged alike. No rows in, none out.
    """
    counts, score = quality_score(model, F.col(text))
    name = "_counts_of_text"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, counts).where(score(F.col(name)) >= cut).select(*[F.col(f"`{c}`") for c in docs.columns])
