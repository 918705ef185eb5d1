"""Toxicity: a linear-chain conditional random field over tokens (operator 1).

Document labels become token labels by word statistics: words much commoner in toxic documents, and
what stands between two of them; a two-state chain (clean, toxic) with word features is fitted by gradient ascent on the exact likelihood; forward-backward marginals
of every token of every line give toxic spans and, pooled, the document's score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, in_fold, learned, logistic_fit, sigmoid, training_rows

#: Bounds of the sample that the field is fitted on; training chains are cut at so many tokens.
MAX_ROWS, MAX_CHARS, CHAIN = 4_000, 60_000, 40
#: Training chains of toxic and of clean documents.
CHAINS = (5_000, 5_000)
#: Hashed weights for word, prefix and suffix features, and tokens remembered in a task.
BUCKETS, REMEMBERED = 1 << 18, 200_000
#: Strong words so many tokens apart belong to one span of a toxic document.
GAP = 3
#: A longer chain is run in blocks.
LONG, BLOCK = 4096, 512
#: A token with this marginal or more is in a span.
SPAN_AT = 0.5

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(token: str) -> str:
    return token.lower().strip(_EDGES)


def feature_ids(word: str) -> tuple[int, ...]:
    """Buckets of the features of a normal form; an empty one has only the bias."""
    if not word:
        return (0,)
    return (0, *(1 + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for f in ("w" + word, "p" + word[:4], "s" + word[-4:])))


@dataclass
class Field:
    """weights: emission of the toxic state by feature; start and move: log potentials."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    pool: np.ndarray


class Emissions(dict):
    """Token to the potential of the toxic state."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> float:
        value = float(self.field.weights[list(feature_ids(normal(token)))].sum())
        if len(self) < REMEMBERED:
            self[token] = value
        return value


def marginals(field: Field, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each token of chains laid end to end.

    The odds of the two states obey a recursion of one number each way; all chains that
    are long enough take a step together.
    """
    if len(lengths) and lengths.max() > LONG:
        out, ends = np.empty(len(emission)), np.cumsum(lengths)
        short = np.repeat(lengths <= LONG, lengths)
        out[short] = marginals(field, emission[short], lengths[lengths <= LONG])
        for end, n in zip(ends[lengths > LONG].tolist(), lengths[lengths > LONG].tolist(), strict=True):
            out[end - n : end] = _long_marginals(field, emission[end - n : end])
        return out
    odds_of = np.exp(np.clip(emission, -30, 30))
    t = np.exp(field.move)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than each step
    forward, backward = np.empty_like(odds_of), np.ones_like(odds_of)
    if not steps:
        return forward
    o = odds_of[first[: active[0]]] * np.exp(field.start[1] - field.start[0])
    forward[first[: active[0]]] = o
    for k in range(1, steps):
        at = first[: active[k]] + k
        o = o[: active[k]]
        o = odds_of[at] * (t[0, 1] + t[1, 1] * o) / (t[0, 0] + t[1, 0] * o)
        forward[at] = o
    for k in range(steps - 2, -1, -1):
        at = first[: active[k + 1]] + k
        e = odds_of[at + 1] * backward[at + 1]
        backward[at] = (t[1, 0] + t[1, 1] * e) / (t[0, 0] + t[0, 1] * e)
    both = forward * backward
    return both / (1 + both)


def _odds(steps: np.ndarray) -> np.ndarray:
    """o of every step, o = (a o + b) / (c o + d) with the step's own [[a, b], [c, d]] from o = 0, blocks of BLOCK steps at a time."""
    n = len(steps)
    blocks = -(-n // BLOCK)
    padded = np.broadcast_to(np.eye(2), (blocks * BLOCK, 2, 2)).copy()
    padded[:n] = steps
    padded = padded.reshape(blocks, BLOCK, 2, 2)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for k in range(BLOCK):
        whole = padded[:, k] @ whole
        whole = whole / whole.max((1, 2), keepdims=True)
    o = np.zeros(blocks)
    for k in range(1, blocks):
        (a, b), (c, d) = whole[k - 1].tolist()
        o[k] = (a * o[k - 1] + b) / (c * o[k - 1] + d)
    out = np.empty((blocks, BLOCK))
    for k in range(BLOCK):
        m = padded[:, k]
        o = (m[:, 0, 0] * o + m[:, 0, 1]) / (m[:, 1, 0] * o + m[:, 1, 1])
        out[:, k] = o
    return out.ravel()[:n]


def _long_marginals(field: Field, emission: np.ndarray) -> np.ndarray:
    """marginals of one chain, both recursions composed over blocks of it."""
    e, t = np.exp(np.clip(emission, -30, 30)), np.exp(field.move)
    ahead, back = np.empty((len(e), 2, 2)), np.empty((len(e), 2, 2))
    ahead[:, 0, 0], ahead[:, 0, 1], ahead[:, 1, 0], ahead[:, 1, 1] = e * t[1, 1], e * t[0, 1], t[1, 0], t[0, 0]
    ahead[0] = [[0.0, e[0] * np.exp(field.start[1] - field.start[0])], [0.0, 1.0]]
    after = np.append(e[1:], 1.0)[::-1]
    back[:, 0, 0], back[:, 0, 1], back[:, 1, 0], back[:, 1, 1] = after * t[1, 1], t[1, 0], after * t[0, 1], t[0, 0]
    back[0] = [[0.0, 1.0], [0.0, 1.0]]
    both = _odds(ahead) * _odds(back)[::-1]
    return both / (1 + both)


def token_labels(texts: list[list[list[str]]], y: np.ndarray) -> set[str]:
    """Words that are much commoner in toxic documents than in others."""
    seen = (Counter(), Counter())
    for lines, label in zip(texts, y, strict=True):
        seen[int(label)].update({normal(w) for line in lines for w in line})
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    return {w for w, c in seen[1].items() if w and c >= 3 and (c / n1) > 8 * ((seen[0][w] + 0.5) / n0)}


def span_labels(line: list[str], strong: set[str]) -> np.ndarray:
    """1 for the tokens of a toxic document's line that are strong words or stand between two of them, GAP apart at most."""
    at = np.flatnonzero([normal(w) in strong for w in line])
    out = np.zeros(len(line))
    out[at] = 1.0
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a <= GAP:
            out[a:b] = 1.0
    return out


def _fit_chain(chains: list[list[str]], toxic: list[np.ndarray], rounds: int = 40, rate: float = 0.4) -> Field:
    """Adam on the mean log likelihood of padded chains, gradients by forward-backward."""
    n, width = len(chains), max(map(len, chains))
    ids: dict[str, int] = {}
    tokens = np.zeros((n, width), np.int64)
    mask, gold = np.zeros((n, width), bool), np.zeros((n, width))
    for i, chain in enumerate(chains):
        tokens[i, : len(chain)] = [ids.setdefault(normal(w), len(ids)) for w in chain]
        mask[i, : len(chain)], gold[i, : len(chain)] = True, toxic[i]
    parts = [feature_ids(w) for w in ids]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    used, local = np.unique(np.concatenate([np.array(p) for p in parts]), return_inverse=True)
    theta = np.zeros(len(used) + 6)  # features, start, move
    theta[0] = -2.0
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    total = mask.sum()
    pair_gold = np.zeros((2, 2))
    g0, g1, both = gold[:, :-1], gold[:, 1:], mask[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pair_gold[a, b] = ((g0 == a) & (g1 == b) & both).sum()
    for k in range(1, rounds + 1):
        w, start, move = theta[: len(used)], theta[len(used) : len(used) + 2], theta[len(used) + 2 :].reshape(2, 2)
        by_word = np.bincount(owner, weights=w[local], minlength=len(parts))
        e = np.clip(by_word[tokens], -30, 30)
        pot = np.stack([np.ones_like(e), np.exp(e)], -1)
        t = np.exp(move)
        alpha, beta, scale = np.zeros((n, width, 2)), np.ones((n, width, 2)), np.ones((n, width))
        a = np.exp(start) * pot[:, 0]
        scale[:, 0] = a.sum(1)
        alpha[:, 0] = a / scale[:, :1]
        for j in range(1, width):
            a = (alpha[:, j - 1] @ t) * pot[:, j]
            s = a.sum(1)
            live = mask[:, j]
            scale[live, j] = s[live]
            alpha[live, j] = a[live] / s[live, None]
        for j in range(width - 2, -1, -1):
            b = ((pot[:, j + 1] * beta[:, j + 1]) @ t.T) / scale[:, j + 1 : j + 2]
            beta[:, j] = np.where(mask[:, j + 1, None], b, 1.0)
        p = alpha * beta
        p /= np.maximum(p.sum(-1, keepdims=True), 1e-300)
        grad = np.zeros_like(theta)
        grad[: len(used)] = np.bincount(local, weights=np.bincount(tokens[mask], weights=(gold - p[..., 1])[mask], minlength=len(parts))[owner], minlength=len(used))
        grad[len(used) : len(used) + 2] = np.array([(gold[:, 0] == 0).sum(), (gold[:, 0] == 1).sum()]) - p[:, 0].sum(0)
        flow = alpha[:, :-1, :, None] * t * (pot * beta)[:, 1:, None, :] / scale[:, 1:, None, None]
        grad[len(used) + 2 :] = (pair_gold - (flow * both[..., None, None]).sum((0, 1))).ravel()
        grad = grad / total - 1e-5 * theta
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
        theta += rate * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[: len(used)]
    return Field(weights, theta[len(used) : len(used) + 2].copy(), theta[len(used) + 2 :].reshape(2, 2).copy(), np.zeros(5))


def pooled(p: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Document features from token marginals; firsts: where each document's tokens begin (none empty)."""
    total, most = np.add.reduceat(p, firsts), np.maximum.reduceat(p, firsts)
    n = np.diff(np.append(firsts, len(p)))
    return np.column_stack([np.log1p(total), np.minimum(total, 3.0), most, total / np.sqrt(n)])


def _document_features(field: Field, emission: Emissions, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled features of each text, and the marginals of its tokens."""
    lines = [[w for line in text.split("\n") if (w := line.split())] for text in texts]
    flat = [line for text in lines for line in text]
    lengths = np.array([len(x) for x in flat], np.int64)
    e = np.fromiter((v for line in flat for v in map(emission.__getitem__, line)), float, int(lengths.sum()))
    p = marginals(field, e, lengths) if len(flat) else np.zeros(0)
    counts = np.array([sum(map(len, text)) for text in lines], np.int64)
    full = np.flatnonzero(counts)
    x = np.zeros((len(texts), 4))
    if len(full):
        x[full] = pooled(p, (np.cumsum(counts) - counts)[full])
    ends = np.cumsum(counts)
    return x, [p[end - n : end] for end, n in zip(ends, counts, strict=True)]


def learn_field(texts: list[str], y: np.ndarray) -> Field:
    """A field from labelled documents. One class or none: nothing is toxic, the score is constant."""
    y = np.array(y, int)
    empty = Field(np.zeros(BUCKETS), np.array([0.0, -6.0]), np.array([[0.0, -6.0], [0.0, 0.0]]), np.zeros(5))
    lines = [[w for line in t.split("\n") if (w := line.split())] for t in texts]
    words = token_labels(lines, y) if len(y) else set()
    if not words:
        empty.pool = logistic_fit(np.zeros((len(y), 4)), y)
        return empty
    chains, gold = [], []
    for label, most in ((1, CHAINS[0]), (0, CHAINS[1])):
        every = [(line, k) for doc, is_ in zip(lines, y, strict=True) if is_ == label for line in doc for k in range(0, len(line), CHAIN)]
        for k in np.random.default_rng(label).permutation(len(every))[:most].tolist():
            line, begin = every[k]
            chains.append(line[begin : begin + CHAIN])
            gold.append(span_labels(line, words)[begin : begin + CHAIN] if label else np.zeros(len(chains[-1])))
    field = _fit_chain(chains, gold)
    x, emission = [], Emissions(field)
    for k in range(0, len(texts), 200):
        x.append(_document_features(field, emission, texts[k : k + 200])[0])
    field.pool = logistic_fit(np.vstack(x), y)
    return field


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Field:
    """Learned from a bounded sample of labelled documents outside the fold.

    Null labels, ids and texts don't count, empty texts do. An id with several labels counts with its smallest,
    one with several texts with the smallest text, so repeated rows count once. Without a labelled row, or with one
    label only, every text gets one and the same score.
    """
    return learned(training_rows(docs, labels, label, fold, MAX_ROWS, MAX_CHARS, key, text), learn_field)


def toxic_spans(text: str, p: np.ndarray, at: float = SPAN_AT) -> list[tuple[int, int]]:
    """Code point offsets (start, end) of maximal runs of toxic tokens within a line."""
    if not len(p) or p.max() < at:
        return []
    spans, k, base = [], 0, 0
    for line in text.split("\n"):
        place, open_ = 0, False
        for w in line.split():
            start = line.index(w, place)
            place = start + len(w)
            if p[k] >= at:
                if open_:
                    spans[-1] = (spans[-1][0], base + place)
                else:
                    spans.append((base + start, base + place))
            open_ = p[k] >= at
            k += 1
        base += len(line) + 1
    return spans


def _text_slices(values: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for v in values:
        part.append(v or "")
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


_TYPE = "struct<score: double, spans: array<struct<start: int, end: int>>>"


def score_toxicity(docs: DataFrame, field: Field, fold: tuple[int, int] = (5, 0), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and spans (code point offsets) of every whole text.

    Null and empty texts have no tokens, no spans and the score of zero pooled features. Repeated
    rows and null or equal keys give a row each (a null key isn't held out). Other columns are left
    out. No rows in, none out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS numbers: a fixed size

    @F.arrow_udf(_TYPE)
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = shared.value
        emission = Emissions(crf)
        for values in batches:
            scores, spans, sizes = [], [], [0]
            for texts in _text_slices(values.to_pylist()):
                x, p = _document_features(crf, emission, texts)
                scores.append(sigmoid(x @ crf.pool[:-1] + crf.pool[-1]))
                for t, q in zip(texts, p, strict=True):
                    spans += toxic_spans(t, q)
                    sizes.append(len(spans))
            flat = np.array(spans, np.int32).reshape(len(spans), 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], ["score", "spans"]
            )

    tagged = docs.select(F.col(key).alias("doc_id"), tag(F.col(text)).alias("t"))
    return tagged.select(
        "doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), F.col("t.score").alias("score"),
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.size("t.spans").alias("n_spans"), F.col("t.spans").alias("spans"),
    )
