"""Language ID: a bidirectional gated recurrent network over bytes (operator 4).

A document is read in windows of STEP bytes with MARGIN more to each side, so that the state of both
directions has run over MARGIN bytes, white space and other words included, before the first byte
that counts; a text of up to STEP bytes is one window. The network labels every byte, and a document's
probabilities are the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, crc32_mod, in_fold, learned, texts_of

#: Bounds of the sample that the network is trained on: languages, rows of each, characters of a text.
MAX_LANGS, MAX_ROWS, MAX_CHARS = 200, 500, 20_000
STEP, MARGIN, HIDDEN = 480, 32, 12
#: Windows that are run at once, and bytes of a window in training.
BLOCK, TRAINED = 512, 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """table: gate inputs (update, reset, new) by direction and byte; recur: by direction; out: to labels, by direction; all feature by feature."""

    langs: tuple[str, ...]
    table: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def pack(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, a window a column padded to the longest, and lengths."""
    lengths = np.fromiter(map(len, windows), np.int64, len(windows))
    out = np.zeros((len(windows), int(lengths.max()) if len(windows) else 0), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(windows), np.uint8)
    return np.ascontiguousarray(out.T), lengths


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each column's first lengths entries turned round; time is the first axis, columns the last."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return np.take_along_axis(x, at if x.ndim == 2 else at[:, None, :], 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(table: np.ndarray, recur: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, HIDDEN, windows) of one direction, and what backpropagation needs of each step."""
    h = np.zeros((HIDDEN, x.shape[1]), table.dtype)
    states, kept = np.empty((len(x), *h.shape), table.dtype), []
    for k, step in enumerate(x):
        gates, back = table[:, step], recur @ h
        zr = _sigmoid(gates[: 2 * HIDDEN] + back[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        c = np.tanh(gates[2 * HIDDEN :] + r * back[2 * HIDDEN :])
        kept.append((h, z, r, c, back[2 * HIDDEN :]))
        h = c + z * (h - c)
        states[k] = h
    return states, kept


def _votes(table: np.ndarray, recur: np.ndarray, out: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What one direction adds to the labels' logits at every step, (steps, labels, windows), as _states would give it."""
    half = np.ones((3 * HIDDEN, 1), table.dtype)
    half[: 2 * HIDDEN] = 0.5  # a sigmoid is a tanh of half its input
    table, recur = table * half, recur * half
    h = np.zeros((HIDDEN, x.shape[1]), table.dtype)
    votes = np.empty((len(x), len(out), x.shape[1]), table.dtype)
    back, gates = np.empty((3 * HIDDEN, x.shape[1]), table.dtype), np.empty((3 * HIDDEN, x.shape[1]), table.dtype)
    for k, step in enumerate(x):
        np.take(table, step, axis=1, out=gates, mode="clip")  # bytes are never out of range, and numpy buffers ``out`` in its default mode
        np.matmul(recur, h, out=back)
        zr = gates[: 2 * HIDDEN]
        zr += back[: 2 * HIDDEN]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c, inner = gates[2 * HIDDEN :], back[2 * HIDDEN :]
        inner *= zr[HIDDEN:]
        c += inner
        np.tanh(c, out=c)
        h -= c
        h *= zr[:HIDDEN]
        h += c
        np.matmul(out, h, out=votes[k])
    return votes


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def label_positions(net: Network, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities at every byte, (steps, labels, windows), and lengths."""
    x, lengths = pack(windows)
    logits = _votes(net.table[0], net.recur[0], net.out[0], x)
    logits += _reverse(_votes(net.table[1], net.recur[1], net.out[1], _reverse(x, lengths)), lengths)
    logits += net.bias[:, None]
    return _softmax(logits), lengths


def loss_and_gradient(p: dict[str, np.ndarray], windows: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all bytes, and its gradient by backpropagation through time."""
    x, lengths = pack(windows)
    turned, n = _reverse(x, lengths), len(windows)
    ahead, kept0 = _states(p["table"][0], p["recur"][0], x)
    back, kept1 = _states(p["table"][1], p["recur"][1], turned)
    back = _reverse(back, lengths)
    q = _softmax(p["out"][0] @ ahead + p["out"][1] @ back + p["bias"][:, None])
    live = (np.arange(len(x))[:, None] < lengths)[:, None, :]
    loss = -float((np.log(np.maximum(q[:, y, np.arange(n)], 1e-30)) * live[:, 0]).sum() / live.sum())
    q[:, y, np.arange(n)] -= 1
    d = (q * live / live.sum()).astype(q.dtype)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["bias"] = d.sum((0, 2))
    for side, states, kept, bytes_ in ((0, ahead, kept0, x), (1, back, kept1, turned)):
        grad["out"][side] = np.tensordot(d, states, axes=([0, 2], [0, 2]))
        above = p["out"][side].T @ d
        above = _reverse(above, lengths) if side else above
        dh, recur, gates = np.zeros((HIDDEN, n), d.dtype), p["recur"][side], np.empty((len(x), 3 * HIDDEN, n), d.dtype)
        for k in range(len(x) - 1, -1, -1):
            h, z, r, c, inner = kept[k]
            dh = dh + above[k]
            dc = dh * (1 - z) * (1 - c * c)
            gates[k, :HIDDEN] = dh * (h - c) * z * (1 - z)
            gates[k, HIDDEN : 2 * HIDDEN] = dc * inner * r * (1 - r)
            gates[k, 2 * HIDDEN :] = dc
            down = gates[k].copy()
            down[2 * HIDDEN :] *= r
            grad["recur"][side] += down @ h.T
            dh = dh * z + recur.T @ down
        by_gate, flat = gates.transpose(1, 0, 2).reshape(3 * HIDDEN, -1), bytes_.ravel()
        grad["table"][side] = np.stack([np.bincount(flat, weights=g, minlength=256) for g in by_gate])
    return loss, grad


def initial(labels: int, rng: np.random.Generator, kind: type = np.float32) -> dict[str, np.ndarray]:
    shape = {"table": (2, 3 * HIDDEN, 256), "recur": (2, 3 * HIDDEN, HIDDEN), "out": (2, labels, HIDDEN), "bias": (labels,)}
    return {k: (rng.normal(0, 0.3, s) if k != "bias" else np.zeros(s)).astype(kind) for k, s in shape.items()}


def train_network(texts: list[str], langs: list[str], rounds: int = 300, batch: int = 160, seed: int = 5, rate: float = 0.015) -> Network:
    """Adam on stretches of TRAINED bytes, each language as often as the others. One language: it is certain; none: no network."""
    names = tuple(sorted(set(langs)))
    rng = np.random.default_rng(seed)
    p = initial(len(names), rng)
    pool = [b"\n".join(t.encode("utf-8", "replace") for t, g in zip(texts, langs, strict=True) if g == name) for name in names]
    which = [k for k, data in enumerate(pool) if data.strip()]
    if len(which) < 2:
        return Network(names, **p)
    one, two = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, rounds + 1):
        y = rng.choice(which, batch)
        starts = (rng.random(batch) * [max(1, len(pool[k]) - TRAINED) for k in y]).astype(int)
        sizes = rng.integers(4, TRAINED + 1, batch)
        grad = loss_and_gradient(p, [pool[k][a : a + n] for k, a, n in zip(y, starts, sizes, strict=True)], y)[1]
        pace = rate * min(1.0, 3 * (1 - (step - 1) / rounds))
        for k in p:
            one[k] = 0.9 * one[k] + 0.1 * grad[k]
            two[k] = 0.999 * two[k] + 0.001 * grad[k] ** 2
            p[k] -= pace * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Network(names, **{k: v.astype(np.float32) for k, v in p.items()})


def fit_language(docs: DataFrame, fold: tuple[int, int] = (3, 1), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Trained on a bounded sample outside the fold: of the MAX_LANGS commonest languages MAX_ROWS texts each, by a hash of the id.

    An id with several languages counts with its smallest; null ids, languages and texts don't count.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("y"))
    labelled = rows.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), fold[0]) != fold[1]))
    counts = labelled.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MAX_LANGS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    few = labelled.select("doc_id", "y").join(F.broadcast(counts), "y").where(place * F.col("n") < 3 * MAX_ROWS * (1 << 20))  # about three times the rows wanted
    few = few.groupBy(F.col("doc_id").alias("id")).agg(F.min("y").alias("y"))
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")))
    return learned(texts_of(labelled.select(F.col("doc_id").alias("id"), "text"), ranked.where(F.col("nth") <= MAX_ROWS).select("id", "y"), MAX_CHARS), train_network)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of these sizes: the text of each, and where its bytes that count begin and end."""
    count = -(-sizes // STEP)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = nth * STEP
    return owner, begin, np.minimum(begin + STEP, sizes[owner])


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over the bytes of each text; zeros without any."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner, begin, end = windows_of(sizes)
    left, right = np.maximum(begin - MARGIN, 0), np.minimum(end + MARGIN, sizes[owner])
    order = np.argsort(right - left, kind="stable")
    out = np.zeros((len(texts), len(net.langs)))
    for k in range(0, len(order), BLOCK):
        part = order[k : k + BLOCK]
        p, _ = label_positions(net, [texts[o][a:b] for o, a, b in zip(owner[part].tolist(), left[part].tolist(), right[part].tolist(), strict=True)])
        steps = np.arange(len(p))[:, None]
        p *= ((steps >= begin[part] - left[part]) & (steps < end[part] - left[part]))[:, None, :]
        np.add.at(out, owner[part], p.sum(0, dtype=np.float64).T)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def language_of(net: Network, shared, text: Column) -> Column:
    """Struct lang_pred, score for a text; no letter, no text or no learned language: UNKNOWN, 0."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for values in batches:
            langs, scores = [], []
            for part in byte_slices(values):
                known = [bool(model.langs) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in part]
                p = document_probabilities(model, [t if k else b"" for t, k in zip(part, known, strict=True)]) if any(known) else np.zeros((len(part), 1))
                for ok, b, q in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    langs.append(model.langs[b] if ok else UNKNOWN)
                    scores.append(min(1.0, q) if ok else 0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def predict_language(docs: DataFrame, net: Network, fold: tuple[int, int] = (3, 1), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Null and empty texts, and texts without a letter, are UNKNOWN with score 0; of equally likely
    languages the first by name. Repeated rows and null or equal keys give a row each (a null key
    isn't held out). Other columns are left out. No rows in, none out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    found = docs.select(F.col(key).alias("doc_id"), language_of(net, shared, F.col(text)).alias("p"))
    return found.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_language(docs: DataFrame, net: Network, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with a known language of at least this score.

    Null and empty texts and texts without a letter go; a score of exactly ``least`` stays; repeated
    rows are judged alike. No rows in, none out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    name = "_language_of_text"
    while name in docs.columns:
        name += "_"
    p = F.col(name)
    return docs.withColumn(name, language_of(net, shared, F.col(text))).where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
