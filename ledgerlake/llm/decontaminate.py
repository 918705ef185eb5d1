"""Benchmark decontamination: SimHash of item-sized windows (operator 2).

For each item, every window of as many words that shares a shingle with it (no other can be
similar) gets a 64-bit SimHash. Hamming blocks find all item fingerprints within RADIUS: two
fingerprints that differ in RADIUS bits at most differ in RADIUS // BLOCKS bits at most in one
block. A run of windows is held against the items of which it has a shingle, so its cost doesn't grow
with the number of all items. Weighted Jaccard similarity of the shingles, with their multiplicity, decides.

RADIUS doesn't reach every window: with random bits, 2 to 9 of 40,000 windows at exactly 0.8 (of 9 to 90
distinct shingles) lay beyond it, and more do where one repeated shingle is most of what differs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS = 64, 20, 7
#: Items in one broadcast index; a larger benchmark is worked through in so large parts.
MAX_ITEMS, MAX_ITEM_CHARS = 20_000, 20_000_000
#: Pairs of a window and an item that are looked at in one go.
SLICE_PAIRS = 2_000_000

_WORD = re.compile(r"\w+")
_SCALE = np.random.default_rng(1).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_EDGES = np.linspace(0, BITS, BLOCKS + 1).astype(int)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit number for every run of k word codes."""
    n = len(codes) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(k):
        out += codes[j : j + n] * _SCALE[j]
    return _mix(out)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def window_prints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash (as BITS booleans) of the windows of ``size`` shingles at ``starts``; a tie of votes is 0."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return (total[starts + size] - total[starts]) > 0


def _block_values(prints: np.ndarray) -> list[np.ndarray]:
    return [prints[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)]


def _packed(prints: np.ndarray) -> np.ndarray:
    return np.packbits(prints, axis=1, bitorder="little").view(np.uint64).ravel()


#: For each width of a block, whether two values of it differ in RADIUS // BLOCKS bits at most.
_NEAR = {w: np.bitwise_count(np.arange(1 << w)[:, None] ^ np.arange(1 << w)) <= RADIUS // BLOCKS for w in set(np.diff(_EDGES).tolist())}


@dataclass
class HammingIndex:
    """Item fingerprints of one window size; for each block the items' values, and for each value the items whose own value is near it, as starts and items."""

    prints: np.ndarray
    near: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        self.packed, self.values = _packed(self.prints), _block_values(self.prints)
        for (a, b), values in zip(zip(_EDGES[:-1], _EDGES[1:], strict=True), self.values, strict=True):
            masks = np.arange(1 << (b - a))
            masks = masks[np.bitwise_count(masks) <= RADIUS // BLOCKS]
            probes = (values[:, None] ^ masks).ravel()  # all values near each item's
            order = np.argsort(probes, kind="stable")
            starts = np.searchsorted(probes[order], np.arange((1 << (b - a)) + 1))
            self.near.append((starts, (order // len(masks)).astype(np.int64)))

    def within(self, prints: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (window, item) with at most RADIUS bits between them, and the number of bits; reach: the items that count, ascending (none given: all).

        Few items are held against the windows block by block; if most of them count, each window looks up its lists.
        """
        all_items = reach is None or 2 * len(reach) >= len(self.packed)
        items = np.arange(len(self.packed)) if all_items else reach
        counts = None if reach is None or not all_items else np.isin(items, reach)
        out, step = [], max(1, SLICE_PAIRS // max(1, len(items)))
        for begin in range(0, len(prints), step):
            part = prints[begin : begin + step]
            hit = self._by_lists(part) if all_items else self._by_blocks(part, items)
            w, i = np.divmod(np.flatnonzero(hit), len(items))
            apart = np.bitwise_count(_packed(part)[w] ^ self.packed[items[i]]).astype(np.int64)
            ok = apart <= RADIUS if counts is None else (apart <= RADIUS) & counts[i]
            out.append((w[ok] + begin, items[i[ok]], apart[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _by_lists(self, part: np.ndarray) -> np.ndarray:
        n = len(self.packed)
        hit = np.zeros(len(part) * n, bool)
        for (starts, items), values in zip(self.near, _block_values(part), strict=True):
            first, count = starts[values], starts[values + 1] - starts[values]
            ends = np.cumsum(count)
            at = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
            hit[np.repeat(np.arange(len(part)) * n, count) + items[at]] = True
        return hit

    def _by_blocks(self, part: np.ndarray, items: np.ndarray) -> np.ndarray:
        hit = np.zeros((len(part), len(items)), bool)
        for width, own, values in zip(np.diff(_EDGES).tolist(), self.values, _block_values(part), strict=True):
            hit |= _NEAR[width][values[:, None], own[items]]
        return hit.ravel()


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two bags of numbers, by multiplicity."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    return int(np.minimum(m[same], n[at[same]]).sum())


class ItemIndex:
    """Items of a benchmark part: word codes, shingles and fingerprints by length in words."""

    def __init__(self, items: list[str], similarity: float = SIMILARITY, shingle: int = SHINGLE):
        self.similarity = similarity
        words = [words_of(t) for t in items]
        self.codes: dict[str, int] = {}
        for w in words:
            for x in w:
                self.codes.setdefault(x, len(self.codes) + 1)
        self.size = [len(w) for w in words]
        self.width = [min(shingle, len(w)) for w in words]
        self.shingles = [shingle_hashes(word_hashes(w), k) if k else np.zeros(0, np.uint64) for w, k in zip(words, self.width, strict=True)]
        pairs = defaultdict(list)  # by width: shingle, size in words and number of the item that has it
        for i, (w, k) in enumerate(zip(words, self.width, strict=True)):
            if k:
                own = np.unique(shingle_hashes(np.array([self.codes[x] for x in w], np.uint64), k))
                pairs[k].append((own, np.full(len(own), len(w)), np.full(len(own), i)))
        self.anchors = {}  # known shingles, where their entries begin, the entries' sizes, where their items begin, and the items
        for k, found in pairs.items():
            hashes, sizes, holders = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((holders, sizes, hashes))
            hashes, sizes, holders = hashes[order], sizes[order], holders[order]
            entry = np.flatnonzero((np.diff(hashes, prepend=hashes[:1] + np.uint64(1)) != 0) | (np.diff(sizes, prepend=-1) != 0))
            known, starts = np.unique(hashes[entry], return_index=True)
            self.anchors[k] = (known, np.append(starts, len(entry)), sizes[entry], np.append(entry, len(hashes)), holders)
        by_size = defaultdict(list)
        for i, n in enumerate(self.size):
            if n:
                by_size[n].append(i)
        self.by_size, self.slot = {}, np.zeros(len(items), np.int64)
        for n, members in by_size.items():
            self.slot[members] = np.arange(len(members))
            prints = np.vstack([window_prints(self.shingles[i], np.array([0]), len(self.shingles[i])) for i in members])
            self.by_size[n] = (members, HammingIndex(prints))

    def _touched(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By item size (in words): places of shared shingles in a text, ascending, and the entries of these shingles."""
        codes = np.fromiter((self.codes.get(w, 0) for w in words), np.uint64, len(words))
        out = {}
        for k, (known, first, sizes, _, _) in self.anchors.items():
            if len(words) < k:
                continue
            hashes = shingle_hashes(codes, k)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes)
            if not len(hit):
                continue
            begin, count = first[at[hit]], first[at[hit] + 1] - first[at[hit]]
            ends = np.cumsum(count)
            entries = np.repeat(begin - (ends - count), count) + np.arange(ends[-1])
            places = np.repeat(hit, count)
            order = np.argsort(sizes[entries], kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(sizes[entries[order]])) + 1):
                out[int(sizes[entries[own[0]]])] = (places[own], entries[own])
        return out

    def _reach(self, k: int, entries: np.ndarray) -> np.ndarray:
        """Places in their size's list of the items with these shingles, ascending."""
        _, _, _, starts, holders = self.anchors[k]
        own = np.unique(entries)
        return np.unique(self.slot[np.concatenate([holders[a:b] for a, b in zip(starts[own].tolist(), starts[own + 1].tolist(), strict=True)])])

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """The best window (item, first word, words, Hamming distance, similarity) of each item that the text holds."""
        words = words_of(text)
        if not words:
            return []
        best: dict[int, tuple] = {}
        for n, (places, entries) in self._touched(words).items():
            members, index = self.by_size[n]
            k = self.width[members[0]]
            if len(words) < n:  # the text is shorter than the item: it is one window
                runs = [(0, len(words), np.array([0]))]
                size = max(1, len(words) - k + 1)
            else:
                starts = np.unique(np.concatenate([np.arange(max(0, p - (n - k)), min(p, len(words) - n) + 1) for p in np.unique(places).tolist()]))
                cuts = np.flatnonzero(np.diff(starts) > n) + 1
                runs = [(int(s[0]), int(s[-1]) + n, s - s[0]) for s in np.split(starts, cuts)]
                size = n - k + 1
            for begin, end, starts in runs:
                shingles = shingle_hashes(word_hashes(words[begin:end]), k)
                reach = self._reach(k, entries[np.searchsorted(places, begin) : np.searchsorted(places, end)])
                for w, i, apart in zip(*index.within(window_prints(shingles, starts, size), reach), strict=True):
                    item, start = members[i], int(starts[w])
                    shared = shared_count(shingles[start : start + size], self.shingles[item])
                    similar = shared / (size + len(self.shingles[item]) - shared)
                    if similar >= self.similarity and (item not in best or (similar, -start - begin) > (best[item][4], -best[item][1])):
                        best[item] = (item, begin + start, min(n, len(words)), int(apart), similar)
        return [best[i] for i in sorted(best)]


_TYPE = "array<struct<item: int, first_word: int, n_words: int, hamming: int, similarity: double>>"


def item_parts(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list]:
    """The benchmark in lists of bounded size, in the order of the key. Items without text are left out."""
    part, chars = [], 0
    wanted = items.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    for row in wanted.orderBy("id", "text").toLocalIterator():
        part.append(row)
        chars += len(row["text"])
        if len(part) >= MAX_ITEMS or chars >= MAX_ITEM_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def matched_items(docs: DataFrame, index: ItemIndex, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # MAX_ITEMS items at most

    @F.arrow_udf(_TYPE)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for values in batches:
            yield pa.array([[dict(zip(("item", "first_word", "n_words", "hamming", "similarity"), m, strict=True)) for m in known.matches(v.as_py())] for v in values], pa.list_(
                pa.struct([("item", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("hamming", pa.int32()), ("similarity", pa.float64())])))

    return match(text)


def contaminations(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, first_word, n_words, hamming, similarity.

    Words are runs of letters, digits and underscores in lower case. Null and empty texts and items
    match nothing; of equally similar windows the first counts; an item under ``shingle`` words is one shingle, and so is a shorter text. Repeated
    documents and equal items give a row each; a null key stays null. Other columns are left out.
    No rows in, none out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id {docs.schema[key].dataType.simpleString()}, item_id {kind}, first_word int, n_words int, hamming int, similarity double")
    for part in item_parts(items, item_key, item_text):
        index = ItemIndex([r["text"] for r in part], similarity, shingle)
        names = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(part)], f"item int, item_id {kind}")
        found = slim.select("doc_id", F.explode(matched_items(docs, index, F.col("text"))).alias("m")).select("doc_id", "m.*")
        found = found.join(F.broadcast(names), "item").select("doc_id", "item_id", "first_word", "n_words", "hamming", "similarity")
        out = out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item.

    Null and empty texts hold none and stay; a window at exactly the least similarity goes; repeated
    rows are judged alike. No items keep all rows; no rows in, none out.
    """
    columns = docs.columns
    name = "_items_in_text"
    while name in columns:
        name += "_"
    for part in item_parts(items, **options):
        index = ItemIndex([r["text"] for r in part])
        docs = docs.withColumn(name, matched_items(docs, index, F.col(text))).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in columns])
    return docs
