"""SentencePiece segmentations, sampled without replacement (operator 10).

The pieces of a public model make a lattice over each token of a text; a piece's probability
falls with its rank. A text's segmentations are the leaves of a tree whose nodes fix the tokens
so far. Each node has a Gumbel-perturbed log mass, the maximum over its leaves, so a best-first
(A-star) search that always opens the node with the greatest one emits the top k perturbed
leaves: k distinct segmentations drawn without replacement. The perturbation of the best node
left is the threshold that gives each its inclusion probability.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Longest piece, and longest token whose lattice a task keeps, in characters; no piece of the model is longer.
PIECE_CHARS, TOKEN_CHARS = 16, 48
#: A token over so many characters is worked on in stretches of STRETCH of them: only the mass of each place is kept, and edges are made again where they are needed.
LONG_CHARS, STRETCH = 16_384, 4_096
#: Tokens and edges of such tokens are numbered from here; an edge by token, place and size.
FAR, PLACES = 1 << 40, 1 << 35
#: Bytes of text that are worked on at once.
SLICE_BYTES = 400_000
#: A task keeps the lattices of the tokens it has seen, and begins anew beyond so many edges.
REMEMBERED_EDGES = 1_000_000
#: Log probability of a byte that stands in for a part of an unknown character.
LOG_BYTE = -14.0

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Pieces:
    """Trie of a model's pieces, their log probabilities, and the bytes they decode to."""

    def __init__(self, pieces: list[str], byte_ids: dict[int, int]):
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        special = set(byte_ids.values())
        ranks = [i for i, p in enumerate(pieces) if i not in special and p and len(p) <= PIECE_CHARS]
        weight = 1.0 / (np.arange(len(ranks)) + 2.7)
        self.alphabet = {c: k for k, c in enumerate(sorted({c for i in ranks for c in pieces[i]}), 1)}
        self.radix = len(self.alphabet) + 1
        children: dict[int, int] = {}
        piece_at = [-1]
        for i in ranks:
            node = 0
            for c in pieces[i]:
                key = node * self.radix + self.alphabet[c]
                if key not in children:
                    children[key] = len(piece_at)
                    piece_at.append(-1)
                node = children[key]
            piece_at[node] = i
        self._hashed(children)
        self.piece_at = np.array(piece_at, np.int64)
        self.logp = np.full(len(pieces), -np.inf)
        self.logp[ranks] = np.log(weight / weight.sum())
        self.code = np.zeros(0x110000, np.int32)
        for c, k in self.alphabet.items():
            self.code[ord(c)] = k
        self.code[ord(" ")], self.code[ord(SPACE)] = self.alphabet.get(SPACE, 0), 0
        joined = {pair for i in ranks for pair in zip(pieces[i], pieces[i][1:])}
        self.before, self.after = (np.zeros(self.radix, np.int64) for _ in range(2))
        for side, place in ((self.before, 0), (self.after, 1)):
            for k, c in enumerate(sorted({pair[place] for pair in joined}), 1):
                side[self.alphabet[c]] = k
        self.joins = np.zeros((self.before.max() + 1, self.after.max() + 1), bool)
        for a, b in joined:
            self.joins[self.before[self.alphabet[a]], self.after[self.alphabet[b]]] = True
        told = [p.replace(SPACE, " ").encode("utf-8", "replace") for p in pieces]
        for b, i in byte_ids.items():
            told[i] = bytes([b])
        self.lengths = np.array([len(t) for t in told], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(told), np.uint8)

    def _hashed(self, children: dict[int, int]) -> None:
        """A table of slots: a key stands at its hash or, where others do, in one of the next ``probes``."""
        bits = max(4, (4 * len(children)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.child = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int64)
        keys = np.array(list(children), np.int64)
        nodes, slots = np.array(list(children.values()), np.int64), self._slots(keys)
        self.probes = 0
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]], self.child[slots[free]] = keys[free], nodes[free]
            rest = self.keys[slots] != keys
            keys, nodes, slots = keys[rest], nodes[rest], slots[rest] + 1
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The trie's nodes that these keys lead to, -1 for none."""
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.child[slots], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slots] >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = slots[open_] + k
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.child[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        return out

    def cut(self, texts: list[str]) -> Parts:
        """The texts cut between any two characters that stand next to each other in no piece."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code[points]
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = ~self.joins[self.before[code[:-1]], self.after[code[1:]]]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        edge[ends] = True
        at = np.flatnonzero(edge)
        counts = np.diff(np.searchsorted(at, ends), prepend=0)
        # a polynomial in an odd base; tokens of up to TOKEN_CHARS are told apart by it
        power = np.cumprod(np.full(len(points) + 1, _BASE), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power[: len(points)], dtype=np.uint64)])
        inverse = np.cumprod(np.full(len(points) + 1, _INVERSE), dtype=np.uint64)
        return Parts(points.astype(np.int64), at[:-1], np.diff(at), (total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]], counts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, lengths[0] of them, then from starts[1]."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def load_pieces(path: str = MODEL) -> Pieces:
    """Read on the driver; tasks get the table by broadcast, its size fixed by the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        pieces.append("" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else p)
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
    return Pieces(pieces, byte_ids)


@dataclass
class Parts:
    """Texts cut into tokens: code points of all texts, the tokens' starts, sizes and 64-bit hashes, tokens of each text."""

    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


class Rows:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.room, self.size = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(size - self.size + size // 2, self.room.dtype)])
        self.room[self.size : size] = values
        self.size = size

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class LongToken:
    """The lattice of one long token; its edges are numbered by place and size."""

    def __init__(self, pieces: Pieces, points: np.ndarray):
        self.pieces, self.points, self.n = pieces, points.astype(np.int32), len(points)
        self.code = np.concatenate([pieces.code[points], np.zeros(PIECE_CHARS, np.int32)])
        self.mass = np.zeros(self.n + 1)
        self.begin, self.made = -1, None
        for b in range(self.n, 0, -STRETCH):
            first, sizes, logs, _ = self._edges(max(0, b - STRETCH), b)
            mass = self.mass[max(0, b - STRETCH) : min(self.n, b + PIECE_CHARS) + 1].tolist()
            for k in range(len(first) - 2, -1, -1):
                v = [logs[e] + mass[k + sizes[e]] for e in range(first[k], first[k + 1])]
                top = max(v)
                mass[k] = top + math.log(sum(math.exp(x - top) for x in v))
            self.mass[max(0, b - STRETCH) : b] = mass[: len(first) - 1]

    def _edges(self, a: int, b: int) -> tuple[list, list, list, list]:
        """Of the places from a to b: where each one's edges begin, longer pieces first, and the edges' sizes, log probabilities and pieces (-1: the bytes of a character)."""
        pieces, n = self.pieces, b - a
        found, live, node = [], np.arange(n)[self.code[a:b] > 0], np.zeros(1, np.int64)
        for size in range(1, PIECE_CHARS + 1):
            k = pieces.find(node * pieces.radix + self.code[a + live + size - 1])
            ok = k >= 0
            live, node = live[ok], k[ok]
            piece = pieces.piece_at[node]
            found.append((live[piece >= 0], np.full(int((piece >= 0).sum()), size), piece[piece >= 0]))
            keep = a + live + size < self.n
            live, node = live[keep], node[keep]
            if not len(live):
                break
        alone = np.zeros(n, bool)
        alone[found[0][0]] = True
        lost = np.flatnonzero(~alone)
        found.append((lost, np.ones(len(lost), np.int64), np.full(len(lost), -1)))
        source, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-size, source))
        source, size, piece = source[order], size[order], piece[order]
        point = self.points[a + source]
        logp = np.where(piece >= 0, pieces.logp[piece], LOG_BYTE * (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)))
        return np.searchsorted(source, np.arange(n + 1)).tolist(), size.tolist(), logp.tolist(), piece.tolist()

    def edges_at(self, place: int) -> tuple[list[int], list[float]]:
        """Sizes and log chances of a place's edges; the stretch of the last place asked for is kept."""
        begin = place - place % STRETCH
        if begin != self.begin:
            self.begin, self.made = begin, self._edges(begin, min(self.n, begin + STRETCH))
        first, sizes, logs, _ = self.made
        own = range(first[place - begin], first[place - begin + 1])
        here = float(self.mass[place])
        return [sizes[e] for e in own], [logs[e] + float(self.mass[place + sizes[e]]) - here for e in own]

    def draw(self, seed: int) -> tuple[np.ndarray, float]:
        """Edges of a segmentation and its log chance."""
        place, out, total, drawn = 0, [], 0.0, []
        while place < self.n:
            if len(out) % STRETCH == 0:
                drawn = uniform(np.uint64(seed) + np.uint64(0x9E3779B97F4A7C15) * np.arange(len(out) + 1, len(out) + STRETCH + 1, dtype=np.uint64)).tolist()
            sizes, logs = self.edges_at(place)
            u, upto, k = drawn[len(out) % STRETCH], 0.0, 0
            for k, log in enumerate(logs):
                upto += math.exp(log)
                if u < min(upto, 1.0):
                    break
            out.append(place * 32 + sizes[k])
            total += logs[k]
            place += sizes[k]
        return np.array(out, np.int64), total

    def chances(self, edges: np.ndarray) -> np.ndarray:
        place, size = edges >> 5, edges & 31
        point, piece = self.points[place], self._pieces(place, size)
        logp = np.where(piece >= 0, self.pieces.logp[piece], LOG_BYTE * (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)))
        return logp + self.mass[place + size] - self.mass[place]

    def _pieces(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(place), np.int64), np.arange(len(place))
        for k in range(int(size.max(initial=0))):
            at = at[(size[at] > k) & (node[at] >= 0)]
            node[at] = np.where(self.code[place[at] + k] > 0, self.pieces.find(node[at] * self.pieces.radix + self.code[place[at] + k]), -1)
        return np.where(node >= 0, self.pieces.piece_at[node], -1)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        place = edges >> 5
        piece = self._pieces(place, edges & 31)
        if (piece >= 0).all():
            return piece
        told = [[p] if p >= 0 else self.pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))].tolist() for p, c in zip(piece.tolist(), self.points[place].tolist(), strict=True)]
        return np.fromiter((i for t in told for i in t), np.int64)


class Lattices:
    """Edges of the lattices of the tokens seen so far: places are characters of the tokens laid end to end.

    A place's edges stand together, shorter pieces after longer ones. ``upto`` is the chance of an
    edge and those before it at its place.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[int, int] = {}
        self.far: list[LongToken] = []
        self._start, self._end, self._first, self._target, self._first_id, self._ids = (Rows(np.int32) for _ in range(6))
        self._n_ids, self._log_chance, self._upto = Rows(np.int8), Rows(np.float64), Rows(np.float64)
        self._first.extend(np.zeros(1, np.int32))

    def number(self, parts: Parts) -> np.ndarray:
        """The tokens' numbers; lattices of new ones are added, those of long ones until forget()."""
        out = np.fromiter(map(self.known.get, parts.hashes.tolist(), repeat(-1)), np.int64, len(parts.starts))
        fresh = np.flatnonzero(out < 0)
        size = parts.sizes[fresh]
        short, long, far = fresh[size <= TOKEN_CHARS], fresh[(size > TOKEN_CHARS) & (size <= LONG_CHARS)], fresh[size > LONG_CHARS]
        self.far = [LongToken(self.pieces, parts.points[a : a + n]) for a, n in zip(parts.starts[far].tolist(), parts.sizes[far].tolist(), strict=True)]
        out[far] = FAR + np.arange(len(far))
        if len(short):
            keys, first, which = np.unique(parts.hashes[short], return_index=True, return_inverse=True)
            out[short] = len(self.known) + which
            self.known.update(zip(keys.tolist(), range(len(self.known), len(self.known) + len(keys)), strict=True))
            self._extend(parts.points, parts.starts[short[first]], parts.sizes[short[first]])
        self._marks = [x.size for x in self._all()]
        if len(long):
            out[long] = len(self.known) + np.arange(len(long))
            self._extend(parts.points, parts.starts[long], parts.sizes[long])
        self.start, self.end, self.edges_of, self.target, self.first_id = (x.values for x in (self._start, self._end, self._first, self._target, self._first_id))
        self.ids, self.n_ids, self.log_chance, self.upto = (x.values for x in (self._ids, self._n_ids, self._log_chance, self._upto))
        return out

    def _all(self) -> tuple[Rows, ...]:
        return self._start, self._end, self._first, self._target, self._first_id, self._ids, self._n_ids, self._log_chance, self._upto

    def forget(self) -> None:
        """Drop the lattices of long tokens, and the room that they took."""
        self.far = []
        for rows, size in zip(self._all(), self._marks, strict=True):
            if rows.size > size:
                rows.room, rows.size = rows.room[: 2 * size + 1024].copy(), size

    @property
    def size(self) -> int:
        return self._target.size

    def _extend(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        pieces = self.pieces
        points = points[ragged(starts, sizes)]
        end = np.cumsum(sizes) + np.arange(len(sizes))  # a place after each token's last character
        start = end - sizes
        n = int(end[-1]) + 1
        at = ragged(start, sizes)
        code, point, left = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
        code[at], point[at] = pieces.code[points], points
        left[at] = np.repeat(end, sizes) - at
        found, count = [], np.zeros(n, np.int64)
        live, node = at[code[at] > 0], np.zeros(1, np.int64)
        for size in range(1, PIECE_CHARS + 1):
            key = node * pieces.radix + code[live + size - 1]
            k = pieces.find(key)
            ok = k >= 0
            live, node = live[ok], k[ok]
            piece = pieces.piece_at[node]
            whole = piece >= 0
            found.append((size, live[whole], piece[whole]))
            count[found[-1][1]] += 1
            keep = left[live] > size
            live, node = live[keep], node[keep]
            if not len(live):
                break
        alone = np.zeros(n, bool)
        alone[found[0][1]] = True
        lost = at[~alone[at]]
        count[lost] += 1
        first = np.cumsum(count) - count
        edges = int(count.sum())
        source, width, ids = np.repeat(np.arange(n), count), np.ones(edges, np.int64), np.full(edges, -1, np.int64)
        target, slot = np.zeros(edges, np.int64), first + count
        for size, where, piece in [(1, lost, -1), *found]:
            slot[where] -= 1
            e = slot[where]
            target[e], ids[e] = where + size, piece
        unknown = np.flatnonzero(ids < 0)
        p = point[source[unknown]]
        width[unknown] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        logp = pieces.logp[ids]
        logp[unknown] = width[unknown] * LOG_BYTE
        first_id = np.cumsum(width) - width
        flat = np.zeros(int(width.sum()), np.int64)
        flat[first_id] = ids
        for e, c in zip(unknown.tolist(), p.tolist(), strict=True):
            data = chr(c).encode("utf-8", "surrogatepass")
            flat[first_id[e] : first_id[e] + len(data)] = pieces.byte_ids[list(data)]
        mass, depth = np.zeros(n), left[source]
        by_depth = np.argsort(depth, kind="stable")
        for chunk in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if edges else ():
            s = source[chunk]
            head = np.flatnonzero(np.diff(s, prepend=-1))
            v = logp[chunk] + mass[target[chunk]]
            top = np.maximum.reduceat(v, head)
            mass[s[head]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count[s[head]])), head))
        log_chance = logp + mass[target] - mass[source]
        upto, chance = np.ones(edges), np.exp(log_chance)
        e, total = first[count > 1], np.zeros(1)
        last = (first + count - 1)[count > 1]
        while len(e):  # the last edge of a place keeps its 1
            total = total + chance[e]
            upto[e] = np.minimum(total, 1.0)
            more = e + 1 < last
            e, last, total = e[more] + 1, last[more], total[more]
        places, before, told = self._first.size - 1, self._target.size, self._ids.size
        self._start.extend(start + places)
        self._end.extend(end + places)
        self._first.extend(before + first + count)
        self._target.extend(target + places)
        self._first_id.extend(first_id + told)
        for rows, values in ((self._ids, flat), (self._n_ids, width), (self._log_chance, log_chance), (self._upto, upto)):
            rows.extend(values)

    def chances(self, edges: np.ndarray) -> np.ndarray:
        """Log chance of each edge."""
        far = edges >= FAR
        if not far.any():
            return self.log_chance[edges]
        out = np.zeros(len(edges))
        out[~far] = self.log_chance[edges[~far]]
        for k in np.unique(edges[far] // PLACES).tolist():
            own = np.flatnonzero(far & (edges // PLACES == k))
            out[own] = self.far[k - FAR // PLACES].chances(edges[own] % PLACES)
        return out

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges, one after the other."""
        told = []
        for run in np.split(edges, np.flatnonzero(np.diff(np.maximum(edges // PLACES, FAR // PLACES - 1))) + 1) if len(edges) and edges.max() >= FAR else [edges]:
            far = len(run) and run[0] >= FAR
            told.append(self.far[int(run[0] // PLACES) - FAR // PLACES].ids(run % PLACES) if far else self.ids[ragged(self.first_id[run], self.n_ids[run])])
        return np.concatenate(told)

    def draw(self, token: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for each of these tokens: edges, how many each has, and its log chance."""
        far = np.flatnonzero(token >= FAR)
        if not len(far):
            return self._draw(token, seed)
        rest = np.flatnonzero(token < FAR)
        edges, some, chances = self._draw(token[rest], seed[rest])
        counts, chance, parts = np.zeros(len(token), np.int64), np.zeros(len(token)), [np.zeros(0, np.int64)] * len(token)
        counts[rest], chance[rest] = some, chances
        for i, part in zip(rest.tolist(), np.split(edges, np.cumsum(some)[:-1]) if len(rest) else (), strict=True):
            parts[i] = part
        for i in far.tolist():
            k = int(token[i] - FAR)
            own, chance[i] = self.far[k].draw(int(seed[i]))
            parts[i], counts[i] = own + (FAR // PLACES + k) * PLACES, len(own)
        return np.concatenate(parts), counts, chance

    def _draw(self, token: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, end = self.start[token].astype(np.int64), self.end[token]
        counts, chance = np.zeros(len(token), np.int64), np.zeros(len(token))
        live, steps = np.flatnonzero(place < end), []
        while len(live):
            u = uniform(seed[live] + np.uint64(0x9E3779B97F4A7C15) * (counts[live] + 1).astype(np.uint64))
            e = self.edges_of[place[live]].astype(np.int64)
            over = np.flatnonzero(u >= self.upto[e])
            while len(over):
                e[over] += 1
                over = over[u[over] >= self.upto[e[over]]]
            steps.append((live, e))
            counts[live] += 1
            chance[live] += self.log_chance[e]
            place[live] = to = self.target[e]
            live = live[to < end[live]]
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (which, e) in enumerate(steps):
            out[first[which] + k] = e
        return out, counts, chance

    def draw_other(self, token: int, seed: int, barred: set[tuple[int, ...]]) -> tuple[int, ...]:
        """A segmentation of a token outside a set of them, by its chance among the others."""
        path, rng, far = [], random.Random(seed), None
        if token >= FAR:
            far, base = self.far[token - FAR], (FAR // PLACES + token - FAR) * PLACES
        place, end = (0, far.n) if far else (int(self.start[token]), int(self.end[token]))
        # each barred way with the log chance of what follows its k-th edge
        logs = [(p, self.chances(np.array(p, np.int64))) for p in barred]
        left = [(p, (np.cumsum(x[::-1])[::-1] - x).tolist()) for p, x in logs]
        while place < end:
            if far:
                sizes, chance = far.edges_at(place)
                own, k, weight = [base + place * 32 + x for x in sizes], len(path), np.exp(chance).tolist()
            else:
                a, b = self.edges_of[place : place + 2].tolist()
                own, k, weight = range(a, b), len(path), np.exp(self.log_chance[a:b]).tolist()
            for e in {p[k] for p, _ in left}:
                held = [(p, tail) for p, tail in left if p[k] == e]
                whole = any(len(p) == k + 1 for p, _ in held)
                weight[own.index(e)] *= 0.0 if whole else max(0.0, 1.0 - sum(math.exp(min(0.0, tail[k])) for _, tail in held))
            if sum(weight) <= 0:
                return ()
            (e,) = rng.choices(own, weight)
            left = [(p, tail) for p, tail in left if p[k] == e]
            path.append(e)
            place = place + (e & 31) if far else int(self.target[e])
        return tuple(path)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(float) * 2.0**-52 + 2.0**-53


class Sampler:
    """Draws for many texts at a time."""

    def __init__(self, pieces: Pieces, samples: int = SAMPLES):
        self.pieces, self.samples = pieces, samples
        self.lattices = Lattices(pieces)

    def run(self, texts: list[str], seeds: list[int]) -> list[list[dict]]:
        parts = self.pieces.cut(texts)
        sizes = parts.counts
        if self.lattices.size > REMEMBERED_EDGES:
            self.lattices = Lattices(self.pieces)
        lattices = self.lattices
        token = lattices.number(parts)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(token)) - np.repeat(first, sizes)
        base = np.repeat(np.array([s & (2**64 - 1) for s in seeds], np.uint64), sizes)
        seed_of = lambda k: base + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((k * 0xABC98388FB8FAC03) % 2**64)
        states = [_Search(lattices, token[a : a + n], s, self.samples) for a, n, s in zip(first, sizes, seeds, strict=True)]
        for k in range(self.samples):
            wanted = [(i, s.next_start()) for i, s in enumerate(states)]
            wanted = [(i, w) for i, w in wanted if w is not None]
            if not wanted:
                break
            begin = np.array([first[i] + w for i, w in wanted], np.int64)
            count = np.array([sizes[i] - w for i, w in wanted], np.int64)
            at = ragged(begin, count)
            edges, counts, chance = lattices.draw(token[at], seed_of(k)[at])
            ends = np.cumsum(counts)
            done = np.cumsum(count)
            for (i, _), n, last in zip(wanted, count, done, strict=True):
                lo = ends[last - n - 1] if last - n else 0
                hi = ends[last - 1] if last else 0
                states[i].add(edges[lo:hi], counts[last - n : last], chance[last - n : last])
        out = [s.results() for s in states]
        lattices.forget()
        return out


class _Search:
    """Best-first search over one text. A node: (tokens before place as in a leaf, barred ways for the token at place)."""

    def __init__(self, lattices: Lattices, token: np.ndarray, seed: int, samples: int):
        self.lattices, self.token, self.seed, self.samples = lattices, token, seed, samples
        self.rng = np.random.default_rng(seed & (2**63 - 1))
        self.leaves: list[tuple] = []
        root = -np.log(-np.log(self.rng.random()))
        self.queue = [(-root, 0, 0, None, frozenset(), 0.0)]
        self.made = 0
        self.node = None

    def next_start(self) -> int | None:
        """Open the best node; the place from which its tokens are free, or None if there is no node."""
        if not self.queue:
            self.node = None
            return None
        self.node = heapq.heappop(self.queue)
        _, _, place, leaf, barred, _ = self.node
        if leaf is None:
            return 0
        self.other = self.lattices.draw_other(int(self.token[place]), (self.seed + len(self.leaves)) & (2**63 - 1), set(barred))
        return place + 1

    def add(self, edges: np.ndarray, counts: np.ndarray, chance: np.ndarray) -> None:
        minus, _, place, leaf, barred, _ = self.node
        if leaf is not None:
            old_edges, old_counts, old_chance = self.leaves[leaf][:3]
            here = self.lattices.chances(np.array(self.other, np.int64)).sum()
            edges = np.concatenate([old_edges[: old_counts[:place].sum()], np.array(self.other, np.int64), edges])
            counts = np.concatenate([old_counts[:place], [len(self.other)], counts])
            chance = np.concatenate([old_chance[:place], [here], chance])
        self.leaves.append((edges, counts, chance, -minus))
        n = len(self.token)
        if not n:
            return
        before = np.cumsum(chance) - chance
        free = -np.expm1(chance)
        if leaf is not None:
            gone = sum(float(np.exp(self.lattices.chances(np.array(p, np.int64)).sum())) for p in barred)
            free[place] -= gone
        at = np.arange(place, n)
        at = at[free[place:] > 1e-12]
        if len(at):
            mass = before[at] + np.log(free[at])
            bound = -minus  # the greatest of the rest stays below this leaf
            g = -np.logaddexp(-bound, np.log(self.rng.exponential(size=len(at))) - mass)
            most = min(self.samples, len(g))
            best = np.argpartition(-g, most - 1)[:most]
            starts = np.cumsum(counts) - counts
            for k in best.tolist():
                j = int(at[k])
                way = tuple(edges[starts[j] : starts[j] + counts[j]].tolist())
                self.made += 1
                heapq.heappush(self.queue, (-float(g[k]), self.made, j, len(self.leaves) - 1, (barred if j == place and leaf is not None else frozenset()) | {way}, 0.0))

    def results(self) -> list[dict]:
        limit = -self.queue[0][0] if self.queue else -np.inf
        out = []
        for rank, (edges, _, chance, g) in enumerate(self.leaves):
            logp = float(chance.sum())
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(50.0, logp - limit))))
            ids = self.lattices.ids_of(edges)
            out.append({"rank": rank, "log_prob": logp, "perturbed": float(g), "inclusion": inclusion, "ids": ids})
        return out


#: Columns of a sampled segmentation, in the order in which tasks make them.
_COLUMNS = "rank int, n_pieces int, log_prob double, perturbed double, inclusion double, ids_crc32 bigint, decoded boolean"

_NAMES = ("doc_id", *(c.split()[0] for c in _COLUMNS.split(", ")))


def _slices(keys: list, texts: pa.Array) -> Iterator[tuple[int, list[str], list[int]]]:
    """Runs of rows of about SLICE_BYTES bytes: number of the first, texts and seeds."""
    begin, size = 0, 0
    for n, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
        size += length or 0
        if size >= SLICE_BYTES or n == len(keys):
            yield begin, [t or "" for t in texts.slice(begin, n - begin).to_pylist()], [xxhash.xxh3_64_intdigest(str(k)) for k in keys[begin:n]]
            begin, size = n, 0


def _batch(ids: pa.Array, found: list[list[dict]], texts: list[str], pieces: Pieces, schema: pa.Schema, with_ids: bool) -> pa.RecordBatch:
    """The rows of a slice, piece ids in one buffer."""
    flat = [f for r in found for f in r]
    owner = np.repeat(np.arange(len(found)), [len(r) for r in found])
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    columns = [ids.take(pa.array(owner)), pa.array([f["rank"] for f in flat], pa.int32()), pa.array([len(f["ids"]) for f in flat], pa.int32())]
    columns += [pa.array([f[k] for f in flat], pa.float64()) for k in ("log_prob", "perturbed", "inclusion")]
    columns += [pa.array([zlib.crc32(f["ids"].astype("<i4").tobytes()) for f in flat], pa.int64()), pa.array([pieces.decode(f["ids"]) == data[k] for f, k in zip(flat, owner, strict=True)], pa.bool_())]
    if with_ids:
        ends = np.cumsum([0, *[len(f["ids"]) for f in flat]]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f["ids"] for f in flat]) if flat else np.zeros(0, np.int32))))
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sample_segmentations(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """A row for each text and sample: doc_id, rank, n_pieces, log_prob, perturbed, inclusion, ids_crc32, decoded[, ids].

    ids decode to the whole text (``decoded``). A text with fewer segmentations than samples has all
    of them, with inclusion 1; a null or empty text has one without pieces. Draws depend on key and
    text alone, so repeated rows get equal ones; null keys share a seed. Other columns are left out.
    No rows in, none out. A task holds the rows of one slice of texts at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    shape = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}" + (", ids array<int>" if with_ids else "")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value, samples)
        for batch in batches:
            ids, keys, texts = batch.columns
            for begin, part, seeds in _slices(keys.to_pylist(), texts):
                found = sampler.run(part, seeds)
                kinds = [ids.type, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                schema = pa.schema(list(zip([*_NAMES, "ids"], kinds, strict=True))[: 9 if with_ids else 8])
                yield _batch(ids.slice(begin, len(part)), found, part, sampler.pieces, schema, with_ids)

    return slim.mapInArrow(sample, shape)


def decode(pieces: Pieces, ids: list[int]) -> str:
    return pieces.decode(np.array(ids, np.int64)).decode("utf-8", "replace")
