"""MinHash near-duplicates by HyperMinHash (operator 8).

A text's set of word shingles is hashed into K buckets; a register keeps of each bucket's
least value the count of leading zeros and some mantissa bits. Texts with equal sets are one
class. Bands of registers bring classes together; a member is compared with the least one of its bands, the
pivot, that shares most bands with it: the register estimate, corrected for chance collisions, drops far pairs,
and full sets confirm the rest. Bands whose members are still in several components join these to groups, and there
the members outside the main component are compared on full sets with all, in blocks, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, stored

ZERO_BITS, MANTISSA = 6, 10
#: Standard errors below the threshold at which an estimate drops a pair.
SLACK = 5.0
#: Needed texts are found by a broadcast list of ids up to so many, by a shuffle beyond.
BROADCAST_IDS = 100_000
#: Rows and bytes of sets in a block of members that are compared with another block.
BLOCK_ROWS, BLOCK_BYTES = 512, 4_000_000
#: Rows of a pair of ids in a task.
ROWS_A_TASK = 100_000
#: Components of links up to so many (16 bytes each) are found in one task, by rounds of joins beyond.
ONE_TASK = 200_000
#: Parts of a group in joins with its figures.
SALTS = 32
REMEMBERED = 150_000

_SCALE = np.random.default_rng(2).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOW32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Plan:
    """shingle: words; similarity: least Jaccard, in hundredths; bands of rows registers."""

    shingle: int
    similarity: int
    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_set(self) -> int:
        """Smaller sets can only be linked with equal ones."""
        return math.ceil(self.similarity / (100 - self.similarity)) if self.similarity < 100 else 1 << 60


def plan_for(shingle: int = 5, similarity: int = 80, most: int = 400, missed: float = 3e-6) -> Plan:
    """The longest bands with which a pair at the threshold shares none in ``missed`` cases at most."""
    s = similarity / 100
    for rows in range(16, 0, -1):
        if s == 1 or (1 - s**rows) ** (most // rows) <= missed:
            return Plan(shingle, similarity, most // rows, rows)
    return Plan(shingle, similarity, most, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(data: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct shingles; under k words the whole sequence is one."""
    words = data.translate(_LOWER).split()
    n = len(words) - k + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += codes[j : j + n] * _SCALE[j]
    return np.unique(_mix(out))


def _probes(registers: int) -> np.ndarray:
    return np.random.default_rng(3).integers(0, registers, (32, registers))


def registers_of(shingles: np.ndarray, count: int, probes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers; an empty one borrows from a filled one that its probes find, the last from the next."""
    high = (shingles >> np.uint64(32)) * np.uint64(count)
    bucket = (high >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the set is sorted, so a bucket's first is its least
    mantissa, exponent = np.frexp((high[first] & _LOW32).astype(float))
    zeros = np.where(exponent > 0, 32 - exponent, 32)
    tail = ((2 * mantissa - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)
    out = np.full(count, -1, np.int64)
    out[bucket[first]] = (zeros << MANTISSA) | tail
    filled = out >= 0
    own, empty = out.copy(), np.flatnonzero(~filled)
    for probe in probes:
        if not len(empty):
            break
        source = probe[empty]
        ok = filled[source]
        out[empty[ok]] = own[source[ok]]
        empty = empty[~ok]
    if len(empty):
        have = np.flatnonzero(filled)
        out[empty] = own[have[np.searchsorted(have, empty) % len(have)]]
    return out.astype(np.uint16)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers (pairs, K), less what unequal sets share by chance."""
    count = a.shape[1]
    level = np.arange(0, 33)

    def shares(n: np.ndarray) -> np.ndarray:
        m = np.maximum(n / count, 1.0)[:, None]
        return (1 - 2.0 ** -(level + 1)) ** m - (1 - 2.0**-level) ** m

    chance = (shares(na) * shares(nb)).sum(1) / (1 << MANTISSA)
    return ((a == b).mean(1) - chance) / (1 - chance)


_FEATURES = "struct<n_shingles: bigint, digest: binary, registers: binary>"


def shingle_features(text: Column, plan: Plan) -> Column:
    """Set size, 128-bit digest of the set and registers of a text; registers are empty for sets under least_set."""

    @F.arrow_udf(_FEATURES)
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, probes = WordHashes(), _probes(plan.registers)
        for values in batches:
            sizes, digests, registers = [], [], []
            for v in values.cast(pa.large_binary()):
                s = shingle_set(v.as_py() or b"", plan.shingle, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                registers.append(registers_of(s, plan.registers, probes).tobytes() if len(s) >= plan.least_set else b"")
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["n_shingles", "digest", "registers"])

    return features(text)


def _stack(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(len(values), -1)


def band_keys(registers: Column, plan: Plan) -> Column:
    @F.arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            r = _stack(values).reshape(len(values), plan.bands, plan.rows).astype(np.uint64) if len(values) else np.zeros((0, plan.bands, plan.rows), np.uint64)
            mixed = np.broadcast_to(_SCALE[100 : 100 + plan.bands], (len(values), plan.bands)).copy()
            for j in range(plan.rows):
                mixed = _mix(mixed + (r[:, :, j] + np.uint64(1)) * _SCALE[j])
            offsets = np.arange(0, len(values) * plan.bands + 1, plan.bands, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(mixed.view(np.int64).ravel()))

    return keys(registers)


def _estimated(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) that sizes and registers don't rule out, with the estimate."""

    @F.arrow_udf("double")
    def estimate(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        if not len(ra):
            return pa.array([], pa.float64())
        return pa.array(estimates(_stack(ra), _stack(rb), na.to_numpy(False).astype(float), nb.to_numpy(False).astype(float)))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("na", "nb") >= plan.similarity * F.greatest("na", "nb"))
    s = plan.similarity / 100
    error = F.sqrt(F.lit(s * (1 - s)) / F.least(F.lit(plan.registers), F.col("na"), F.col("nb")))
    return both.withColumn("estimate", estimate.asNondeterministic()("ra", "rb", "na", "nb")).where(F.col("estimate") >= s - SLACK * error).select("a", "b", "estimate")


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """node, items (the full set as bytes) of the wanted nodes, built anew from their texts."""
    needed, told = stored(wanted.select("node").distinct().join(nodes.select("node", "digest", F.col("doc_id").alias("id"), "text_hash"), "node"))
    if told["rows"] <= BROADCAST_IDS:
        needed = F.broadcast(needed)

    @F.arrow_udf("struct<digest: binary, items: binary>")
    def whole_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for values in batches:
            sets = [shingle_set(v.as_py() or b"", plan.shingle, hashes).tobytes() for v in values.cast(pa.large_binary())]
            yield pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "items"])

    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(needed, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("id")))
    # marked so that the filter stays above it: as a join key it would run over all texts
    found = placed.withColumn("set", whole_set.asNondeterministic()("text")).where(F.col("set.digest") == F.col("digest"))
    return materialised(found.select("node", F.col("set.items").alias("items")).dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            merged = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q)])
            merged.sort(kind="stable")
            shared = int((merged[1:] == merged[:-1]).sum())
            out.append(100 * shared >= plan.similarity * (len(merged) - shared))
        return pa.array(out, pa.bool_())

    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, plan)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"s{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(similar("sa", "sb")).select("a", "b")


def _compact(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of ids in partitions enough for its rows, so that small ones don't become many tasks and files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK)))


def _unsized(df: DataFrame) -> DataFrame:
    """A stored table of ids whose size Spark takes as unknown.

    Spark takes a stored table for as large as what it was made from, and a join for the product of its sides: in rounds
    of joins this number has twice the digits after each, until the driver's memory is full of them.
    """
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), session)


# Tables of ids are joined by merge below: a small one would else go through the driver in every round.


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = np.minimum(new[new], new[label])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(links: DataFrame) -> DataFrame:
    """node, label of every node of at most ONE_TASK stored links."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            node, label = components(*(np.concatenate(side) for side in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_pydict({"node": node, "label": label})

    return _unsized(materialised(links.select("a", "b").coalesce(1).mapInArrow(find, "node bigint, label bigint")))


def connected(links: DataFrame) -> DataFrame:
    """node, label of every node of the links (a, b): label is the least node of its component."""
    links, told = stored(links.select("a", "b"))
    if told["rows"] <= ONE_TASK:
        return _in_one_task(links)
    both, told = stored(links.union(links.select("b", "a")).where("a != b").distinct())
    both = _compact(_unsized(both), told["rows"])
    labels = _unsized(materialised(_compact(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).select("node", "label"), told["rows"])))
    while True:  # as often as the longest chain of links halves
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("bigint").alias("old"))
        nearer = labels.select("node", "label", F.col("label").alias("old")).union(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = nearer.join(jump.hint("merge"), "label").select("node", "old", F.least("label", "next").alias("label"))
        moved, seen = stored(_compact(moved, told["rows"]), changed=F.col("old") != F.col("label"))
        labels = _unsized(moved.select("node", "label"))
        if not seen["changed"]:
            return labels


def rooted(nodes: DataFrame, rows: int, links: DataFrame) -> DataFrame:
    """node, label of all nodes: where the chain of links (a, b) from b to a smaller a ends. Each node is the b of one link at most."""
    links = _unsized(materialised(links.select("a", "b")))
    if 2 * rows <= ONE_TASK:
        return _in_one_task(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).union(links.select("a", "b")))
    labels = nodes.join(links.select("a", F.col("b").alias("node")).hint("merge"), "node", "left").select("node", F.coalesce("a", "node").alias("label"))
    labels = _unsized(materialised(_compact(labels, rows)))
    while True:  # as often as the longest chain halves
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = labels.join(jump.hint("merge"), "label").select("node", F.col("label").alias("old"), F.col("next").alias("label"))
        moved, seen = stored(_compact(moved, rows), changed=F.col("old") != F.col("label"))
        labels = _unsized(moved.select("node", "label"))
        if not seen["changed"]:
            return labels


def _merged(labels: DataFrame, rows: int, links: DataFrame) -> DataFrame:
    """labels (node, label; so many rows) after the links between nodes are added. A label is its component's least node."""
    links, told = stored(links)
    links = _unsized(links)
    if rows + told["rows"] <= ONE_TASK:
        return _in_one_task(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links.select("a", "b")))
    one, two = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    between = links.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = connected(between)
    new = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return _unsized(materialised(_compact(labels.join(new.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), rows)))


def near_duplicates(docs: DataFrame, plan: Plan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every whole text.

    Words are runs without ASCII white space, A-Z in lower case. component_id is the least doc_id
    that links reach. Texts without words (null, empty, white space) have no shingles and are
    linked with nothing; each is its own component. Repeated rows are linked by their equal text. A
    null doc_id takes the component's least id, or null, and isn't kept. Other columns are left
    out. No rows in, none out.
    """
    plan = plan or plan_for()
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    seen = materialised(slim.select("doc_id", F.xxhash64("text").alias("text_hash"), shingle_features(F.col("text"), plan).alias("f")).select("doc_id", "text_hash", "f.*"))
    classes = seen.where("n_shingles > 0").groupBy("digest", "n_shingles", "registers").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"))
    nodes = materialised(classes.withColumn("node", F.monotonically_increasing_id()))
    linked = _components(slim, nodes, plan)
    ids = nodes.select("digest", "node", F.col("doc_id").alias("least"))
    if linked is not None:
        ids = materialised(ids.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node")))
        ids = ids.join(materialised(ids.groupBy("label").agg(F.min("least").alias("component"))), "label")
    else:
        ids = ids.withColumn("component", F.col("least"))
    out = seen.select("doc_id", "n_shingles", "digest").join(ids.select("digest", "component"), "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _components(slim: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame | None:
    """node, label of the nodes that share a band with another; None if none does."""
    signed = nodes.where(F.length("registers") > 0)
    bands = signed.select(F.explode(band_keys(F.col("registers"), plan)).alias("band"), "node")
    # stored, so that a hot band's partition can be split in the join where the bands are too many to broadcast
    shared, told = stored(bands.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot != other").select("band", "pivot"))
    if told["rows"] == 0:
        return None
    if told["rows"] <= BROADCAST_IDS:
        shared = F.broadcast(shared)
    members, told = stored(bands.join(shared, "band"))
    members = _compact(members, told["rows"])
    alike, told = stored(members.select("node").distinct())
    rows = told["rows"]
    alike = _compact(alike, rows)
    signed = materialised(signed.join(alike, "node"))
    # of a node's pivots the one with most bands in common
    common = members.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    best = materialised(_compact(common.groupBy(F.col("node").alias("b")).agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("a")).select("a", "b"), rows))
    labels = rooted(alike, rows, _confirmed(_estimated(best, signed, plan), signed, slim, plan))
    known = F.broadcast(labels) if rows <= BROADCAST_IDS else labels
    tagged = members.select("band", "node").join(known, "node")
    mixed, told = stored(tagged.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band", "low"))
    if told["rows"] == 0:
        return labels
    if told["rows"] <= BROADCAST_IDS:
        mixed = F.broadcast(mixed)
    open_, told = stored(tagged.join(mixed, "band").select("node", "label", "low").distinct())
    open_ = _compact(open_, told["rows"])
    groups = connected(open_.where("low != label").select(F.col("low").alias("a"), F.col("label").alias("b")).distinct())
    return _merged(labels, rows, _links_left(open_.select("node", "label").distinct(), groups, signed, slim, plan))


def block_links(xs: list[dict], ys: list[dict], similarity: int) -> list[tuple[int, int]]:
    """Links of outside members xs with members ys that have a band in common and another label; two outside ones are compared once.

    A link between labels that the links before it join already is left out, so there are fewer than labels.
    """
    out = []
    if not xs or not ys:
        return out
    sets = [np.frombuffer(y["items"], np.uint64) for y in ys]
    sizes = np.array([len(s) for s in sets])
    labels, keys = np.array([y["label"] for y in ys]), np.array([y["keys"] for y in ys], np.int64)
    nodes, outside = np.array([y["node"] for y in ys]), np.array([y["outside"] for y in ys])
    known, at = np.unique(np.concatenate([labels, [x["label"] for x in xs]]), return_inverse=True)
    root, of, own = np.arange(len(known)), at[: len(ys)], at[len(ys) :].tolist()
    owners, merged = np.repeat(np.arange(len(ys)), sizes), np.concatenate(sets)
    order = np.argsort(merged, kind="stable")
    owners, merged = owners[order], merged[order]
    for x, label in zip(xs, own, strict=True):
        mine = np.frombuffer(x["items"], np.uint64)
        wanted = (root[of] != root[label]) & (100 * np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine)))
        wanted &= ~outside | (nodes > x["node"])
        wanted[wanted] = (keys[wanted] == np.array(x["keys"], np.int64)).any(1)
        if not wanted.any():
            continue
        low, high = np.searchsorted(merged, mine, "left"), np.searchsorted(merged, mine, "right")
        spans = high - low
        at = np.repeat(low - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        shared = np.bincount(owners[at], minlength=len(ys))
        linked = np.flatnonzero(wanted & (100 * shared >= similarity * (sizes + len(mine) - shared)))
        roots, first = np.unique(root[of[linked]], return_index=True)
        out += [(x["node"], ys[k]["node"]) for k in linked[first].tolist()]
        root[np.isin(root, roots)] = root[label]
    return out


def _with_group(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """``rows`` with their group's one row of ``per_group``; SALTS copies of it, so that no task gets a whole large group.

    Joined by merge: Spark takes the copies for as large as what they are made from, and would send them all through the driver.
    """
    salted = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["group", "salt"]).drop("salt")


def _links_left(open_: DataFrame, groups: DataFrame, nodes: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between labels of one group; open_: the nodes in a band with several labels, groups: the labels that chains of these bands join.

    Of each two labels one at least isn't the group's main one. Its nodes, the outside
    ones, are compared on full sets with all of the group, in blocks of bounded size.
    """

    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def links(xs: pa.Array, ys: pa.Array) -> pa.Array:
        rows = [[{"a": a, "b": b} for a, b in block_links(x.as_py(), y.as_py(), plan.similarity)] for x, y in zip(xs, ys, strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    of = groups.select(F.col("node").alias("label"), F.col("label").alias("group"))
    marked = materialised(open_.join(of, "label").join(nodes.select("node", "n_shingles"), "node"))
    sizes = marked.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
    mixed = sizes.groupBy("group").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"),
        F.ceil(F.greatest(F.sum("n") / BLOCK_ROWS, F.sum("items") * 8 / BLOCK_BYTES)).alias("blocks"),
    ).where("labels > 1")
    open_ = materialised(_with_group(marked, mixed).select("node", "group", "label", (F.col("label") != F.col("main")).alias("outside"), F.pmod(F.xxhash64("node"), "blocks").alias("block")))
    keyed = open_.join(nodes.select("node", "registers"), "node").withColumn("keys", band_keys(F.col("registers"), plan))
    member = F.struct("node", "label", "outside", "keys", "items")
    dealt = keyed.join(_sets(open_, nodes, docs, plan), "node").groupBy("group", "block").agg(F.collect_list(member).alias("ys"), F.collect_list(F.when(F.col("outside"), member)).alias("xs"))
    blocks = materialised(dealt)
    xs = blocks.where(F.size("xs") > 0).select("group", F.col("block").alias("x"), "xs")
    pairs = xs.select("group", "x").join(blocks.select("group", F.col("block").alias("y")), "group")
    both = pairs.join(blocks.select("group", F.col("block").alias("y"), "ys"), ["group", "y"]).join(xs, ["group", "x"])
    return both.select(F.explode(links("xs", "ys")).alias("l")).select("l.*").distinct()


def one_of_each(docs: DataFrame, plan: Plan | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs``, with all columns, for each component: the first by id, then by place.

    Null, empty and blank texts are alike to none, so all of them stay. Of repeated rows one stays, and of equal ids
    the first in the table's order. A null id comes after all others. No rows in, none out. The rows are checkpointed with their places, which a scan that
    is planned anew (with another count of cores, say) would give to other rows.
    """
    place = "_place"
    while place in docs.columns:
        place += "_"
    placed = materialised(docs.withColumn(place, F.monotonically_increasing_id()))
    ranked = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), F.col(place).alias("place"))
    found = near_duplicates(placed.select(ranked.alias("doc_id"), F.col(f"`{text}`").alias("text")), plan)
    gone, told = stored(found.where("not kept").select(F.col("doc_id.place").alias(place)))
    if told["rows"] <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return placed.join(gone, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
