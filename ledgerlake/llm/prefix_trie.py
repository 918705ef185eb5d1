"""Prefix tries of conversations that share their first turns (operator 13).

The turns of a conversation are numbered and hashed by prefix in blocks, so that a long conversation
needs no large group; a prefix's hash names its node, and conversations alike are counted where they
are read. The nodes are dealt by the hash of their first turn; a group is a pointer trie in a
dictionary, summed in postorder. A first turn with too many nodes is followed to the first depth at which
its conversations part, and each of their next turns is a subtrie of its own, again and again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialised

#: Conversation c starts with up to MOST_HEAD turns of conversation c - c % FAMILY.
FAMILY, MOST_HEAD = 5, 8
#: Nodes of a subtrie that one task builds, and turns whose prefixes are hashed together.
MAX_NODES = 50_000
BLOCK = 1_024
#: Bits of conversation ids that are listed together before they are hashed.
LIST_BITS = 12
_ID, _TOP = ["a", "b"], ["ta", "tb"]
_STATS = "a bigint, b bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def numbered_turns(df: DataFrame) -> DataFrame:
    """conv, k from 1, digest and bytes of each turn; of equal turns, by the digest of role and text, and rows alike in any order.

    Rows are dealt by ranges of that order, numbered in each range and counted on from range to range.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    slim = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", F.md5(F.concat(F.md5(full("role")), F.md5(full("text"))).cast("binary")).alias("digest"),
        F.octet_length(full("text")).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("place")]
    dealt = materialised(slim.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv", "part", "before")
    number = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) + F.coalesce(F.col("before"), F.lit(0))
    # a range has one conversation at most that began in an earlier one, so there are as many rows as ranges
    return dealt.join(F.broadcast(earlier), ["conv", "part"], "left").select("conv", number.alias("k"), "digest", "bytes")


def rebuilt_lengths(turns: DataFrame) -> DataFrame:
    """conv, base, h, shared and length: how many turns come from the base conversation, and how many there are then."""
    counts = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_HEAD + 1)).alias("h")
    own = counts.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), h)
    based = own.join(counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    return based.select("conv", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefix_rows(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, pos, length, bytes, node (a, b) and parent (pa, pb) of each turn of the rebuilt conversations.

    A node is named by two 64-bit lanes: the XOR of hashes of place and digest of each of its turns; the root is (0, 0).
    """
    heads = turns.where(F.col("k") <= MOST_HEAD).withColumnRenamed("conv", "base")
    first = lengths.where("shared > 0").join(heads, "base").where("k <= h").select("conv", F.col("k").alias("pos"), "digest", "bytes", "length")
    rest = turns.join(lengths, "conv").where("k > h").select("conv", (F.col("shared") + F.col("k") - F.col("h")).alias("pos"), "digest", "bytes", "length")
    lanes = first.unionByName(rest).select("conv", "pos", "bytes", "length", F.xxhash64("pos", "digest").alias("la"), F.xxhash64("digest", "pos", F.lit(1)).alias("lb"), F.floor((F.col("pos") - 1) / block).alias("block"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lanes.withColumn("xa", F.bit_xor("la").over(upto)).withColumn("xb", F.bit_xor("lb").over(upto))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lanes.where(F.col("length") > block).groupBy("conv", "block").agg(F.bit_xor("la").alias("la"), F.bit_xor("lb").alias("lb"))
    starts = blocks.select("conv", "block", F.bit_xor("la").over(before).alias("sa"), F.bit_xor("lb").over(before).alias("sb"))
    lane = lambda s, x: F.coalesce(F.col(s), F.lit(0)).bitwiseXOR(F.col(x))
    named = inside.join(starts, ["conv", "block"], "left").select("conv", "pos", "length", "bytes", "la", "lb", lane("sa", "xa").alias("a"), lane("sb", "xb").alias("b"))
    return named.select("conv", "pos", "length", "bytes", *_ID, F.col("a").bitwiseXOR(F.col("la")).alias("pa"), F.col("b").bitwiseXOR(F.col("lb")).alias("pb"))


def build_tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of whole subtries with their sums: a dictionary of nodes with pointers to their children, summed from the leaves up."""
    columns = {c: pdf[c].tolist() for c in ("a", "b", "pa", "pb", "conv_id", "n_convs", "bytes", "above")}
    places = {x: i for i, x in enumerate(zip(columns["a"], columns["b"], strict=True))}
    children: list[list[int]] = [[] for _ in places]
    above, todo = columns["above"], []
    for i, parent in enumerate(zip(columns["pa"], columns["pb"], strict=True)):
        p = places.get(parent)
        if p is None:
            todo.append((i, False))
        else:
            children[p].append(i)
            above[i] = columns["conv_id"][p]
    leaves, saved = [0] * len(places), [0] * len(places)
    while todo:
        i, below = todo.pop()
        if not below:
            todo.append((i, True))
            todo += [(c, False) for c in children[i]]
            continue
        leaves[i] = sum(leaves[c] for c in children[i]) or 1
        saved[i] = sum(saved[c] for c in children[i]) + (columns["n_convs"][i] - 1) * columns["bytes"][i]
    return pd.DataFrame({
        "a": columns["a"], "b": columns["b"], "conv_id": columns["conv_id"], "depth": pdf["depth"].to_numpy(), "parent_conv_id": above, "n_convs": columns["n_convs"],
        "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved,
    })


def _tries(nodes: DataFrame, n_nodes: int, most: int) -> DataFrame:
    """Subtries by the hash of their top, about ``most`` / 2 nodes together."""
    groups = max(1, 2 * n_nodes // most)
    return nodes.withColumn("bucket", F.pmod(F.xxhash64(*_TOP), F.lit(groups))).groupBy("bucket").applyInPandas(build_tries, _STATS)


def _followed(own: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of subtries too large for a task: the stats of the nodes before the first fork, and the nodes from there on as subtries of the next turn."""
    worth = (F.col("n_convs") - 1) * F.col("bytes")
    depths = own.groupBy(*_TOP, "depth").agg(F.count("*").alias("n"))
    forks = depths.where("n > 1").groupBy(*_TOP).agg(F.min("depth").alias("fork"), F.min_by("n", "depth").alias("branches"))
    leaves = own.join(own.select(F.col("pa").alias("a"), F.col("pb").alias("b")), _ID, "left_anti").groupBy(*_TOP).agg(F.count("*").alias("n_leaves"))
    sums = own.groupBy(*_TOP).agg(F.sum(worth).alias("total"), F.max("depth").alias("deepest")).join(leaves, _TOP).join(forks, _TOP, "left")
    told = materialised(sums)  # a row for each large subtrie
    marked = own.join(told, _TOP)
    chain = Window.partitionBy(*_TOP).orderBy("depth")
    spent = F.coalesce(F.sum(worth).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("depth") == F.coalesce(F.col("fork") - 1, F.col("deepest"))
    line = marked.where(F.col("fork").isNull() | (F.col("depth") < F.col("fork")))
    stats = line.select(
        *_ID, "conv_id", "depth", F.coalesce(F.lag("conv_id").over(chain), "above").alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("branches", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"), "n_leaves", (F.col("total") - spent).alias("saved_tokens"),
    )
    ends = line.where(last & F.col("fork").isNotNull()).select(*_TOP, F.col("conv_id").alias("next_above"))
    beyond = marked.where(F.col("depth") >= F.col("fork")).join(ends, _TOP)
    tops = rows.select(F.col("conv").alias("conv_id"), F.col("pos").alias("fork"), F.col("a").alias("na"), F.col("b").alias("nb"))
    kept = [c for c in own.columns if c not in (*_TOP, "above")]
    return stats, beyond.join(tops, ["conv_id", "fork"]).select(*kept, F.col("na").alias("ta"), F.col("nb").alias("tb"), F.col("next_above").alias("above"))


def node_stats(rows: DataFrame, root_conv: int, most: int = MAX_NODES) -> DataFrame:
    """_STATS of all nodes but the root."""
    nodes = rows.groupBy(*_ID).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(n) for c, n in (("pos", "depth"), ("bytes", "bytes"), ("pa", "pa"), ("pb", "pb"))])
    firsts = rows.where("pos = 1").select(F.col("conv").alias("conv_id"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    nodes = materialised(nodes.join(firsts, "conv_id").withColumn("above", F.lit(root_conv).cast("bigint")))
    done = []
    while True:
        sizes = nodes.groupBy(*_TOP).agg(F.count("*").alias("n"))
        large = F.col("n") > most
        seen = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("large")).first()
        if not seen["large"]:
            done.append(_tries(nodes, seen["all"], most))
            break
        over = sizes.where(large).select(*_TOP)
        done.append(_tries(nodes.join(over, _TOP, "left_anti"), seen["all"] - seen["large"], most))
        stats, nodes = _followed(materialised(nodes.join(over, _TOP, "left_semi")), rows)
        done.append(stats)
        nodes = materialised(nodes)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ends_digests(rows: DataFrame, lengths: DataFrame, bits: int = LIST_BITS) -> DataFrame:
    """a, b and ends_sha256 of the nodes at which conversations end: ids in lists of 2 ** bits numbers, and these hashed in order as they come."""
    ends = rows.where("pos = length").select(*_ID, "conv").unionByName(lengths.where("length = 0").select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "conv"))
    lists = ends.groupBy(*_ID, F.shiftright("conv", bits).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _told(out)
        if now is not None:
            yield _told([(*now, digest.hexdigest())])

    return lists.repartition(*_ID).sortWithinPartitions(*_ID, "part").mapInArrow(work, "a bigint, b bigint, ends_sha256 string")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(kinds.names)}, kinds)


def prefix_nodes(df: DataFrame, most: int = MAX_NODES, block: int = BLOCK, bits: int = LIST_BITS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node, the root among them.

    ``df`` has conv_id, turn, role and text; other columns aren't read. Null roles and texts count as
    empty, null turns come first, equal turns in the order of a digest of role and text, repeated rows are
    turns of their own, and rows without a conv_id belong to no conversation. No conversation, no row.
    Two prefixes are taken for one where 128 bits of hash agree.
    """
    turns = materialised(numbered_turns(df))
    lengths = materialised(rebuilt_lengths(turns))
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    if not whole["n"]:
        return df.sparkSession.createDataFrame([], _STATS).drop(*_ID).withColumn("ends_sha256", F.lit(""))
    rows = materialised(prefix_rows(turns, lengths, block))
    stats = materialised(node_stats(rows, whole["conv"], most))
    long = lambda v, name: F.lit(v).cast("bigint").alias(name)
    root = stats.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    told = root.select(long(0, "a"), long(0, "b"), long(whole["conv"], "conv_id"), long(0, "depth"), long(None, "parent_conv_id"), long(whole["n"], "n_convs"), "n_children", "n_leaves", "saved_tokens")
    nothing = hashlib.sha256(b"").hexdigest()
    both = stats.unionByName(told).join(ends_digests(rows, lengths, bits), _ID, "left")
    return both.drop(*_ID).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
