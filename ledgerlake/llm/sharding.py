"""Sharding: rendezvous hashing of record keys over weighted shards (operator 6, native).

Each shard bids for a key with -weight / ln(u), u in (0, 1) drawn from a digest of key and shard;
the highest bid wins. A further shard changes no other bid, so rows move only into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialised

SHARDS = 24
#: Rows of a shard are numbered in so many buckets, each by itself.
BUCKETS = 4096
LAW = "key"


def _draw(key: Column, shard: int) -> Column:
    """52 bits of an md5 as an exact number in (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(shard)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def best_bid(key: Column, weights: Sequence[float], even: bool, first: int = 0) -> Column:
    """Struct bid, shard of the highest bid among shards from number ``first`` on; of equal bids the higher number."""
    bids = [F.struct((_draw(key, s) if even else -float(w) / F.ln(_draw(key, s))).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights, first)]
    return F.greatest(*bids) if len(bids) > 1 else bids[0]


def _is_even(weights: Sequence[float]) -> bool:
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return min(weights) == max(weights)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the highest bid. Weights must be positive.

    A null key bids as the empty text does. With equal weights the draws themselves are compared,
    which orders them alike and needs no logarithm.
    """
    return best_bid(key, weights, _is_even(weights))["shard"]


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, shard: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` and the shard of each; a column of that name is replaced, so name another one to keep it.

    Null keys go to the shard of the empty text; equal keys go to one shard. No rows in, none out.
    """
    return df.withColumn(shard, winner(F.col(key), weights))


def shard_layout(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots number the rows of a shard from 0 without a gap, by bucket, key, size and checksum, the
    same on every run and layout. Null texts count as empty; null keys go to one shard. Rows that
    are alike in all of these are counted where they are read and numbered as a range, and others of
    one key fall into different buckets, so a key that a third of all rows share needs no large group.
    No rows in, none out.
    """
    grown = list(weights) + [sum(weights) / len(weights)] if grown is None else grown
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"),
    )
    # by size and checksum too, so that different texts of one key are spread over the buckets
    alike = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("text_crc32"))
    bucket = F.conv(F.substring(F.md5(alike.cast("binary")), 1, 3), 16, 10).cast("int")
    # bids are made where rows are read; further shards bid against the best so far
    same = _is_even(grown) == _is_even(weights) and list(grown[: len(weights)]) == list(weights) and len(grown) > len(weights)
    bids = slim.withColumn("best", best_bid(F.col("doc_id"), weights, _is_even(weights)))
    more = F.greatest("best", best_bid(F.col("doc_id"), grown[len(weights) :], _is_even(grown), len(weights)))["shard"] if same else winner(F.col("doc_id"), grown)
    bids = bids.select("doc_id", "size", "text_crc32", "part", F.col("best.shard").alias("shard"), more.alias("grown_shard"))
    counted = bids.groupBy("doc_id", "size", "text_crc32", "part", "shard", "grown_shard").agg(F.count("*").alias("n"))
    placed = materialised(counted.withColumn("bucket", bucket))
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))  # shards x BUCKETS rows at most
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(within), F.lit(0))
    ranged = placed.withColumn("first", first).join(F.broadcast(starts), ["shard", "bucket"]).withColumn("first", F.col("first") + F.col("start"))
    slots = ranged.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
