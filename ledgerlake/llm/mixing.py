"""Mixing sources to target weights by hash-threshold histograms (operator 12).

A source whose target is r times its size is taken floor(r) times whole, and once more below a
threshold of a hash. The threshold is found by a histogram of sizes over buckets of the hash; only
the bucket in which the budget ends is looked at more closely, and no row is sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialised, shared_folder

WEIGHTS = (5.0, 2.0, 1.0)
#: Nothing is taken more than so many times.
MOST = 3
WORD, BLANK = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
#: Hexadecimal digits of the hash of a row's content, of the hash that parts rows alike, and of a step of the histogram.
CONTENT, PLACE, STEP = 16, 16, 2


def n_words(text: Column) -> Column:
    """Number of words; null has none. Each word becomes one letter first, so that no list of words is made."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BLANK, "")).cast("long")


def _written(df: DataFrame, folder: str) -> DataFrame:
    """df in a new table of the shared folder: small tables whose size Catalyst then knows, so that it broadcasts those only that are small."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, place in the order of sources (null last), size, and the hash that orders the rows of a source.

    The hash is of id and text, and then of the row's place, which parts rows that are alike.
    """
    named = F.col(f"`{source}`").cast("string")
    alike = F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).cast("binary"))
    place = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), named), F.lit("-")).alias("sk"), n_words(F.col(f"`{text}`")).alias("size"),
        F.concat(F.left(alike, F.lit(CONTENT)), F.left(place, F.lit(PLACE))).alias("mark"),
    )


def numbered_sources(rows: DataFrame, folder: str) -> DataFrame:
    """sk, source_size and number from 0 of each source: dealt by ranges of the name, numbered in each range, and counted on from range to range."""
    dealt = _written(rows.groupBy("sk").agg(F.sum("size").alias("source_size")).repartitionByRange("sk").withColumn("part", F.spark_partition_id()), folder)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("sk")) - 1 + F.col("before")
    return dealt.join(before, "part").select("sk", "source_size", number.alias("number"))


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources and their target: shares by weight of all sizes, none above ``most`` times its own; what is cut off there goes to the others by weight.

    A target is least(level * weight, most * size). The level rises as sources reach their bound; each
    round is one sum over the sources, until no further one does.
    """
    weighted = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))).withColumn("bound", (F.col("source_size") * most).cast("double"))
    level, full = 0.0, -1
    while True:
        above = F.col("bound") < F.lit(level) * F.col("weight")
        r = weighted.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("full"),
        ).first()
        if r["full"] == full or not r["open"]:
            break
        level, full = (r["all"] - r["given"]) / r["open"], r["full"]
    return weighted.select("sk", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("bound")).alias("target"))


def cut_sources(rows: DataFrame, sources: DataFrame, folder: str) -> DataFrame:
    """sources and copies, cut and with_cut: each row is taken ``copies`` times, and once more if its mark is below the cut, or at it and with_cut.

    The sum below the cut is the nearest to what is left of the target that whole rows give; of two as near the smaller.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    left = F.col("target") - F.col("copies") * F.col("source_size")
    state = sources.withColumn("copies", copies).withColumn("left", left).select("*", F.lit("").alias("prefix"), (F.col("left") <= 0).alias("done"), F.when(F.col("left") <= 0, "").alias("cut"), F.lit(False).alias("with_cut"))
    state, rows, looked = _written(state, folder), rows.where("size > 0"), 0
    while not state.where("not done").isEmpty():
        aim = state.where("not done").select("sk", "prefix", "left")
        inside = rows.join(aim, "sk").where(F.col("mark").startswith(F.col("prefix")))
        if looked == 1:  # from now on only the rows of the buckets in which budgets end
            rows = materialised(inside.select("sk", "size", "mark"))
            inside = rows.join(aim, "sk")
        bucket = F.substring("mark", F.length("prefix") + 1, F.lit(STEP))
        sums = inside.groupBy("sk", "left", bucket.alias("bucket")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"))
        upto = F.sum("s").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # 256 rows of a source at most
        ends = sums.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("s") <= F.col("left")))
        same = F.left("low", F.lit(CONTENT)) == F.left("high", F.lit(CONTENT))
        found = ends.select("sk", (F.col("left") - F.col("upto") + F.col("s")).alias("rest"), "s", "n", "low", F.when(same, F.left("low", F.lit(CONTENT))).alias("alike"), "bucket")
        longer = F.concat("prefix", "bucket")
        single, none, open_ = F.col("n") == 1, F.col("n").isNull(), ~F.col("done")
        state = _written(
            state.join(found, "sk", "left").select(
                "sk", "source_size", "target", "copies", F.coalesce("rest", "left").alias("left"),
                F.when(F.length("alike") > F.length(longer), F.col("alike")).otherwise(F.coalesce(longer, "prefix")).alias("prefix"), (F.col("done") | none | single).alias("done"),
                F.when(open_ & none, "g").when(open_ & single, F.col("low")).otherwise(F.col("cut")).alias("cut"),  # g: above all digits, when rounding leaves more than there is
                F.when(open_ & single, 2 * F.col("rest") > F.col("s")).otherwise(F.col("with_cut")).alias("with_cut"),
            ),
            folder,
        )
        looked += 1
    return state


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``; other columns aren't read.

    Sources in the order of their code points, null last, weigh ``weights``, repeating. Rows are taken
    whole; a source's sum misses its target by half a row's size at most, a larger budget takes all that a
    smaller one does, and reruns agree whatever the layout: rows alike in id and text are told apart
    only in how many of them are taken. Null and empty texts have size 0 and are taken 0 times, and so
    do sources without a word; null ids count as empty. No rows in, none out.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights must be positive, and each source may be taken once at least")
    folder = f"{shared_folder(docs.sparkSession)}/mix-{uuid.uuid4().hex}"
    rows = materialised(sized_rows(docs, key, text, source))
    state = cut_sources(rows, with_targets(numbered_sources(rows, folder), weights, most), folder)
    more = ((F.col("mark") < F.col("cut")) | ((F.col("mark") == F.col("cut")) & F.col("with_cut"))) & (F.col("size") > 0)
    return rows.join(state, "sk").select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more.cast("int"))).alias("taken"))
