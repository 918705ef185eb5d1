"""Keyed writes as set operations: a batch and a table give the table's next snapshot.

``order`` gives the rows of a batch a total order by arrival; aggregation by key combines on the map
side, so a key that is delivered very often needs no large group.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialised

_OLD, _SEQ = "_stored", "_seq"


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_of_each(batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The earliest row of each key."""
    rest = _rest(batch, keys)
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*batch.columns)


def last_of_each(batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The latest row of each key."""
    rest = _rest(batch, keys)
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*batch.columns)


def insert_ignore(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Stored rows stay; of new keys the earliest row comes in."""
    fresh = batch.join(table.select(*keys), list(keys), "left_anti").select(*batch.columns)
    return table.unionByName(first_of_each(fresh, keys, order).select(*table.columns))


def insert_unique(table: DataFrame | Sequence[DataFrame], batch: DataFrame, keys: Sequence[Sequence[str]], order: Column) -> tuple[DataFrame, DataFrame]:
    """table: what is stored, or for each key the stored rows that may have one of its values. Rows of the batch that come in, and those that don't, as if one came after the other in this order.

    A row comes in unless one that is stored, or came in before, has the same values in one of the keys;
    null values are the same as none. Each round takes the rows that are the first of all their keys among
    those left, and drops what these exclude; so there are as many rounds as rows exclude one another in a
    chain, and no key is gathered in one place. Rows of equal order come one after the other all the same.
    """
    place = F.struct(order.alias("o"), F.monotonically_increasing_id().alias("n"))
    whole = materialised(batch.withColumn(_SEQ, place))
    left, parts = whole, []
    for key, stored in zip(keys, [table] * len(keys) if isinstance(table, DataFrame) else table, strict=True):
        left = left.join(stored.select(*key), list(key), "left_anti")
    while True:
        left = materialised(left)
        if left.isEmpty():
            break
        winners = left
        for k, key in enumerate(keys):
            known = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
            first = left.where(known).groupBy(*key).agg(F.min(_SEQ).alias(f"_first{k}"))
            winners = winners.join(first, list(key), "left").where(F.col(f"_first{k}").isNull() | (F.col(f"_first{k}") == F.col(_SEQ))).drop(f"_first{k}")
        parts.append(materialised(winners.select(*whole.columns)))
        left = left.join(parts[-1].select(_SEQ), _SEQ, "left_anti")
        for key in keys:
            left = left.join(parts[-1].select(*key), list(key), "left_anti")
    taken = functools.reduce(DataFrame.unionByName, parts) if parts else whole.limit(0)
    return taken.select(*batch.columns), whole.join(taken.select(_SEQ), _SEQ, "left_anti").select(*batch.columns)


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The latest row of each key wins, but for the ``keep`` columns, which stay as first stored."""
    seq = F.struct(F.lit(0).alias(_OLD), F.lit(None).cast(batch.select(order.alias("o")).schema["o"].dataType).alias("o"))
    marked = table.withColumn(_SEQ, seq).unionByName(batch.select(*table.columns, F.struct(F.lit(1).alias(_OLD), order.alias("o")).alias(_SEQ)))
    moving = [c for c in table.columns if c not in keys and c not in keep]
    kept = [F.min_by(F.struct(*keep), _SEQ).alias("_kept")] if keep else []
    merged = marked.groupBy(*keys).agg(F.max_by(F.struct(*moving), _SEQ).alias("_moved"), *kept)
    return merged.select(*keys, "_moved.*", *(["_kept.*"] if keep else [])).select(*table.columns)


def replace(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Whole rows are replaced; columns that the batch lacks become null, and columns that the table lacks are left out."""
    kinds = table.schema
    given = [F.col(c) if c in batch.columns else F.lit(None).cast(kinds[c].dataType).alias(c) for c in table.columns]
    kind = batch.select(order.alias("o")).schema["o"].dataType
    seq = lambda late, at: F.struct(F.lit(late).alias(_OLD), at.alias("o")).alias(_SEQ)
    both = table.select("*", seq(0, F.lit(None).cast(kind))).unionByName(batch.select(*given, seq(1, order)))
    rest = _rest(table, keys)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), _SEQ).alias("_row")).select(*keys, "_row.*").select(*table.columns)


def delete_cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent stays."""
    return children.join(gone.select(key), key, "left_anti").select(*children.columns)


def first_or_fail(df: DataFrame, order: Column) -> DataFrame:
    """The first row of df in this order; the query fails where there is none."""
    found = df.agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*df.columns), order).alias("_row"))
    return found.where(F.when(F.col("_n") == 0, F.raise_error(F.lit("no row"))).otherwise(True)).select("_row.*")


def exactly_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, one row for each key; the query fails where a key has more."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*_rest(df, keys))).alias("_row"))
    return counted.where(F.when(F.col("_n") != 1, F.raise_error(F.lit("more than one row of a key"))).otherwise(True)).select(*keys, "_row.*").select(*df.columns)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose (non-null) key has no parent."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti").select(*children.columns)
