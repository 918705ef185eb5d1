"""Labelling of transactions that have none yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .merge import last_of_each, replace


def category_dim(pairs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """id, category, subcategory: each pair once. Stored pairs keep their ids; new ones are numbered by name above the greatest.

    New pairs are numbered in one window; a dimension has as many rows as there are distinct pairs.
    """
    keys = ["category", "subcategory"]
    fresh = pairs.select(*keys).distinct()
    number = F.row_number().over(Window.orderBy(*keys))
    if stored is None:
        return fresh.withColumn("id", number).select("id", *keys)
    known = fresh.alias("f").join(stored.alias("s"), (F.col("f.category").eqNullSafe(F.col("s.category"))) & (F.col("f.subcategory").eqNullSafe(F.col("s.subcategory"))), "left_anti")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = known.withColumn("_n", number).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).cast("int").alias("id"), *keys)  # one row on the right
    return stored.select("id", *keys).unionByName(numbered)


def pending(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions without a label."""
    return transactions.join(labels.select("reference"), "reference", "left_anti").select(*transactions.columns)


def with_label_flag(transactions: DataFrame, labels: DataFrame, name: str = "is_categorized") -> DataFrame:
    """A boolean for each transaction: is there a label."""
    known = labels.select(F.col("reference").alias("_labelled"))
    return transactions.alias("_all").select("*", known.where(F.col("_labelled") == F.col("_all.reference").outer()).exists().alias(name))


def by_rules(text: Column, rules: Sequence[tuple[str, str, str]], default: tuple[str, str]) -> Column:
    """Struct category, subcategory, confidence, reasoning by the first rule (pattern, category, subcategory) that the text matches."""
    answer = lambda c, s, p, why: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"), F.lit(p).cast("float").alias("confidence"), F.lit(why).alias("reasoning"))
    out = None
    for pattern, c, s in rules:
        hit, value = text.rlike(pattern), answer(c, s, 0.9, f"matches {pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    last = answer(*default, 0.1, "no rule matches")
    return last if out is None else out.otherwise(last)


def by_mandate(transactions: DataFrame, mandates: DataFrame) -> DataFrame:
    """Transactions with the category that their mandate fixes, if any."""
    return transactions.join(mandates.select("creditor_mandate_id", "category_id"), "creditor_mandate_id", "left")


def resolve(answers: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label rows of answers whose pair is known, and the answers whose pair isn't."""
    ids = categories.select("category", "subcategory", F.col("id").alias("category_id"))
    found = answers.join(ids, ["category", "subcategory"], "left")
    labels = found.where("category_id is not null").select("reference", "category_id", "reasoning", F.col("confidence").cast("double").alias("confidence"))
    return labels, found.where("category_id is null").select(*answers.columns)


def write_labels(labels: DataFrame, answers: DataFrame, categories: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """The label table after a batch of answers, and the answers whose pair is unknown, which are set aside."""
    ids = categories.select("category", "subcategory", F.col("id").alias("category_id"))
    found = answers.withColumn("_at", order).join(ids, ["category", "subcategory"], "left")
    known = found.where("category_id is not null").select("reference", "category_id", "reasoning", F.col("confidence").cast("double").alias("confidence"), "_at")
    return add_labels(labels, known, F.col("_at")), found.where("category_id is null").select(*answers.columns)


def classify_pending(transactions: DataFrame, labels: DataFrame, classifier: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers of any classifier, rows in and rows out, for the transactions without a label; of a reference the first answer by name."""
    answers = classifier(pending(transactions, labels))
    return last_of_each(answers, ["reference"], F.struct("category", "subcategory", "reasoning"))


def add_labels(labels: DataFrame, fresh: DataFrame, order: Column) -> DataFrame:
    """One label for each reference, the latest."""
    return replace(labels, fresh, ["reference"], order)
