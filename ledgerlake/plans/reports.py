"""Report queries over transactions, labels and categories."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cents

REPORT_FIELDS = ("month", "year", "category", "total_income", "total_expenses")
UNCATEGORIZED = "uncategorized"


def month_range(month: str, year: str) -> tuple[datetime.date, datetime.date]:
    """First day of the month and of the next; '1' and '01' are January."""
    first = datetime.date(int(year), int(month), 1)
    return first, (first.replace(day=28) + datetime.timedelta(days=4)).replace(day=1)


def average_by_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(name))


def income_and_expenses(lines: DataFrame) -> DataFrame:
    """Totals of amounts over and under zero by category, exact to the cent; both are positive."""
    amount = cents(F.col("amount"))
    total = lambda a: F.coalesce(F.sum(a), F.lit(0)).cast("double")
    return lines.groupBy("category").agg(total(F.when(amount > 0, amount)).alias("total_income"), total(F.when(amount < 0, -amount)).alias("total_expenses"))


def in_month(transactions: DataFrame, month: str, year: str, date: str = "booking_date") -> DataFrame:
    """A range of dates, so that it reaches the scan."""
    first, last = month_range(month, year)
    kind = transactions.schema[date].dataType.simpleString()
    bound = lambda d: F.lit(d.isoformat()).cast(kind)
    return transactions.where((F.col(date) >= bound(first)) & (F.col(date) < bound(last)))


def reports(transactions: DataFrame, labels: DataFrame, categories: DataFrame, month: str, year: str, fields: Sequence[str] = REPORT_FIELDS, typename: bool = False) -> DataFrame:
    """Income and expenses of a month by category; transactions without a label are UNCATEGORIZED. fields: what the caller selects."""
    named = in_month(transactions, month, year).join(labels.select("reference", "category_id"), "reference", "left").join(categories.select(F.col("id").alias("category_id"), "category"), "category_id", "left")
    totals = income_and_expenses(named.select("amount", F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category")))
    return select_fields(totals.select(F.lit(month).alias("month"), F.lit(year).alias("year"), "*"), fields, typename)


def select_fields(df: DataFrame, fields: Sequence[str], typename: bool = False, include: dict[str, bool] | None = None, skip: dict[str, bool] | None = None) -> DataFrame:
    """The selected fields, but for those that a condition leaves out."""
    wanted = [f for f in fields if (include or {}).get(f, True) and not (skip or {}).get(f, False)]
    return df.select(*wanted, *([F.lit("Report").alias("__typename")] if typename else []))


def chart_series(df: DataFrame, label: str = "year", value: str = "count") -> DataFrame:
    return df.select(label, value)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """Rows that the caller states, as a table."""
    return spark.createDataFrame(list(rows), columns)


def hello(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'Hello, world!' AS hello")
