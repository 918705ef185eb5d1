"""Scalar functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that is a floating point number by the strict grammar (no blanks, type suffixes or hexadecimal).
NUMBER = r"^[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}\z"


def parse_or_zero(text: Column) -> Column:
    """Double of a strict number, else 0.0."""
    body = F.regexp_replace(F.lower(text), r"^([+-]?)inf(inity)?$", "$1Infinity")
    return F.coalesce(F.when(text.rlike(NUMBER), F.regexp_replace(body, "^[+-]?nan$", "NaN").try_cast("double")), F.lit(0.0))


def parse_date(text: Column) -> Column:
    """Date of year-month-day text; any other text fails the query."""
    return F.when(text.rlike(DATE), text.cast("date")).otherwise(F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(text, F.lit("null")))).cast("date"))


def try_date(text: Column) -> Column:
    """Date of year-month-day text, else null, for rows that are to be set aside."""
    return F.when(text.rlike(DATE), text.try_cast("date"))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space."""
    return ~text.rlike(r"(?U)\S")


def strip_suffix(text: Column, suffix: str) -> Column:
    """Without the suffix, however often it stands at the end."""
    return F.regexp_replace(text, f"(?:\\Q{suffix}\\E)+$", "")


def request_suffix(moment: Column) -> Column:
    """Last nine digits of the milliseconds since the epoch, fractions cut off."""
    return F.right(F.unix_millis(moment.cast("timestamp")).cast("string"), F.lit(9))


def fill_template(template: Column, name: str, value: Column) -> Column:
    return F.replace(template, F.lit("{" + name + "}"), value)


def backoff_minutes(attempt: Column) -> Column:
    """10, 20 and 40 minutes after the first failures, then 60."""
    return F.when(attempt <= 1, 10).when(attempt == 2, 20).when(attempt == 3, 40).otherwise(60)


def seconds_left(until: Column, now: Column) -> Column:
    """Time to wait, never negative."""
    return F.greatest(until - now, F.lit(0))


def cents(amount: Column) -> Column:
    """Exact amount for sums."""
    return amount.cast("decimal(18,2)")


def whole_minutes(seconds: Column) -> Column:
    """Integer division, cut off towards zero."""
    return ((seconds - seconds % 60) / 60).cast("bigint")


def as_json(value: Column) -> Column:
    """JSON text of a struct; nulls are written, as null."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def random_id() -> Column:
    """A random UUID for each row, another in each run."""
    return F.uuid()


def redacted(secret: Column) -> Column:
    """What stands in logs for a secret; null stays null."""
    return F.when(secret.isNotNull(), F.lit("[redacted]"))


def page_url(base: Column, account: Column, offset: Column, state: str = "BOOKED") -> Column:
    """Address of a page of an account's transactions; the base may end in /api, however often."""
    return F.format_string(f"%s/banking/v1/accounts/%s/transactions?transactionState={state}&paging-first=%d", strip_suffix(base, "/api"), account, offset)


def label_text(reference: Column, category: Column, subcategory: Column, confidence: Column) -> Column:
    return F.format_string("%s: %s/%s (%.2f)", reference, category, subcategory, confidence)
