"""Nested documents to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import or_empty, parse_date, parse_or_zero


def accounts(balances: DataFrame, institute: str, keep: tuple[str, ...] = ()) -> DataFrame:
    a = F.col("account")
    return balances.select(
        a["accountId"].alias("account_id"), a["accountDisplayId"].alias("display_id"), a["accountType"]["text"].alias("account_type"),
        a["iban"].alias("iban"), a["bic"].alias("bic"), F.lit(institute).alias("institute"), *keep,
    )


def daily_balances(balances: DataFrame, day: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Balances of one day: today in the session's zone, or a given one."""
    return balances.select(F.col("account.accountId").alias("account_id"), (F.current_date() if day is None else day).alias("date"), parse_or_zero(F.col("balance.value")).alias("amount"), *keep)


def booked(transactions: DataFrame, account_id: Column, absent: str | None = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of account_transactions. absent: what stands for missing creditor and mandate ids; keep: columns that come along."""
    other = lambda c: F.coalesce(c, F.lit(absent))
    return transactions.select(
        "reference", account_id.alias("account_id"), F.col("bookingStatus").alias("booking_status"), parse_date(F.col("bookingDate")).alias("booking_date"),
        parse_or_zero(F.col("amount.value")).alias("amount"), or_empty(F.col("remitter.holderName")).alias("remitter"), or_empty(F.col("deptor")).alias("deptor"),
        or_empty(F.col("creditor.holderName")).alias("creditor"), other(F.col("directDebitCreditorId")).alias("creditor_id"),
        other(F.col("directDebitMandateId")).alias("creditor_mandate_id"), F.col("remittanceInfo").alias("remittance_info"), F.col("transactionType.text").alias("transaction_type"), *keep,
    )


def filed(transactions: DataFrame) -> DataFrame:
    """Rows of the legacy transactions table from a file: text dates, type keys, no account."""
    return transactions.select(
        "reference", F.col("bookingStatus").alias("booking_status"), F.col("bookingDate").alias("booking_date"), F.col("amount.value").try_cast("double").alias("amount"),
        F.col("remitter.holderName").alias("remitter"), F.col("deptor"), F.col("creditor.holderName").alias("creditor"), F.col("directDebitCreditorId").alias("creditor_id"),
        F.col("directDebitMandateId").alias("creditor_mandate_id"), F.col("remittanceInfo").alias("remittance_info"), F.col("transactionType.key").alias("transaction_type"),
    )
