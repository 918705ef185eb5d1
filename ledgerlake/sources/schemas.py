"""Explicit schemas of wire documents and of the keyed tables."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _OPT = T.StringType(), True


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, opt) for n, t, opt in fields])


MONEY = _struct(("value", _STR, False), ("unit", _STR, False))

TRANSACTION = _struct(
    ("reference", _STR, False), ("bookingStatus", _STR, False), ("bookingDate", _STR, False), ("amount", MONEY, False),
    ("remitter", _struct(("holderName", _STR, False)), _OPT), ("deptor", _STR, _OPT),
    ("creditor", _struct(("holderName", _STR, False), ("iban", _STR, _OPT), ("bic", _STR, _OPT)), _OPT),
    ("valutaDate", _STR, False), ("directDebitCreditorId", _STR, _OPT), ("directDebitMandateId", _STR, _OPT),
    ("endToEndReference", _STR, _OPT), ("newTransaction", T.BooleanType(), False), ("remittanceInfo", _STR, False),
    ("transactionType", _struct(("key", _STR, False), ("text", _STR, False)), False),
)

ACCOUNT_BALANCE = _struct(
    ("account", _struct(("iban", _STR, False), ("bic", _STR, False), ("accountId", _STR, False), ("accountDisplayId", _STR, False), ("accountType", _struct(("text", _STR, False)), False)), False),
    ("accountId", _STR, False), ("balance", MONEY, False),
)

CATEGORY = _struct(("category", _STR, False), ("subcategories", T.ArrayType(_STR, False), False))

#: What a classifier answers; confidence is single precision until it is stored.
LABEL = _struct(("reference", _STR, False), ("category", _STR, False), ("subcategory", _STR, False), ("confidence", T.FloatType(), False), ("reasoning", _STR, False))

#: Target tables: columns and key.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "account": ("account_id string, display_id string, account_type string, iban string, bic string, institute string", ("account_id",)),
    "account_balance": ("account_id string, date date, amount double", ("account_id", "date")),
    "account_transactions": ("reference string, account_id string, booking_status string, booking_date date, amount double, remitter string, deptor string, creditor string, creditor_id string, creditor_mandate_id string, remittance_info string, transaction_type string", ("reference",)),
    "transactions": ("reference string, account_id string, booking_status string, booking_date string, amount double, remitter string, deptor string, creditor string, creditor_id string, creditor_mandate_id string, remittance_info string, transaction_type string", ("reference",)),
    "categories": ("id int, category string, subcategory string", ("category", "subcategory")),
    "transaction_categories": ("reference string, category_id int, reasoning string, confidence double", ("reference",)),
    "mandate_categories": ("creditor_mandate_id string, category_id int, description string", ("creditor_mandate_id",)),
}


#: Further unique keys of tables, and where children name their parents: parent and its key, child and its column.
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {"account": (("iban",),)}
PARENTS: tuple[tuple[str, str, str, str], ...] = (
    ("account", "account_id", "account_balance", "account_id"), ("account", "account_id", "account_transactions", "account_id"),
    ("categories", "id", "transaction_categories", "category_id"), ("categories", "id", "mandate_categories", "category_id"), ("transactions", "reference", "transaction_categories", "reference"),
)


def required(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of fields that a document must have, within the optional ones where these are present."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if not f.nullable:
            out.append(path)
        if isinstance(f.dataType, T.StructType):
            out += required(f.dataType, f"{path}.")
    return out
