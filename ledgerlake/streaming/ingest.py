"""Periodic import: micro-batches of documents merged into keyed tables, each batch once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flatten import accounts, booked, daily_balances
from ..plans.store import Files, Snapshots, Transaction
from ..sources import paged
from ..sources.files import decode_lines
from ..sources.schemas import ACCOUNT_BALANCE, TRANSACTION, UNIQUE

TRANSACTION_KEEPS = ("account_id",)


def merge_transactions(tx: Transaction, rows: DataFrame, order: Column) -> None:
    """Redelivered references take the latest values but keep their first account."""
    tx.upsert("account_transactions", rows, order, TRANSACTION_KEEPS)


def merge_balances(tx: Transaction, balances: DataFrame, institute: str, day: Column | None = None) -> None:
    """New accounts come in; of each account and day the first balance by ``_at`` stays. Both tables change in one commit.

    An account whose IBAN another one has doesn't come in, and neither does a balance without its account.
    """
    at = F.col("_at")
    tx.insert_unique("account", accounts(balances, institute, keep=("_at",)), at, UNIQUE["account"])
    tx.insert_ignore("account_balance", _of_accounts(tx, daily_balances(balances, day, keep=("_at",))), at)


def _of_accounts(tx: Transaction, rows: DataFrame) -> DataFrame:
    """Rows whose account is stored."""
    return rows.join(tx.read("account").select("account_id"), "account_id", "left_semi").select(*rows.columns)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """What a streaming query is called for as long as its checkpoint lives; a new checkpoint has another."""
    return json.loads(Files(spark, checkpoint).read("metadata"))["id"]


def into_store(stream: DataFrame, store: Snapshots, checkpoint: str, merge: Callable[[Transaction, DataFrame], None], finished: Callable[[int], None] | None = None) -> StreamingQuery:
    """Merge what the stream has that wasn't read yet, then stop; run it again for the next cycle.

    A commit names the query and its batch. If a run ends after a commit and before the checkpoint is
    written, the batch is delivered again, and the commit tells that it counts already. ``finished``
    is called after each commit.
    """

    def once(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.run(lambda tx: merge(tx, batch), source=query_id(stream.sparkSession, checkpoint), batch=number)
        finally:
            batch.unpersist()
        if finished:
            finished(number)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_transactions(spark: SparkSession, folder: str, tables: Snapshots, checkpoint: str, account_id: str, finished: Callable[[int], None] | None = None) -> StreamingQuery:
    """The files of a folder that weren't read yet. Of a reference that is delivered more than once the last in order of arrival counts."""

    def merge(tx: Transaction, batch: DataFrame) -> None:
        place = F.struct("file_modification_time", "file_path", "file_block_start", F.monotonically_increasing_id())
        rows = decode_lines(batch.select("value", place.alias("_at")), TRANSACTION, keep=("_at",))
        merge_transactions(tx, booked(rows, F.lit(account_id), keep=("_at",)), F.col("_at"))

    # order of arrival: file by file, and within a file by block and place; a task reads a block's lines in order
    stream = spark.readStream.text(folder).select("value", "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return into_store(stream, tables, checkpoint, merge, finished)


def import_account_stream(spark: SparkSession, options: dict, tables: Snapshots, checkpoint: str, finished: Callable[[int], None] | None = None) -> StreamingQuery:
    """What was added to the accounts that the options name since the last batch; its offsets are kept by account."""

    def merge(tx: Transaction, batch: DataFrame) -> None:
        merge_transactions(tx, _booked(batch), F.col("_at"))

    paged.register(spark)
    return into_store(spark.readStream.format("paged_transactions").options(**options).load(), tables, checkpoint, merge, finished)


def _booked(documents: DataFrame) -> DataFrame:
    """Rows of account_transactions of a service's documents, in order of account and place."""
    at = F.struct("account_id", "place")
    rows = decode_lines(documents.select("value", "account_id", at.alias("_at")), TRANSACTION, keep=("account_id", "_at"))
    return booked(rows, F.col("account_id"), keep=("_at",))


def import_all(spark: SparkSession, options: dict, tables: Snapshots, institute: str, day: Column | None = None) -> int:
    """One cycle: accounts, balances and all transactions of every account of the service, in one commit; the number of the version.

    An error of the service, also in the middle of its pages, leaves the tables as they were.
    """
    balances = paged.balances_of(spark, options).withColumnRenamed("place", "_at").persist()
    documents = paged.transactions_of(balances.select(F.col("account.accountId").alias("account_id")).distinct(), options).persist()
    try:

        def work(tx: Transaction) -> None:
            merge_balances(tx, balances, institute, day)
            merge_transactions(tx, _of_accounts(tx, _booked(documents)), F.col("_at"))

        tables.run(work)
    finally:
        documents.unpersist()
        balances.unpersist()
    return tables.version().number


def load_accounts(spark: SparkSession, path: str, tables: Snapshots, institute: str, day: Column | None = None) -> int:
    """Accounts and balances of one response file; the number of balances read."""
    page = spark.read.schema(f"values array<{ACCOUNT_BALANCE.simpleString()}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    balances = page.select(F.posexplode("values").alias("_at", "v")).select("v.*", "_at")
    tables.run(lambda tx: merge_balances(tx, balances, institute, day))
    return balances.count()
