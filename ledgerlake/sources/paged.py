"""Accounts and transactions of a paged service, as Spark sources.

``spark.read.format("paged_transactions").option("url", ...).option("accounts", "a,b")`` reads named
accounts, and ``spark.readStream`` what was added since the last batch; ``transactions_of(accounts,
options)`` reads the accounts of a DataFrame, however many. ``spark.read.format("paged_balances")`` reads
accounts and balances. Without a ``url`` the option ``client`` names a factory of clients, see ``service``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from .schemas import ACCOUNT_BALANCE
from .service import Service, offsets

BOOKED = "BOOKED"
#: Paths of the service.
BALANCES, TRANSACTIONS = "banking/clients/user/v2/accounts/balances", "banking/v1/accounts/{}/transactions"
DOCUMENTS = "account_id string, page_offset int, place bigint, booking_status string, value string"
#: Pages that one task of a source reads.
PAGES = 20


class Stretch(InputPartition):
    """Values of one account between two places, read page by page."""

    def __init__(self, account: str, start: int, end: int):
        super().__init__((account, start, end))
        self.account, self.start, self.end = account, start, end


def stretches(account: str, start: int, end: int, step: int, pages: int) -> list[Stretch]:
    """As many stretches of ``pages`` pages as there are."""
    return [Stretch(account, start + at, min(end, start + at + step * pages)) for at in offsets(step * pages, end - start)]


def _document(account: str, offset: int, place: int, value: dict) -> tuple:
    return account, offset, place, value.get("bookingStatus"), json.dumps(value)


class _Accounts:
    """What both readers of transactions share."""

    def __init__(self, options: dict):
        self.options = options
        self.state, self.pages = options.get("state", BOOKED), int(options.get("pages_per_task", PAGES))
        self.accounts = [a for a in options.get("accounts", "").split(",") if a]

    def first(self, service: Service, account: str) -> tuple[list, int]:
        return service.page(TRANSACTIONS.format(account), {"transactionState": self.state}, 0)

    def read(self, partition: Stretch | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes when there are no partitions
            return
        path = TRANSACTIONS.format(partition.account)
        for offset, values in Service(self.options).rows(path, {"transactionState": self.state}, partition.start, partition.end):
            for k, value in enumerate(values):
                yield _document(partition.account, offset, offset + k, value)


class _Reader(_Accounts, DataSourceReader):
    """The first page of each account is asked for when the read is planned; it tells how many pages tasks are to read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """The booking status goes into the request; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("booking_status",):
                self.state = f.value
            yield f

    def partitions(self) -> list[Stretch]:
        service, out = Service(self.options), []
        for account in self.accounts:
            values, matches = self.first(service, account)
            out += stretches(account, 0, matches, len(values), self.pages)
        return out


class _StreamReader(_Accounts, DataSourceStreamReader):
    """An offset is the number of transactions of each account; a batch reads what lies between two of them."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        service = Service(self.options)
        return {account: self.first(service, account)[1] for account in self.accounts}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        step = int(self.options.get("page_rows", 20))
        return [x for a, n in sorted(end.items()) for x in stretches(a, min(n, start.get(a, 0)), n, step, self.pages)]


class PagedTransactions(DataSource):
    """account_id, page_offset, place among the account's transactions, booking_status and the document as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_transactions"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))


class _BalancesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.pages = options, int(options.get("pages_per_task", PAGES))

    def partitions(self) -> list[Stretch]:
        values, matches = Service(self.options).page(BALANCES, {}, 0)
        return stretches("", 0, matches, len(values), self.pages)

    def read(self, partition: Stretch | None) -> Iterator[tuple]:
        if partition is not None:
            for offset, values in Service(self.options).rows(BALANCES, {}, partition.start, partition.end):
                yield from ((offset + k, json.dumps(value)) for k, value in enumerate(values))


class PagedBalances(DataSource):
    """place and the document as JSON text of each account with its balance."""

    @classmethod
    def name(cls) -> str:
        return "paged_balances"

    def schema(self) -> str:
        return "place bigint, value string"

    def reader(self, schema) -> _BalancesReader:
        return _BalancesReader(dict(self.options))


def balances_of(spark: SparkSession, options: dict) -> DataFrame:
    """account, accountId, balance and place of all accounts of the service; a malformed document fails the read."""
    register(spark)
    read = spark.read.format("paged_balances").options(**options).load()
    return read.select(F.from_json("value", ACCOUNT_BALANCE, {"mode": "FAILFAST"}).alias("v"), "place").select("v.*", "place")


#: Rows and characters of a batch that a task hands on.
BATCH_ROWS, BATCH_CHARS = 1_000, 4_000_000
_PAGE = pa.schema([("account", pa.string()), ("start", pa.int64()), ("rows", pa.int64()), ("part", pa.int64()), ("first", pa.string())])
_DOCUMENT = pa.schema([("account_id", pa.string()), ("page_offset", pa.int32()), ("place", pa.int64()), ("booking_status", pa.string()), ("value", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded size; the last column is the long one."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1] or "")
        if len(part) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def transactions_of(accounts: DataFrame, options: dict, account_id: str = "account_id", tasks: int | None = None) -> DataFrame:
    """DOCUMENTS of all accounts of a DataFrame.

    The accounts are dealt over ``tasks`` tasks, which read the first page of each; it tells the number of its
    pages. These are dealt by account and offset over as many tasks (the shuffle partitions of the session without one), so
    an account of many pages is read by all of them. First pages come along and aren't asked for again.

    The option ``near`` tells that the service keeps accounts together whose crc32 leaves the same remainder by this
    number: a task asks for these one after the other, and for up to PAGES pages of an account.
    """
    state, near = options.get("state", BOOKED), int(options.get("near", 0))
    query = {"transactionState": state}

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        service = Service(options)
        for batch in batches:
            for account in batch.column(0).to_pylist():
                values, matches = service.page(TRANSACTIONS.format(account), query, 0)
                for k, o in enumerate(offsets(len(values), matches)):
                    yield account, o, min(len(values), matches - o), k // PAGES if near else k, json.dumps(values) if o == 0 else None

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        service = Service(options)
        for batch in batches:
            for page in batch.to_pylist():
                path, start = TRANSACTIONS.format(page["account"]), page["start"]
                found = [(start, json.loads(page["first"]))] if page["first"] else service.rows(path, query, start, start + page["rows"])
                for offset, values in found:
                    yield from (_document(page["account"], offset, offset + k, v) for k, v in enumerate(values))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(planned(batches), _PAGE)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(fetched(batches), _DOCUMENT)

    named = accounts.select(F.col(account_id).cast("string").alias("account")).where(F.col("account").isNotNull())
    n = tasks or int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.crc32(F.col("account").cast("binary")), F.lit(near)) if near else F.col("account")
    # a stated number of partitions: by their few bytes, Spark would put all accounts into one task
    dealt = named.repartition(n, group)
    pages = (dealt.sortWithinPartitions(group) if near else dealt).mapInArrow(plan, "account string, start bigint, rows bigint, part bigint, first string")
    dealt = pages.repartition(n, group, "part")
    return (dealt.sortWithinPartitions(group, "account", "start") if near else dealt).mapInArrow(fetch, DOCUMENTS)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedTransactions)
    spark.dataSource.register(PagedBalances)
