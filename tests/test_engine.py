"""Parsing, files, paging, merges, labels, snapshots and streaming."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import columns as C
from ledgerlake.operators import categorize, flatten, merge
from ledgerlake.plans import reports, tables
from ledgerlake.sources import files, paged, service
from ledgerlake.streaming import ingest


def _document(reference, value="1.50", **more):
    return {"reference": reference, "bookingStatus": "BOOKED", "bookingDate": "2025-03-01", "amount": {"value": value, "unit": "EUR"}, "valutaDate": "2025-03-01", "newTransaction": False, "remittanceInfo": "x", "transactionType": {"key": "K", "text": "T"}} | more


def test_numbers(spark):
    told = {"abc": 0, "": 0, " 1.5 ": 0, "1d": 0, "0x1p3": 0, "-12.30": -12.3, "1e5": 1e5, ".5": 0.5, "5.": 5, "+1": 1, "inf": math.inf, "-Infinity": -math.inf, None: 0}
    df = spark.createDataFrame([(k,) for k in told], "t string")
    assert {r.t: r.v for r in df.select("t", C.parse_or_zero(F.col("t")).alias("v")).collect()} == told


def test_dates_and_blanks(spark):
    df = spark.createDataFrame([("2025-01-02",), ("2025-1-2",)], "t string")
    assert {str(r.d) for r in df.select(C.parse_date(F.col("t")).alias("d")).collect()} == {"2025-01-02"}
    for bad in ("2025-13-01", "2025", "2025-01"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "t string").select(C.parse_date(F.col("t"))).collect()
    lines = spark.createDataFrame([("\t",), ("",), (" ",), ("x",)], "t string")
    assert [r.b for r in lines.select(C.is_blank(F.col("t")).alias("b")).collect()] == [True, True, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([_document("1"), _document("2", "bad", remitter={"holderName": "R"})]))
    rows = flatten.booked(files.read_array(spark, str(tmp_path / "a.json")), F.lit("acc")).collect()
    assert [(r.reference, r.amount, r.remitter, r.creditor_id, r.account_id) for r in rows] == [("1", 1.5, "", "", "acc"), ("2", 0.0, "R", "", "acc")]
    assert flatten.filed(files.read_array(spark, str(tmp_path / "a.json")).limit(1)).first().creditor_id is None
    broken = _document("3")
    del broken["amount"]
    (tmp_path / "b.json").write_text(json.dumps([broken]))
    with pytest.raises(Exception):
        files.read_array(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.ndjson").write_text(json.dumps(_document("4")) + "\n \t\n" + json.dumps(_document("5")) + "\n")
    assert [r.reference for r in files.read_lines(spark, str(tmp_path / "c.ndjson")).collect()] == ["4", "5"]
    (tmp_path / "d.json").write_text(json.dumps([{"category": "a", "subcategories": ["x", "y"]}, {"category": "b", "subcategories": []}]))
    assert [tuple(r) for r in files.read_categories(spark, str(tmp_path / "d.json")).collect()] == [("a", "x"), ("a", "y")]


def test_paging(spark):
    paged.register(spark)
    read = lambda a: spark.read.format("paged_transactions").option("client", "fake_bank:bank").option("accounts", a).load()
    for account, n in (("empty", 0), ("one", 3), ("rest", 7), ("exact", 6)):
        refs = [json.loads(r.value)["reference"] for r in read(account).collect()]
        assert len(refs) == len(set(refs)) == n
    assert read("one,rest").where("booking_status = 'BOOKED'").count() == 6
    assert service.offsets(0, 5) == []


KEYS, COLUMNS = ["k"], "k string, a string, v int, n int"


def _batch(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_merges(spark):
    table = spark.createDataFrame([("x", "first", 1), ("y", "first", 1)], "k string, a string, v int")
    batch = _batch(spark, [("x", "late", 3, 2), ("x", "mid", 2, 1), ("z", "one", 5, 1), ("z", "two", None, 2)])
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    ignored = merge.insert_ignore(table, batch, KEYS, F.col("n"))
    assert shown(ignored) == [("x", "first", 1), ("y", "first", 1), ("z", "one", 5)]
    merged = merge.upsert(table, batch, KEYS, F.col("n"), keep=("a",))
    assert shown(merged) == [("x", "first", 3), ("y", "first", 1), ("z", "one", None)]
    assert shown(merge.upsert(merged, batch, KEYS, F.col("n"), keep=("a",))) == shown(merged)
    replaced = merge.replace(table, batch.select("k", "v", "n"), KEYS, F.col("n")).select("k", "a", "v")
    assert shown(replaced) == [("x", None, 3), ("y", "first", 1), ("z", None, None)]


def test_labels_and_report(spark):
    moves = spark.createDataFrame([("1", "2025-03-01", 10.0), ("2", "2025-03-31", -4.0), ("3", "2025-04-01", 9.0), ("4", "2025-03-05", 0.1)], "reference string, d string, amount double").select("reference", F.col("d").cast("date").alias("booking_date"), "amount")
    dim = categorize.category_dim(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "category string, subcategory string"))
    answers = spark.createDataFrame([("1", "a", "x", 0.9, "r"), ("2", "nope", "x", 0.9, "r")], "reference string, category string, subcategory string, confidence float, reasoning string")
    labels, unknown = categorize.resolve(answers, dim)
    assert [r.reference for r in unknown.collect()] == ["2"] and labels.first().confidence == 0.8999999761581421
    assert sorted(r.reference for r in categorize.pending(moves, labels).collect()) == ["2", "3", "4"]
    got = {r.category: (r.total_income, r.total_expenses) for r in reports.reports(moves, labels, dim, "03", "2025").collect()}
    assert got == {"a": (10.0, 0.0), "uncategorized": (0.1, 4.0)}
    assert [str(d) for d in reports.month_range("12", "2025")] == ["2025-12-01", "2026-01-01"]


def test_stream_is_idempotent(spark, tmp_path):
    store = tables.Snapshots(spark, str(tmp_path / "tables"))
    (tmp_path / "in").mkdir()
    run = lambda account: ingest.import_transactions(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"), account).awaitTermination()
    (tmp_path / "in" / "1.ndjson").write_text(json.dumps(_document("1")) + "\n")
    run("first")
    (tmp_path / "in" / "2.ndjson").write_text("\n".join(json.dumps(_document(r, "7")) for r in "12"))
    run("second")
    run("second")
    assert sorted((r.reference, r.account_id, r.amount) for r in store.read("account_transactions").collect()) == [("1", "first", 7.0), ("2", "second", 7.0)]


def test_no_line_feed_slips_through(spark):
    df = spark.createDataFrame([("1.5\n", "2025-01-02\n")], "n string, d string")
    row = df.select(C.parse_or_zero(F.col("n")).alias("n"), C.try_date(F.col("d")).alias("d")).first()
    assert row.n == 0.0 and row.d is None


def test_last_delivery_wins_in_order_of_arrival(spark, tmp_path):
    store = tables.Snapshots(spark, str(tmp_path / "tables"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.ndjson").write_text("\n".join(json.dumps(_document("1", v)) for v in ("100", "7")) + "\n")
    (tmp_path / "in" / "2.ndjson").write_text(json.dumps(_document("2", "9")) + "\n" + json.dumps(_document("2", "3")) + "\n")
    ingest.import_transactions(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"), "a").awaitTermination()
    assert {r.reference: r.amount for r in store.read("account_transactions").collect()} == {"1": 7.0, "2": 3.0}


def test_a_version_counts_once_its_marker_is_there(spark, tmp_path):
    store = tables.Snapshots(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([(i, "c", "s") for i in range(n)], tables.TABLES["categories"][0])
    assert store.read("categories").count() == 0
    store.write("categories", rows(1))
    store.write("categories", rows(2))
    rows(9).write.parquet(str(tmp_path / "categories" / "broken"))  # a writer that stopped before its marker
    assert store.read("categories").count() == 2
    for k in range(9):
        store.write("categories", rows(k))
    assert store.read("categories").count() == 8  # the tenth comes after the ninth


def test_stored_ids_stay(spark):
    pairs = lambda *names: spark.createDataFrame([(n, "x") for n in names], "category string, subcategory string")
    first = categorize.category_dim(pairs("b", "c"))
    assert sorted(tuple(r) for r in categorize.category_dim(pairs("a", "b", "d"), first).collect()) == [(1, "b", "x"), (2, "c", "x"), (3, "a", "x"), (4, "d", "x")]


def test_replace_keeps_the_tables_columns(spark):
    table = spark.createDataFrame([("x", 1)], "k string, v int")
    assert merge.replace(table, _batch(spark, [("x", "a", 2, 1)]), KEYS, F.col("n")).columns == ["k", "v"]


def test_balances_in_order(spark, tmp_path):
    value = lambda i, v: {"account": {"iban": i, "bic": "b", "accountId": i, "accountDisplayId": f"d{v}", "accountType": {"text": "t"}}, "accountId": i, "balance": {"value": v, "unit": "EUR"}}
    (tmp_path / "page.json").write_text(json.dumps({"values": [value("a", "5"), value("b", "1"), value("a", "2")], "paging": {"index": 0, "matches": 3}}))
    store = tables.Snapshots(spark, str(tmp_path / "tables"))
    assert ingest.load_accounts(spark, str(tmp_path / "page.json"), store, "Bank", F.lit("2025-01-01").cast("date")) == 3
    assert {r.account_id: r.amount for r in store.read("account_balance").collect()} == {"a": 5.0, "b": 1.0}
    assert {(r.account_id, r.display_id, r.institute) for r in store.read("account").collect()} == {("a", "d5", "Bank"), ("b", "d1", "Bank")}


def test_accounts_of_a_table(spark):
    accounts = spark.createDataFrame([("one",), ("rest",), (None,), ("empty",)], "account_id string")
    rows = paged.transactions_of(accounts, {"client": "fake_bank:bank"}).collect()
    assert sorted((r.account_id, json.loads(r.value)["reference"]) for r in rows) == sorted([("one", f"one-{k}") for k in range(3)] + [("rest", f"rest-{k}") for k in range(7)])


def test_one_or_fail(spark):
    two = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    assert merge.first_or_fail(two, F.col("v")).first().v == 1
    for bad in (lambda: merge.first_or_fail(two.limit(0), F.col("v")).collect(), lambda: merge.exactly_one(two, KEYS).collect()):
        with pytest.raises(Exception):
            bad()
    assert two.select(C.random_id().alias("u")).distinct().count() == 2
