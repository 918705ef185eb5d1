"""A service that keeps accounts together is asked for these one after the other, and tasks hand on more than a page at a time."""

import itertools
import json
import os
import uuid
import zlib

from pyspark.sql import functions as F

from ledgerlake.sources import paged, stored_service


class Shelves:
    """Accounts of 5 documents; notes for each client from which of 4 shelves it reads."""

    def __init__(self, options):
        self.log = os.path.join(options["log"], uuid.uuid4().hex)

    def get(self, path, query):
        account, at = path.split("/")[-2], int(query["paging-first"])
        with open(self.log, "a") as f:
            f.write(f"{zlib.crc32(account.encode()) % 4}\n")
        return 200, json.dumps({"paging": {"index": at, "matches": 5}, "values": [{"reference": f"{account}-{k}"} for k in range(at, min(at + 2, 5))]})


def test_each_client_reads_a_shelf_once(spark, tmp_path):
    accounts = spark.range(200).select(F.col("id").cast("string").alias("account_id"))
    found = paged.transactions_of(accounts, {"client": "test_near_accounts:Shelves", "near": "4", "log": str(tmp_path)}, tasks=2)
    assert sorted((r.account_id, r.place, json.loads(r.value)["reference"]) for r in found.collect()) == sorted((str(a), k, f"{a}-{k}") for a in range(200) for k in range(5))
    for log in tmp_path.iterdir():
        shelves = log.read_text().split()
        assert len(list(itertools.groupby(shelves))) == len(set(shelves))


def test_a_file_is_read_once_for_all_its_accounts(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 12).cast("string").alias("account_id"), F.lit("BOOKED").alias("state"), F.format_string('{"n": %d}', "id").alias("value"), F.col("id").alias("at"))
    balances = spark.range(0).select(F.col("id").alias("place"), F.lit("{}").alias("value"))
    options = stored_service.store_answers(balances, rows, str(tmp_path / "served"), 1, F.col("at"))
    client, opened = stored_service.StoredService({**options, "step": "2"}), []

    class Counted:
        def get_file_info(self, place):
            opened.append(place)
            return files.get_file_info(place)

    files = client.files
    first = json.loads(client.get("accounts/0/transactions", {"transactionState": "BOOKED", "paging-first": "0"})[1])
    client.files = Counted()
    pages = [json.loads(client.get(f"accounts/{a}/transactions", {"transactionState": "BOOKED", "paging-first": str(at)})[1]) for a in range(12) for at in (0, 2, 4)]
    assert first == pages[0] == {"paging": {"index": 0, "matches": 5}, "values": [{"n": 0}, {"n": 12}]}
    assert [v["n"] for p in pages[3:6] for v in p["values"]] == [1, 13, 25, 37, 49] and opened == []


def test_batches_are_bounded(spark):
    rows = [("a", 0, k, None, "x" * 10) for k in range(paged.BATCH_ROWS + 1)] + [("a", 0, 1, None, "x" * paged.BATCH_CHARS)] * 2
    assert [b.num_rows for b in paged._batches(iter(rows), paged._DOCUMENT)] == [paged.BATCH_ROWS, 2, 1]
