"""Requests, paged sources, a whole import, labels of a model, and the loop around an import."""

import collections
import json

import pytest
from pyspark.sql import functions as F

import fake_bank
from ledgerlake.operators import categorize, classify
from ledgerlake.plans.store import Snapshots
from ledgerlake.sources import paged, service
from ledgerlake.sources.settings import Settings, from_environment
from ledgerlake.streaming import ingest, job, schedule

OPTIONS = {"client": "fake_bank:bank", "wait_seconds": "0"}


def _service(answers, **options):
    waits = []
    out = service.Service({"client": "fake_bank:bank", "wait_seconds": "60", "retries": "6", **options}, waits.append)
    out.client = fake_bank.Moods(answers)
    return out, waits


GOOD = (200, json.dumps({"values": [1], "paging": {"index": 0, "matches": 1}}))


def test_status_and_retries():
    asked, waits = _service([(503, ""), OSError("reset"), (429, ""), (408, ""), (500, ""), GOOD])
    assert asked.page("p", {}, 0) == ([1], 1) and waits == [60, 120, 240, 480, 540]
    for answers, error in (([(401, "")], service.Unauthorized), ([(404, "")], service.UnexpectedStatus), ([(500, "")] * 7, service.UnexpectedStatus), ([OSError("x")] * 7, OSError), ([(200, "no json")], service.BadAnswer), ([(200, '{"values": 1, "paging": {"matches": 1}}')], service.BadAnswer), ([(200, "[]")], service.BadAnswer)):
        with pytest.raises(error):
            _service(answers)[0].page("p", {}, 0)


def test_short_pages_and_missing_ones():
    page = lambda v, n: (200, json.dumps({"values": v, "paging": {"index": 0, "matches": n}}))
    assert list(_service([page([1, 2], 5), page([3], 5), page([4, 5, 6], 5)])[0].rows("p", {}, 0, 5)) == [(0, [1, 2]), (2, [3]), (3, [4, 5])]
    with pytest.raises(service.BadAnswer):
        list(_service([page([1, 2], 5), page([], 5)])[0].rows("p", {}, 0, 5))


def test_over_http(spark):
    server = fake_bank.serve()
    options = {"url": f"http://127.0.0.1:{server.server_address[1]}", "token": "secret", "wait_seconds": "0"}
    paged.register(spark)
    try:
        rows = spark.read.format("paged_transactions").options(**options, accounts="rest").load().collect()
        assert sorted(json.loads(r.value)["reference"] for r in rows) == sorted(f"rest-{k}" for k in range(7))
        info = json.loads(server.seen[-1]["x-http-request-info"])["clientRequestId"]
        assert len(info["requestId"]) == 9 and len(info["sessionId"]) == 36
        assert [r.accountId for r in paged.balances_of(spark, options).orderBy("place").collect()] == ["one", "rest", "one", "exact", "empty"]
        with pytest.raises(Exception, match="Unauthorized"):
            paged.balances_of(spark, {**options, "token": "old"}).collect()
    finally:
        server.shutdown()


def test_pages_of_one_account_are_read_by_all_tasks(spark, tmp_path):
    """10,000 pages: every page once, spread over the tasks, and no order of accounts or pages is lost."""
    accounts = spark.createDataFrame([("huge",), ("rest",), (None,), ("empty",)], "account_id string").coalesce(1)
    rows = paged.transactions_of(accounts, {**OPTIONS, "step": "1", "log": str(tmp_path)}, tasks=8).withColumn("part", F.spark_partition_id())
    found = rows.groupBy("account_id", "part").agg(F.count("*").alias("n"), F.sum("place").alias("places")).collect()
    huge = [r.n for r in found if r.account_id == "huge"]
    assert len(huge) == 8 and sum(huge) == 10_000 and max(huge) < 1.3 * min(huge)
    assert sum(r.places for r in found if r.account_id == "huge") == sum(range(10_000)) and sum(r.n for r in found if r.account_id == "rest") == 7
    seen = collections.Counter(x for f in tmp_path.iterdir() for x in f.read_text().splitlines())
    assert len(seen) == 10_000 + 7 + 1 and set(seen.values()) == {1}


def test_named_accounts_in_stretches(spark):
    paged.register(spark)
    read = spark.read.format("paged_transactions").options(**OPTIONS, accounts="rest,empty,exact", pages_per_task="2", step="2").load()
    assert read.rdd.getNumPartitions() == 4  # 7 rows in 4 pages, 6 in 3
    assert sorted((r.account_id, r.place, r.page_offset) for r in read.collect()) == sorted([("rest", k, k - k % 2) for k in range(7)] + [("exact", k, k - k % 2) for k in range(6)])


def test_import_all(spark, tmp_path):
    store, day = Snapshots(spark, str(tmp_path)), F.lit("2025-01-02").cast("date")
    assert ingest.import_all(spark, OPTIONS, store, "Bank", day) == 1 == store.version().number
    assert sorted((r.account_id, r.display_id) for r in store.read("account").collect()) == [("empty", "d-0"), ("exact", "d-bad"), ("one", "d-1.5"), ("rest", "d-2")]
    assert {r.account_id: r.amount for r in store.read("account_balance").collect()} == {"one": 1.5, "rest": 2.0, "exact": 0.0, "empty": 0.0}
    assert sorted((r.reference, r.account_id, r.amount) for r in store.read("account_transactions").collect()) == sorted((f"{a}-{k}", a, float(k)) for a, n in (("one", 3), ("rest", 7), ("exact", 6)) for k in range(n))
    before = sorted(map(tuple, store.read("account_transactions").collect()))
    ingest.import_all(spark, OPTIONS, store, "Bank", day)
    assert sorted(map(tuple, store.read("account_transactions").collect())) == before and store.read("account_balance").count() == 4


@pytest.mark.parametrize("status,error", [("401", "Unauthorized"), ("418", "UnexpectedStatus")])
def test_an_import_that_fails_changes_nothing(spark, tmp_path, status, error):
    store = Snapshots(spark, str(tmp_path))
    with pytest.raises(Exception, match=error):
        ingest.import_all(spark, {"client": "fake_bank:failing", "status": status, "wait_seconds": "0"}, store, "Bank")
    assert store.version().number == 0 and store.read("account").count() == 0


def test_stream_reads_what_was_added(spark, tmp_path):
    """Two cycles and a restart between them; each document comes once, by the offsets of its account."""
    store, path = Snapshots(spark, str(tmp_path / "store")), tmp_path / "rows.json"
    rows = [{"account": a, **d} for a, n in (("one", 3), ("rest", 5)) for d in fake_bank.transactions(a)[:n]]
    options = {"client": "fake_bank:growing", "path": str(path), "accounts": "one,rest", "page_rows": "2", "pages_per_task": "1"}
    batches = []

    def cycle():
        ingest.import_account_stream(spark, options, store, str(tmp_path / "checkpoint"), batches.append).awaitTermination()
        return sorted(r.reference for r in store.read("account_transactions").collect())

    path.write_text(json.dumps(rows))
    assert cycle() == sorted([f"one-{k}" for k in range(3)] + [f"rest-{k}" for k in range(5)])
    store.run(lambda tx: tx.delete("account_transactions", spark.createDataFrame([("one-0",)], "reference string"), "reference"))
    path.write_text(json.dumps(rows + [{"account": "rest", **d} for d in fake_bank.transactions("rest")[5:]]))
    assert cycle() == sorted(["one-1", "one-2"] + [f"rest-{k}" for k in range(7)])  # one-0 isn't read again
    n = len(batches)
    assert cycle() and len(batches) == n


def test_model_answers_under_a_contract(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    store.write("categories", spark.createDataFrame([(1, "food", "bread")], "id int, category string, subcategory string"))
    moves = spark.createDataFrame([(str(k), None if k == 9 else str(k)) for k in range(10)], "reference string, text string")
    run = lambda more={}: classify.label_pending(store, moves, F.col("text"), {"model": "fake_bank:Model", "wait_seconds": "0", **more})
    assert run({"retries": "1"}) == (1, 9)
    told = {r.reference: r.reason for r in store.read(classify.REJECTED).collect()}
    assert told["1"] == told["7"] == "no JSON object of the schema" and told["2"] == "confidence isn't from 0 to 1" and told["3"] == "unknown category" and told["6"] == "reasoning is missing" and told["9"] == "no question"
    assert told["5"] == "ConnectionError: gone" and told["4"] == "OSError: busy" and told["8"] in ("no JSON object of the schema", "confidence is missing")
    assert run() == (1, 8)  # with more retries the fourth is answered, and nothing that has a label is asked for
    assert sorted((r.reference, r.category_id, r.confidence) for r in store.read("transaction_categories").collect()) == [("0", 1, 0.5), ("4", 1, 0.5)]
    assert "4" not in {r.reference for r in store.read(classify.REJECTED).collect()} and store.version().number == 3


def test_prompt(spark):
    dim = spark.createDataFrame([("food", "milk"), ("food", "bread"), ("car", "fuel")], "category string, subcategory string")
    row = spark.range(1).select(classify.prompt("Use {categories} only.", dim).alias("p")).first()
    assert row.p == 'Use [{"category":"car","subcategories":["fuel"]},{"category":"food","subcategories":["bread","milk"]}] only.'
    assert categorize.category_dim(dim).count() == 3


def test_next_run_is_counted_from_the_last_finish():
    now, runs, fails = [0.0], [], []

    def job():
        runs.append(now[0])
        now[0] += 50
        if fails and fails.pop(0):
            raise OSError("x")

    def sleep(seconds):
        now[0] += seconds

    loop = lambda **more: schedule.run_every(job, delay=100, clock=lambda: now[0], sleep=sleep, **more)
    assert loop(rounds=3) == 3 and runs == [0, 150, 300]
    runs.clear()
    now[0], fails[:] = 0.0, [True, True, False]
    assert loop(rounds=2) == 2 and runs == [0, 650, 1900, 2050]  # 10 and 20 minutes after the failures, then the delay
    runs.clear()
    now[0], fails[:] = 0.0, [True] * 6
    with pytest.raises(OSError):
        loop()
    assert [b - a - 50 for a, b in zip(runs, runs[1:])] == [600, 1200, 2400, 3600, 3600]
    fails[:], runs[:] = [True], []
    with pytest.raises(OSError):
        loop(fatal=(OSError,))
    assert len(runs) == 1 and loop(until=lambda: True) == 0


def test_the_import_as_a_job(spark, tmp_path, monkeypatch):
    """Settings from the environment, two cycles over HTTP, and an end when the session has ended."""
    server = fake_bank.serve()
    environ = {"APP_BANK__URL": f"http://127.0.0.1:{server.server_address[1]}", "APP_BANK__TOKEN": "secret", "APP_BANK__WAIT_SECONDS": "0", "APP_STORE": str(tmp_path), "APP_DELAY_SECONDS": "5"}
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    monkeypatch.setattr(fake_bank, "ROWS", {**fake_bank.ROWS, "huge": 0})
    try:
        settings = from_environment(Settings, environ)
        assert job.import_loop(spark, settings, rounds=2, clock=lambda: now[0], sleep=sleep) == 2 and slept == [5.0]
        store = Snapshots(spark, str(tmp_path))
        assert store.version().number == 2 and store.read("account_transactions").count() == 16 and store.read("account").count() == 4
        with pytest.raises(job.SessionEnded):
            job.import_loop(spark, from_environment(Settings, {**environ, "APP_BANK__TOKEN": "old"}), sleep=lambda s: pytest.fail("it waits"))
        assert store.version().number == 2
    finally:
        server.shutdown()
