"""Transactions over stored tables: conflicts, touched buckets, batches once, several tables, migrations."""

import concurrent.futures
import json
import random

import pytest
from pyspark.sql import functions as F

import fake_bank
from ledgerlake.operators import merge
from ledgerlake.plans import migrations as M
from ledgerlake.plans.store import Conflict, Snapshots
from ledgerlake.sources.schemas import TABLES
from ledgerlake.streaming import ingest

COLUMNS = "k string, a string, v int"


@pytest.fixture
def store(spark, tmp_path):
    made = Snapshots(spark, str(tmp_path / "store"), buckets=8)
    made.run(lambda tx: tx.create("t", COLUMNS, ("k",)))
    return made


def _batch(spark, rows):
    return spark.createDataFrame(rows, COLUMNS + ", n int")


def _put(store, rows, keep=()):
    return store.run(lambda tx: tx.upsert("t", _batch(store.spark, rows), F.col("n"), keep))


def _rows(store, name="t", number=None):
    return sorted(tuple(r) for r in store.read(name, number).collect())


def test_second_writer_of_a_version_fails(store, spark):
    _put(store, [("a", "x", 1, 1)])
    one, two = store.begin(), store.begin()
    one.upsert("t", _batch(spark, [("b", "x", 2, 1)]), F.col("n"))
    two.upsert("t", _batch(spark, [("c", "x", 3, 1)]), F.col("n"))
    assert store.commit(one)
    with pytest.raises(Conflict):
        store.commit(two)
    assert _rows(store) == [("a", "x", 1), ("b", "x", 2)] and store.version().number == 3
    assert [n for n in store.files.names("commits") if not n.isdigit() and not n.startswith(".")] == []


def test_second_writer_tries_again(store, spark):
    """Another commit comes between: the work is done anew on what is there then, and no row is lost."""
    calls = []

    def work(tx):
        calls.append(tx.base.number)
        if len(calls) == 1:
            _put(store, [("a", "first", 1, 1), ("b", "first", 1, 1)])
        tx.upsert("t", _batch(spark, [("a", "second", 5, 2)]), F.col("n"), keep=("a",))

    assert store.run(work)
    assert calls == [1, 2] and _rows(store) == [("a", "first", 5), ("b", "first", 1)]


def test_stale_overwrite_fails_and_writers_of_other_tables_dont_meet(store, spark):
    _put(store, [("a", "x", 1, 1)])
    old = store.version().number
    derived = store.read("t").where("v > 0")
    _put(store, [("b", "x", 1, 1)])
    with pytest.raises(Conflict):
        store.write("t", derived, number=old)
    other = store.begin()
    other.create("u", COLUMNS, ("k",))
    _put(store, [("c", "x", 1, 1)])
    assert store.commit(other)
    assert [r[0] for r in _rows(store)] == ["a", "b", "c"] and _rows(store, "u") == []


def test_a_number_is_published_once(store):
    assert store.files.publish("commits/77", "{}") and not store.files.publish("commits/77", "other")
    assert store.files.read("commits/77") == "{}"


def test_merges_touch_only_the_buckets_they_hit(store, spark):
    _put(store, [(f"k{i}", "x", i, 1) for i in range(200)])
    before = store.manifest("t", store.version()).folders
    assert len(before) == 8 and len({f for fs in before.values() for f in fs}) == 8
    _put(store, [("k7", "y", -1, 2)])
    after = store.manifest("t", store.version()).folders
    assert sum(before[b] != after[b] for b in before) == 1
    store.run(lambda tx: tx.insert_ignore("t", _batch(spark, [("k7", "z", 0, 3), ("new", "z", 9, 2), ("new", "z", 8, 1)]), F.col("n")))
    added = store.manifest("t", store.version()).folders
    grown = [b for b in after if after[b] != added[b]]
    assert len(grown) == 1 and added[grown[0]][:-1] == after[grown[0]]  # what was stored stays where it is
    want = {f"k{i}": ("x", i) for i in range(200)} | {"k7": ("y", -1), "new": ("z", 8)}
    assert {k: (a, v) for k, a, v in _rows(store)} == want
    store.run(lambda tx: tx.compact("t", 1))
    packed = store.manifest("t", store.version()).folders
    assert all(len(f) == 1 for f in packed.values()) and [b for b in packed if packed[b] != added[b]] == grown
    assert {k: (a, v) for k, a, v in _rows(store)} == want
    store.run(lambda tx: tx.delete("t", spark.createDataFrame([("k7",), ("no such",)], "k string"), "k"))
    store.run(lambda tx: tx.delete("t", spark.createDataFrame([(5,), (6,)], "v int"), "v"))
    assert {r[0] for r in _rows(store)} == set(want) - {"k7", "k5", "k6"}


def test_replace_drops_what_the_batch_lacks(store, spark):
    _put(store, [("a", "x", 1, 1), ("b", "x", 1, 1)])
    store.run(lambda tx: tx.replace("t", spark.createDataFrame([("a", 4, 1), ("a", 3, 0)], "k string, v int, n int"), F.col("n")))
    assert _rows(store) == [("a", None, 4), ("b", "x", 1)]


def test_a_batch_counts_once(store, spark):
    def add(number):
        return store.run(lambda tx: tx.upsert("t", tx.read("t").withColumn("v", F.col("v") + 1).withColumn("n", F.lit(1)), F.col("n")), source="s", batch=number)

    _put(store, [("a", "x", 0, 1)])
    assert add(0) and add(1) and not add(1) and not add(0)
    assert _rows(store) == [("a", "x", 2)]
    late = store.begin()  # a writer that began before the batch was committed elsewhere
    assert store.run(lambda tx: tx.create("u", COLUMNS, ("k",)), source="s", batch=2)
    late.create("w", COLUMNS, ("k",))
    assert not store.commit(late, source="s", batch=2) and "w" not in store.version().tables


def test_several_tables_change_together(store, spark):
    store.run(lambda tx: tx.create("aside", COLUMNS, ("k",)))

    def work(tx):
        tx.upsert("t", _batch(spark, [("a", "x", 1, 1)]), F.col("n"))
        assert [r.k for r in tx.read("t").collect()] == ["a"]  # its own changes
        tx.upsert("aside", _batch(spark, [("b", "x", 1, 1)]), F.col("n"))
        if broken:
            raise OSError("the writer stops")

    broken, before = True, store.version()
    with pytest.raises(OSError):
        store.run(work)
    assert store.version() == before and _rows(store) == _rows(store, "aside") == []
    broken = False
    store.run(work)
    assert _rows(store) == [("a", "x", 1)] and _rows(store, "aside") == [("b", "x", 1)]


def test_versions_stay_until_they_are_removed(store):
    for v in range(4):
        _put(store, [("a", "x", v, 1)])
    assert [_rows(store, number=n)[0][2] for n in (2, 3, 4, 5)] == [0, 1, 2, 3]
    assert store.vacuum(keep=2, seconds=3600) == 3  # the commits alone: their files are too young
    assert store.vacuum(keep=2, seconds=-60) == 5  # of versions 1 to 3: three manifests, two folders
    assert _rows(store, number=4)[0][2] == 2 and _rows(store)[0][2] == 3
    with pytest.raises(Exception):
        store.read("t", 2)


def test_many_writers_at_once(spark, tmp_path):
    """Threads that all change the same rows: every change counts, in some order."""
    store = Snapshots(spark, str(tmp_path), buckets=2)
    store.run(lambda tx: tx.create("t", COLUMNS, ("k",)))
    _put(store, [("a", "x", 0, 1)])

    def writer(n):
        for k in range(2):
            store.run(lambda tx: tx.upsert("t", tx.read("t").where("k = 'a'").withColumn("v", F.col("v") + 1).withColumn("n", F.lit(1)), F.col("n")), attempts=50)
            store.run(lambda tx, k=k: tx.upsert("t", _batch(spark, [(f"{n}-{k}", "x", 1, 1)]), F.col("n")), attempts=50)

    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        list(pool.map(writer, range(4)))
    rows = {r[0]: r[2] for r in _rows(store)}
    assert rows.pop("a") == 8 and set(rows) == {f"{n}-{k}" for n in range(4) for k in range(2)}
    assert store.version().number == 2 + 16


def test_children_go_with_their_parents(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), buckets=2)
    store.write("categories", spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, category string, subcategory string"))
    store.write("transactions", spark.createDataFrame([("r1",), ("r2",), ("r3",)], "reference string").selectExpr("*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in TABLES["transactions"][0].split(", ")[1:]))))
    store.write("transaction_categories", spark.createDataFrame([("r1", 1, "", 1.0), ("r2", 2, "", 1.0), ("r3", 2, "", 1.0)], TABLES["transaction_categories"][0]))
    before = store.version().number
    store.run(lambda tx: tx.delete_with_children("categories", spark.createDataFrame([("a", "x")], "category string, subcategory string").select("category"), "category"))
    store.run(lambda tx: tx.delete_with_children("transactions", spark.createDataFrame([("r2",)], "reference string"), "reference"))
    assert store.version().number == before + 2
    assert [r.id for r in store.read("categories").collect()] == [2] and [r.reference for r in store.read("transaction_categories").collect()] == ["r3"]
    assert sorted(r.reference for r in store.read("transactions").collect()) == ["r1", "r3"]


def test_unique_keys_as_if_row_by_row(spark):
    """Against a loop over the rows: chains in which a row that is left out lets a later one in, ties, nulls, and what is stored."""
    rng = random.Random(6)
    for trial in range(6):
        rows = [(rng.choice([None, *range(7)]), rng.choice([None, *"abcdef"]), rng.randint(0, 2), k) for k in range(40)]
        stored = [(3, "c"), (50, "z")] if trial % 2 else []
        keys, ibans, want = {k for k, _ in stored}, {i for _, i in stored}, []
        for k, i, _, n in sorted(rows, key=lambda r: (r[2], r[3])):
            if k not in keys and i not in ibans:
                want.append(n)
                keys |= {k} - {None}
                ibans |= {i} - {None}
        batch = spark.createDataFrame(rows, "k int, i string, at int, n int")
        taken, left = merge.insert_unique(spark.createDataFrame(stored, "k int, i string"), batch, [["k"], ["i"]], F.struct("at", "n"))
        assert sorted(r.n for r in taken.collect()) == sorted(want)
        assert sorted(r.n for r in left.collect()) == sorted({r[3] for r in rows} - set(want))


def test_an_account_with_the_iban_of_another_stays_out(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), buckets=2)
    values = [fake_bank.balance("a", "1"), fake_bank.balance("b", "2"), fake_bank.balance("c", "3")]
    values[1]["account"]["iban"] = "i-a"
    (tmp_path / "page.json").write_text(json.dumps({"values": values, "paging": {"index": 0, "matches": 3}}))
    for _ in range(2):
        ingest.load_accounts(spark, str(tmp_path / "page.json"), store, "Bank", F.lit("2025-01-02").cast("date"))
        assert sorted(r.account_id for r in store.read("account").collect()) == sorted(r.account_id for r in store.read("account_balance").collect()) == ["a", "c"]


def _document(reference, value):
    return {"reference": reference, "bookingStatus": "BOOKED", "bookingDate": "2025-03-01", "amount": {"value": value, "unit": "EUR"}, "valutaDate": "2025-03-01", "newTransaction": False, "remittanceInfo": "x", "transactionType": {"key": "K", "text": "T"}}


def test_a_crash_between_commit_and_checkpoint(spark, tmp_path):
    """The batch is delivered again; the commit tells that it counts already, though another import has changed its row meanwhile."""
    store, folder = Snapshots(spark, str(tmp_path / "store")), tmp_path / "in"
    folder.mkdir()
    (folder / "1.ndjson").write_text(json.dumps(_document("r", "1")) + "\n")

    def crash(number):
        raise OSError("ends before the checkpoint")

    run = lambda **more: ingest.import_transactions(spark, str(folder), store, str(tmp_path / "checkpoint"), "a", **more).awaitTermination()
    with pytest.raises(Exception, match="ends before"):
        run(finished=crash)
    assert store.version().number == 1
    store.run(lambda tx: tx.overwrite("account_transactions", tx.read("account_transactions").withColumn("amount", F.lit(9.0))))
    run()
    assert store.version().number == 2 and [r.amount for r in store.read("account_transactions").collect()] == [9.0]
    (folder / "2.ndjson").write_text(json.dumps(_document("r", "3")) + "\n")
    run()
    assert store.version().number == 3 and [r.amount for r in store.read("account_transactions").collect()] == [3.0]


STEPS = [
    M.Step(1, "accounts", (M.Create("acc", "id int, name string", ("id",)),), (M.Drop("acc"),)),
    M.Step(2, "balance", (M.AddColumn("acc", "note", "string"), M.AddColumn("acc", "balance", "double", "id * 1.5")), (M.DropColumn("acc", "balance"), M.DropColumn("acc", "note"))),
    M.Step(3, "names", (M.Update("acc", (("name", "upper(name)"),)),), (M.Update("acc", (("name", "lower(name)"),)),)),
]


def test_migrations_up_and_down_over_rows(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert M.migrate(store, STEPS, to=1) == [(1, "up")]
    store.write("acc", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
    assert M.migrate(store, STEPS) == [(2, "up"), (3, "up")] and M.migrate(store, STEPS) == []
    assert _rows(store, "acc") == [(1, "A", None, 1.5), (2, "B", None, 3.0)]
    assert M.migrate(store, STEPS, to=1) == [(3, "down"), (2, "down")]
    assert _rows(store, "acc") == [(1, "a"), (2, "b")]
    assert M.migrate(store, STEPS) == [(2, "up"), (3, "up")]
    assert [(r.place, r.number, r.direction) for r in M.ledger(store).orderBy("place").collect()] == [(1, 1, "up"), (2, 2, "up"), (3, 3, "up"), (4, 3, "down"), (5, 2, "down"), (6, 2, "up"), (7, 3, "up")]
    assert M.migrate(store, STEPS, to=0) == [(3, "down"), (2, "down"), (1, "down")]
    with pytest.raises(KeyError):
        store.read("acc")


def test_changed_missing_and_late_steps_are_refused(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    M.migrate(store, STEPS, to=2)
    changed = [STEPS[0], M.Step(2, "balance", (M.AddColumn("acc", "balance", "double"),)), STEPS[2]]
    for bad in (changed, STEPS[1:], [*STEPS, M.Step(0, "late", (M.Drop("acc"),))]):
        with pytest.raises(M.ChangedStep):
            M.migrate(store, bad)
    with pytest.raises(ValueError):
        M.migrate(store, [*STEPS, STEPS[0]])
    forward = [*STEPS[:2], M.Step(3, "no way back", (M.Update("acc", (("name", "upper(name)"),)),))]
    M.migrate(store, forward)
    with pytest.raises(ValueError, match="can't be undone"):
        M.migrate(store, forward, to=1)


def test_a_step_that_fails_leaves_nothing_and_is_run_again(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    M.migrate(store, STEPS[:1])
    store.write("acc", spark.createDataFrame([(1, "a")], "id int, name string"))
    bad = M.Step(2, "bad", (M.AddColumn("acc", "x", "int", "1"), M.Update("acc", (("name", "no_such_function(name)"),))))
    with pytest.raises(Exception):
        M.migrate(store, [STEPS[0], bad, M.Step(3, "then", (M.Drop("acc"),))])
    assert _rows(store, "acc") == [(1, "a")] and M.ledger(store).count() == 1
    good = M.Step(2, "bad", (M.AddColumn("acc", "x", "int", "1"),))
    assert M.migrate(store, [STEPS[0], good]) == [(2, "up")] and _rows(store, "acc") == [(1, "a", 1)]
