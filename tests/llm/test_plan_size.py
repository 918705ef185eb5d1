"""What Spark takes a table's size for doesn't grow with the rounds of joins that made it."""

import random

import pytest

from ledgerlake.llm import near_dedup


def digits(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


@pytest.fixture
def in_rounds(monkeypatch):
    monkeypatch.setattr(near_dedup, "ONE_TASK", 0)


def test_rounds_over_a_chain(spark, in_rounds):
    order = random.Random(5).sample(range(1, 40), 39)
    links = spark.createDataFrame(list(zip([0, *order], order)), "a long, b long")
    labels = near_dedup.connected(links)
    assert sorted(map(tuple, labels.collect())) == [(n, 0) for n in range(40)]
    assert digits(labels) < 100


def test_rounds_up_a_chain_and_links_added(spark, in_rounds):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    up = spark.createDataFrame([(n - 2, n) for n in range(2, 60)], "a long, b long")
    labels = near_dedup.rooted(nodes, 60, up)
    assert sorted(map(tuple, labels.collect())) == [(n, n % 2) for n in range(60)]
    assert digits(labels) < 100
    merged = near_dedup._merged(labels, 60, spark.createDataFrame([(7, 10)], "a long, b long"))
    assert sorted(map(tuple, merged.collect())) == [(n, 0) for n in range(60)]
    assert digits(merged) < 100


def test_near_duplicates_stage(spark, in_rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    most = []
    monkeypatch.setattr(near_dedup, "_compact", lambda df, rows, compact=near_dedup._compact: most.append(digits(df)) or compact(df, rows))
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words[5 * k : 5 * k + 200])) for k in range(40)], "doc_id long, text string")
    kept = near_dedup.one_of_each(docs)
    assert [r.doc_id for r in kept.collect()] == [0]
    assert len(most) > 8 and max(most) < 3_000
