"""Bounded samples take from every class, in the order of a hash."""

import collections

from ledgerlake.llm import common


def test_classes_take_turns():
    rows = [(f"{k:03}", "common" if k < 90 else "rare", (k * 7919) % 101, 10) for k in range(100)]
    got = common.fair_share(rows, 200)
    of = {r[0]: r[1] for r in rows}
    assert collections.Counter(of[i] for i in got) == {"common": 10, "rare": 10}
    at = {r[0]: r[2] for r in rows}
    for y in ("common", "rare"):
        own = [at[i] for i in got if of[i] == y]
        assert own == sorted(at[r[0]] for r in rows if r[1] == y)[: len(own)]
    assert common.fair_share(rows, 10_000) and common.fair_share(rows, 9) == [] and common.fair_share([], 5) == []


def test_texts_of_a_sample_over_its_bound(spark, monkeypatch):
    """The ids that sort last as text are those of the rare class: they come in all the same."""
    docs = spark.createDataFrame([(k, "x" * 10) for k in range(10, 100)] + [(5, None), (6, "y" * 99)], "id long, text string")
    ids = spark.createDataFrame([(k, "rare" if k > 89 else "common") for k in range(100)], "id long, y string")
    assert common.texts_of(docs, ids, 50).count() == 90
    monkeypatch.setattr(common, "MAX_TOTAL", 200)
    got = common.texts_of(docs, ids, 50).collect()
    assert collections.Counter(r.y for r in got) == {"common": 10, "rare": 10} and all(r.text == "x" * 10 for r in got)
