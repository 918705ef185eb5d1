"""Work of a window follows the items it can match, and no match is lost."""

import random
import time

import numpy as np

from ledgerlake.llm import decontaminate


def test_reach_gives_the_pairs_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.random((200, 64)) < 0.5
    flips = rng.random((300, 64)) < rng.choice([0.1, 0.3, 0.35], (300, 1))
    windows = items[rng.integers(0, 200, 300)] ^ flips
    index = decontaminate.HammingIndex(items)
    apart = (windows[:, None] != items[None]).sum(2)
    for reach in (None, np.arange(200), np.arange(0, 200, 3), np.array([5]), np.arange(1, 190), np.zeros(0, np.int64)):
        own = np.arange(200) if reach is None else reach
        want = sorted((int(w), int(i), int(apart[w, i])) for w in range(300) for i in own if apart[w, i] <= decontaminate.RADIUS)
        assert sorted(zip(*(x.tolist() for x in index.within(windows, reach)))) == want


def test_time_doesnt_grow_with_the_number_of_items():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    seconds = []
    for n in (500, 20_000):
        items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)]
        text = " ".join(x for i in range(10) for x in (items[i * 3], " ".join(rng.choice(words) for _ in range(130))))
        index = decontaminate.ItemIndex(items)
        index.matches(text)
        began = time.perf_counter()
        assert [m[0] for m in index.matches(text)] == [i * 3 for i in range(10)]
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 5 * seconds[0] + 0.05


def test_parts_of_a_benchmark_give_what_it_gives_whole(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 12, 30])))) for k in range(11)] + [(11, None), (12, "")]
    texts = [(k, " ".join([*(rng.choice(words) for _ in range(40)), *(rng.choice(items[:11])[1] for _ in range(k % 3)), *(rng.choice(words) for _ in range(9))])) for k in range(30)] + [(30, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shown = lambda: sorted(tuple(r) for r in decontaminate.contaminations(docs, bench).collect())
    clean = lambda: sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect())
    whole = shown(), clean()
    assert len(whole[0]) > 10 and 0 < len(whole[1]) < 31
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 3)
    assert len(list(decontaminate.item_parts(bench))) == 4 and (shown(), clean()) == whole
    monkeypatch.setattr(decontaminate, "MAX_ITEM_CHARS", 20)
    assert len(list(decontaminate.item_parts(bench))) > 4 and (shown(), clean()) == whole
