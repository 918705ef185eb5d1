"""Mixing against a plain version that fills targets step by step and sorts rows by their hash."""

import collections
import hashlib
import random
import re

from ledgerlake.llm import mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    given, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in sorted(open_, key=names.index):
            given[s] += left * weight[s] / total
        left = 0.0
        for s in [s for s in open_ if given[s] > most * sizes[s]]:
            left += given[s] - most * sizes[s]
            given[s] = float(most * sizes[s])
            open_.discard(s)
    return given


def _plain(rows, **more):
    h = lambda x: hashlib.md5(x.encode()).hexdigest()
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), h(f"{'' if i is None else i}|{h(t or '')}")) for i, t, s in rows]
    sizes = collections.Counter()
    for _, s, n, _ in sized:
        sizes[s] += n
    out = []
    for s, target in _targets(sizes, **more).items():
        own = sorted((r for r in sized if r[1] == s), key=lambda r: r[3])
        copies = int(target / sizes[s] + 1e-12) if sizes[s] else 0
        rest, upto = target - copies * sizes[s], 0
        for i, _, n, _ in own:
            upto += n
            out.append((i, n, sizes[s], round(target, 6), n * (copies + (n > 0 and rest > 1e-9 and (upto <= rest or 2 * (rest - upto + n) > n)))))
    return collections.Counter(out)


def _got(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, sk int").repartition(parts)
    return collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sources(df, **more).collect())


def _rows(seed, n=400, sources=("a", "b", "é", "z", None), long=400):
    rng = random.Random(seed)
    pick = lambda: rng.choice(sources) if rng.random() < 0.6 else sources[0]
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(long if rng.random() < 0.01 else rng.randint(0, 30))) + rng.choice(["", "\n", " \t"]), pick()) for i in range(n)]


def test_equals_plain_version(spark):
    for seed, more in ((1, {}), (2, {"weights": (1.0, 8.0)}), (3, {"most": 1}), (4, {"weights": (1.0, 30.0, 2.0), "most": 2})):
        rows = _rows(seed)
        assert _got(spark, rows, **more) == _plain(rows, **more)


def test_sums_come_near_targets_and_nothing_is_taken_too_often(spark):
    rows = _rows(5, 900)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for (_, size, whole, target, taken), n in _got(spark, rows).items():
        by[whole][0] += taken * n
        by[whole][1], by[whole][2] = target, max(by[whole][2], size)
        assert taken <= 3 * size and (size == 0 or taken % size == 0)
    assert len(by) == 5 and all(abs(taken - target) <= largest / 2 for taken, target, largest in by.values())


def test_a_larger_budget_takes_all_that_a_smaller_one_does(spark):
    rows = _rows(6, sources=("a", "b"))
    taken = [{r[0]: r[4] for r in _got(spark, rows, weights=(w, 2.0)) if r[1]} for w in (1.0, 1.3, 2.5)]
    sources = {i: s for i, _, s in rows}
    assert all(low[i] <= high[i] for low, high in zip(taken, taken[1:]) for i in low if sources[i] == "a")


def test_rows_alike_are_parted_by_number(spark):
    """Half of all rows are one row; how many of them are taken once more is as near the target as for any others, on every layout."""
    rows = _rows(7, 60) + [(5, "one and the same text", "b")] * 300 + [(None, "one and the same text", "b")] * 40 + [(None, None, "a"), (1, "", "b"), (2, " \n", None)]
    assert _got(spark, rows, 3) == _got(spark, rows, 7) == _plain(rows)


def test_empty_tables_and_sources_without_a_word(spark):
    assert not _got(spark, [])
    rows = [(1, None, "a"), (2, "", None), (2, "", None)]
    assert _got(spark, rows) == {(1, 0, 0, 0.0, 0): 1, (2, 0, 0, 0.0, 0): 2}
    assert _got(spark, rows + [(3, "x y", "c")]) == _plain(rows + [(3, "x y", "c")])


def test_words(spark):
    texts = ["a b", "", None, " \t\n\x0b\x0c\r", "x y   z", "xx" * 1000, "a\x1cb c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(mixing.n_words(df.t).alias("n")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
