"""Operators against plain versions and held-out labels on the test tables."""

import collections
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import chat_format, common, decontaminate, html_extract, language, near_dedup, piece_sampling, quality_model, quality_rules, queries, sharding, text_stats, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(df.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_counts():
    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "\xa0", "a b a b "]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = text_stats.count_batch(pa.array(texts))[:, :5].tolist()
    assert got == [list(plain(t)) for t in texts]


def _held_out(spark, query, label):
    got = queries.queries()[query](spark, SF).where("held_out").select("doc_id", "predicted").collect()
    truth = {r.doc_id: r[label] for r in common.read_table(spark, SF, "labels").collect()}
    return np.mean([truth[r.doc_id] == r.predicted for r in got if r.doc_id in truth])


def test_held_out_accuracy(spark):
    assert _held_out(spark, "op7_quality", "quality") > 0.93
    assert _held_out(spark, "op1_toxicity", "toxic") > 0.93
    docs = common.read_table(spark, SF, "documents")
    got = queries.op4_language(spark, SF).where("held_out").collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.95
    rules = quality_rules.fit_rules(docs, common.read_table(spark, SF, "labels"))
    kept = {r.doc_id: r.kept for r in quality_rules.apply_quality_rules(docs, rules).where("not base_failed").collect()}
    good = [kept[r.doc_id] for r in common.read_table(spark, SF, "labels").where("quality = 1").collect() if r.doc_id in kept]
    assert np.mean(good) > 0.95


def test_score_column_equals_numpy(spark):
    docs = common.read_table(spark, SF, "documents").limit(200)
    rng = np.random.default_rng(0)
    x = rng.random((300, len(text_stats.FEATURES))) * 3
    model = quality_model.learn_ensemble(x, (x[:, 1] > 1.5).astype(int))
    texts = [r.text for r in docs.collect()]
    want = model.scores(text_stats.feature_matrix(text_stats.count_batch(pa.array(texts))))
    assert np.allclose([r.score for r in quality_model.score_quality(docs, model).collect()], want)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(5))
    lengths = np.array([3, 1, 5])
    e = rng.normal(size=9)
    got, at = toxicity.marginals(field, e, lengths), 0
    for n in lengths:
        total, hot = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(field.start[y[0]] + sum(e[at + k] * y[k] for k in range(n)) + sum(field.move[a, b] for a, b in zip(y, y[1:])))
            total += w
            hot += w * np.array(y)
        assert np.allclose(got[at : at + n], hot / total)
        at += n


def test_spans():
    assert toxicity.toxic_spans("a bad\nworse x", np.array([0, 0.9, 0.8, 0.1])) == [(2, 5), (6, 11)]


def test_pages(spark):
    raw = {r.page_id: r.html for r in common.read_table(spark, SF, "pages").collect()}
    for r in queries.op5_html(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1]
        blocks = re.sub(r"<(?:p|h1)>|</(?:p|h1)>", "\0", body).split("\0")
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in blocks]
        assert r.text == "\n".join(filter(None, want))


def test_shards(spark):
    docs = common.read_table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sharding.shard_layout(docs).collect():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data)) and r.grown_shard in (r.shard, 24)
    heavy = collections.Counter(r.shard for r in sharding.assign_shards(docs, weights=(1.0, 3.0)).collect())
    assert 2.2 < heavy[1] / heavy[0] < 4


@pytest.mark.parametrize("bound", [None, 0])
def test_near_duplicates_by_all_pairs(spark, monkeypatch, bound):
    if bound is not None:  # as with tables too large to broadcast or for one task
        monkeypatch.setattr(near_dedup, "BROADCAST_IDS", bound)
        monkeypatch.setattr(near_dedup, "ONE_TASK", bound)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    plan = near_dedup.plan_for(3, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()}
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(rows))}


def test_components_by_search():
    rng = np.random.default_rng(8)
    for n, m in ((30, 20), (200, 150), (5, 0)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        nodes, labels = near_dedup.components(a, b)
        want = {x: x for x in range(n)}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        assert dict(zip(nodes.tolist(), labels.tolist())) == {x: want[x] for x in nodes.tolist()}


def test_register_estimates():
    rng = np.random.default_rng(5)
    plan = near_dedup.plan_for(3, 85)
    probes = near_dedup._probes(plan.registers)
    off = []
    for shared in (500, 900, 970):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**63, 2_500, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = (np.sort(np.concatenate([pool[:shared], pool[s : s + 1000 - shared]])) for s in (1000, 2000 - shared))
            ra, rb = (near_dedup.registers_of(s, plan.registers, probes)[None] for s in (a, b))
            off.append(near_dedup.estimates(ra, rb, np.array([1000.0]), np.array([1000.0]))[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(6)
    items, windows = rng.random((40, 64)) < 0.5, None
    flips = [rng.permutation(64)[:n] for n in range(0, 41)]
    windows = np.array([np.logical_xor(items[k % 40], np.isin(np.arange(64), f)) for k, f in enumerate(flips)])
    w, i, d = decontaminate.HammingIndex(items).within(windows)
    apart = (windows[:, None] != items[None]).sum(-1)
    assert set(zip(w.tolist(), i.tolist(), d.tolist())) == {(a, b, int(apart[a, b])) for a, b in zip(*np.nonzero(apart <= decontaminate.RADIUS))}


def test_decontamination_by_all_windows(spark):
    docs, items = common.read_table(spark, SF, "documents"), common.read_table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, items).collect()}
    told = [(r.item_id, decontaminate.words_of(r.text)) for r in items.collect()]
    want, near = set(), set()
    for r in docs.collect():
        words = decontaminate.words_of(r.text)
        text = f" {' '.join(words)} "
        for i, w in told:
            if f" {' '.join(w)} " in text:
                want.add((r.doc_id, i))
    assert want == got | near
    index = decontaminate.ItemIndex([" ".join(f"w{k}" for k in range(60))])
    changed = " ".join(["x"] * 30 + [f"w{k}" if k != 25 else "other" for k in range(60)] + ["y"] * 9)
    (m,) = index.matches(changed)
    assert m[1:3] == (30, 60) and abs(m[4] - 51 / 61) < 1e-9


def test_sampling_without_replacement():
    pieces = piece_sampling.load_pieces()
    sampler = piece_sampling.Sampler(pieces, 2)
    firsts, seconds, chance = collections.Counter(), collections.Counter(), {}
    for s in range(1500):
        one, two = sampler.run(["thea"], [s * 7919 + 1])[0]
        for counter, f in ((firsts, one), (seconds, two)):
            k = tuple(f["ids"].tolist())
            counter[k] += 1
            chance[k] = np.exp(f["log_prob"])
        assert one["perturbed"] >= two["perturbed"] and firsts.keys()
    top = firsts.most_common(1)[0][0]
    assert abs(firsts[top] / 1500 - chance[top]) < 0.05
    rest = {k: p / (1 - chance[top]) for k, p in chance.items() if k != top}
    best = max(rest, key=rest.get)
    assert abs(seconds[best] / (1500 - seconds[top]) - rest[best]) < 0.08


def test_schema_violations():
    schema = {"type": "object", "properties": {"n": {"type": "number", "maximum": 3}, "s": {"type": "string", "pattern": "^a", "maxLength": 2}, "l": {"type": "array", "items": {"enum": [1, 2]}}}, "required": ["n"], "additionalProperties": False}
    assert chat_format.violations({"n": 2.5, "s": "ab", "l": [1, 2]}, schema) == []
    assert chat_format.violations({"s": "bcd", "l": [3], "z": 1}, schema) == ["$.n: required", "$.l[0]: enum", "$.s: maxLength", "$.s: pattern", "$.z: not allowed"]
    assert chat_format.violations({"n": True}, schema) == ["$.n: type"] and chat_format.violations({"n": 4}, schema) == ["$.n: maximum"]
