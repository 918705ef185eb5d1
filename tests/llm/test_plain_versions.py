"""Parts of the operators against plain versions, and the stages on awkward tables."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerlake.llm import common, decontaminate, piece_sampling, quality_model, quality_rules, toxicity


def _small_pieces():
    names = [f"<0x{b:02X}>" for b in range(256)] + ["a", "b", "c", "ab", "▁", "▁c", "bc", "cc", "▁▁", "ca"]
    return piece_sampling.Pieces(names, {b: b for b in range(256)}), names


@pytest.mark.parametrize("text", ["abc ccab", "ab  c\nxb", "cab"])
def test_segmentations_by_enumeration(text):
    pieces, names = _small_pieces()
    plain = text.replace(" ", "▁")

    def ways(at):
        if at == len(plain):
            yield (), 0.0
        found = [(k, n) for k, n in enumerate(names) if k >= 256 and plain.startswith(n, at)]
        steps = [((k,), len(n), pieces.logp[k]) for k, n in found]
        if not any(n == 1 for _, n, _ in steps) and at < len(plain):  # a character that is no piece stands as its bytes
            data = text[at].encode()
            steps.append((tuple(data), 1, len(data) * piece_sampling.LOG_BYTE))
        for ids, n, logp in steps:
            for rest, p in ways(at + n):
                yield ids + rest, logp + p

    told = dict(ways(0))
    mass = np.exp(list(told.values()))
    chance = dict(zip(told, mass / mass.sum(), strict=True))
    runs, firsts, pairs, weight = 4000, collections.Counter(), collections.Counter(), []
    sampler = piece_sampling.Sampler(pieces, 2)
    for s in range(runs):
        found = sampler.run([text], [s * 104729 + 5])[0]
        ids = [tuple(f["ids"].tolist()) for f in found]
        assert len(set(ids)) == len(ids) == min(2, len(chance))
        for f, i in zip(found, ids, strict=True):
            assert abs(np.exp(f["log_prob"]) - chance[i]) < 1e-9
        firsts[ids[0]] += 1
        pairs[tuple(ids[:2])] += 1
        weight.append(sum(chance[i] / f["inclusion"] for f, i in zip(found, ids, strict=True)))
    for i, p in chance.items():
        assert abs(firsts[i] / runs - p) < 4 * np.sqrt(p * (1 - p) / runs) + 1e-3
    for (i, j), n in pairs.items():
        p = chance[i] * chance[j] / (1 - chance[i])
        assert abs(n / runs - p) < 4 * np.sqrt(p * (1 - p) / runs) + 1e-3
    assert abs(np.mean(weight) - 1) < 5 * np.std(weight) / np.sqrt(runs) + 1e-6  # samples over inclusions are unbiased


def test_cuts_are_where_no_piece_crosses():
    pieces = piece_sampling.load_pieces()
    text = "Hello, world!  It's 3.14 — naïve\n\tx=1; 漢字 " * 3
    parts = pieces.cut([text, "", text])
    assert parts.counts.tolist()[1] == 0 and parts.counts[0] == parts.counts[2]
    assert "".join(chr(c) for c in parts.points) == text * 2 and parts.sizes.sum() == len(parts.points)
    token = [text[a : a + n] for a, n in zip(parts.starts.tolist(), parts.sizes.tolist(), strict=True) if a < len(text)]
    known = {}
    for t, h in zip(token, parts.hashes.tolist(), strict=False):
        assert known.setdefault(t, h) == h
    assert len(set(known.values())) == len(known)


def test_tree_splits_and_lasso():
    rng = np.random.default_rng(2)
    x = np.round(rng.random((80, 3)), 2)
    y = ((x[:, 1] > 0.4) & (rng.random(80) < 0.9)).astype(int)
    cuts = [np.unique(x[:, f])[:-1] for f in range(3)]
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    gain = {(f, t): gini(y) - gini(y[x[:, f] > t]) - gini(y[x[:, f] <= t]) for f in range(3) for t in cuts[f] if 5 <= (x[:, f] > t).sum() <= 75}
    best = max(gain, key=gain.get)
    rules = quality_model._tree_paths(x, y, cuts, np.arange(3), 1)
    assert {r.conditions for r in rules} == {((best[0], side, best[1]),) for side in (True, False)}
    hits = (rng.random((200, 12)) < 0.3).astype(float)
    target = (hits[:, 0] + hits[:, 3] + rng.random(200) > 1.2).astype(float)
    w, b = quality_model._lasso(hits, target, 0.02, rounds=5000)
    slope = hits.T @ (common.sigmoid(hits @ w + b) - target) / 200
    assert np.all(np.abs(slope[w == 0]) <= 0.02 + 1e-4) and np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)
    assert 0 < (w != 0).sum() < 12


def test_pooled_features():
    p = np.array([0.1, 0.9, 0.2, 0.7, 0.7, 0.9, 0.8])
    got = toxicity.pooled(p, np.array([0, 2, 3]))
    for row, part in zip(got, (p[:2], p[2:3], p[3:]), strict=True):
        assert np.allclose(row, [np.log1p(part.sum()), min(part.sum(), 3), part.max(), part.sum() / np.sqrt(len(part))])


def test_rules_catch_bad_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (common.read_table(spark, sf, t) for t in ("documents", "labels"))
    rules = quality_rules.fit_rules(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = docs.where(common.in_fold(docs.doc_id, 4, 2)).join(labels.select("doc_id"), "doc_id", "left_semi")
    told = [(truth[r.doc_id], r.kept) for r in quality_rules.apply_quality_rules(held, rules).where("not base_failed").collect()]
    assert len(rules) and np.mean([k for q, k in told if q == 0]) < 0.1 and np.mean([k for q, k in told if q == 1]) > 0.97


def test_near_copies_of_items_are_found(monkeypatch):
    rng = random.Random(4)
    items = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(12, 120))] for _ in range(150)]
    bag = lambda w: collections.Counter(zip(*(w[k:] for k in range(5))))
    index = decontaminate.ItemIndex([" ".join(w) for w in items])
    wanted, found, texts = 0, 0, []
    for i, item in enumerate(items):
        for _ in range(3):
            copy = list(item)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.choice([0, 1, len(copy) - 1, len(copy) - 2, rng.randrange(len(copy))])] = f"x{rng.randrange(9)}"
            text = " ".join([f"y{rng.randrange(99)}" for _ in range(20)] + copy + [f"z{rng.randrange(99)}" for _ in range(20)])
            texts.append(text)
            a, b = bag(item), bag(copy)
            if (a & b).total() >= 0.8 * (a | b).total():
                wanted += 1
                found += i in {m[0] for m in index.matches(text)}
    assert wanted > 100 and found == wanted
    before = [index.matches(t) for t in texts[:40]]
    monkeypatch.setattr(decontaminate, "SLICE_PAIRS", 3)
    assert [index.matches(t) for t in texts[:40]] == before
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        assert decontaminate.shared_count(np.array(a), np.array(b)) == (collections.Counter(a) & collections.Counter(b)).total()


def test_stages_on_awkward_tables(spark, tmp_path):
    good = "The quick brown fox jumps over the lazy dog and runs away from all the other animals of the wood. " * 5
    rows = [(i, f"{good} number {i * 37}", "en" if i % 2 else "de", None, None, i, 0.5) for i in range(30)] + [(None, None, None, None, None, 1, 0.5), (40, "", "en", "s", 0, 1, 0.5), (41, " \n", None, "s", 2, 1, 0.5), (1, f"{good} number 37", "en", None, None, 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, score double")
    tables = {"labels": ("doc_id long, quality int, toxic int", [(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 1), (3, None, None)]), "benchmark": ("item_id long, text string", [(1, None), (2, ""), (None, "runs away from all the other animals of the sea")])}
    for k, rows_of in enumerate((lambda r: r, lambda r: [])):
        for name, (schema, values) in tables.items():
            spark.createDataFrame(rows_of(values), schema).write.parquet(str(tmp_path / str(k) / f"{name}.parquet"))
        for table in (docs, docs.limit(0)):
            for name, stage in corpus_pipeline.STAGES[:-1]:
                out = stage(spark, table, str(tmp_path / str(k)))
                assert out.columns == docs.columns, name
                assert out.count() <= len(rows) and (table is docs or out.count() == 0)
            out = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path / str(k)))
            assert out.select("doc_id").distinct().count() == (33 if table is docs else 0)
        table = docs.select("doc_id", "text", "lang", "source", "n_chars")
        table.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / str(k))).count() >= 0


def test_models_of_other_column_names(spark):
    rows = [(i, ("idiot clown " if i % 2 else "kind words ") + "of the house and the tree " * 12, i % 2) for i in range(160)]
    docs = spark.createDataFrame(rows, "`the id` long, body string, bad int")
    for fit in (quality_model.fit_ensemble, quality_rules.fit_rules, toxicity.fit_toxicity):
        fit(docs, docs, key="the id", text="body", label="bad")
    field = toxicity.fit_toxicity(docs, docs, key="the id", text="body", label="bad")
    told = toxicity.score_toxicity(docs.select(docs["the id"].alias("k"), "body"), field, key="k", text="body").collect()
    assert all(r.predicted == r.doc_id % 2 for r in told)
