"""The pipeline and what it asks of its stages."""

import collections
import glob
import re

import pyarrow as pa

import corpus_pipeline
from ledgerlake.llm import common, decontaminate, language, near_dedup, piece_sampling, quality_model, text_stats


def test_places_hold_when_a_scan_is_planned_anew(spark, tmp_path):
    rows = [(i, f"{'same words in every copy of this text' if i % 2 else f'text {i} has words of its own {i * 7}'} and so on") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id").write.parquet(str(tmp_path / "docs"))
    once = near_dedup.one_of_each(spark.read.parquet(str(tmp_path / "docs")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # as when cores come or go
        got = sorted(r.doc_id for r in once.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([1, *range(0, 400, 2)])


def _copies(texts):
    """Ids that a smaller one of their component stands for, by all pairs."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i for i, r in root.items() if i != r}


def _holds(words, item):
    if f" {' '.join(item)} " in f" {' '.join(words)} ":
        return bool(item)
    bag = lambda w: collections.Counter(zip(*(w[k:] for k in range(5))))
    mine, whole = bag(item), bag(words)
    if not mine.keys() & whole.keys():
        return False
    windows = (bag(words[k : k + len(item)]) for k in range(len(words) - len(item) + 1))
    return any((mine & w).total() >= 0.8 * (mine | w).total() for w in windows)


def test_run_equals_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    root = spark.conf.get("spark.checkpoint.dir")
    old = set(glob.glob(f"{root}/pipeline-*"))
    got = corpus_pipeline.run(spark, sf, keep_stages=True).collect()
    (new,) = set(glob.glob(f"{root}/pipeline-*")) - old
    texts_of = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    docs = common.read_table(spark, sf, "documents")
    stages = [texts_of(docs), *(texts_of(spark.read.parquet(f"{new}/{k}")) for k in range(4))]
    model = quality_model.fit_ensemble(docs, common.read_table(spark, sf, "labels"))
    scores = model.scores(text_stats.feature_matrix(text_stats.count_batch(pa.array(list(stages[0].values())))))
    assert stages[1].keys() == {i for i, x in zip(stages[0], scores, strict=True) if x >= quality_model.CUT}
    first = spark.read.parquet(f"{new}/0")
    told = language.predict_language(first, language.fit_language(first)).collect()
    assert stages[2].keys() == {r.doc_id for r in told if r.lang_pred != language.UNKNOWN and r.score >= 0.3}
    assert stages[3].keys() == stages[2].keys() - _copies(stages[2])
    items = [decontaminate.words_of(r.text) for r in common.read_table(spark, sf, "benchmark").collect()]
    assert stages[4].keys() == {i for i, t in stages[3].items() if not any(_holds(decontaminate.words_of(t), w) for w in items)}
    assert {r.doc_id for r in got} == stages[4].keys()
    pieces = piece_sampling.load_pieces()
    assert all(piece_sampling.decode(pieces, r.ids) == stages[4][r.doc_id] for r in got)


def test_only_the_last_stage_is_kept(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    old = set(glob.glob(f"{root}/pipeline-*"))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (new,) = set(glob.glob(f"{root}/pipeline-*")) - old
    assert glob.glob(f"{new}/*") == [f"{new}/{len(corpus_pipeline.STAGES) - 1}"] and got.count() > 0
