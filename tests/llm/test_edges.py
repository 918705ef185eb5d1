"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import json

import pytest

from ledgerlake.llm import chat_format, decontaminate, html_extract, language, near_dedup, piece_sampling, quality_model, quality_rules, sharding, toxicity

EXTRA = "score double, kept boolean, shard int, slot long, lang_pred string, text_crc32 long, _counts_of_text int, place int, node int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
PAD = (0.5, True, 3, 4, "x", 9, 1, 2, 3)
LONG = " ".join(f"word{i % 997} and" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from all the other animals", "en"), (2, None, "en"), (3, "", "de"), (4, " \t\n\x0b\x0c\r ", "de"), (5, LONG, "en"),
    (6, "ein kurzer Text mit Wörtern und Öl 😀 ▁ \x00 über alles", "de"), (7, "12 34 56", "de"), (8, "Einzelwort", None), (1, "the quick brown fox jumps over the lazy dog and runs away from all the other animals", "en"),
    (None, "a text without any id but with words enough to be read by everyone", "en"), (None, None, None), (9, LONG, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "src", None, *PAD) for i, t, g in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


SCORED = {
    "toxicity": lambda d, y: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, y)),
    "quality": lambda d, y: quality_model.score_quality(d, quality_model.fit_ensemble(d, y)),
    "rules": lambda d, y: quality_rules.apply_quality_rules(d, quality_rules.fit_rules(d, y)),
    "language": lambda d, y: language.predict_language(d, language.fit_language(d)),
    "shards": lambda d, y: sharding.shard_layout(d),
    "copies": lambda d, y: near_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", SCORED)
def test_a_row_for_each_document(name, docs, none, labels, no_labels):
    got = SCORED[name](docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in ROWS)
    for r in got:
        if name in ("toxicity", "quality", "language"):
            assert 0 <= r.score <= 1 and r.held_out in (True, False)
    assert SCORED[name](none, labels).collect() == []
    assert SCORED[name](none, no_labels).collect() == []


def test_scores_without_labels_are_constant(docs, no_labels):
    assert {r.score for r in SCORED["quality"](docs, no_labels).collect()} == {0.5}
    assert {r.score for r in SCORED["toxicity"](docs, no_labels).collect()} == {0.5}


def test_language_of_texts_without_letters(docs, labels):
    got = {r.doc_id: (r.lang_pred, r.score) for r in SCORED["language"](docs, labels).collect() if r.doc_id}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 7))


def test_copies_and_empty_texts(docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    assert {(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (7, 1, 7, True), (8, 1, 8, True)} <= set(got)
    assert [(c, k) for i, _, c, k in got if i == 9] == [(5, False)]
    assert [(c, k) for i, n, c, k in got if i is None and n == 0] == [(None, False)]


def test_filters_keep_columns(docs, none, labels, spark):
    items = spark.createDataFrame([(1, "jumps over the lazy dog and runs"), (2, None), (3, "")], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    once = near_dedup.one_of_each(docs)
    assert once.columns == docs.columns
    ids = [r.doc_id for r in once.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 6, 7, 8] and ids.count(None) == 2
    for f in (lambda d: near_dedup.one_of_each(d), lambda d: decontaminate.keep_clean(d, items), lambda d: language.keep_language(d, language.fit_language(d)), lambda d: quality_model.keep_quality(d, quality_model.fit_ensemble(d, labels))):
        assert f(none).collect() == [] and f(none).columns == none.columns


def test_decontamination_edges(docs, none, spark):
    items = spark.createDataFrame([(1, "jumps over the lazy dog and runs"), (2, None), (3, ""), (4, "Einzelwort"), (5, "Einzelwort")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_words) for r in decontaminate.contaminations(docs, items).collect())
    assert got == [(1, 1, 7), (1, 1, 7), (8, 4, 1), (8, 5, 1)]
    assert decontaminate.contaminations(none, items).collect() == []
    assert decontaminate.contaminations(docs, items.limit(0)).collect() == []


def test_slots_have_no_gap(docs):
    by = {}
    for r in sharding.shard_layout(docs).collect():
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_pieces_round_trip(docs, none):
    pieces = piece_sampling.load_pieces()
    got = piece_sampling.sample_segmentations(docs, pieces).collect()
    assert all(r.decoded and 0 <= r.inclusion <= 1 for r in got)
    texts = {i: t or "" for i, t, _ in ROWS if i}
    ways = {}
    for r in got:
        if r.doc_id:
            assert piece_sampling.decode(pieces, r.ids) == texts[r.doc_id]
            ways.setdefault(r.doc_id, set()).add((r.rank, tuple(r.ids)))
    assert all(len({w for _, w in v}) == len(v) for i, v in ways.items())
    assert [len(ways[i]) for i in (2, 3, 5, 6)] == [1, 1, 2, 2]
    assert piece_sampling.sample_segmentations(none, pieces).collect() == []


def test_pages(spark):
    page = "<body><nav>menu</nav><div class='cookie-notice'>we use</div><article><h1>T &amp; x</h1><p>one  two\n three<p>four<script>no</script></article><div id=comments>first!</div><footer>f</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "plain <b>text"), (1, "u", page), (5, "u", "<p>" + "long words here " * 50_000)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert [(r.page_id, r.text) for r in got[:5]] == [(1, "T & x\none two three\nfour"), (2, ""), (3, ""), (None, "plain text"), (1, "T & x\none two three\nfour")]
    assert all(r.n_chars == len(r.text) for r in got) and got[5].n_chars == 799_999


def test_chats(spark):
    call = lambda i, n, x, *after: {"id": i, "name": n, "arguments": x, "depends_on": list(after)}
    tools = {"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"], "additionalProperties": False}}]}
    rows = [
        (1, 0, "system", json.dumps(tools)), (1, 1, "assistant", json.dumps({"tool_calls": [call("b", "f", {"x": 1}, "a"), call("a", "f", '{"x": 2}'), call("c", "f", {"y": 1}, "d"), call("d", "g", {}, "c")]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "é"})), (1, 3, "assistant", json.dumps({"tool_calls": [call("a", "f", {"x": 3})]})), (1, 4, "tool", "{not json"),
        (2, 0, "user", None), (2, 0, "user", ""), (None, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1})), (2, None, None, "x"), (2, None, None, "x"), (2, 5, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS message", "1 AS level")
    got = chat_format.format_chats(df).collect()
    assert len(got) == len(rows)
    main = next(r for r in got if r.turn == 1 and r.conv_id == 1)
    assert (main.n_calls, main.n_linked, main.n_invalid) == (4, 1, 2)
    calls = {c["id"]: c for c in json.loads(main.message)["tool_calls"]}
    assert [c["id"] for c in json.loads(main.message)["tool_calls"]] == ["a", "b", "c", "d"]
    assert {k: c["level"] for k, c in calls.items()} == {"a": 0, "b": 1, "c": None, "d": None}
    assert calls["a"]["result"] == "é" and calls["d"]["errors"] == ["tool: unknown"] and "$.x: required" in calls["c"]["errors"]
    again = next(r for r in got if r.turn == 3)
    assert (again.n_linked, json.loads(again.message)["tool_calls"][0]["errors"]) == (0, ["id: repeated"])
    assert chat_format.format_chats(df.limit(0)).collect() == []
