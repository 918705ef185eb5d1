"""Calls and results that a shorter way would lose."""

import json

from ledgerlake.llm import chat_format


def test_every_call_is_kept_and_linked(spark):
    tools = {"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}}}, {"name": "g", "parameters": {"anyOf": [{"required": ["x"]}]}}]}
    ask = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": x, "depends_on": list(d)} for i, n, x, *d in calls]})
    tell = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    rows = [
        (1, 0, "system", json.dumps(tools)), (1, 1, "tool", tell("call_0", "stray")),
        (1, 2, "assistant", ask(("call_0", "f", {"x": 1}))), (1, 3, "tool", tell("call_0", "one")), (1, 4, "tool", tell("call_0", "one again")),
        (1, 5, "assistant", ask(("call_0", "f", {"x": 2}, "call_0"), ("b", "f", {"x": 3}, "call_0"))), (1, 6, "tool", tell("call_0", "two")),
        (1, 7, "assistant", ask(("call_0", "f", {"x": "no"}))),
        (1, 8, "assistant", ask((7, "f", {"x": 1}), (None, "f", {"x": 1}), ("u", "g", {}))),
        (1, 9, "assistant", json.dumps({"tool_calls": ["not an object"]})),
        (None, 2, "assistant", ask(("call_0", "f", {"x": 1}))),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r, json.loads(r.message)) for r in chat_format.format_chats(df).collect()}
    assert len(got) == len(rows)
    counts = {k: (r.n_calls, r.n_linked, r.n_invalid) for k, (r, _) in got.items() if r.n_calls}
    assert counts == {(1, 2): (1, 1, 0), (1, 5): (2, 1, 0), (1, 7): (1, 0, 1), (1, 8): (3, 0, 3), (1, 9): (1, 0, 1), (None, 2): (1, 0, 1)}
    calls = lambda t: {json.dumps(c["id"]): c for c in got[1, t][1]["tool_calls"]}
    assert calls(2)['"call_0"']["result"] == "one" and calls(5)['"call_0"']["result"] == "two"
    assert {k: c["level"] for k, c in calls(5).items()} == {'"call_0"': 1, '"b"': 2}
    assert calls(7)['"call_0"']["errors"] == ["id: repeated", "$.x: type"]
    assert {k: c["errors"] for k, c in calls(8).items()} == {"7": ["id: type"], "null": ["id: type"], '"u"': ["$: anyOf unsupported"]}
    assert [got[1, t][1]["linked"] for t in (1, 3, 4, 6)] == [False, True, False, True]


def test_unsupported_keywords_are_told():
    assert chat_format.violations(5, {"multipleOf": 2}) == ["$: multipleOf unsupported"]
    assert chat_format.violations({"a": [1]}, {"properties": {"a": {"items": [{"type": "string"}]}}}) == ["$.a: items unsupported"]
    assert chat_format.violations(5, {"title": "t", "description": "d", "default": 1}) == []
