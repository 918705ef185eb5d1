"""Generated tool conversations against a plain version; texts that a looser reading would break on."""

import collections
import json
import random

import pytest

from ledgerlake.llm import chat_format

SCHEMA = {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}
TOOLS = json.dumps({"tools": [{"name": "f", "parameters": SCHEMA}]})


def _conversation(rng):
    rows = [(0, "system", TOOLS)]
    for turn in range(1, rng.randrange(3, 14)):
        kind = rng.random()
        if kind < 0.5:
            calls = [{"id": rng.choice("abc"), "name": rng.choice("fg"), "arguments": {rng.choice("xy"): rng.randrange(2)}, "depends_on": rng.sample("abcd", rng.randrange(3))} for _ in range(rng.randrange(1, 4))]
            rows.append((turn, "assistant", json.dumps({"tool_calls": calls})))
        elif kind < 0.9:
            rows.append((turn, "tool", json.dumps({"tool_call_id": rng.choice("abcd"), "content": rng.randrange(9)})))
        else:
            rows.append((turn, "user", "hello"))
    return rows


def _plain(rows):
    """turn -> calls as a set of (id, name, arguments, level, errors, result), or whether a result is linked."""
    calls = []  # (turn, id, name, arguments, after)
    for turn, role, text in rows:
        for c in json.loads(text).get("tool_calls", []) if role == "assistant" else []:
            calls.append((turn, c["id"], c["name"], chat_format.canonical(c["arguments"]), tuple(sorted(set(c["depends_on"])))))
    first = {}
    for turn, i, *rest in calls:
        first[i, turn] = min(first.get((i, turn), rest), rest)
    nth = collections.defaultdict(list)  # id -> its turns
    for i, turn in sorted(first, key=lambda k: k[1]):
        nth[i].append(turn)
    result, linked = {}, set()
    for turn, role, text in rows:
        if role == "tool":
            data = json.loads(text)
            before = [t for t in nth[data["tool_call_id"]] if t < turn]
            if before and (data["tool_call_id"], before[-1]) not in result:
                result[data["tool_call_id"], before[-1]] = chat_format.canonical(data["content"])
                linked.add(turn)
    on = {}
    for (i, turn), (_, _, after) in first.items():
        on[i, turn] = set()
        for a in after:
            before = [t for t in nth[a] if t < turn or (t == turn and a != i)]
            if nth[a]:
                on[i, turn].add((a, before[-1] if before else nth[a][0]))
    level = dict.fromkeys(on)
    for _ in on:
        for k, needs in on.items():
            if level[k] is None and all(level[n] is not None for n in needs):
                level[k] = max((level[n] + 1 for n in needs), default=0)
    out = collections.defaultdict(list)
    for turn, i, name, arguments, after in calls:
        mine = first[i, turn][:2] == [name, arguments]
        good = mine and (nth[i][0] == turn or (i, turn) in result)
        errors = [] if good else ["id: repeated"]
        if name == "g":
            errors.append("tool: unknown")
        else:
            value = json.loads(arguments)
            errors += ["$.x: required"] * ("x" not in value)
        out[turn].append((i, name, arguments, level[i, turn] if mine else None, tuple(errors), result.get((i, turn)) if mine else None))
    return {t: sorted(v, key=repr) for t, v in out.items()}, linked


@pytest.mark.parametrize("bound", [None, 0])
def test_generated_conversations(spark, monkeypatch, bound):
    if bound is not None:  # as if every conversation were too large for one task
        monkeypatch.setattr(chat_format, "IN_ONE_TASK", bound)
    rng = random.Random(5)
    told = [_conversation(rng) for _ in range(60 if bound is None else 12)]
    df = spark.createDataFrame([(c, *row) for c, rows in enumerate(told) for row in rows], "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(dict)
    for r in chat_format.format_chats(df).collect():
        got[r.conv_id][r.turn] = (r, json.loads(r.message))
    for c, rows in enumerate(told):
        calls, linked = _plain(rows)
        assert len(got[c]) == len(rows)
        for turn, (r, message) in got[c].items():
            mine = [(x["id"], x["name"], chat_format.canonical(x["arguments"]), x["level"], tuple(x["errors"]), None if x["result"] is None else chat_format.canonical(x["result"])) for x in message.get("tool_calls", [])]
            assert sorted(mine, key=repr) == calls.get(turn, [])
            levels = [x[3] for x in mine]
            assert levels == sorted(levels, key=lambda v: (v is None, v or 0))
            assert (r.n_calls, r.n_linked, r.n_invalid) == (len(mine), sum(x[5] is not None for x in mine), sum(bool(x[4]) for x in mine))
            assert message.get("linked", False) == (turn in linked)
            assert r.message == chat_format.canonical(message)


def test_halves_of_pairs_infinities_and_depth(spark):
    deep = "[" * 5000 + "]" * 5000
    call = lambda i, x: '{"tool_calls":[{"id":"' + i + '","name":"f","arguments":' + x + "}]}"
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "assistant", '{"tool_calls":[],"content":"a\\ud800"}'), (1, 2, "assistant", call("b", '{"x":1,"\\udc00":"\\ud800z"}')),
        (1, 3, "assistant", call("c\\ud800", '{"x":1}')), (1, 4, "assistant", call("d", '{"x":1e999}')), (1, 5, "assistant", call("e", '{"x":NaN}')),
        (1, 6, "assistant", call("f", deep)), (1, 7, "tool", '{"tool_call_id":"b","content":"\\ud83d"}'), (1, 8, "assistant", '{"x":' + "9" * 5000 + "}"),
        (None, 2, "assistant", call("b", '{"x":1}')),
    ]
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert json.loads(got[1, 1].message)["content"] == "a\ud800" and "\\ud800" in got[1, 1].message
    one = json.loads(got[1, 2].message)["tool_calls"][0]
    assert one["arguments"] == {"x": 1, "\udc00": "\ud800z"} and one["result"] == "\ud83d" and one["errors"] == []
    assert json.loads(got[1, 3].message)["tool_calls"][0]["errors"] == ["id: type"]
    for turn in (4, 5, 6, 8):  # no JSON of ours: plain content
        assert got[1, turn].n_calls == 0 and json.loads(got[1, turn].message)["content"] == rows[turn][3]
    assert (got[None, 2].n_calls, got[None, 2].n_linked) == (1, 0)
