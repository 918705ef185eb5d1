"""Chat formatting with tool-call linking (operator 9).

Messages may hold tool definitions (system), calls (assistant) or a result (tool) as JSON text.
Calls and results meet in a hash join on conversation and identifier; calls are put in
topological order of what they build on, their arguments validated against the tool's schema, and
each message becomes one line of canonical JSON (sorted keys, no spaces). Rows are messages, so a
conversation of any length is never gathered in one place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, stored
from .linear_match import Unsupported, pattern_of

_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("after", pa.list_(pa.string())), ("odd", pa.string())])
_TOOL = pa.struct([("name", pa.string()), ("schema", pa.string())])
_PARSED = pa.struct([("content", pa.string()), ("shown", pa.string()), ("calls", pa.list_(_CALL)), ("result_id", pa.string()), ("result", pa.string()), ("tools", pa.list_(_TOOL))])
#: Calls of a message as they are written: in topological order, with errors and result.
CALLS = "array<struct<id: string, name: string, arguments: string, level: int, errors: array<string>, result: string, odd: string>>"
#: Deepest nesting of a message; conversations with up to so many calls and links are ordered in one task each.
DEPTH, IN_ONE_TASK = 200, 100_000
_PARSED_SQL = "struct<content: string, shown: string, calls: array<struct<id: string, name: string, arguments: string, after: array<string>, odd: string>>, result_id: string, result: string, tools: array<struct<name: string, schema: string>>>"


_LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """Half a surrogate pair, which no UTF-8 has, as its JSON escape."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _whole(value: object) -> object:
    """The value with numbers that are whole written as such: 1.0 and 1e0 are 1."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    return escaped(json.dumps(_whole(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False))


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(text)
    return value


def _strict(text: str) -> object:
    """A JSON value; numbers beyond a double, NaN and nesting over DEPTH are errors."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    value = json.loads(text, parse_constant=refuse, parse_float=_finite)
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("nesting")


def _is_text(value: object) -> bool:
    return isinstance(value, str) and _LONE.search(value) is None


def parse_message(role: str | None, text: str | None) -> dict:
    """Parts of a message. What isn't a JSON object with the keys of its role is plain content; shown: content from JSON, as JSON."""
    plain = {"content": text, "shown": None, "calls": [], "result_id": None, "result": None, "tools": []}
    if text is None or role not in ("system", "assistant", "tool") or not text.lstrip().startswith("{"):
        return plain
    try:
        data = _strict(text)
    except (ValueError, RecursionError):
        return plain
    content = data.get("content")
    shown = canonical(content if content is None or isinstance(content, str) else canonical(content))
    if role == "tool" and _is_text(data.get("tool_call_id")):
        return plain | {"content": None, "result_id": data["tool_call_id"], "result": canonical(content)}
    if role == "system" and isinstance(data.get("tools"), list):
        tools = [t.get("function", t) for t in data["tools"] if isinstance(t, dict) and isinstance(t.get("function", t), dict)]
        return plain | {"content": None, "shown": shown, "tools": [{"name": t["name"], "schema": canonical(t.get("parameters", {}))} for t in tools if _is_text(t.get("name"))]}
    if role == "assistant" and isinstance(data.get("tool_calls"), list):
        calls = []
        for c in data["tool_calls"]:
            f = c.get("function", c) if isinstance(c, dict) else None
            if not isinstance(f, dict):
                calls.append({"id": None, "name": None, "arguments": canonical(c), "after": [], "odd": "null"})
                continue
            arguments = f.get("arguments", {})
            if isinstance(arguments, str):
                try:
                    arguments = _strict(arguments)
                except (ValueError, RecursionError):
                    pass  # stays a string, which no object schema takes
            after = [a for a in c.get("depends_on", []) if _is_text(a)] if isinstance(c.get("depends_on", []), list) else []
            own = _is_text(c.get("id"))
            calls.append({"id": c["id"] if own else None, "odd": None if own else canonical(c.get("id")), "name": f.get("name") if _is_text(f.get("name")) else None, "arguments": canonical(arguments), "after": sorted(set(after))})
        return plain | {"content": None, "shown": shown, "calls": calls}
    return plain


#: Keywords that constrain a value and that aren't evaluated; a schema with one is reported.
UNSUPPORTED = tuple("$ref $dynamicRef $recursiveRef additionalItems allOf anyOf contains dependencies dependentRequired dependentSchemas disallow divisibleBy extends if maxContains maxProperties minContains minProperties multipleOf not oneOf patternProperties prefixItems propertyNames unevaluatedItems unevaluatedProperties uniqueItems".split())
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def equal(a: object, b: object) -> bool:
    """JSON equality: numbers by value, and true and false are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def violations(value: object, schema: object, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, const, bounds, lengths, pattern, properties, required, items.

    Other keywords that constrain the value (UNSUPPORTED, a list of items, a boolean bound) are told as unsupported, and so
    are patterns that ``linear_match`` can't follow in time that grows with pattern times text.
    """
    if schema is True or schema is None:
        return []
    if not isinstance(schema, dict):
        return [f"{at}: not allowed" if schema is False else f"{at}: schema unsupported"]
    out = [f"{at}: {k} unsupported" for k in UNSUPPORTED if k in schema]
    out += [f"{at}: {k} unsupported" for k in ("exclusiveMinimum", "exclusiveMaximum") if isinstance(schema.get(k), bool)]
    if isinstance(schema.get("items"), list):
        out.append(f"{at}: items unsupported")
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if isinstance(kinds, list) and not any(_is(value, k) for k in kinds):
        return [*out, f"{at}: type"]
    if "enum" in schema and not any(equal(value, v) for v in schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and not equal(value, schema["const"]):
        out.append(f"{at}: const")
    if _is(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b), ("exclusiveMinimum", lambda b: value <= b), ("exclusiveMaximum", lambda b: value >= b)) if k in schema and not isinstance(schema[k], bool) and bad(schema[k])]
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: {k}" for k, bad in ((low, lambda b: len(value) < b), (high, lambda b: len(value) > b)) if k in schema and bad(schema[k])]
    if isinstance(value, str) and "pattern" in schema:
        try:
            if not pattern_of(schema["pattern"]).found_in(value):
                out.append(f"{at}: pattern")
        except Unsupported as e:
            out.append(f"{at}: pattern unsupported ({e})")
    if isinstance(value, list) and "items" in schema and not isinstance(schema["items"], list):
        for k, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif "additionalProperties" in schema:
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


def _parse_column(role, text):
    @F.arrow_udf(_PARSED_SQL)
    def parse(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            yield pa.array([parse_message(r, t) for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)], _PARSED)

    return parse(role, text)


def _violations(arguments: pa.Array, schemas: pa.Array) -> pa.Array:
    rows = []
    for a, s in zip(arguments.to_pylist(), schemas.to_pylist(), strict=True):
        try:
            rows.append(["tool: unknown"] if s is None else [escaped(v) for v in violations(json.loads(a), json.loads(s))])
        except (AttributeError, TypeError, ValueError, RecursionError, re.error) as e:
            rows.append([f"schema: {type(e).__name__}"])
    return pa.array(rows, pa.list_(pa.string()))


def _message(role: pa.Array, turn: pa.Array, content: pa.Array, shown: pa.Array, calls: pa.Array, result_id: pa.Array, linked: pa.Array) -> pa.Array:
    rows = []
    for r, t, c, j, cs, i, ok in zip(*(x.to_pylist() for x in (role, turn, content, shown, calls, result_id, linked)), strict=True):
        out = {"role": r, "turn": t, "content": c if j is None else json.loads(j)}
        if cs:
            order = sorted(cs, key=lambda x: (x["level"] is None, x["level"] or 0, x["id"] is None, x["id"] or "", x["odd"] or "", x["name"] or "", x["arguments"]))
            out["tool_calls"] = [
                {"id": x["id"] if x["odd"] is None else json.loads(x["odd"]), "name": x["name"], "arguments": json.loads(x["arguments"]), "level": x["level"], "errors": x["errors"], "result": None if x["result"] is None else json.loads(x["result"])} for x in order
            ]
        if i is not None:
            out |= {"tool_call_id": i, "linked": ok}
        rows.append(canonical(out))
    return pa.array(rows, pa.string())


def levels_of(after: dict[str, list[str]]) -> dict[str, int | None]:
    """Level of each call by what it builds on: 0 without a known call to build on, else one above the highest. In or behind a cycle: None."""
    out: dict[str, int | None] = dict.fromkeys(after)
    behind, open_ = {i: [] for i in after}, {}
    for i, on in after.items():
        known = {x for x in on if x in after}
        open_[i] = len(known)
        for x in known:
            behind[x].append(i)
    ready = [i for i, n in open_.items() if not n]
    for i in ready:
        out[i] = 0
    while ready:
        fresh = []
        for x in ready:
            for i in behind[x]:
                out[i] = max(out[i] or 0, out[x] + 1)
                open_[i] -= 1
                if not open_[i]:
                    fresh.append(i)
        ready = fresh
    return {i: None if open_[i] else level for i, level in out.items()}


def call_levels(calls: DataFrame) -> DataFrame:
    """conv, id and level (levels_of) of calls (conv, id, after).

    A conversation of up to IN_ONE_TASK calls and links is ordered by one task; larger ones by a
    round of joins for each level, so that none is gathered in one place.
    """
    size = calls.groupBy("conv").agg(F.sum(1 + F.size("after")).alias("size"))
    marked, told = stored(calls.join(size, "conv").withColumn("large", F.col("size") > IN_ONE_TASK), large=F.col("size") > IN_ONE_TASK)

    def order(rows: pa.Table) -> pa.Table:
        found = levels_of(dict(zip(rows["id"].to_pylist(), rows["after"].to_pylist(), strict=True)))
        return pa.table({"conv": rows["conv"], "id": rows["id"], "level": pa.array([found[i] for i in rows["id"].to_pylist()], pa.int32())})

    kind = calls.schema["conv"].dataType.simpleString()
    small = marked.where("not large").select("conv", "id", "after").groupBy("conv").applyInArrow(order, f"conv {kind}, id string, level int")
    return small if not told["large"] else small.union(_levels_by_rounds(marked.where("large")))


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    ids = calls.select("conv", "id")
    edges = calls.select("conv", "id", F.explode("after").alias("on")).join(ids.select("conv", F.col("id").alias("on")), ["conv", "on"])
    edges = materialised(edges)
    levels = materialised(ids.join(edges.select("conv", "id"), ["conv", "id"], "left_anti").withColumn("level", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        known = edges.join(levels.select("conv", F.col("id").alias("on"), "level"), ["conv", "on"], "left")
        ready = known.groupBy("conv", "id").agg(F.max("level").alias("top"), F.sum(F.col("level").isNull().cast("int")).alias("open")).where("open = 0")
        fresh = ready.join(levels.select("conv", "id"), ["conv", "id"], "left_anti").select("conv", "id", (F.col("top") + 1).alias("level"))
        levels, told = stored(levels.union(fresh), new=F.col("level") == depth)
        if not told["new"]:
            return ids.join(levels, ["conv", "id"], "left")


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid and message (canonical JSON) of every message.

    A result belongs to the last call of its conversation with its identifier from an earlier turn, and
    each call has the first of its results. Of equal identifiers in a turn the first call by name and
    arguments counts. A later call of an identifier, without a result of its own, has the error
    'id: repeated', as have the others of a turn; a call without a text as identifier links with nothing
    and has the error 'id: type'. What a call builds on is the last call of that identifier before or in
    its turn, else the first after it. Null and empty texts are content as they are; null
    conversations hold messages that link with nothing. Repeated messages give a row each. Tool
    definitions: the first by turn of a name. Numbers beyond a double and nesting over DEPTH make a text plain
    content; half a surrogate pair is written as its escape, and an identifier or name with one is no text. Other
    columns are left out. No rows in, none out.
    """
    slim = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    # only what looks like a JSON object is parsed, once
    special = F.coalesce(F.col("role").isin("system", "assistant", "tool") & F.col("content").rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    none = F.lit(None).cast("string")
    plain = slim.where(~special).withColumns({"shown": none, "result_id": none})
    rare, told = stored(slim.where(special).withColumn("p", _parse_column(F.col("role"), F.col("content"))).select("conv", "turn", "role", "p.*"))
    no_calls = F.array().cast(CALLS)
    shape = lambda df, calls, linked: df.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.coalesce(F.size(calls), F.lit(0)).alias("n_calls"), F.coalesce(F.size(F.filter(calls, lambda c: c["result"].isNotNull())), F.lit(0)).alias("n_linked"),
        F.coalesce(F.size(F.filter(calls, lambda c: F.size(c["errors"]) > 0)), F.lit(0)).alias("n_invalid"), F.arrow_udf(_message, "string")("role", "turn", "content", "shown", calls, "result_id", linked).alias("message"),
    )
    done = shape(plain, no_calls, F.lit(False))
    if not told["rows"]:
        return done
    made = rare.select("conv", "turn", F.explode("calls").alias("c")).select("conv", "turn", "c.*").where("conv is not null and id is not null")
    first = made.groupBy("conv", "id", "turn").agg(F.min(F.struct("name", "arguments", "after")).alias("f")).select("conv", "id", "turn", "f.*")
    by_turn = Window.partitionBy("conv", "id").orderBy("turn")
    first = materialised(first.withColumn("nth", F.row_number().over(by_turn)).withColumn("node", F.to_json(F.struct("id", "nth"))))
    # each identifier's calls, results and mentions by turn: results, and mentions by the call itself, come before the calls of their turn
    event = lambda df, kind, **extra: df.select("conv", "id", "turn", F.lit(kind).alias("kind"), *[extra.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("nth", "int"), ("result", "string"), ("node", "string"))])
    mentions = first.select("conv", F.explode("after").alias("id"), "turn", "node", F.col("id").alias("own"))
    given = rare.where("result_id is not null and conv is not null and turn is not null").select("conv", F.col("result_id").alias("id"), "turn", "result")
    events = event(given, 0, result=F.col("result")).union(event(mentions.where("id = own"), 0, node=F.col("node"))).union(event(first, 1, nth=F.col("nth"))).union(event(mentions.where("id != own"), 2, node=F.col("node")))
    so_far = Window.partitionBy("conv", "id").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialised(events.withColumn("of", F.last("nth", True).over(so_far)).withColumn("any", F.min("nth").over(Window.partitionBy("conv", "id"))).where("kind != 1"))
    taken = placed.where("result is not null and of is not null").groupBy("conv", "id", F.col("of").alias("nth")).agg(F.min(F.struct("turn", "result")).alias("r"))
    on = F.to_json(F.struct("id", F.coalesce("of", "any").alias("nth")))
    after = placed.where("node is not null and any is not null").select("conv", "node", on.alias("on")).groupBy("conv", "node").agg(F.collect_set("on").alias("after"))  # what one call builds on
    steps = call_levels(first.select("conv", "node").join(after, ["conv", "node"], "left").select("conv", F.col("node").alias("id"), F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    tools = rare.select("conv", "turn", F.explode("tools").alias("t")).where("conv is not null").groupBy("conv", F.col("t.name").alias("name")).agg(F.min(F.struct("turn", "t.schema")).alias("t"))
    answered = first.drop("after").join(taken, ["conv", "id", "nth"], "left").withColumn("r", F.when(F.col("turn").isNotNull(), F.col("r")))
    of = materialised(answered.join(steps.withColumnRenamed("id", "node"), ["conv", "node"]).select("conv", "id", "turn", "nth", F.struct("name", "arguments").alias("is"), "level", "r"))
    marked = materialised(rare.withColumn("row", F.monotonically_increasing_id()))
    each = marked.select("row", "conv", "turn", F.explode("calls").alias("c")).select("row", "conv", "turn", "c.*")
    each = each.join(tools.select("conv", "name", F.col("t.schema").alias("schema")), ["conv", "name"], "left").withColumn("broken", F.arrow_udf(_violations, "array<string>")("arguments", "schema"))
    mine = F.struct("name", "arguments").eqNullSafe(F.col("is"))
    of = of.withColumnRenamed("turn", "t")
    joined = each.alias("e").join(of.alias("o"), (F.col("e.conv") == F.col("o.conv")) & (F.col("e.id") == F.col("o.id")) & F.col("e.turn").eqNullSafe(F.col("o.t")), "left")
    told = F.when(F.col("e.id").isNull(), F.array(F.lit("id: type"))).when(F.col("e.conv").isNull() | (mine & ((F.col("nth") == 1) | F.col("r").isNotNull())), F.array().cast("array<string>")).otherwise(F.array(F.lit("id: repeated")))
    matched = joined.select("row", F.struct("e.id", "e.name", "e.arguments", F.when(mine, F.col("level")).alias("level"), F.concat(told, "broken").alias("errors"), F.when(mine, F.col("r.result")).alias("result"), "e.odd").alias("c"))
    calls_of = matched.groupBy("row").agg(F.collect_list("c").alias("with"))  # the calls of one message
    results = of.where("r is not null").select("conv", F.col("id").alias("result_id"), F.col("r.turn").alias("turn"), F.col("r.result").alias("result"), F.lit(True).alias("ok")).distinct()
    full = marked.join(calls_of, "row", "left").join(results, ["conv", "result_id", "turn", "result"], "left")
    return done.unionByName(shape(full, F.coalesce(F.col("with"), no_calls), F.coalesce("ok", F.lit(False))))

