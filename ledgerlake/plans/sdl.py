"""Schemas as type definitions in text, and back: what a client of the reports is told."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Names of scalar types in text; those the language has no word for are declared as scalars.
SCALARS = {"string": "String", "int": "Int", "double": "Float", "boolean": "Boolean", "bigint": "Long", "float": "Single", "smallint": "Short", "tinyint": "Byte", "date": "Date", "timestamp": "Timestamp", "timestamp_ntz": "LocalTimestamp", "binary": "Binary"}
BUILT_IN = {"String", "Int", "Float", "Boolean"}
_KINDS = {v: k for k, v in SCALARS.items()}


@dataclass(frozen=True)
class Query:
    """A query by name: arguments and their types, and the type of its result; many: a list of these."""

    name: str
    result: str
    arguments: tuple[tuple[str, T.DataType], ...] = ()
    many: bool = True


@dataclass
class Schema:
    types: dict[str, T.StructType] = field(default_factory=dict)
    queries: list[Query] = field(default_factory=list)


def _named(kind: T.DataType, nullable: bool, name: str, nested: dict[str, T.StructType]) -> str:
    end = "" if nullable else "!"
    if isinstance(kind, T.StructType):
        nested[name] = kind
        return name + end
    if isinstance(kind, T.ArrayType):
        return f"[{_named(kind.elementType, kind.containsNull, name, nested)}]{end}"
    told = kind.simpleString()
    if isinstance(kind, T.DecimalType):
        return f"Decimal_{kind.precision}_{kind.scale}{end}"
    if told not in SCALARS:
        raise ValueError(f"no name for {told}")
    return SCALARS[told] + end


def printed(schema: Schema) -> str:
    """Types in the order given, structs within them as types of their own, then the queries; scalars beyond the built-in ones first."""
    blocks, todo = [], list(schema.types.items())
    seen = {n for n, _ in todo}
    while todo:
        name, kind = todo.pop(0)
        nested: dict[str, T.StructType] = {}
        lines = [f"  {f.name}: {_named(f.dataType, f.nullable, f'{name}_{f.name}', nested)}" for f in kind.fields]
        blocks.append(f"type {name} {{\n" + "\n".join(lines) + "\n}")
        if clash := seen & set(nested):
            raise ValueError(f"two types are called {sorted(clash)[0]}")
        seen |= set(nested)
        todo[:0] = nested.items()
    asked = []
    for q in schema.queries:
        arguments = ", ".join(f"{n}: {_named(t, False, n, {})}" for n, t in q.arguments)
        asked.append(f"  {q.name}{f'({arguments})' if arguments else ''}: {f'[{q.result}!]!' if q.many else f'{q.result}!'}")
    if asked:
        blocks.append("type Query {\n" + "\n".join(asked) + "\n}")
    text = "\n\n".join(blocks) + "\n"
    declared = sorted(x for x in set(re.findall(r"[:\[] ?\[*([A-Z]\w*)", text)) if x not in BUILT_IN and x not in seen)
    return "".join(f"scalar {x}\n" for x in declared) + ("\n" if declared else "") + text


def _kind(told: str, lines: dict[str, list[tuple[str, str]]]) -> tuple[T.DataType, bool]:
    nullable = not told.endswith("!")
    told = told.rstrip("!")
    if told.startswith("["):
        inner, holes = _kind(told[1:-1], lines)
        return T.ArrayType(inner, holes), nullable
    if told in lines:
        return _struct(told, lines), nullable
    if m := re.fullmatch(r"Decimal_(\d+)_(\d+)", told):
        return T.DecimalType(int(m[1]), int(m[2])), nullable
    if told not in _KINDS:
        raise ValueError(f"unknown type {told}")
    return T.StructType.fromDDL(f"x {_KINDS[told]}").fields[0].dataType, nullable


def _struct(name: str, lines: dict[str, list[tuple[str, str]]]) -> T.StructType:
    return T.StructType([T.StructField(n, *_kind(t, lines)) for n, t in lines[name]])


def parsed(text: str) -> Schema:
    """What ``printed`` has printed. Types that others hold as fields are read into those."""
    lines = {m[1]: re.findall(r"^  (\w+(?:\([^)]*\))?): (\S+)$", m[2], re.M) for m in re.finditer(r"^type (\w+) \{\n(.*?)\n\}", text, re.M | re.S)}
    asked = lines.pop("Query", [])
    held = {t.strip("[]!") for fields in lines.values() for _, t in fields}
    out = Schema({n: _struct(n, lines) for n in lines if n not in held})
    for head, result in asked:
        name, _, arguments = head.partition("(")
        pairs = [a.split(": ") for a in arguments.rstrip(")").split(", ") if a]
        out.queries.append(Query(name, result.strip("[]!"), tuple((n, _kind(t, lines)[0]) for n, t in pairs), result.startswith("[")))
    return out
