"""Settings from environment variables: a prefix, nested names, types, and secrets that no print shows."""

from __future__ import annotations

import dataclasses
import os
import types
import typing
from collections.abc import Mapping

PREFIX, NESTED = "APP", "__"


class Secret:
    """A text that is shown as [redacted] wherever it is printed; ``expose`` gives it where it is needed."""

    __slots__ = ("_value",)

    def __init__(self, value: str):
        self._value = value

    def expose(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "[redacted]"

    def __format__(self, spec: str) -> str:
        return format("[redacted]", spec)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Secret) and self._value == other._value

    def __hash__(self) -> int:
        return hash((Secret, self._value))

    def __reduce__(self):
        return Secret, (self._value,)


class MissingSettings(ValueError):
    """Variables that aren't set, or aren't of their type; values are never part of the message."""


def _read(kind: type, text: str) -> object:
    if kind is bool:
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError
        return text.lower() in ("true", "1")
    return kind(text)


def from_environment(kind: type, environ: Mapping[str, str] | None = None, prefix: str = PREFIX):
    """A dataclass filled from variables PREFIX_FIELD, and those of dataclasses within it from PREFIX_FIELD__NAME.

    Names are matched without regard to case; variables that no field names don't count, and a field with
    a default may be missing. All that is wrong is told at once.
    """
    given = {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    wrong: list[str] = []
    out = _filled(kind, given, f"{prefix.upper()}_", wrong)
    if wrong:
        raise MissingSettings("; ".join(wrong))
    return out


def _filled(kind: type, given: Mapping[str, str], before: str, wrong: list[str]):
    hints, values = typing.get_type_hints(kind), {}
    for f in dataclasses.fields(kind):
        name, of = before + f.name.upper(), hints[f.name]
        if isinstance(of, types.UnionType):
            of = next(t for t in typing.get_args(of) if t is not type(None))
        if dataclasses.is_dataclass(of):
            optional = f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING
            if not optional or any(k.startswith(name + NESTED) for k in given):
                values[f.name] = _filled(of, given, name + NESTED, wrong)
        elif name in given:
            try:
                values[f.name] = _read(of, given[name])
            except ValueError:
                wrong.append(f"{name} is no {of.__name__}")
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            wrong.append(f"{name} isn't set")
    return None if wrong else kind(**values)


@dataclasses.dataclass(frozen=True)
class Bank:
    url: str
    token: Secret
    retries: int = 6
    wait_seconds: float = 60.0


@dataclasses.dataclass(frozen=True)
class Settings:
    """What an import needs."""

    bank: Bank
    store: str
    institute: str = "Bank"
    delay_seconds: float = 4 * 3600.0


def reader_options(bank: Bank) -> dict[str, str]:
    """Options of the paged sources. Spark hides the value of ``token`` wherever it prints options."""
    return {"url": bank.url, "token": bank.token.expose(), "retries": str(bank.retries), "wait_seconds": str(bank.wait_seconds)}
