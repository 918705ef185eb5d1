"""Versioned migrations of stored tables: each step and its line in the ledger are one commit."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Snapshots, Transaction

LEDGER = "migration_ledger"
LEDGER_COLUMNS = "place int, number int, name string, direction string, checksum string"


class ChangedStep(RuntimeError):
    """A step that was applied reads otherwise now, is missing, or stands after one that wasn't applied."""


@dataclass(frozen=True)
class Create:
    table: str
    columns: str
    keys: tuple[str, ...]

    def apply(self, tx: Transaction) -> None:
        tx.create(self.table, self.columns, self.keys)


@dataclass(frozen=True)
class Drop:
    table: str

    def apply(self, tx: Transaction) -> None:
        tx.drop(self.table)


@dataclass(frozen=True)
class AddColumn:
    """A column at the end; value: a SQL expression over the row. Without one it is null, and no file is written anew."""

    table: str
    column: str
    kind: str
    value: str | None = None

    def apply(self, tx: Transaction) -> None:
        m = tx.manifest(self.table)
        columns = f"{m.columns}, {self.column} {self.kind}"
        # files of a column of this name that was dropped before don't come back: DropColumn writes all rows anew
        if self.value is None:
            tx.widen(self.table, columns)
        else:
            tx.reshape(self.table, columns, tx.read(self.table).withColumn(self.column, F.expr(self.value).cast(self.kind)))


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str

    def apply(self, tx: Transaction) -> None:
        rows = tx.read(self.table).drop(self.column)
        if self.column in tx.manifest(self.table).keys:
            raise ValueError(f"{self.column} is part of the key of {self.table}")
        tx.reshape(self.table, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), rows)


@dataclass(frozen=True)
class Update:
    """New values of columns by SQL expressions over the row; keys stay."""

    table: str
    values: tuple[tuple[str, str], ...]

    def apply(self, tx: Transaction) -> None:
        m, rows = tx.manifest(self.table), tx.read(self.table)
        if set(m.keys) & {c for c, _ in self.values}:
            raise ValueError(f"the key of {self.table} stays")
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        tx.overwrite(self.table, rows.withColumns({c: F.expr(e).cast(kinds[c]) for c, e in self.values}))


@dataclass(frozen=True)
class Step:
    """One migration: what to do, and what undoes it (nothing: it can't be undone)."""

    number: int
    name: str
    up: tuple
    down: tuple = ()

    def checksum(self) -> str:
        return hashlib.sha256(repr((self.number, self.name, self.up, self.down)).encode()).hexdigest()


def ledger(store: Snapshots) -> DataFrame:
    """Steps in the order in which they were applied and undone."""
    return store.begin().read(LEDGER) if _known(store.begin()) else store.spark.createDataFrame([], LEDGER_COLUMNS)


def _known(tx: Transaction) -> bool:
    return tx.exists(LEDGER)


def _lines(tx: Transaction) -> list:
    """The ledger: as many rows as steps were run."""
    return sorted((tuple(r) for r in tx.read(LEDGER).collect())) if _known(tx) else []


def applied(lines: Sequence[tuple]) -> dict[int, str]:
    """Number and checksum of the steps that count now."""
    out: dict[int, str] = {}
    for _, number, _, direction, checksum in lines:
        if direction == "up":
            out[number] = checksum
        else:
            out.pop(number, None)
    return out


def pending(steps: Sequence[Step], done: dict[int, str], to: int | None = None) -> list[tuple[Step, str]]:
    """What has to be run, in order, so that all steps up to ``to`` (none given: all) and no later ones count."""
    known = {s.number: s for s in steps}
    if len(known) != len(steps):
        raise ValueError("two steps have the same number")
    for number, checksum in done.items():
        if number not in known or known[number].checksum() != checksum:
            raise ChangedStep(f"step {number} isn't as it was when it was applied")
    last = max(known, default=0) if to is None else to
    early = [n for n in sorted(known) if n not in done and n < max(done, default=0) and n <= last]
    if early:
        raise ChangedStep(f"step {early[0]} comes before steps that were applied")
    back = [n for n in sorted(done, reverse=True) if n > last]
    lasting = [n for n in back if not known[n].down]
    if lasting:
        raise ValueError(f"step {lasting[0]} can't be undone")
    return [(known[n], "down") for n in back] + [(known[n], "up") for n in sorted(known) if n not in done and n <= last]


def migrate(store: Snapshots, steps: Sequence[Step], to: int | None = None) -> list[tuple[int, str]]:
    """Run what is pending; number and direction of each step that was run.

    A step that fails leaves neither changes nor a line in the ledger, and the next call goes on with it.
    With other writers a step is begun anew; if one of these has applied it meanwhile, it isn't run twice.
    """
    ran: list[tuple[int, str]] = []
    todo = pending(steps, applied(_lines(store.begin())), to)
    for step, direction in todo:
        done = []

        def work(tx: Transaction, step: Step = step, direction: str = direction, done: list = done) -> None:
            done.clear()
            tx.create(LEDGER, LEDGER_COLUMNS, ("place",), 1)
            lines = _lines(tx)
            if (step.number in applied(lines)) == (direction == "up"):
                return
            for change in step.up if direction == "up" else step.down:
                change.apply(tx)
            line = [(max((x[0] for x in lines), default=0) + 1, step.number, step.name, direction, step.checksum())]
            tx.insert_ignore(LEDGER, store.spark.createDataFrame(line, LEDGER_COLUMNS), F.col("place"))
            done.append((step.number, direction))

        store.run(work)
        ran += done
    return ran
