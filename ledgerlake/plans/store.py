"""Keyed tables in Parquet folders, changed by optimistic transactions.

A commit is a small file named by its number, made so that it can't replace another one. It names the
manifest of each table, and how far each source has been applied. A manifest lists the folders of the
table's buckets, into which rows go by a hash of their key; a merge rewrites the buckets that its batch
hits (insert-ignore only adds to them), and all other files stay. Nothing that a commit names is ever
overwritten, so readers need no lock and every version can be read until ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources.schemas import PARENTS, TABLES

BUCKETS = 16
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed a table that this transaction has read or changed."""


class Files:
    """Small files and listings below a folder, on whatever file system it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root, spark._jvm
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _found(self, folder: str) -> list:
        place = self.path(folder)
        return list(self._fs.listStatus(place)) if self._fs.exists(place) else []

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._found(folder)]

    def older(self, folder: str, seconds: float) -> list[str]:
        """Names of what wasn't changed for so long."""
        last = (time.time() - seconds) * 1000
        return [s.getPath().getName() for s in self._found(folder) if s.getModificationTime() <= last]

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def publish(self, name: str, text: str) -> bool:
        """A whole file of that name, or False where there is one: a hard link on local disks, elsewhere a rename, which must not replace a file."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        self.write(draft, text)
        try:
            if self._fs.getUri().getScheme() != "file":
                return bool(self._fs.rename(self.path(draft), self.path(name)))
            at = lambda n: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(self.path(n)).toUri())
            self._jvm.java.nio.file.Files.createLink(at(name), at(draft))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.remove(draft)


@dataclass(frozen=True)
class Version:
    """What a commit says: the manifest of each table, and the last batch of each source."""

    number: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    """Columns and key of a table, and the folders of its buckets."""

    columns: str
    keys: tuple[str, ...]
    buckets: int
    folders: dict[str, list[str]] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`").cast("string") for k in self.keys)), F.lit(self.buckets)).cast("int")


class Transaction:
    """Changes to tables as they were at one version; they count together once committed. A read sees the transaction's own changes."""

    def __init__(self, store: Snapshots, base: Version):
        self.store, self.base = store, base
        self.seen: set[str] = set()
        self.changed: dict[str, Manifest | None] = {}

    def manifest(self, name: str) -> Manifest:
        self.seen.add(name)
        found = self.changed[name] if name in self.changed else self.store.manifest(name, self.base)
        if found is None:
            raise KeyError(f"no table {name}")
        return found

    def exists(self, name: str) -> bool:
        self.seen.add(name)
        return (self.changed[name] if name in self.changed else self.store.manifest(name, self.base)) is not None

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.store.rows(name, self.manifest(name), buckets)

    def create(self, name: str, columns: str, keys: Sequence[str], buckets: int | None = None) -> None:
        """An empty table, where there is none."""
        if not self.exists(name):
            self.changed[name] = Manifest(columns, tuple(keys), buckets or self.store.buckets)

    def drop(self, name: str) -> None:
        self.seen.add(name)
        self.changed[name] = None

    def reshape(self, name: str, columns: str, rows: DataFrame) -> None:
        """Other columns, and all rows anew."""
        self.changed[name] = replace(self.manifest(name), columns=columns)
        self.overwrite(name, rows)

    def widen(self, name: str, columns: str) -> None:
        """Further columns at the end, null in all rows there are; no file is touched."""
        self.changed[name] = replace(self.manifest(name), columns=columns)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        m = self.manifest(name)
        self.changed[name] = replace(m, folders={b: [f] for b, f in self._written(name, m, rows).items()})

    def insert_ignore(self, name: str, batch: DataFrame, order: Column) -> None:
        """Stored rows stay; of new keys the earliest row is added, and no stored file is touched."""
        m = self.manifest(name)
        old = self.read(name, self._hit(m, batch))
        fresh = batch.join(old.select(*m.keys), list(m.keys), "left_anti")
        added = self._written(name, m, merge.first_of_each(fresh, m.keys, order).select(*old.columns))
        self.changed[name] = replace(m, folders={**m.folders, **{b: [*m.folders.get(b, []), f] for b, f in added.items()}})

    def insert_unique(self, name: str, batch: DataFrame, order: Column, unique: Sequence[Sequence[str]]) -> DataFrame:
        """As insert_ignore, with further unique keys; the rows left out because of these. Of buckets that the batch doesn't hit only those keys are read."""
        m = self.manifest(name)
        hit = self._hit(m, batch)
        own, whole = self.read(name, hit), self.read(name)
        taken, left = merge.insert_unique([own, *[whole] * len(unique)], batch, [m.keys, *unique], order)
        added = self._written(name, m, taken.select(*own.columns))
        self.changed[name] = replace(m, folders={**m.folders, **{b: [*m.folders.get(b, []), f] for b, f in added.items()}})
        return left.join(self.read(name, hit).select(*m.keys), list(m.keys), "left_anti")

    def upsert(self, name: str, batch: DataFrame, order: Column, keep: Sequence[str] = ()) -> None:
        """The latest row of each key, but for the ``keep`` columns, which stay as first stored."""
        self._rewrite(name, batch, lambda old, keys: merge.upsert(old, batch, keys, order, keep))

    def replace(self, name: str, batch: DataFrame, order: Column) -> None:
        """Whole rows; columns that the batch lacks become null."""
        self._rewrite(name, batch, lambda old, keys: merge.replace(old, batch, keys, order))

    def delete(self, name: str, gone: DataFrame, key: str) -> None:
        """Without the rows whose ``key`` is listed. Only where that is the table's key are other buckets left alone."""
        m = self.manifest(name)
        self._rewrite(name, gone if m.keys == (key,) else None, lambda old, _: merge.delete_cascade(old, gone, key))

    def delete_with_children(self, name: str, gone: DataFrame, key: str, parents: Sequence[tuple[str, str, str, str]] = PARENTS) -> None:
        """Without the rows whose ``key`` is listed, and without the rows of other tables that name them, and those that name these."""
        for parent, own, child, column in parents:
            if parent == name and self.exists(child):
                listed = gone.select(F.col(key).alias(own)) if own == key else self.read(name).join(gone.select(key), key, "left_semi").select(own)
                self.delete_with_children(child, listed.select(F.col(own).alias(column)).distinct(), column, parents)
        self.delete(name, gone, key)

    def compact(self, name: str, most: int = 8) -> None:
        """Buckets of more than ``most`` folders in one each."""
        m = self.manifest(name)
        self._put(name, m, [b for b, f in m.folders.items() if len(f) > most], lambda old, _: old)

    def _rewrite(self, name: str, batch: DataFrame | None, work: Callable[[DataFrame, Sequence[str]], DataFrame]) -> None:
        m = self.manifest(name)
        self._put(name, m, list(m.folders) if batch is None else self._hit(m, batch), work)

    def _put(self, name: str, m: Manifest, hit: Sequence[str], work: Callable[[DataFrame, Sequence[str]], DataFrame]) -> None:
        if hit:
            made = self._written(name, m, work(self.store.rows(name, m, hit), m.keys))
            rest = {b: f for b, f in m.folders.items() if b not in set(hit)}
            self.changed[name] = replace(m, folders={**rest, **{b: [f] for b, f in made.items()}})

    def _hit(self, m: Manifest, batch: DataFrame) -> list[str]:
        """Buckets of the batch's keys: as many as the table has at most."""
        return [str(r["b"]) for r in batch.select(m.bucket().alias("b")).distinct().collect()]

    def _written(self, name: str, m: Manifest, rows: DataFrame) -> dict[str, str]:
        """Folder of each bucket that got rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, m.bucket()).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.store.root}/{name}/{folder}")
        mark = f"{_BUCKET}="
        return {n.removeprefix(mark): f"{folder}/{n}" for n in self.store.files.names(f"{name}/{folder}") if n.startswith(mark)}


class Snapshots:
    """Versions of keyed tables below a folder, each made by one transaction."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.files = Files(spark, root)

    def version(self, number: int | None = None) -> Version:
        """The latest version, or the one of that number; before the first commit there are no tables."""
        if number is None:
            number = max((int(n) for n in self.files.names("commits") if n.isdigit()), default=0)
        return Version(number, **json.loads(self.files.read(f"commits/{number}"))) if number else Version()

    def manifest(self, name: str, at: Version) -> Manifest | None:
        """Of tables that were never written, those of the domain are empty."""
        if name not in at.tables:
            return Manifest(*TABLES[name], self.buckets) if name in TABLES else None
        told = at.tables[name]
        return Manifest(**{k: tuple(v) if k == "keys" else v for k, v in json.loads(self.files.read(f"{name}/manifests/{told}")).items()}) if told else None

    def rows(self, name: str, m: Manifest, buckets: Iterable[int | str] | None = None) -> DataFrame:
        folders = [f for b, fs in m.folders.items() if buckets is None or b in set(map(str, buckets)) for f in fs]
        if not folders:
            return self.spark.createDataFrame([], m.columns)
        return self.spark.read.schema(m.columns).parquet(*(f"{self.root}/{name}/{f}" for f in folders))

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """The table as of the latest version, or of the one of that number."""
        found = self.manifest(name, self.version(number))
        if found is None:
            raise KeyError(f"no table {name}")
        return self.rows(name, found)

    def begin(self, number: int | None = None) -> Transaction:
        return Transaction(self, self.version(number))

    def commit(self, tx: Transaction, source: str | None = None, batch: int = 0) -> bool:
        """All changes, or a Conflict where a table that the transaction has read or changed isn't as it was.

        False, and no change, where this batch of the source, or a later one, has been committed before.
        """
        names = {}
        while True:
            head = self.version()
            if source is not None and head.sources.get(source, -1) >= batch:
                return False
            moved = sorted(t for t in tx.seen if head.tables.get(t) != tx.base.tables.get(t))
            if moved:
                raise Conflict(f"changed since version {tx.base.number}: {', '.join(moved)}")
            if not tx.changed and source is None:
                return True
            for name, m in tx.changed.items():
                if name not in names:
                    names[name] = f"{uuid.uuid4().hex}.json" if m else ""  # a table that was dropped has no manifest
                    if m:
                        self.files.write(f"{name}/manifests/{names[name]}", json.dumps({"columns": m.columns, "keys": m.keys, "buckets": m.buckets, "folders": m.folders}))
            sources = head.sources if source is None else {**head.sources, source: batch}
            if self.files.publish(f"commits/{head.number + 1}", json.dumps({"tables": {**head.tables, **names}, "sources": sources})):
                return True

    def run(self, work: Callable[[Transaction], None], source: str | None = None, batch: int = 0, attempts: int = 5) -> bool:
        """``work`` in a transaction, begun anew after a conflict. False, and ``work`` isn't called, if this batch of the source counts already."""
        for left in reversed(range(attempts)):
            tx = self.begin()
            if source is not None and tx.base.sources.get(source, -1) >= batch:
                return False
            work(tx)
            try:
                return self.commit(tx, source, batch)
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one attempt")

    def write(self, name: str, df: DataFrame, number: int | None = None) -> None:
        """All rows of a table anew. number: the version that ``df`` was made from; the write fails if the table has changed since."""
        tx = self.begin(number)
        tx.overwrite(name, df)
        self.commit(tx)

    def vacuum(self, keep: int = 1, seconds: float = 7 * 86_400) -> int:
        """Remove all versions but the last ``keep``, and the files that none of these names and that are older than so many seconds; how many files and folders went."""
        numbers = sorted(int(n) for n in self.files.names("commits") if n.isdigit())
        kept = [self.version(n) for n in numbers[-keep:]]
        gone = [f"commits/{n}" for n in numbers[:-keep]]
        for name in (n for n in self.files.names("") if n != "commits"):
            manifests = {v.tables.get(name, "") for v in kept} - {""}
            folders = {f.split("/")[1] for told in manifests for fs in json.loads(self.files.read(f"{name}/manifests/{told}"))["folders"].values() for f in fs}
            gone += [f"{name}/manifests/{x}" for x in self.files.older(f"{name}/manifests", seconds) if x not in manifests]
            gone += [f"{name}/data/{x}" for x in self.files.older(f"{name}/data", seconds) if x not in folders]
        for x in gone:
            self.files.remove(x)
        return len(gone)
