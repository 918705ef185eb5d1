"""A paged service whose answers are rows of Parquet files, to run an import over the rows of a table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paged import BALANCES

_STRETCH = 1_000  # balances of a file


def store_answers(balances: DataFrame, documents: DataFrame, folder: str, files: int, order: Column) -> dict:
    """Options of a service that answers with ``balances`` (place from 0, value) and ``documents`` (account_id, state, value) in this order."""
    of_account = F.pmod(F.crc32(F.col("account_id").cast("binary")), F.lit(files))
    kept = documents.select("account_id", "state", "value", order.alias("_at"), of_account.alias("b"))
    kept.repartition("b").sortWithinPartitions("b", "account_id", "_at").select("account_id", "state", "value", "b").write.partitionBy("b").parquet(f"{folder}/documents")
    stretches = balances.select("place", "value", F.floor(F.col("place") / _STRETCH).alias("b"))
    stretches.repartition("b").sortWithinPartitions("b", "place").write.partitionBy("b").parquet(f"{folder}/balances")
    return {"client": f"{__name__}:StoredService", "folder": folder, "files": str(files), "near": str(files), "matches": str(balances.count())}


class StoredService:
    """Options: folder, files and matches as ``store_answers`` gives them, step: rows of a page, busy: every so manyth page is refused once to each client."""

    def __init__(self, options: dict):
        where = options["folder"]
        self.files, self.root = fs.FileSystem.from_uri(where if "://" in where or not where.startswith("file:") else "file://" + where[5:])
        self.buckets, self.matches, self.step = int(options["files"]), int(options["matches"]), int(options.get("step", 50))
        self.busy, self.refused = int(options.get("busy", 0)), set()
        self._last: tuple[str, object] = ("", None)

    def _kept(self, name: str, made: Callable[[pa.Table | None], object]) -> object:
        """What is made of a file's rows; of the last file it is kept."""
        if self._last[0] != name:
            place = f"{self.root}/{name}"
            found = self.files.get_file_info(place).type == fs.FileType.Directory
            self._last = name, made(ds.dataset(place, filesystem=self.files, format="parquet", partitioning=None).to_table() if found else None)
        return self._last[1]

    @staticmethod
    def _by_account(rows: pa.Table | None) -> dict[tuple[str, str], list[str]]:
        out: dict[tuple[str, str], list[str]] = {}
        if rows is not None:
            for account, state, value in zip(*(rows.column(c).to_pylist() for c in ("account_id", "state", "value")), strict=True):
                out.setdefault((account, state), []).append(value)
        return out

    def get(self, path: str, query: dict[str, str]) -> tuple[int, str]:
        start = int(query["paging-first"])
        asked = f"{path} {start}"
        if self.busy and zlib.crc32(asked.encode()) % self.busy == 0 and asked not in self.refused:
            self.refused.add(asked)
            return 503, "busy"
        if path == BALANCES:
            values, matches = [], self.matches
            for b in range(start // _STRETCH, (start + self.step - 1) // _STRETCH + 1):
                rows = self._kept(f"balances/b={b}", lambda table: table)
                if rows is not None:
                    values += rows.filter((pc.field("place") >= start) & (pc.field("place") < start + self.step)).column("value").to_pylist()
        else:
            account = path.split("/")[-2]
            found = self._kept(f"documents/b={zlib.crc32(account.encode()) % self.buckets}", self._by_account)
            all_values = found.get((account, query["transactionState"]), [])
            values, matches = all_values[start : start + self.step], len(all_values)
        return 200, f'{{"paging": {{"index": {start}, "matches": {matches}}}, "values": [{", ".join(values)}]}}'  # the values are JSON
