"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, whatever Arrow's batch size is.
SLICE_BYTES = 2_000_000
#: Characters of all texts of a fitting sample together.
MAX_TOTAL = 60_000_000


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Rows of an Arrow batch: texts are long, and JVM and Python each hold a batch of every running task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """True where the key falls in the held-out fold; false for a null key."""
    return F.coalesce(crc32_mod(key, modulus) == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode, where none is named, a new one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more goes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the shared checkpoint folder, its lineage cut."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialised(df), and ``rows``, its number of rows, with the number of rows where each of ``counts`` is true, in the same job."""
    seen = Observation()
    told = [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()]]
    out = materialised(df.observe(seen, *told))
    found = seen.get  # nothing where Spark knows that there are no rows
    return out, {n: int(found.get(n) or 0) for n in ("rows", *counts)}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], max_rows: int, max_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A bounded sample of labelled texts for fitting: id, y, text.

    At most ``max_rows`` labelled ids outside the fold, in the order of a hash of the id, and of
    these the texts of at most ``max_chars`` characters. An id with several labels counts with its
    smallest; an id with several texts with the smallest text. Null ids, labels and texts don't count.
    """
    modulus, remainder = fold
    ids = (
        labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc32_mod(F.col("id"), modulus) != remainder))
        .groupBy("id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    return texts_of(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), ids, max_chars)


def texts_of(docs: DataFrame, ids: DataFrame, max_chars: int) -> DataFrame:
    """id, y and text of a bounded list of ids (a limit stands above; so the broadcast is bounded too).

    Texts over ``max_chars`` don't count. If the others have more than MAX_TOTAL characters together, the
    classes give a text each in turn, in the order of a hash of the id, as long as there is room.
    """
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = materialised(texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    sizes = found.select(F.col("id").cast("string").alias("id"), F.col("y").cast("string").alias("y"), F.xxhash64("id").alias("at"), F.length("text").alias("n")).collect()
    if sum(r["n"] for r in sizes) <= MAX_TOTAL:
        return found
    chosen = docs.sparkSession.createDataFrame([(i,) for i in fair_share([tuple(r) for r in sizes], MAX_TOTAL)], "_id string")
    return found.join(F.broadcast(chosen), F.col("id").cast("string") == F.col("_id"), "left_semi")


def fair_share(rows: list[tuple[str, str, int, int]], most: int) -> list[str]:
    """Ids of rows (id, class, place, size) of at most ``most`` in all: the classes in turn, in the order of the places; none after the first that has no room."""
    seen: dict[str, int] = {}
    turns = []
    for i, y, at, n in sorted(rows, key=lambda r: (r[2], r[0])):
        turns.append((seen.get(y, 0), at, i, n))
        seen[y] = seen.get(y, 0) + 1
    out, total = [], 0
    for _, _, i, n in sorted(turns):
        total += n
        if total > most:
            break
        out.append(i)
    return out


def learned(rows: DataFrame, learn: Callable[[list[str], list], object]) -> object:
    """What ``learn`` makes of the texts and ys of a bounded sample, in one task; only the model comes to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((str(r["id"]), r["text"], r["y"]) for b in batches for r in b.to_pylist())
        model = learn([r[1] for r in found], [r[2] for r in found])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    out = rows.select("id", "y", "text").coalesce(1).mapInArrow(task, "model binary").collect()
    return pickle.loads(out[0]["model"]) if out else learn([], [])


def byte_slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as bytes (null: empty), in order, in lists of about SLICE_BYTES."""
    part, size = [], 0
    for value in texts.cast(pa.large_binary()) if len(texts) else ():
        data = value.as_py() or b""
        part.append(data)
        size += len(data)
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the last one is the bias. One class only: a constant."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        out = np.zeros(x.shape[1] + 1)
        out[-1] = 0.0 if n == 0 else (4.0 if y[0] else -4.0)
        return out
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) / n + ridge * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
