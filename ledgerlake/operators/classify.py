"""Labels by an external model: one question for each row, answers held to a schema, bad ones set aside with a reason."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import Snapshots, Transaction
from ..sources.schemas import LABEL
from .categorize import pending
from .merge import last_of_each

REJECTED = "rejected_answers"
REJECTED_COLUMNS = "reference string, answer string, reason string"


def prompt(template: str, categories: DataFrame) -> Column:
    """The template with the category tree, as JSON, in place of {categories}. categories: a row for each pair, so a dimension."""
    tree = categories.groupBy("category").agg(F.sort_array(F.collect_set("subcategory")).alias("subcategories")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("category", "subcategories")))).alias("tree"))
    return F.lit(template.replace("{categories}", tree.first()["tree"]))


def ask(questions: DataFrame, options: dict, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """reference, answer and failure of each row (reference, question).

    ``options["model"]`` ("module:factory", called with the options) gives each task a model, which has
    ``answer(question) -> str``. A question is asked up to ``retries`` times more after an OSError; the last
    error is the row's ``failure``, and its answer null. A null question has no answer.
    """
    retries, wait = int(options.get("retries", 3)), float(options.get("wait_seconds", 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, factory = options["model"].partition(":")
        model = getattr(importlib.import_module(module), factory)(options)

        def one(question: str | None) -> tuple[str | None, str | None]:
            for attempt in range(retries + 1 if question is not None else 0):
                try:
                    return model.answer(question), None
                except OSError as e:
                    if attempt == retries:
                        return None, f"{type(e).__name__}: {e}"
                    sleep(wait * 2**attempt)
            return None, "no question"

        for b in batches:
            told = [one(q) for q in b.column("question").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("reference"), pa.array([a for a, _ in told], pa.string()), pa.array([f for _, f in told], pa.string())], ["reference", "answer", "failure"])

    return questions.select(F.col("reference").cast("string"), F.col("question").cast("string")).mapInArrow(work, "reference string, answer string, failure string")


def judged(answers: DataFrame, categories: DataFrame) -> DataFrame:
    """answers and category_id, reasoning, confidence and reason: why the answer can't be used, null for a good one.

    An answer is one JSON object with all fields of LABEL, confidence from 0 to 1, and a known pair. Its
    own reference isn't looked at: the row's counts. categories: id, category, subcategory.
    """
    kinds = {f.name: f.dataType for f in LABEL.fields}
    parsed = F.from_json("answer", F.lit(", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", _corrupt string"), {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    ids = categories.select(F.col("id").alias("category_id"), F.col("category").alias("_category"), F.col("subcategory").alias("_subcategory"))
    p, found = lambda n: F.col(f"_parsed.{n}"), answers.withColumn("_parsed", parsed)
    named = found.join(ids, (p("category") == F.col("_category")) & (p("subcategory") == F.col("_subcategory")), "left")
    reason = F.coalesce(
        F.col("failure"), F.when(F.col("answer").isNull(), "no answer"), F.when(~F.col("answer").rlike(r"^\s*\{") | p("_corrupt").isNotNull() | F.col("_parsed").isNull(), "no JSON object of the schema"),
        *[F.when(p(n).isNull(), f"{n} is missing") for n in kinds], F.when(~p("confidence").between(0, 1), "confidence isn't from 0 to 1"), F.when(F.col("category_id").isNull(), "unknown category"),
    )
    return named.select(*answers.columns, "category_id", p("reasoning").alias("reasoning"), p("confidence").cast("double").alias("confidence"), reason.alias("reason"))


def label_pending(store: Snapshots, transactions: DataFrame, question: Column, options: dict, order: Column | None = None) -> tuple[int, int]:
    """Ask for all transactions that have no label; labels and rejected answers are one commit. How many of each there are.

    A transaction whose answer was rejected has no label, so the next run asks again; of its answers the
    last is kept.
    """
    at = F.lit(0) if order is None else order
    asked = pending(transactions, store.read("transaction_categories")).select(F.col("reference").cast("string").alias("reference"), question.alias("question"), at.alias("_at"))
    once = last_of_each(asked, ["reference"], F.struct("_at", "question")).drop("_at")
    answers = judged(ask(once, options), store.read("categories")).persist()  # each question is asked once, also when the commit is tried again
    good, bad = answers.where("reason is null"), answers.where("reason is not null")

    def work(tx: Transaction) -> None:
        tx.create(REJECTED, REJECTED_COLUMNS, ("reference",))
        tx.replace("transaction_categories", good.select("reference", "category_id", "reasoning", "confidence"), F.lit(0))
        tx.upsert(REJECTED, bad.select("reference", "answer", "reason"), F.lit(0))
        tx.delete(REJECTED, good.select("reference"), "reference")

    try:
        store.run(work)
        return good.count(), bad.count()
    finally:
        answers.unpersist()
