"""A training corpus from documents: quality, language, near duplicates, benchmark passages, pieces.

Each stage takes what the stage before kept, whole rows; the last gives sampled segmentations.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontaminate, language, near_dedup, piece_sampling, quality_model
from ledgerlake.llm.common import bound_batches, read_table, remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rule ensemble score reaches its cut.

    Null and empty texts are scored as texts without a word; repeated rows and equal ids are judged each by its
    text; a score at the cut stays. An empty table stays empty.
    """
    return quality_model.keep_quality(docs, quality_model.fit_ensemble(docs, read_table(spark, sf_dir, "labels")))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows.

    Null and empty texts, and texts without a letter, go; of languages that are equally likely the first by
    name counts; repeated rows are judged alike. Without a labelled row all go, so an empty table stays empty.
    """
    return language.keep_language(docs, language.fit_language(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the smallest id, of equal ids the first row.

    Null and empty texts have no copies and stay; of repeated rows one stays; a null id comes last. An empty
    table stays empty.
    """
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike; a window at exactly the least
    similarity counts as holding its item. Without items all stay; an empty table stays empty.
    """
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with piece ids.

    A null or empty text has one segmentation, without pieces; repeated rows have equal ones, and null ids
    share a seed. An empty table gives no rows. Only id and text are read.
    """
    return piece_sampling.sample_segmentations(docs, piece_sampling.load_pieces())


STAGES = [
    ("quality classifier", quality),
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

#: Learned and sampled stages have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _bounded(stage):
    @functools.wraps(stage)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return work


STAGES = [(name, _bounded(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str, keep_stages: bool = False) -> DataFrame:
    """STAGES over documents, each stage's rows written as Parquet in the shared folder and read again.

    The folders of all but the last stage go once that is written, unless ``keep_stages``.
    """
    root = f"{shared_folder(spark)}/pipeline-{os.urandom(8).hex()}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    for k in range(0 if keep_stages else len(STAGES) - 1):
        remove(spark, f"{root}/{k}")
    return docs
