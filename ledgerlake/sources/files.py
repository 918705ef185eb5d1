"""File sources: JSON arrays, JSON lines, category trees and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_blank
from .schemas import CATEGORY, TRANSACTION, required


def checked(df: DataFrame, schema: T.StructType, root: str = "") -> DataFrame:
    """df; reading it fails where a required field is missing (of optional structs: where these are present)."""
    missing: Column = F.lit(False)
    for path in required(schema):
        parents = path.split(".")[:-1]
        absent = F.col(f"{root}{path}").isNull()
        for k in range(len(parents)):
            absent = absent & F.col(root + ".".join(parents[: k + 1])).isNotNull()
        missing = missing | absent
    return df.where(F.when(missing, F.raise_error(F.lit("a required field is missing")).cast("boolean")).otherwise(True))


def read_array(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    """Rows of files that hold one JSON array each; a malformed file or a missing field fails the load."""
    return checked(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path), schema)


def decode_lines(lines: DataFrame, schema: T.StructType = TRANSACTION, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text lines as columns next to the raw line, blank lines skipped; a bad line fails."""
    parsed = lines.where(~is_blank(F.col(column))).withColumn("parsed", F.from_json(column, schema, {"mode": "FAILFAST"}))
    return checked(parsed, schema, "parsed.").select(F.col(column).alias("raw"), "parsed.*", *keep)


def read_lines(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    return decode_lines(spark.read.text(path), schema)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """category, subcategory of a category tree; a category without any gives no row."""
    return explode_categories(read_array(spark, path, CATEGORY))


def explode_categories(tree: DataFrame) -> DataFrame:
    return tree.select("category", F.explode("subcategories").alias("subcategory"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its whole text."""
    return spark.read.text(path, wholetext=True)


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chart data: a JSON array of flat objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
