"""The domain's tables in the catalogue, and schemas for export. Snapshots of stored tables are in ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.schemas import TABLES
from .store import Snapshots  # noqa: F401


def create_all(spark: SparkSession, database: str = "ledger") -> None:
    """Database and tables, where they don't exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (columns, _) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop_all(spark: SparkSession, database: str = "ledger") -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def describe(df: DataFrame) -> str:
    """Schema for export."""
    return df.schema.json()
