"""Parquet, JSON and model storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One table with a directory per split; a reader of one split skips the other."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(df[split] == name).drop(split)


def write_json(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines: few rows, so one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)

