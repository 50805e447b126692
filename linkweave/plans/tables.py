"""Named inputs: reads a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names=TABLES) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}
