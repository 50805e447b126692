"""From raw documents to shards: quality, near duplicates, decontamination, mixing, sharding.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.decontamination import decontaminated
from linkweave.llm.mixing import mixed
from linkweave.llm.near_duplicates import distinct_documents
from linkweave.llm.quality import good_documents
from linkweave.llm.sharding import sharded
from linkweave.plans.tables import read_table
from linkweave.session import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    return distinct_documents(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture of sources; the order of the rows in its files is what the next stage takes."""
    return mixed(docs).orderBy("position").select(docs.columns)


def in_order(docs: DataFrame) -> DataFrame:
    """The rows with `position`, their place (from 0) in the order in which the stage before has written them."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        rows.schema
    except AnalysisException:  # not read from files
        rows = docs.select("*", F.format_string("%010d", F.spark_partition_id()).alias("__file"), F.expr("monotonically_increasing_id() & ((1L << 33) - 1)").alias("__row"))
    before = "coalesce(sum(__rows) OVER (ORDER BY __file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __before"
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows")).selectExpr("__file", before)
    # a row a file
    return rows.join(F.broadcast(files), "__file").withColumn("position", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot, shard and position in the mixture; the rows of a shard stand together, in the order of the mixture."""
    return sharded(in_order(docs)).orderBy("shard", "position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good), ("near_duplicates", keep_distinct), ("decontamination", keep_clean), ("mixing", keep_mixture), ("sharding", place),
]

ORACLE_SQL = None
"""Fitted weights and hashed mixtures are not SQL; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
