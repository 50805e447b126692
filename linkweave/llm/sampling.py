"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves `fold` when divided by `folds`. A NULL key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def spread_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of the smallest key hashes; the same rows each time. `most` bounds the result."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def one_text_each(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row of each key: that of the smallest text hash, ties by the text. Tasks keep one row a key before they shuffle, so
    a key that repeats without end sends on one row a task."""
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY xxhash64({text}), {text})")
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
