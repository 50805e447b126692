"""Column sketches: bottom-k samples of fingerprints and distinct ratios."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from linkweave.functions.text import fingerprint
from linkweave.operators.occurrences import distinct_values
from linkweave.session import cut_lineage


def bottom_k(values: DataFrame, k: int, by: tuple[str, ...] = ("table", "column")) -> DataFrame:
    """The k smallest fingerprints of each group. Spark keeps k per task before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy("fingerprint"))
    return values.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def value_totals(values: DataFrame) -> DataFrame:
    """Cells and distinct values per column."""
    return values.groupBy("table", "column").agg(F.sum("cells").alias("nonempty"), F.count(F.lit(1)).alias("distinct"))


def cardinality(cells: DataFrame, exact: bool = False) -> DataFrame:
    """Non-empty cells, distinct values and their ratio per column; a 256-register sketch by default."""
    if exact:
        grouped = value_totals(distinct_values(cells)).withColumn("distinct", F.col("distinct").cast("double"))
    else:
        grouped = cells.groupBy("table", "column").agg(
            F.count(F.lit(1)).alias("nonempty"),
            F.hll_sketch_estimate(F.hll_sketch_agg("value", 8)).cast("double").alias("distinct"),
        )
    ratio = F.least(F.lit(1.0), F.col("distinct") / F.col("nonempty"))
    return grouped.withColumn("ratio", F.round(ratio, 6))


def hash_cutoffs(stats: DataFrame, k: int, margin: int = 4) -> list[tuple[str, str, str]]:
    """(table, column, largest fingerprint worth keeping), from estimated distinct counts.

    Fingerprints are uniform, so the k-th smallest of n lies near k/n of the range; `margin` times that
    share makes a miss practically impossible, and `sampled_bottom_k` checks for one. One row per column.
    """
    cutoffs = []
    for row in stats.select("table", "column", "distinct").collect():
        share = (margin * k + 64) / max(row["distinct"], 1.0)
        if share < 0.5:
            cutoffs.append((row["table"], row["column"], f"{int(share * 16**12):012x}"))
    return cutoffs


def sampled_bottom_k(cells: DataFrame, stats: DataFrame, k: int, distinct: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bottom-k with almost no shuffle, for columns of billions of distinct values. Exact.

    Fingerprints above the cutoff of their column are dropped in the scan, so only a few hundred values of
    a high-cardinality column reach the distinct step. Columns that come out short are done again in full.
    """
    spark, few = cells.sparkSession, distinct or partial(distinct_values, few=True)
    distinct = distinct or distinct_values
    cutoffs = hash_cutoffs(stats, k)
    if not cutoffs:
        return bottom_k(distinct(cells), k)
    limit = spark.createDataFrame(cutoffs, "table string, column string, cutoff string")
    marked = cells.join(F.broadcast(limit), ["table", "column"], "left")
    near = marked.where(f"cutoff IS NULL OR {fingerprint('value')} < cutoff").drop("cutoff")
    kept = cut_lineage(bottom_k(few(near), k), "sample")
    short = [
        (r["table"], r["column"])
        for r in kept.groupBy("table", "column").count().join(limit, ["table", "column"], "right")
        .where(F.coalesce("count", F.lit(0)) < k).collect()
    ]
    if not short:
        return kept
    again = spark.createDataFrame(short, "table string, column string")
    full = bottom_k(distinct(cells.join(F.broadcast(again), ["table", "column"], "left_semi")), k)
    return kept.join(F.broadcast(again), ["table", "column"], "left_anti").unionByName(full)


def smallest_values(values: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Bottom-k of distinct values whose numbers per column are known: no task sorts more than a few hundred of a column."""
    return sampled_bottom_k(values, totals, k, distinct=lambda near: near)


def column_profile(cells: DataFrame, k: int) -> DataFrame:
    """Per column: cells, distinct values, ratio and the k smallest fingerprints as rows."""
    # written without fingerprints, which are longer than most values; both steps below read it
    values = cut_lineage(distinct_values(cells).drop("fingerprint", "row_no"), "values").selectExpr("*", f"{fingerprint('value')} AS fingerprint")
    totals = cut_lineage(value_totals(values), "totals")
    w = W.partitionBy("table", "column")
    sample = smallest_values(values, totals, k).drop("cells").withColumn("rank", F.row_number().over(w.orderBy("fingerprint")))
    ratio = F.round(F.least(F.lit(1.0), F.col("distinct") / F.col("nonempty")), 6)
    return sample.join(F.broadcast(totals), ["table", "column"]).withColumn("ratio", ratio)
