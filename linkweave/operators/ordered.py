"""Running values along an order, without one task per key.

A plain window over a key puts all rows of that key into one task. Here a key is cut into buckets of its
order (`seq` or a time); each bucket is worked on by itself and what came before it is carried in from a
table with one row per (key, bucket). A key that holds a third of all rows is many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut_lineage

WIDTH = 1_000_000


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.selectExpr("*", f"bigint(floor({order} / {width})) AS __bucket")


def carried_lag(df: DataFrame, key: list[str], order: str, values: list[str], width: int = WIDTH) -> DataFrame:
    """Adds prev_<value>: the values of the row before, within the key. `order` is a number, unique per key."""
    keys = ", ".join(key)
    packed = f"struct({', '.join(values)})"
    rows = _bucketed(df, order, width)
    last = rows.groupBy(*key, "__bucket").agg(F.expr(f"max_by({packed}, {order}) AS __last")).selectExpr(
        *key, "__bucket", f"lag(__last) OVER (PARTITION BY {keys} ORDER BY __bucket) AS __carried"
    )
    within = rows.selectExpr("*", f"lag({packed}) OVER (PARTITION BY {keys}, __bucket ORDER BY {order}) AS __near")
    joined = within.join(last, [*key, "__bucket"])
    previous = "coalesce(__near, __carried)"
    return joined.selectExpr(
        *df.columns, *[f"{previous}.{v} AS prev_{v}" for v in values], f"{previous} IS NULL AS is_first"
    )


def carried_sum(df: DataFrame, key: list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the running sum of an expression along the order, the current row included."""
    return _carried(df, key, order, value, name, "sum", width)


def carried_max(df: DataFrame, key: list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the running maximum of an expression along the order, the current row included."""
    return _carried(df, key, order, value, name, "max", width)


def _carried(df, key, order, value, name, how, width) -> DataFrame:
    keys = ", ".join(key)
    rows = _bucketed(df, order, width).selectExpr("*", f"{value} AS __value")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    totals = rows.groupBy(*key, "__bucket").agg(F.expr(f"{how}(__value) AS __total")).selectExpr(
        *key, "__bucket", f"{how}(__total) OVER (PARTITION BY {keys} ORDER BY __bucket {before}) AS __carried"
    )
    within = rows.selectExpr(
        "*", f"{how}(__value) OVER (PARTITION BY {keys}, __bucket ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS __near"
    )
    joined = within.join(totals, [*key, "__bucket"])
    combined = (
        "coalesce(__near, 0) + coalesce(__carried, 0)" if how == "sum"
        else "greatest(__near, __carried)"  # greatest skips NULLs
    )
    return joined.selectExpr(*df.columns, f"{combined} AS {name}")


def carried_asof(
    requests: DataFrame, versions: DataFrame, key: list[str], order: str, values: list[str], width: int = WIDTH
) -> DataFrame:
    """The requests, each with the values of the version of its key that was newest at its time (<=), NULL before the first.

    Both frames have the key and `order`, a number; of versions of one time the largest values count. One row a request comes out: a key's
    rows are cut into buckets of the order, and each bucket begins with the last version before it.
    """
    keys = ", ".join(key)
    packed = f"struct({', '.join(values)})"
    kind = versions.selectExpr(f"{packed} AS v").schema["v"].dataType.simpleString()
    asked = requests.selectExpr(*key, f"{order} AS __at", "1 AS __kind", f"cast(NULL AS {kind}) AS __value", f"struct({', '.join(requests.columns)}) AS __row")
    row = asked.schema["__row"].dataType.simpleString()
    known = versions.selectExpr(*key, f"{order} AS __at", "0 AS __kind", f"{packed} AS __value", f"cast(NULL AS {row}) AS __row")
    rows = _bucketed(known.unionByName(asked), "__at", width)
    last = rows.groupBy(*key, "__bucket").agg(F.expr("max_by(__value, struct(__at, __value)) FILTER (WHERE __kind = 0) AS __last")).selectExpr(
        *key, "__bucket",
        f"last(__last, true) OVER (PARTITION BY {keys} ORDER BY __bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __carried",
    )
    within = rows.selectExpr(
        "*", f"last(__value, true) OVER (PARTITION BY {keys}, __bucket ORDER BY __at, __kind, __value ROWS UNBOUNDED PRECEDING) AS __near"
    ).where("__kind = 1")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*key, "__bucket")]
    joined = within.alias("r").join(last.alias("l"), same, "left")
    return joined.selectExpr("r.__row AS __row", "coalesce(r.__near, l.__carried) AS __version").selectExpr(
        "__row.*", *[f"__version.{v} AS {v}" for v in values]
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place (from 0) along an order of the whole frame.

    Rows are dealt out by range, sorted and written; a row's place is its place in its file after the rows of the
    files before. Only one row a file is ordered as a whole. Rows that are equal in `order` stand in any order.
    """
    ranges = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n_part", F.spark_partition_id()), "ranges"
    ).select("*", F.col("_metadata.file_name").alias("__n_file"), F.col("_metadata.row_index").alias("__n_row"))
    files = ranges.groupBy("__n_file").agg(F.min("__n_part").alias("__n_part"), F.count(F.lit(1)).alias("__n_rows")).selectExpr(
        "__n_file", "coalesce(sum(__n_rows) OVER (ORDER BY __n_part, __n_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __n_before"
    )
    # a row for each task that wrote, so for each shuffle partition
    return ranges.join(F.broadcast(files), "__n_file").select(*rows.columns, (F.col("__n_before") + F.col("__n_row")).alias(name))
