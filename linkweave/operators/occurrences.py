"""Value occurrences: wide rows turned into (table, column, row, value), and their distinct form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.config import ValueRules
from linkweave.functions.text import (
    fingerprint,
    normalize_value,
    quote,
    safe_preview,
    stringify,
    with_nfkc,
)
from linkweave.functions.values import specificity, valid_join_value
from linkweave.operators.ordered import numbered
from linkweave.session import input_bytes, spread
from linkweave.sources.catalog import is_text

FILE_STRIDE = 1 << 40


ROW = "__row"
"""Column of a frame that was numbered where it was read (text formats); it is no column of the table."""


def with_row_number(df: DataFrame) -> DataFrame:
    """Adds `row_no`: 1-based within a file, stable between runs; further files start at multiples of 2^40.

    Needs a file source that tells its row index (Parquet), or a frame with a number a row already.
    """
    return with_file_ordinals(file_rows(df), df)


def file_rows(df: DataFrame) -> DataFrame:
    """Adds `row_no`, the 1-based row of a file, and where `df` is read from several files `__file`; rows of text formats are numbered as they are read."""
    if ROW in df.columns:
        return df.withColumnRenamed(ROW, "row_no")
    index = (F.col("_metadata.row_index") + F.lit(1)).alias("row_no")
    return df.select("*", index) if len(df.inputFiles()) <= 1 else df.select("*", index, F.col("_metadata.file_path").alias("__file"))


def with_file_ordinals(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Rows with the row_no and __file of `file_rows(df)`, numbered over all files."""
    if "__file" not in rows.columns:
        return rows
    # a row a file, and the listing holds as much already; without the hint Spark may send the table instead, and one task reads it
    return rows.join(F.broadcast(file_ordinals(df)), "__file").withColumn("row_no", F.expr(f"row_no + ordinal * {FILE_STRIDE}")).drop("__file", "ordinal")


def file_ordinals(df: DataFrame) -> DataFrame:
    """(__file, ordinal): the files that a frame has rows of, numbered from 0 by path. Reads no column of the table."""
    return numbered(df.select(F.col("_metadata.file_path").alias("__file")).distinct(), [F.col("__file").asc()], "ordinal")


def join_cells(
    df: DataFrame, columns: list[tuple[str, str]], rules: ValueRules = ValueRules(), carry: tuple[str, ...] = ()
) -> DataFrame:
    """row_no, the chosen columns with their values in normal form, NULL where they can't link, and carried columns as they are.

    Only those columns are read."""
    types = {c: df.schema[c].dataType for c, _ in columns}
    # one projection per step, so that each reads a finished text instead of repeating its expression
    texts = df.selectExpr("row_no", *carry, *[f"{stringify(f'`{c}`', t)} AS `{c}`" for c, t in types.items()])
    composed = with_nfkc(texts, *[c for c, t in types.items() if is_text(t)])
    folded = composed.selectExpr(
        "row_no", *carry, *[f"{_folded(f'`{c}`', t)} AS `{c}`" for c, t in types.items()]
    )
    return folded.selectExpr(
        "row_no", *carry, *[f"if({_valid(f'`{c}`', kind, types[c], rules)}, `{c}`, NULL) AS `{c}`" for c, kind in columns]
    )


def table_occurrences(
    df: DataFrame, table: str, columns: list[tuple[str, str]], rules: ValueRules = ValueRules(), carry: tuple[str, ...] = ()
) -> DataFrame:
    """(table, column, row_no, value) of the chosen columns, and carried columns as they are. Only those columns are read."""
    if "row_no" not in df.columns:
        df = with_row_number(df)
    tall = join_cells(df, columns, rules, carry).unpivot(["row_no", *carry], [c for c, _ in columns], "column", "value")
    return tall.where(F.col("value").isNotNull()).select(F.lit(table).alias("table"), "column", "row_no", "value", *carry)


def _folded(x: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return x  # digits and a sign are in normal form
    if isinstance(dtype, T.NumericType):
        return f"lower({x})"
    return normalize_value(x, ascii_only=not is_text(dtype))


def _valid(x: str, kind: str, dtype: T.DataType, rules: ValueRules) -> str:
    """The value rules, less those that the text of a number cannot break."""
    if isinstance(dtype, T.NumericType) and kind != "name":
        short = f"char_length({x}) < {rules.min_digits} AND {x} rlike '^[0-9]+$'"
        keyed = kind in ("id", "code", "reference", "phone") and rules.min_digits > 1
        return f"({x} <> ''" + (f" AND NOT ({short}))" if keyed else ")")
    return valid_join_value(x, quote(kind), rules)


def occurrences(
    tables: dict[str, DataFrame],
    columns: dict[str, list[tuple[str, str]]],
    rules: ValueRules = ValueRules(),
    bootstrap_rows: dict[str, int] | None = None,
) -> DataFrame:
    """Occurrences of several tables. `bootstrap_rows` reads only the first rows of a table."""
    parts = []
    if not columns:  # no table has a join column
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, row_no long, value string")
    for table in sorted(columns):
        df = with_row_number(tables[table])
        if bootstrap_rows and table in bootstrap_rows:
            df = df.where(F.col("row_no") <= bootstrap_rows[table])
        wanted = spread(df.select("row_no", *[c for c, _ in columns[table]]))
        parts.append(table_occurrences(wanted, table, columns[table], rules))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


TASK_BYTES = 16 << 20
"""Input for a task that holds distinct values; a few hundred bytes of memory a value make some ten times as much of it."""


def distinct_values(cells: DataFrame, few: bool = False) -> DataFrame:
    """One row per (table, column, value) with its first row and its count; combined before the shuffle.

    Of large tables, values are combined by the batch and dealt out to as many tasks as the input asks for, so that no task holds more of
    them as tables grow. `few`: the cells were thinned out, and their input says nothing of them.
    """
    keys, parts = ["table", "column", "value"], 0 if few or cells.isStreaming else input_bytes(cells) // TASK_BYTES
    if parts <= 1:
        grouped = cells.groupBy(*keys).agg(F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("cells"))
    else:
        combined = cells.select(*keys, "row_no").mapInArrow(_combining(), "table string, column string, value string, row_no long, cells long")
        parts = max(parts, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        grouped = combined.repartition(parts, *keys).groupBy(*keys).agg(F.min("row_no").alias("row_no"), F.sum("cells").alias("cells"))
    return grouped.selectExpr("*", f"{fingerprint('value')} AS fingerprint")


def _combining():
    """Equal cells of a batch become one row, so that a frequent value is not a row a cell in the shuffle."""

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(["table", "column", "value"], use_threads=False)
            rows = rows.aggregate([("row_no", "min"), ("row_no", "count")]).select(["table", "column", "value", "row_no_min", "row_no_count"])
            yield from rows.rename_columns(["table", "column", "value", "row_no", "cells"]).to_batches()

    return run


def describe_values(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds what the catalog knows of the column, the locator, the masked preview and the specificity."""
    return values.join(known_columns(catalog), ["table", "column"]).selectExpr(
        "* EXCEPT (value)",
        f"{cell_locator()} AS locator",
        f"{safe_preview('kind', 'value')} AS preview",
        f"{specificity('value', 'kind')} AS specificity",
        "xxhash64(value) AS probe_key",
    )


def known_columns(catalog: DataFrame) -> DataFrame:
    """What a join needs of the catalog: one short row per column, so it is broadcast."""
    return F.broadcast(catalog.selectExpr("table", "name AS column", "position", "key", "kind", "base"))


def cell_locator() -> str:
    part = "if(shiftright(row_no, 40) > 0, concat('#', shiftright(row_no, 40)), '')"
    return f"concat('table:', table, {part}, ';row:', row_no & {FILE_STRIDE - 1}, ';column:', column)"
