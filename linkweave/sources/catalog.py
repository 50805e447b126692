"""Catalog of tables and columns: header clean-up, kinds, seed choice, role scores, signature."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from linkweave.config import JOIN_KINDS, HeaderRules, Limits
from linkweave.functions.headers import header_base, header_key, header_kind
from linkweave.functions.text import SPACE, casefold, count_of, filled, replace_all, with_nfkc


def unique_headers(headers: DataFrame, first_suffix: int = 1) -> DataFrame:
    """(table, position, header) -> name, query_name. Blanks become column_n; repeats get a suffix.

    `first_suffix` is the number the second occurrence gets (1 in discovery, 2 in previews).
    """
    named = with_nfkc(headers, "header").selectExpr(
        "*", f"coalesce({filled('header')}, concat('column_', position + 1)) AS name"
    )
    seen = named.selectExpr("*", "row_number() OVER (PARTITION BY table, name ORDER BY position) AS seen")
    return seen.selectExpr(
        "* EXCEPT (seen)", f"if(seen = 1, name, concat(name, '_', seen - 2 + {first_suffix})) AS query_name"
    )


def column_meaning(columns: DataFrame, rules: HeaderRules = HeaderRules()) -> DataFrame:
    """Adds key, kind and base to a frame that has `name`."""
    keyed = columns.selectExpr("*", f"{header_key('name', rules)} AS key")
    kinds = keyed.selectExpr("*", f"{header_kind('key', rules)} AS kind")
    return kinds.selectExpr("*", f"{header_base('key', 'kind', rules)} AS base")


def schema_catalog(
    spark: SparkSession, tables: dict[str, DataFrame], rules: HeaderRules = HeaderRules()
) -> DataFrame:
    """One row per column of the given tables. Schemas are driver metadata, so this reads no data."""
    rows = [
        (table, position, unicodedata.normalize("NFKC", field.name).strip(), field.dataType.simpleString())
        for table, df in sorted(tables.items())
        for position, field in enumerate(f for f in df.schema.fields if f.name != "__row")  # a row number isn't a column
    ]
    columns = spark.createDataFrame(rows, "table string, position int, name string, dtype string")
    meaning = column_meaning(columns, rules)
    # finished rows, one per column: later plans carry values instead of the marker rules
    return spark.createDataFrame(meaning.collect(), meaning.schema)


def join_columns(catalog: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """{table: [(column, kind)]} of the columns worth scanning. One row per column comes to the driver."""
    chosen: dict[str, list[tuple[str, str]]] = {}
    for row in catalog.where(F.col("kind").isin(*JOIN_KINDS)).orderBy("table", "position").collect():
        chosen.setdefault(row["table"], []).append((row["name"], row["kind"]))
    return chosen


# Words in a file name that make it worth reading first.
ROLE_TERMS = (
    "rule", "rules", "policy", "policies", "config", "configuration", "reference", "lookup",
    "dictionary", "mapping", "template", "sample", "example", "result", "output", "spec",
    "规则", "政策", "配置", "参考", "字典", "映射", "模板", "样例", "示例", "结果", "输出", "规范",
)


def goal_tokens(x: str) -> str:
    """Words of two characters or more and neighbouring CJK pairs, blanks removed first."""
    packed = casefold(replace_all(x, SPACE + "+"))
    chinese = replace_all(x, "[^一-鿿]+")
    size = f"char_length({chinese})"
    pairs = (
        f"if({size} > 1, transform(sequence(1, greatest({size} - 1, 1)), i -> substring({chinese}, i, 2)),"
        " cast(array() as array<string>))"
    )
    return f"array_union(regexp_extract_all({packed}, '[a-z0-9_]{{2,}}|[一-鿿]{{2,}}', 0), {pairs})"


def role_score(stem: str, goal: str | None = None) -> str:
    """Role words in a file stem, plus twice the share of its tokens that the goal names."""
    score = f"double({count_of(header_key(stem), ROLE_TERMS)})"
    if goal is None:
        return score
    tokens = goal_tokens(stem)
    return f"({score} + 2D * size(array_intersect({tokens}, {goal_tokens(goal)})) / greatest(size({tokens}), 1))"


def seed_tables(tables: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(table, role_score, row_count?, column_count, size) -> seeds in reading order (`seed_order`).

    Without a table that fits the budgets, the smallest one is taken; if its cells and its file are both above them, only its
    first rows are (`bootstrap`).
    """
    cells = F.col("row_count") * F.col("column_count")
    weight = F.when(cells.isNull() | (cells == 0), F.col("size")).otherwise(cells)
    fits = F.when(cells.isNull(), F.col("size") <= limits.seed_file_bytes).otherwise(
        cells <= limits.seed_cell_budget
    )
    ranked = tables.withColumn("cells", cells).withColumn("weight", weight).withColumn("fits", fits)
    # one row per table: the catalog is metadata, so one window over all of it is small
    ranked = ranked.withColumn("any_fits", F.max(F.col("fits").cast("int")).over(W.partitionBy()))
    smallest = F.row_number().over(W.orderBy("weight", "table"))
    order = F.row_number().over(W.orderBy(F.desc("role_score"), "weight", "table"))
    return (
        ranked.withColumn("by_size", smallest)
        .where(F.col("fits") | ((F.col("any_fits") == 0) & (F.col("by_size") == 1)))
        .withColumn("seed_order", order)
        .withColumn("bootstrap", F.coalesce((cells > limits.seed_cell_budget) & (F.col("size") > limits.seed_file_bytes), F.lit(False)))
        .drop("fits", "any_fits", "by_size", "weight")
    )


def multiset_digest(line: str) -> list[Column]:
    """Aggregates whose values change when any line of a group changes, in any order.

    Four lanes of each line's SHA-256 are summed, so the lines are never brought together.
    """
    lanes = [
        F.expr(f"sum(cast(conv(substring(sha2({line}, 256), {1 + 15 * i}, 15), 16, 10) as decimal(20,0))) AS lane{i}")
        for i in range(4)
    ]
    return [F.expr("count(1) AS lines"), *lanes]


def digest_of() -> str:
    lanes = ", ".join(f"string(lane{i})" for i in range(4))
    return f"sha2(concat_ws('\n', string(lines), {lanes}), 256)"


def catalog_signature(files: DataFrame) -> DataFrame:
    """One digest over (path, size, modified, sha256); equal catalogs allow old results to be reused."""
    line = "concat_ws('\0', path, string(size), string(modified), sha256)"
    return files.agg(*multiset_digest(line)).selectExpr("lines AS files", f"{digest_of()} AS signature")


def content_digest(files: DataFrame, group: str) -> DataFrame:
    """One digest per folder over its (path, content) pairs, caches left out. A hash of hashes."""
    kept = files.where("NOT path rlike '(^|/)__pycache__(/|$)' AND NOT lower(path) rlike '[.]py[co]$'")
    line = "concat_ws('\0', path, sha2(content, 256))"
    return kept.groupBy(group).agg(*multiset_digest(line)).selectExpr(
        group, "lines AS files", f"{digest_of()} AS digest"
    )


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType))
