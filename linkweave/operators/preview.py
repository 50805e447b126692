"""Bounded previews of tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.config import Limits
from linkweave.functions.text import quoted, truncate_utf8, when
from linkweave.sources.catalog import unique_headers

# Preview kinds by file extension.
PREVIEW_KINDS = {
    "mermaid": (".mmd", ".mermaid"),
    "markdown": (".md", ".markdown"),
    "json": (".json", ".geojson"),
    "table": (".csv", ".tsv", ".parquet", ".xlsx", ".xls", ".sqlite", ".sqlite3", ".db"),
    "document": (".docx", ".pptx"),
    "pdf": (".pdf",),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".svg", ".ico"),
    "video": (".mp4", ".webm", ".ogv", ".mov", ".m4v"),
    "audio": (".mp3", ".wav", ".ogg", ".oga", ".m4a", ".flac", ".aac"),
    "archive": (".zip", ".tar", ".tgz", ".gz", ".bz2", ".xz"),
    "text": (
        ".txt", ".log", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".html", ".htm", ".css",
        ".scss", ".sass", ".less", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".vue", ".py", ".pyi", ".java",
        ".kt", ".kts", ".go", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs", ".php", ".rb", ".sh", ".ps1", ".bat",
        ".cmd", ".sql", ".graphql", ".gql", ".env", ".properties", ".jsonl", ".ndjson",
    ),
}


def preview_kind(ext: str) -> str:
    return when(
        *[(f"{ext} IN ({quoted(exts)})", f"'{kind}'") for kind, exts in PREVIEW_KINDS.items()], otherwise="'unsupported'"
    )


def table_preview(df: DataFrame, order: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """First rows and columns of a table with `truncated` set where rows were left out.

    Only one row more than is shown is read.
    """
    shown = df.select(*df.columns[: limits.preview_columns])
    rows = (shown.orderBy(*order) if order else shown).limit(limits.preview_rows + 1)
    key = ", ".join(order) if order else "1"
    numbered = rows.selectExpr("*", f"row_number() OVER (ORDER BY {key}) AS n")
    return numbered.selectExpr("*", f"count(1) OVER () > {limits.preview_rows} AS truncated").where(
        f"n <= {limits.preview_rows}"
    )


def header_rows(rows: DataFrame, candidates: int = 10, width: int = 80) -> DataFrame:
    """Row most likely to be the header of each sheet (table_id, row_idx, cells).

    Among the first ten rows: most filled cells, then most distinct, then most that are not numbers;
    the earliest row wins ties.
    """
    filled = f"filter(transform(filter(slice(cells, 1, {width}), c -> c IS NOT NULL AND c <> ''), c -> trim(c)), c -> true)"
    texts = r"size(filter(f, c -> NOT c rlike r'^(?=.*\d)\d*[.]?\d*$'))"
    scored = rows.where(f"row_idx < {candidates}").selectExpr("table_id", "row_idx", "cells", f"{filled} AS f").selectExpr(
        "table_id", "row_idx", "cells", f"struct(size(f) AS n, size(array_distinct(f)) AS u, {texts} AS t, -row_idx AS o) AS score"
    )
    best = scored.groupBy("table_id").agg(F.expr("max_by(struct(row_idx, cells), score) AS best"))
    return best.selectExpr("table_id", "best.row_idx + 1 AS header_row", "best.cells AS cells")


def inferred_headers(rows: DataFrame, width: int = 80) -> DataFrame:
    """Unique column names of each sheet, from its inferred header row."""
    cells = header_rows(rows, width=width).selectExpr(
        "table_id AS table", "header_row", f"posexplode(slice(cells, 1, {width})) AS (position, header)"
    )
    return unique_headers(cells, first_suffix=2).selectExpr("table AS table_id", "header_row", "position", "query_name AS name")


def text_preview(texts: DataFrame, limits: Limits = Limits(), limit: int | None = None) -> DataFrame:
    """First bytes of texts, with `truncated` and whether the whole text is valid JSON."""
    size = limit or limits.preview_text_bytes
    return texts.selectExpr(
        "* EXCEPT (text)", f"octet_length(text) > {size} AS truncated", f"{truncate_utf8('text', size)} AS preview",
        f"octet_length(text) <= {size} AND try_parse_json(text) IS NOT NULL AS valid_json",
    )


