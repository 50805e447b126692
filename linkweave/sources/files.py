"""File sources: inventory, delimited and JSON-lines scans with line numbers, text segments, globs."""

from __future__ import annotations

import csv
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.text import quoted, raw, when
from linkweave.operators.ordered import numbered
from linkweave.session import cut_lineage
from linkweave.sources.catalog import unique_headers

# Kinds by file extension.
TABULAR = (".csv", ".tsv", ".xlsx", ".jsonl", ".ndjson", ".parquet", ".sqlite", ".sqlite3", ".db")
TEXT = (
    ".txt", ".md", ".markdown", ".log", ".sql", ".json", ".xml", ".html", ".htm", ".yaml", ".yml", ".ini",
    ".cfg", ".conf",
)
DOCUMENT = TEXT + (
    ".pdf", ".docx", ".pptx", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp",
)

INLINE_BYTES = 256 * 1024 * 1024


def extension(path: str) -> str:
    """Lower-case extension with its dot; '' for none and for dot files."""
    name = f"regexp_extract({path}, {raw('([^/]*)$')}, 1)"
    return f"lower(regexp_extract({name}, {raw('[^.][^/]*([.][^./]+)$')}, 1))"


def file_name(path: str) -> str:
    return f"regexp_extract({path}, {raw('([^/]*)$')}, 1)"


def file_kind(ext: str) -> str:
    return when(
        (f"{ext} IN ({quoted(TABULAR)})", "'tabular'"), (f"{ext} IN ({quoted(DOCUMENT)})", "'document'"),
        otherwise="'binary'",
    )


def numbered_files(files: DataFrame) -> DataFrame:
    """Adds extension, kind and a 1-based id by folded path to (path, size, sha256, ...)."""
    described = files.selectExpr("*", f"{extension('path')} AS extension").selectExpr(
        "*", f"{file_kind('extension')} AS kind", "lower(path) AS order_key"
    )
    return global_rank(described, ["order_key", "path"], "id").drop("order_key")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based rank over all rows."""
    return numbered(df, [F.col(c).asc() for c in order], name).withColumn(name, F.col(name) + 1)


def inventory(spark: SparkSession, folder: str, inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """Files below a folder: path, size, modified, sha256, extension, kind, id.

    Small files are hashed from their row. Larger ones do not fit a row and are hashed as a stream by
    the task that holds their path. Spark lists no empty files.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .selectExpr("path", "length AS size", "unix_micros(modificationTime) AS modified", "content")
    )
    small = listing.where(f"size <= {inline_bytes}").selectExpr("path", "size", "modified", "sha2(content, 256) AS sha256")
    large = listing.where(f"size > {inline_bytes}").select("path", "size", "modified")
    hashed = large.repartition("path").mapInPandas(_hash_streams, "path string, size long, modified long, sha256 string")
    root = folder if ":" in folder else "file:" + folder
    relative = f"ltrim('/', replace(path, {quoted([root.rstrip('/')])}, ''))"
    rows = small.unionByName(hashed).selectExpr(f"{relative} AS path", "size", "modified", "sha256")
    return numbered_files(rows)


def _hash_streams(batches):
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({**{c: batch[c] for c in batch.columns}, "sha256": digests})


def sniff_separator(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """Separator of a delimited file, from its first lines (200 lines, 8192 characters)."""
    lines = spark.read.option("encoding", encoding).text(path).limit(200).collect()
    head = "\n".join(row[0] for row in lines)[:8192]
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """All-text scan of a CSV or TSV file. Missing cells of short rows are NULL."""
    if separator is None:
        separator = "\t" if path.lower().endswith(".tsv") else sniff_separator(spark, path, encoding)
    return spark.read.csv(
        path, header=True, sep=separator, encoding=encoding, mode="PERMISSIVE", inferSchema=False,
        multiLine=False, quote='"', escape='"',
    )


def numbered_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", pattern: str | None = None) -> DataFrame:
    """(path, ordinal, line_no, row_no, value) of the lines of text files; the numbers depend on the files alone.

    A line's place within its split is its own; the lines of a file's earlier splits are added from one count a split, and
    row_no counts further files from multiples of 2^40, by path. `pattern` is a glob for the names of files below a folder.
    """
    reader = spark.read.option("encoding", encoding).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    lines = reader.text(path).select(
        F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    splits = cut_lineage(lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "splits")
    files = numbered(splits.select("path").distinct(), [F.col("path").asc()], "ordinal")
    before = splits.selectExpr(
        "path", "start", "first", "coalesce(sum(n) OVER (PARTITION BY path ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before"
    ).join(files, "path")
    return lines.join(before, ["path", "start"]).selectExpr("path", "ordinal", "at - first + before + 1 AS line_no", "value").selectExpr(
        "path", "ordinal", "line_no", f"ordinal * {1 << 40} + line_no AS row_no", "value"
    )


def scan_delimited(spark: SparkSession, path: str | list[str], separator: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """A CSV or TSV table as text columns with its row numbers (`__row`): lines after the header of each file.

    Blank lines are no rows, cells that short rows lack are NULL, and a quoted cell ends on its line.
    """
    first = path if isinstance(path, str) else path[0]
    if separator is None:
        separator = "\t" if first.lower().endswith(".tsv") else sniff_separator(spark, first, encoding)
    lines = numbered_lines(spark, path, encoding)
    head = lines.where("ordinal = 0 AND line_no = 1").first()
    cells = next(csv.reader([head["value"].lstrip("\ufeff")], delimiter=separator), []) if head else []
    named = spark.createDataFrame([("", i, c) for i, c in enumerate(cells)], "table string, position int, header string")
    names = [r["query_name"] for r in unique_headers(named).orderBy("position").collect()]
    if not names:
        return lines.selectExpr("row_no AS __row").limit(0)
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = f"map('sep', {quoted([separator])}, 'escape', '\"')"
    rows = lines.where("line_no > 1 AND trim(value) <> ''")
    return rows.selectExpr("row_no - 1 AS __row", f"from_csv(value, {quoted([fields])}, {options}) AS r").selectExpr("__row", "r.*")


def read_json_lines(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """JSON-lines scan: bad lines are skipped and nested values stay JSON text.

    The header is the union of the keys of all lines, in the order met; with `sample`, of the first so many lines.
    """
    lines = numbered_lines(spark, path).select("row_no", "value")
    head = lines if sample is None else lines.where(F.col("row_no") <= sample)
    keys = head.selectExpr("row_no", "posexplode(json_object_keys(value)) AS (p, k)")
    # a row a key, whatever the number of lines
    first = keys.groupBy("k").agg(F.min(F.struct("row_no", "p")).alias("at")).orderBy("at").collect()
    names = [row["k"] for row in first]
    fields = ", ".join(f"`{n}` string" for n in names)
    parsed = lines.selectExpr("row_no", f"from_json(value, {quoted([fields])}, map('mode', 'PERMISSIVE')) AS r", "value")
    return parsed.where("json_object_keys(value) IS NOT NULL").selectExpr("row_no", "r.*")


def line_segments(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with `locator` (line:n) and `line_no`."""
    split = df.selectExpr(
        f"* EXCEPT ({text})", f"posexplode(split(rtrim('\\n', {text}), {raw(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'n' + chr(92) + 'r]')})) AS (seq, line)"
    )
    return split.selectExpr("* EXCEPT (seq)", "seq + 1 AS line_no", "concat('line:', seq + 1) AS locator")


def grep_lines(df: DataFrame, pattern: str, name: str | None = None, glob: str | None = None, text: str = "text") -> DataFrame:
    """Lines that contain a text, of files whose name fits the glob. Texts without it are dropped first."""
    kept = df.where(F.contains(F.col(text), F.lit(pattern)))
    if glob and name:
        kept = glob_filter(kept, name, glob)
    return line_segments(kept, text).where(F.contains(F.col("line"), F.lit(pattern)))


def glob_filter(df: DataFrame, column: str, glob: str) -> DataFrame:
    return df.where(F.col(column).rlike(glob_regex(glob)))


def glob_regex(glob: str) -> str:
    """Regex of a shell pattern with *, ? and [..]."""
    out = []
    i = 0
    while i < len(glob):
        char = glob[i]
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append("\\" + char if not char.isalnum() else char)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def line_page(df: DataFrame, offset: int, limit: int, text: str = "text") -> DataFrame:
    """Lines offset+1 .. offset+limit of each text, with the total number of lines."""
    lines = f"split(rtrim('\\n', {text}), {raw(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'n' + chr(92) + 'r]')})"
    cut = df.selectExpr(f"* EXCEPT ({text})", f"{lines} AS lines")
    return cut.selectExpr(
        "* EXCEPT (lines)", "size(lines) AS line_count",
        f"if(size(lines) > {offset}, array_join(slice(lines, {offset + 1}, {limit}), '\\n'), NULL) AS content",
    )


def folder_rollup(files: DataFrame) -> DataFrame:
    """Tree of (path, size): one row per folder with its files, bytes and direct children."""
    parts = "split(path, '/')"
    levels = files.selectExpr(
        "size",
        f"explode(transform(sequence(0, size({parts}) - 1), i -> named_struct("
        f"'folder', array_join(slice({parts}, 1, i), '/'), 'child', {parts}[i], 'leaf', i = size({parts}) - 1))) AS e",
    ).selectExpr("e.folder", "e.child", "e.leaf", "size")
    # children are combined first, so the root folder never sees one row per file
    children = levels.groupBy("folder", "child", "leaf").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
    return children.groupBy("folder").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
        F.expr("count_if(NOT leaf) AS folders_inside"), F.expr("count_if(leaf) AS files_inside"),
    )


def hide_deleted(files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drops paths that equal a deleted path or lie under one: an equi-join on path prefixes."""
    dead = tombstones.selectExpr("trim('/', replace(path, '\\\\', '/')) AS dead").where("dead <> ''").distinct()
    clean = "split(trim('/', replace(path, '\\\\', '/')), '/')"
    hit = (
        files.selectExpr("path", f"explode(transform(sequence(1, size({clean})), i -> array_join(slice({clean}, 1, i), '/'))) AS dead")
        .join(dead, "dead", "left_semi").select("path").distinct()
    )
    return files.join(hit, "path", "left_anti")


TABLE_ROOT = r"^(.*?[.](?:parquet|csv|tsv|jsonl|ndjson))(?:/.*)?$"


def read_folder(spark: SparkSession, folder: str, files: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: rows}, documents) of a folder and its inventory. A table is a file, or a folder named like one.

    Tables in text formats bring their row numbers along (`__row`). documents: (path, line_no, text), one row a line.
    Names of tables reach the driver, names of files don't.
    """
    roots = files.selectExpr(f"lower(regexp_extract(path, {raw('(?i)' + TABLE_ROOT)}, 1)) AS folded", f"regexp_extract(path, {raw('(?i)' + TABLE_ROOT)}, 1) AS root")
    tables = {}
    for row in roots.where("root <> ''").groupBy("root").agg(F.first("folded").alias("folded")).orderBy("root").collect():
        path, kind = f"{folder.rstrip('/')}/{row['root']}", row["folded"].rsplit(".", 1)[1]
        if kind == "parquet":
            tables[row["root"]] = spark.read.parquet(path)
        elif kind in ("csv", "tsv"):
            tables[row["root"]] = scan_delimited(spark, path)
        else:
            tables[row["root"]] = read_json_lines(spark, path).withColumnRenamed("row_no", "__row")
    names = "{" + ",".join("*" + e for e in TEXT) + "}"
    root = folder if ":" in folder else "file:" + folder
    if files.where(f"extension IN ({quoted(TEXT)})").isEmpty():
        documents = spark.createDataFrame([], "path string, line_no long, text string")
    else:
        lines = numbered_lines(spark, folder, pattern=names)
        documents = lines.selectExpr(f"ltrim('/', replace(path, {quoted([root.rstrip('/')])}, '')) AS path", "line_no", "value AS text")
    return tables, documents
