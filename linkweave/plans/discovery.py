"""Discovery: which columns of which tables hold the same values, and how the files hang together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.config import HeaderRules, Limits, ValueRules
from linkweave.functions.headers import compatibility_groups
from linkweave.functions.text import fingerprint, normalize_value, quote, when
from linkweave.functions.values import describe_entities, text_entities
from linkweave.operators import links as L
from linkweave.operators.occurrences import ROW, describe_values, distinct_values, file_rows, occurrences, table_occurrences, with_file_ordinals
from linkweave.operators.ordered import numbered
from linkweave.operators.scan import Scan, scan_seed_table, scan_table, seed_hashes
from linkweave.operators.sketches import bottom_k, cardinality, sampled_bottom_k
from linkweave.plans.store import Store, digest, table_signatures
from linkweave.session import cut_lineage, spread
from linkweave.sources.catalog import join_columns, role_score, schema_catalog, seed_tables
from linkweave.sources.files import file_name, inventory, read_folder


@dataclass(frozen=True)
class Rules:
    headers: HeaderRules = HeaderRules()
    values: ValueRules = ValueRules()
    limits: Limits = Limits()


def scan(spark: SparkSession, tables: dict[str, DataFrame], rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(catalog, cells): cells of the join columns only; tables without one are never read."""
    catalog = schema_catalog(spark, tables, rules.headers)
    columns = join_columns(catalog)
    return catalog, occurrences({t: tables[t] for t in columns}, columns, rules.values)


def profiles(catalog: DataFrame, cells: DataFrame, rules: Rules, large: bool = False) -> DataFrame:
    """Bottom-k samples of every scanned column, described. `large` prefilters by estimated cutoffs."""
    k = rules.limits.profile_size
    sample = sampled_bottom_k(cells, cardinality(cells), k) if large else bottom_k(distinct_values(cells), k)
    # k rows per column at most, read twice by the overlap join: written once, so the tables are scanned once
    return cut_lineage(describe_values(sample, catalog))


CUTOFF_STRIDE = 256
"""Every so many rows tell which fingerprints of a column can't be among its smallest."""


def sampled_columns(spark: SparkSession, tables: dict[str, DataFrame], rules: Rules) -> DataFrame:
    """The samples of `profiles`, from a pass over each table that drops what no sample can hold where it reads it.

    The k-th smallest fingerprint of some rows is at least the k-th smallest of all, so it is a cutoff that loses nothing, whatever
    the rows; columns with fewer values in those rows have none. Only values below it are combined and shuffled.
    """
    catalog, k = cut_lineage(schema_catalog(spark, tables, rules.headers), "catalog"), rules.limits.profile_size
    columns = join_columns(catalog)
    sample = spark.createDataFrame([], "table string, column string, value string, row_no long, fingerprint string")
    if columns:  # all tables in one job each time
        def cells(df: DataFrame, t: str) -> DataFrame:
            return table_occurrences(df, t, columns[t], rules.values, ("__file",) if "__file" in df.columns else ())

        narrow = {}
        for t, own in sorted(columns.items()):
            rows = file_rows(tables[t])
            narrow[t] = rows.select("row_no", *[c for c, _ in own], *[c for c in rows.columns if c == "__file"])
        some = _union([cells(df.where(F.col("row_no") % CUTOFF_STRIDE == 0), t).select("table", "column", "value") for t, df in narrow.items()])
        least = bottom_k(some.distinct().selectExpr("*", f"{fingerprint('value')} AS fingerprint"), k)
        ends = least.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"), F.max("fingerprint").alias("cutoff")).where(F.col("n") == k)
        cutoffs = {(r["table"], r["column"]): r["cutoff"] for r in ends.collect()}  # one row a column
        near = []
        for t, df in narrow.items():
            known = [(f"column = {quote(c)}", f"{fingerprint('value')} <= '{cutoffs[t, c]}'") for c, _ in columns[t] if (t, c) in cutoffs]
            found = cells(spread(df), t)
            # rows get the numbers of their files when most are gone
            near.append(with_file_ordinals(found.where(when(*known, otherwise="true")) if known else found, tables[t]))
        first = _union(near).groupBy("table", "column", "value").agg(F.min("row_no").alias("row_no"))
        sample = bottom_k(first.selectExpr("*", f"{fingerprint('value')} AS fingerprint"), k)
    return cut_lineage(describe_values(sample, catalog))


def profile_evidence(spark: SparkSession, tables: dict[str, DataFrame], rules: Rules = Rules()) -> DataFrame:
    """Evidence rows of links between column samples."""
    return L.evidence_rows(L.profile_links(sampled_columns(spark, tables, rules), rules.limits))


def profile_relations(spark: SparkSession, tables: dict[str, DataFrame], rules: Rules = Rules()) -> DataFrame:
    """Relations between columns whose bounded samples overlap."""
    return L.relations(profile_evidence(spark, tables, rules), rules.limits)


# The directed probe -------------------------------------------------------------------------------


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count, column_count, size, role_score) from the footers and the listing of the files.

    Rows of a table in a text format are not known before it is read: NULL.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = None
    for name, df in sorted(tables.items()):
        text = ROW in df.columns
        files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.max("_metadata.file_size").alias("size"), (F.lit(None).cast("long") if text else F.count(F.lit(1))).alias("rows")
        ) if not text else file_sizes(df).withColumn("rows", F.lit(None).cast("long"))
        width = len([c for c in df.columns if c != ROW])
        one = files.agg(F.sum("rows").alias("row_count"), F.sum("size").alias("size")).selectExpr(
            f"{quote(name)} AS table", f"if({text}, NULL, coalesce(row_count, 0)) AS row_count", f"{width} AS column_count", "coalesce(size, 0) AS size"
        )
        parts = one if parts is None else parts.unionAll(one)
    scored = parts.selectExpr("*", f"{role_score('table')} AS role_score")
    return spark.createDataFrame(scored.collect(), scored.schema)  # one row per table


def file_sizes(df: DataFrame) -> DataFrame:
    """(file, size) of the files a frame is read from, from their listing."""
    return df.sparkSession.read.format("binaryFile").load(df.inputFiles()).select(F.col("path").alias("file"), F.col("length").alias("size"))


def table_bytes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, size): bytes of the files a table is read from."""
    sizes = None
    for name, df in sorted(tables.items()):
        one = file_sizes(df).agg(F.sum("size").alias("size")).selectExpr(f"{quote(name)} AS table", "size")
        sizes = one if sizes is None else sizes.unionAll(one)
    return sizes


SEED = ("fingerprint", "table", "column", "key", "kind", "base", "locator", "preview", "specificity")


def column_seeds(values: DataFrame, catalog: DataFrame, places: DataFrame) -> DataFrame:
    """Sampled values of columns as seeds; `ord` has them by place of the table, before its text, by column and fingerprint."""
    return describe_values(values, catalog).join(F.broadcast(places), "table").selectExpr(
        *SEED, "probe_key", "table AS file", "format_string('%06d/0/%04d/%s', place, position, fingerprint) AS ord"
    )


def text_seeds(found: DataFrame, places: DataFrame, rules: Rules) -> DataFrame:
    """Entities (table, column, source_kind, row_no, value, locator) as seeds, bounded for each table.

    A value that stands under several labels or rows counts where it stands first.
    """
    described = describe_entities(found.withColumnRenamed("column", "label"), rules.headers).withColumnRenamed("label", "column")
    row = F.struct(*[c for c in described.columns if c not in ("table", "fingerprint")])
    first = described.groupBy("table", "fingerprint").agg(F.min_by(row, F.struct("row_no", "column", "kind")).alias("r")).select("table", "fingerprint", "r.*")
    return bottom_k(first, rules.limits.max_text_seeds, by=("table",)).join(F.broadcast(places), "table").selectExpr(
        *SEED, "xxhash64(value) AS probe_key", "table AS file", "format_string('%06d/1/0000/%s', place, fingerprint) AS ord"
    )


def document_entities(documents: DataFrame) -> DataFrame:
    """(table, column, source_kind, row_no, value, locator): the first line of each entity of each document (path, line_no, text)."""
    found = spread(documents).selectExpr("path AS table", "line_no AS row_no", f"inline({text_entities('text')})")
    return found.groupBy("table", F.col("label").alias("column"), "source_kind", "value").agg(F.min("row_no").alias("row_no")).selectExpr(
        "*", "concat('line:', row_no) AS locator"
    )


def next_table(catalog: DataFrame, seeds: DataFrame, open_tables: DataFrame) -> str:
    """Open table whose columns agree best with the seeds' kinds and bases; the smallest wins ties."""
    known = seeds.selectExpr("'' AS key", "kind", "base").distinct().selectExpr(f"inline({compatibility_groups()})").select("label").distinct()
    labels = L.compatible_groups(catalog).where("label NOT LIKE 'header:%'")
    scores = labels.join(known, "label").groupBy("table").agg(F.max("score").alias("score"))
    ranked = open_tables.join(scores, "table", "left").selectExpr("*", "coalesce(score, 0) AS fit")
    return ranked.orderBy(F.desc("fit"), "cells", "table").first()["table"]


LINK = tuple(f"{p}_{c}" for p in ("s", "t") for c in ("file", "column", "locator", "preview", "specificity")) + (
    "fingerprint", "type", "confidence", "verdict", "evidence_kind", "note", "seq",
)

SEED_JOBS = 8
"""Passes over small tables that run at a time."""

STATS = "table string, mode string, rows_scanned long, row_count long, candidate_columns int, matches long, frontier_values long"


def _link(s: str, t: str, column: tuple[str, str], locator: tuple[str, str], preview: tuple[str, str], fingerprint: str, rest: dict[str, str]) -> list[str]:
    """Expressions of a link between two files as such."""
    ends = zip(("s", "t"), (s, t), column, locator, preview, strict=True)
    sides = [f"{x} AS {p}_{n}" for p, f, c, at, view in ends for n, x in (("file", f), ("column", quote(c)), ("locator", at), ("preview", view), ("specificity", "3"))]
    return [*sides, f"{fingerprint} AS fingerprint", *(f"{x} AS {n}" for n, x in rest.items())]


def file_links(files: DataFrame | None, documents: DataFrame | None) -> list[DataFrame]:
    """Links between whole files: equal contents (files: path, sha256), and documents (path, line_no, text) that name another file."""
    if files is None:
        return []
    digest = "concat(left(fingerprint, 16), '...')"
    same = L.duplicate_links(files).selectExpr(*_link(
        "source", "target", ("whole-file", "whole-file"), ("'whole-file'", "'whole-file'"), (digest, digest), "fingerprint",
        {"type": "type", "confidence": "confidence", "verdict": "verdict", "evidence_kind": "'sha256'", "note": quote(DUPLICATE_NOTE), "seq": "concat('00/', source, target)"},
    ))
    if documents is None:
        return [same]
    names = files.selectExpr("path", f"{file_name('path')} AS file_name")
    texts = documents.selectExpr("path", "concat('line:', line_no) AS locator", "text")
    name = file_name("target")
    named = L.explicit_references(texts, names).selectExpr(*_link(
        "source", "target", ("file-reference", "file-name"), ("locator", "'file-name'"), (name, name), f"sha2({normalize_value('target')}, 256)",
        {"type": "type", "confidence": "confidence", "verdict": "verdict", "evidence_kind": "'explicit_file_reference'", "note": quote(REFERENCE_NOTE), "seq": "concat('0/9/', source, locator)"},
    ))
    return [same, named]


# Explanations that links between files carry.
DUPLICATE_NOTE = "Complete file SHA-256 digests are identical."
REFERENCE_NOTE = "The source text explicitly names the target file."


def discover(
    spark: SparkSession, tables: dict[str, DataFrame], rules: Rules = Rules(), documents: DataFrame | None = None,
    files: DataFrame | None = None, store: Store | None = None, most_probes: int | None = None,
) -> dict[str, DataFrame]:
    """Whole discovery: seeds from small tables and documents, directed probes of the rest, sample overlaps, links of whole files.

    Every table is read once: a pass leaves counts, sketches, samples and the rows that may match (operators/scan.py), and all
    else comes from those. Passes are kept in `store`, under a digest of the table's files, the rules and the seeds, so that a further run
    reads only what has changed. documents: (path, line_no, text); files: (path, sha256). With `most_probes` the run
    stops after so many probes; its coverage says so, and the next run with the same store goes on from there.

    The driver loops over tables, never over rows. Evidence is ordered by stage, table, row and column.
    """
    limits, store = rules.limits, store or Store(spark)
    signatures = table_signatures(tables) if store.folder else {}
    settings = repr((rules.values, rules.headers, limits))
    catalog = cut_lineage(schema_catalog(spark, tables, rules.headers))
    columns = join_columns(catalog)
    sizes = store.keep("sizes", digest(sorted(signatures.items())), lambda: table_sizes(tables).coalesce(1))
    known = {r["table"]: r for r in sizes.collect()}
    chosen = seed_tables(sizes, limits).collect()
    order = {r["table"]: r["seed_order"] for r in chosen}
    partly = {r["table"] for r in chosen if r["bootstrap"]}
    stats: list[tuple] = []

    # seeds: one pass a table, all of its columns
    columns_of = {t: columns.get(t, []) for t in order}

    def seed_pass(t: str) -> DataFrame:
        return store.keep(f"seed/{t}", digest(signatures.get(t), settings), lambda: scan_seed_table(tables[t], columns_of[t], rules.values))

    small = [t for t in order if t not in partly]
    with ThreadPoolExecutor(SEED_JOBS) as jobs:  # small tables: their jobs share the executors
        kept = dict(zip(small, jobs.map(seed_pass, small), strict=True))
    values = _union([df.withColumn("table", F.lit(t)) for t, df in kept.items()]) if kept else None
    places = spark.createDataFrame([*order.items()], "table string, place int")
    candidates, samples = [], []
    if values is not None:
        cells = values.where("what = 'cell'").selectExpr("table", "column", "value", "row_no", "n AS cells", f"{fingerprint('value')} AS fingerprint")
        samples.append(bottom_k(cells, limits.profile_size).drop("cells"))
        candidates.append(column_seeds(bottom_k(cells, limits.seed_values_per_column), catalog, places))
        texts = values.where("what = 'text'").selectExpr("table", "column", "source_kind", "row_no", "value", "concat('table:', table, ';row:', row_no) AS locator")
        candidates.append(text_seeds(texts, places, rules))
        read = values.where("what = 'rows'").groupBy("table").agg(F.sum("n").alias("n"))
        counted = {r["table"]: r["n"] for r in read.collect()}
        stats += [(t, "complete_seed", counted.get(t, 0), known[t]["row_count"], len(columns_of[t]), 0, 0) for t in kept]
    for t in sorted(partly & set(columns)):
        first = Scan(t, store.keep(f"first/{t}", digest(signatures.get(t), settings), lambda t=t: scan_table(
            tables[t], columns[t], rules.values, limits, limits.seed_values_per_column, None, limits.bootstrap_rows)))
        candidates.append(column_seeds(first.sample(limits.seed_values_per_column), catalog, places))
    if documents is not None:
        found = cut_lineage(document_entities(documents), "entities")
        after = numbered(found.select("table").distinct(), [F.col("table").asc()], "place").withColumn("place", F.col("place") + len(order) + 1)
        candidates.append(text_seeds(found, after, rules))
    fresh = cut_lineage(_union(candidates)) if candidates else spark.createDataFrame([], SEEDS)
    seeds = cut_lineage(L.seed_index(fresh, limits))
    links = file_links(files, documents)
    links.append(L.seed_seed_links(seeds, fresh, limits).withColumn("seq", F.concat(F.lit("0/"), "seq")))

    # probes: one pass a table, join columns only
    remaining = {t: (r["row_count"] or 0) * r["column_count"] or r["size"] for t, r in known.items() if t not in kept}
    stats += [(t, "schema_only", 0, known[t]["row_count"], 0, 0, 0) for t in remaining if t not in columns]
    remaining = {t: n for t, n in remaining.items() if t in columns}
    steps = 0
    while remaining and (most_probes is None or steps < most_probes):
        steps += 1
        table = next_table(catalog, seeds, spark.createDataFrame(list(remaining.items()), "table string, cells long")) if len(remaining) > 1 else next(iter(remaining))
        remaining.pop(table)
        hashes = seed_hashes(seeds, table)
        key = digest(signatures.get(table), settings, hashes.tobytes())
        scan = Scan(table, store.keep(f"probe/{table}", key, lambda t=table, h=hashes: scan_table(tables[t], columns[t], rules.values, limits, None, h)))
        samples.append(scan.sample(limits.profile_size))
        matches = cut_lineage(L.probe_seeds(scan.cells(), catalog, seeds, limits))
        scan_order = f"format_string('1/%06d/%020d/%06d', {steps}, row_no, position)"
        links.append(matches.withColumn("seq", F.expr(scan_order)))
        edge = cut_lineage(L.frontier(scan.cells(), matches, limits.frontier_values_per_column))
        if remaining:
            opened = spark.createDataFrame([(t,) for t in remaining], "table string")
            near = catalog.where(F.col("table").isin(table, *remaining))
            wanted = L.expandable_columns(near, opened, scan.cardinality(), limits)
            more = describe_values(edge.join(wanted.select("table", "column"), ["table", "column"], "left_semi"), catalog).selectExpr(
                *SEED, "probe_key", "table AS file", f"format_string('9%05d/0/%04d/%s', {steps}, position, fingerprint) AS ord"
            )
            seeds = cut_lineage(L.seed_index(seeds.unionByName(more), limits))
        done = scan.rows().withColumns({
            "matches": matches.agg(F.count(F.lit(1))).scalar(), "frontier": edge.agg(F.count(F.lit(1))).scalar()
        }).first()
        stats.append((table, "directed_probe", done["rows"] if done else 0, known[table]["row_count"], len(columns[table]), done["matches"] if done else 0, done["frontier"] if done else 0))
    stats += [(t, "open", 0, known[t]["row_count"], len(columns[t]), 0, 0) for t in remaining]
    empty = spark.createDataFrame([], "table string, column string, value string, row_no long, fingerprint string")
    profile_rows = cut_lineage(describe_values(_union(samples or [empty]), catalog))
    links.append(L.profile_links(profile_rows, limits).withColumn("seq", F.concat(F.lit("2/"), F.lpad(F.col("seq").cast("string"), 20, "0"))))
    evidence = cut_lineage(L.evidence_rows(_union([x.select(*LINK) for x in links])), "evidence")
    told = spark.createDataFrame(stats, STATS)
    return {
        "catalog": catalog, "seeds": seeds, "profiles": profile_rows, "evidence": evidence,
        "relations": L.relations(evidence, limits), "stats": told, "coverage": tables_covered(told),
    }


def discover_folder(
    spark: SparkSession, folder: str, rules: Rules = Rules(), store: Store | None = None, most_probes: int | None = None
) -> dict[str, DataFrame]:
    """Discovery over all files of a folder: tables as Parquet, CSV, TSV and JSON lines, and text documents."""
    files = cut_lineage(inventory(spark, folder), "inventory")
    tables, documents = read_folder(spark, folder, files)
    return discover(spark, tables, rules, documents, files, store, most_probes) | {"files": files}


SEEDS = (
    "fingerprint string, table string, column string, key string, kind string, base string, locator string, preview string,"
    " specificity int, probe_key long, file string, ord string"
)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def tables_covered(stats: DataFrame) -> DataFrame:
    """What was read of the tables of a run. Of the readable ones, those with a join column, the ones are completed of which all
    rows they are known to have were read; `status` is partial while some are not."""
    whole = "candidate_columns > 0 AND mode <> 'open' AND rows_scanned >= coalesce(row_count, 0)"
    return stats.agg(
        F.count(F.lit(1)).alias("tables"), F.expr(f"count_if({whole}) AS completed"), F.expr("count_if(candidate_columns > 0) AS readable"),
        F.expr("count_if(mode = 'directed_probe') AS probe_steps"), F.expr("coalesce(sum(rows_scanned), 0) AS rows_scanned"),
        F.expr("coalesce(sum(matches), 0) AS matches"), F.expr("coalesce(sum(frontier_values), 0) AS frontier_values"),
    ).selectExpr("*", "if(completed = readable, 'complete', 'partial') AS status")


def coverage(result: dict[str, DataFrame]) -> DataFrame:
    """How much a discovery covered: tables by what was read of them, seeds, sampled values, relations by verdict."""
    found = result["relations"]
    return result["coverage"].withColumns({
        "seed_values": result["seeds"].agg(F.expr("count(DISTINCT fingerprint)")).scalar(),
        "profile_values": result["profiles"].agg(F.count(F.lit(1))).scalar(),
        "relations": found.agg(F.count(F.lit(1))).scalar(),
        "confirmed": found.agg(F.expr("count_if(verdict = 'confirmed')")).scalar(),
    })
