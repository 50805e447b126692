"""Discovery end to end: one pass a table, mixed folders, resumed runs."""

import shutil

import pytest
from pyspark.sql import functions as F

from linkweave.config import Limits
from linkweave.operators import links as L
from linkweave.operators.occurrences import describe_values, distinct_values, occurrences, with_row_number
from linkweave.operators.scan import Scan, scan_table, seed_hashes
from linkweave.operators.sketches import bottom_k, cardinality
from linkweave.plans import discovery as D
from linkweave.plans.queries_discovery import RULES
from linkweave.plans.store import Store
from linkweave.plans.tables import read_table, read_tables
from linkweave.session import cut_lineage
from linkweave.sources.catalog import join_columns, schema_catalog


def rows(df):
    return sorted(map(str, df.collect()))


def same_columns(df, other):
    return rows(df.select(*other.columns)) == rows(other)


@pytest.fixture(scope="module")
def many_files(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "lineitem")
    read_table(spark, folder, "lineitem").repartition(5, "l_partkey").write.parquet(path)
    return spark.read.parquet(path)


def test_one_pass_finds_what_separate_passes_find(spark, folder, many_files):
    limits = Limits(max_matches_per_seed=3)
    tables = {"lineitem": many_files, "part": read_table(spark, folder, "part"), "orders": read_table(spark, folder, "orders")}
    catalog = schema_catalog(spark, tables, RULES.headers)
    columns = join_columns(catalog)
    few = occurrences(tables, {t: columns[t] for t in ("part", "orders")}, RULES.values)
    sample = describe_values(bottom_k(distinct_values(few), 40), catalog).withColumn("file", F.col("table"))
    seeds = cut_lineage(L.seed_index(sample.withColumn("ord", F.concat("table", "fingerprint")), limits))
    cells = cut_lineage(occurrences({"lineitem": many_files}, {"lineitem": columns["lineitem"]}, RULES.values))
    entries = scan_table(many_files, columns["lineitem"], RULES.values, limits, 50, seed_hashes(seeds, "lineitem"))
    scan = Scan("lineitem", cut_lineage(entries))

    assert same_columns(scan.sample(50), bottom_k(distinct_values(cells), 50).drop("cells"))
    wanted = L.probe_seeds(cells, catalog, seeds, limits)
    found = L.probe_seeds(scan.cells(), catalog, seeds, limits)
    assert wanted.count() > 100 and rows(found) == rows(wanted.select(*found.columns))
    assert same_columns(L.frontier(scan.cells(), found, 20).drop("cells"), L.frontier(cells, wanted, 20).drop("cells"))
    assert scan.cells().count() < cells.count() and scan.rows().first()["rows"] == many_files.count()
    exact = {r["column"]: r for r in cardinality(cells, exact=True).collect()}
    for r in scan.cardinality().collect():
        assert r["nonempty"] == exact[r["column"]]["nonempty"] and abs(r["distinct"] / exact[r["column"]]["distinct"] - 1) < 0.26


def test_a_pass_over_nothing(spark, folder):
    empty = read_table(spark, folder, "orders")
    scan = Scan("orders", cut_lineage(scan_table(empty.where("false"), [("o_custkey", "id")], RULES.values)))
    assert scan.sample(5).count() == scan.cells().count() == scan.cardinality().count() == 0


def test_every_table_is_read_once(spark, folder):
    store = Store(spark)
    tables = read_tables(spark, folder)
    result = D.discover(spark, tables, D.Rules(RULES.headers, RULES.values, Limits(seed_cell_budget=1_000)), store=store)
    assert sorted(n.split("/")[1] for n in store.made if "/" in n) == sorted(tables)
    stats = {r["table"]: r for r in result["stats"].collect()}
    assert stats["lineitem"]["mode"] == "directed_probe" and stats["lineitem"]["rows_scanned"] == tables["lineitem"].count()
    assert stats["lineitem"]["matches"] > 0 and stats["nation"]["mode"] == "complete_seed"
    covered = D.coverage(result).first()
    assert covered["tables"] == covered["completed"] == 14 and covered["status"] == "complete"
    assert covered["rows_scanned"] == sum(df.count() for df in tables.values())


def test_a_large_folder_starts_from_first_rows(spark, folder):
    """Where every table is above the budgets, the smallest one lends its first rows as seeds and is probed later."""
    tables = read_tables(spark, folder, ("orders", "lineitem", "customer"))
    limits = Limits(seed_cell_budget=10, seed_file_bytes=10, bootstrap_rows=20)
    result = D.discover(spark, tables, D.Rules(RULES.headers, RULES.values, limits))
    stats = {r["table"]: r["mode"] for r in result["stats"].collect()}
    assert set(stats.values()) == {"directed_probe"}
    first = result["seeds"].where("ord < '9'").agg(F.max(F.expr("int(regexp_extract(locator, 'row:([0-9]+)', 1))"))).first()[0]
    assert first <= 20 and {"customer", "lineitem"} <= {r["source"] for r in result["relations"].collect()}


@pytest.fixture(scope="module")
def mixed(spark, folder, tmp_path_factory):
    """The same text tables as Parquet files and as files of four formats, with two documents and a copy."""
    plain, mixed = (tmp_path_factory.mktemp(n) for n in ("plain", "mixed"))
    kinds = {"customer": "csv", "nation": "tsv", "supplier": "jsonl", "orders": "parquet", "part": "csv", "labels": "ndjson", "region": "parquet"}
    for name, kind in kinds.items():
        df = read_table(spark, folder, name)
        df = df.select(*[F.col(c).cast("string") for c in df.columns]).coalesce(1)
        df.write.parquet(str(plain / f"{name}.{kind}"))
        df = spark.read.parquet(str(plain / f"{name}.{kind}"))
        target = str(mixed / f"{name}.{kind}")
        if kind == "parquet":
            df.write.parquet(target)
        elif kind in ("csv", "tsv"):
            df.write.option("header", True).option("sep", ";" if kind == "csv" else "\t").option("lineSep", "\n").csv(target)
        else:
            df.write.json(target)
    (mixed / "docs").mkdir()
    (mixed / "docs" / "notes.txt").write_text("first line\nsee Rates.txt and mail ann@shop.example\n")
    (mixed / "docs" / "rates.txt").write_text("Contact: ann@shop.example\n")
    shutil.copy(mixed / "docs" / "rates.txt", mixed / "docs" / "copy.txt")
    return plain, mixed, kinds


def test_a_mixed_folder_gives_the_relations_of_its_tables(spark, mixed):
    plain, folder, kinds = mixed
    tables = {f"{n}.{k}": spark.read.parquet(str(plain / f"{n}.{k}")) for n, k in kinds.items()}
    rules = D.Rules(RULES.headers, RULES.values, Limits(seed_cell_budget=2_000, seed_file_bytes=6_000))
    got = D.discover_folder(spark, str(folder), rules)
    of_tables = got["profiles"].where("NOT table LIKE 'docs/%'").drop("rank")
    want = D.profiles(*D.scan(spark, tables, rules), rules)
    assert rows(of_tables.select(*[c for c in want.columns if c != "cells"])) == rows(want.drop("cells"))
    overlap = L.relations(D.profile_evidence(spark, tables, rules), rules.limits)
    found = got["relations"].where("type = 'profiled_value_overlap'")
    assert overlap.count() > 5 and rows(found) == rows(overlap)
    links = {(r["source"], r["target"], r["type"]) for r in got["relations"].where("source LIKE 'docs/%' OR target LIKE 'docs/%'").collect()}
    assert {("docs/copy.txt", "docs/rates.txt", "exact_duplicate"), ("docs/notes.txt", "docs/rates.txt", "explicit_reference"), ("docs/notes.txt", "docs/rates.txt", "seeded_value_link")} <= links
    evidence = {r["type"]: r for r in got["evidence"].where("source_file = 'docs/notes.txt' AND target_file = 'docs/rates.txt'").collect()}
    assert evidence["explicit_reference"]["source_locator"] == "line:2" and evidence["seeded_value_link"]["target_locator"] == "line:1"


def test_a_second_run_reads_nothing_and_a_changed_table_alone(spark, mixed, tmp_path):
    plain, _, kinds = mixed
    here = tmp_path / "data"
    shutil.copytree(plain, here)

    def tables():
        return {n: spark.read.parquet(str(here / f"{n}.{k}")) for n, k in kinds.items()}

    rules = D.Rules(RULES.headers, RULES.values, Limits(seed_cell_budget=2_000))
    kept = str(tmp_path / "kept")
    first = Store(spark, kept)
    relations = rows(D.discover(spark, tables(), rules, store=first)["relations"])
    again = Store(spark, kept)
    assert rows(D.discover(spark, tables(), rules, store=again)["relations"]) == relations
    assert again.made == [] and sorted(again.found) == sorted(first.made)
    fewer = spark.read.parquet(str(here / "nation.tsv")).where("n_nationkey > 3").toArrow()
    shutil.rmtree(here / "nation.tsv")
    spark.createDataFrame(fewer).coalesce(1).write.parquet(str(here / "nation.tsv"))
    after = Store(spark, kept)
    changed = rows(D.discover(spark, tables(), rules, store=after)["relations"])
    assert changed == rows(D.discover(spark, tables(), rules)["relations"]) != relations
    assert "seed/nation" in after.made and {f"seed/{t}" for t in ("region", "supplier", "labels", "part") if f"seed/{t}" in first.made} <= set(after.found)


def test_a_stopped_run_goes_on(spark, folder, tmp_path):
    tables = read_tables(spark, folder, ("nation", "supplier", "customer", "orders", "lineitem"))
    rules = D.Rules(RULES.headers, RULES.values, Limits(seed_cell_budget=500))
    whole = Store(spark, str(tmp_path / "kept"))
    part = D.discover(spark, tables, rules, store=whole, most_probes=1)
    covered = D.coverage(part).first()
    assert covered["status"] == "partial" and covered["completed"] < covered["tables"] and covered["probe_steps"] == 1
    rest = Store(spark, str(tmp_path / "kept"))
    full = D.discover(spark, tables, rules, store=rest)
    assert D.coverage(full).first()["status"] == "complete" and sum(n.startswith("probe/") for n in rest.found) == 1
    assert rows(full["relations"]) == rows(D.discover(spark, tables, rules)["relations"])


def test_files_of_a_table_are_numbered_without_a_list(spark, many_files):
    from linkweave.operators.occurrences import FILE_STRIDE, with_row_number

    numbers = [r["row_no"] for r in with_row_number(many_files).select("row_no").collect()]
    assert len(set(numbers)) == many_files.count() and {n // FILE_STRIDE for n in numbers} == set(range(5))


def test_samples_of_one_pass_equal_those_of_all_values(spark):
    """The samples that relations of profiles come from: those of all distinct values, though none of these is shuffled."""
    tables = read_tables(spark, "/root/testdata/sf0.001")
    columns = ["table", "column", "fingerprint", "row_no", "locator", "preview", "specificity", "probe_key"]
    got = D.sampled_columns(spark, tables, RULES).select(*columns)
    want = D.profiles(*D.scan(spark, tables, RULES), RULES).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 500
    assert D.sampled_columns(spark, {"region": tables["region"].select("r_name").withColumnRenamed("r_name", "amount")}, RULES).count() == 0


def test_numbering_many_files_leaves_the_table_where_it_is(spark, tmp_path):
    """The numbers of files go to the rows; a table of many small files is not sent to the one task that holds those numbers."""
    spark.range(4000).repartition(40).write.parquet(str(tmp_path / "t"))
    numbered = with_row_number(spark.read.parquet(str(tmp_path / "t")))
    hinted = numbered._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)")
    assert hinted == 2  # the rows of a file, and the numbers of files
    assert numbered.select("row_no").distinct().count() == 4000


def test_samples_are_cut_off_where_they_are_read_and_lose_nothing(spark, tmp_path, monkeypatch):
    """The rows that give the cutoffs are no sample of the result: sorted, repeated, sparse and rare values all come out as from all values."""
    rows = spark.range(0, 40_000, 1, 3).selectExpr(
        "id AS a_key", "id % 90 AS b_key", "id DIV 4 AS c_key", "if(id % 256 = 255, 7, id) AS d_key", "if(id % 199 = 1, id, NULL) AS e_key",
    )
    rows.write.parquet(str(tmp_path / "n"))
    spark.range(300).selectExpr("id AS a_key", "concat('Straße ', id) AS p_name").write.parquet(str(tmp_path / "s"))
    tables = {t: spark.read.parquet(str(tmp_path / t)) for t in ("n", "s")}
    columns = ["table", "column", "fingerprint", "row_no", "locator", "preview", "specificity", "probe_key"]
    plans, cut = [], D.cut_lineage
    with monkeypatch.context() as patch:
        patch.setattr(D, "cut_lineage", lambda df, *name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, *name))
        got = D.sampled_columns(spark, tables, RULES).select(*columns)
    want = D.profiles(*D.scan(spark, tables, RULES), RULES).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 700
    assert not any("MapInArrow" in p for p in plans)  # cells of numbers don't pass Python
