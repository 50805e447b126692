"""Numbered lines of text files, and cards that speak of two files."""

from __future__ import annotations

import hashlib

from linkweave.operators import cards as C
from linkweave.operators import claims as V
from linkweave.sources import files as X


def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path):
    lines = [f"line {n} " + "x" * (n % 37) for n in range(1, 500)]
    path = tmp_path / "lines.txt"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        numbered = X.numbered_lines(spark, str(path))
        rows = sorted((r["row_no"], r["value"]) for r in numbered.collect())
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(enumerate(lines, 1))


def test_an_empty_file_has_no_lines(spark, tmp_path):
    path = tmp_path / "none.txt"
    path.write_text("")
    assert X.numbered_lines(spark, str(path)).count() == 0


def test_a_field_card_is_found_by_both_files(spark):
    pairs = spark.sql(
        "SELECT 'a.csv' AS source, 'b.csv' AS target, 1L AS correspondences, 0.9D AS files_confidence, 2L AS files_evidence,"
        " 1 AS rank, 'x' AS source_column, 'y' AS target_column, 'same_header' AS alignment, 0.9D AS confidence, 2L AS evidence_count"
    )
    cards = C.field_cards(pairs)
    for file in ("a.csv", "b.csv"):
        assert C.evidence_page(cards, 0, 5, file=file).count() == 1
    assert C.evidence_page(cards, 0, 5, file="c.csv").count() == 0


def test_an_included_file_is_used_by_a_card_of_two_files(spark):
    def frame(text):
        return spark.sql(text)

    none = "SELECT 1L AS graph_id, 'n' AS id, 'object' AS type, 'name' AS name, array('E-1') AS evidence_ids"
    claims = V.Claims(
        graphs=frame("SELECT 1L AS graph_id, 'g' AS name, 'p' AS purpose"), nodes=frame(none),
        edges=frame("SELECT 1L AS graph_id, 'e' AS id, 'n' AS source, 'n' AS target, 'feeds' AS type, 0.5D AS confidence, array('E-1') AS evidence_ids"),
        chain=frame("SELECT 1L AS graph_id, 0 AS pos, 'n' AS node"),
        branches=frame("SELECT 1L AS graph_id, 0 AS pos, 'b' AS id, 'n' AS origin, array('n') AS path, array('E-1') AS evidence_ids"),
        coverage=frame("SELECT 1L AS graph_id, explode(array('a.csv', 'b.csv')) AS file, true AS included, '' AS reason, array() AS evidence_ids").selectExpr(
            "graph_id", "file", "included", "reason", "cast(evidence_ids AS array<string>) AS evidence_ids"),
        inventory=frame("SELECT 1L AS graph_id, explode(array('a.csv', 'b.csv')) AS file"),
        cards=frame("SELECT 'E-1' AS id, 'field_relationship' AS kind, 'direct' AS strength, 'a.csv' AS file, '' AS snippet, array('a.csv', 'b.csv') AS files"),
    )
    assert V.coverage_rules(claims).count() == 0
    alone = V.coverage_rules(V.replace(claims, cards=claims.cards.drop("files"))).collect()
    assert [(r["rule"], r["subject"]) for r in alone] == [("included_file_unused", "b.csv")]


def test_both_ways_of_hashing_agree(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"f{k % 2}" / f"{k}.txt").write_bytes(bytes(range(k * 7 + 1)) * 1000)
    want = {f"f{k % 2}/{k}.txt": hashlib.sha256(bytes(range(k * 7 + 1)) * 1000).hexdigest() for k in range(5)}
    for limit in (1 << 20, 10_000, -1):
        got = {r["path"]: r["sha256"] for r in X.inventory(spark, str(tmp_path), limit).collect()}
        assert got == want
