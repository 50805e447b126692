"""Cards of whole folders: what tables say counts whatever their size, and one pass over texts finds what the joins find."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from linkweave.operators import cards as C
from linkweave.operators.texts import known_names, scan_texts
from linkweave.plans import queries_text as QT
from linkweave.plans.tables import TABLES

SAID = "If the orders and the lineitem of a customer change, the supplier returns the part before the events."


@pytest.fixture(scope="module")
def large_orders(spark, folder, tmp_path_factory):
    """The tables of sf0.001 with few texts, and orders of more than 100 000 cells whose last row holds a statement."""
    out = tmp_path_factory.mktemp("large")
    for t in TABLES:
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        if t == "orders":
            rows = spark.range(17_000).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "'O' AS o_orderstatus", "1.5D AS o_totalprice")
            dated = rows.selectExpr("*", "timestamp'2020-01-01 00:00:00' AS o_orderdate", f"if(o_orderkey = 16999, '{SAID}', '5-LOW') AS o_orderpriority")
            df = dated.coalesce(1)
        elif t in ("documents", "pages", "conversations", "benchmark"):
            df = df.limit(3).withColumn("html" if t == "pages" else "text", F.lit("No more to say."))
        df.write.parquet(f"{out}/{t}.parquet")
    return str(out)


def test_card_kinds_count_statements_of_large_tables(spark, large_orders):
    kinds = {r["kind"]: r["cards"] for r in entry.queries()["card_kinds"](spark, large_orders).collect()}
    assert kinds["table_relation_statement"] == 1
    few = spark.read.parquet(f"{large_orders}/orders.parquet")
    assert few.count() * len(few.columns) > 100_000


def test_evidence_cards_hold_statements_of_large_tables(spark, large_orders):
    cards = entry.queries()["evidence_cards"](spark, large_orders).where("kind = 'table_relation_statement'").collect()
    assert [(c["file"], c["locator"], c["snippet"]) for c in cards] == [("orders.parquet", "table:orders;row:17000;column:o_orderpriority", SAID)]


def test_synthesis_brief_reads_statements_of_large_tables(spark, large_orders, monkeypatch):
    """Files, schemas and links of fourteen tables fill the brief; without the schemas there is room for statements."""
    whole = QT.all_cards
    monkeypatch.setattr(QT, "all_cards", lambda *at: whole(*at).where("kind <> 'table_schema'"))
    cards = entry.queries()["synthesis_brief"](spark, large_orders).where("kind = 'table_relation_statement'").collect()
    assert [(c["file"], c["snippet"]) for c in cards] == [("orders.parquet", SAID)]


ODD = [
    "If it rains, the plan depends on ORDERS.parquet.. Then\twe wait!  Otherwise Straße STRASSE must close?\r\n# 1 Overview of all\r1.2 Second part here",
    "依赖订单表。然后 提交 审批；report alpha beta gamma uses the quarterly alpha beta figures\n\n- item of a list\n一、标题 的 内容 很 长\n" + "x" * 330 + " if y then z",
    "ΣΊΣΥΦΟΣ requires ſtraight İstanbul before SRC1 ends. mentions other.parquet and src12", "", "short", None, "no break line if 　then ends.\n\n",
]


def test_one_pass_over_texts_finds_what_the_joins_find(spark, tmp_path):
    """Scores, names, headings and ranks are those of the SQL expressions, over odd texts and more statements than a file's best."""
    n = len(ODD)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, text string")
    many = spark.range(0, 900, 1, 3).selectExpr("id", f"int(id % {n}) AS i").join(texts, "i").selectExpr(
        "id AS doc_id", "if(id % 5 = 0, text, concat(coalesce(text, 'then'), ' must end ', id % 211, '. after ', id, ' if src12 returns. # ', id))  AS text",
        "'en' AS lang", "if(id % 9 = 0, NULL, concat('src', id % 4)) AS source",
    )
    many.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    names = spark.createDataFrame(
        [(f, f, f.split(".")[0]) for f in ("documents.parquet", "orders.parquet", "other.parquet", "src0", "src1", "src12")]
        + [("a/r.txt", "report_alpha_beta.txt", "report alpha beta gamma"), ("q", "quarterly 依赖订单表", "quarterly 依赖订单表 figures")],
        "path string, file_name string, stem string",
    )
    tables = {"documents": spark.read.parquet(str(tmp_path / "documents.parquet"))}

    def best(found):
        said, cells, heads = found
        return [
            sorted(map(str, df.collect())) for df in (
                C.best_statements(said, extra=("mentioned",)), C.best_statements(cells, extra=("column", "mentioned")), C.outline_rows(heads),
            )
        ]

    got = best(QT.card_texts(spark, str(tmp_path), tables, names))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(QT, "known_names", lambda names: None)
        want = best(QT.card_texts(spark, str(tmp_path), tables, names))
    assert got == want and len(got[0]) > 160 and len(got[1]) == 40 and len(got[2]) >= 4
    with pytest.MonkeyPatch.context() as patch:  # more pieces of names than one expression looks for
        patch.setattr("linkweave.operators.texts.FEW_PIECES", 2)
        assert best(QT.card_texts(spark, str(tmp_path), tables, names)) == want
    kept = scan_texts(tables["documents"], "documents", "documents.parquet", known_names(names), ("source", "doc_id", "text"))
    assert kept.count() <= 4 * (40 + 5 * (40 + 24))  # a task sends on the best of each file and no more


def test_one_pass_without_names_or_texts(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "numbers"))
    none = known_names(spark.createDataFrame([], "path string, file_name string, stem string"))
    assert scan_texts(spark.read.parquet(str(tmp_path / "numbers")), "numbers", "numbers.parquet", none) is None
    spark.range(10).selectExpr("if(id = 3, 'It then ends.', 'nothing') AS t").write.parquet(str(tmp_path / "texts"))
    found = scan_texts(spark.read.parquet(str(tmp_path / "texts")), "texts", "texts.parquet", none).collect()
    assert [(r["what"], r["statement"], r["score"], r["mentioned"]) for r in found] == [("cell", "It then ends.", 5, [])]
