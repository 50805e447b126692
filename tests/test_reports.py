"""Reports and result tables of claimed graphs, and what notes hold, next to their SQL and by hand."""

import pytest

from linkweave.operators.claims import Claims
from linkweave.sources import sinks
from tools.compare import compare


@pytest.mark.parametrize("name", ["scenario_report", "stored_claims", "note_entities"])
def test_equals_sql(spark, folder, name):
    state, rows, _, note = compare(spark, folder, name)
    assert state == "same" and rows > 0, note


def claims(spark, rows=True):
    def frame(values, fields):
        return spark.createDataFrame(values if rows else [], fields)

    return Claims(
        graphs=frame([(1, "Orders", "From order to bill"), (2, "Bare", "Nothing")], "graph_id long, name string, purpose string"),
        nodes=frame([(1, "a", "input", "Order", ["c1"]), (1, "b", "activity", "Check", ["c1"]), (1, "c", "output", "Bill", [])],
                    "graph_id long, id string, type string, name string, evidence_ids array<string>"),
        edges=frame([(1, "e1", "a", "b", "feeds", 0.5, ["c1", "c9"]), (1, "e2", "b", "gone", "feeds", 1.0, [])],
                    "graph_id long, id string, source string, target string, type string, confidence double, evidence_ids array<string>"),
        chain=frame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b")], "graph_id long, pos int, node string"),
        branches=frame([(1, 0, "x", "b", ["c", "a"], [])], "graph_id long, pos int, id string, origin string, path array<string>, evidence_ids array<string>"),
        coverage=frame([(1, "f1", True, "", []), (1, "f2", False, "empty", [])],
                       "graph_id long, file string, included boolean, reason string, evidence_ids array<string>"),
        inventory=frame([(1, "f1")], "graph_id long, file string"),
        cards=frame([("c1", "k", "direct", "f1", "line:3", "Orders are checked."), ("c2", "k", "direct", "f1", "line:4", "Unused.")],
                    "id string, kind string, strength string, file string, locator string, snippet string"),
    )


def test_report_by_hand(spark):
    rows = sinks.scenario_report(claims(spark)).orderBy("graph_id", "part", "item", "rank").collect()
    assert [r.line for r in rows if r.graph_id == 1] == [
        "# 业务场景宏观数据关系", "- 场景：Orders", "- 目的：From order to bill", "- 节点：3；关系：2；分支：1", "## 主数据路径", "Order → Check → Bill",
        "- Check --[分支]→ Bill → Order", "### e1 · feeds", "Order → Check", "- 置信度：0.500", "- `c1` [direct] f1#line:3：Orders are checked.",
        "### e2 · feeds", "Check → gone", "- 置信度：1.000", "- 已纳入 `f1`", "- 排除 `f2`：empty",
    ]
    assert [r.line for r in rows if r.graph_id == 2][3] == "- 节点：0；关系：0；分支：0"
    assert sinks.scenario_report(claims(spark, rows=False)).count() == 0


def test_claim_tables_by_hand(spark, tmp_path):
    out = str(tmp_path)
    for _ in range(2):  # a rerun replaces its own rows
        sinks.write_tables(sinks.claim_tables(claims(spark)), out, "run-1")
    assert [r.id for r in sinks.read_table(spark, out, "evidence_cards").collect()] == ["c1"]
    cited = sinks.read_table(spark, out, "claim_evidence").collect()
    assert sorted((r.claim_kind, r.claim_id, r.evidence_id) for r in cited) == [("edge", "e1", "c1"), ("edge", "e1", "c9"), ("node", "a", "c1"), ("node", "b", "c1")]
