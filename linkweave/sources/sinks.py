"""Sinks: result tables by run, and their rendering as Mermaid and Markdown lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import when
from linkweave.sources.files import global_rank


def write_tables(tables: dict[str, DataFrame], folder: str, run_id: str, fmt: str = "parquet") -> None:
    """Each frame under folder/name/run_id=...; a rerun of the same run replaces only its own output."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}/run_id={run_id}")


def read_table(spark, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{folder}/{name}")


def mermaid_lines(relation_rows: DataFrame) -> DataFrame:
    """Flow chart of files and relations as (n, line), node lines before edge lines."""
    ends = relation_rows.selectExpr("explode(array(source, target)) AS file").distinct()
    nodes = global_rank(ends, ["file"], "node")
    clean = "right(replace(file, '\"', '\\''), 60)"
    head = relation_rows.sparkSession.range(1).selectExpr("0 AS part", "'' AS a", "'' AS b", "'flowchart LR' AS line")
    node_lines = nodes.selectExpr("1 AS part", "file AS a", "'' AS b", f"concat('  F', node, '[\"', {clean}, '\"]') AS line")
    left = nodes.selectExpr("file AS source", "node AS s")
    right = nodes.selectExpr("file AS target", "node AS t")
    label = "concat(type, ' ', format_string('%.2f', confidence))"
    edge_lines = relation_rows.join(left, "source").join(right, "target").selectExpr(
        "2 AS part", "concat_ws('\\0', source, target, type, source_column) AS a", "id AS b",
        f"concat('  F', s, ' ---|\"', {label}, '\"| F', t) AS line",
    )
    return head.unionByName(node_lines).unionByName(edge_lines)


def relation_report(relation_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Markdown lines of relations and their evidence, with the keys that order them."""
    # Layout of the relation report.
    heading = "concat('### ', id, ' · ', type)"
    body = (
        "concat_ws('\\n', concat('`', source, '` ↔ `', target, '`'), '',"
        " concat('- 列：`', source_column, '` ↔ `', target_column, '`'),"
        " concat('- 判定：`', verdict, '`；置信度：`', format_string('%.3f', confidence), '`'),"
        " concat('- 说明：', explanation), concat('- 证据总数：', evidence_count))"
    )
    proof = (
        "concat('- 证据：`', kind, '`；`', source_locator, '` ↔ `', target_locator, '`；匹配 `', value_preview,"
        " '`；指纹 `', left(fingerprint, 16), '...`')"
    )
    rows = relation_rows.selectExpr("id", "0 AS part", "0 AS rank", f"{heading} AS line").unionByName(
        relation_rows.selectExpr("id", "1 AS part", "0 AS rank", f"{body} AS line")
    )
    proofs = evidence.selectExpr("relation_id AS id", "2 AS part", "rank", f"{proof} AS line")
    omitted = relation_rows.where("omitted_evidence_count > 0").selectExpr(
        "id", "3 AS part", "0 AS rank", "concat('- 未展开证据：', omitted_evidence_count) AS line"
    )
    return rows.unionByName(proofs).unionByName(omitted)


def scenario_mermaid(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Flow charts of many claimed graphs: main steps are thick, branch steps dashed."""
    clean = "left(replace(replace({}, '\"', '\\''), '\\n', ' '), 80)"
    node_lines = nodes.selectExpr("graph_id", "1 AS part", "id", f"concat('  ', id, '[\"', {clean.format('name')}, '\"]') AS line")
    on_path = steps.groupBy("graph_id", "source", "target").agg(F.expr("bool_or(owner = 'main_chain') AS main"))
    arrow = when(("main", "'==>'"), ("main IS NOT NULL", "'-.->'"), otherwise="'-->'")
    edge_lines = edges.join(on_path, ["graph_id", "source", "target"], "left").selectExpr(
        "graph_id", "2 AS part", "id", f"concat('  ', source, ' ', {arrow}, '|\"', {clean.format('type')}, '\"| ', target) AS line"
    )
    heads = nodes.select("graph_id").distinct().selectExpr("graph_id", "0 AS part", "'' AS id", "'flowchart TB' AS line")
    return heads.unionByName(node_lines).unionByName(edge_lines)


def claim_tables(claims) -> dict[str, DataFrame]:
    """Result tables of claimed graphs: nodes, edges, which claim cites which card, and the cards that are cited at all."""
    cited = [
        rows.selectExpr("graph_id", f"'{kind}' AS claim_kind", "id AS claim_id", "explode(evidence_ids) AS evidence_id")
        for kind, rows in (("node", claims.nodes), ("edge", claims.edges))
    ]
    evidence = cited[0].unionByName(cited[1])
    return {
        "nodes": claims.nodes.select("graph_id", "id", "name", "type"),
        "edges": claims.edges.select("graph_id", "id", "source", "target", "type", "confidence"),
        "claim_evidence": evidence,
        "evidence_cards": claims.cards.join(evidence.select(F.col("evidence_id").alias("id")).distinct(), "id", "left_semi"),
    }


def _named(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Rows with the name of the node in `column`, or its id where there is no such node, as {column}_name."""
    names = nodes.selectExpr("graph_id", f"id AS {column}", "name AS __name")
    return rows.join(names, ["graph_id", column], "left").selectExpr("* EXCEPT (__name)", f"coalesce(__name, {column}) AS {column}_name")


def _route(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, route): the names of a path's nodes in order. A path is a line of its graph's report."""
    return steps.groupBy(*keys).agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, node_name))), x -> x.node_name), ' → ') AS route"))


def scenario_report(claims) -> DataFrame:
    """Markdown of many claimed graphs as (graph_id, part, item, rank, line), in which order they stand.

    Names of unknown nodes are their ids. Graphs without branches, excluded files or evidence have no lines of these kinds.
    Cards may have a locator beside their file.
    """
    c = claims
    counts = c.graphs.select("graph_id", "name", "purpose")
    for name, rows in (("n_nodes", c.nodes), ("n_edges", c.edges), ("n_branches", c.branches)):
        counts = counts.join(rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name)), "graph_id", "left").fillna(0, name)
    # Wording of the scenario report.
    head = counts.selectExpr(
        "graph_id", "0 AS part", "'' AS item",
        "posexplode(array('# 业务场景宏观数据关系', concat('- 场景：', name), concat('- 目的：', purpose),"
        " concat('- 节点：', n_nodes, '；关系：', n_edges, '；分支：', n_branches))) AS (rank, line)",
    )
    chain = _route(_named(c.chain, c.nodes, "node"), ["graph_id"]).selectExpr(
        "graph_id", "1 AS part", "'' AS item", "posexplode(array('## 主数据路径', route)) AS (rank, line)"
    )
    steps = _named(c.branches.selectExpr("graph_id", "id", "posexplode(path) AS (pos, node)"), c.nodes, "node")
    routes = _named(c.branches.select("graph_id", "id", "origin"), c.nodes, "origin").join(_route(steps, ["graph_id", "id"]), ["graph_id", "id"])
    branches = routes.selectExpr("graph_id", "2 AS part", "id AS item", "0 AS rank", "concat('- ', origin_name, ' --[分支]→ ', route) AS line")
    edges = _named(_named(c.edges, c.nodes, "source"), c.nodes, "target").selectExpr(
        "graph_id", "3 AS part", "id AS item",
        "posexplode(array(concat('### ', id, ' · ', type), concat(source_name, ' → ', target_name),"
        " concat('- 置信度：', format_string('%.3f', double(confidence))))) AS (rank, line)",
    )
    place = "concat(file, '#', locator)" if "locator" in c.cards.columns else "file"
    cited = c.edges.selectExpr("graph_id", "id AS item", "posexplode(evidence_ids) AS (at, id)").join(c.cards, "id")
    proofs = cited.selectExpr("graph_id", "3 AS part", "item", "3 + at AS rank", f"concat('- `', id, '` [', strength, '] ', {place}, '：', snippet) AS line")
    files = c.coverage.select("graph_id", "file", "included", "reason").distinct()
    covered = files.where("included").selectExpr("graph_id", "4 AS part", "file AS item", "0 AS rank", "concat('- 已纳入 `', file, '`') AS line")
    left_out = files.where("NOT included").selectExpr("graph_id", "5 AS part", "file AS item", "0 AS rank", "concat('- 排除 `', file, '`：', reason) AS line")
    out = head
    for rows in (chain, branches, edges, proofs, covered, left_out):
        out = out.unionByName(rows)
    return out
