"""Validation of claimed relationship graphs, many at once, keyed by `graph_id`.

Frames: graphs (graph_id, name, purpose); nodes (graph_id, id, type, name, evidence_ids); edges (graph_id, id,
source, target, type, confidence, evidence_ids); chain (graph_id, pos, node); branches (graph_id, pos, id,
origin, path, evidence_ids); coverage (graph_id, file, included, reason, evidence_ids); inventory (graph_id,
file); cards (id, kind, strength, snippet, file). Every check yields (graph_id, rule, subject).
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.config import Limits
from linkweave.functions.statements import ordering_signal
from linkweave.functions.text import casefold, quoted, when
from linkweave.functions.values import record_like_name
from linkweave.operators.graph import components
from linkweave.session import cut_lineage

# Node and edge types and which ends an edge type may join.
NODE_TYPES = (
    "trigger", "actor", "input", "activity", "object", "rule", "decision", "state", "system", "output",
)
EDGE_TYPES = (
    "triggers", "consumes", "produces", "transforms", "governed_by", "precedes", "depends_on", "branches_to",
    "updates", "returns_to", "references", "performed_by", "feeds", "joins_with", "governs", "derives",
)
FLOW_TYPES = (
    "triggers", "consumes", "produces", "transforms", "precedes", "depends_on", "branches_to", "updates",
    "returns_to", "feeds", "derives",
)
ORDER_TYPES = ("triggers", "precedes", "branches_to", "returns_to")
ENDPOINTS = {
    "consumes": (("activity", "decision", "system"), ("input", "object", "state")),
    "produces": (("activity", "decision", "system"), ("output", "object", "state")),
    "governed_by": (("activity", "decision", "system"), ("rule",)),
    "performed_by": (("activity", "decision"), ("actor",)),
    "feeds": (
        ("trigger", "input", "object", "activity", "state", "system"),
        ("activity", "decision", "system", "object", "output"),
    ),
    "joins_with": (("input", "object", "state"), ("input", "object", "state")),
    "governs": (("rule",), ("activity", "decision", "system", "object", "output")),
    "derives": (
        ("input", "object", "activity", "decision", "system", "state"), ("decision", "object", "state", "output"),
    ),
}
START_TYPES = ("trigger", "input", "actor", "system")
END_TYPES = ("output", "state", "object")
WHOLE_GRAPH = 2000
"""Branches of a graph that is worked out in one piece."""
STATED = ("document_relation_statement", "table_relation_statement", "goal_relation_statement")
LINKED = ("references", "depends_on", "feeds", "joins_with")


@dataclass(frozen=True)
class Claims:
    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chain: DataFrame
    branches: DataFrame
    coverage: DataFrame
    inventory: DataFrame
    cards: DataFrame


def found(df: DataFrame, rule: str, subject: str = "''", where: str | None = None) -> DataFrame:
    rows = df.where(where) if where else df
    return rows.selectExpr("graph_id", f"'{rule}' AS rule", f"string({subject}) AS subject")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def citations(claims: Claims) -> DataFrame:
    """(graph_id, owner, owner_id, evidence_id) of everything that cites a card."""
    parts = [
        claims.nodes.selectExpr("graph_id", "'node' AS owner", "id AS owner_id", "evidence_ids"),
        claims.edges.selectExpr("graph_id", "'edge' AS owner", "id AS owner_id", "evidence_ids"),
        claims.branches.selectExpr("graph_id", "'branch' AS owner", "id AS owner_id", "evidence_ids"),
        claims.coverage.where("NOT included").selectExpr("graph_id", "'excluded' AS owner", "file AS owner_id", "evidence_ids"),
    ]
    return union(parts)


def size_rules(claims: Claims, limits: Limits = Limits()) -> DataFrame:
    """Graphs with too many nodes, edges or branches; ids that are empty or used twice; bad names and types."""
    def over(df: DataFrame, limit: int, rule: str) -> DataFrame:
        return found(df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), rule, "n", f"n > {limit}")

    def repeated(df: DataFrame, rule: str) -> DataFrame:
        counts = df.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("n"))
        return found(counts.where("n > 1 OR coalesce(id, '') = ''").select("graph_id").distinct(), rule)

    name = "trim(coalesce(name, ''))"
    sized = f"char_length({name}) BETWEEN 2 AND 80"
    return union([
        over(claims.nodes, limits.graph_nodes, "too_many_nodes"),
        over(claims.edges, limits.graph_edges, "too_many_edges"),
        over(claims.branches, limits.graph_branches, "too_many_branches"),
        repeated(claims.nodes, "node_id_not_unique"),
        repeated(claims.edges, "edge_id_not_unique"),
        repeated(claims.branches, "branch_id_not_unique"),
        found(claims.nodes, "node_type", "id", f"coalesce(type, '') NOT IN ({quoted(NODE_TYPES)})"),
        found(claims.nodes, "node_name_length", "id", f"NOT {sized}"),
        found(claims.nodes, "node_name_is_record", "id", f"{sized} AND {record_like_name('name')}"),
        found(claims.edges, "edge_type", "id", f"coalesce(type, '') NOT IN ({quoted(EDGE_TYPES)})"),
        found(claims.edges, "edge_self_loop", "id", "source = target"),
        found(claims.edges, "edge_confidence", "id", "confidence IS NULL OR NOT confidence BETWEEN 0 AND 1"),
        found(claims.graphs, "scenario_text", "''", "trim(coalesce(name, '')) = '' OR trim(coalesce(purpose, '')) = ''"),
    ])


def chain_rules(claims: Claims) -> DataFrame:
    """Length, repeats, first and last type of main chains."""
    per = claims.chain.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("min_by(node, pos) AS head"), F.expr("max_by(node, pos) AS tail")
    )
    sizes = claims.graphs.select("graph_id").join(per, "graph_id", "left")
    again = claims.chain.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    typed = claims.nodes.selectExpr("graph_id", "id", "type")
    head = per.join(typed.withColumnRenamed("id", "head"), ["graph_id", "head"])
    tail = per.join(typed.withColumnRenamed("id", "tail"), ["graph_id", "tail"])
    return union([
        found(sizes, "chain_too_short", "coalesce(n, 0)", "coalesce(n, 0) < 3"),
        found(again.select("graph_id").distinct(), "chain_repeats"),
        found(head, "chain_start_type", "head", f"type NOT IN ({quoted(START_TYPES)})"),
        found(tail, "chain_end_type", "tail", f"type NOT IN ({quoted(END_TYPES)})"),
    ])


def reference_rules(claims: Claims) -> DataFrame:
    """Unknown nodes and cards, and owners that cite nothing: one anti join per kind of reference."""
    known = claims.nodes.selectExpr("graph_id", "id AS node").distinct()
    ends = claims.edges.selectExpr("graph_id", "id", "explode(array(source, target)) AS node")
    steps = claims.branches.selectExpr("graph_id", "id", "explode(path) AS node")

    def unknown(df: DataFrame, rule: str, subject: str) -> DataFrame:
        return found(df.join(known, ["graph_id", "node"], "left_anti"), rule, subject).distinct()

    owners = citations(claims)
    cited = owners.selectExpr("graph_id", "owner", "owner_id", "explode(evidence_ids) AS card")
    missing = cited.join(claims.cards.selectExpr("id AS card").distinct(), "card", "left_anti")
    label = "concat(owner, ':', owner_id)"
    return union([
        unknown(ends, "edge_unknown_node", "id"),
        unknown(claims.chain, "chain_unknown_node", "node"),
        unknown(steps, "branch_unknown_node", "id"),
        found(owners, "no_evidence", label, "coalesce(size(evidence_ids), 0) < 1"),
        found(missing, "unknown_card", "concat(owner, ':', owner_id, ':', card)").distinct(),
    ])


def endpoint_table(spark) -> DataFrame:
    rows = [(t, s, e) for t, (sources, ends) in ENDPOINTS.items() for s in sources for e in ends]
    return spark.createDataFrame(rows, "type string, source_type string, target_type string")


def typed_edges(claims: Claims) -> DataFrame:
    kinds = claims.nodes.dropDuplicates(["graph_id", "id"])
    left = kinds.selectExpr("graph_id", "id AS source", "type AS source_type")
    right = kinds.selectExpr("graph_id", "id AS target", "type AS target_type")
    return claims.edges.join(left, ["graph_id", "source"]).join(right, ["graph_id", "target"])


def endpoint_rules(claims: Claims) -> DataFrame:
    """Edges whose end types do not fit their type. The rule table is fixed and a hundred rows long."""
    allowed = F.broadcast(endpoint_table(claims.nodes.sparkSession))
    ruled = typed_edges(claims).where(f"type IN ({quoted(ENDPOINTS)})")
    wrong = ruled.join(allowed, ["type", "source_type", "target_type"], "left_anti")
    return found(wrong, "edge_endpoint_types", "concat(id, ':', source_type, '->', target_type)")


def endpoint_hints(claims: Claims) -> DataFrame:
    """Edge types that would fit the ends of each edge that breaks the rule."""
    allowed = F.broadcast(endpoint_table(claims.nodes.sparkSession).withColumnRenamed("type", "fitting"))
    wrong = typed_edges(claims).where(f"type IN ({quoted(ENDPOINTS)})").join(
        F.broadcast(endpoint_table(claims.nodes.sparkSession)), ["type", "source_type", "target_type"], "left_anti"
    )
    return wrong.join(allowed, ["source_type", "target_type"], "left").groupBy("graph_id", "id").agg(
        F.expr("array_join(array_sort(collect_set(fitting)), ',') AS fitting")
    )


def path_steps(claims: Claims) -> DataFrame:
    """(graph_id, owner, source, target, first) of all steps of chains and branches."""
    order = "PARTITION BY graph_id ORDER BY pos"
    chain = claims.chain.selectExpr(
        "graph_id", "'main_chain' AS owner", f"lag(node) OVER ({order}) AS source", "node AS target", "false AS first"
    ).where("source IS NOT NULL")
    branch = claims.branches.where("size(path) > 0").selectExpr(
        "graph_id", "id AS owner", "inline(zip_with(slice(array_insert(path, 1, origin), 1, size(path)), path,"
        " (s, t) -> named_struct('source', s, 'target', t)))", "path[0] AS head", "origin",
    )
    first = "source = origin AND target = head"
    return chain.unionByName(branch.selectExpr("graph_id", "owner", "source", "target", f"{first} AS first"))


def path_rules(claims: Claims, order: DataFrame | None = None) -> DataFrame:
    """Steps without a flow edge of their direction; branches that do not start with a branching edge.

    A branch that never attaches is not judged by its steps. order: the result of `branch_order`, if at hand.
    """
    order = branch_order(claims) if order is None else order
    steps = path_steps(replace(claims, branches=claims.branches.join(order.select("graph_id", "pos"), ["graph_id", "pos"], "left_semi")))
    flow = claims.edges.where(f"type IN ({quoted(FLOW_TYPES)})").select("graph_id", "source", "target").distinct()
    branching = claims.edges.where("type = 'branches_to'").select("graph_id", "source", "target").distinct()
    on = ["graph_id", "source", "target"]
    label = "concat(owner, ':', source, '->', target)"
    return union([
        found(steps.where("NOT first").join(flow, on, "left_anti"), "step_without_flow_edge", label),
        found(steps.where("first").join(branching, on, "left_anti"), "branch_start", label),
    ])


def evidence_adequacy(claims: Claims) -> DataFrame:
    """(graph_id, id, type, adequate) for edges of a known type that cite at least one known card."""
    cards = claims.cards.dropDuplicates(["id"]).selectExpr(
        "id AS card", "kind", "strength", f"{ordering_signal(casefold('coalesce(snippet, ' + quoted(['']) + ')'))} AS ordered"
    )
    cited = claims.edges.where(f"type IN ({quoted(EDGE_TYPES)})").selectExpr(
        "graph_id", "id", "type", "explode(evidence_ids) AS card"
    ).join(cards, "card")
    stated = f"kind IN ({quoted(STATED)})"
    weight = when(("strength = 'direct'", "3"), ("strength = 'structural'", "2"), ("strength = 'corroborating'", "1"), otherwise="0")
    facts = cited.groupBy("graph_id", "id", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("bool_or(kind = 'field_relationship') AS linked"),
        F.expr(f"bool_or({stated}) AS stated"),
        F.expr(f"bool_or({stated} AND ordered) AS ordered"),
        F.expr("count_if(kind = 'goal_relation_statement') AS goals"),
        F.expr("bool_or(kind = 'table_process_signal') AS signal"),
        F.expr(f"sum({weight}) AS weight"),
        F.expr("bool_or(strength IN ('direct', 'structural')) AS firm"),
    )
    adequate = when(
        (f"type IN ({quoted(LINKED)}) AND linked", "true"),
        (f"type IN ({quoted(ORDER_TYPES)})", "ordered OR goals >= 2 OR (signal AND n >= 2)"),
        ("stated", "true"),
        otherwise="weight >= 4 AND firm",
    )
    return facts.selectExpr("graph_id", "id", "type", f"{adequate} AS adequate")


def adequacy_rules(claims: Claims) -> DataFrame:
    return found(evidence_adequacy(claims), "weak_evidence", "concat(id, ':', type)", "NOT adequate")


def graph_node(graph: str, node: str) -> str:
    return f"to_json(named_struct('g', {graph}, 'n', {node}))"


def connectivity_rules(claims: Claims) -> DataFrame:
    """Nodes that cannot be reached from the head of the main chain, whatever the direction of edges."""
    links = claims.edges.selectExpr(f"{graph_node('graph_id', 'source')} AS source", f"{graph_node('graph_id', 'target')} AS target")
    part = components(links)
    heads = claims.chain.groupBy("graph_id").agg(F.expr("min_by(node, pos) AS head"))
    start = heads.selectExpr("graph_id", "head", f"{graph_node('graph_id', 'head')} AS node").join(part, "node", "left").selectExpr(
        "graph_id", "coalesce(component, node) AS reached"
    )
    placed = claims.nodes.selectExpr("graph_id", "id", f"{graph_node('graph_id', 'id')} AS node").join(part, "node", "left").selectExpr(
        "graph_id", "id", "coalesce(component, node) AS component"
    )
    return found(placed.join(start, "graph_id"), "disconnected_node", "id", "component <> reached").distinct()


def branch_order(claims: Claims) -> DataFrame:
    """(graph_id, pos, pass): when each branch attaches; branches that never do are absent.

    Branches are read in order, pass after pass, and each one that starts at an attached node adds its
    path. So a branch attaches in the pass of the earliest branch that holds its origin, or in the next
    pass where that one is read later. Graphs of at most `WHOLE_GRAPH` branches are worked out whole, many a
    task; the rounds for larger ones, one a branch along a row of branches, relax that minimum until nothing changes.
    """
    branches = claims.branches.selectExpr("graph_id", "pos", "origin", "path")
    large = cut_lineage(branches.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(f"n > {WHOLE_GRAPH}").select("graph_id"), "large")
    heads = claims.chain.selectExpr("graph_id", "node AS origin", "true AS starts").distinct()
    marked = branches.join(large, "graph_id", "left_anti").join(heads, ["graph_id", "origin"], "left")
    graphs = marked.groupBy("graph_id").agg(F.collect_list(F.struct("pos", "origin", "path", "starts")).alias("branches"))
    kinds = dict(branches.dtypes)
    whole = graphs.mapInArrow(_attaching(), f"graph_id {kinds['graph_id']}, pos {kinds['pos']}, pass long")
    if large.isEmpty():
        return cut_lineage(whole, "order")
    return cut_lineage(whole.unionByName(_order_in_rounds(claims, branches.join(large, "graph_id", "left_semi"))), "order")


def _attaching():
    """Passes of the branches of whole graphs, a graph a row."""

    def passes(branches):
        starts, held, reads = set(), defaultdict(set), defaultdict(set)
        for b in branches:
            if b["pos"] is None:
                continue
            held[b["pos"]].update(b["path"] or ())
            reads[b["origin"]].add(b["pos"])
            if b["starts"]:
                starts.add(b["pos"])
        reads.pop(None, None)
        found, ready, number = {}, starts, 1
        while ready:  # the branches of a pass, then of the next one
            queue, later = [p for p in ready if p not in found], set()
            found.update(dict.fromkeys(queue, number))
            while queue:
                holder = queue.pop()
                for node in held[holder]:
                    for pos in reads.get(node, ()):
                        if pos in found:
                            continue
                        if pos < holder:
                            later.add(pos)
                        else:
                            found[pos] = number
                            queue.append(pos)
            ready, number = later, number + 1
        return found

    def run(batches):
        for batch in batches:
            graphs = ((g.as_py(), b.as_py()) for g, b in zip(*batch.columns))  # one at a time
            rows = [(g, p, n) for g, b in graphs for p, n in passes(b).items()]
            kinds = (batch.schema.field(0).type, batch.schema.field(1).type.value_type.field("pos").type, pa.int64())
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["graph_id", "pos", "pass"])

    return run


def _order_in_rounds(claims: Claims, branches: DataFrame) -> DataFrame:
    start = branches.join(
        claims.chain.selectExpr("graph_id", "node AS origin").distinct(), ["graph_id", "origin"], "left_semi"
    ).selectExpr("graph_id", "pos", "1L AS pass")
    current = cut_lineage(start)
    state = None
    while True:
        row = current.agg(F.count(F.lit(1)).alias("n"), F.sum("pass").alias("s")).first()
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
        holders = current.join(branches, ["graph_id", "pos"]).selectExpr(
            "graph_id", "pos AS holder", "pass", "explode(path) AS origin"
        )
        reached = branches.join(holders, ["graph_id", "origin"]).where("holder <> pos").selectExpr(
            "graph_id", "pos", "pass + int(holder > pos) AS pass"
        )
        current = cut_lineage(
            current.unionByName(reached).groupBy("graph_id", "pos").agg(F.min("pass").alias("pass"))
        )
    return current


def branch_rules(claims: Claims, order: DataFrame | None = None) -> DataFrame:
    """Branches that never attach, are empty, or neither end at a result nor return to an attached node."""
    order = branch_order(claims) if order is None else order
    branches = claims.branches
    loose = branches.join(order, ["graph_id", "pos"], "left_anti")
    attached = branches.join(order, ["graph_id", "pos"]).selectExpr(
        "*", "struct(pass, pos) AS turn", "element_at(if(size(path) > 0, path, array(NULL)), -1) AS endpoint"
    )
    empty = attached.where("coalesce(size(path), 0) < 1")
    ends = attached.where("size(path) > 0")
    # what is attached when a branch is read: the chain and all branches read before it
    pool = claims.chain.selectExpr("graph_id", "node", "struct(0L AS pass, bigint(-1) AS pos) AS since").unionByName(
        ends.selectExpr("graph_id", "explode(path) AS node", "struct(pass, bigint(pos) AS pos) AS since")
    ).groupBy("graph_id", "node").agg(F.min("since").alias("since"))
    turn = "struct(pass, bigint(pos) AS pos)"
    typed = claims.nodes.dropDuplicates(["graph_id", "id"]).selectExpr("graph_id", "id AS endpoint", "type")
    known_end = ends.join(pool.withColumnRenamed("node", "endpoint"), ["graph_id", "endpoint"]).where(f"since < {turn}")
    returns = claims.edges.where("type = 'returns_to'").selectExpr("graph_id", "source AS endpoint", "target AS node")
    back = ends.join(returns, ["graph_id", "endpoint"]).join(pool, ["graph_id", "node"]).where(f"since < {turn}")
    result = ends.join(typed, ["graph_id", "endpoint"]).where(f"type IN ({quoted(END_TYPES)})")
    fine = union([df.select("graph_id", "pos") for df in (known_end, back, result)]).distinct()
    return union([
        found(loose, "branch_unattached", "id"),
        found(empty, "branch_empty", "id"),
        found(ends.join(fine, ["graph_id", "pos"], "left_anti"), "branch_end", "id"),
    ])


def coverage_rules(claims: Claims) -> DataFrame:
    """Files unknown, missing, in both lists, excluded without reason or fitting evidence, or included unused."""
    named = claims.coverage.select("graph_id", "file", "included", "reason", "evidence_ids")
    included = named.where("included").select("graph_id", "file").distinct()
    no_reason = "coalesce(file, '') = '' OR coalesce(reason, '') = ''"
    excluded_rows = named.where("NOT included")
    excluded = excluded_rows.where(f"NOT ({no_reason})").select("graph_id", "file").distinct()
    on = ["graph_id", "file"]
    files = "files" if "files" in claims.cards.columns else "array(file)"  # a card may speak of several files
    cards = claims.cards.selectExpr("id AS card", f"explode({files}) AS card_file")
    cited = citations(claims).selectExpr("graph_id", "owner", "owner_id", "explode(evidence_ids) AS card").join(cards, "card")
    in_file = cited.where("owner = 'excluded' AND card_file = owner_id").selectExpr("graph_id", "owner_id AS file").distinct()
    has_card = cited.where("owner = 'excluded'").selectExpr("graph_id", "owner_id AS file").distinct()
    used = cited.where("owner <> 'excluded'").selectExpr("graph_id", "card_file AS file").distinct()
    all_named = included.unionByName(excluded).distinct()
    return union([
        found(all_named.join(claims.inventory, on, "left_anti"), "file_outside_inventory", "file"),
        found(claims.inventory.join(all_named, on, "left_anti"), "file_not_covered", "file"),
        found(included.join(excluded, on, "left_semi"), "file_in_and_out", "file"),
        found(excluded_rows, "exclusion_without_reason", "file", no_reason),
        found(has_card.join(in_file, on, "left_anti"), "exclusion_evidence_elsewhere", "file"),
        found(included.join(used, on, "left_anti"), "included_file_unused", "file"),
    ])


def violations(claims: Claims) -> DataFrame:
    """All broken rules of all graphs."""
    order = branch_order(claims)
    return union([
        size_rules(claims), chain_rules(claims), reference_rules(claims), endpoint_rules(claims), path_rules(claims, order),
        adequacy_rules(claims), connectivity_rules(claims), branch_rules(claims, order), coverage_rules(claims),
    ]).distinct()


def valid_graphs(claims: Claims, broken: DataFrame) -> DataFrame:
    return claims.graphs.join(broken.select("graph_id").distinct(), "graph_id", "left_anti")
