"""Connected components and maximum spanning forests over edge frames.

Rounds are few (they grow with the logarithm of the graph). Each round writes its result to the
checkpoint folder, so a lost executor never costs more than the running round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkweave.session import cut_lineage
from linkweave.sources.catalog import digest_of, multiset_digest


def _hashed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): each node with a 64-bit hash that no other one has, and the edges between two nodes as such hashes."""
    both = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v"))
    for seed in count():
        nodes = cut_lineage(both.select("node", F.xxhash64(F.lit(seed), "node").alias("id")).distinct(), "nodes")
        if nodes.groupBy("id").count().where("count > 1").isEmpty():
            break
    ends = [F.xxhash64(F.lit(seed), c).alias(c) for c in ("u", "v")]
    return nodes, cut_lineage(pairs.where(F.col("u") != F.col("v")).select(*ends), "edges")


def _seen(df: DataFrame, condition: str, name: str) -> tuple[DataFrame, int]:
    """The frame, written, and how many of its rows meet a condition, counted by the way."""
    seen = Observation()
    return cut_lineage(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name), seen.get["n"]


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): each node points to the smallest node around it, and pointers are followed to their end."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS node", "least(u, m) AS root"), "roots")
    moved = 1
    while moved:  # a pointer goes down, so there are no circles; each step doubles its length
        steps = roots.where("node <> root").selectExpr("node AS root", "root AS next")
        roots, moved = _seen(roots.join(steps, "root", "left").selectExpr("node", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"), "moved", "roots")
    return roots.select("node", "root")


def components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component): the component is named by its smallest node. Nodes come from the edges.

    Nodes are joined to the smallest hash around them and become one; what is left of the edges goes through the next round. Hashes have
    no order that follows the graph, so a round leaves few nodes of a dense part, and a node that stays alone is joined in the next.
    """
    nodes, rest = _hashed(edges.select(F.col(source).alias("u"), F.col(target).alias("v")))
    rounds, left = [], int(not rest.isEmpty())
    while left:
        rounds.append(_roots(rest))
        ends = [rounds[-1].selectExpr(f"node AS {c}", f"root AS r{c}") for c in ("u", "v")]
        moved = rest.join(ends[0], "u").join(ends[1], "v").where("ru <> rv").selectExpr("least(ru, rv) AS u", "greatest(ru, rv) AS v")
        rest, left = _seen(moved.distinct(), "true", "edges")
    if not rounds:
        return nodes.selectExpr("node", "node AS component")
    labels = rounds.pop()
    while rounds:
        above = labels.selectExpr("node AS root", "root AS top")
        labels = cut_lineage(rounds.pop().join(above, "root", "left").selectExpr("node", "coalesce(top, root) AS root"), "labels")
    placed = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").selectExpr("node", "coalesce(root, id) AS root")
    placed = cut_lineage(placed, "placed")
    return placed.join(placed.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (id, source, target, confidence) of the maximum spanning forest.

    Edges are ordered by falling confidence, then id. The order is total, so the forest is unique and
    every round may take the best edge of each tree at once.
    """
    rest = edges.where(F.col("source") != F.col("target")).select(
        "id", "confidence", F.col("source").alias("cu"), F.col("target").alias("cv")
    )
    rest = cut_lineage(rest)
    chosen: DataFrame | None = None
    best_first = F.struct((-F.col("confidence")).alias("c"), F.col("id"))
    while not rest.isEmpty():
        ends = rest.select(F.col("cu").alias("c"), "id", "confidence", "cu", "cv").unionAll(
            rest.select(F.col("cv").alias("c"), "id", "confidence", "cu", "cv")
        )
        picked = ends.groupBy("c").agg(F.min_by(F.struct("id", "cu", "cv"), best_first).alias("e"))
        picked = cut_lineage(picked.select("e.*").dropDuplicates(["id"]))
        chosen = picked.select("id") if chosen is None else chosen.unionAll(picked.select("id"))
        label = components(picked, "cu", "cv")
        left = label.select(F.col("node").alias("cu"), F.col("component").alias("nu"))
        right = label.select(F.col("node").alias("cv"), F.col("component").alias("nv"))
        moved = rest.join(left, "cu", "left").join(right, "cv", "left").select(
            "id", "confidence", F.coalesce("nu", "cu").alias("cu"), F.coalesce("nv", "cv").alias("cv")
        )
        rest = cut_lineage(moved.where(F.col("cu") != F.col("cv")))
    if chosen is None:
        return edges.select("id").limit(0)
    return chosen


def chain_ids(members: DataFrame) -> DataFrame:
    """(component, files, id). The id is an order-free digest of the members, which are never brought together."""
    return members.groupBy("component").agg(*multiset_digest("node")).selectExpr(
        "component", "lines AS files", f"concat('C-', left({digest_of()}, 12)) AS id"
    )


def chains(relation_rows: DataFrame) -> dict[str, DataFrame]:
    """Chains of files joined by relations: `summary`, `members` and `core` (their spanning forest)."""
    members = components(relation_rows)
    ids = chain_ids(members)
    per_chain = relation_rows.join(members, F.col("source") == F.col("node")).groupBy("component").agg(
        F.count(F.lit(1)).alias("relation_count")
    )
    core = spanning_forest(relation_rows)
    edge_chain = relation_rows.select("id", "source").join(members, F.col("source") == F.col("node")).select(
        "id", "component"
    )
    named = ids.select("component", F.col("id").alias("chain_id"))
    summary = ids.join(per_chain, "component").select(
        F.col("id").alias("chain_id"), F.col("component").alias("first_file"), "files", "relation_count",
        F.format_string(
            "Connected evidence network with %d files and %d direct relationship(s).", "files", "relation_count"
        ).alias("explanation"),
    )
    return {
        "summary": summary,
        "members": members.join(named, "component").select("chain_id", F.col("node").alias("file")),
        "core": core.join(edge_chain, "id").join(named, "component").select("chain_id", F.col("id").alias("relation_id")),
    }
