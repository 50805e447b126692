"""Merkle dataset manifest by butterfly exchange.

Every row is a leaf. Leaves are numbered by group and key and dealt out in aligned blocks of fanout^3, each the subtree of a node;
a block works out its own levels in one task. Then all blocks go up together, a round a level: the blocks whose numbers differ in one
digit to the base of the fanout swap the nodes they have reached, and each hashes the parent itself. So after the last round
every block holds the root and all siblings on its way there, and nothing has to come down again. Where the last
node of a level has fewer blocks than the others, the blocks without a partner of the same lower digits ask the ones it has
in turn. Groups are the blocks' upper digits: the rounds go on over the sorted groups once each group is one node.

Texts are hashed where they are read and never shuffled; rounds work on one row a block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.operators.ordered import numbered
from linkweave.session import cut_lineage

FANOUT = 16
LEVELS = 3
"""Levels within a block, so it holds 4096 leaves at most."""

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "struct<before:string,after:string>"
"""A level of a proof: the siblings' digests on the left, and those on the right."""


def leaf_digest(*fields: str) -> Column:
    """SHA-256 of the fields (SQL): `-` for NULL, else the number of bytes, `:` and the value."""
    parts = [f"coalesce(concat(octet_length(string({x})), ':', string({x})), '-')" for x in fields]
    return F.expr(f"sha2(concat({', '.join(parts)}), 256)")


def folded(leaf: str, proof: str) -> Column:
    """The root that a leaf and its proof (SQL) lead to."""
    return F.expr(f"aggregate({proof}, {leaf}, (h, s) -> sha2(concat(s.before, h, s.after), 256))")


def siblings(proof: str) -> str:
    """All digests of a proof (SQL), level by level, left to right."""
    return f"array_join(transform({proof}, s -> concat(s.before, s.after)), '')"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """The levels of a block, leaves first, its node last. A group's only block stops at its root, others go all the way."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= levels:
        out.append([_digest("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def _placed(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Adds __q (the group's place), __b (the block), __blocks (of its group) and __n (the leaf's place) to rows of __group, __key and __leaf."""
    rows = numbered(rows, [F.col("__group").asc(), F.col("__key").asc(), F.col("__leaf").asc()], "__n")
    groups = rows.groupBy("__group").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__size"))
    groups = numbered(groups, [F.col("__group").asc()], "__q").withColumnRenamed("__group", "__name")
    size = fanout**levels
    return rows.join(groups, F.col("__group").eqNullSafe(F.col("__name"))).withColumns({
        "__n": F.expr("__n - __first"), "__b": F.expr(f"(__n - __first) div {size}"), "__blocks": F.expr(f"(__size + {size - 1}) div {size}"),
    }).drop("__name", "__first", "__size", "__group", "__key")


def _nodes(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(q, b, blocks, node): one row a block."""

    def seal(table: pa.Table) -> pa.Table:
        table = table.sort_by("__n")
        blocks = table.column("__blocks")[0].as_py()
        node = _levels(table.column("__leaf").to_pylist(), fanout, levels, blocks == 1)[-1][0]
        return pa.table({"q": table.column("__q")[:1], "b": table.column("__b")[:1], "blocks": [blocks], "node": [node]})

    return rows.select("__q", "__b", "__blocks", "__n", "__leaf").groupBy("__q", "__b").applyInArrow(seal, "q long, b long, blocks long, node string")


def _swapped(state: DataFrame, asked: DataFrame, fanout: int, turn: int) -> DataFrame:
    """One round. asked: (q, b, place, member, pq, pb): which block tells (q, b) about each member of its group; place: its own."""
    told = asked.join(state.select(F.col("q").alias("pq"), F.col("b").alias("pb"), "node"), ["pq", "pb"])
    heard = told.groupBy("q", "b").agg(F.min("place").alias("place"), F.expr("transform(array_sort(collect_list(struct(member, node))), x -> x.node) AS nodes"))
    return heard.join(state.select("q", "b", "blocks"), ["q", "b"]).selectExpr(
        "q", "b", "blocks", f"{turn} AS turn", "array_join(slice(nodes, 1, int(place)), '') AS before",
        f"array_join(slice(nodes, int(place) + 2, {fanout}), '') AS after", "sha2(array_join(nodes, ''), 256) AS node",
    )


def _group(own: str, width: str, span: int, fanout: int) -> tuple[str, str]:
    """Of a node, the one that number `own` of `width` has reached (SQL): its place in its group, and all members of the group."""
    node = f"{own} div {span}"
    first = f"({node} - ({node}) % {fanout})"
    return f"{node} - {first} AS place", f"explode(sequence({first}, least({first} + {fanout - 1}, ({width} - 1) div {span}))) AS member"


def _partner(own: str, width: str, span: int) -> str:
    """Which of the numbers below `member` tells `own` its node: the one with the same lower digits, or one of those there are."""
    return f"member * {span} + ({own} % {span}) % least({span}, {width} - member * {span})"


def exchanged(state: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(q, b, subroot, root, upper): what each block knows in the end. state: (q, b, blocks, node); upper: its proof above the block."""
    state = cut_lineage(state, "blocks")
    top = state.agg(F.max("blocks").alias("blocks"), (F.max("q") + 1).alias("groups")).first()
    if not top["blocks"]:
        return state.selectExpr("q", "b", "node AS subroot", "node AS root", f"cast(array() AS array<{STEP}>) AS upper")
    steps: list[DataFrame] = []

    def step(asked: DataFrame) -> DataFrame:
        steps.append(cut_lineage(_swapped(state, asked, fanout, len(steps)), "round"))
        return steps[-1].select("q", "b", "blocks", "node")

    span = 1
    while span < top["blocks"]:  # within the groups
        going = state.where(f"blocks > {span}").selectExpr("q", "b", "blocks", *_group("b", "blocks", span, fanout))
        risen = step(going.selectExpr("*", "q AS pq", f"{_partner('b', 'blocks', span)} AS pb"))
        state = risen.unionByName(state.where(f"blocks <= {span}"))
        span *= fanout
    subroots = state.selectExpr("q", "b", "node AS subroot")
    widths = state.where("b = 0").selectExpr("q AS pq", "blocks AS width")
    span = 1
    while span < top["groups"]:  # among the groups, any block of one speaks for it
        going = state.selectExpr("q", "b", *_group("q", str(top["groups"]), span, fanout))
        asked = going.selectExpr("*", f"{_partner('q', str(top['groups']), span)} AS pq").join(widths, "pq")
        state = step(asked.selectExpr("*", "b % width AS pb"))
        span *= fanout
    known = subroots.join(state.selectExpr("q", "b", "node AS root"), ["q", "b"])
    if not steps:
        return known.selectExpr("*", f"cast(array() AS array<{STEP}>) AS upper")
    told = steps[0].select("q", "b", "turn", "before", "after")
    for other in steps[1:]:
        told = told.unionByName(other.select("q", "b", "turn", "before", "after"))
    upper = told.groupBy("q", "b").agg(F.expr("transform(array_sort(collect_list(struct(turn, before, after))), x -> struct(x.before, x.after)) AS upper"))
    return known.join(upper, ["q", "b"], "left").selectExpr("q", "b", "subroot", "root", f"coalesce(upper, cast(array() AS array<{STEP}>)) AS upper")


OUTPUT = ("leaf", "subroot", "root", "proof")


def manifest(
    documents: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", carry: tuple[str, ...] = (),
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """(key, carried columns, leaf, subroot, root, proof) of every row; carried columns of the last four names are left out.

    Leaves ascend by key within their group, a NULL key first, leaves of equal keys by digest; equal rows are leaves side by side. A NULL
    group is one of its own, before the others. The proof lists the siblings of each level up to the root; an empty table has no rows.
    """
    kept = list(dict.fromkeys((key, *(c for c in carry if c not in OUTPUT))))
    rows = documents.select(
        *[documents[c].alias(f"__c{k}") for k, c in enumerate(kept)], documents[group].alias("__group"), documents[key].alias("__key"),
        leaf_digest(*[f"`{f}`" for f in fields]).alias("__leaf"),
    )
    rows = _placed(rows, fanout, levels)
    known = exchanged(_nodes(rows, fanout, levels), fanout)
    carried = [f for f in rows.schema.fields if f.name.startswith("__c")]
    schema = T.StructType(list(carried)).add("leaf", "string").add("subroot", "string").add("root", "string")
    proof = pa.struct([("before", pa.string()), ("after", pa.string())])

    def prove(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by("__n")
        below = _levels(table.column("__leaf").to_pylist(), fanout, levels, table.column("__blocks")[0].as_py() == 1)
        above = state.column("upper")[0].as_py()
        before, after, n = [], [], table.num_rows
        for i in range(n):
            for level, nodes in enumerate(below[:-1]):
                at = i // fanout**level
                first = at - at % fanout
                before.append("".join(nodes[first:at]))
                after.append("".join(nodes[at + 1 : first + fanout]))
            before += [s["before"] for s in above]
            after += [s["after"] for s in above]
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(proof))
        ends = pa.array([k * (len(below) - 1 + len(above)) for k in range(n + 1)], pa.int32())
        same = {c: pa.array([state.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        return pa.table({
            **{f.name: table.column(f.name) for f in carried}, "leaf": table.column("__leaf"), **same,
            "proof": pa.ListArray.from_arrays(ends, steps),
        })

    told = rows.groupBy("__q", "__b").cogroup(known.withColumnsRenamed({"q": "__q", "b": "__b"}).groupBy("__q", "__b"))
    levels_of = T.ArrayType(T.StructType().add("before", "string").add("after", "string"))
    proven = told.applyInArrow(prove, schema.add("proof", levels_of))
    return proven.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(kept)], *OUTPUT)


def tamper_checked(documents: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """Each row's leaf, subroot, root and proof digest, and whether the leaf of its `tampered` text still leads to the root."""
    rows = documents.withColumn("__tampered", tampered)
    found = leaf_digest(*["__tampered" if f == text else f"`{f}`" for f in fields])
    proven = manifest(rows.withColumn("__found", found), fields, key, group, ("__found",))
    return proven.withColumn("folded_root", folded("__found", "proof")).select(
        key, "leaf", "subroot", "root", F.expr(f"sha2({siblings('proof')}, 256)").alias("proof_sha256"), "folded_root",
        F.expr("folded_root = root").alias("verified"),
    )
