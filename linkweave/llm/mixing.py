"""Interleaving sources to target weights by Pfair scheduling.

Time is cut into slots, each for one block of rows. With weights of a_i in Q slots, block j of source i (from 0) is
released at floor(j Q / a_i) and due at ceil((j + 1) Q / a_i); in each slot the released block that is due first goes. All
blocks then go in time, so after any slot each source is less than one block away from its target. Weights being
whole numbers of Q, the schedule repeats after Q slots: one period is worked out on the driver.

A source that has run out leaves the schedule: a new stretch begins, in which the weights of those that have rows left are
whole numbers of a period of its own. So every row has a slot. Rows are placed by a join with the periods of all stretches,
whose size depends on the number of sources, not on the size of the data.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MixRules:
    block_rows: int = 16
    period: int = 1_000
    """Slots a period, at least ten a source: the resolution of the weights."""
    power: float = 0.5
    """Without given weights a source's weight is its number of rows to this power."""
    max_sources: int = 20_000
    """Bound on the sources, so on what the driver holds and broadcasts; more are an error."""
    bucket_rows: int = 4_096
    """Rows of a source are numbered in buckets of about this size, so no source is one task."""
    leave_at_once: int = 32
    """A stretch ends when one in so many of its sources, at least one, has run out; the slots of others stay empty till then."""


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole numbers that add up to the period, at least 1 each, by largest remainders (ties by name)."""
    used = {s: w for s, w in sorted(weights.items()) if w > 0}
    if not used or len(used) > period:
        raise ValueError("give a weight above zero to one source at least, and no more sources than slots")
    total = sum(used.values())
    free = period - len(used)
    exact = {s: w / total * free for s, w in used.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def pfair_period(parts: dict[str, int]) -> list[tuple[str, int]]:
    """(source, its how-manieth block) for each slot of a period, earliest deadline first among the released blocks."""
    period = sum(parts.values())
    waiting = [(0, -(-period // a), s, 0) for s, a in parts.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * period // parts[s], -(-(j + 2) * period // parts[s]), s, j + 1))
    return out


@dataclass
class Plan:
    """The stretches: of each source that has blocks in one, its first block there and its parts; and the slots of each period."""

    first_end: int
    """The first slot whose source has run out."""
    shares: pa.Table
    slots: pa.Table


def planned(weights: dict[str, float], blocks: dict[str, int], rules: MixRules) -> Plan:
    """Stretches until all blocks of all sources with a weight have a slot; sources without blocks end the first one."""
    names = sorted(weights)
    code = {s: k for k, s in enumerate(names)}
    left = np.array([blocks.get(s, 0) for s in names], np.int64)
    done, base, first_end, live = np.zeros(len(names), np.int64), 0, None, names
    shares, slots = [], []
    while live:
        parts = whole_weights({s: weights[s] for s in live}, max(rules.period, 10 * len(live)))
        period, ids = sum(parts.values()), np.array([code[s] for s in parts])
        size = np.array(list(parts.values()))
        schedule = pfair_period(parts)
        who, nth = np.array([code[s] for s, _ in schedule]), np.array([j for _, j in schedule])
        begin = np.zeros(len(names), np.int64)
        begin[ids] = np.cumsum(size) - size
        at = np.zeros(period, np.int64)
        at[begin[who] + nth] = np.arange(period)
        # the first slot that each source cannot fill
        ends = left[ids] // size * period + at[begin[ids] + left[ids] % size]
        length = int(np.sort(ends)[-(-len(live) // rules.leave_at_once) - 1])
        first_end = int(ends.min()) if first_end is None else first_end
        used = np.minimum(left[ids], length // period * size + np.bincount(who[: length % period], minlength=len(names))[ids])
        some = used > 0
        k = np.full(some.sum(), len(slots))
        shares.append((ids[some], k, done[ids[some]], size[some]))
        shown = min(length, period)
        slots.append((who[:shown], np.full(shown, len(slots)), nth[:shown], base + np.arange(shown), np.full(shown, period)))
        done[ids] += used
        left[ids] -= used
        base += length
        live = [s for s in live if left[code[s]]]
    owner, *fields = (np.concatenate(x) for x in zip(*shares, strict=True))
    order = np.argsort(owner, kind="stable")
    stretches = pa.StructArray.from_arrays([pa.array(x[order]) for x in fields], names=["stretch", "first", "parts"])
    offsets = np.searchsorted(owner[order], np.arange(len(names) + 1)).astype(np.int32)
    return Plan(
        first_end,
        pa.table({"__source": names, "__code": np.arange(len(names)), "__stretches": pa.ListArray.from_arrays(pa.array(offsets), stretches)}),
        pa.table(dict(zip(("__code", "__stretch", "__nth", "__slot", "__period"), (np.concatenate(x) for x in zip(*slots, strict=True)), strict=True))),
    )


def numbered(rows: DataFrame, have: dict[str, int], bucket_rows: int) -> DataFrame:
    """Adds __n, a row's place (from 0) in its __source, in the order of a hash of the row; have: rows of each source."""
    columns = [c for c in rows.columns if c != "__source"]
    sized = rows.sparkSession.createDataFrame([(s, -(-n // bucket_rows)) for s, n in have.items()], "__source string, __buckets long")
    turn = F.xxhash64(*[f"`{c}`" for c in columns])
    # a row a source, which max_sources bounds
    rows = rows.join(F.broadcast(sized), "__source").withColumn("__turn", turn)
    rows = rows.withColumn("__bucket", F.expr("pmod(__turn, __buckets)")).drop("__buckets")
    before = rows.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__rows")).selectExpr(
        "__source", "__bucket",
        "coalesce(sum(__rows) OVER (PARTITION BY __source ORDER BY __bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __before",
    )
    # a row for each 4096 rows of a source at most
    within = rows.withColumn("__row", F.expr("row_number() OVER (PARTITION BY __source, __bucket ORDER BY __turn)"))
    return within.join(before, ["__source", "__bucket"]).withColumn("__n", F.expr("__before + __row - 1")).drop(
        "__before", "__row", "__bucket", "__turn"
    )


OUTPUT = ("block", "slot", "position", "in_mix")


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, rules: MixRules = MixRules(), source: str = "source") -> DataFrame:
    """The rows with block, slot, position and in_mix; columns of these names are replaced.

    `position` orders the rows: at any point of it the sources that have rows left stand in target proportions, less than
    one block off since the last of them ran out (see leave_at_once for more than 32 sources). Without given weights all rows
    are in the mixture (in_mix). Given weights are a target for the whole: in_mix then ends before the first slot whose source
    has run out, and sources without a weight have no slot. A NULL source counts as the empty name. Rows of a source follow a
    hash of the row; repeated rows stand side by side.
    """
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c not in OUTPUT]
    rows = documents.select(*kept, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"))
    counts = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__rows"))
    listed = counts.limit(rules.max_sources + 1).collect()
    if len(listed) > rules.max_sources:
        raise ValueError(f"more than {rules.max_sources} sources")
    have = {r["__source"]: r["__rows"] for r in listed}
    whole = weights is None
    if whole:
        weights = {s: n**rules.power for s, n in have.items()}
    weights = {s: w for s, w in weights.items() if w > 0}
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in zip(OUTPUT, ("long", "long", "long", "boolean"), strict=True)]
    if not have or not weights:
        return documents.select(*kept, *empty[:3], F.lit(False).alias("in_mix"))
    plan = planned(weights, {s: -(-n // rules.block_rows) for s, n in have.items()}, rules)
    shares, slots = spark.createDataFrame(plan.shares), spark.createDataFrame(plan.slots)
    blocks = numbered(rows, have, rules.bucket_rows).withColumn("__block", F.expr(f"__n div {rules.block_rows}"))
    # a row a source
    blocks = blocks.join(F.broadcast(shares), "__source", "left").withColumn(
        "__at", F.expr("element_at(filter(__stretches, x -> x.first <= __block), -1)")
    )
    blocks = blocks.selectExpr(
        *(f"`{c}`" for c in kept), "__n", "__block", "__code", "__at.stretch AS __stretch",
        "(__block - __at.first) % __at.parts AS __nth", "(__block - __at.first) div __at.parts AS __turn",
    )
    placed = blocks.join(slots, ["__code", "__stretch", "__nth"], "left").withColumn("slot", F.expr("__turn * __period + __slot"))
    inside = F.col("slot").isNotNull() if whole else F.coalesce(F.col("slot") < plan.first_end, F.lit(False))
    return placed.select(
        *kept, F.col("__block").alias("block"), "slot",
        F.expr(f"slot * {rules.block_rows} + __n % {rules.block_rows}").alias("position"), inside.alias("in_mix"),
    )
