"""One pass over a table: what discovery wants to know of its join columns, from a single read.

A task keeps, for each column, a count, the registers of a distinct-count sketch and the k smallest fingerprints, and sends on the
rows that hold a seed value, fifty a value and column at most. All of that merges: counts add up, registers take their
maximum, small fingerprints are ranked again, and the first matches of the whole are among the first of the tasks. So what leaves
a task is bounded by the limits and not by its rows, and no value is shuffled that the result doesn't hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.config import Limits, ValueRules
from linkweave.functions.text import fingerprint, quote, stringify
from linkweave.functions.values import text_entities
from linkweave.operators.occurrences import ROW, join_cells, with_row_number
from linkweave.operators.sketches import bottom_k
from linkweave.session import spread

REGISTERS = 256
_FIELDS = pa.schema([("what", pa.string()), ("column", pa.string()), ("row_no", pa.int64()), ("value", pa.string()), ("n", pa.int64())])


class _Column:
    """What a task keeps of one column."""

    def __init__(self, k: int):
        self.k, self.count, self.registers = k, 0, np.zeros(REGISTERS, np.int64)
        self.kept: dict[str, tuple[int, str]] = {}
        self.bound = "g"  # above all hexadecimal digits

    def add(self, rows: pa.Array, values: pa.Array, digests: pa.Array, hashes: np.ndarray) -> None:
        """rows: the row numbers; digests: the first digits of the fingerprints; hashes: 64 bits, for the sketch."""
        self.count += len(rows)
        bits = hashes.view(np.uint64)
        rest = (bits >> np.uint64(8)).astype(np.float64)
        rank = np.where(rest > 0, 57 - np.frexp(rest)[1], 57)
        np.maximum.at(self.registers, (bits & np.uint64(REGISTERS - 1)).astype(np.int64), rank)
        near = pc.less(digests, self.bound)
        if not pc.any(near).as_py():
            return
        some = pa.table({"d": digests, "row": rows, "value": values}).filter(near)
        for d, row, value in zip(*(c.to_pylist() for c in some.group_by("d").aggregate([("row", "min"), ("value", "min")]).select(["d", "row_min", "value_min"]).columns), strict=True):
            old = self.kept.get(d)
            if old is None or row < old[0]:
                self.kept[d] = (row, value)
        if len(self.kept) > 2 * self.k:
            self.kept = {d: self.kept[d] for d in sorted(self.kept)[: self.k]}
            self.bound = max(self.kept)


class _Matches:
    """The first rows of a task with each seed value in each column."""

    def __init__(self, seeds: np.ndarray, columns: int, cap: int):
        self.seeds, self.cap, self.met, self.last = seeds, cap, np.zeros((columns, len(seeds)), np.int32), -1

    def rows(self, numbers: np.ndarray, valid: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
        """Which rows of a batch (their places) to send on."""
        if not len(self.seeds):
            return np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(numbers) <= 0) + 1  # another part of the table begins
        out = []
        for low, high in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if low < high and numbers[low] <= self.last:
                self.met[:] = 0  # the first of that part may come before those met
            for c, (ok, h) in enumerate(zip(valid, hashes, strict=True)):
                at = np.minimum(np.searchsorted(self.seeds, h[low:high]), len(self.seeds) - 1)
                hit = np.flatnonzero(ok[low:high] & (self.seeds[at] == h[low:high]))
                seed = at[hit]
                order = np.argsort(seed, kind="stable")
                ordered = seed[order]
                nth = np.empty(len(seed), np.int64)
                nth[order] = np.arange(len(seed)) - np.searchsorted(ordered, ordered)
                out.append(low + hit[nth + self.met[c, seed] < self.cap])
                self.met[c] += np.bincount(seed, minlength=len(self.seeds)).astype(np.int32)
            self.last = int(numbers[high - 1]) if low < high else self.last
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _entries(what: str, column: str, rows, values, n) -> pa.RecordBatch:
    size = len(rows)
    filled = [pa.array([x] * size, pa.string()) for x in (what, column)]
    return pa.RecordBatch.from_arrays(
        [*filled, pa.array(rows, pa.int64()), pa.array([None] * size, pa.string()) if values is None else values, pa.array(n, pa.int64())], schema=_FIELDS
    )


def _passing(names: list[str], k: int, seeds: np.ndarray, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, matches = [_Column(k) for _ in names], _Matches(seeds, len(names), cap)
        read = 0
        for batch in batches:
            numbers = batch.column("row_no")
            valid, hashes = [], []
            read += len(numbers)
            for i, kept in enumerate(columns):
                values, digests = batch.column(f"v{i}"), batch.column(f"d{i}")
                ok = pc.is_valid(values)
                valid.append(ok.to_numpy(zero_copy_only=False))
                hashes.append(batch.column(f"h{i}").to_numpy(zero_copy_only=False))
                if pc.any(ok).as_py():
                    kept.add(numbers.filter(ok), values.filter(ok), digests.filter(ok), hashes[-1][valid[-1]])
            rows = matches.rows(numbers.to_numpy(zero_copy_only=False), valid, hashes)
            for i, name in enumerate(names):
                own = rows[valid[i][rows]]
                if len(own):
                    yield _entries("match", name, numbers.take(pa.array(own)), batch.column(f"v{i}").take(pa.array(own)), np.zeros(len(own), np.int64))
        yield _entries("rows", "", [0], None, [read])
        for name, c in zip(names, columns, strict=True):
            if c.count:
                yield _entries("count", name, [0], None, [c.count])
                at = np.flatnonzero(c.registers)
                yield _entries("register", name, at, None, c.registers[at])
                best = [c.kept[d] for d in sorted(c.kept)[:k]]
                yield _entries("sample", name, [r for r, _ in best], pa.array([v for _, v in best], pa.string()), [0] * len(best))

    return run


@dataclass
class Scan:
    """The entries of one table that its pass left behind, written once."""

    table: str
    entries: DataFrame

    def _of(self, what: str) -> DataFrame:
        return self.entries.where(F.col("what") == what).select(F.lit(self.table).alias("table"), "column", "row_no", "value", "n")

    def sample(self, k: int) -> DataFrame:
        """(table, column, value, row_no, fingerprint): the k smallest fingerprints of each column and their first rows."""
        first = self._of("sample").groupBy("table", "column", "value").agg(F.min("row_no").alias("row_no"))
        return bottom_k(first.selectExpr("*", f"{fingerprint('value')} AS fingerprint"), k)

    def rows(self) -> DataFrame:
        """(table, rows): how many rows the pass read."""
        return self._of("rows").groupBy("table").agg(F.sum("n").alias("rows"))

    def cells(self) -> DataFrame:
        """(table, column, row_no, value) of all rows that may match; each match that counts is among them."""
        return self._of("match").drop("n")

    def cardinality(self) -> DataFrame:
        """(table, column, nonempty, distinct, ratio): counted cells and sketched distinct values."""
        counts = self._of("count").groupBy("table", "column").agg(F.sum("n").alias("nonempty"))
        merged = self._of("register").groupBy("table", "column", "row_no").agg(F.max("n").alias("rank"))
        sums = merged.groupBy("table", "column").agg(
            F.count(F.lit(1)).alias("used"), F.sum(F.expr("pow(2D, -rank)")).alias("inverse")
        )
        m = REGISTERS
        harmonic = f"{0.7213 / (1 + 1.079 / m)!r}D * {m * m} / (inverse + {m} - used)"
        sketched = sums.selectExpr("*", f"{harmonic} AS raw").selectExpr(
            "table", "column", f"if(raw <= {2.5 * m}D AND used < {m}, {m} * ln({m}D / ({m} - used)), raw) AS distinct"
        )
        return counts.join(sketched, ["table", "column"]).withColumn(
            "ratio", F.expr("round(least(1D, distinct / nonempty), 6)")
        )


def scan_table(
    df: DataFrame, columns: list[tuple[str, str]], rules: ValueRules = ValueRules(), limits: Limits = Limits(),
    k: int | None = None, seeds: np.ndarray | None = None, first_rows: int | None = None,
) -> DataFrame:
    """(what, column, row_no, value, n): the entries of one pass over the join columns; write them before use.

    seeds: sorted distinct 64-bit hashes of seed values; first_rows: only so many rows.
    """
    numbered = with_row_number(df)
    if first_rows is not None:
        numbered = numbered.where(F.col("row_no") <= first_rows)
    narrow = numbered.select("row_no", *[c for c, _ in columns])
    dealt = spread(narrow)
    # rows of a file come in order, dealt ones don't
    cells = join_cells(dealt if dealt is narrow else dealt.sortWithinPartitions("row_no"), columns, rules)
    wide = cells.selectExpr("row_no", *[f"`{c}` AS v{i}" for i, (c, _) in enumerate(columns)]).selectExpr(
        "*", *[f"left({fingerprint(f'v{i}')}, 24) AS d{i}" for i in range(len(columns))],
        *[f"xxhash64(v{i}) AS h{i}" for i in range(len(columns))],
    )
    run = _passing([c for c, _ in columns], k or limits.profile_size, seeds if seeds is not None else np.zeros(0, np.int64), limits.max_matches_per_seed)
    return wide.mapInArrow(run, "what string, column string, row_no long, value string, n long")


def scan_seed_table(df: DataFrame, columns: list[tuple[str, str]], rules: ValueRules = ValueRules()) -> DataFrame:
    """(what, column, source_kind, row_no, value, n): distinct cells, and the entities of the joined text of each row, of a small table.

    Reads all columns once. `column` is the label of an entity; row_no the first row, n the number of rows; what = 'rows' counts all.
    """
    names = [f.name for f in df.schema.fields if f.name != ROW]
    numbered = spread(with_row_number(df))
    texts = ", ".join(stringify(f"`{c}`", df.schema[c].dataType) for c in names)
    joined = numbered.selectExpr("row_no", *[f"`{c}`" for c, _ in columns], f"concat_ws('\t', filter(array({texts}), c -> c <> '')) AS __text")
    cells = join_cells(joined, columns, rules, ("__text",))
    entry = "named_struct('what', {what}, 'column', {column}, 'source_kind', {kind}, 'value', {value})"
    own = [entry.format(what="'cell'", column=quote(c), kind="''", value=f"`{c}`") for c, _ in columns]
    found = f"transform({text_entities('__text')}, e -> {entry.format(what="'text'", column='e.label', kind='e.source_kind', value='e.value')})"
    tally = entry.format(what="'rows'", column="''", kind="''", value="''")
    each = cells.selectExpr("row_no", f"inline(filter(concat(array({', '.join([tally, *own])}), {found}), e -> e.value IS NOT NULL))")
    return each.groupBy("what", "column", "source_kind", "value").agg(F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("n"))


def seed_hashes(seeds: DataFrame, table: str) -> np.ndarray:
    """Sorted distinct hashes of the seed values that other tables hold; the seed index bounds their number."""
    hashes = seeds.where(F.col("file") != table).select("probe_key").distinct().toArrow().column(0).to_numpy()
    return np.sort(hashes.astype(np.int64))
