"""Retrieval: vector top-k, context assembly, term scores, tiered prefix match."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import quote, when
from linkweave.session import cut_lineage


def with_norm(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Doubles and length of a vector, computed once per row."""
    wide = vectors.withColumn("vector", F.col(column).cast("array<double>"))
    return wide.withColumn("norm", F.expr("sqrt(aggregate(vector, 0D, (a, x) -> a + x * x))"))


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The k chunks most similar to one query; each task keeps its own k before they are merged."""
    k = max(1, min(k, 50))
    size = sum(x * x for x in query) ** 0.5
    literal = "array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")"
    dot = f"aggregate(zip_with(vector, {literal}, (a, b) -> a * b), 0D, (a, x) -> a + x)"
    scored = with_norm(vectors).withColumn("similarity", F.expr(f"round({dot} / (norm * {size!r}D), 6)"))
    return scored.drop("vector", "norm").orderBy(F.desc("similarity"), key).limit(k)


BLOCK_QUERIES = 1 << 14
"""Queries of a meeting, at about."""

BLOCK_CHUNKS = 1 << 15
"""Chunks of a meeting, at about."""

STEP_QUERIES, STEP_CHUNKS = 1024, 512
"""Rows and columns of the products of matrices that a meeting is worked out by."""

SLACK = 2e-5
"""More than single precision and the rounding to six digits can change a similarity by."""


def _matrix(vectors: pa.Array, count: int) -> np.ndarray:
    """Rows of unit length of a list array. All vectors have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(count, -1) if count else flat.reshape(0, 1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _ranked(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (row, id, score) of each row, equal scores by id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], ids[first], scores[first]


def _nearest(asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, chunks: np.ndarray, k: int, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, similarity) of the k nearest chunks of each query; a query is not its own result.

    Single precision picks what may be among the k best so far, double precision ranks it. `wanted(low, high)`: which queries meet the
    chunks from low to high; None for all.
    """
    quick, quick_chunks = queries.astype(np.float32), chunks.astype(np.float32)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(asked), -2.0, np.float32)
    for low in range(0, len(ids), STEP_CHUNKS):
        high = min(low + STEP_CHUNKS, len(ids))
        rows = wanted(low, high)
        some = np.arange(len(asked)) if rows is None else np.flatnonzero(rows)
        if not len(some):
            continue
        scores = (quick if rows is None else quick[some]) @ quick_chunks[low:high].T
        bound, fresh = least[some], np.flatnonzero(least[some] <= -2)
        if len(fresh) and high - low > k:  # one more than k, for a query may be there itself
            bound[fresh] = np.partition(scores[fresh], high - low - k - 1, axis=1)[:, high - low - k - 1] - SLACK
        q, c = np.nonzero(scores >= bound[:, None])
        q, c = some[q], c + low
        other = asked[q] != ids[c]
        q, c = q[other], c[other]
        if not len(q):
            continue
        exact = np.round(np.einsum("ij,ij->i", queries[q], chunks[c]), 6)
        best = _ranked(*(np.concatenate(x) for x in zip(best, (q, ids[c], exact), strict=True)), k)
        last = np.flatnonzero(np.bincount(best[0], minlength=len(asked)) == k)
        least[last] = best[2][np.searchsorted(best[0], last, "right") - 1] - SLACK
    return asked[best[0]], best[1], best[2]


def _vectors(rows: DataFrame, key: str) -> DataFrame:
    """(id, vector) of rows with an embedding, in the precision it has."""
    kind = rows.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return rows.select(F.col(key).cast("long").alias("id"), vector.alias("vector")).where("vector IS NOT NULL")


def _met(chunks: DataFrame, asked: DataFrame, k: int, key: str, query_key: str, plan: HyperplanePlan | None = None) -> DataFrame:
    """The k best of each query over all meetings of chunks (id, vector, part) and queries (id, vector, part, block)."""
    schema = pa.schema([(query_key, pa.int64()), (key, pa.int64()), ("similarity", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (queries, asked), (chunks, ids) = ((_matrix(t["vector"].combine_chunks(), t.num_rows), t["id"].to_numpy()) for t in (left, right))
            place = (plan.codes(queries), plan.codes(chunks)) if plan else (np.zeros(len(asked)), np.zeros(len(ids)))
            by_query, by_chunk = np.lexsort((asked, place[0])), np.lexsort((ids, place[1]))
            queries, asked, chunks, ids, codes = queries[by_query], asked[by_query], chunks[by_chunk], ids[by_chunk], place[1][by_chunk]
            for low in range(0, len(asked), STEP_QUERIES):
                some = queries[low : low + STEP_QUERIES]
                lists = plan.lists(some) if plan else None
                wanted = (lambda a, b, lists=lists: lists[:, np.unique(codes[a:b])].any(axis=1)) if plan else lambda a, b: None
                found.append(_nearest(asked[low : low + STEP_QUERIES], some, ids, chunks, k, wanted))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table(columns, schema=schema)

    cells = [rows.groupBy("part", "block") for rows in (asked, chunks)]
    best = cells[0].cogroup(cells[1]).applyInArrow(meet, f"{query_key} long, {key} long, similarity double")
    return best.selectExpr("*", f"row_number() OVER (PARTITION BY {query_key} ORDER BY similarity DESC, {key}) AS rank").where(f"rank <= {k}")


def vector_top_k_many(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id"
) -> DataFrame:
    """Top-k of many queries over all chunks, exact, without forming a pair row.

    Chunks are dealt into parts and queries into blocks of bounded size; each part meets each block in a group of its own, which is worked
    out by small products of matrices and leaves k rows a query; only those are ranked again. Nothing but two counts reaches the driver. The
    time grows with chunks x queries, the memory of a task does not grow.
    """
    chunks, asked = _vectors(vectors, key), _vectors(queries, query_key)
    parts, blocks = max(1, -(-chunks.count() // BLOCK_CHUNKS)), max(1, -(-asked.count() // BLOCK_QUERIES))
    dealt = [F.pmod(F.xxhash64("id"), F.lit(n)) for n in (parts, blocks)]
    every = [F.expr(f"explode(sequence(0L, {n - 1}L))") for n in (parts, blocks)]
    return _met(
        chunks.withColumn("part", dealt[0]).withColumn("block", every[1]), asked.withColumn("block", dealt[1]).withColumn("part", every[0]),
        k, key, query_key,
    )


@dataclass(frozen=True)
class HyperplaneRules:
    bucket: int = 64
    """Chunks a list to aim at; sets the number of planes from the number of chunks."""
    most_planes: int = 10
    """Bound on the planes: a query weighs all lists, so 1024 at most."""
    recall: float = 0.95
    """Share of the exact neighbours of the sampled queries that the lists looked into must hold."""
    sample: int = 256
    """Queries whose exact neighbours are found to fit the number of lists looked into."""
    seed: int = 7


@dataclass
class HyperplanePlan:
    """Planes, the chunks of each list (the sides of the planes they lie on) and how many lists a query looks into."""

    planes: np.ndarray
    sizes: np.ndarray
    probes: int = 1

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) // BLOCK_CHUNKS
        self.parts = np.maximum(1, -(-self.sizes // BLOCK_CHUNKS))
        """A list stands in one part with its neighbours; one of more than BLOCK_CHUNKS chunks is spread over several."""

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.planes > 0) @ (1 << np.arange(self.planes.shape[1], dtype=np.int64))

    def costs(self, rows: np.ndarray) -> np.ndarray:
        """How far each row lies from each list: squared distances to the planes between them; lists without chunks are endlessly far."""
        side = rows @ self.planes
        bits = (np.arange(len(self.sizes))[:, None] >> np.arange(self.planes.shape[1])) & 1
        cost = np.where(side > 0, side, 0) ** 2 @ (1 - bits).T + np.where(side > 0, 0, side) ** 2 @ bits.T
        return np.where(self.sizes[None, :] > 0, cost, np.inf)

    def lists(self, rows: np.ndarray) -> np.ndarray:
        """Which lists each row looks into."""
        cost = self.costs(rows)
        far = np.partition(cost, self.probes - 1, axis=1)[:, self.probes - 1]
        return (cost <= far[:, None]) & np.isfinite(cost)

    def chunk_parts(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        code = self.codes(rows)
        turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[code] + (turn % self.parts[code].astype(np.uint64)).astype(np.int64)

    def query_parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the parts that hold a list each row looks into."""
        holds = np.zeros((len(self.sizes), int((self.first + self.parts).max())), np.float32)
        for code in np.flatnonzero(self.sizes):
            holds[code, self.first[code] : self.first[code] + self.parts[code]] = 1
        return np.nonzero(self.lists(rows).astype(np.float32) @ holds)


def hyperplane_plan(chunks: DataFrame, asked: DataFrame, k: int, rules: HyperplaneRules) -> HyperplanePlan | None:
    """Planes for chunks (id, vector) and the number of lists that hold `rules.recall` of the exact neighbours of some queries.

    The driver holds the sizes of at most 1024 lists, and the sampled queries with their neighbours.
    """
    total = chunks.count()
    sample = cut_lineage(asked.orderBy(F.xxhash64("id"), "id").limit(rules.sample), "sample")
    listed = sample.toArrow()
    if not listed.num_rows or not total:
        return None
    rows = _matrix(listed["vector"].combine_chunks(), listed.num_rows)
    bits = min(rules.most_planes, rows.shape[1], max(1, math.ceil(math.log2(max(total, 2) / rules.bucket))))
    planes = np.linalg.qr(np.random.default_rng(rules.seed).standard_normal((rows.shape[1], bits)))[0]
    plan = HyperplanePlan(planes, np.ones(1 << bits, np.int64))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plan.codes(_matrix(batch.column(1), batch.num_rows)))], names=["code"])

    sizes = np.zeros(1 << bits, np.int64)
    for row in chunks.select("id", "vector").mapInArrow(place, "code long").groupBy("code").count().collect():
        sizes[row["code"]] = row["count"]
    plan = HyperplanePlan(planes, sizes)
    exact = vector_top_k_many(
        chunks.withColumnRenamed("vector", "embedding"), sample.selectExpr("id AS query_id", "vector AS embedding"), k, "id", "query_id"
    ).select("query_id", "id")
    near = exact.join(chunks, "id").select("query_id", "vector").toArrow()
    order = np.argsort(listed["id"].to_numpy())
    at = order[np.searchsorted(listed["id"].to_numpy(), near["query_id"].to_numpy(), sorter=order)]
    costs = plan.costs(rows)
    found = plan.codes(_matrix(near["vector"].combine_chunks(), near.num_rows))
    before = np.sort((costs[at] < costs[at, found][:, None]).sum(axis=1))  # lists nearer than that of a neighbour
    return HyperplanePlan(planes, sizes, 1 + int(before[math.ceil(rules.recall * len(before)) - 1]) if len(before) else 1)


def vector_top_k_probed(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", rules: HyperplaneRules = HyperplaneRules()
) -> DataFrame:
    """Top-k of many queries among the chunks of the lists nearest to them, by their exact similarity.

    Every chunk stands in the list of its sides of some planes. How many lists a query looks into is fitted on a bounded sample of the
    queries, whose exact neighbours are found: few where vectors lie in groups, half of all and more where they have no structure. Parts of
    neighbouring lists meet blocks of the queries that look into them, as in vector_top_k_many, and no pair is a row. A few neighbours may
    be missed (see vector_recall).
    """
    chunks, asked = _vectors(vectors, key), _vectors(queries, query_key)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    plan = hyperplane_plan(chunks, asked, k, rules)
    if plan is None:
        return vector_top_k_many(vectors, queries, k, key, query_key)

    def chunk_parts(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = plan.chunk_parts(_matrix(batch.column(1), len(ids)), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts)], names=["id", "vector", "part"])

    def query_parts(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, STEP_QUERIES):
                some = batch.slice(low, STEP_QUERIES)
                row, part = plan.query_parts(_matrix(some.column(1), some.num_rows))
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(part)], names=["id", "vector", "part"])

    kinds = [f"id long, vector {rows.schema['vector'].dataType.simpleString()}, part long" for rows in (chunks, asked)]
    return _met(
        chunks.mapInArrow(chunk_parts, kinds[0]).withColumn("block", F.expr(f"explode(sequence(0L, {blocks - 1}L))")),
        asked.mapInArrow(query_parts, kinds[1]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), k, key, query_key, plan,
    )


def vector_recall(exact: DataFrame, found: DataFrame, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """(wanted, met, recall): how many of the exact neighbours an approximate search has found."""
    both = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("met")).selectExpr("*", "met / greatest(wanted, 1) AS recall")


def assemble_context(hits: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Ranked chunks (rank, title, similarity, document_id, chunk_id, text) as one text per group.

    A group holds at most fifty chunks, the limit of a search.
    """
    # Fixed value: layout of one source in the context text.
    layout = "[来源 %d]\\n标题：%s\\n相关性：%s\\ndocument_id：%s\\nchunk_id：%s\\n正文：\\n%s"
    part = (
        f"format_string('{layout}', rank, coalesce(nullif(title, ''), '未知'), string(similarity), string(document_id),"
        " string(chunk_id), coalesce(text, ''))"
    )
    parts = hits.selectExpr(*(group or []), "rank", f"{part} AS part")
    joined = F.expr("array_join(transform(array_sort(collect_list(struct(rank, part))), p -> p.part), '\\n\\n---\\n\\n') AS context")
    return parts.groupBy(*(group or [])).agg(joined)


def term_search(
    entries: DataFrame, query: str, offset: int = 0, limit: int = 10, ordinal: str = "ordinal"
) -> DataFrame:
    """Entries (name, description) by term score: 30 a term in the name, 10 in the description, 1000 exact.

    Without a query all entries come in order of kind and name.
    """
    offset, limit = max(0, offset), max(1, min(limit, 20))
    folded = query.lower().strip()
    terms = [t for t in folded.split() if t]
    if terms:
        gains = [
            when((f"contains(lower(name), {quote(t)})", "30"), (f"contains(lower(description), {quote(t)})", "10"), otherwise="0")
            for t in terms
        ]
        total_gain = " + ".join(gains)
        exact = f"if(lower(name) = {quote(folded)}, 1000, 0)"
        rows = entries.selectExpr("*", f"{total_gain} AS gain").where("gain > 0").selectExpr(
            "* EXCEPT (gain)", f"gain + {exact} AS score"
        )
        order = [F.desc("score"), F.col(ordinal)]
    else:
        rows = entries.selectExpr("*", "0 AS score")
        order = [F.col("kind"), F.expr("lower(name)")]
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    step = f"if({offset + limit} < total, {offset + limit}, NULL)"
    return page.withColumn("total", total.scalar()).selectExpr("*", f"{step} AS next_offset")


def mention_tier(name: str, path: str, query: str) -> str:
    """0 equal name, 1 name starts, 2 path starts, 3 name contains, 4 path contains, -1 none."""
    q = quote(query.strip().lower())
    return when(
        (f"lower({name}) = {q}", "0"), (f"startswith(lower({name}), {q})", "1"), (f"startswith(lower({path}), {q})", "2"),
        (f"contains(lower({name}), {q})", "3"), (f"contains(lower({path}), {q})", "4"), otherwise="-1",
    )


def mention_search(files: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Files (name, path) that fit a typed prefix, best tier first."""
    hits = files.selectExpr("*", f"{mention_tier('name', 'path', query)} AS tier").where("tier >= 0")
    ordered = hits.orderBy("tier", "path")
    return ordered.limit(limit) if limit else ordered
