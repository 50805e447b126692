"""Near-duplicate documents: MinHash signatures in bands, verified links, and connected components.

1. A pass over the texts gives each document's set of word shingles a 128-bit name, a signature of universal-hash minima
   and one value a band. Documents of equal sets are one node from here on, so copies cost a count.
2. Nodes that agree in a band share a slot. Slots are never spelled out as pairs. First one pivot of each slot, the same one in
   most slots of a group of copies, meets the other members; pairs whose signatures agree enough are verified on the
   full sets, and links become components. What then shares a slot across components, without its pivot, is compared in blocks
   of nodes: those outside a slot's largest component with that component, and with each other. A block pair
   is one row, its links are counted by a matrix product of its sets, and only links between components come out.
   So a pair that shares a slot is either tied by links or was compared.
3. With 50 bands of 6 rows, a pair of similarity 0.8 misses all bands with a chance of 3 in 10 million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.components import star_components
from linkweave.llm.textbytes import LOWER, Words, mixed, pieces, runs, text_bytes
from linkweave.session import cut_lineage


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    """Words a shingle; a shorter text is one shingle of all its words."""
    percent: int = 80
    """Two documents are linked if 100 * intersection >= percent * union."""
    bands: int = 50
    rows: int = 6
    slack: float = 0.12
    """Pairs whose signatures agree in less than percent/100 - slack are not verified (five standard deviations)."""
    block: int = 128
    """Nodes a block, about."""


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` words."""
    words = Words(*text_bytes(texts))
    [hashes] = words.hashes(LOWER)
    owner, counts = words.owner, words.counts
    place, shingles = runs(hashes, owner, width)
    ends = np.searchsorted(place, np.arange(len(counts) + 1))
    out = []
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if 0 < counts[k] < width:
            own = hashes[words.bounds[k] : words.bounds[k + 1]]
            out.append(runs(own, np.zeros(len(own), np.int64), len(own))[1])
        else:
            out.append(np.unique(shingles[a:b]))
    return out


class Signer:
    """Minima of bands * rows universal hashes a * x + b (mod 2^32) over the high half of the shingle hashes."""

    def __init__(self, rules: NearRules):
        random = np.random.default_rng(11)
        size = rules.bands * rules.rows
        self.rules = rules
        self.a = random.integers(0, 1 << 31, size, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 1 << 32, size, np.uint32)[:, None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 512):
            hashed = self.a * x[k : k + 512]
            hashed += self.b
            np.minimum(low, hashed.min(axis=1), out=low)
        return low

    def slots(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit value for each band, unlike for different bands."""
        rows = minima.reshape(self.rules.bands, self.rules.rows).astype(np.uint64)
        total = np.arange(1, self.rules.bands + 1, dtype=np.uint64)
        for k in range(self.rules.rows):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return total.view(np.int64)


def _signed(texts: DataFrame, rules: NearRules) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(rules)
        for whole in batches:
            for batch in pieces(whole, "text"):
                names, sizes, signatures, slots = [], [], [], []
                for shingles in shingle_sets(batch.column("text"), rules.words):
                    minima = signer.minima(shingles)
                    sizes.append(len(shingles))
                    names.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    signatures.append((minima & np.uint32(0xFF)).astype(np.uint8).tobytes())
                    slots.append(signer.slots(minima))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                        pa.array(signatures, pa.binary()), pa.array(slots, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "name", "signature", "slots"],
                )

    return texts.mapInArrow(sign, "doc_id long, n_shingles long, name binary, signature binary, slots array<long>")


def _sets(texts: DataFrame, rules: NearRules) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = [x.tobytes() for x in shingle_sets(batch.column("text"), rules.words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(listed, "node long, shingles binary")


def _beside(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the values of both ends."""
    for end in ("a", "b"):
        pairs = pairs.join(values.select(F.col("node").alias(end), F.col(value).alias(f"{end}_{value}")), end)
    return pairs


def _alike(pairs: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs whose signatures agree enough; an eighth byte in 256 agrees by chance."""
    least = rules.percent / 100 - rules.slack

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a_signature", "b_signature"))
                agree = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                yield batch.select(["a", "b"]).filter(pa.array(agree >= least))

    return pairs.select("a", "b", "a_signature", "b_signature").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs that are linked on their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_shingles"), batch.column("b_shingles"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= rules.percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_shingles", "b_shingles").mapInArrow(compare, "a long, b long")


def _labelled(slots: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Slots with each node's component and that component's size."""
    if labels is None:
        return slots.selectExpr("slot", "node", "node AS component", "1L AS size")
    sized = labels.join(labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    return slots.join(sized, "node", "left").selectExpr(
        "slot", "node", "coalesce(component, node) AS component", "coalesce(size, 1) AS size"
    )


def _split(rows: DataFrame) -> DataFrame:
    """Rows of the slots that hold two components or more."""
    return rows.join(_several(rows), "slot", "left_semi")


def _blocks(nodes: DataFrame, group: str, rules: NearRules) -> DataFrame:
    """(group, part, members): the nodes of each group in blocks of a bounded size. nodes: (group, node, component, shingles)."""
    sized = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("__n") / rules.block))
    return nodes.join(sized, group).groupBy(group, part.alias("part")).agg(
        F.collect_list(F.struct("node", "component", "shingles")).alias("members")
    )


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y."""
    common = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    held = []
    for sets in (x, y):
        flags = np.zeros((len(sets), len(common)), np.float32)
        for k, one in enumerate(sets):
            at = np.searchsorted(common, one)
            ok = at < len(common)
            ok[ok] = common[at[ok]] == one[ok]
            flags[k, at[ok]] = 1
        held.append(flags)
    return (held[0] @ held[1].T).astype(np.int64)


def _block_links(pairs: DataFrame, rules: NearRules) -> DataFrame:
    """Links (a, b) between different components of two blocks (left, right)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: set[tuple[int, int]] = set()
            for sides in zip(batch.column("left"), batch.column("right"), strict=True):
                nodes, parts, sets = [], [], []
                for side in sides:
                    rows = side.values
                    nodes.append(rows.field("node").to_numpy(zero_copy_only=False))
                    parts.append(rows.field("component").to_numpy(zero_copy_only=False))
                    sets.append([np.frombuffer(v.as_buffer(), np.uint64) for v in rows.field("shingles")])
                shared = shared_counts(*sets)
                size = [np.array([len(v) for v in one]) for one in sets]
                linked = 100 * shared >= rules.percent * (size[0][:, None] + size[1][None, :] - shared)
                linked &= parts[0][:, None] != parts[1][None, :]
                found: set[tuple[int, int]] = set()
                for i, j in zip(*np.nonzero(linked), strict=True):
                    tie = (int(parts[0][i]), int(parts[1][j]))
                    if tie not in found:  # one link ties two components
                        found.add(tie)
                        links.add((int(nodes[0][i]), int(nodes[1][j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(links)], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.select("left", "right").mapInArrow(compare, "a long, b long")


def _residual_links(rows: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Links between components that share a slot. rows: (slot, node, component, size) of the slots with several components."""
    main = rows.groupBy("slot").agg(F.max(F.struct("size", "component")).alias("m")).select("slot", F.col("m.component").alias("main"))
    others = cut_lineage(rows.join(main, "slot").where("component <> main"), "others")
    # those outside with the slot's main component: each component's members once, whatever the number of its slots
    outside = others.select(F.col("main").alias("group"), "node", "component").distinct().join(sets, "node")
    mains = rows.select("node", "component").distinct().join(others.select(F.col("main").alias("component")).distinct(), "component", "left_semi")
    inside = mains.withColumn("group", F.col("component")).join(sets, "node")
    left = _blocks(outside, "group", rules).select("group", F.col("members").alias("left"))
    right = _blocks(inside, "group", rules).select("group", F.col("members").alias("right"))
    # those outside with each other
    beside = _blocks(others.select("slot", "node", "component").join(_several(others), "slot", "left_semi").join(sets, "node"), "slot", rules)
    beside = cut_lineage(beside, "beside")
    ways = beside.select("slot", F.col("part").alias("p"), F.col("members").alias("left")).join(
        beside.select("slot", F.col("part").alias("q"), F.col("members").alias("right")), "slot"
    ).where("p <= q")
    return _block_links(left.join(right, "group"), rules).unionAll(_block_links(ways, rules)).distinct()


def _several(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("slot")


def node_components(slots: DataFrame, signatures: DataFrame, sets: DataFrame, ties: DataFrame, rules: NearRules) -> DataFrame | None:
    """(node, component) of all nodes with a link; None without any link. ties: links (a, b) that are known before."""
    turn = F.xxhash64("node")
    pivots = slots.groupBy("slot").agg(F.min(F.struct(turn.alias("turn"), "node")).alias("p")).select("slot", F.col("p.node").alias("pivot"))
    pivots = cut_lineage(pivots, "pivots")
    met = slots.join(pivots, "slot").where("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    ).distinct()
    near = cut_lineage(_alike(_beside(met, signatures, "signature"), rules), "near")
    links = cut_lineage(_verified(_beside(near, sets, "shingles"), rules).unionAll(ties), "links")
    labels = None if links.isEmpty() else cut_lineage(star_components(links), "labels")
    rest = slots.join(pivots.select("slot", F.col("pivot").alias("node")), ["slot", "node"], "left_anti")
    rows = cut_lineage(_split(_labelled(rest, labels)), "split-slots")
    if rows.isEmpty():
        return labels
    more = cut_lineage(_residual_links(rows, sets, rules), "residual-links")
    return labels if more.isEmpty() else cut_lineage(star_components(links.unionAll(more)), "labels")


def _own_ties(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of an id that has several texts. Of most ids nothing passes the first step."""
    several = linked.groupBy("doc_id").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low < high").select("doc_id")
    held = linked.join(several, "doc_id", "left_semi").select("doc_id", "name").distinct().join(nodes.select("name", "node"), "name")
    low = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    return held.join(low, "doc_id").where("a < node").selectExpr("a", "node AS b").distinct()


def near_duplicates(documents: DataFrame, rules: NearRules = NearRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest doc_id that links reach.

    NULL and blank texts have no shingles and no links. Rows of one doc_id count as one document whose texts are all
    linked; a row of a NULL id stays alone, is kept and has no component. Other columns are left out.
    """
    texts = documents.select(documents[key].cast("long").alias("doc_id"), documents[text].cast("string").alias("text"))
    signed = cut_lineage(_signed(texts, rules), "signed")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = cut_lineage(
        linked.groupBy("name").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("slots").alias("slots")), "nodes"
    )
    each = nodes.select("node", F.explode("slots").alias("slot"))
    shared = each.groupBy("slot").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    slots = cut_lineage(each.join(shared.select("slot"), "slot", "left_semi").select("slot", "node"), "slots")
    members = slots.select(F.col("node").alias("doc_id")).distinct()
    named = nodes.join(members, nodes["node"] == members["doc_id"], "left_semi").select("node", "signature")
    sets = cut_lineage(_sets(texts.join(members, "doc_id", "left_semi").distinct(), rules), "sets")
    labels = node_components(slots, named, sets, _own_ties(linked, nodes), rules)
    placed = nodes.select("name", "node")
    if labels is not None:
        placed = placed.join(labels, "node", "left").select("name", F.coalesce("component", "node").alias("component"))
    else:
        placed = placed.select("name", F.col("node").alias("component"))
    return signed.select("doc_id", "n_shingles", "name").join(placed, "name", "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(documents: DataFrame, rules: NearRules = NearRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group of near copies: that of the smallest id. Of repeated rows of an id one is
    kept (the smallest in its columns' order); rows of a NULL id are all kept."""
    kept = near_duplicates(documents, rules, key, text).where("kept").select(F.col("doc_id").alias(key)).distinct()
    rank = "row_number() OVER (PARTITION BY %s ORDER BY %s)" % (f"`{key}`", ", ".join(f"hash(`{c}`), `{c}`" if c == text else f"hash(`{c}`)" for c in documents.columns))
    first = documents.where(F.col(key).isNotNull()).join(kept, key, "left_semi").withColumn("__rank", F.expr(rank)).where("__rank = 1").drop("__rank")
    return first.select(documents.columns).unionByName(documents.where(F.col(key).isNull()))
