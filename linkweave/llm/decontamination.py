"""Test items found again in training texts: rare n-gram seeds, then Smith-Waterman alignment of the words around them.

The items are taken in blocks whose words are bounded, so that a block may be broadcast; every block meets all
documents in two passes without a shuffle of texts. The first counts the documents that hold each n-gram of the block.
An item's seeds are those n-grams that are not far more frequent than the item's usual ones, so an item
always keeps at least half of its n-grams however often it was copied. The second pass aligns the item with the
words around each seed; copies with changed, added or left out words score less, but are found.

An n-gram is three words of four or five neighbours: which of them it leaves out is no part of it. So three words of the item meet
the same three of the text where a word between them was changed, put in or left out, and a copy need not keep any three words in a
row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.textbytes import MARKS, Words, mixed, pieces, text_bytes


@dataclass(frozen=True)
class LeakRules:
    least_words: int = 4
    """Items with fewer words are found, but say too little to remove a document for."""
    frequent: float = 4.0
    """An n-gram in more documents than so many times the item's median, and in over `few`, is no seed."""
    few: int = 20
    least_score: float = 0.5
    """Share of the score of a full copy from which a text counts as holding the item."""
    short_words: int = 8
    short_score: float = 0.85
    """The share asked of items with fewer words than that: nearly all of them."""
    stretch_words: int = 30
    """The score of so many words copied whole counts too, whatever the length of the item."""
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    block_words: int = 2_000_000
    """Bound on the words of the items that are broadcast at a time."""


ITEM_PICKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
TEXT_PICKS = (*ITEM_PICKS, (0, 2, 4))
"""Which neighbours make an n-gram. Of an item that scores half, two words in three stand: some pick of it is whole."""


def _picked(hashes: np.ndarray, owner: np.ndarray, pick: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the picked words at each place where they fit; the hash doesn't tell the pick."""
    n = len(hashes) - pick[-1]
    if n <= 0:
        return np.zeros(0, np.int64), hashes[:0]
    total = np.zeros(n, np.uint64)
    for k in pick:
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    fits = np.flatnonzero(owner[:n] == owner[pick[-1] :])
    return fits, mixed(total[fits] + np.uint64(len(pick)))


def _picks(words: int, picks: tuple = ITEM_PICKS) -> tuple:
    """The picks for items of so many words; one or two words are a pick of all."""
    return picks if words >= 3 else (tuple(range(words)),)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    words = Words(*text_bytes(texts, lower=True), MARKS)
    return words.hashes()[0], words.owner, words


@dataclass
class Items:
    """A block of items: ids, word hashes, and all n-grams with the item and place that hold them, sorted by n-gram."""

    ids: list
    words: list[np.ndarray]
    rules: LeakRules
    grams: np.ndarray = field(init=False)
    item: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)

    def __post_init__(self):
        grams, item, place = [], [], []
        for k, words in enumerate(self.words):
            for pick in _picks(len(words)) if len(words) else ():
                at, found = _picked(words, np.zeros(len(words), np.int64), pick)
                grams.append(found)
                item.append(np.full(len(found), k))
                place.append(at)
        grams, item, place = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((grams, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.picks = sorted({pick for w in self.words if len(w) for pick in _picks(len(w), TEXT_PICKS)})

    def keep(self, chosen: np.ndarray) -> None:
        self.grams, self.item, self.place = self.grams[chosen], self.item[chosen], self.place[chosen]

    def near(self) -> np.ndarray:
        """Tells most other n-grams apart by their low bits."""
        table = np.zeros(1 << 20, bool)
        table[self.grams & np.uint64(0xFFFFF)] = True
        return table

    def hits(self, hashes: np.ndarray, owner: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, first entry of that n-gram) of the n-grams of the block in the words of a batch."""
        at, entry = [], []
        for pick in self.picks:
            fits, grams = _picked(hashes, owner, pick)
            may = near[grams & np.uint64(0xFFFFF)]
            fits, grams = fits[may], grams[may]
            first = np.searchsorted(self.grams, grams)
            ok = first < len(self.grams)
            ok[ok] = self.grams[first[ok]] == grams[ok]
            at.append(fits[ok])
            entry.append(first[ok])
        return np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*entry, np.zeros(0, np.int64)])


def align(item: np.ndarray, text: np.ndarray, rules: LeakRules) -> tuple[int, int]:
    """(score, end) of the best local alignment; the end is the first place after it in the text, the earliest of ties."""
    row, steps = np.zeros(len(text) + 1, np.int64), -rules.gap * np.arange(len(text) + 1)
    best, end = 0, 0
    for word in item:
        cell = np.maximum(0, row + rules.gap)
        np.maximum(cell[1:], row[:-1] + np.where(text == word, rules.match, rules.mismatch), out=cell[1:])
        row = np.maximum.accumulate(cell + steps) - steps  # gaps in the item
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def found_in(words: np.ndarray, hits: list[tuple[int, int, int]], items: Items) -> list[tuple[int, float, int, int]]:
    """(item, score, start, end) of the items that one text holds, from hits (item, position, place in the item); its best
    alignment for each item."""
    best: dict[int, tuple[float, int, int]] = {}
    hits.sort()
    k = 0
    while k < len(hits):
        item, position, _ = hits[k]
        size = len(items.words[item])
        last = position
        k += 1
        while k < len(hits) and hits[k][0] == item and hits[k][1] <= last + size:
            last = hits[k][1]
            k += 1
        low, high = max(0, position - 2 * size), min(len(words), last + 2 * size + 1)
        score, end = align(items.words[item], words[low:high], items.rules)
        rules = items.rules
        share = score / (rules.match * size)
        enough = share >= (rules.short_score if size < rules.short_words else rules.least_score) or score >= rules.match * rules.stretch_words
        if enough and share > best.get(item, (0,))[0]:
            back = align(items.words[item][::-1], words[low : low + end][::-1], items.rules)[1]
            best[item] = (share, low + end - back, low + end)
    return [(item, *x) for item, x in sorted(best.items())]


def _blocks(benchmark: DataFrame, rules: LeakRules, item: str, text: str) -> Iterator[Items]:
    """Blocks of items with about `block_words` words; items without an id or a word are left out."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")
    )
    # a word takes two bytes at least
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // (2 * rules.block_words)))
    for k in range(count):
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k).orderBy("item", "text").toArrow()
        ids = some.column("item").to_pylist()
        hashes, _, words = _word_hashes(some.column("text").combine_chunks()) if ids else (None, None, None)
        parts = [hashes[words.bounds[i] : words.bounds[i + 1]] for i in range(len(ids))]
        keep = [i for i, x in enumerate(parts) if len(x)]
        yield Items([ids[i] for i in keep], [parts[i] for i in keep], rules)


def _with_seeds(items: Items, texts: DataFrame) -> Items:
    """The block with seeds only, after a count over all texts."""
    sent, rules = texts.sparkSession.sparkContext.broadcast(items), items.rules

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        near, totals = items.near(), np.zeros(len(items.grams), np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                hashes, owner, _ = _word_hashes(batch.column("text"))
                at, entry = items.hits(hashes, owner, near)
                once = np.unique(owner[at] * np.int64(len(items.grams) + 1) + entry)
                np.add.at(totals, once % (len(items.grams) + 1), 1)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["entry", "documents"])

    rows = texts.mapInArrow(count, "entry long, documents long").groupBy("entry").agg(F.sum("documents").alias("documents"))
    seen = rows.toPandas()  # a row an n-gram of the block at most
    documents = np.zeros(len(items.grams), np.int64)
    documents[seen.entry] = seen.documents
    documents = documents[np.searchsorted(items.grams, items.grams)]  # counts stand at the first entry of an n-gram
    order = np.argsort(items.item, kind="stable")
    usual = np.zeros(len(items.ids))
    for part in np.split(order, np.flatnonzero(np.diff(items.item[order])) + 1):
        if len(part):
            usual[items.item[part[0]]] = np.median(documents[part])
    items.keep(documents <= np.maximum(rules.few, rules.frequent * usual[items.item]))
    return items


def _finder(items: Items) -> Callable[[pa.Array], list[list[tuple[int, float, int, int]]]]:
    """A function that gives the items found in each text of a batch."""
    near = items.near()

    def find(texts: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        hashes, owner, words = _word_hashes(texts)
        at, entry = items.hits(hashes, owner, near)
        per_text: dict[int, list[tuple[int, int, int]]] = {}
        ends = np.searchsorted(items.grams, items.grams[entry], "right")
        for p, a, b in zip(at.tolist(), entry.tolist(), ends.tolist(), strict=True):
            text = int(owner[p])
            per_text.setdefault(text, []).extend((int(items.item[e]), p - int(words.bounds[text]), int(items.place[e])) for e in range(a, b))
        return [
            found_in(hashes[words.bounds[t] : words.bounds[t + 1]], per_text[t], items) if t in per_text else [] for t in range(len(texts))
        ]

    return find


def leaks(documents: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each text and item that it holds, with the words of the best alignment.

    Scores are shares of a full copy's score. NULL and empty texts hold nothing; repeated rows give rows each, NULL ids
    rows with a NULL id; of a repeated item each row counts by itself. Case and ASCII punctuation don't matter.
    """
    texts = documents.select(documents[key].alias("key"), documents[text].cast("string").alias("text"))
    kind = documents.schema[key].dataType.simpleString()
    out = None
    for items in _blocks(benchmark, rules, "item_id", "text"):
        sent = documents.sparkSession.sparkContext.broadcast(_with_seeds(items, texts))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, names = sent.value, ["key", "item_id", "score", "start_word", "end_word"]
            find = _finder(items)
            for whole in batches:
                for batch in pieces(whole, "text"):
                    rows = [(t, *x) for t, found in enumerate(find(batch.column("text"))) for x in found]
                    t, item, score, start, end = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("key").take(pa.array(t, pa.int64())), pa.array([items.ids[k] for k in item], pa.int64()),
                            pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                        ],
                        names=names,
                    )

        found = texts.mapInArrow(search, f"key {kind}, item_id long, score double, start_word long, end_word long")
        out = found if out is None else out.unionAll(found)
    return out.withColumnRenamed("key", key)


def decontaminated(documents: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), text: str = "text") -> DataFrame:
    """The documents that hold no item of `least_words` words at least, all columns as they are; nothing is shuffled."""
    texts = documents.select(documents[text].cast("string").alias("text"))
    for items in _blocks(benchmark, rules, "item_id", "text"):
        sent = documents.sparkSession.sparkContext.broadcast(_with_seeds(items, texts))

        def sift(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            find = _finder(items)
            for whole in batches:
                for batch in pieces(whole, text):
                    found = find(batch.column(text).cast(pa.string()))
                    clean = [not any(len(items.words[i]) >= rules.least_words for i, *_ in x) for x in found]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(sift, documents.schema)
    return documents
