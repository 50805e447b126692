"""Quality scores learned from trusted positives and unlabelled texts.

The share of good texts among the unlabelled (the class prior) is estimated first, then a small network
minimises the non-negative unbiased risk: the positives stand in for their part of the unlabelled texts, and
the negative part of the risk is held at zero or above, so that it can't be driven down by overfitting.
Texts are reduced on the executors to some forty numbers about their form; only those numbers of a bounded
sample reach the driver, where the network is fitted. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.sampling import in_fold, one_text_each, spread_sample
from linkweave.llm.textbytes import LOWER, MARKS, Words, mixed, pieces, runs, text_bytes


@dataclass(frozen=True)
class PuRules:
    max_positive: int = 8_000
    """Bound on trusted positives; beyond it, those of the smallest key hashes."""
    max_unlabelled: int = 16_000
    """Bound on unlabelled texts, chosen alike."""
    hidden: int = 16
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4


def _classes() -> np.ndarray:
    kind = np.full(256, 8, np.int64)
    for k, group in enumerate(
        (range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" ", b"\n", b"\t\r\x0b\x0c", b".,", b";:'\"-()!?")
    ):
        kind[list(group)] = k
    for k, byte in enumerate(b"!|#$%&*<>/\\=_{}[]@", 9):
        kind[byte] = min(k, 18)
    kind[0x80:0xC0] = 19
    kind[0xC0:] = 20
    return kind


CLASSES, KINDS = _classes(), 21
LINE_GAPS = np.zeros(256, bool)
LINE_GAPS[0x0A] = True
COLUMNS = KINDS + 19


def _distinct_share(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: distinct hashes among all its hashes; 1 without any."""
    different = np.unique(mixed(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    total = np.bincount(owner, minlength=texts)
    return np.where(total > 0, np.bincount(owner[different], minlength=texts) / np.maximum(total, 1), 1.0)


def form_features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of bytes, of repeated words and lines, word and line lengths."""
    data, offsets = text_bytes(texts)
    n, size = len(texts), np.diff(offsets)
    per_byte = np.repeat(np.arange(n) * KINDS, size) + CLASSES[data]
    kinds = np.bincount(per_byte, minlength=n * KINDS).reshape(n, KINDS)[:, :KINDS] if n else np.zeros((0, KINDS))
    columns = [kinds / np.maximum(size, 1)[:, None]]
    words = Words(data, offsets)
    [hashes] = words.hashes(LOWER)
    owner, count = words.owner, np.maximum(words.counts, 1)
    long = (words.end - words.start).astype(float)
    lines = Words(data, offsets, LINE_GAPS)
    [line_hashes] = lines.hashes()
    line_long = (lines.end - lines.start).astype(float)
    line_count = np.maximum(lines.counts, 1)

    def share(flag: np.ndarray, of: np.ndarray = owner, among: np.ndarray = count) -> np.ndarray:
        return np.bincount(of, flag, n) / among

    mean = share(long)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    second = np.zeros(len(hashes), bool)
    second[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    ends, begins = (data[words.end - 1], data[words.start]) if len(words.start) else (data[:0], data[:0])
    pair_owner, pairs = runs(hashes, owner, 2)
    triple_owner, triples = runs(hashes, owner, 4)
    plain = np.isin(ends, np.frombuffer(b".,;:'\")?", np.uint8))
    more = [
        np.log1p(size), np.log1p(words.counts), mean, np.sqrt(np.maximum(share(long * long) - mean * mean, 0)),
        share(long <= 2), share((long > 2) & (long <= 4)), share(long > 12), share(same), share(second),
        share(MARKS[ends] & ~plain), share(MARKS[begins]), share((begins >= 0x41) & (begins <= 0x5A)),
        _distinct_share(owner, hashes, n), _distinct_share(pair_owner, pairs, n), _distinct_share(triple_owner, triples, n),
        _distinct_share(lines.owner, line_hashes, n), np.log1p(lines.counts),
        np.log1p(share(line_long, lines.owner, line_count)), share(line_long < 30, lines.owner, line_count),
    ]
    return np.column_stack([*columns, *more]).astype(np.float32)


class Network:
    """One hidden layer; plain arrays, so that it can be broadcast."""

    def __init__(self, features: np.ndarray, hidden: int, seed: int = 0):
        random = np.random.default_rng(seed)
        self.center, self.scale = features.mean(0), features.std(0) + 1e-3
        d = features.shape[1]
        self.parts = [
            random.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1),
        ]

    def standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.center) / self.scale, -6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.parts
        inner = np.tanh(x @ a + b)
        return inner, inner @ c + d[0]

    def gradient(self, x: np.ndarray, inner: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
        below = np.outer(by_output, self.parts[2]) * (1 - inner * inner)
        return [x.T @ below, below.sum(0), inner.T @ by_output, by_output.sum(keepdims=True)]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.standard(features))[1], -35, 35)))


def _descend(net: Network, rules: PuRules, gradients) -> None:
    """Adam steps; `gradients` gives the gradients at the present parts."""
    first = [np.zeros_like(p) for p in net.parts]
    second = [np.zeros_like(p) for p in net.parts]
    for step in range(1, rules.steps + 1):
        for k, g in enumerate(gradients()):
            g = g + rules.decay * net.parts[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.parts[k] = net.parts[k] - rules.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, rules: PuRules) -> float:
    """Share of positives among the unlabelled: a classifier tells the two samples apart on one half of each; on
    the other half, no set of high scores may hold fewer unlabelled texts than its positives account for."""
    (p, q), (u, v) = ((x[::2], x[1::2]) for x in (positive, unlabelled))
    net = Network(np.concatenate([p, u]), rules.hidden)
    x = net.standard(np.concatenate([p, u]))
    is_p = np.arange(len(x)) < len(p)
    weight = np.where(is_p, 0.5 / len(p), 0.5 / len(u))

    def gradients() -> list[np.ndarray]:
        inner, out = net.forward(x)
        return net.gradient(x, inner, weight * (1 / (1 + np.exp(-np.clip(out, -35, 35))) - is_p))

    _descend(net, rules, gradients)
    high, other = np.sort(net.score(q))[::-1], np.sort(net.score(v))
    reached = np.arange(1, len(high) + 1) / len(high)
    held = 1 - np.searchsorted(other, high, "left") / len(other)
    slack = np.sqrt(np.log(20) / (2 * len(high))) + np.sqrt(np.log(20) / (2 * len(other)))
    return float(np.clip(held[k := np.argmin((held + slack) / reached)] / reached[k], 0.01, 0.99))


def fit_quality(positive: np.ndarray, unlabelled: np.ndarray, rules: PuRules = PuRules(), prior: float | None = None) -> Network | None:
    """The network of least non-negative risk under the sigmoid loss; None if either sample has under two rows."""
    if min(len(positive), len(unlabelled)) < 2:
        return None
    prior = class_prior(positive, unlabelled, rules) if prior is None else prior
    net = Network(unlabelled, rules.hidden)
    x = net.standard(np.concatenate([positive, unlabelled]))
    is_p = np.arange(len(x)) < len(positive)

    def gradients() -> list[np.ndarray]:
        inner, out = net.forward(x)
        s = 1 / (1 + np.exp(-np.clip(out, -35, 35)))  # loss as a negative; 1 - s as a positive
        slope = s * (1 - s)
        negative = s[~is_p].mean() - prior * s[is_p].mean()
        by_p, by_u = prior / is_p.sum(), 1 / (~is_p).sum()
        if negative >= 0:
            by_output = np.where(is_p, -2 * by_p, by_u) * slope
        else:  # step back from a negative part below zero
            by_output = np.where(is_p, by_p, -by_u) * slope
        return net.gradient(x, inner, by_output)

    _descend(net, rules, gradients)
    return net


def _features(texts: DataFrame, key: str, text: str, done) -> DataFrame:
    """(key, value) where `done` makes the value column of a batch's features."""
    kind = texts.schema[key].dataType.simpleString()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("key"), done[1](form_features(batch.column("text")))], names=["key", "value"])

    rows = texts.select(texts[key].alias("key"), texts[text].cast("string").alias("text"))
    return rows.mapInArrow(featured, f"key {kind}, value {done[0]}")


def sampled_features(texts: DataFrame, ids: DataFrame, key: str = "doc_id") -> np.ndarray:
    """Features of a text of each of these ids, of which there must be a bounded number, in the order of the ids."""
    as_lists = ("array<float>", lambda x: pa.array(list(x), pa.list_(pa.float32())))
    held = texts.select(key, F.col("text").cast("string").alias("text")).join(F.broadcast(ids.select(key).distinct()), key)
    found = _features(one_text_each(held, [f"`{key}`"]), key, "text", as_lists).toPandas().sort_values("key", kind="stable")
    return np.array(found.value.tolist(), np.float64).reshape(-1, COLUMNS)


def fitted(documents: DataFrame, labels: DataFrame, rules: PuRules, folds: int, held_out: int) -> Network | None:
    """The network fitted on labels of the folds that are not held out and a sample of all documents."""
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").distinct()
    trusted = labels.where(~in_fold("doc_id", folds, held_out) & (F.col("quality") == 1)).select("doc_id").distinct()
    # trusted ids may have left the documents in the meantime
    trusted = trusted.join(ids, "doc_id", "left_semi")
    positive = sampled_features(documents, spread_sample(trusted, "doc_id", rules.max_positive))
    unlabelled = sampled_features(documents, spread_sample(ids, "doc_id", rules.max_unlabelled))
    return fit_quality(positive, unlabelled, rules)


def quality(documents: DataFrame, labels: DataFrame, rules: PuRules = PuRules(), threshold: float = 0.5,
            folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Trusted positives are labelled rows of quality 1 of the other folds; the unlabelled texts are a bounded sample of
    all documents, whose labels are not read; an id with several rows teaches by one of them. Repeated rows get a row
    each, equal texts the same score; NULL texts count as empty and NULL ids as not held out. Without two positives and
    two documents with ids every score is 0.5.
    """
    net = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, rules, folds, held_out))
    scored = ("double", lambda x: pa.array(net.value.score(x) if net.value else np.full(len(x), 0.5)))
    return _features(documents, "doc_id", "text", scored).select(
        F.col("key").alias("doc_id"), in_fold("key", folds, held_out).alias("held_out"), F.col("value").alias("score"),
        (F.col("value") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(documents: DataFrame, labels: DataFrame, rules: PuRules = PuRules(), threshold: float = 0.5,
                   folds: int = 3, held_out: int = 1, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, all columns as they are; nothing is shuffled."""
    net = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, rules, folds, held_out))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                x = form_features(batch.column(text))
                yield batch.filter(pa.array((net.value.score(x) if net.value else np.full(len(x), 0.5)) >= threshold))

    return documents.mapInArrow(sift, documents.schema)
