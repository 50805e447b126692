"""Toxicity scores by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Each coordinate has its own learning rate and is held at zero until its evidence outgrows the L1 term, so
the fitted weights are few. They are sorted by feature hash and broadcast; scoring is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.sampling import in_fold, one_text_each, spread_sample
from linkweave.llm.textbytes import MARKS, Words, pieces, runs, text_bytes

STEMS = (4, 5, 6, 7)
"""Lengths in bytes of the word beginnings that count as words of their own, for inflected and compound forms."""


@dataclass(frozen=True)
class FtrlRules:
    max_labelled: int = 12_000
    """Bound on the labelled documents that the fit sees; beyond it, those of the smallest key hashes."""
    min_documents: int = 3
    """Features in fewer labelled documents get no weight."""
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0
    epochs: int = 3


def gram_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) for words, word beginnings, pairs, triples and skip-grams; features are 32-bit hashes."""
    words = Words(*text_bytes(texts, lower=True), MARKS)
    hashes, *stems = words.hashes(stems=STEMS)
    owner = words.owner
    kinds = [(owner, hashes)]
    long = words.end - words.start
    for n, stem in zip(STEMS, stems, strict=True):
        kinds.append((owner[long > n], stem[long > n] ^ np.uint64(n)))
    kinds += [runs(hashes, owner, 2), runs(hashes, owner, 3), runs(hashes, owner, 2, 2), runs(hashes, owner, 2, 3)]
    return np.concatenate([o for o, _ in kinds]), (np.concatenate([h for _, h in kinds]) >> np.uint64(32)).astype(np.uint32)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | feature)
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, rules: FtrlRules) -> np.ndarray:
    """Weights of `size` features and, last, of the constant. rows: the features present in each document."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [np.append(x, size) for x in rows]

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * rules.l1 - zi
        return np.where(np.abs(zi) <= rules.l1, 0.0, shrunk / ((rules.beta + np.sqrt(ni)) / rules.alpha + rules.l2))

    turns = np.random.default_rng(0)
    for _ in range(rules.epochs):
        for k in turns.permutation(len(rows)):
            at = rows[k]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            sigma = (np.sqrt(ni + gradient * gradient) - np.sqrt(ni)) / rules.alpha
            z[at] = zi + gradient - sigma * w
            n[at] = ni + gradient * gradient
    return weights(z, n)


def fit_toxicity(labelled: DataFrame, rules: FtrlRules = FtrlRules()) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, constant) from rows (key, text, label 0 or 1), of which `max_labelled` at most are given.

    The rows become sets of hashes on the executors; one task then fits, over a number of rows that the rules bound.
    """

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                owner, feature = _distinct(*gram_features(batch.column("text")))
                ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                rows = [feature[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("label"), pa.array(rows, pa.binary())], names=["key", "label", "features"]
                )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, rows = [], [], []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            labels += batch.column("label").to_pylist()
            rows += [np.frombuffer(x, np.uint32) for x in batch.column("features").to_pylist()]
        order = sorted(range(len(keys)), key=lambda k: (keys[k], len(rows[k]), labels[k]))
        names, seen = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]), return_counts=True)
        names = names[seen >= rules.min_documents]
        kept = []
        for k in order:
            at = np.searchsorted(names, rows[k])
            ok = at < len(names)
            ok[ok] = names[at[ok]] == rows[k][ok]
            kept.append(at[ok])
        w = ftrl(kept, np.array([labels[k] for k in order], float), len(names), rules)
        used = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(names[used].astype(np.int64), -1)), pa.array(np.append(w[:-1][used], w[-1]))],
            names=["feature", "weight"],
        )

    found = (
        labelled.select("key", "text", "label")
        .mapInArrow(featured, "key string, label int, features binary")
        .repartition(1)
        .mapInArrow(fitted, "feature long, weight double")
        .toPandas()
        .sort_values("feature")
    )
    constant = float(found.weight[found.feature < 0].sum())
    found = found[found.feature >= 0]
    return found.feature.to_numpy().astype(np.uint32), found.weight.to_numpy(), constant


def score_toxicity(texts: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row: 0 to 1. NULL and empty texts get the score of no evidence."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, constant = sent.value
        near = np.zeros(1 << 16, bool)  # most features are told to have no weight by their low bits
        near[names & np.uint32(0xFFFF)] = True
        for whole in batches:
            for batch in pieces(whole, "text"):
                owner, feature = gram_features(batch.column("text"))
                may = near[feature & np.uint32(0xFFFF)]
                owner, feature = owner[may], feature[may]
                at = np.searchsorted(names, feature)
                ok = at < len(names)
                ok[ok] = names[at[ok]] == feature[ok]
                owner, feature = _distinct(owner[ok], feature[ok])
                total = np.bincount(owner, weights[np.searchsorted(names, feature)], batch.num_rows) + constant
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["key", "score"]
                )

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(texts[key].alias("key"), texts[text].cast("string").alias("text"))
    return rows.mapInArrow(scored, f"key {kind}, score double").withColumnRenamed("key", key)


def toxicity(documents: DataFrame, labels: DataFrame, rules: FtrlRules = FtrlRules(), threshold: float = 0.3,
             folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    The fit reads labels of the other folds only; rows without text, label or id teach nothing, and of the rows of one id
    and label one teaches. Repeated rows get a row each, equal texts the same score, a NULL id counts as not held out.
    Without any label the score is 0.5.
    """
    known = labels.where(~in_fold("doc_id", folds, held_out) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    # the sample is bounded by max_labelled, so that its ids may be broadcast
    some = spread_sample(known.select("doc_id", F.col("toxic").cast("int").alias("label")).distinct(), "doc_id", rules.max_labelled)
    held = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id")
    labelled = one_text_each(held, ["doc_id", "label"])
    model = fit_toxicity(labelled.select(F.col("doc_id").cast("string").alias("key"), "text", "label"), rules)
    return score_toxicity(documents, model).select(
        "doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
