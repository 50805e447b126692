"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target's texts.

Features are runs of one to three words, hashed into buckets by CRC-32. Their checksums are worked out for whole batches of
spans from a table of contributions by byte and distance from the end (crc_spans). Two passes over the texts: the first adds
up the features of each bucket, task by task, the second sums each document's gains. Gumbel noise fixed by the id turns
the weights into draws without replacement, so the highest scores are the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.crc_spans import crc32_spans
from linkweave.llm.textbytes import LOWER, MARKS, Words, pieces, text_bytes
from linkweave.operators.ordered import numbered
from linkweave.session import cut_lineage


@dataclass(frozen=True)
class ResampleRules:
    words: int = 3
    """Words of the longest feature."""
    buckets: int = 10_000
    """Also the smoothing, and the bound on the counts that reach the driver and the gains that reach the tasks."""
    min_words: int = 20
    """A document with fewer words is never drawn."""
    percent: int = 5
    seed: int = 42


def feature_buckets(texts: pa.Array, rules: ResampleRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of each text, their buckets in the order of the texts) for each length of feature, 1 word first."""
    data, offsets = text_bytes(texts)
    words = Words(data, offsets, MARKS)
    counts, owner = words.counts, words.owner
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    # the words alone, each followed by a blank
    line = np.full(end[-1] + 1 if len(end) else 0, 0x20, np.uint8)
    letters = np.ones(len(line), bool)
    letters[end] = False
    line[letters] = LOWER[data[~MARKS[data]]]
    for n in range(1, rules.words + 1):
        k = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
        yield np.maximum(counts - n + 1, 0), crc32_spans(line, start[k], end[k + n - 1]) % np.uint32(rules.buckets)


def bucket_counts(texts: DataFrame, rules: ResampleRules = ResampleRules(), text: str = "text") -> dict[int, int]:
    """Features of all texts in each bucket. A task sends one row a bucket at most."""

    def count(batches):
        total = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                for _, found in feature_buckets(piece.column("text"), rules):
                    total += np.bincount(found, minlength=rules.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(texts[text].cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], rules: ResampleRules = ResampleRules()) -> np.ndarray:
    """What a feature of each bucket adds to a weight: 1000 times the log of target over source share, smoothed, floored."""
    here, there = float(sum(source.values()) + rules.buckets), float(sum(target.values()) + rules.buckets)
    ratio = ((target.get(b, 0) + 1.0) * here / ((source.get(b, 0) + 1.0) * there) for b in range(rules.buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """The rows with __words, n_features and weight in place of __text."""
    added = [T.StructField(c, T.LongType()) for c in ("__words", "n_features", "weight")]
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__text"] + added)

    def weigh(batches):
        for batch in batches:
            for piece in pieces(batch, "__text"):
                features, weight, words = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64), None
                for many, found in feature_buckets(piece.column("__text"), rules):
                    words = many if words is None else words
                    sums, ends = np.append(0, np.cumsum(gain[found])), np.cumsum(many)
                    features += many
                    weight += sums[ends] - sums[ends - many]
                rest = [c for c in piece.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in rest), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=schema.names
                )

    return rows.mapInArrow(weigh, schema)


OUTPUT = ("n_features", "weight", "score", "rank")


def scored(
    documents: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules(), key: str = "doc_id", text: str = "text",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The rows with n_features, weight, score and rank (1, 2, 3 ... of those drawn, else NULL); columns of these names are replaced.

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded. A NULL or empty text has no features and weight 0;
    it is never drawn. `percent` of the documents with `min_words` words are drawn: the highest scores, of equal ones the smallest
    id, a NULL id first. The noise of a NULL id is that of an empty one. Repeated rows are documents of their own with equal scores.

    `carry` names the columns that go along (all by default, the id always); they are written twice. A text must fit a task.
    """
    gain = gains(bucket_counts(documents, rules, text), bucket_counts(target, rules, text), rules)
    kept = [c for c in documents.columns if c not in OUTPUT and (carry is None or c == key or c in carry)]
    rows = weighed(documents.select(*[documents[c] for c in kept], documents[text].cast("string").alias("__text")), gain, rules)
    h = f"bigint(conv(left(sha2(concat('{rules.seed}:', coalesce(string(`{key}`), '')), 256), 8), 16, 10))"
    noise = f"bigint(floor(-1000 * ln(-ln(({h} + 0.5D) / 4294967296D))))"
    return _ranked(rows.withColumn("score", F.expr(f"weight + {noise}")), kept, rules, key)


def _ranked(rows: DataFrame, kept: list[str], rules: ResampleRules, key: str) -> DataFrame:
    rows = cut_lineage(rows, "scores")
    able = rows.where(f"__words >= {rules.min_words}")
    drawn = rules.percent * able.count() // 100
    placed = numbered(able, [F.col("score").desc(), F.col(key).asc()], "__n").withColumn("rank", F.expr(f"IF(__n < {drawn}, __n + 1, NULL)"))
    rest = rows.where(f"__words < {rules.min_words}").withColumn("rank", F.lit(None).cast("long"))
    return placed.drop("__n").unionByName(rest).select(*kept, *OUTPUT)


def resampled(documents: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents with all their columns, in no order."""
    names = [f"__c{k}" for k in range(len(documents.columns))]  # own names of the results may clash with theirs
    renamed = documents.select(*[documents[c].alias(n) for c, n in zip(documents.columns, names, strict=True)])
    at = dict(zip(documents.columns, names, strict=True))
    rows = scored(renamed, target.withColumnRenamed(text, at[text]), rules, at[key], at[text]).where("rank IS NOT NULL")
    return rows.select(*[F.col(n).alias(c) for c, n in at.items()])
