"""Token counts of whole texts: batches balanced by bytes, and only the lengths come back.

A vocabulary whose pieces hold the space mark at their front only never merges across a single blank that
follows another character, so a text may be cut there. Every distinct stretch is encoded once a worker
and its length kept in a bounded table; a text's count is the sum over its stretches, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkweave.llm.textbytes import Words, pieces, text_bytes

KEPT_LENGTHS = 1_000_000
SPACE_MARK = "▁"


class PieceLengths:
    """Lengths in tokens under a sentencepiece model, stretch by stretch."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", x) for x in names)
        one = self.model.encode(["x", "x  x", " x"], out_type=str)
        self.cuts &= one[0] == [SPACE_MARK + "x"] and "".join(one[1] + one[2]).count(SPACE_MARK) == 5  # blanks are kept
        self.blank = len(self.model.encode("x ")) - len(self.model.encode("x"))  # a blank that ends a text
        self.known: dict[int, int] = {}

    def of(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(texts)
        if not self.cuts:
            return np.array([len(x) for x in self.model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
        first = data == 0x20
        # not after a blank, and not after a byte that may end a literal space mark
        first[1:] &= (data[:-1] != 0x20) & (data[:-1] != 0x81)
        words = Words.cut_at(data, offsets, first)
        [hashes] = words.hashes()
        opens = np.zeros(len(hashes), bool)
        opens[words.bounds[:-1][words.counts > 0]] = True
        # the first stretch of a text gets a blank before it, all others have their own
        hashes = np.where(opens, hashes ^ np.uint64(0x5BD1E9955BD1E995), hashes)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(lengths < 0)
        if len(new):
            raw = data.tobytes()
            begin = words.start[at[new]] + ~opens[at[new]]
            found = self.model.encode([raw[a:b].decode() for a, b in zip(begin, words.end[at[new]], strict=True)], num_threads=1)
            lengths[new] = np.where(begin == words.end[at[new]], self.blank, [len(x) for x in found])
            if len(self.known) + len(new) > KEPT_LENGTHS:
                self.known.clear()
            self.known.update(zip(distinct[new].tolist(), lengths[new].tolist(), strict=True))
        sums = np.append(0, np.cumsum(lengths[inverse]))
        return sums[words.bounds[1:]] - sums[words.bounds[:-1]]


def token_counts(texts: DataFrame, tokenizer: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row.

    `tokenizer` names a file of the public tokenizers that each worker reads from its own installation. NULL
    and empty texts have no tokens; repeated rows and NULL keys give a row each; other columns are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        lengths = PieceLengths(public_tokenizers.path(tokenizer))
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens = lengths.of(batch.column("text"))
                size = np.diff(text_bytes(batch.column("text"))[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                    names=["key", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(texts[key].alias("key"), texts[text].cast("string").alias("text")).mapInArrow(
        count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("key", key)
