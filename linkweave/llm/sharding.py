"""Shards from a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, and the shards take turns in claiming
their next free slot, so each gets the same number of slots (one more or less), and few slots change hands when a
shard comes or goes. The table depends on the shards' names alone, never on the data: it is filled on the driver,
broadcast, and a row is placed by one lookup of its key's hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 2503
SHARDS = tuple(f"shard-{k:02d}" for k in range(24))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard (its place in `shards`) of each slot. `slots` is a prime above the number of shards.

    Shard s prefers the slots offset + k * skip for k = 0, 1, ...; both come from MD5 of its name.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be different names, and slots a prime not below their number")
    start = [_number(s + "/offset") % slots for s in shards]
    skip = [_number(s + "/skip") % (slots - 1) + 1 for s in shards]
    tried, table = [0] * len(shards), [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while table[at := (start[s] + tried[s] * skip[s]) % slots] >= 0:
            tried[s] += 1
        table[at] = s
    return table


def slot_of(key: str, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5. A NULL key counts as the empty text."""
    return F.expr(f"conv(left(md5(coalesce(cast(`{key}` AS string), '')), 8), 16, 10)").cast("long") % slots


def _table_frame(spark: SparkSession, shards: tuple[str, ...], slots: int) -> DataFrame:
    listed = ",".join(map(str, lookup_table(shards, slots)))
    names = ", ".join(f"'{s}'" for s in shards)
    return spark.sql(f"SELECT bigint(pos) AS __slot, int(col) AS __shard, element_at(array({names}), int(col) + 1) AS __name FROM (SELECT posexplode(split('{listed}', ',')))")


def sharded(documents: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """The rows with slot, shard and shard_name; columns of these names are replaced, nothing is shuffled.

    Rows of one key, repeated rows too, go to one shard; rows without a key go where the empty text goes. The broadcast has
    `slots` rows.
    """
    rows = documents.drop("slot", "shard", "shard_name").withColumn("__slot", slot_of(key, slots))
    placed = rows.join(F.broadcast(_table_frame(documents.sparkSession, shards, slots)), "__slot")
    kept = [c for c in documents.columns if c not in ("slot", "shard", "shard_name")]
    return placed.select(*kept, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"), F.col("__name").alias("shard_name"))


def write_sharded(documents: DataFrame, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> None:
    """Writes the rows in a folder a shard. Rows are rebalanced by shard, so a large shard is written by several tasks."""
    sharded(documents, shards, slots, key).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
