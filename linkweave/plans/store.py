"""Results kept from run to run, each under a digest of all it was made from.

A table's pass depends on its files (path, size, time of change), on the rules and on the seeds that probe it. A run that finds
a result of the same digest reads it instead of the table; where a file has changed, the passes over it, and those
over tables that its values probe, have new digests and are made anew. Nothing has to be invalidated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import cut_lineage
from linkweave.sources.catalog import digest_of, multiset_digest


def digest(*parts: object) -> str:
    return hashlib.sha256("\0".join(repr(p) for p in parts).encode()).hexdigest()[:32]


class Store:
    """A folder of kept results; without one, results are intermediates of this run. `made` and `found` list what was done."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder and folder.rstrip("/")
        self.made: list[str] = []
        self.found: list[str] = []

    def keep(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of this name and key, made only if it isn't there. A result is there once it is written whole."""
        if self.folder is None:
            self.made.append(name)
            return cut_lineage(make(), "scan")
        path = f"{self.folder}/{name.replace('/', '_')}-{key}"
        if self._complete(path):
            self.found.append(name)
        else:
            self.made.append(name)
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _complete(self, path: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)


def table_signatures(tables: dict[str, DataFrame]) -> dict[str, str]:
    """{table: signature} of the files each table is read from. Lists files and opens none; one row a table reaches the driver."""
    parts = None
    for name, df in sorted(tables.items()):
        files = df.inputFiles()
        if not files:
            continue
        listed = df.sparkSession.read.format("binaryFile").load(files).select(
            F.lit(name).alias("table"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified")
        )
        parts = listed if parts is None else parts.unionAll(listed)
    if parts is None:
        return {}
    line = "concat_ws('\0', path, string(size), string(modified))"
    rows = parts.groupBy("table").agg(*multiset_digest(line)).selectExpr("table", f"{digest_of()} AS signature").collect()
    return {r["table"]: r["signature"] for r in rows}
