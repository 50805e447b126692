"""Structured Streaming jobs: the event and probe work on data that keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkweave.config import Limits, ValueRules
from linkweave.operators import links as L
from linkweave.operators.occurrences import FILE_STRIDE, table_occurrences

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 64) -> DataFrame:
    """Stream over the Parquet files of a table, a file or a folder of files, with each row's file and number in it.

    Folders are read to any depth; columns that only their names hold (`k=v`) are not.
    """
    schema = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{table}.parquet").schema
    rows = (
        spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table}.parque[t]")
    )
    return rows.select("*", (F.col("_metadata.row_index") + 1).alias("row_no"), F.col("_metadata.file_path").alias("file_path"))


def numbered_batch(batch: DataFrame, number: int, stride: int = 1 << 12) -> DataFrame:
    """A batch whose `row_no` differ from those of all other files: files count from `number * stride`, each 2^40 rows apart.

    The offsets fix which files a batch holds, so a retry numbers its rows alike. A batch holds fewer than `stride` files.
    """
    files = sorted(row["file_path"] for row in batch.select("file_path").distinct().collect())  # bounded by files_per_batch
    if len(files) > stride:
        raise ValueError(f"a batch of {len(files)} files; set files_per_batch to {stride} at most")
    ordinals = batch.sparkSession.createDataFrame(
        [(path, (number * stride + k) * FILE_STRIDE) for k, path in enumerate(files)], "file_path string, first_row long"
    )
    return batch.join(F.broadcast(ordinals), "file_path").withColumn("row_no", F.expr("row_no + first_row")).drop("file_path", "first_row")


def run_to_folder(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now; each batch owns one folder, so a retry replaces it whole."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query: StreamingQuery = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/data")


def probe_stream(
    stream: DataFrame, table: str, columns: list[tuple[str, str]], catalog: DataFrame, seeds: DataFrame, out: str,
    values: ValueRules = ValueRules(), limits: Limits = Limits(),
) -> DataFrame:
    """Probes a growing table against fixed seeds, batch by batch; resumes from its offsets.

    Each batch keeps at most the cap of matches per value, and the cap is applied again to all batches. Rows are
    numbered in the order in which their files came, so the result equals that of one scan in that order.
    """
    spark = stream.sparkSession

    def probe(batch: DataFrame, number: int) -> None:
        cells = table_occurrences(numbered_batch(batch, number), table, columns, values)
        L.probe_seeds(cells, catalog, seeds, limits).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = (
        stream.writeStream.foreachBatch(probe).option("checkpointLocation", f"{out}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return L.cap_matches(read_batches(spark, out).drop("batch"), limits)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", keys=("type", "status")) -> DataFrame:
    """Events and calls per tumbling window; rows later than the watermark are lost here, counts_with_late keeps them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.approx_count_distinct("call_id").alias("calls")
    ).selectExpr("w.start AS window_start", *keys, "events", "calls")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "run_id") -> DataFrame:
    """Events per session of a run: a session ends after a gap without events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("events")
    ).selectExpr(key, "w.start AS session_start", "w.end AS session_end", "events")


def counts_with_late(stream: DataFrame, out: str, window: str = "1 hour", late: str = "1 hour", keys: tuple[str, ...] = ("type", "status")) -> None:
    """Counts per window, batch by batch; rows whose window has closed when they come are kept aside whole, in `out`/late.

    A window closes when the newest time of earlier batches, less `late`, has passed its end. Each batch leaves partial counts, its late rows
    and the newest time so far in folders of its own, so a retry replaces them.
    """
    spark = stream.sparkSession

    def split(batch: DataFrame, number: int) -> None:
        mark = spark.read.parquet(f"{out}/mark/batch={number - 1}").first()["newest"] if number else None
        placed = batch.withColumn("w", F.window("ts", window))
        closed = F.coalesce(F.col("w.end") <= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {late}"), F.lit(False))
        marked = placed.withColumn("is_late", closed).persist()
        marked.where("NOT is_late").groupBy(F.col("w.start").alias("window_start"), *keys).agg(F.count(F.lit(1)).alias("events")).write.mode(
            "overwrite").parquet(f"{out}/counts/batch={number}")
        marked.where("is_late").drop("w", "is_late").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        marked.agg(F.greatest(F.max("ts"), F.lit(mark).cast("timestamp")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{out}/mark/batch={number}")
        marked.unpersist()

    query = stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came after their window had closed."""
    return spark.read.parquet(f"{out}/late").drop("batch")


def merged_counts(spark: SparkSession, out: str, window: str = "1 hour", keys: tuple[str, ...] = ("type", "status")) -> DataFrame:
    """Counts of rows on time and late rows together."""
    on_time = spark.read.parquet(f"{out}/counts").select("window_start", *keys, "events")
    after = late_rows(spark, out).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    both = on_time.unionByName(after.select(F.col("w.start").alias("window_start"), *keys, "events"))
    return both.groupBy("window_start", *keys).agg(F.sum("events").alias("events"))


def newest_batch(spark: SparkSession, out: str, keys: list[str], values: list[str]) -> DataFrame:
    """Final values of a stream in update mode: the newest batch of each key wins."""
    packed = f"max_by(struct({', '.join(values)}), batch)"
    return read_batches(spark, out).groupBy(*keys).agg(F.expr(f"{packed} AS v")).select(*keys, "v.*")


def once_per_call(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """First event of each call within the watermark; replays are dropped."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scope", "call_id"])
