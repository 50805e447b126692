"""Session helpers: sane defaults for local runs, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "linkweave", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only for local runs without it."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folder


_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_intermediates(spark: SparkSession) -> int:
    """Deletes the folders this process has made in the shared folder; how many. For the end of a run: frames that still read
    them can't be used any more."""
    jvm, done = spark._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes an intermediate result once and reads it back.

    What follows no longer depends on the executors that made it, and Spark plans it with its true size.
    """
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def input_bytes(df: DataFrame) -> int:
    """Bytes of what a frame is read from, as Spark knows them; unlike its estimate of the frame itself, joins don't multiply them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # Spark's stand-in for an unknown size, of local rows say, is the largest long


SPREAD_BYTES = (1 << 20, 8 << 20)
"""Tables smaller than the first, or larger than the second for each core, are read as they are split."""


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores, dealt out to all of them.

    A Parquet file is read a row group a task, so a small one occupies one core however it is cut. The bound keeps the
    shuffle this costs below a few megabytes a core.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or not SPREAD_BYTES[0] <= size <= SPREAD_BYTES[1] * cores or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
