"""Parquet table reads with a small-input parallelism guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A table of fewer bytes than this for each task slot is dealt out again.
BYTES_PER_SLOT = 4 << 20


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, by the file system's own listing."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(hp).getLength()


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A table whose scan is followed by CPU-heavy work (regexes,
    tokenising, hashing, distances).

    A small Parquet file is read by one task, and that work would run on one
    core; such a table is hash-repartitioned by ``key`` over the task slots
    (hash, not round-robin: retries are deterministic).  A large table has
    more splits than slots and stays as the scan deals it.
    """
    df = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    if stored_bytes(spark, path) >= slots * BYTES_PER_SLOT:
        return df
    return df.repartition(slots, key) if key else df.repartition(slots)
