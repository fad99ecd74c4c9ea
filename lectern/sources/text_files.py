"""Plain-text book sources.

``read_lines`` turns text files into ``(file, line_no, raw)`` without reading
any file whole: Spark's line reader splits big files into byte blocks, and
the line number of a row is (lines in earlier blocks of the same file) +
(position inside its block).  The scanned rows are written once with their
block and position, so the counts and the lines come from the same splits
whatever the number of executors does meanwhile.  The per-block counts are
one tiny aggregate, their running sum per file is a window over block rows,
and the result is joined back on (file, block) - broadcast when the block
table is under the broadcast threshold.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.scan import small_table

_log = logging.getLogger(__name__)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files -> ``file STRING, line_no LONG, raw STRING``.

    Line ends are LF, CR LF or CR, as with Python's universal newlines.
    ``line_no`` starts at 1 in every file.  A missing path raises
    (Spark's ``PATH_NOT_FOUND``); use ``read_lines_if_exists`` for the
    empty-result behaviour.

    ``file`` is the path with its percent-encoding undone, so titles and
    ids come from the name that a listing shows.
    """
    if isinstance(paths, str):
        paths = [paths]
    raw = small_table(
        spark.read.text(paths)
        .select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("_pos"),
                F.col("value").alias("raw")), "raw-lines")
    # Rows of one (file, block) are read by one task in file order, so
    # their monotonically increasing ids are consecutive and ordered.
    blocks = raw.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    w = (Window.partitionBy("file").orderBy("block")
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(
        "file", "block", "_first",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    # One row per file block: written as a small table so the planner sees
    # its size and broadcasts it (the lines themselves are never shuffled
    # here); beyond the broadcast threshold it falls back to a merge join.
    offsets = small_table(offsets, "line-offsets")
    return (raw.join(offsets, ["file", "block"])
               .select("file",
                       (F.col("_before") + F.col("_pos") - F.col("_first") + 1)
                       .cast("long").alias("line_no"),
                       "raw"))


def read_lines_if_exists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A1 as the reference behaves: a missing file gives an empty result
    (and a logged error) instead of failing the job."""
    if isinstance(paths, str):
        paths = [paths]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.globStatus(hp) is not None and len(fs.globStatus(hp)) > 0:
            present.append(p)
    missing = [p for p in paths if p not in present]
    if missing:
        _log.error("file not found: %s", ", ".join(missing))
    if not present:
        return spark.createDataFrame([], "file STRING, line_no LONG, raw STRING")
    return read_lines(spark, present)
