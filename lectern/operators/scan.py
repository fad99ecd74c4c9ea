"""Running totals over an ordered key without one task per key.

Line order is data here (a book is a sequence of lines), and several
operators need inclusive running values along that order: how many headers
came so far, how many blank lines, which part header was the latest.  A
plain ``Window.partitionBy(book).orderBy(line_no)`` puts a whole book into
one task, and one book may hold a large share of all lines.

``running_scan`` computes the same values in two levels:

1. rows are cut into chunks of ``chunk_size`` consecutive order values; a
   window per (key, chunk) gives the running value inside the chunk;
2. one small aggregate per (key, chunk) gives the chunk totals, and a window
   over those chunk rows (one row per chunk, so tiny) carries the totals of
   all earlier chunks forward;
3. the carry is joined back on (key, chunk); AQE broadcasts it when small.

Sums carry by addition, "latest non-null value" carries by replacement, so
both are exact.  Every task holds at most one chunk of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.storagelevel import StorageLevel

from lectern.session import ensure_checkpoint_dir, scratch_path

DEFAULT_CHUNK = 1 << 16


def running_scan(df: DataFrame, keys: list[str], order: str,
                 sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None,
                 chunk_size: int = DEFAULT_CHUNK,
                 materialize: bool = True,
                 chunk_col: str | None = None) -> DataFrame:
    """Add inclusive running ``sums`` and latest-non-null ``lasts`` columns.

    ``order`` must be an integral column, unique within ``keys``.
    ``chunk_col`` keeps the chunk number under that name.

    The windowed rows feed two branches (chunk totals and the join back).
    With ``materialize`` they are written once with ``checkpoint()`` to the
    shared checkpoint folder, so neither branch recomputes the input (the
    branches prune different columns, so the shuffle could not be reused)
    and a lost executor re-reads files instead of re-running the lineage.

    Plan shape: one shuffle of the rows on (keys, chunk) feeds a single
    window operator that yields both the in-chunk running values and the
    chunk totals; the one-row-per-chunk table is aggregated from those rows
    (partial aggregation leaves one row per chunk per task), its carry is a
    window over chunk rows, and with ``materialize`` the carry is written
    as a small table and broadcast back when its size allows.
    """
    sums = sums or {}
    lasts = lasts or {}
    names = [*sums, *lasts]
    if not names:
        return df
    chunk = "_scan_chunk"
    staged = df.withColumn(chunk, F.floor(F.col(order) / F.lit(chunk_size)))
    for name, expr in {**sums, **lasts}.items():
        staged = staged.withColumn(f"_v_{name}", expr)

    spec = Window.partitionBy(*keys, chunk).orderBy(order)
    w_in = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = []
    for n in sums:
        cols += [F.sum(f"_v_{n}").over(w_in).alias(f"_l_{n}"),
                 F.sum(f"_v_{n}").over(w_all).alias(f"_t_{n}")]
    for n in lasts:
        cols += [F.last(f"_v_{n}", ignorenulls=True).over(w_in).alias(f"_l_{n}"),
                 F.last(f"_v_{n}", ignorenulls=True).over(w_all).alias(f"_t_{n}")]
    local = staged.select("*", *cols)
    if materialize:
        local = checkpointed(local)

    # One row per chunk: the partial aggregate leaves at most one row per
    # chunk per task, so only those rows are shuffled.
    totals = local.groupBy(*keys, chunk).agg(
        *[F.first(f"_t_{n}").alias(f"_t_{n}") for n in names])
    w_before = (Window.partitionBy(*keys).orderBy(chunk)
                .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(
        *keys, chunk,
        *[F.coalesce(F.sum(f"_t_{n}").over(w_before), F.lit(0)).alias(f"_c_{n}")
          for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(w_before).alias(f"_c_{n}")
          for n in lasts])

    if materialize:
        # The carry has one row per chunk.  Written as a small table it has
        # a true size, so the planner broadcasts it when it is under the
        # broadcast threshold (the rows are then not shuffled again) and
        # falls back to a sort-merge join when it is not.
        carry = small_table(carry, "carry")
    out = local.join(carry, on=[*keys, chunk], how="inner")
    for name in sums:
        out = out.withColumn(name, F.col(f"_c_{name}") + F.col(f"_l_{name}"))
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}")))
    drop = [f"_{p}_{n}" for p in "vltc" for n in names]
    if chunk_col:
        # Keep the chunk: the rows stay hash-partitioned by (keys, chunk),
        # so later work keyed by (keys, chunk, ...) needs no shuffle.
        return out.drop(*drop).withColumnRenamed(chunk, chunk_col)
    return out.drop(chunk, *drop)


def small_table(df: DataFrame, prefix: str, max_records: int = 0) -> DataFrame:
    """Write a derived table under the shared checkpoint folder and read it
    back, so that the planner sees its real size.  ``max_records``: rows of a
    file at most (0: any number)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{prefix}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", max_records).parquet(path)
    return spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``small_table`` that is no longer read."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint computed once: the rows are cached while
    the checkpoint files are written (otherwise writing them would run the
    lineage a second time).  The checkpointed rows carry no known
    partitioning, so later work keyed by the same columns shuffles again;
    callers keep those shuffles small (a broadcast carry, a filtered
    subset)."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
