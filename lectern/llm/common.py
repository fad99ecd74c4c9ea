"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import bounded_batches, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write under the shared checkpoint folder and read back: the lineage
    ends here, columns prune, and the planner sees the real size."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of ``materialize``d tables that are no longer read."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def crc_mod(col: str, n: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks.  A
    worker keeps one operator's cache at a time: the next stage of a pipeline
    drops what the last one kept."""
    holder = sys.modules.setdefault("_lectern_process_cache", types.ModuleType("_lectern_process_cache"))
    kept = holder.__dict__.setdefault("kept", {})
    if name not in kept:
        kept.clear()
        kept[name] = {}
        release()
    return kept[name]


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their
    tasks, and what their allocators hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:      # another C library
        pass


# ---------------------------------------------------------------- bytes

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised, wraps around)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back and row offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = col.buffers()[2] if n else None
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that do not cross rows: starts, ends, rows."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte run; ``lower`` folds A-Z.  Works through the
    runs in pieces of about a megabyte."""
    lens = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    table_ = _BYTE[_LOWER] if lower else _BYTE
    pw = powers(int(lens.max()))
    cum = np.concatenate([[0], np.cumsum(lens)])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(cum, cum[i] + CHUNK, side="right")) - 1)
        n, first = lens[i:j], cum[i:j] - cum[i]
        within = np.arange(cum[j] - cum[i]) - np.repeat(first, n)
        val = table_[data[np.repeat(starts[i:j], n) + within]] * pw[within]
        out[i:j] = np.add.reduceat(val, first) + n.astype(np.uint64) * MIX_A
        i = j
    return mix64(out)


# ----------------------------------------------------------- components

def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge table (ids: long).

    Alternating large-star and small-star steps: each is one aggregate
    (the smallest neighbour of a node) and one join, so a hub with very many
    neighbours is a skewed join, which Spark splits, never one group in one
    task.  Every round is written to the shared folder.  Returns
    ``node, component`` for nodes that have an edge; component is the
    smallest id reachable.
    """
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .filter("u <> v").distinct(), "edges")
    if not cur.take(1):
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # Large star: larger neighbours of a node attach to its smallest neighbour.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # Small star: a node and its smaller neighbours attach to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        nxt = materialize(small, "edges")
        # Done when every node points at one root and no root points on.
        bad = (nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
               .union(nxt.select("u").join(nxt.select(F.col("v").alias("u")), "u", "left_semi")))
        done = not bad.take(1)
        discard(cur)
        cur = nxt
        if done:
            roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
