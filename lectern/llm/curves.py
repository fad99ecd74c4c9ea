"""Approximate nearest neighbours along shifted space-filling curves.

Every vector is projected to a few directions, shifted and put on a Hilbert
curve, once for each of several random projections.  Spark range-partitions
each curve; a curve is cut into blocks of equal numbers of rows.  A query
looks at the blocks around its own place on every curve, ranks what it finds
there by the exact inner product, and the windows of all curves are merged.

Inner products become distances by one more coordinate, which gives all
candidates the largest norm (0 for queries).

The width of the windows is measured, not guessed: a bounded sample of
queries is answered exactly, and the windows are made wide enough to hold the
target share of those answers.  Where vectors have no structure that a curve
could follow, the windows grow to a large part of the table; where they have,
they stay narrow.

Defined cases: null or zero vectors, vectors with null or non-finite
components and vectors of another length than the commonest take no part;
ties go to smaller ids; rows that repeat a ``vec_id`` count once in a
result; an empty table, or one without queries, gives an empty table; only
the id and vector columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, discard, materialize
from lectern.llm.vectors import dimension, dot_rows, lists, matrix, rotation, usable

CURVES = 6
DIMENSIONS = 8           # projected
BITS = 6                 # a coordinate
BLOCK = 2048             # rows of a block
CHUNK = 2048             # queries that meet a block in one task, about
SAMPLE_QUERIES = 64      # answered exactly, to set the windows
RECALL = 0.95            # share of their answers that the windows must hold
RESULT = "query_id LONG, vec_id LONG, score DOUBLE"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid cells (rows, dimensions).

    Works from the highest bit down: each bit says which half of the cube a
    point lies in, and the halves are turned so that they join; the turned
    coordinates, read as a Gray code across dimensions, are the position.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            up = (x[i] & high) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, 0) ^ swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the columns that can be among its best k
    (ties and rounding included)."""
    n = scores.shape[1]
    if n <= k:
        return [np.flatnonzero(np.isfinite(s)) for s in scores]
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    floor = np.where(np.isfinite(kth), kth - 1e-9 * np.maximum(1, np.abs(kth)), np.finfo(float).min)
    return [np.flatnonzero(s >= f) for s, f in zip(scores, floor)]


def best_pairs(qid, q, cid, c, k: int, tile: int = 256) -> pa.RecordBatch:
    """Exact top k of every query among the candidates, its own id left out."""
    out = [[], [], []]
    for i in range(0, len(qid), tile):
        scores = q[i:i + tile] @ c.T
        scores[qid[i:i + tile, None] == cid[None, :]] = -np.inf
        for j, cols in enumerate(top_rows(scores, cid, k)):
            exact = dot_rows(np.broadcast_to(q[i + j], (len(cols), c.shape[1])), c[cols])
            order = np.lexsort((cid[cols], -exact))[:k]
            out[0].append(np.full(len(order), qid[i + j]))
            out[1].append(cid[cols][order])
            out[2].append(exact[order])
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(cat(out[0], np.int64)), pa.array(cat(out[1], np.int64)),
                                       pa.array(cat(out[2], np.float64))], ["query_id", "vec_id", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Merge: the k best of every query, each candidate once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def exact(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """Exact answers of a bounded list of (id, vector) queries."""
    qid = np.array([r[0] for r in queries], dtype=np.int64)
    q = np.array([r[1] for r in queries], dtype=np.float64).reshape(len(queries), dim)
    shared = rows.sparkSession.sparkContext.broadcast((qid, q))

    def scan(batches):
        ids, qs = shared.value
        for rb in batches:
            if rb.num_rows:
                yield best_pairs(ids, qs, rb.column("id").to_numpy(), matrix(rb.column("vec"), dim), k)

    return best_of(rows.select("id", "vec").mapInArrow(scan, RESULT), k)


def nearest(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            curves: int = CURVES, block: int = BLOCK, recall: float = RECALL, seed: int = 5, chunk: int = CHUNK,
            report: dict | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest inner products
    found for each query row among all other rows.  ``report`` receives the
    measured window width and the most queries of a task's group."""
    spark = df.sparkSession
    bounded_batches(spark)
    dim = dimension(df, vec_col)
    rows = df.filter(usable(vec_col, dim) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sample = rows.filter("q").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).select("id", "vec").collect()
    if not sample:
        return spark.createDataFrame([], "query_id LONG, rank INT, vec_id LONG, score DOUBLE")

    # Sums over all rows: the grid follows the spread of every projection.
    d = min(DIMENSIONS, dim + 1)
    turns = [rotation(dim + 1, seed + s)[:, :d] for s in range(curves)]
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = rows.agg(F.max(norm2)).first()[0]

    def lift(m: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, largest - (m * m).sum(1)))
        return np.column_stack([m, extra])

    def moments(batches):
        for rb in batches:
            if rb.num_rows:
                p = lift(matrix(rb.column("vec"), dim), False) @ np.concatenate(turns, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([float(rb.num_rows)]), lists(p.sum(0)[None]), lists((p * p).sum(0)[None])],
                                                 ["n", "s", "ss"])

    sums = rows.select("vec").mapInArrow(moments, "n DOUBLE, s ARRAY<DOUBLE>, ss ARRAY<DOUBLE>").select(
        "n", F.posexplode(F.arrays_zip("s", "ss")).alias("i", "x")).groupBy("i").agg(
        F.sum("n"), F.sum("x.s"), F.sum("x.ss")).orderBy("i").collect()       # curves * dimensions rows
    n, s, ss = (np.array([r[j] for r in sums]) for j in (1, 2, 3))
    mean = s / n
    spread = np.sqrt(np.maximum(ss / n - mean * mean, 1e-18))
    cells = 1 << BITS
    shift = np.random.default_rng(seed).uniform(-0.5, 0.5, len(mean))

    def keyed(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            m, ids, q = matrix(rb.column("vec"), dim), rb.column("id"), rb.column("q").to_numpy(zero_copy_only=False)
            for kind, take in ((0, np.arange(len(m))), (1, np.flatnonzero(q))):
                if not len(take):
                    continue
                p = (lift(m[take], kind == 1) @ np.concatenate(turns, axis=1) - mean) / spread
                g = np.clip(np.floor((p + 3) / 6 * cells + shift), 0, cells - 1).astype(np.int64)
                at = pa.array(take)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(take), c, np.int32)), pa.array(hilbert_keys(g[:, c * d:(c + 1) * d], BITS)),
                         pa.array(np.full(len(take), kind, np.int32)), ids.take(at), rb.column("vec").take(at)],
                        ["curve", "key", "kind", "id", "vec"])

    vec_type = rows.schema["vec"].dataType.simpleString()
    ordered = (rows.mapInArrow(keyed, f"curve INT, key LONG, kind INT, id LONG, vec {vec_type}")
               .repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id", "kind")
               .withColumn("_at", F.monotonically_increasing_id()))
    placed = materialize(ordered, "curves")
    # Rank on the curve: rows of earlier partitions plus the place in this one.
    part = F.shiftright("_at", 33)
    counts = placed.groupBy("curve", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("curve", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    total = offsets.join(counts.select("curve", "part", "n"), ["curve", "part"]).agg(F.max(F.col("before") + F.col("n"))).first()[0]
    blocks = max(1, math.ceil(total / block))
    # Equal blocks, so that the last one is not a remainder.
    spot = F.col("before") + F.col("_at") - F.col("first")
    of = F.floor(spot * blocks / F.lit(total)).cast("int")
    placed = placed.withColumn("part", part).join(offsets, ["curve", "part"]).select("curve", "kind", "id", "vec", of.alias("block"), spot.alias("spot"))

    reach = 0
    if blocks > 1:
        truth = exact(rows, [tuple(r) for r in sample], dim, k)
        truth = materialize(truth.select("query_id", "vec_id"), "truth")
        spots = placed.select("curve", "kind", "id", "block")
        far = (truth.join(spots.filter("kind = 1").select(F.col("id").alias("query_id"), "curve", F.col("block").alias("qb")), "query_id")
               .join(spots.filter("kind = 0").select(F.col("id").alias("vec_id"), "curve", F.col("block").alias("vb")), ["vec_id", "curve"])
               .select("query_id", "vec_id", "qb", "vb"))
        # A window that would leave the curve is moved, not cut.
        apart = F.abs(F.col("qb") - F.col("vb"))
        gap = F.least(apart, F.when(F.col("qb") < F.col("vb"), F.ceil(F.col("vb") / 2))
                      .otherwise(F.ceil((blocks - 1 - F.col("vb")) / 2)))
        gaps = [r[0] for r in far.groupBy("query_id", "vec_id").agg(F.min(gap).alias("g")).select("g").orderBy("g").collect()]
        reach = int(gaps[min(len(gaps) - 1, math.ceil(recall * len(gaps)) - 1)]) if gaps else 0
    width = min(blocks, 2 * reach + 1)
    if report is not None:
        report |= {"blocks": blocks, "reach": reach, "width": width}
    low = F.greatest(F.lit(0), F.least(F.col("block") - reach, F.lit(blocks - width)))
    asked = placed.filter("kind = 1").withColumn("block", F.explode(F.sequence(low, low + (width - 1))))

    # However wide the windows, a task takes one block and a bounded part of its queries.
    parts = materialize(asked.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts")), "parts")
    cols = ["curve", "kind", "id", "vec", "block", "chunk"]
    asked = asked.join(parts, ["curve", "block"]).withColumn("chunk", F.pmod(F.xxhash64("spot"), "parts")).select(cols)
    there = (placed.filter("kind = 0").join(parts, ["curve", "block"])
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(cols))
    if report is not None:
        report["queries"] = asked.groupBy("curve", "block", "chunk").count().agg(F.max("count")).first()[0]

    def search(table):
        kind, ids = table.column("kind").to_numpy(), table.column("id").to_numpy()
        m = matrix(table.column("vec"), dim)
        return pa.Table.from_batches([best_pairs(ids[kind == 1], m[kind == 1], ids[kind == 0], m[kind == 0], k)])

    return best_of(there.unionByName(asked).groupBy("curve", "block", "chunk").applyInArrow(search, RESULT), k)
