"""A stored vector index that grows, and is searched without being read whole
(SURVEY A5, A6, C3, D2, D3).

Vectors lie by cluster.  A vector belongs to its nearest *pivot*, and a part
of the index is range-partitioned by (pivot, distance to it, id): a *unit* is
the slice of one pivot's vectors in one file, so a cluster with very many
vectors is many units, even where all are alike.  A unit's statistics are its
size and the least and the largest distance to the pivot.  For a query at
distance d of the pivot, no vector of the unit is nearer than
``max(d - largest, least - d, 0)``: the triangle inequality.

* ``build`` writes the first part with pivots fitted on a bounded sample
  (``SAMPLE`` vectors; at most ``SAMPLE / 8`` pivots, so they broadcast).
* ``add`` appends vectors as another part under the pivots that are there.
  Files of earlier parts are not touched.
* ``compact`` writes all parts as one, with pivots of their own.
* ``search`` is exact.  Every query first reads the units of the least lower
  bounds until they hold k vectors; the k-th distance found there rules out
  all units whose bound is larger, and the others are read in a second pass.

The parts that belong to the index are named in a numbered manifest.  A writer
creates the next number if nobody has, else it reads the newest manifest,
applies its change to that one and tries again: of two writers one comes first
and neither's vectors are lost.  ``vacuum`` removes parts no manifest names.

    root/manifest/00000003.json     parts of version 3
    root/vectors/part=<p>/u=<file>/ vec_id, embedding, g, dist
    root/units/part=<p>/            u, g, n, lo, hi
    root/pivots/set=<s>/            g, pivot
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import knn
from lectern.operators.scan import drop_table, small_table
from lectern.session import scratch_path
from lectern.sources import manifest as manifests
from lectern.sources.manifest import Conflict, file_system

SAMPLE = 16_384             # vectors that the pivots are fitted on, about
UNIT_ROWS = 16_384          # vectors of a file at least
MAX_FILES = 1 << 17         # files of a part at most; larger ones beyond that
ROUNDS = 8                  # steps of the pivots' fit
VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, g INT, dist DOUBLE"


# ------------------------------------------------------------- manifest

def manifest(spark: SparkSession, root: str) -> dict:
    """The newest manifest: ``version``, ``parts`` (name, pivot set), ``next``."""
    return {"parts": [], **manifests.newest(spark, f"{root}/manifest")}


def commit(spark: SparkSession, root: str, base: dict, parts: list[dict]) -> dict:
    """Create the manifest that follows ``base``; Conflict if it is there."""
    return manifests.commit(spark, f"{root}/manifest", base, {"parts": parts})


def publish(spark: SparkSession, root: str, change, base: dict | None = None) -> dict:
    """Commit ``change(parts) -> parts`` on the newest manifest."""
    return manifests.update(spark, f"{root}/manifest", lambda state: {"parts": change(state.get("parts", []))}, base)


# ---------------------------------------------------------------- parts

def fit_pivots(vectors: DataFrame, n: int, dim: int, unit_rows: int = UNIT_ROWS, sample: int = SAMPLE) -> np.ndarray:
    """Cluster centres of about ``sample`` vectors, chosen by a hash of the id."""
    share = max(1, -(-n // sample))
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("vec_id", "embedding").toArrow()
    if not rows.num_rows:
        rows = vectors.select("vec_id", "embedding").limit(1).toArrow()
    x = knn.arrow_matrix(rows.take(pa.compute.sort_indices(rows.column("vec_id"))).column("embedding"), dim)
    k = int(np.clip(-(-2 * n // unit_rows), 1, max(1, len(x) // 8)))
    centres = x[np.random.default_rng(17).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near, _ = nearest_pivots(x, centres)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every row and the distance to it."""
    g, step = np.zeros(len(x), np.int64), max(1, knn.BLOCK_BUDGET_BYTES // (8 * len(pivots)))
    norm = (pivots * pivots).sum(axis=1)
    for s in range(0, len(x), step):
        g[s:s + step] = (norm[None, :] - 2.0 * (x[s:s + step] @ pivots.T)).argmin(axis=1)
    return g, np.sqrt(((x - pivots[g]) ** 2).sum(axis=1))


def _write_part(vectors: DataFrame, root: str, pivots: np.ndarray, pivot_set: str, n: int, unit_rows: int) -> dict:
    spark = vectors.sparkSession
    part, dim = uuid.uuid4().hex, pivots.shape[1]
    shared = spark.sparkContext.broadcast(pivots)       # at most SAMPLE / 8 vectors

    def assign(batches):
        for rb in batches:
            if rb.num_rows:
                g, dist = nearest_pivots(knn.arrow_matrix(rb.column("embedding"), dim), shared.value)
                yield pa.RecordBatch.from_arrays([rb.column("vec_id"), rb.column("embedding"), pa.array(g.astype(np.int32)),
                                                  pa.array(dist)], ["vec_id", "embedding", "g", "dist"])

    files = int(np.clip(-(-n // unit_rows), 1, MAX_FILES))
    (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
     .mapInArrow(assign, VECTORS).repartitionByRange(files, "g", "dist", "vec_id").sortWithinPartitions("g", "dist")
     .withColumn("u", F.spark_partition_id()).write.partitionBy("u").parquet(f"{root}/vectors/part={part}"))
    units = (spark.read.parquet(f"{root}/vectors/part={part}").groupBy("u", "g")
             .agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")))
    units.coalesce(1).write.parquet(f"{root}/units/part={part}")
    return {"part": part, "pivots": pivot_set}


def _size(vectors: DataFrame) -> tuple[int, int]:
    got = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return got["n"], got["d"] or 0


def _with_own_pivots(vectors: DataFrame, root: str, unit_rows: int, sample: int) -> list[dict]:
    spark = vectors.sparkSession
    n, dim = _size(vectors)
    if not n:
        return []
    pivots, name = fit_pivots(vectors, n, dim, unit_rows, sample), uuid.uuid4().hex
    spark.createDataFrame([(i, p) for i, p in enumerate(pivots.tolist())], "g INT, pivot ARRAY<DOUBLE>").coalesce(1).write.parquet(
        f"{root}/pivots/set={name}")
    return [_write_part(vectors, root, pivots, name, n, unit_rows)]


def build(vectors: DataFrame, root: str, unit_rows: int = UNIT_ROWS, sample: int = SAMPLE) -> dict:
    """The index of ``vec_id, embedding``, in the place of what was there."""
    parts = _with_own_pivots(vectors, root, unit_rows, sample)
    return publish(vectors.sparkSession, root, lambda _: parts)


def add(vectors: DataFrame, root: str, unit_rows: int = UNIT_ROWS, sample: int = SAMPLE) -> dict:
    """``index.add``: more vectors, as a part of their own.  Their ids are the
    caller's (``next_vec_id`` continues the positions)."""
    spark = vectors.sparkSession
    base = manifest(spark, root)
    if not base["parts"]:
        more = _with_own_pivots(vectors, root, unit_rows, sample)
    else:
        n, dim = _size(vectors)
        name = base["parts"][0]["pivots"]
        pivots = read_pivots(spark, root, name)
        if n and dim != pivots.shape[1]:
            raise ValueError(f"vectors of length {dim} for an index of length {pivots.shape[1]}")
        more = [_write_part(vectors, root, pivots, name, n, unit_rows)] if n else []
    return publish(spark, root, lambda parts: parts + more, base)


def compact(spark: SparkSession, root: str, unit_rows: int = UNIT_ROWS, sample: int = SAMPLE) -> dict:
    """All parts as one.  A part that another writer adds meanwhile stays beside it."""
    base = manifest(spark, root)
    old = {p["part"] for p in base["parts"]}
    if len(old) < 2:
        return base
    new = _with_own_pivots(read_vectors(spark, root, base), root, unit_rows, sample)

    def swapped(parts: list[dict]) -> list[dict]:
        if not old <= {p["part"] for p in parts}:
            raise RuntimeError("the index was rebuilt while it was compacted")
        return new + [p for p in parts if p["part"] not in old]

    return publish(spark, root, swapped, base)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove parts and pivots that the newest manifest doesn't name: those of
    earlier versions and of writers that failed.  Not for use while another
    writer is at work.  Returns how many folders went."""
    parts = manifest(spark, root)["parts"]
    keep = {f"part={p['part']}" for p in parts} | {f"set={p['pivots']}" for p in parts}
    gone = 0
    for kind in ("vectors", "units", "pivots"):
        folder, fs = file_system(spark, f"{root}/{kind}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in keep:
                gone += bool(fs.delete(s.getPath(), True))
    return gone


# -------------------------------------------------------------- reading

def read_vectors(spark: SparkSession, root: str, of: dict | None = None) -> DataFrame:
    """``vec_id, embedding`` of the whole index."""
    parts = (of or manifest(spark, root))["parts"]
    if not parts:
        return spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")
    return (spark.read.option("basePath", f"{root}/vectors").parquet(*[f"{root}/vectors/part={p['part']}" for p in parts])
            .select("vec_id", "embedding"))


def read_pivots(spark: SparkSession, root: str, name: str) -> np.ndarray:
    rows = spark.read.parquet(f"{root}/pivots/set={name}").orderBy("g").toArrow()
    pivots = rows.column("pivot").combine_chunks()
    return pivots.flatten().to_numpy().reshape(len(pivots), -1)


def next_vec_id(spark: SparkSession, root: str) -> int:
    last = read_vectors(spark, root).agg(F.max("vec_id")).first()[0]
    return 0 if last is None else last + 1


class Units:
    """Statistics of all units of a version, by position."""

    def __init__(self, spark: SparkSession, root: str, parts: list[dict]):
        rows = (spark.read.option("basePath", f"{root}/units").parquet(*[f"{root}/units/part={p['part']}" for p in parts])
                .select("part", "u", "g", "n", "lo", "hi").toPandas().sort_values(["part", "u", "g"]))
        sets = sorted({p["pivots"] for p in parts})
        pivots = [read_pivots(spark, root, s) for s in sets]
        first = dict(zip(sets, np.cumsum([0] + [len(p) for p in pivots]).tolist()))
        of = {p["part"]: first[p["pivots"]] for p in parts}
        self.part, self.u, self.g = rows["part"].tolist(), rows["u"].tolist(), rows["g"].tolist()
        self.pivots = np.concatenate(pivots)
        self.pivot = rows["g"].to_numpy(np.int64) + np.array([of[p] for p in self.part], dtype=np.int64)
        self.n, self.lo, self.hi = (rows[c].to_numpy() for c in ("n", "lo", "hi"))

    def __len__(self) -> int:
        return len(self.u)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, units): no vector of the unit is nearer."""
        d2 = (queries ** 2).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1)[None, :] - 2.0 * (queries @ self.pivots.T)
        d = np.sqrt(np.maximum(d2, 0.0))[:, self.pivot]
        # A margin for the rounding of the product form.
        slack = 1e-6 * (1.0 + d)
        return np.maximum(np.maximum(d - self.hi, self.lo - d) - slack, 0.0)

    def first(self, bounds: np.ndarray, ks: np.ndarray) -> np.ndarray:
        """(queries, units): the units of the least bounds that hold k vectors."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(out, order, before < ks[:, None], axis=1)
        return out


def _wanted(units: Units, block: knn.Block, kth: np.ndarray | None) -> np.ndarray:
    """Packed (queries, units) bits: what the first pass reads, or (``kth``
    distances known) what is still to be read."""
    out, step = [], max(1, knn.BLOCK_BUDGET_BYTES // (32 * max(1, len(units))))
    for s in range(0, len(block.mat), step):
        low = units.bounds(block.mat[s:s + step])
        mask = units.first(low, block.ks[s:s + step])
        if kth is not None:
            mask = ~mask & (low <= kth[s:s + step, None])
        out.append(np.packbits(mask, axis=1))
    return np.concatenate(out)


def _read_units(spark: SparkSession, root: str, units: Units, block: knn.Block, wanted: np.ndarray) -> DataFrame | None:
    """Hits (by position of the query in its block) in the units that some
    query wants; no other file is opened."""
    some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(wanted, axis=0))[:len(units)])
    if not len(some):
        return None
    files = sorted({f"{root}/vectors/part={units.part[i]}/u={units.u[i]}" for i in some.tolist()})
    place: dict[tuple, dict[int, int]] = {}
    for i in some.tolist():
        place.setdefault((units.part[i], units.u[i]), {})[units.g[i]] = i
    # At most the block's bytes and, for each file read, its units.
    shared = spark.sparkContext.broadcast((block.mat, block.ks, wanted, place))
    dim = block.mat.shape[1]

    def per_partition(batches):
        mat, ks, bits, where = shared.value
        top = knn.TopK(mat, ks)
        for rb in batches:
            if not rb.num_rows:
                continue
            g, u = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("g", "u"))
            part = rb.column("part").dictionary_encode()
            name = part.indices.to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]) | (u[1:] != u[:-1]) | (name[1:] != name[:-1])) + 1
            ids = rb.column("vec_id").to_numpy()
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), rb.num_rows]):
                unit = where.get((part.dictionary[int(name[s])].as_py(), int(u[s])), {}).get(int(g[s]))
                if unit is None:
                    continue
                rows = np.flatnonzero(bits[:, unit >> 3] >> (7 - (unit & 7)) & 1)
                step = top.batch_rows()
                for a in range(s, e, step):
                    b = min(e, a + step)
                    top.add(knn.arrow_matrix(rb.column("embedding").slice(a, b - a), dim), ids[a:b], rows)
        yield top.hits(np.arange(len(mat)))

    table = (spark.read.option("basePath", f"{root}/vectors").schema(VECTORS + ", part STRING, u INT").parquet(*files))
    return table.select("vec_id", "embedding", "g", "u", "part").mapInArrow(per_partition, knn.HIT_SCHEMA)


def search(spark: SparkSession, root: str, queries: DataFrame, k: int | None = None, qid_col: str = "qid",
           qvec_col: str = "qvec", k_col: str | None = None, broadcast_cap: int = knn.DEFAULT_BROADCAST_CAP) -> tuple[DataFrame, dict]:
    """The same rows as ``knn.nearest`` over all vectors, and how much was
    read: units of the index, units read, and both counted for every query."""
    of = manifest(spark, root)
    q = knn.query_table(queries, k, qid_col, qvec_col, k_col)
    report = {"units": 0, "units_read": 0, "pairs": 0, "pairs_read": 0}
    nothing = spark.createDataFrame([], "qid LONG, vec_id LONG, d2 DOUBLE, rk INT")
    if not of["parts"]:
        return nothing, report
    units = Units(spark, root, of["parts"])
    dim = units.pivots.shape[1]
    # Vectors and bits of a block's queries stay within the bound.
    max_rows = max(1, broadcast_cap // (8 * dim + len(units) // 4))
    base, read = scratch_path(spark, f"knn-hits-{uuid.uuid4().hex}"), np.zeros(len(units), dtype=bool)
    written = False
    for b, (block, _) in enumerate(knn.query_blocks(q, dim, max_rows)):
        if not len(block.qids):
            break
        found, kth = [], None
        for turn in (0, 1):
            wanted = _wanted(units, block, kth)
            hits = _read_units(spark, root, units, block, wanted)
            if hits is None:
                continue
            mask = np.unpackbits(wanted, axis=1)[:, :len(units)]
            read |= mask.any(axis=0)
            report["pairs_read"] += int(mask.sum())
            hits = small_table(hits, "unit-hits")
            found.append(hits)
            if turn == 0:
                # The k-th distance of every query of the block so far.
                got = (knn.best(hits, None).groupBy("qid").agg(F.max("rk").alias("rk"), F.max("d2").alias("d2")).toPandas())
                kth = np.full(len(block.qids), math.inf)
                at, rk = got["qid"].to_numpy(np.int64), got["rk"].to_numpy(np.int64)
                full = rk >= block.ks[at]
                kth[at[full]] = np.sqrt(got["d2"].to_numpy()[full] + 1e-12) * (1 + 1e-9) + 1e-9
        report["pairs"] += len(block.qids) * len(units)
        names = spark.createDataFrame(pa.table({"qid": pa.array(range(len(block.qids)), pa.int64()),
                                                "named": pa.array(block.qids, pa.int64())}))
        hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        (knn.best(hits, None).join(names, "qid").select(F.col("named").alias("qid"), "vec_id", "d2", "rk")
         .write.parquet(f"{base}/block={b}"))
        written = True
        for t in found:
            drop_table(t)
    report |= {"units": len(units), "units_read": int(read.sum())}
    return (spark.read.parquet(base).select("qid", "vec_id", "d2", "rk") if written else nothing), report
