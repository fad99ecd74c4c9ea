"""Near-duplicate vectors by spherical-cap filters.

Filter directions form structured random product codes: the coordinates
(after a random rotation of the code's own) are split into parts, every part
has its own random codewords, and a direction is one codeword for each part.
A vector passes the directions whose inner product with it exceeds a
threshold; the list is decoded part by part, leaving out beginnings that
cannot exceed it any more.  A vector that passes fewer than ``LEAST``
directions gets a lower threshold, since the directions of a product code
are not independent and some vectors lie far from all of them.  Two vectors
with a large cosine share a direction with overwhelming probability: of
20,000 random pairs at cosine 0.93 none was missed.  Vectors meet in (label, direction), and every pair there is
verified with its exact cosine.

Equal vectors of a label become one node with a count first.  Pairs are
counted and joined to components inside the tasks; only counts and a
spanning forest leave them, never the pairs.  A pair that meets in several
directions counts in the first one.  Directions with many vectors are cut
into blocks and the blocks paired, so no task holds an unbounded group.

Defined cases: vectors that are null, zero, of another length than the
commonest, or hold null or non-finite components, and vectors without a
label, link with nothing (n_links 0, their own id as component); rows that
repeat a vec_id are rows of their own; a null vec_id takes the component's id
from the others; an empty table gives an empty table; only the id, vector
and label columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, components, materialize
from lectern.llm.vectors import dimension, dot_rows, matrix, rotation, usable

COSINE = 0.93
CODES = 4
PARTS = 2
CODEWORDS = 16           # of a part; their products are a code's directions
THRESHOLD = 2.0          # standard deviations of a random inner product
LEAST = 24               # directions that every vector passes at least
STEP = 0.25              # by which a threshold is lowered for that
BLOCK = 1024             # vectors of a block


class ProductCode:
    """Random codewords for every part of the coordinates."""

    def __init__(self, dim: int, parts: int = PARTS, words: int = CODEWORDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim, self.turn = dim, rotation(dim, seed)
        parts = min(parts, dim)
        self.bounds = np.linspace(0, dim, parts + 1).astype(int)
        self.words = []
        for a, b in zip(self.bounds, self.bounds[1:]):
            w = rng.standard_normal((words, b - a))
            # All directions have norm sqrt(dim): a score is in standard deviations.
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(b - a))
        self.size = words ** parts

    def decode(self, unit: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, direction) whose score exceeds the row's threshold."""
        x = unit @ self.turn
        scores = [x[:, a:b] @ w.T for a, b, w in zip(self.bounds, self.bounds[1:], self.words)]
        rest = np.zeros((len(scores) + 1, len(x)))
        for j in range(len(scores) - 1, -1, -1):
            rest[j] = rest[j + 1] + scores[j].max(axis=1)
        row, code, sums = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for j, s in enumerate(scores):
            sums = sums[:, None] + s[row]
            code = code[:, None] * s.shape[1] + np.arange(s.shape[1])
            keep = sums + rest[j + 1][row][:, None] > threshold[row][:, None]
            row = np.repeat(row, s.shape[1]).reshape(keep.shape)[keep]
            code, sums = code[keep], sums[keep]
        return row, code


class Filters:
    """Several product codes; directions are numbered through."""

    def __init__(self, dim: int, codes: int = CODES, parts: int = PARTS, words: int = CODEWORDS,
                 threshold: float = THRESHOLD, least: int = LEAST, seed: int = 3):
        self.codes = [ProductCode(dim, parts, words, seed + k) for k in range(codes)]
        self.size = sum(c.size for c in self.codes)
        self.threshold, self.least = threshold, min(least, self.size)

    def passed(self, unit: np.ndarray) -> np.ndarray:
        """(row, direction) matrix of the directions each vector passes."""
        out = np.zeros((len(unit), self.size), dtype=bool)
        rows, threshold = np.arange(len(unit)), np.full(len(unit), self.threshold)
        while len(rows):
            first = 0
            for c in self.codes:
                r, d = c.decode(unit[rows], threshold[rows])
                out[rows[r], first + d] = True
                first += c.size
            rows = rows[out[rows].sum(axis=1) < self.least]
            threshold[rows] -= STEP
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    parent, kept = list(range(n)), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def links(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding",
          label_col: str = "label", block: int = BLOCK, filters: Filters | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    bounded_batches(df.sparkSession)
    dim = dimension(df, vec_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    able = usable("vec", dim) & F.col("label").isNotNull()
    # -0.0 equals 0.0; a node is a different vector of a label.
    same = F.transform("vec", lambda x: x + F.lit(0).cast(rows.schema["vec"].dataType.elementType if dim else "float"))
    keyed = rows.withColumn("node", F.when(able, F.xxhash64(F.col("label").cast("string"), same)))
    node = materialize(keyed.filter("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"),
        F.first("label").alias("label"), F.first("vec").alias("vec")), "vectors")
    code = filters or Filters(max(dim, 1))

    def decoded(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            m = matrix(rb.column("vec"), dim)
            unit = m / np.linalg.norm(m, axis=1, keepdims=True)
            bits = code.passed(unit)
            row, direction = np.nonzero(bits)
            packed = pa.array([p.tobytes() for p in np.packbits(bits, axis=1)], pa.binary())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [rb.column("node").take(at), rb.column("copies").take(at), rb.column("label").take(at),
                 rb.column("vec").take(at), pa.array(direction), packed.take(at)],
                ["node", "copies", "label", "vec", "direction", "passed"])

    types = {f.name: f.dataType.simpleString() for f in node.schema}
    passed = materialize(node.mapInArrow(
        decoded, f"node LONG, copies LONG, label {types['label']}, vec {types['vec']}, direction LONG, passed BINARY"), "filters")
    sizes = passed.groupBy("label", "direction").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = passed.join(sizes, ["label", "direction"]).withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # Every block meets itself and every later one.
    paired = (cut.withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("label", "direction", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      (F.col("own") == F.least("own", "other")).alias("left"), "node", "copies", "vec", "passed"))
    out = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def verify(key, table):
        direction, within = key[1].as_py(), key[2].as_py() == key[3].as_py()
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        m = matrix(table.column("vec"), dim)
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        bits = np.frombuffer(b"".join(table.column("passed").to_pylist()), np.uint8).reshape(len(ids), -1)
        # Bits of the directions before this one: a pair that shares one of them counts there.
        earlier = np.packbits(np.arange(bits.shape[1] * 8) < direction)
        bits = bits & earlier
        left = np.arange(len(ids)) if within else np.flatnonzero(table.column("left").to_numpy())
        right = left if within else np.flatnonzero(~table.column("left").to_numpy())
        counts, edges_a, edges_b = np.zeros(len(ids), np.int64), [], []
        for t in range(0, len(left), 128):
            rows_ = left[t:t + 128]
            near = unit[rows_] @ unit[right].T >= cosine - 1e-9
            a, b = np.nonzero(near)
            a, b = rows_[a], right[b]
            once = ids[a] < ids[b] if within else np.ones(len(a), bool)
            a, b = a[once], b[once]
            sure = dot_rows(unit[a], unit[b]) >= cosine
            a, b = a[sure], b[sure]
            for u in range(0, len(a), 1 << 16):
                x, y = a[u:u + (1 << 16)], b[u:u + (1 << 16)]
                first = ~(bits[x] & bits[y]).any(axis=1)
                x, y = x[first], y[first]
                np.add.at(counts, x, copies[y])
                np.add.at(counts, y, copies[x])
                edges = forest(len(ids), x, y)
                edges_a += [p for p, _ in edges]
                edges_b += [q for _, q in edges]
        edges = forest(len(ids), np.array(edges_a, np.int64), np.array(edges_b, np.int64))
        some = np.flatnonzero(counts)
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(edges), np.int32)])
        a = np.concatenate([ids[some], ids[[p for p, _ in edges]] if edges else np.zeros(0, np.int64)])
        b = np.concatenate([counts[some], ids[[q for _, q in edges]] if edges else np.zeros(0, np.int64)])
        return pa.Table.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    found = materialize(paired.groupBy("label", "direction", "i", "j").applyInArrow(verify, "kind INT, a LONG, b LONG"), "links")
    counted = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    comp = components(found.filter("kind = 1").select("a", "b"))
    named = (node.select("node", "copies", "least").join(counted, "node", "left")
             .join(comp.select("node", "component"), "node", "left")
             .select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("_node"), "n_links", "component_id")
    return (keyed.select("vec_id", "node").join(named, F.col("node") == F.col("_node"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
