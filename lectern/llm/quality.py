"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its trigrams of character classes, the shapes of its
words, and repetition (words equal to the one or the second before, lines
that came before).  Shares of terms, weighted by inverse document frequency,
are projected by a truncated singular value decomposition of labelled
documents.  The latent vectors of those documents are broadcast, every
document's cosines with all of them are computed exactly, block by block, and
the labels of the nearest vote with weights that grow with the cosine.

The fit sees a bounded sample: of each label the ``SAMPLE`` labelled
documents with the smallest hashes.

Defined cases: a null or empty text gets the share of label 1 among the rows
that may be learned from; rows with a null label are not learned from;
without labels every score is 0.5; repeated rows get equal scores, whatever
rows they are read with (cosines count to ten decimals; of neighbours that tie
at the edge, those with smaller doc_id vote); result columns replace input
columns of the same names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import SPACE, bounded_batches, run_hashes, runs, text_bytes

SAMPLE = 800             # labelled documents of each label that the fit sees
LATENT = 48
NEIGHBOURS = 15
SHARPNESS = 8            # power of the cosine that weighs a vote
ROWS = 256               # documents whose terms are counted at once

CLASSES = 16
SHAPES = 512
EXTRA = 6
TERMS = CLASSES ** 3 + SHAPES + EXTRA

_CLASS = np.full(256, 9, dtype=np.int64)        # other punctuation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[128:192], _CLASS[192:] = 3, 4            # later and first bytes beyond ASCII
_CLASS[:32] = 6
_CLASS[[9, 32]], _CLASS[10] = 5, 6
_CLASS[ord(".")], _CLASS[ord(",")] = 7, 8
for _c, _k in zip("!|*$#%", (10, 11, 12, 13, 14, 15)):
    _CLASS[ord(_c)] = _k


def term_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, term) square roots of shares; each group of terms sums to 1."""
    n, size = len(offsets) - 1, len(data)
    out = np.zeros((n, TERMS), dtype=np.float32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    tri = CLASSES ** 3
    if size >= 3:
        c = _CLASS[data]
        code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        whole = row[:-2] == row[2:]
        out[:, :tri] = np.bincount(row[:-2][whole] * tri + code[whole], minlength=n * tri).reshape(n, tri)
    s, e, wrow = runs(~SPACE[data], offsets)
    if len(s):
        upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
        shout = (upper[e] - upper[s]) * 2 > (e - s)
        length = np.minimum(np.log2(e - s).astype(np.int64), 1) + ((e - s) > 3) + ((e - s) > 8)
        shape = _CLASS[data[s]] * 32 + (_CLASS[data[e - 1]] % 8) * 4 + length
        out[:, tri:tri + SHAPES] = np.bincount(wrow * SHAPES + shape % SHAPES, minlength=n * SHAPES).reshape(n, SHAPES)
        h = run_hashes(data, s, e)
        words = np.bincount(wrow, minlength=n)
        again = np.zeros((3, len(s)), dtype=bool)
        for k in (1, 2):
            again[k - 1, k:] = (h[k:] == h[:-k]) & (wrow[k:] == wrow[:-k])
        again[2] = shout
        extra = np.column_stack([np.bincount(wrow[a], minlength=n) for a in again]).astype(np.float32)
        ls, le, lrow = runs(data != 10, offsets)
        lh = run_hashes(data, ls, le) ^ lrow.astype(np.uint64)
        _, first = np.unique(lh, return_index=True)
        seen = np.ones(len(lh), dtype=bool)
        seen[first] = False
        lines = np.bincount(lrow, minlength=n)
        at = tri + SHAPES
        out[:, at:at + 3] = extra / np.maximum(words, 1)[:, None]
        out[:, at + 3] = np.bincount(lrow[seen], minlength=n) / np.maximum(lines, 1)
        out[:, at + 4] = (words > 0) * 0.05
    for a, b in ((0, tri), (tri, tri + SHAPES)):
        total = out[:, a:b].sum(axis=1, keepdims=True)
        out[:, a:b] /= np.where(total > 0, total, 1)
    return np.sqrt(out)


def blocks_of(texts: pa.Array):
    """(first row, shares) of a column, a bounded number of rows at a time."""
    for i in range(0, len(texts), ROWS):
        yield i, term_shares(*text_bytes(texts.slice(i, ROWS)))


class Voter:
    """Projection, latent vectors of the labelled documents and their labels."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, prior: float, latent: int = LATENT):
        self.prior, self.labels = prior, labels.astype(np.float32)
        if not len(shares):
            self.project, self.vectors = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        idf = 1 + np.log((1 + len(shares)) / (1 + (shares > 0).sum(axis=0)))
        x = shares * idf
        # Right singular vectors from the smaller Gram matrix.
        values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
        top = np.argsort(values)[::-1][:min(latent, len(values))]
        top = top[values[top] > 1e-9 * max(values.max(), 1e-12)]
        right = (x.T @ left[:, top]) / np.sqrt(values[top])
        self.project = (idf[:, None] * right).astype(np.float32)
        self.vectors = unit(shares @ self.project).astype(np.float32)

    def scores(self, shares: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(shares), self.prior)
        v = unit(shares.astype(np.float64) @ self.project.astype(np.float64))
        # The last digits depend on the rows of a block; without them equal
        # documents have equal cosines and equal neighbours.
        cosine = np.round(v @ self.vectors.astype(np.float64).T, 10)
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        # Ties at the edge: the first ones, in order of doc_id.
        edge = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((cosine >= edge).sum(axis=1) > k)
        near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
        near.sort(axis=1)
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = w.sum(axis=1)
        vote = (w * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where((total > 0) & (np.abs(v).sum(axis=1) > 0), np.clip(vote, 0, 1), self.prior)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Voter:
    """``docs`` (doc_id, text, ...), ``labels`` (doc_id, quality); ``learn``
    (on doc_id) marks rows that may be learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(learn & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    prior = known.agg(F.avg("quality")).first()[0]
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() for q in (0, 1)]
    rows = [(r["doc_id"], r["quality"]) for p in picked for r in p]
    if not rows:
        return Voter(np.zeros((0, TERMS), np.float32), np.zeros(0), 0.5 if prior is None else float(prior))
    chosen = spark.createDataFrame(rows, "doc_id LONG, quality INT")      # at most 2 * sample rows

    @arrow_udf("binary")
    def shares(texts: pa.Array) -> pa.Array:
        return pa.array([r.astype(np.float16).tobytes() for _, s in blocks_of(texts) for r in s], pa.binary())

    got: pd.DataFrame = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                         .select("doc_id", "quality", shares("text").alias("s")).orderBy("doc_id", "quality", "s").toPandas())
    x = np.frombuffer(b"".join(got["s"]), np.float16).reshape(len(got), TERMS).astype(np.float32)
    some = x.sum(axis=1) > 0
    return Voter(x[some], got["quality"].to_numpy()[some], float(prior))


def score(docs: DataFrame, voter: Voter, name: str = "score") -> DataFrame:
    """Add the voted score of ``text`` (0 to 1, higher: label 1 likelier)."""
    bounded_batches(docs.sparkSession)
    # Arrays only (a few MB at most: TERMS * LATENT and 2 * SAMPLE * LATENT floats).
    shared = docs.sparkSession.sparkContext.broadcast((voter.project, voter.vectors, voter.labels, voter.prior))

    @arrow_udf("double")
    def vote(texts: pa.Array) -> pa.Array:
        v = Voter(np.zeros((0, TERMS), np.float32), np.zeros(0), 0.5)
        v.project, v.vectors, v.labels, v.prior = shared.value
        return pa.array(np.concatenate([np.zeros(0)] + [v.scores(s) for _, s in blocks_of(texts)]), pa.float64())

    return docs.withColumn(name, vote(F.col("text")))
