"""Vector columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, vec: str) -> int:
    """The commonest vector length (ties: the larger); 0 for no vectors."""
    top = (df.filter(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count()
           .orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    return int(top[0]["d"]) if top else 0


def usable(vec: str, dim: int) -> Column:
    """Vectors of that length, not zero, all components finite."""
    return F.coalesce(
        (F.size(vec) == dim)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """List column of vectors of one length as float64 rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, each computed the same way whatever the
    number of rows, so equal pairs get equal results in different tasks."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)),
                                    pa.array(np.ascontiguousarray(rows).reshape(-1)))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
