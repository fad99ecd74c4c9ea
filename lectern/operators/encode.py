"""Text encoding and vector tables.

The default encoder is a *hashed bag of words*: lower-case the text, take
the tokens ``[a-z0-9]+``, map each token to a bucket with the first 28 bits
of its MD5 (mod ``dim``), count, and scale the count vector to unit length.
The dense vectors come from an Arrow-native UDF over small batches (a
token's bucket is computed once for each worker, ``np.bincount`` counts a
batch's buckets), so encoding needs no shuffle and keeps the input
partitioning.  ``bucket_array`` is the same in Spark SQL functions.

A learned sentence encoder can replace it through ``encode_with_model``:
``mapInPandas`` loads a user-supplied model once per task.  No such model
ships here.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.scan import drop_table, small_table
from lectern.session import bounded_batches

DEFAULT_DIM = 384
TOKEN_PATTERN = "[a-z0-9]+"
HASH_HEX_DIGITS = 7
BLOCK_TEXTS = 128        # texts encoded at once
KEPT_TOKENS = 200_000    # tokens whose buckets a worker keeps between batches


def tokens(text_col) -> Column:
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))),
                                F.lit(TOKEN_PATTERN), 0)


def token_bucket(tok: Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of a token: first 7 hex digits of md5, as integer, mod dim."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, HASH_HEX_DIGITS), 16, 10)
                  .cast("long"), F.lit(dim)).cast("int")


def bucket_array(text_col, dim: int = DEFAULT_DIM) -> Column:
    return F.transform(tokens(text_col), lambda t: token_bucket(t, dim))


def term_buckets(df: DataFrame, id_col: str, text_col: str,
                 dim: int = DEFAULT_DIM) -> DataFrame:
    """Sparse form: ``id, bucket, tf`` (one row per non-empty bucket).

    Tokens of one row sit in one partition, so the partial aggregate leaves
    at most ``dim`` rows per text before the shuffle.
    """
    return (df.select(F.col(id_col).alias("id"),
                      F.explode(bucket_array(text_col, dim)).alias("bucket"))
              .groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("tf")))


class Buckets(dict):
    """Buckets of tokens, each computed once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        self[token] = got = int(hashlib.md5(token.encode()).hexdigest()[:HASH_HEX_DIGITS], 16) % self.dim
        return got


def _unit_vectors(dim: int):
    """Arrow-native UDF: lower-cased texts -> unit count vectors."""
    kept: dict[int, Buckets] = {}

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def to_unit(texts: pa.Array) -> pa.Array:
        of = kept.setdefault(dim, Buckets(dim))
        find, n = re.compile(TOKEN_PATTERN).findall, len(texts)
        unit = np.empty((n, dim), np.float32)
        # A few texts at a time: counts and their products take eight bytes a cell.
        for s in range(0, n, BLOCK_TEXTS):
            part = texts.slice(s, BLOCK_TEXTS).to_pylist()
            lengths, flat = np.zeros(len(part), np.int64), []
            for i, text in enumerate(part):
                found = find(text)
                lengths[i] = len(found)
                flat.append(np.fromiter(map(of.__getitem__, found), np.int32, len(found)))
            rows = np.repeat(np.arange(len(part), dtype=np.int64), lengths)
            counts = np.bincount(rows * dim + np.concatenate([np.zeros(0, np.int32), *flat]), minlength=len(part) * dim)
            counts = counts.reshape(len(part), dim).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1))
            norms[norms == 0] = 1.0
            unit[s:s + len(part)] = counts / norms[:, None]
        offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel(), pa.float32()))
    return to_unit


def encode_hashed(df: DataFrame, text_col: str = "text",
                  dim: int = DEFAULT_DIM, out_col: str = "embedding") -> DataFrame:
    """C1 / C1q: add ``out_col`` ARRAY<FLOAT> of length ``dim``.

    A text without tokens encodes to the zero vector.
    """
    bounded_batches(df.sparkSession)
    return df.withColumn(out_col, _unit_vectors(dim)(F.lower(F.coalesce(F.col(text_col), F.lit("")))))


def encode_with_model(df: DataFrame, load_model, text_col: str = "text",
                      out_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """C1 (pluggable): ``load_model()`` returns an object with
    ``encode(list[str]) -> 2-D array``; it is called once per task."""
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        model = load_model()
        for pdf in batches:
            vecs = np.asarray(model.encode(pdf[text_col].fillna("").tolist()),
                              dtype=np.float32)
            if dim is not None and vecs.shape[1] != dim:
                raise ValueError("encoder output length differs from dim")
            yield pdf.assign(**{out_col: list(vecs)})

    return df.mapInPandas(run, schema)


def vector_dimension(vectors: DataFrame, vec_col: str = "embedding") -> int:
    """The common vector length; raises when lengths differ."""
    row = vectors.agg(F.min(F.size(vec_col)).alias("lo"),
                      F.max(F.size(vec_col)).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no vectors")
    if row["lo"] != row["hi"]:
        raise ValueError(f"vector lengths differ: {row['lo']}..{row['hi']}")
    return int(row["lo"])


def dimension_check(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """C2 as a table: ``dim_min, dim_max, n, consistent``."""
    return vectors.agg(F.min(F.size(vec_col)).cast("long").alias("dim_min"),
                       F.max(F.size(vec_col)).cast("long").alias("dim_max"),
                       F.count(F.lit(1)).alias("n")) \
        .withColumn("consistent", F.col("dim_min") == F.col("dim_max"))


def assign_vec_ids(verses: DataFrame, file_col: str = "file",
                   order_col: str = "line_no") -> DataFrame:
    """Stable dense ``vec_id`` = position in (file, line) order, from 0.

    The verses are written, so that the ranges' bounds are not sampled by
    another run of all that made them, range-partitioned in that order (a
    large book takes several ranges), sorted inside each range and written
    once more; the first copy goes.  A position
    is the rows of earlier ranges plus the place in its own, so the only
    window runs over one row per range, however many files there are.
    """
    plain = small_table(verses, "unordered")
    ordered = small_table(
        plain.repartitionByRange(file_col, order_col).sortWithinPartitions(file_col, order_col)
        .withColumn("_at", F.monotonically_increasing_id()), "ordered")
    drop_table(plain)
    part = F.shiftright("_at", 33)
    ranges = ordered.groupBy(part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_table(ranges.select(
        "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "range-offsets")
    return (ordered.withColumn("_part", part).join(offsets, "_part")
            .withColumn("vec_id", (F.col("_before") + F.col("_at") - F.col("_first")).cast("long"))
            .drop("_part", "_at", "_first", "_before"))
