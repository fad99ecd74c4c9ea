"""Relevance feedback -> labelled training pairs.

Feedback records are ``query, verse_id, is_relevant, timestamp`` plus a
unique ``fid`` that breaks timestamp ties (the reference's store orders by
timestamp only; ties are store-internal there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scan import small_table

# Fixed values of the training-set builder (must equal the reference).
LATEST_N = 100
POSITIVE_LABEL = 1.0
NEGATIVE_LABEL = 0.0

MAX_LATEST = 10_000         # the newest records go through the driver and one window

FEEDBACK_COLUMNS = ["fid", "query", "verse_id", "is_relevant", "timestamp"]
REASON_QUERY = "query missing"
REASON_VERSE = "verse_id missing"
REASON_FLAG = "is_relevant not a boolean"


def newest_rows(feedback: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` records (timestamp desc, fid desc), projected.  Sort +
    limit plans as ``TakeOrderedAndProject``: each task keeps its own top
    ``n`` and only those are merged."""
    return (feedback.orderBy(F.col("timestamp").desc(), F.col("fid").desc())
                    .limit(n)
                    .select(*FEEDBACK_COLUMNS))


def latest(feedback: DataFrame, n: int = LATEST_N) -> DataFrame:
    """E1 + E2: newest ``n`` records, ``n`` at most ``MAX_LATEST``.

    The result is materialised once as a small local table; the split, the
    lookup and the consume then reuse it instead of scanning the store again
    for every use.
    """
    if not 0 <= n <= MAX_LATEST:
        raise ValueError(f"n must be from 0 to {MAX_LATEST}")
    top = newest_rows(feedback, n)
    spark = feedback.sparkSession
    return spark.createDataFrame(top.collect(), top.schema)


def split_by_relevance(recent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positives and negatives of the already limited set.  The filters
    stay above the limit (Catalyst does not push a filter below a limit)."""
    pos = recent.filter(F.col("is_relevant")).select("fid", "query", "verse_id", "timestamp")
    neg = recent.filter(~F.col("is_relevant")).select("fid", "query", "verse_id", "timestamp")
    return pos, neg


def first_texts(verses: DataFrame, order_col: str = "vec_id") -> DataFrame:
    """E4 helper: one text per ``verse_id`` - the row with the lowest
    ``order_col`` (the first match in index order).  The aggregate keeps
    numbers only; the text joins its winner afterwards."""
    least = verses.groupBy("verse_id").agg(F.min(order_col).alias("_first"))
    return (verses.join(least.withColumnRenamed("verse_id", "_id"),
                        (F.col(order_col) == F.col("_first")) & (F.col("verse_id") == F.col("_id")))
                  .select("verse_id", F.col("text").alias("verse_text")))


def lookup_texts(pairs: DataFrame, verses: DataFrame, strict: bool = False,
                 order_col: str = "vec_id") -> DataFrame:
    """Attach the verse text by id (first match).  ``strict`` raises when
    an id is unknown, like the reference; otherwise unknown ids drop out
    (see ``missing_ids``).

    Only ids that occur in the pairs matter, so the verse table is cut down
    by a semi-join before the first-match aggregate.  The ids are a written
    table of known size: the planner broadcasts them while they are few.
    """
    wanted = small_table(pairs.select("verse_id").distinct(), "pair-ids")
    texts = first_texts(verses.join(wanted, "verse_id", "left_semi"), order_col)
    if strict:
        missing = pairs.join(texts, "verse_id", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(f"unknown verse_id {missing[0]['verse_id']!r}")
    return pairs.join(texts, "verse_id", "inner")


def missing_ids(pairs: DataFrame, verses: DataFrame) -> DataFrame:
    """Feedback rows whose verse_id is not in the verse table."""
    wanted = small_table(pairs.select("verse_id").distinct(), "pair-ids")
    known = verses.select("verse_id").join(wanted, "verse_id", "left_semi").distinct()
    return pairs.join(known, "verse_id", "left_anti")


def labelled_pairs(recent: DataFrame, verses: DataFrame, strict: bool = False,
                   order_col: str = "vec_id") -> DataFrame:
    """E3 + E4 + E5: ``ord, fid, query, verse_id, verse_text, label``.

    Positives (1.0) come first, then negatives (0.0), each newest first.
    The input is the bounded latest-N set, so the global ``ord`` window runs
    over at most N rows.
    """
    pos, neg = split_by_relevance(recent)
    both = (pos.withColumn("label", F.lit(POSITIVE_LABEL))
               .unionByName(neg.withColumn("label", F.lit(NEGATIVE_LABEL))))
    joined = lookup_texts(both, verses, strict=strict, order_col=order_col)
    w = Window.orderBy(F.col("label").desc(), F.col("timestamp").desc(), F.col("fid").desc())
    return joined.select((F.row_number().over(w) - 1).alias("ord"), "fid", "query",
                         "verse_id", "verse_text", "label")


def guard_counts(recent: DataFrame) -> DataFrame:
    """One row of counts; ``proceed`` is false when there is nothing to
    train on (the reference stops there)."""
    return recent.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.col("is_relevant"), 1)).alias("n_pos"),
        F.count(F.when(~F.col("is_relevant"), 1)).alias("n_neg"),
    ).withColumn("proceed", F.col("n_total") > 0)


def consume(feedback: DataFrame, used: DataFrame, mode: str = "used") -> DataFrame:
    """The feedback left after training.

    ``used`` removes the records given (those that went into the training
    set); ``all`` empties the store, as the reference does.
    """
    if mode == "all":
        return feedback.limit(0)
    if mode != "used":
        raise ValueError("mode must be 'used' or 'all'")
    return feedback.join(used.select("fid"), "fid", "left_anti")


def validate_records(raw: DataFrame) -> DataFrame:
    """Typed feedback plus ``reason`` (null when valid).

    ``raw`` has string-typed ``query, verse_id, is_relevant`` (and
    optionally ``timestamp``); ``is_relevant`` must parse as a boolean.
    """
    flag = F.expr("try_cast(is_relevant AS BOOLEAN)") \
        if dict(raw.dtypes).get("is_relevant") != "boolean" else F.col("is_relevant")
    reason = (F.when(F.col("query").isNull(), F.lit(REASON_QUERY))
               .when(F.col("verse_id").isNull(), F.lit(REASON_VERSE))
               .when(F.col("_flag").isNull(), F.lit(REASON_FLAG)))
    out = raw.withColumn("_flag", flag).withColumn("reason", reason)
    return out.withColumn("is_relevant", F.col("_flag")).drop("_flag")
