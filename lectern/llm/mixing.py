"""Mixing sources to target weights by entropy balancing.

Among all rates that give every source its target number of words, take
those closest to the base rates in relative entropy over words, with no
rate above ``cap``.  The solution is ``min(cap, base * exp(lam[source]))``;
``lam`` solves a convex dual.  Newton steps run on Spark: each one is an
aggregate over (source, base, size) strata, so a step costs as much as
there are different document lengths, not documents.  Rates become whole
copies per stratum with the error carried from long to short documents, and
the copies of a stratum go to its documents in order of a hash, in buckets
of bounded size.

Defined cases: a null text has size 0; null is a source of its own and comes
last; documents of size 0 are never taken; repeated rows are documents of
their own; an empty table gives an empty table.  Result columns replace
input columns of the same names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BUCKET = 4096            # documents ranked together
ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size`` -> plus ``target``: shares by the repeating
    ``weights`` in code-point order (null last), none above ``cap`` sizes,
    the excess shared again by weight.  One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # Water level: targets are min(cap * size, level * weight) and add up to all sizes.
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = w.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / F.sum("_w").over(onward))
    w = w.withColumn("_at", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")))
    level = F.first("_at", ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (w.withColumn("_theta", level)
            .select("source", "source_size",
                    F.least("_cap", F.coalesce(F.col("_theta") * F.col("_w"), F.col("_cap"))).alias("target")))


def balance(strata: DataFrame, targets: DataFrame, cap: float = CAP,
            tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """Newton iterations on the dual: ``strata`` (source, base, size, n) and
    ``targets`` (source, target) -> ``source, lam``."""
    # Where rates meet the cap the dual has kinks; a step that leaves the
    # bracket of the root (lo, hi) becomes a halving of it.
    lam = materialize(targets.select("source", "target", F.lit(0.0).alias("lam"), F.lit(-1e3).alias("lo"),
                                     F.lit(1e3).alias("hi"), F.lit(1.0).alias("off")), "dual")
    for _ in range(max_steps):
        rate = F.col("base") * F.exp("lam")
        words = F.col("n") * F.col("size")
        step = (strata.join(lam, strata["source"].eqNullSafe(lam["source"]))
                .groupBy(lam["source"], "target", "lam", "lo", "hi")
                .agg(F.sum(words * F.least(rate, F.lit(cap))).alias("got"),
                     F.sum(F.when(rate < cap, words * rate).otherwise(0.0)).alias("slope")))
        gap = F.col("got") - F.col("target")
        step = (step.withColumn("off", F.when((F.col("slope") <= 0) & (gap <= 0), 0.0).otherwise(
                    F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))))
                .withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
                .withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
                .withColumn("newton", F.col("lam") + F.when(F.col("slope") > 0, F.greatest(
                    F.lit(-2.0), F.least(F.lit(2.0), -gap / F.col("slope")))).otherwise(F.when(gap > 0, -1.0).otherwise(1.0))))
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        nxt = materialize(step.select(
            "source", "target", F.when(F.col("off") <= tolerance, F.col("lam")).when(inside, F.col("newton"))
            .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi", "off"), "dual")
        worst = nxt.agg(F.max("off")).first()[0]
        discard(lam)
        lam = nxt
        if worst is None or worst <= tolerance:
            return lam.select("source", "lam")
    raise RuntimeError(f"the dual did not settle in {max_steps} Newton steps")


def _whole_copies(cap: float):
    def per_source(pdf: pd.DataFrame) -> pd.DataFrame:
        # Long documents first; what rounding leaves over goes to shorter ones.
        pdf = pdf.sort_values(["size", "base"], ascending=[False, True], kind="stable").reset_index(drop=True)
        n, z, r = pdf["n"].to_numpy(), pdf["size"].to_numpy(), pdf["rate"].to_numpy()
        copies = np.zeros(len(pdf), dtype=np.int64)
        owed = 0.0
        for i in range(len(pdf)):
            if z[i] <= 0:
                continue
            owed += n[i] * r[i] * z[i]
            copies[i] = min(max(int(np.floor(owed / z[i] + 0.5)), 0), int(np.floor(cap)) * n[i])
            owed -= copies[i] * z[i]
        pdf["total"] = copies
        return pdf[["source", "base", "size", "rate", "n", "total"]]
    return per_source


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, base: Column | None = None,
        key: Column | None = None) -> DataFrame:
    """Add ``size, source_size, target, rate, copies, taken`` to ``docs``
    (``doc_id, text`` or ``size``, ``source``, ...).  ``base`` is the rate a document
    would have without targets (default 1); ``key`` orders equal documents
    (default: a hash of doc_id and the text)."""
    have = set(docs.columns)
    if "text" in have:
        size = word_count(F.col("text"))
    else:
        size = F.col("size")
    key = key if key is not None else F.xxhash64(*[c for c in ("doc_id", "text") if c in have])
    rows = docs.select(*[F.col(c) for c in docs.columns if c not in ADDED],
                       size.alias("size"), key.alias("_key"),
                       (base if base is not None else F.lit(1.0)).cast("double").alias("_base"))
    strata = materialize(rows.groupBy("source", F.col("_base").alias("base"), "size")
                         .agg(F.count(F.lit(1)).alias("n")), "strata")
    sizes = strata.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap), "targets")
    lam = balance(strata, targets, cap)
    rated = (strata.join(F.broadcast(lam.withColumnRenamed("source", "_s")) if _small(lam) else
                         lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
             .select("source", "base", "size", "n",
                     F.least(F.col("base") * F.exp("lam"), F.lit(float(cap))).alias("rate")))
    # One row per different length of a source, never its documents.
    totals = rated.groupBy("source").applyInPandas(
        _whole_copies(cap), "source STRING, base DOUBLE, size LONG, rate DOUBLE, n LONG, total LONG")
    plan = (totals.join(targets.select(F.col("source").alias("_s"), "source_size", "target"),
                        F.col("source").eqNullSafe(F.col("_s")))
            .select(F.col("source").alias("_s"), F.col("base").alias("_b"), F.col("size").alias("_z"), "rate",
                    "source_size", "target",
                    F.expr("total div n").alias("_each"), F.expr("total % n").alias("_extra"), F.col("n").alias("_n"),
                    F.ceil(F.col("n") / F.lit(BUCKET)).cast("long").alias("_parts")))
    plan = materialize(plan, "copies")
    joined = (rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
                        & (F.col("_base") == F.col("_b")))
              .withColumn("_part", F.pmod(F.col("_key"), F.col("_parts"))))
    # Only strata that need some documents once more are ranked, bucket by bucket.
    none = joined.filter("_extra = 0").withColumn("copies", F.col("_each"))
    some = joined.filter("_extra > 0")
    counts = some.groupBy("_s", "_b", "_z", "_extra", "_n", "_part").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_s", "_b", "_z").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    share = F.floor(F.col("_extra") * F.sum("_c").over(upto) / F.col("_n"))
    quota = counts.select(F.col("_s").alias("_qs"), F.col("_b").alias("_qb"), F.col("_z").alias("_qz"),
                          F.col("_part").alias("_qp"),
                          (share - F.floor(F.col("_extra") * (F.sum("_c").over(upto) - F.col("_c")) / F.col("_n"))).alias("_quota"))
    ranked = some.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_s", "_b", "_z", "_part").orderBy("_key")))
    some = (ranked.join(quota, F.col("_s").eqNullSafe(F.col("_qs")) & (F.col("_b") == F.col("_qb"))
                        & (F.col("_z") == F.col("_qz")) & (F.col("_part") == F.col("_qp")))
            .withColumn("copies", F.col("_each") + (F.col("_rank") <= F.col("_quota")).cast("long")))
    keep = [c for c in docs.columns if c not in ADDED]
    out = [*keep, "size", "source_size", "target", "rate", "copies"]
    return (none.select(*out).unionByName(some.select(*out))
            .withColumn("taken", F.col("copies") * F.col("size")))


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    return len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as it has copies."""
    return (mixed.filter("copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*columns))
