import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import adapt, encode, feedback as fb


def store(spark, n=130):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"q{i % 7}", str(i % 12), i % 3 != 0, base + dt.timedelta(minutes=i // 2))
            for i in range(n)]
    return spark.createDataFrame(rows, "fid LONG, query STRING, verse_id STRING, "
                                       "is_relevant BOOLEAN, timestamp TIMESTAMP_NTZ")


def verses(spark):
    rows = [(i, str(i % 10), f"text {i}") for i in range(25)]
    return spark.createDataFrame(rows, "vec_id LONG, verse_id STRING, text STRING")


def test_latest_and_split(spark):
    recent = fb.latest(store(spark))
    ids = [r.fid for r in recent.collect()]
    assert len(ids) == 100 and ids[0] == 129 and ids[-1] == 30
    pos, neg = fb.split_by_relevance(recent)
    assert pos.count() + neg.count() == 100
    assert neg.count() == sum(1 for i in range(30, 130) if i % 3 == 0)


def test_pairs_first_match_and_missing(spark):
    recent = fb.latest(store(spark))
    pairs = fb.labelled_pairs(recent, verses(spark)).orderBy("ord").collect()
    known = [i for i in range(30, 130) if i % 12 < 10]
    assert len(pairs) == len(known)
    text = {p.verse_id: p.verse_text for p in pairs}
    assert text["3"] == "text 3"            # lowest vec_id among 3, 13, 23
    labels = [p.label for p in pairs]
    assert labels == sorted(labels, reverse=True)
    assert fb.missing_ids(recent, verses(spark)).count() == 100 - len(known)
    with pytest.raises(KeyError):
        fb.lookup_texts(recent, verses(spark), strict=True)


def test_guards_and_consume(spark):
    s = store(spark)
    g = fb.guard_counts(fb.latest(s)).first()
    assert g.n_total == 100 and g.proceed
    empty = fb.guard_counts(fb.latest(s.limit(0))).first()
    assert empty.n_total == 0 and not empty.proceed
    assert fb.consume(s, fb.latest(s)).count() == 30
    assert fb.consume(s, fb.latest(s), mode="all").count() == 0


def test_validate_records(spark):
    raw = spark.createDataFrame([("q", "v", "true"), (None, "v", "true"), ("q", None, "false"),
                                 ("q", "v", "maybe"), ("q", "v", None)],
                                "query STRING, verse_id STRING, is_relevant STRING")
    got = [r.reason for r in fb.validate_records(raw).collect()]
    assert got == [None, fb.REASON_QUERY, fb.REASON_VERSE, fb.REASON_FLAG, fb.REASON_FLAG]


def test_batches_and_schedule(spark):
    pairs = fb.labelled_pairs(fb.latest(store(spark)), verses(spark))
    b = adapt.batches(pairs).groupBy("batch").count().collect()
    sizes = sorted(r["count"] for r in b)
    assert max(sizes) == 4 and sum(sizes) == pairs.count()
    s = adapt.schedule(pairs).first()
    assert s.steps == -(-s.n_examples // 4) and s.warmup_steps == int(0.1 * s.steps) and s.epochs == 1


def test_contrastive_loss_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 8))
    b = rng.normal(size=(40, 8))
    y = (rng.random(40) > 0.5).astype(float)
    df = spark.createDataFrame([(a[i].tolist(), b[i].tolist(), float(y[i])) for i in range(40)],
                               "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, label DOUBLE")
    got = adapt.contrastive_loss(df).first().loss
    d = 1 - (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    exp = np.mean(0.5 * (y * d ** 2 + (1 - y) * np.maximum(0.5 - d, 0) ** 2))
    assert abs(got - exp) < 1e-12


def test_fit_scale_never_raises_loss(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        a = rng.normal(size=6)
        y = float(i % 2)
        b = a + rng.normal(scale=0.3, size=6) if y else rng.normal(size=6)
        rows.append((a.tolist(), b.tolist(), y))
    df = spark.createDataFrame(rows, "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, label DOUBLE")
    w, losses = adapt.fit_scale(df, 6, steps=4)
    assert len(w) == 6 and len(losses) >= 1
    assert adapt.loss_series_ok(losses)
    vecs = spark.createDataFrame([(1, [3.0, 4.0, 0.0, 0.0, 0.0, 0.0])], "vec_id LONG, embedding ARRAY<FLOAT>")
    out = adapt.apply_scale(vecs, [1.0] * 6).first().embedding
    assert abs(sum(x * x for x in out) - 1.0) < 1e-6


def test_hashed_encoder(spark):
    df = spark.createDataFrame([(1, "Om om OM peace"), (2, ""), (3, None)], "id LONG, text STRING")
    enc = {r.id: r.embedding for r in encode.encode_hashed(df, "text", dim=32).collect()}
    assert len(enc[1]) == 32 and abs(sum(x * x for x in enc[1]) - 1.0) < 1e-6
    assert sorted(enc[1])[-1] == pytest.approx(3 / np.sqrt(10), rel=1e-6)
    assert all(x == 0 for x in enc[2]) and all(x == 0 for x in enc[3])
    tf = encode.term_buckets(df, "id", "text", dim=32).filter(F.col("id") == 1)
    assert sorted(r.tf for r in tf.collect()) == [1, 3]


def test_pluggable_model_encoder(spark):
    class LengthModel:
        """A stand-in for a user model: vector = (length, vowel count).
        Defined locally so it is pickled by value for the workers."""

        def encode(self, texts):
            return np.array([[len(t), sum(c in "aeiou" for c in t)] for t in texts],
                            dtype=np.float32)

    df = spark.createDataFrame([(1, "om"), (2, "peace"), (3, None)], "id LONG, text STRING")
    out = {r.id: r.embedding for r in encode.encode_with_model(df, LengthModel, dim=2).collect()}
    assert out == {1: [2.0, 1.0], 2: [5.0, 3.0], 3: [0.0, 0.0]}
    assert encode.vector_dimension(encode.encode_with_model(df, LengthModel)) == 2


def test_feedback_without_a_pair_is_published_unchanged(spark, tmp_path):
    from lectern.plans import catalog
    sf = str(tmp_path)
    spark.createDataFrame([(0, "one\ntwo", "src0"), (1, "three", "src1")], "doc_id LONG, text STRING, source STRING") \
        .write.parquet(f"{sf}/documents.parquet")
    spark.range(150).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id + 5000 AS user_id",
                                "'click' AS event_type").write.parquet(f"{sf}/events.parquet")
    rows = catalog.e11_adapt_publish_consume(spark, sf).collect()
    assert sorted(r.fid for r in rows) == list(range(150))      # nothing was trained on, nothing is consumed
    assert {(r.version, r.n_vectors, r.dim, r.n_weights) for r in rows} == {("adapted-1", 2, 64, 64)}
