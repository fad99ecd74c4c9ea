import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, lines_df
from lectern.plans import jobs
from lectern.sources import feedback_store, index_store
from lectern.streaming import feedback_ingest


def test_verses_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'He said "OM",\nthen', "S 0.1")], "verse_id STRING, text STRING, source STRING")
    index_store.write_verses_csv(df, str(tmp_path / "v"))
    back = index_store.read_verses(spark, str(tmp_path / "v"), fmt="csv").first()
    assert back.text == 'He said "OM",\nthen'
    with pytest.raises(ValueError):
        index_store.check_columns(df.drop("source"))


def test_verses_sink_create_then_append(spark, tmp_path):
    path = str(tmp_path / "verses")
    a = spark.createDataFrame([("x-0-1", "one", "X 0.1")], "verse_id STRING, text STRING, source STRING")
    b = spark.createDataFrame([("y-0-1", "uno", "Y 0.1")], "verse_id STRING, text STRING, source STRING")
    index_store.write_verses(a, path)
    index_store.write_verses(b, path, append=True)
    assert sorted(r.verse_id for r in index_store.read_verses(spark, path).collect()) == ["x-0-1", "y-0-1"]
    index_store.write_verses(b, path)
    assert [r.verse_id for r in index_store.read_verses(spark, path).collect()] == ["y-0-1"]


def test_stamped_duplicates_get_distinct_ids(spark, tmp_path):
    reqs = spark.createDataFrame([("q", "v", True)] * 3, "query STRING, verse_id STRING, is_relevant BOOLEAN")
    path = str(tmp_path / "store")
    feedback_store.append(feedback_store.stamp(reqs), path)
    got = feedback_store.read(spark, path).collect()
    assert len(got) == 3 and len({r.fid for r in got}) == 3
    assert all(r.timestamp is not None for r in got)


def test_versions_publish_and_resolve(spark, tmp_path):
    root = str(tmp_path / "idx")
    assert index_store.resolve_version(spark, root) == "base"
    lines = lines_df(spark, "I\nalpha beta\n\nII\nbeta gamma\n\nIII\nom\n")
    built = []
    assert index_store.build_if_missing(
        spark, root, "base", lambda: built.append(jobs.build_corpus(spark, lines, root)))
    assert not index_store.build_if_missing(spark, root, "base", lambda: None)
    assert index_store.resolve_version(spark, root) == "base"
    meta = index_store.read_metadata(spark, root)
    assert sorted(r.vec_id for r in meta.collect()) == [0, 1, 2]
    index_store.publish_version(spark, root, "v2")
    assert index_store.resolve_version(spark, root) == "v2"


def test_adapt_cycle_with_a_trained_map(spark, tmp_path):
    from lectern.operators import train
    root, store_path = str(tmp_path / "idx"), str(tmp_path / "fb")
    jobs.build_corpus(spark, lines_df(spark, "I\nalpha beta\n\nII\nbeta gamma\n\nIII\nom shanti\n"), root, dim=16)
    reqs = spark.createDataFrame([("alpha", "Upanishads+Test-0-1", True), ("om", "Upanishads+Test-0-3", True),
                                  ("alpha", "Upanishads+Test-0-3", False)], "query STRING, verse_id STRING, is_relevant BOOLEAN")
    feedback_store.append(feedback_store.stamp(reqs), store_path)
    res = jobs.adapt_from_feedback(spark, root, store_path, "m1", dim=16, rank=2)
    assert res["trained"] and len(res["losses"]) == 1 and feedback_store.read(spark, store_path).count() == 0
    vectors, meta, weights = jobs.current_index(spark, root, dim=16)
    assert isinstance(weights, train.Metric) and weights.a.shape == (16, 2) and weights.b.any()
    base = {r.vec_id: r.embedding for r in index_store.read_vectors(spark, root, "base").collect()}
    for r in vectors.collect():
        want = weights.map(np.array(base[r.vec_id], dtype=float)[None])[0]
        np.testing.assert_allclose(r.embedding, want / np.linalg.norm(want), atol=1e-6)
    q = spark.createDataFrame([(1, "om shanti")], "qid LONG, query STRING")
    top = jobs.retrieve_hits(vectors, meta, q, k=1, dim=16, weights=weights).first()
    assert top.verse_id == "Upanishads+Test-0-3" and top.score == pytest.approx(1.0, abs=1e-6)


def test_adapt_cycle_publishes_then_consumes(spark, tmp_path):
    root = str(tmp_path / "idx")
    lines = lines_df(spark, "I\nalpha beta\n\nII\nbeta gamma\n\nIII\nom shanti\n\nIV\nalpha om\n")
    jobs.build_corpus(spark, lines, root, dim=16)
    store_path = str(tmp_path / "fb")
    reqs = spark.createDataFrame(
        [("alpha", "Upanishads+Test-0-1", True), ("om", "Upanishads+Test-0-3", True),
         ("alpha", "Upanishads+Test-0-3", False), ("gamma", "Upanishads+Test-0-2", True)],
        "query STRING, verse_id STRING, is_relevant BOOLEAN")
    feedback_store.append(feedback_store.stamp(reqs), store_path)
    res = jobs.adapt_from_feedback(spark, root, store_path, "v1", dim=16, steps=3)
    assert res["trained"] and res["n_pos"] == 3 and res["n_neg"] == 1
    assert all(b <= a + 1e-12 for a, b in zip(res["losses"], res["losses"][1:]))
    assert index_store.resolve_version(spark, root) == "v1"
    assert feedback_store.read(spark, store_path).count() == 0
    # The next run sees the consume: nothing to train on, nothing published.
    again = jobs.adapt_from_feedback(spark, root, store_path, "v2", dim=16, steps=3)
    assert not again["trained"] and index_store.resolve_version(spark, root) == "v1"
    # Records that name no verse are no pairs: they stay, and nothing is published.
    stray = spark.createDataFrame([("alpha", "nowhere", True)], "query STRING, verse_id STRING, is_relevant BOOLEAN")
    feedback_store.append(feedback_store.stamp(stray), store_path)
    none = jobs.adapt_from_feedback(spark, root, store_path, "v2", dim=16, steps=3)
    assert not none["trained"] and none["n_pos"] == 1 and index_store.resolve_version(spark, root) == "v1"
    with pytest.raises(KeyError):
        jobs.adapt_from_feedback(spark, root, store_path, "v2", dim=16, strict=True)
    feedback_store.append(feedback_store.stamp(reqs.limit(2)), store_path)
    more = jobs.adapt_from_feedback(spark, root, store_path, "v1b", dim=16, steps=3)
    assert more["trained"] and [r.verse_id for r in feedback_store.read(spark, store_path).collect()] == ["nowhere"]
    vectors, meta, weights = jobs.current_index(spark, root, dim=16)
    assert weights is not None and len(weights) == 16
    q = spark.createDataFrame([(1, "om shanti"), (2, "beta gamma")], "qid LONG, query STRING")
    hits = jobs.retrieve_hits(vectors, meta, q, k=2, dim=16, weights=weights).collect()
    top = {r.qid: r.verse_id for r in hits if r.rk == 1}
    assert top == {1: "Upanishads+Test-0-3", 2: "Upanishads+Test-0-2"}
    out = jobs.answer_batch(vectors, meta, spark.createDataFrame(
        [(1, "om", 2), (2, " ", 3), (3, "alpha", 11)], "qid LONG, query STRING, k INT"), dim=16)
    assert out["rejected"].count() == 2 and out["rejected_answers"].count() == 1
    assert [len(r.results) for r in out["responses"].collect()] == [2]
    # An answer request has no upper bound on k.
    assert sorted((r.qid, len(r.context)) for r in out["answers"].collect()) == [(1, 2), (3, 4)]
    spark.createDataFrame([("v1c",)], "version STRING").write.parquet(f"{root}/vectors/v1c")
    index_store.publish_version(spark, root, "v1c")
    with pytest.raises(Exception, match="weights"):
        jobs.current_index(spark, root, dim=16)


def test_answers_and_responses_shuffle_the_verses_once(spark):
    from lectern.operators import encode
    from pyspark.sql import functions as F
    meta = spark.createDataFrame([(i, f"B+T-0-{i}", f"verse {w}", f"T 0.{i}") for i, w in enumerate("abcdefgh")],
                                 "vec_id LONG, verse_id STRING, text STRING, source STRING")
    vectors = encode.encode_hashed(meta, "text").select("vec_id", "embedding")
    requests = spark.createDataFrame([(1, "verse a", 2), (2, " ", 3), (3, "verse c", 11), (4, "verse d", None)],
                                     "qid LONG, query STRING, k INT")
    out = jobs.answer_batch(vectors, meta, requests)
    both = out["responses"].select("qid", F.col("results.verse").alias("v")).unionByName(
        out["answers"].select("qid", F.col("context.verse").alias("v")))
    got = sorted((r.qid, len(r.v), r.v[0]) for r in both.collect())
    assert got == [(1, 2, "verse a"), (1, 2, "verse a"), (3, 8, "verse c"), (4, 5, "verse d"), (4, 5, "verse d")]
    # One shuffle of hits with their verses, read by both tables.
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 1


def test_stream_ingest_splits_valid_and_rejected(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(1, "q", "v1", "true", None), (2, None, "v2", "false", None), (3, "q", "v3", "maybe", None)]
    df = spark.createDataFrame(rows, feedback_ingest.RAW_SCHEMA)
    df.write.parquet(str(src / "batch1"))
    stream = spark.readStream.schema(feedback_ingest.RAW_SCHEMA).parquet(str(src / "batch1"))
    out = str(tmp_path / "out")
    q = feedback_ingest.start_ingest(feedback_ingest.validated_stream(stream), out, out + "/_ckpt")
    q.awaitTermination()
    assert [r.fid for r in feedback_ingest.read_ingested(spark, out).collect()] == [1]
    assert sorted(r.fid for r in feedback_ingest.read_ingested(spark, out, "rejected").collect()) == [2, 3]


def test_json_request_stream(spark, tmp_path):
    src = tmp_path / "requests"
    src.mkdir()
    (src / "a.json").write_text('{"query": "What is Dharma?", "verse_id": "Upanishads+Isa-0-1", "is_relevant": true}\n'
                                '{"query": "x", "verse_id": null, "is_relevant": false}\n')
    (src / "b.json").write_text('{"query": "Peace", "verse_id": "Upanishads+Kena-1-2", "is_relevant": "no idea"}\n')
    out = str(tmp_path / "store")
    q = feedback_ingest.ingest_json_requests(spark, str(src), out)
    q.awaitTermination()
    valid = feedback_ingest.read_ingested(spark, out).collect()
    assert [(r.query, r.is_relevant) for r in valid] == [("What is Dharma?", True)]
    assert valid[0].timestamp is not None and valid[0].fid is not None
    rejected = feedback_ingest.read_ingested(spark, out, "rejected").collect()
    assert sorted(r.reason for r in rejected) == ["is_relevant not a boolean", "verse_id missing"]


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_stream_of_a_folder_of_part_files(spark, tmp_path):
    spark.read.parquet(SF_SMALL + "/events.parquet").repartition(7).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    feedback_ingest.ingest_events_once(spark, str(tmp_path / "sf"), str(tmp_path / "out"), files_per_trigger=3)
    assert feedback_ingest.read_ingested(spark, str(tmp_path / "out")).count() == spark.read.parquet(
        SF_SMALL + "/events.parquet").count()


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace
    from lectern import session
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, master="yarn", _jsc=SimpleNamespace(
        sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"qid", "rk", "verse_id", "source", "score"} <= set(df.columns)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", ["b_parse_verses", "d3_batch_top_k", "e4_training_pairs",
                                  "a10_feedback_stream", "c3_vec_ids"])
def test_registered_queries_run(spark, name):
    import __spark_entry__ as E
    assert E.queries()[name](spark, SF_SMALL).count() > 0
