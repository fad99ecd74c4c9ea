"""The newest N feedback records kept by a stream equal the batch form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import feedback as fb
from lectern.sources.feedback_store import FEEDBACK_SCHEMA
from lectern.streaming import feedback_ingest, latest_stream


def _records(seed: int, n: int):
    """Records with ties, repeats, a missing id and a missing timestamp."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["what is dharma", 'a "quote"\n', "ओम्"]), f"v{i % 7}", i % 3 == 0,
             start + timedelta(seconds=rng.randrange(n // 2), microseconds=rng.randrange(3))) for i in range(n)]
    rows += [(n, "no time", "v", True, None), (None, "no id", "v", False, start + timedelta(days=1))]
    return rows


def _write(spark, rows, path):
    spark.createDataFrame(rows, FEEDBACK_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(FEEDBACK_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_equals_the_batch_form_after_killed_runs(spark, tmp_path, monkeypatch):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    rows = _records(1, 300)
    random.Random(2).shuffle(rows)
    parts = [rows[i::4] for i in range(4)]
    for part in parts:
        _write(spark, part + rows[:20], src)            # twenty are sent with every file
    whole = latest_stream.fb.newest_rows

    def run(broken_at=None, after_write=False):
        calls = []

        def breaking(batch, n):
            calls.append(1)
            if len(calls) == broken_at and not after_write:
                raise RuntimeError("killed before the write")
            return whole(batch, n)

        def breaking_delete(spark, path):
            raise RuntimeError("killed after the write")

        with monkeypatch.context() as m:
            m.setattr(latest_stream.fb, "newest_rows", breaking)
            if after_write:
                m.setattr(latest_stream.manifests, "delete", breaking_delete)
            q = latest_stream.start_latest(_stream(spark, src), out, ckpt, n=40, buckets=3)
            feedback_ingest.finish(q)

    with pytest.raises(Exception, match="killed before"):
        run(broken_at=2)
    assert latest_stream._snapshots(spark, out) == [0]
    with pytest.raises(Exception, match="killed after"):
        run(after_write=True)                            # batch 3 deletes the first snapshot
    run()
    want = _rows(fb.newest_rows(spark.createDataFrame(rows, FEEDBACK_SCHEMA), 40))
    assert _rows(latest_stream.read_latest(spark, out)) == want
    # More arrives: newer ones, repeats of old ones and one older than all.
    late = [(1000 + i, "q", "v", True, datetime(2025, 1, 1, 0, 0, i)) for i in range(5)]
    _write(spark, late + rows[:50] + [(2000, "q", "v", True, datetime(1999, 1, 1))], src)
    run()
    want = _rows(fb.newest_rows(spark.createDataFrame(rows + late, FEEDBACK_SCHEMA), 40))
    assert _rows(latest_stream.read_latest(spark, out)) == want
    assert len(latest_stream._snapshots(spark, out)) <= latest_stream.KEPT + 1


def test_few_records_and_none(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert latest_stream.read_latest(spark, out).count() == 0
    rows = _records(3, 10)
    _write(spark, rows, src)
    stream = _stream(spark, src).withColumn("reason", F.when(F.col("fid") == 4, "bad")).withColumn("bucket", F.lit("x"))
    feedback_ingest.finish(latest_stream.start_latest(stream, out, str(tmp_path / "ckpt")))
    assert _rows(latest_stream.read_latest(spark, out)) == sorted([r for r in rows if r[0] != 4], key=repr)


def test_a_lost_snapshot_is_not_taken_for_an_empty_one(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    _write(spark, _records(4, 10), src)
    feedback_ingest.finish(latest_stream.start_latest(_stream(spark, src), str(tmp_path / "a"), ckpt))
    _write(spark, _records(5, 10), src)
    with pytest.raises(Exception, match="no snapshot before"):
        feedback_ingest.finish(latest_stream.start_latest(_stream(spark, src), str(tmp_path / "b"), ckpt))


def test_bounds(spark):
    empty = spark.createDataFrame([], FEEDBACK_SCHEMA)
    for n in (0, fb.MAX_LATEST + 1):
        with pytest.raises(ValueError):
            latest_stream.entering(empty, n)
    with pytest.raises(ValueError):
        fb.latest(empty, fb.MAX_LATEST + 1)


def test_request_ids_are_the_same_however_a_batch_is_split(spark):
    rows = [("q", "v", "true", None)] * 40 + [("q", None, "true", None), (None, "q", "true", None)]
    batch = spark.createDataFrame(rows, "query STRING, verse_id STRING, is_relevant STRING, reason STRING")
    one, many = (sorted(map(tuple, feedback_ingest.with_request_ids(batch.repartition(p), 7).collect()), key=repr)
                 for p in (1, 5))
    assert one == many and len({r[-1] for r in one}) == 42
    other = {r.fid for r in feedback_ingest.with_request_ids(batch, 8).collect()}
    assert not other & {r[-1] for r in one}
