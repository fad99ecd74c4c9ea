"""Two publishers, retired versions, and a feedback store that is compacted."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import lines_df
from lectern.plans import jobs
from lectern.sources import feedback_store, index_store

REQUESTS = [("alpha", "Upanishads+Test-0-1", True), ("om", "Upanishads+Test-0-3", True), ("om", "Upanishads+Test-0-1", False)]


@pytest.fixture
def index(spark, tmp_path):
    root, store = str(tmp_path / "idx"), str(tmp_path / "fb")
    jobs.build_corpus(spark, lines_df(spark, "I\nalpha beta\n\nII\nbeta gamma\n\nIII\nom shanti\n"), root, dim=16)
    reqs = spark.createDataFrame(REQUESTS, "query STRING, verse_id STRING, is_relevant BOOLEAN")
    feedback_store.append(feedback_store.stamp(reqs), store)
    return root, store


def folders(root):
    return {k: sorted(os.listdir(f"{root}/{k}")) if os.path.isdir(f"{root}/{k}") else [] for k in index_store.KINDS}


def test_of_two_publishers_one_wins_and_nothing_dangles(spark, index, monkeypatch):
    root, store = index
    whole = index_store.publish_version

    def late(spark, root, version, folder=None, seen=None):
        # Another run comes in between the writing and the publishing.
        monkeypatch.setattr(index_store, "publish_version", whole)
        jobs.adapt_from_feedback(spark, root, store, "mine", dim=16, steps=1)
        return whole(spark, root, version, folder, seen)

    monkeypatch.setattr(index_store, "publish_version", late)
    with pytest.raises(index_store.Conflict):
        jobs.adapt_from_feedback(spark, root, store, "late", dim=16, steps=2)
    assert index_store.resolve_version(spark, root) == "mine"
    assert feedback_store.read(spark, store).count() == 0        # the winner's
    named = {e["folder"] for e in index_store.published(spark, root)["entries"]}
    assert {f for k in folders(root).values() for f in k} == named and len(named) == 2


def test_writers_of_one_name_do_not_meet(spark, index):
    root, _ = index
    vectors = index_store.read_vectors(spark, root, "base")
    seen = index_store.published(spark, root)
    a, b = index_store.new_folder("v"), index_store.new_folder("v")
    for folder, by in ((a, 2.0), (b, 3.0)):
        index_store.write_vectors(vectors.withColumn("embedding", F.transform("embedding", lambda x: x * by)), root, folder)
    index_store.publish_version(spark, root, "v", a, seen)
    with pytest.raises(index_store.Conflict):
        index_store.publish_version(spark, root, "v", b, seen)
    assert index_store.folder_of(spark, root, "v") == a
    # Not bound to a state, it replaces the version of its name.
    index_store.publish_version(spark, root, "v", b)
    assert index_store.folder_of(spark, root, "v") == b
    assert index_store.vacuum(spark, root) == 0                  # readers may be at it
    assert index_store.vacuum(spark, root, grace=0.0) == 1 and a not in folders(root)["vectors"]
    assert index_store.published(spark, root)["gone"] == []
    assert [r.version for r in index_store.versions(spark, root).orderBy("created").collect()] == ["base", "v"]


def test_retired_versions_go_and_the_base_stays(spark, index):
    root, _ = index
    vectors = index_store.read_vectors(spark, root, "base")
    for v in ("v1", "v2", "v3"):
        folder = index_store.new_folder(v)
        index_store.write_vectors(vectors, root, folder)
        index_store.publish_version(spark, root, v, folder)
    index_store.retire(spark, root, keep=1)
    assert [e["version"] for e in index_store.published(spark, root)["entries"]] == ["base", "v3"]
    assert len(folders(root)["vectors"]) == 4 and index_store.vacuum(spark, root, grace=0.0) == 2
    assert index_store.resolve_version(spark, root) == "v3"
    assert index_store.read_vectors(spark, root, "v3").count() == index_store.read_metadata(spark, root, "v3").count() == 3


def test_a_publisher_lost_while_it_wrote_is_passed_over(spark, index):
    root, _ = index
    half = f"{root}/published/00000002.json"
    with open(half, "w") as f:
        f.write('{"entr')
    seen = index_store.published(spark, root)
    assert [e["version"] for e in seen["entries"]] == ["base"]
    with pytest.raises(index_store.Conflict):
        index_store.publish_version(spark, root, "v", "base", seen)
    os.utime(half, (1, 1))
    index_store.publish_version(spark, root, "v", "base", seen)
    assert index_store.resolve_version(spark, root) == "v"


def records(spark, ids):
    return spark.createDataFrame([(i, f"q{i}", "v", i % 2 == 0) for i in ids],
                                 "fid LONG, query STRING, verse_id STRING, is_relevant BOOLEAN").withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def ids(df):
    return sorted(r.fid for r in df.collect())


def test_compaction_keeps_the_content_and_ends_the_runs(spark, tmp_path):
    path = str(tmp_path)
    assert ids(feedback_store.read(spark, path)) == []
    for run in range(4):
        feedback_store.append(records(spark, range(10 * run, 10 * run + 10)), path)
        feedback_store.consume(records(spark, range(10 * run, 10 * run + 7)), path, f"r{run}")
    left = [i for i in range(40) if i % 10 >= 7]
    assert ids(feedback_store.read(spark, path)) == left
    feedback_store.compact(spark, path)
    got = feedback_store.read(spark, path)
    assert ids(got) == left and {re.search(r"/(added|consumed|snapshots)/", f)[1] for f in got.inputFiles()} == {"snapshots"}
    assert "Join" not in got._jdf.queryExecution().toString()    # no id of an earlier run is read
    # Later appends and consumes, of records from before too.
    feedback_store.append(records(spark, [100, 101]), path)
    feedback_store.consume(records(spark, [7, 100]), path, "r9")
    left = [i for i in left if i != 7] + [101]
    assert ids(feedback_store.read(spark, path)) == left
    assert feedback_store.vacuum(spark, path) == 0 and feedback_store.vacuum(spark, path, grace=0.0) > 0
    assert ids(feedback_store.read(spark, path)) == left
    feedback_store.compact(spark, path)
    feedback_store.vacuum(spark, path, grace=0.0)
    assert ids(feedback_store.read(spark, path)) == left and len(os.listdir(f"{path}/snapshots")) == 1
    feedback_store.compact(spark, path)
    assert feedback_store.state(spark, path)["folded"] == []     # deleted files' names don't pile up


def test_a_repeated_run_counts_after_its_first_mark_was_folded(spark, tmp_path):
    path = str(tmp_path)
    feedback_store.append(records(spark, range(6)), path)
    feedback_store.consume(records(spark, [0]), path, "r")
    feedback_store.compact(spark, path)
    feedback_store.consume(records(spark, [0, 3]), path, "r")
    assert ids(feedback_store.read(spark, path)) == [1, 2, 4, 5]


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    feedback_store.append(records(spark, range(6)), path)
    content = feedback_store._content

    def slow(*args):
        # Another compaction, an append and a consume come in between.
        monkeypatch.setattr(feedback_store, "_content", content)
        feedback_store.compact(spark, path)
        feedback_store.append(records(spark, [9]), path)
        feedback_store.consume(records(spark, [2]), path, "x")
        return content(*args)

    monkeypatch.setattr(feedback_store, "_content", slow)
    with pytest.raises(index_store.Conflict):
        feedback_store.compact(spark, path)
    assert ids(feedback_store.read(spark, path)) == [0, 1, 3, 4, 5, 9] and len(os.listdir(f"{path}/snapshots")) == 1
    # All records consumed: an empty snapshot.
    feedback_store.consume(feedback_store.read(spark, path), path, "all")
    feedback_store.compact(spark, path)
    assert ids(feedback_store.read(spark, path)) == []
    assert json.load(open(sorted(tmp_path.glob("manifest/*.json"))[-1]))["snapshot"]
