"""Feedback store: an append-only Parquet table with snapshots.

The reference keeps feedback in a document database.  Here the store is a
folder on the shared file system::

    path/added/                 records as they are appended
    path/consumed/run=<n>/      ids that a finished training run used
    path/snapshots/<s>/         what a compaction left of both
    path/manifest/0000000n.json the snapshot that counts and the files in it

The store's content is the newest snapshot and the records added since,
without the ids consumed since.  A consume only adds a folder: readers and
appends that run meanwhile are not disturbed, records appended during a
training run stay, and the next read sees the consume.

``compact`` writes the content as a new snapshot and names, in a new manifest,
the added and consumed files that are part of it.  Those are no longer read, so
a read costs what is left and what came since, whatever number of runs there
have been.  A file counts as folded by its name: one that an append or a
consume finishes while the compaction runs is simply not among them.
``vacuum`` deletes folded files and earlier snapshots when their readers have
ended.  Ids are unique: a record under an id consumed before the last
compaction would be a new one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import manifest as manifests
from lectern.sources.manifest import Conflict

GRACE = 3600.0              # seconds that a reader may take
FEEDBACK_SCHEMA = T.StructType([
    T.StructField("fid", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("verse_id", T.StringType()),
    T.StructField("is_relevant", T.BooleanType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


def utc_now(spark: SparkSession):
    """The current time as a naive UTC timestamp, whatever the session's
    time zone (``current_timestamp`` shifted to UTC wall-clock time)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.to_utc_timestamp(F.current_timestamp(), tz).cast("timestamp_ntz")


def stamp(requests: DataFrame) -> DataFrame:
    """Stamp requests with the current UTC time (naive timestamp) and a
    unique id when they have none."""
    out = requests
    if "timestamp" not in out.columns:
        out = out.withColumn("timestamp", utc_now(requests.sparkSession))
    if "fid" not in out.columns:
        # The request, its time and its position: identical requests sent
        # together still get different ids.
        out = out.withColumn("fid", F.xxhash64("query", "verse_id", "is_relevant", "timestamp",
                                               F.monotonically_increasing_id()))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in FEEDBACK_SCHEMA.fields])


def append(records: DataFrame, path: str) -> None:
    """Append records (already stamped) to the store."""
    (records.select(*[F.col(f.name).cast(f.dataType) for f in FEEDBACK_SCHEMA.fields])
            .write.mode("append").parquet(f"{path}/added"))


def _files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Finished files below the store's folder, named from there."""
    hp, fs = manifests.file_system(spark, f"{path}/{pattern}")
    levels = pattern.count("/") + 1
    return sorted("/".join(s.getPath().toString().rsplit("/", levels)[1:]) for s in fs.globStatus(hp) or [])


def state(spark: SparkSession, path: str) -> dict:
    """The newest manifest: ``snapshot`` (or None), the ``folded`` files and
    the snapshots ``gone``, both with the time they went."""
    return {"snapshot": None, "folded": [], "gone": [], **manifests.newest(spark, f"{path}/manifest")}


def _parts(spark: SparkSession, path: str) -> tuple[dict, list[str], list[str]]:
    """The manifest, the consumed files and the added files that aren't folded.
    Consumed files are listed first: what they name was added before."""
    used = _files(spark, path, "consumed/*/*.parquet")
    added = _files(spark, path, "added/*.parquet")
    now = state(spark, path)
    folded = {f["file"] for f in now["folded"]}
    return now, [f for f in used if f not in folded], [f for f in added if f not in folded]


def _content(spark: SparkSession, path: str, now: dict, used: list[str], added: list[str]) -> DataFrame:
    places = ([f"{path}/snapshots/{now['snapshot']}"] if now["snapshot"] else []) + [f"{path}/{f}" for f in added]
    if not places:
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    rows = spark.read.schema(FEEDBACK_SCHEMA).parquet(*places)
    if not used:
        return rows
    return rows.join(spark.read.schema("fid LONG").parquet(*[f"{path}/{f}" for f in used]), "fid", "left_anti")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the store that no run has consumed."""
    return _content(spark, path, *_parts(spark, path))


def consume(used: DataFrame, path: str, run: str) -> None:
    """Mark records as consumed.  ``run`` names the training run, so a
    run that is repeated replaces its own mark."""
    used.select(F.col("fid").cast("long")).write.mode("overwrite").parquet(f"{path}/consumed/run={run}")


def compact(spark: SparkSession, path: str) -> dict:
    """Write the content as a snapshot and commit it.  Of two compactions at
    once the second one raises a ``Conflict`` and leaves nothing."""
    now, used, added = _parts(spark, path)
    name, at = uuid.uuid4().hex[:12], time.time()
    _content(spark, path, now, used, added).write.parquet(f"{path}/snapshots/{name}")
    # Names of files that are deleted by now needn't be kept.
    there = {*_files(spark, path, "consumed/*/*.parquet"), *_files(spark, path, "added/*.parquet")}
    new = {"snapshot": name,
           "folded": [f for f in now["folded"] if f["file"] in there] + [{"file": f, "at": at} for f in used + added],
           "gone": now["gone"] + ([{"snapshot": now["snapshot"], "at": at}] if now["snapshot"] else [])}
    try:
        return manifests.commit(spark, f"{path}/manifest", now, new)
    except Conflict:
        manifests.delete(spark, f"{path}/snapshots/{name}")
        raise


def vacuum(spark: SparkSession, path: str, grace: float = GRACE) -> int:
    """Delete files folded, and snapshots replaced or never committed, over
    ``grace`` seconds ago.  Returns how many."""
    # The listing comes first: what is committed meanwhile is in the manifest.
    snapshots = manifests.listed(spark, f"{path}/snapshots")
    there = {*_files(spark, path, "consumed/*/*.parquet"), *_files(spark, path, "added/*.parquet")}
    now = state(spark, path)
    since = {g["snapshot"]: g["at"] for g in now["gone"]}
    old = [f["file"] for f in now["folded"] if f["file"] in there and time.time() - f["at"] >= grace]
    old += [f"snapshots/{name}" for name, written in snapshots
            if name != now["snapshot"] and time.time() - max(written, since.get(name, 0.0)) >= grace]
    for f in old:
        manifests.delete(spark, f"{path}/{f}")
    return len(old)
