"""Versioned verse/vector tables.

Layout under one root folder on the shared file system::

    root/verses/                 verse_id, text, source (+ file, line_no)
    root/metadata/<folder>/      vec_id, verse_id, text, source
    root/vectors/<folder>/       vec_id, embedding ARRAY<FLOAT>
    root/weights/<folder>/       dim, weight          (adapted encoders)
    root/metric/<folder>/        the same for trained maps
    root/published/0000000n.json the versions there are, each with its folder

Every writer has a folder of its own (``new_folder``), so two that write a
version of the same name don't meet.  A version is written completely before
it is published, which is one new manifest: readers keep the old version until
the new one is whole.  A publisher that read the store before it wrote names
what it saw; if another one has published since, it gets a ``Conflict`` and
publishes nothing.  ``retire`` takes old versions out of the manifest;
``vacuum`` deletes folders that none names: those of retired and replaced
versions and of publishers that lost or were lost.
"""

from __future__ import annotations

import datetime as _dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import manifest as manifests
from lectern.sources.manifest import Conflict

BASE_VERSION = "base"
KINDS = ("vectors", "metadata", "weights", "metric")
GRACE = 3600.0              # seconds that readers and writers of a folder may take
REQUIRED_VERSE_COLUMNS = ["verse_id", "text", "source"]


def check_columns(df: DataFrame, required=REQUIRED_VERSE_COLUMNS) -> DataFrame:
    """A4: fail when required columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def write_verses(verses: DataFrame, path: str, append: bool = False) -> None:
    """A3: create (overwrite) or append the verse table."""
    check_columns(verses).write.mode("append" if append else "overwrite").parquet(path)


def write_verses_csv(verses: DataFrame, path: str, append: bool = False) -> None:
    """A3 (interchange form): CSV with a header, quotes doubled."""
    (check_columns(verses).select(*REQUIRED_VERSE_COLUMNS)
        .write.mode("append" if append else "overwrite")
        .option("header", True).option("quote", '"').option("escape", '"')
        .csv(path))


def read_verses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: read the verse table and check its columns."""
    if fmt == "csv":
        df = (spark.read.option("header", True).option("quote", '"')
              .option("escape", '"').option("multiLine", True).csv(path))
    else:
        df = spark.read.parquet(path)
    return check_columns(df)


def exists(spark: SparkSession, path: str) -> bool:
    hp, fs = manifests.file_system(spark, path)
    return fs.exists(hp)


def published(spark: SparkSession, root: str) -> dict:
    """The newest manifest: ``entries`` (version, folder, created; oldest
    first) and the folders that ``gone`` versions had."""
    return {"entries": [], "gone": [], **manifests.newest(spark, f"{root}/published")}


def new_folder(version: str) -> str:
    """A folder name for one writer of a version."""
    return f"{version}-{uuid.uuid4().hex[:12]}"


def folder_of(spark: SparkSession, root: str, version: str) -> str:
    """The folder of a published version; one that isn't published is looked
    for under its own name."""
    return {e["version"]: e["folder"] for e in published(spark, root)["entries"]}.get(version, version)


def write_vectors(vectors: DataFrame, root: str, folder: str) -> str:
    """A5: write ``vec_id, embedding`` of one version."""
    path = f"{root}/vectors/{folder}"
    (vectors.select(F.col("vec_id").cast("long"),
                    F.col("embedding").cast("array<float>"))
            .write.mode("overwrite").parquet(path))
    return path


def read_vectors(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A6."""
    return spark.read.parquet(f"{root}/vectors/{folder_of(spark, root, version)}")


def write_metadata(verses_with_ids: DataFrame, root: str, folder: str = BASE_VERSION) -> None:
    """Verse metadata keyed by ``vec_id``, beside the vectors it belongs to."""
    (verses_with_ids.select("vec_id", "verse_id", "text", "source")
        .write.mode("overwrite").parquet(f"{root}/metadata/{folder}"))


def read_metadata(spark: SparkSession, root: str, version: str = BASE_VERSION) -> DataFrame:
    """Metadata of a version; versions that only changed the encoder have
    none of their own and use the base version's."""
    own = f"{root}/metadata/{folder_of(spark, root, version)}"
    return check_columns(spark.read.parquet(
        own if exists(spark, own) else f"{root}/metadata/{folder_of(spark, root, BASE_VERSION)}"))


def publish_version(spark: SparkSession, root: str, version: str, folder: str | None = None,
                    seen: dict | None = None) -> dict:
    """The manifest that names the new version - the last write of a
    publish.  ``folder`` holds it (its own name by default).  A version of the
    same name is replaced.  With ``seen`` (from ``published``, read before
    anything else was) the publish is refused with a ``Conflict`` if any other
    one came in between; without, it goes behind that one."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat()

    def change(state: dict) -> dict:
        entries = state.get("entries", [])
        old = [e for e in entries if e["version"] == version and e["folder"] != (folder or version)]
        return {"entries": [e for e in entries if e["version"] != version]
                + [{"version": version, "folder": folder or version, "created": now}],
                "gone": state.get("gone", []) + [{"folder": e["folder"], "at": time.time()} for e in old]}

    where = f"{root}/published"
    if seen is None:
        return manifests.update(spark, where, change)
    # A manifest that isn't whole counts for nothing until its writer is lost;
    # the number behind it is taken from a fresh look.
    now_there = published(spark, root)
    if now_there["version"] != seen["version"]:
        raise Conflict(f"version {now_there['version']} is there")
    return manifests.commit(spark, where, now_there, change(seen))


def drop_folder(spark: SparkSession, root: str, folder: str) -> None:
    """What a writer leaves that doesn't publish."""
    for kind in KINDS:
        manifests.delete(spark, f"{root}/{kind}/{folder}")


def retire(spark: SparkSession, root: str, keep: int = 1) -> dict:
    """Take all but the newest ``keep`` versions and the base version out of
    the manifest.  Their folders stay until ``vacuum``."""
    def change(state: dict) -> dict:
        entries = state.get("entries", [])
        stay = [e for i, e in enumerate(entries) if e["version"] == BASE_VERSION or i >= len(entries) - keep]
        return {"entries": stay, "gone": state.get("gone", []) + [
            {"folder": e["folder"], "at": time.time()} for e in entries if e not in stay]}

    return manifests.update(spark, f"{root}/published", change)


def vacuum(spark: SparkSession, root: str, grace: float = GRACE) -> int:
    """Delete the folders that no published version names: those gone from
    the manifest, and unpublished ones last written, over ``grace`` seconds
    ago.  Returns how many."""
    # The listing comes first: what is published meanwhile is in the manifest.
    there = [(kind, *x) for kind in KINDS for x in manifests.listed(spark, f"{root}/{kind}")]
    state = published(spark, root)
    stay = {e["folder"] for e in state["entries"]}
    if BASE_VERSION not in {e["version"] for e in state["entries"]}:
        stay.add(BASE_VERSION)
    since = {g["folder"]: g["at"] for g in state["gone"]}
    old = [(kind, folder) for kind, folder, written in there
           if folder not in stay and time.time() - max(written, since.get(folder, 0.0)) >= grace]
    for kind, folder in old:
        manifests.delete(spark, f"{root}/{kind}/{folder}")
    gone = {folder for _, folder in old}
    if gone & set(since):
        manifests.update(spark, f"{root}/published", lambda s: {
            "entries": s.get("entries", []), "gone": [g for g in s.get("gone", []) if g["folder"] not in gone]})
    return len(old)


def versions(spark: SparkSession, root: str) -> DataFrame:
    rows = [(e["version"], _dt.datetime.fromisoformat(e["created"]), True) for e in published(spark, root)["entries"]]
    return spark.createDataFrame(rows, "version STRING, created TIMESTAMP_NTZ, published BOOLEAN")


def current_version(version_rows: DataFrame) -> DataFrame:
    """Newest published version, or ``base`` when there is none.
    One aggregate; the result is a single row."""
    pub = version_rows.filter(F.col("published"))
    return pub.agg(F.max_by("version", "created").alias("v")).select(
        F.coalesce("v", F.lit(BASE_VERSION)).alias("current_version"))


def resolve_version(spark: SparkSession, root: str) -> str:
    """C4c on a store: the version that was published last.  The manifest has
    them in that order, whatever the publishers' clocks say."""
    entries = published(spark, root)["entries"]
    return entries[-1]["version"] if entries else BASE_VERSION


def build_if_missing(spark: SparkSession, root: str, version: str, build) -> bool:
    """Run ``build()`` (which writes and publishes the version) only when
    there is none.  Returns True when it built."""
    if exists(spark, f"{root}/vectors/{folder_of(spark, root, version)}"):
        return False
    build()
    return True
