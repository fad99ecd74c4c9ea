"""Numbered manifests: the commit rule of every stored table here.

A folder holds ``00000001.json``, ``00000002.json``, ...; the newest whole one
is the state.  A writer creates the next number if nobody has.  Else it reads
the newest state, applies its change to that one and tries again, so of two
writers one comes first and neither's change is lost.  A writer whose change
only holds for the state it began with passes ``base`` to ``commit`` and gets a
``Conflict`` instead.  States are small: names of folders and files, no rows.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

GRACE = 30.0                # seconds that a manifest may stay half written


class Conflict(RuntimeError):
    """Another writer took the version first."""


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names in a folder and the seconds of their last change; empty where the
    folder is missing."""
    path, fs = file_system(spark, folder)
    if not fs.exists(path):
        return []
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def newest(spark: SparkSession, folder: str) -> dict:
    """The newest whole manifest with its ``version`` (0: none) and the number
    that comes ``next``.  A newer file that isn't whole is being written;
    ``GRACE`` seconds after its last change its writer is taken for lost, and
    the next number is the one behind it."""
    later = None
    for name, changed in reversed(listed(spark, folder)):
        if not name.endswith(".json") or name.startswith("."):
            continue
        text = "".join(r["value"] for r in spark.read.text(f"{folder}/{name}").collect())
        try:
            return {"next": later or int(name[:8]) + 1, **json.loads(text)}
        except ValueError:
            later = (later or int(name[:8]) + 1) if time.time() - changed > GRACE else None
    return {"version": 0, "next": later or 1}


def commit(spark: SparkSession, folder: str, base: dict, state: dict) -> dict:
    """Create the manifest that follows ``base``; Conflict if it is there."""
    new = {**state, "version": base["next"]}
    path, fs = file_system(spark, f"{folder}/{new['version']:08d}.json")
    try:
        out = fs.create(path, False)
    except Exception as exc:
        if fs.exists(path):
            raise Conflict(f"version {new['version']} is there") from exc
        raise
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    return new


def update(spark: SparkSession, folder: str, change, base: dict | None = None) -> dict:
    """Commit ``change(state) -> state`` on the newest manifest, again and
    again until no other writer comes in between.  Every failed try means that
    another one was successful."""
    while True:
        base = base or newest(spark, folder)
        try:
            return commit(spark, folder, base, change({k: v for k, v in base.items() if k not in ("version", "next")}))
        except Conflict:
            base = None
            time.sleep(0.2)
