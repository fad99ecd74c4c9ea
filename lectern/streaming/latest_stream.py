"""The newest N feedback records as a stream.

``feedback.latest`` scans the store for every training run.  Here a stateful
query keeps its answer up to date: each record goes by its hash to one of
``buckets`` groups, and a group's state is a heap of its newest ``n`` records.
A micro-batch costs its own records, and the state holds ``buckets * n`` of
them however many have arrived.

Records that are sent again count once.  The heap itself tells them: a record
that has left it has ``n`` newer ones in its group, so its repeat can't come
back.  No list of all ids seen is needed.

A group emits only records that enter its heap.  The sink merges them with the
snapshot of the batch before and writes the newest ``n`` as ``batch=<id>``.
State and input offsets are the checkpoint's, and a batch that is run again
starts from the same state and the same snapshot and replaces its own folder:
each record takes effect exactly once, whatever was killed in between.

Defined cases: records without a timestamp are the oldest, without an id the
oldest of their timestamp, as in ``feedback.latest``; equal records are one;
fewer than ``n`` records give them all; before the first batch the result is
empty; columns besides ``FEEDBACK_COLUMNS`` are not kept.  Records that a
training run has consumed still count here; the batch form on the store leaves
them out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import feedback as fb
from lectern.sources import manifest as manifests
from lectern.sources.feedback_store import FEEDBACK_SCHEMA

BUCKETS = 64
KEPT = 2                    # earlier snapshots that stay for a retry and for readers

# Fixed width, so that text order is time order.
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_RECORD = "fid LONG, query STRING, verse_id STRING, is_relevant BOOLEAN, ts STRING"


def _age(record: str) -> tuple:
    """Sort key of a record: newer is larger."""
    r = json.loads(record)
    return r.get("ts", ""), "fid" in r, r.get("fid", 0), record


def newest_of_bucket(n: int):
    """The state function: merge a batch's records into the bucket's heap and
    yield those that enter it."""
    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = set(state.get[0]) if state.exists else set()
        held = before
        for frame in frames:
            # Most records of a late batch are older than the whole heap.
            least = min(_age(r)[0] for r in held) if len(held) >= n else ""
            come = set(frame.loc[frame["ts"] >= least, "record"])
            held = set(heapq.nlargest(n, held | come, key=_age))
        state.update((sorted(held),))
        entered = sorted(held - before)
        if entered:
            yield pd.DataFrame({"record": entered})
    return merge


def entering(records: DataFrame, n: int = fb.LATEST_N, buckets: int = BUCKETS) -> DataFrame:
    """Streaming records -> those that enter the newest ``n`` of their bucket
    (update mode).  A superset of the newest ``n`` of all."""
    if not 1 <= n <= fb.MAX_LATEST or buckets < 1:
        raise ValueError(f"n must be from 1 to {fb.MAX_LATEST} and buckets at least 1")
    ts = F.date_format("timestamp", _TIME)
    packed = records.select(
        F.pmod(F.xxhash64(*fb.FEEDBACK_COLUMNS), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce(ts, F.lit("")).alias("ts"),
        F.to_json(F.struct("fid", "query", "verse_id", "is_relevant", ts.alias("ts"))).alias("record"))
    out = packed.groupBy("bucket").applyInPandasWithState(
        newest_of_bucket(n), "record STRING", "held ARRAY<STRING>", "update", GroupStateTimeout.NoTimeout)
    r = F.from_json("record", _RECORD).alias("r")
    return out.select(r).select("r.fid", "r.query", "r.verse_id", "r.is_relevant",
                                F.to_timestamp_ntz("r.ts", F.lit(_TIME)).alias("timestamp"))


def _snapshots(spark: SparkSession, out_dir: str) -> list[int]:
    """Ids of the finished snapshots, oldest first."""
    ids = [int(name.split("=")[1]) for name, _ in manifests.listed(spark, out_dir) if name.startswith("batch=")]
    done = []
    for i in sorted(ids):
        mark, fs = manifests.file_system(spark, f"{out_dir}/batch={i}/_SUCCESS")
        if fs.exists(mark):
            done.append(i)
    return done


def start_latest(records: DataFrame, out_dir: str, checkpoint: str, n: int = fb.LATEST_N,
                 buckets: int = BUCKETS, available_now: bool = True):
    """Keep the newest ``n`` of a stream of valid records in ``out_dir``.  Of a
    stream with a column ``reason`` only the valid ones count.  A checkpoint
    belongs to one ``out_dir``, ``n`` and ``buckets``."""
    if "reason" in records.columns:
        records = records.filter(F.col("reason").isNull())

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        there = _snapshots(spark, out_dir)
        earlier = [i for i in there if i < epoch_id]
        if epoch_id and not earlier:
            raise RuntimeError(f"{out_dir} has no snapshot before batch {epoch_id}; its checkpoint has")
        if earlier:
            batch = batch.unionByName(spark.read.schema(FEEDBACK_SCHEMA).parquet(f"{out_dir}/batch={earlier[-1]}"))
        (fb.newest_rows(batch, n).coalesce(1)
         .write.mode("overwrite").parquet(f"{out_dir}/batch={epoch_id}"))
        for i in earlier[:-KEPT]:
            manifests.delete(spark, f"{out_dir}/batch={i}")

    writer = (entering(records, n, buckets).writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest records as of the last finished batch."""
    there = _snapshots(spark, out_dir)
    if not there:
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(f"{out_dir}/batch={there[-1]}")
