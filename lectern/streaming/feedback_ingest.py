"""Feedback as a stream.

The reference inserts one record per HTTP request.  Here requests land as
files in a folder; a Structured Streaming query validates them and appends
the valid ones to the feedback store and the malformed ones to a
``rejected`` table.  ``foreachBatch`` writes both sinks of a micro-batch;
the checkpoint makes a restarted query continue where it stopped, and
``availableNow`` processes everything present and then stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import feedback as fb
from lectern.plans import standins as S
from lectern.sources import feedback_store

RAW_SCHEMA = T.StructType([
    T.StructField("fid", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("verse_id", T.StringType()),
    T.StructField("is_relevant", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


def validated_stream(raw_stream: DataFrame) -> DataFrame:
    """A11 on a stream: typed records plus ``reason``."""
    return fb.validate_records(raw_stream)


REQUEST_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("verse_id", T.StringType()),
    T.StructField("is_relevant", T.StringType()),
])


def with_request_ids(batch: DataFrame, epoch_id: int) -> DataFrame:
    """Add ``fid``, a hash of the batch id, the request and its number among
    equal requests of the batch: the same on a retry, however the batch is
    split then.  Equal requests are counted before they are shuffled."""
    columns = batch.columns
    counted = batch.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    # Nulls are skipped by the hash, so their places go in as well.
    places = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return numbered.select(*columns, F.xxhash64(F.lit(epoch_id), places, *columns, "_i").alias("fid"))


def start_ingest(checked: DataFrame, out_dir: str, checkpoint: str,
                 available_now: bool = True):
    """A10: write valid records to ``out_dir/valid`` and malformed ones to
    ``out_dir/rejected``.

    Each micro-batch goes to its own ``batch=<id>`` folder with overwrite,
    so a batch that is retried (for example after a lost executor) replaces
    its own output instead of appending it twice; the checkpoint records
    which batches are done.  Readers use ``read_ingested``.
    """
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        if "fid" not in batch.columns:
            batch = with_request_ids(batch, epoch_id)
        batch = batch.persist()
        (batch.filter(F.col("reason").isNull()).drop("reason")
              .write.mode("overwrite").parquet(f"{out_dir}/valid/batch={epoch_id}"))
        (batch.filter(F.col("reason").isNotNull())
              .write.mode("overwrite").parquet(f"{out_dir}/rejected/batch={epoch_id}"))
        batch.unpersist()

    writer = (checked.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_ingested(spark: SparkSession, out_dir: str, which: str = "valid") -> DataFrame:
    """Valid (or rejected) records of all finished micro-batches."""
    df = spark.read.parquet(f"{out_dir}/{which}")
    return df.drop("batch")


def stamped_requests(requests: DataFrame) -> DataFrame:
    """A7 on a stream: each request gets the processing time of its
    micro-batch (UTC, naive); ``start_ingest`` adds the id."""
    return requests.withColumn("timestamp", feedback_store.utc_now(requests.sparkSession))


def ingest_json_requests(spark: SparkSession, in_dir: str, out_dir: str,
                         available_now: bool = True):
    """A10: feedback requests arriving as JSON files (one object per line,
    fields ``query, verse_id, is_relevant``) -> validated feedback store."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).json(in_dir)
    checked = validated_stream(stamped_requests(stream))
    return start_ingest(checked, out_dir, f"{out_dir}/_checkpoint", available_now)


def event_requests(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The ``events`` table of a driver folder, one file or a folder of part
    files, as a stream of feedback requests (stand-in mapping of
    ``standins.feedback``)."""
    events_schema = S.table(spark, sf_dir, "events").schema
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(events_schema).option("maxFilesPerTrigger", files_per_trigger)
    # A file stream reads folders; a single file is named by a filter on its folder.
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hp).isDirectory():
        stream = reader.parquet(path)
    else:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(
        F.col("event_id").alias("fid"),
        F.col("event_type").alias("query"),
        F.col("user_id").cast("string").alias("verse_id"),
        F.when(F.col("event_type").isin(*S.RELEVANT_EVENTS), "true")
         .otherwise("false").alias("is_relevant"),
        F.col("ts").alias("timestamp"))


def finish(query) -> None:
    """Wait for a query and raise what it failed with."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest_events_once(spark: SparkSession, sf_dir: str, out_dir: str, files_per_trigger: int = 100) -> None:
    """Stream the ``events`` table of a driver folder into ``out_dir``."""
    raw = event_requests(spark, sf_dir, files_per_trigger)
    finish(start_ingest(validated_stream(raw), out_dir, f"{out_dir}/_checkpoint"))
