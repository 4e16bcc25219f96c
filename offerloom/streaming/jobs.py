"""Continuous price feeds with Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from offerloom.operators.merge import clean_batch
from offerloom.operators.offerstore import OfferStore

PLAN_TTL = "60 minutes"
LATENESS = "2 hours"
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def events_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _batch_dir(out: str, batch_id: int) -> str:
    return os.path.join(out, f"batch={batch_id}")


def write_batches(df: DataFrame, out: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a batch that is run again changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_dir(out, batch_id))

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def rolling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and value per tumbling window and type."""
    return (
        events.withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def newest_of_batches(spark: SparkSession, out: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Last emitted row per key of an update-mode output."""
    rows = spark.read.schema(schema.add("batch", T.LongType())).option("basePath", out).parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def latest_prices(spark: SparkSession, events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Newest value per key and batch; older rows that come late lose against the newest on reading."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
        newest.select("user_id", "event_type", "r.*").write.mode("overwrite").parquet(_batch_dir(out, batch_id))

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r")).select("user_id", "event_type", "r.*")


def valid_checkouts(events: DataFrame) -> DataFrame:
    """Checkouts made while a plan of the same user was valid. A semi join: one row per checkout, however many plans."""
    plans = events.filter("event_type = 'view'").select(F.col("user_id").alias("plan_user"), F.col("ts").alias("plan_ts")).withWatermark("plan_ts", LATENESS)
    checkouts = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("paid_ts")).withWatermark("paid_ts", LATENESS)
    valid = F.expr(f"user_id = plan_user AND paid_ts >= plan_ts AND paid_ts <= plan_ts + INTERVAL {PLAN_TTL}")
    return checkouts.join(plans, valid, "left_semi")


def import_stream(raw: DataFrame, store: OfferStore, checkpoint: str) -> StreamingQuery:
    """Price lists landing as files, in any number of parts and batches: every micro-batch adds its rows to the store.

    ``raw`` names the list of each row (price_list_id, and list_no that rises from a supplier's list to its next). Version
    numbers follow from the batch number, so a batch that is run again replaces what it wrote.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        rows = clean_batch(batch, F.col("price_list_id")).filter("refused IS NULL")
        store.add(rows, 2 * batch_id + 2)
        store.compact(batch.sparkSession, 2 * batch_id + 3)

    return raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
