"""Streaming forms: ingest with upsert, first-seen addresses, and the health of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.store import upsert_listings
from .buckets import Buckets


def ingest(raw: DataFrame, table: Buckets, checkpoint: str, now: Callable[[int], Column] = lambda _: F.current_timestamp()) -> StreamingQuery:
    """Upserts each batch of raw listings into the buckets of table that it touches; a batch that is run again changes nothing. now: the time that a batch's rows get."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # told by its buckets, then read
        try:
            table.change(number, batch, lambda current, rows: upsert_listings(current, rows, now(number)).drop("inserted"))
        finally:
            batch.unpersist()

    return raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what each batch of an aggregate in update mode says, under the batch's number; a batch that is run again writes the same again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number:09d}")

    return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_updates(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """What was said last of each key."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/*")
    others = [f.name for f in schema if f.name not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def first_seen(raw: DataFrame, late: str = "1 day") -> DataFrame:
    """Addresses as they are seen first; copies within the watermark are dropped."""
    return raw.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["source_url"])


def health_windows(runs: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs, errors and the last count of each source by window of time. Later rows than the watermark are dropped."""
    w = F.window("ran_at", width)
    agg = runs.withWatermark("ran_at", late).groupBy(w.alias("w"), "source").agg(F.count("*").alias("runs"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.max_by("events_found", F.struct("ran_at", "id")).alias("last_found"))
    return agg.select(F.col("w.start").alias("start"), "source", "runs", "errors", "last_found")


def latest_status(runs: DataFrame) -> DataFrame:
    """The status of each source's last run, for update mode."""
    last = runs.groupBy("source").agg(F.max(F.struct("ran_at", "id", "events_found", "error")).alias("r"))
    return last.select("source", F.when(F.col("r.error").isNotNull(), "Error").when(F.col("r.events_found") == 0, "0 events").otherwise("OK").alias("status"))
