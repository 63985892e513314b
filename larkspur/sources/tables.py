"""Parquet tables of the listings engine: schemas, reading, appending and new versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

DDL = {
    "listings": "id string, source string, source_url string, raw_title string, raw_description string, venue string, event_date_start date, event_date_end date, scraped_at timestamp, included boolean, filter_reason string, blurb string, tags array<string>, is_manually_added boolean, is_published boolean, is_heads_up boolean, is_duplicate boolean, duplicate_of string, enriched_description string, score int, created_at timestamp, updated_at timestamp",
    "subscribers": "id string, email string, subscribed_at timestamp, is_active boolean, unsubscribe_token string",
    "scraper_runs": "id string, source string, events_found int, error string, ran_at timestamp",
    "digest_runs": "id string, ran_at timestamp, subject string, events_count int, heads_up_count int, subscribers_count int, total_sent int, total_failed int, skipped string, completed_at timestamp",
    "email_logs": "id string, digest_run_id string, subscriber_id string, email string, subject string, message_id string, status string, error string, sent_at timestamp",
    "digest_events": "id string, digest_run_id string, event_id string, category string, created_at timestamp",
}


def schema(name: str) -> StructType:
    return _parse_datatype_string(DDL[name])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(DDL[name]).parquet(f"{root}/{name}")


def append(rows: DataFrame, root: str, name: str) -> None:
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema(name)]).write.mode("append").parquet(f"{root}/{name}")


def write_version(rows: DataFrame, path: str, spread: int = 16) -> None:
    """A version of the listings, by month and sorted within, so that date windows read few files and few row groups. A month lies in `spread` files at most."""
    month = F.date_format("event_date_start", "yyyy-MM")
    rows.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("is_published", "event_date_start", "id").write.partitionBy("month").parquet(path)
