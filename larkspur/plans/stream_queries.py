"""Queries that run as streams: a table is landed in parts, and a stream is taken up again after each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import new_folder
from ..sources import tables
from ..streaming import streams
from ..streaming.buckets import Buckets
from .queries import query

c = F.col
NOON = "TIMESTAMP '2024-02-01 12:00:00'"


def _in_parts(parts: list[DataFrame], start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Lands the parts one after another, and after each runs the stream that start gives until it has read all that is there."""
    spark, folder = parts[0].sparkSession, new_folder(parts[0].sparkSession, "landed")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"), f"{folder}/checkpoint").awaitTermination()


def _halves(runs: DataFrame) -> list[DataFrame]:
    """The runs before a day and those from it on, as they come; event times need a zone."""
    runs = runs.withColumn("ran_at", c("ran_at").cast("timestamp"))
    early = c("ran_at") < F.lit("2024-01-16").cast("timestamp")
    return [runs.where(early), runs.where(~early)]


@query("listings", f"""SELECT source_url, concat('v', last, ' ', raw_title) AS raw_title, CASE WHEN no % 5 = 0 THEN concat('Again ', raw_title) WHEN no % 3 = 0 THEN raw_description END AS raw_description,
 CASE WHEN last < 2 THEN event_date_end END AS event_date_end, {NOON} + to_days(CAST(first AS INT)) AS created_at, {NOON} + to_days(CAST(last AS INT)) AS updated_at
FROM (SELECT *, CASE WHEN no % 3 = 0 THEN 0 WHEN no % 2 = 0 THEN 1 ELSE 2 END AS first, CASE WHEN no % 5 = 0 THEN 2 WHEN no % 2 = 0 THEN 1 ELSE 0 END AS last FROM (SELECT *, CAST(id AS BIGINT) AS no FROM listings)) WHERE no % 2 = 0 OR no % 3 = 0 OR no % 5 = 0""")
def streamed_upserts(rows):
    """Three batches: each has listings of the ones before it, the second no descriptions, the third no end dates."""
    no = c("id").cast("long")
    base = ["source", "source_url", "raw_title", "raw_description", "venue", "event_date_start", "event_date_end"]
    told = lambda k, said, end: rows.where(no % (3, 2, 5)[k] == 0).withColumns({"raw_title": F.concat(F.lit(f"v{k} "), "raw_title"), "raw_description": said, "event_date_end": end}).select(*base, no.alias("seq"))
    parts = [told(0, c("raw_description"), c("event_date_end")), told(1, F.lit(None).cast("string"), c("event_date_end")), told(2, F.concat(F.lit("Again "), "raw_title"), F.lit(None).cast("date"))]
    spark = rows.sparkSession
    table = Buckets(spark, new_folder(spark, "listings"), tables.schema("listings"), "source_url").create()
    noon = lambda k: F.lit(f"2024-02-0{k + 1} 12:00:00").cast("timestamp")
    _in_parts(parts, lambda raw, at: streams.ingest(raw, table, at, noon))
    return table.read().select("source_url", "raw_title", "raw_description", "event_date_end", "created_at", "updated_at")


@query("scraper_runs", "SELECT DISTINCT concat('https://example.org/', source, '/', events_found) AS source_url FROM scraper_runs")
def first_seen_addresses(runs):
    """Addresses that a stream sees for the first time; it remembers them for longer than the runs lie apart."""
    seen = runs.select(F.concat(F.lit("https://example.org/"), "source", F.lit("/"), c("events_found").cast("string")).alias("source_url"), c("ran_at").cast("timestamp").alias("fetched_at"), "ran_at")
    out = new_folder(runs.sparkSession, "first-seen")
    once = lambda raw: streams.first_seen(raw.drop("ran_at"), "60 days").select("source_url")
    _in_parts(_halves(seen), lambda raw, at: once(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start())
    return runs.sparkSession.read.parquet(out)


@query("scraper_runs", "SELECT time_bucket(INTERVAL '1 hour', ran_at) AS start, source, count(*) AS runs, count(error) AS errors, max_by(events_found, struct_pack(ran_at, id)) AS last_found FROM scraper_runs GROUP BY 1, 2")
def streamed_health(runs):
    """The hours of each source as a stream has counted them."""
    return _kept(runs, lambda raw: streams.health_windows(raw, "1 hour", "1 hour"), ["start", "source"]).withColumn("start", c("start").cast("timestamp_ntz"))


@query("scraper_runs", "SELECT source, CASE WHEN error IS NOT NULL THEN 'Error' WHEN events_found = 0 THEN '0 events' ELSE 'OK' END AS status FROM scraper_runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) = 1")
def streamed_status(runs):
    """The last status of each source, kept up by a stream."""
    return _kept(runs, streams.latest_status, ["source"])


def _kept(runs: DataFrame, aggregate: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    out, parts = new_folder(runs.sparkSession, "updates"), _halves(runs)
    _in_parts(parts, lambda raw, at: streams.kept_updates(aggregate(raw), out, at))
    return streams.last_updates(runs.sparkSession, out, aggregate(parts[0]).schema, keys)
