"""Listings, runs, logs and subscribers derived from the driver's tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import TAGS

# In DuckDB; the Spark forms below give the same rows.
SQL = {
    "listings": r"""w AS (
  SELECT doc_id, text, source, lang,
         regexp_extract(text, '^[ \t\r\n]*([^ \t\r\n]+(?:[ \t\r\n]+[^ \t\r\n]+){0,7})', 1) AS raw_title,
         md5(lower(regexp_extract(text, '^[ \t\r\n]*([^ \t\r\n]+(?:[ \t\r\n]+[^ \t\r\n]+){0,2})', 1))) AS h
  FROM documents),
x AS (
  SELECT *, instr('0123456789abcdef', substr(h,4,1))-1 AS d4, instr('0123456789abcdef', substr(h,5,1))-1 AS d5,
         instr('0123456789abcdef', substr(h,6,1))-1 AS d6, instr('0123456789abcdef', substr(h,7,1))-1 AS d7,
         instr('0123456789abcdef', substr(h,8,1))-1 AS d8, instr('0123456789abcdef', substr(h,9,1))-1 AS d9
  FROM w),
y AS (SELECT *, CAST((16*d4+d5) % 60 AS INT) AS off FROM x),
z AS (
SELECT CAST(y.doc_id AS VARCHAR) AS id, y.source AS source, concat('https://example.org/', CAST(y.doc_id AS VARCHAR)) AS source_url,
       y.raw_title AS raw_title, y.text AS raw_description, concat('Hall ', substr(y.h,1,2), ' b', substr(y.h,3,1)) AS venue,
       DATE '2024-01-01' + y.off AS event_date_start,
       CASE WHEN y.d6 < 8 THEN NULL ELSE DATE '2024-01-01' + CAST(y.off + y.d6 - 7 + CASE WHEN y.d7 = 0 THEN 45 ELSE 0 END AS INT) END AS event_date_end,
       (l.quality = 1) AS included, CAST(CASE WHEN l.quality = 1 THEN y.d8 % 10 + 1 END AS INT) AS score,
       coalesce(l.quality = 1 AND y.d8 % 10 + 1 >= 7, FALSE) AS is_published, coalesce(l.quality = 1 AND y.d7 < 3, FALSE) AS is_heads_up,
       FALSE AS is_duplicate, CAST(y.d9 % 12 AS INT) AS tag_no, TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM y LEFT JOIN labels l ON l.doc_id = y.doc_id),
listings AS (
SELECT *, CAST(NULL AS VARCHAR) AS enriched_description, CASE WHEN included THEN substr(raw_description, 1, 120) END AS blurb,
       CASE WHEN included IS NULL THEN NULL WHEN tag_no % 2 = 0 THEN [TAGS[tag_no + 1], TAGS[(tag_no + 5) % 12 + 1]] ELSE [TAGS[tag_no + 1]] END AS tags
FROM z)""".replace("TAGS[", "(" + str(list(TAGS)) + ")["),
    "scraper_runs": """scraper_runs AS (
SELECT CAST(event_id AS VARCHAR) AS id, concat('src', CAST(user_id % 10 AS VARCHAR)) AS source,
       CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INT) % 5 END AS events_found,
       CASE WHEN event_type = 'error' THEN props END AS error, ts AS ran_at FROM events)""",
    "sources": """sources AS (SELECT concat('src', CAST(range AS VARCHAR)) AS source FROM range(11))""",
    "digest_runs": """digest_runs AS (
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS id, max(ts) AS ran_at, CASE WHEN day(CAST(ts AS DATE)) % 7 = 0 THEN 'No events for this week' END AS skipped,
       CASE WHEN day(CAST(ts AS DATE)) % 5 = 0 THEN NULL ELSE max(ts) END AS completed_at, CAST(count(DISTINCT user_id) AS INT) AS subscribers_count
FROM events GROUP BY CAST(ts AS DATE))""",
    "email_logs": """email_logs AS (
SELECT CAST(event_id AS VARCHAR) AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS digest_run_id, user_id AS subscriber_id,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS status,
       CASE WHEN event_type <> 'error' THEN NULL WHEN user_id % 2 = 0 THEN 'Too many requests' ELSE 'Invalid address' END AS error, ts AS sent_at FROM events)""",
    "subscribers": """subscribers AS (
SELECT c_custkey AS id, concat(replace(lower(c_name), '#', '.'), '@example.org') AS email, DATE '2023-01-01' + CAST(c_custkey % 365 AS INT) AS subscribed_on,
       c_acctbal > 0 AS is_active, md5(c_name) AS unsubscribe_token FROM customer)""",
    "digest_events": """digest_events AS (
SELECT CASE WHEN doc_id % 2 = 0 THEN '2024-01-29' ELSE '2024-01-19' END AS digest_run_id, CAST(doc_id AS VARCHAR) AS event_id, CASE WHEN doc_id % 9 = 0 THEN 'heads_up' ELSE 'new' END AS category FROM documents WHERE doc_id % 3 = 0)""",
}


def with_tables(names: str, query: str) -> str:
    """An oracle that reads derived tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda n: F.regexp_extract("text", rf"^[ \t\r\n]*([^ \t\r\n]+(?:[ \t\r\n]+[^ \t\r\n]+){{0,{n}}})", 1)
    h = F.md5(F.lower(words(2)).cast("binary"))
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring("h", k, 1)) - 1
    w = read(spark, sf_dir, "documents").select("doc_id", "text", "source", words(7).alias("raw_title"), h.alias("h"))
    y = w.withColumns({f"d{k}": digit(k) for k in range(4, 10)}).withColumn("off", (16 * F.col("d4") + F.col("d5")) % 60)
    marks = read(spark, sf_dir, "labels").select("doc_id", "quality")
    j = y.join(marks, "doc_id", "left")
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("off"))
    good = F.col("quality") == 1
    tags = F.array(*[F.lit(t) for t in TAGS])
    no = F.col("d9") % 12
    first, second = F.element_at(tags, (no + 1).cast("int")), F.element_at(tags, ((no + 5) % 12 + 1).cast("int"))
    return j.select(
        F.col("doc_id").cast("string").alias("id"), "source", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), "raw_title", F.col("text").alias("raw_description"),
        F.concat(F.lit("Hall "), F.substring("h", 1, 2), F.lit(" b"), F.substring("h", 3, 1)).alias("venue"), start.alias("event_date_start"),
        F.when(F.col("d6") < 8, None).otherwise(F.date_add(start, F.col("d6") - 7 + F.when(F.col("d7") == 0, 45).otherwise(0))).alias("event_date_end"),
        good.alias("included"), F.when(good, F.col("d8") % 10 + 1).cast("int").alias("score"), F.coalesce(good & (F.col("d8") % 10 + 1 >= 7), F.lit(False)).alias("is_published"),
        F.coalesce(good & (F.col("d7") < 3), F.lit(False)).alias("is_heads_up"), F.lit(False).alias("is_duplicate"), no.cast("int").alias("tag_no"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.lit(None).cast("string").alias("enriched_description"), F.when(good, F.substring("text", 1, 120)).alias("blurb"),
        F.when(good.isNull(), None).when(no % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("tags"),
    )


def scraper_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 10).cast("string")).alias("source"),
        F.when(failed, 0).otherwise(F.floor("value").cast("int") % 5).cast("int").alias("events_found"), F.when(failed, F.col("props")).alias("error"), F.col("ts").alias("ran_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten known sources, and one that never ran."""
    return spark.range(11).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))


def digest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    runs = read(spark, sf_dir, "events").groupBy(day.alias("d")).agg(F.max("ts").alias("ran_at"), F.count_distinct("user_id").cast("int").alias("subscribers_count"))
    n = F.dayofmonth("d")
    return runs.select(F.col("d").cast("string").alias("id"), "ran_at", F.when(n % 7 == 0, "No events for this week").alias("skipped"), F.when(n % 5 == 0, None).otherwise(F.col("ran_at")).alias("completed_at"), "subscribers_count")


def email_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    error = F.when(~failed, None).when(F.col("user_id") % 2 == 0, "Too many requests").otherwise("Invalid address")
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.to_date("ts").cast("string").alias("digest_run_id"), F.col("user_id").alias("subscriber_id"), F.when(failed, "failed").otherwise("sent").alias("status"), error.alias("error"), F.col("ts").alias("sent_at"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.org"))
    since = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), email.alias("email"), since.alias("subscribed_on"), (F.col("c_acctbal") > 0).alias("is_active"), F.md5(F.col("c_name").cast("binary")).alias("unsubscribe_token"))


def digest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == 0)
    return seen.select(F.when(F.col("doc_id") % 2 == 0, "2024-01-29").otherwise("2024-01-19").alias("digest_run_id"), F.col("doc_id").cast("string").alias("event_id"), F.when(F.col("doc_id") % 9 == 0, "heads_up").otherwise("new").alias("category"))
