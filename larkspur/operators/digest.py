"""The periodic digest: what is in it, compared with the one before, and to whom it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import compact_range, header_label, short_label
from .ordered import numbered


def previous_members(runs: DataFrame, members: DataFrame, before: str | None = None) -> DataFrame:
    """event_id and category of the latest run that was completed and not skipped; before: leave this run out."""
    done = runs.where("completed_at is not null and skipped is null")
    if before is not None:
        done = done.where(F.col("id") != before)
    last = done.agg(F.max_by("id", F.struct("ran_at", "id")).alias("digest_run_id"))
    return members.join(F.broadcast(last), "digest_run_id").select("event_id", "category")  # one row


def classified(listings: DataFrame, previous: DataFrame, window_end: Column, least_new: int = 3) -> DataFrame:
    """The listings with category and position (from 1) in it.

    Unseen rows and seen ones of a single day are new; seen ones of several days end soon if they end in the window,
    and go on otherwise. Where fewer than least_new are new, the best ongoing ones follow them.
    """
    seen = previous.select(F.col("event_id").alias("id"), F.lit(True).alias("seen")).distinct()
    several = F.col("event_date_end").isNotNull() & (F.col("event_date_end") != F.col("event_date_start"))
    category = F.when(F.col("seen").isNull() | ~several, "new").when(F.col("event_date_end") <= window_end, "ending_soon").otherwise("ongoing")
    rows = listings.join(seen, "id", "left").withColumn("category", category)
    score = F.coalesce("score", F.lit(0))
    n_new = rows.agg(F.count_if(F.col("category") == "new").alias("n_new"))
    # at most least_new rows, the best of those that go on
    few = rows.where("category = 'ongoing'").orderBy(score.desc(), "event_date_start", "id").limit(least_new)
    few = few.select("id", F.row_number().over(Window.orderBy(score.desc(), "event_date_start", "id")).alias("by_score"))
    up = few.crossJoin(F.broadcast(n_new)).where(F.col("by_score") <= least_new - F.col("n_new")).select("id", F.col("by_score").alias("up"))
    rows = rows.join(F.broadcast(up), "id", "left").withColumn("category", F.when(F.col("up").isNotNull(), "new").otherwise(F.col("category")))
    new = F.col("category") == "new"
    order = {"k1": F.coalesce("up", F.lit(0)), "k2": F.when(new, -score).otherwise(0), "k3": F.when(new, F.col("event_date_start")).otherwise(F.coalesce("event_date_end", F.lit("0001-01-01").cast("date")))}
    placed = numbered(rows.withColumns(order).drop("seen", "up"), F.col("category"), *map(F.col, order), F.col("id"), name="place")
    first = placed.groupBy("category").agg(F.min("place").alias("first"))  # three rows
    return placed.join(F.broadcast(first), "category").withColumn("position", F.col("place") - F.col("first") + 1).drop("place", "first", *order).select(*listings.columns, "category", "position")


def digest_members(parts: DataFrame, ahead: DataFrame, run_id: str) -> DataFrame:
    both = parts.select("id", "category").unionByName(ahead.select("id", F.lit("heads_up").alias("category")))
    return both.select(F.lit(run_id).alias("digest_run_id"), F.col("id").alias("event_id"), "category")


def skip_reason(listings: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row: why no digest goes out, null if one does."""
    events = listings.limit(1).agg(F.count("*").alias("events"))
    active = subscribers.where("is_active").limit(1).agg(F.count("*").alias("active"))
    return events.crossJoin(F.broadcast(active)).select(F.when(F.col("events") == 0, "No events for this week").when(F.col("active") == 0, "No active subscribers").alias("skipped"))


def sections(parts: DataFrame, window_start: Column) -> DataFrame:
    """New and ending rows by day, days in order of first appearance: group_no, day label and lines."""
    main = parts.where(F.col("category").isin("new", "ending_soon")).withColumn("day", F.greatest("event_date_start", window_start))
    place = F.struct((F.col("category") == "ending_soon").alias("c"), "position")
    badge = F.when(F.col("category") == "ending_soon", " (last chance)").otherwise("")
    span = compact_range(F.col("event_date_start"), F.col("event_date_end"))
    line = F.concat("raw_title", badge, F.lit(", "), "venue", F.coalesce(F.concat(F.lit(", "), span), F.lit("")))
    days = main.groupBy("day").agg(F.min(place).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    return days.select(F.row_number().over(Window.orderBy("at")).alias("group_no"), header_label(F.col("day")).alias("day"), "lines")  # a row for each day of the window


def ongoing_lines(parts: DataFrame) -> DataFrame:
    """position and line of what still goes on: title, venue and its last day."""
    until = F.coalesce(F.concat(F.lit(" · until "), short_label(F.col("event_date_end"))), F.lit(""))
    return parts.where("category = 'ongoing'").select("position", F.concat("raw_title", F.lit(" · "), "venue", until).alias("line"))


def heads_up_sections(ahead: DataFrame) -> DataFrame:
    """What is announced, best first as top_heads_up gives it, by day in order of first appearance: group_no, day label and lines."""
    place = F.struct((-F.coalesce("score", F.lit(0))).alias("s"), F.col("event_date_start").alias("d"), "id")
    span = compact_range(F.col("event_date_start"), F.col("event_date_end"))
    line = F.concat("raw_title", F.lit(", "), "venue", F.coalesce(F.concat(F.lit(", "), span), F.lit("")))
    days = ahead.groupBy(F.col("event_date_start").alias("day")).agg(F.min(place).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    return days.select(F.row_number().over(Window.orderBy("at")).alias("group_no"), header_label(F.col("day")).alias("day"), "lines")  # of the two or three rows that are announced


def outbox(subscribers: DataFrame, body: DataFrame) -> DataFrame:
    """A message for each active subscriber: one body, with the subscriber's token put in."""
    return subscribers.where("is_active").crossJoin(F.broadcast(body.select("subject", "body"))).select("id", "email", "subject", F.replace("body", F.lit("{token}"), F.col("unsubscribe_token")).alias("body"))  # one row


def welcome(new_subscribers: DataFrame, ahead: DataFrame) -> DataFrame:
    """Each new subscriber with the listings announced to all of them."""
    few = ahead.select(F.col("id").alias("event_id"), "raw_title", "event_date_start")
    return new_subscribers.select("id", "email").crossJoin(F.broadcast(few))  # top_heads_up gives two or three rows


def retry_set(runs: DataFrame, logs: DataFrame, subscribers: DataFrame, pattern: str = "%Too many requests%") -> DataFrame:
    """Subscribers whose message of the latest run failed for the given reason."""
    last = runs.agg(F.max_by("id", F.struct("ran_at", "id")).alias("digest_run_id"))
    failed = logs.where((F.col("status") == "failed") & F.col("error").ilike(pattern)).join(F.broadcast(last), "digest_run_id")  # one row
    return failed.select("digest_run_id", F.col("id").alias("log_id"), "subscriber_id").join(subscribers.select(F.col("id").alias("subscriber_id"), "email"), "subscriber_id")


def delivery_totals(logs: DataFrame) -> DataFrame:
    return logs.groupBy("digest_run_id").agg(F.count_if(F.col("status") == "sent").alias("total_sent"), F.count_if(F.col("status") == "failed").alias("total_failed"))
