"""Serving queries over listings: date windows, tags, keywords, look-ahead, detail and browsing.

Every order ends with id, so that pages are the same on every run. `today` is a
date column or literal; the caller decides on the zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

VISIBLE = "coalesce(included, false) and not is_duplicate"


def published_between(listings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Published listings that overlap the window. Neither duplicates nor excluded rows are looked for here."""
    s, e = F.col("event_date_start"), F.col("event_date_end")
    return listings.where(F.col("is_published") & (s < F.date_add(end, 1)) & ((e >= start) | (e.isNull() & (s >= start)))).orderBy("event_date_start", "id")


def public_feed(listings: DataFrame, start: Column, end: Column) -> DataFrame:
    out = published_between(listings, start, end)
    return out.select("id", "raw_title", "venue", "event_date_start", "event_date_end", F.coalesce("blurb", F.lit("")).alias("blurb"), F.coalesce("tags", F.array()).alias("tags"), "source_url")


def window_feed(listings: DataFrame, start: Column, end: Column, tag: str | None = None) -> DataFrame:
    """The window's visible listings; with a tag, only those that start in the window and have it."""
    if tag is None:
        return published_between(listings, start, end).where(VISIBLE)
    inside = F.col("event_date_start").between(start, end)
    return listings.where(F.col("is_published") & inside & has_tag(tag)).where(VISIBLE).orderBy("event_date_start", "id")


def has_tag(tag: str) -> Column:
    return F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(t) == tag.lower())


def keyword_search(listings: DataFrame, words: str, today: Column, limit: int = 10) -> DataFrame:
    """Any of title, descriptions, venue or tags holds the pattern, case aside; % and _ in it are wildcards."""
    pattern = "%" + words.replace("\\", "\\\\") + "%"
    columns = ("raw_title", "enriched_description", "raw_description", "venue")
    hit = F.coalesce(F.array_join("tags", ","), F.lit("")).ilike(pattern)
    for c in columns:
        hit = hit | F.coalesce(c, F.lit("")).ilike(pattern)
    return listings.where(F.col("is_published") & (F.col("event_date_start") >= today) & hit).where(VISIBLE).orderBy("event_date_start", "id").limit(min(max(limit, 1), 50))


def heads_up(listings: DataFrame, today: Column, limit: int = 20, first: int = 20) -> DataFrame:
    """The next `first` announced listings over a week ahead, of which the visible ones are shown."""
    ahead = listings.where(F.col("is_heads_up") & F.col("is_published") & (F.col("event_date_start") > F.date_add(today, 7)))
    return ahead.orderBy("event_date_start", "id").limit(first).where(VISIBLE).orderBy("event_date_start", "id").limit(limit)


def top_heads_up(listings: DataFrame, today: Column, limit: int = 3) -> DataFrame:
    ahead = listings.where(F.col("is_heads_up") & F.col("is_published") & (F.col("event_date_start") > F.date_add(today, 7)))
    return ahead.orderBy(F.coalesce("score", F.lit(0)).desc(), "event_date_start", "id").limit(limit)


def by_tag(listings: DataFrame, tag: str, today: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    return listings.where(F.col("is_published") & (F.col("event_date_start") >= today) & has_tag(tag)).orderBy("event_date_start", "id").offset(offset).limit(limit)


def tag_page(listings: DataFrame, tag: str, vocabulary: tuple[str, ...], today: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page with has_more, known from one row beyond it. An unknown tag is an error."""
    if tag not in vocabulary:
        raise ValueError(f"unknown tag: {tag}")
    limit = min(limit, 100)
    more = by_tag(listings, tag, today, limit + 1, offset)
    n = F.row_number().over(Window.orderBy("event_date_start", "id"))  # over a page and one row
    return more.withColumn("n", n).withColumn("has_more", F.max("n").over(Window.partitionBy()) > limit).where(F.col("n") <= limit)


def browse_tag(listings: DataFrame, tag: str, vocabulary: tuple[str, ...], today: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """A tag in any case; a page may be short, since hidden rows go after paging."""
    if tag.lower() not in vocabulary:
        raise ValueError(f"unknown tag: {tag}")
    return by_tag(listings, tag, today, limit, offset).where(VISIBLE)


def details(listings: DataFrame, ids: DataFrame) -> DataFrame:
    return listings.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("is_published")).where(VISIBLE)


def admin_list(listings: DataFrame, source: str | None = None, title: str | None = None) -> DataFrame:
    """All listings, newest first, by source and a part of the title."""
    out = listings
    if source:
        out = out.where(F.col("source") == source)
    if title:
        out = out.where(F.lower("raw_title").contains(title.lower()))
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def sources(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def grouped_by_day(listings: DataFrame, window_start: Column) -> DataFrame:
    """Days in order, each with its listings; what began before the window counts for its first day."""
    day = F.greatest("event_date_start", window_start)
    return listings.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_date_start", "id"))), lambda x: x["id"]), ",").alias("ids")).orderBy("day")


def result_header(rows: DataFrame, what: str, block: Column) -> DataFrame:
    """One row: how many were found, and their blocks with rules between."""
    both = rows.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_date_start", "id", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("body"))
    return both.select(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f" {what}"), F.when(F.col("n") == 1, "").otherwise("s")).alias("header"), "body")


def day_parts(listings: DataFrame, window_start: Column, most: int = 200) -> DataFrame:
    """grouped_by_day in parts of at most `most` listings, numbered from 0 within their day: day, part, n, ids."""
    dated = listings.select("id", "event_date_start", F.greatest("event_date_start", window_start).alias("day"))
    placed = numbered(dated, F.col("day"), F.col("event_date_start"), F.col("id"), name="place")
    first = placed.groupBy("day").agg(F.min("place").alias("first"))  # a row for each day
    part = F.floor((F.col("place") - F.col("first")) / most).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",")
    return placed.join(first, "day").groupBy("day", part).agg(F.count("*").alias("n"), ids.alias("ids"))


def result_parts(rows: DataFrame, what: str, block: Column, most: int = 100) -> DataFrame:
    """result_header in parts of at most `most` blocks, each under the header of all: header, part, body. No rows: one part with nothing in it."""
    placed = numbered(rows.select("event_date_start", "id", block.alias("b")), F.col("event_date_start"), F.col("id"), name="place")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "b"))), lambda x: x["b"]), "\n\n---\n\n")
    parts = placed.groupBy(F.floor(F.col("place") / most).alias("part")).agg(body.alias("body"))
    n = placed.agg(F.count("*").alias("n"))
    header = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f" {what}"), F.when(F.col("n") == 1, "").otherwise("s"))
    both = n.join(parts, F.col("part").isNotNull(), "left")  # one row on the left
    return both.select(header.alias("header"), F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.coalesce("body", F.lit("")).alias("body"))
