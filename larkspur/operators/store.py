"""Keyed maintenance of tables: the current rows and the changes give the next version.

All of these are joins on the key, so that the same function serves a batch job
and foreachBatch. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .unique import taken

CONTENT = ("raw_title", "venue", "event_date_start", "event_date_end")


def reduced_batch(batch: DataFrame) -> DataFrame:
    """One row per source_url: the last row in order of seq, with the last description that isn't null."""
    last = F.max_by(F.struct("source", *CONTENT), "seq")
    said = F.expr("max_by(raw_description, seq) FILTER (WHERE raw_description IS NOT NULL)")
    return batch.groupBy("source_url").agg(last.alias("r"), said.alias("raw_description")).select("source_url", "r.*", "raw_description")


def upsert_listings(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Current rows with the batch applied, and `inserted` for new ones. An end date may become null, a description may not."""
    new = reduced_batch(batch).select("source_url", *[F.col(c).alias(f"n_{c}") for c in ("source", *CONTENT, "raw_description")], F.lit(True).alias("changed"))
    both = current.withColumn("known", F.lit(True)).join(new, "source_url", "full_outer")
    changed, known = F.coalesce("changed", F.lit(False)), F.coalesce("known", F.lit(False))
    fresh = {
        "id": F.coalesce("id", F.sha2("source_url", 256)),
        "source": F.coalesce("source", "n_source"),
        "raw_description": F.coalesce("n_raw_description", "raw_description"),
        "scraped_at": F.when(known, F.col("scraped_at")).otherwise(now),
        "created_at": F.when(known, F.col("created_at")).otherwise(now),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    } | {c: F.when(changed, F.col(f"n_{c}")).otherwise(F.col(c)) for c in CONTENT}
    flags = {c: F.when(known, F.col(c)).otherwise(F.lit(False)) for c in ("is_published", "is_heads_up", "is_duplicate", "is_manually_added") if c in current.columns}
    return both.select(*[(fresh | flags).get(c, F.col(c)).alias(c) for c in current.columns], (~known).alias("inserted"))


def insert_strict(current: DataFrame, rows: DataFrame, key: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is new, and the rejected others; of rows with one new key the first in order of seq is taken."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("seq")) == 1
    marked = rows.withColumn("first", first).join(current.select(F.col(key), F.lit(True).alias("known")).distinct(), key, "left")
    taken = F.col("first") & F.col("known").isNull()
    return marked.where(taken).drop("first", "known"), marked.where(~taken).drop("first", "known")


UNIQUE = ("email", "id", "unsubscribe_token")


def subscribe(current: DataFrame, rows: DataFrame, order: str | None = "id") -> DataFrame:
    """Each request with already_exists; a request is taken if its email, id and token are new, here and among the taken ones before it. order: what requests come in order of."""
    return taken(rows, current, [k for k in UNIQUE if k in rows.columns], order).withColumn("already_exists", ~F.col("taken")).drop("taken")


def subscribers_after(current: DataFrame, rows: DataFrame, order: str | None = "id") -> DataFrame:
    """The table with the requests that are taken."""
    return current.unionByName(subscribe(current, rows, order).where("not already_exists").drop("already_exists"), allowMissingColumns=True)


def mark_duplicates(current: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """pairs: duplicate_id, canonical_id and seq; the last pair of an id counts."""
    last = pairs.groupBy(F.col("duplicate_id").alias("id")).agg(F.max_by("canonical_id", "seq").alias("to"))
    both = current.join(last, "id", "left")
    hit = F.col("to").isNotNull()
    return both.select(*[{"is_duplicate": F.col("is_duplicate") | hit, "duplicate_of": F.coalesce("to", "duplicate_of"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}.get(c, F.col(c)).alias(c) for c in current.columns])


def patch_columns(current: DataFrame, changes: DataFrame, columns: tuple[str, ...], now: Column | None = None) -> DataFrame:
    """Columns of the rows that changes names by id get the values given there, null too."""
    new = changes.select("id", *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("hit"))
    both = current.join(new, "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    out = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in columns}
    if now is not None:
        out["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in current.columns])


SCORED = ("included", "filter_reason", "blurb", "tags", "score", "is_heads_up", "is_published")


def apply_scores(current: DataFrame, scores: DataFrame, now: Column) -> DataFrame:
    return patch_columns(current, scores, SCORED, now)


def store_enriched(current: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """found: id and enriched_description."""
    return patch_columns(current, found, ("enriched_description",), now)


def rescored_blurbs(current: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """New blurbs, from verdicts (id, blurb) on the raw texts, for listings that are published and included; nothing else changes."""
    live = current.where(F.col("is_published") & F.coalesce("included", F.lit(False))).select("id")
    return patch_columns(current, verdicts.join(live, "id", "left_semi"), ("blurb",), now)


def patch_by_map(current: DataFrame, patches: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """patches: id and a map of column names to values as text; unknown names are ignored, a null value is a value."""
    both = current.join(patches.select("id", "patch"), "id", "left")
    given = lambda c: F.coalesce(F.map_contains_key("patch", F.lit(c)), F.lit(False))
    value = lambda c: F.try_element_at("patch", F.lit(c)).try_cast(current.schema[c].dataType)
    return both.select(*[(F.when(given(c), value(c)).otherwise(F.col(c)) if c in allowed else F.col(c)).alias(c) for c in current.columns])


def unsubscribe(current: DataFrame, tokens: DataFrame) -> DataFrame:
    """Subscribers with is_active, and changed for those that a token has just ended."""
    hit = tokens.select(F.col("token").alias("unsubscribe_token"), F.lit(True).alias("hit")).distinct()
    both = current.join(hit, "unsubscribe_token", "left")
    ends = F.coalesce("hit", F.lit(False)) & F.col("is_active")
    return both.select(*[(F.col("is_active") & ~ends if c == "is_active" else F.col(c)).alias(c) for c in current.columns], ends.alias("changed"))


def _changed(current: DataFrame, hit: Column, new: dict[str, Column], now: Column) -> DataFrame:
    """Rows that are hit get the new values and the time."""
    hit = F.coalesce(hit, F.lit(False))
    new = {c: v for c, v in (new | {"updated_at": now}).items() if c in current.columns}
    return current.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def _ahead(today: Column) -> Column:
    return (F.col("event_date_start") >= today) & ~F.col("is_duplicate")


def reset_excluded(current: DataFrame, today: Column, now: Column) -> DataFrame:
    """What was excluded, is no duplicate and still lies ahead is unprocessed again."""
    return _changed(current, ~F.col("included") & _ahead(today), {"included": F.lit(None), "filter_reason": F.lit(None)}, now)


def reset_sources(current: DataFrame, sources: tuple[str, ...], today: Column, now: Column) -> DataFrame:
    """The results of scoring of these sources' processed listings that lie ahead and are no duplicates go; the heads-up mark stays."""
    again = F.col("source").isin(*sources) & F.col("included").isNotNull() & _ahead(today)
    gone = ("included", "filter_reason", "enriched_description", "blurb", "tags", "score")
    return _changed(current, again, {c: F.lit(None) for c in gone} | {"is_published": F.lit(False)}, now)


def republish(current: DataFrame, today: Column, now: Column, least: int = 6) -> DataFrame:
    """Included listings of a score of `least` that lie ahead, aren't published and are no duplicates are published."""
    up = F.col("included") & (F.col("score") >= least) & ~F.col("is_published") & _ahead(today)
    return _changed(current, up, {"is_published": F.lit(True)}, now)


def finish_runs(runs: DataFrame, logs: DataFrame, now: Column | None = None) -> DataFrame:
    """Runs with total_sent and total_failed from their delivery logs; now: the time at which they are completed."""
    totals = logs.groupBy(F.col("digest_run_id").alias("id")).agg(F.count_if(F.col("status") == "sent").alias("total_sent"), F.count_if(F.col("status") == "failed").alias("total_failed"))
    joined = runs.join(totals, "id", "left")
    out = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_sent", "total_failed")})
    return out if now is None else out.withColumn("completed_at", now)
