"""Health of sources, of the pipeline and of deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_runs(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return runs.where(F.col("ran_at") >= now - F.make_dt_interval(F.lit(days))).orderBy(F.desc("ran_at"), "id")


def latest_per_source(runs: DataFrame) -> DataFrame:
    """The last run of each source, found without a sort of all its runs."""
    last = runs.groupBy("source").agg(F.max(F.struct("ran_at", "id", "events_found", "error")).alias("r"))
    return last.select("source", "r.*")


def cycle_stats(runs: DataFrame, minutes: int = 10) -> DataFrame:
    """Sources of the latest cycle with their count and status: error, zero or ok."""
    newest = runs.agg(F.max("ran_at").alias("newest"))
    cycle = runs.join(F.broadcast(newest), F.col("ran_at") >= F.col("newest") - F.make_dt_interval(mins=F.lit(minutes))).drop("newest")  # one row
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("events_found") == 0, "zero").otherwise("ok")
    return latest_per_source(cycle).select("source", "events_found", "error", status.alias("status"))


def source_status(runs: DataFrame, sources: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Each known source: No data, Error, 0 events or OK, from its last run in some days."""
    last = latest_per_source(runs.where(F.col("ran_at") >= now - F.make_dt_interval(F.lit(days))))
    status = F.when(F.col("ran_at").isNull(), "No data").when(F.col("error").isNotNull(), "Error").when(F.col("events_found") == 0, "0 events").otherwise("OK")
    return sources.join(last, "source", "left").select("source", status.alias("status"))


def zero_sources(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Known sources of the latest cycle with nothing found and no error."""
    joined = sources.join(cycle_stats(runs), "source", "left")
    return joined.where(F.col("error").isNull() & (F.coalesce("events_found", F.lit(0)) == 0)).select("source")


def pipeline_report(cycle: DataFrame, counters: DataFrame | None = None, crash: str | None = None, both_heads: bool = False) -> DataFrame:
    """One row about a cycle of sources and, with counters, a run of scoring: issue flags, the total found, a subject, a summary and the whole text.

    The text has the issues, if there are any, then each source with its count or failure, then what scoring came to.
    crash: what ended scoring before its time. both_heads: with issues, sources with nothing found and sources that
    failed are both headed, even where there are none of one kind.
    """
    said = lambda c: F.col(c).cast("string")
    lines = lambda cond, line: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("source", line.alias("l"))))), lambda x: x["l"])
    zero, failed = F.col("status") == "zero", F.col("status") == "error"
    c = cycle.agg(  # a row for each known source
        F.coalesce(F.sum("events_found"), F.lit(0)).alias("total"), F.count_if(failed).alias("failed_sources"), F.count_if(zero).alias("zero_sources"),
        lines(zero, F.concat(F.lit("  - "), "source")).alias("zeros"), lines(failed, F.concat(F.lit("  - "), "source", F.lit(": "), "error")).alias("failures"),
        lines(F.lit(True), F.concat(F.lit("  "), "source", F.when(failed & (F.col("events_found") == 0), ": FAILED").otherwise(F.concat(F.lit(": "), said("events_found"), F.lit(" events"))))).alias("every"),
    )
    names = ("processed", "included", "excluded", "deduplicated", "errors")
    if counters is None:
        both = c.withColumns({n: F.lit(0) for n in names})
    else:
        have = [F.coalesce(F.col(n), F.lit(0)).alias(n) if n in counters.columns else F.lit(0).alias(n) for n in names]
        both = c.crossJoin(F.broadcast(counters.select(*have)))  # one row each
    source_issues = (F.col("failed_sources") > 0) | (F.col("zero_sources") > 0)
    scoring_issues = (F.col("errors") > 0) | F.lit(crash is not None)
    issues = source_issues | scoring_issues
    subject = F.lit("Sources: alert") if counters is None else F.when(issues, "Pipeline: issues found").otherwise("Pipeline: all well")
    words = {"total": "found", "included": "included", "excluded": "excluded", "deduplicated": "deduplicated", "errors": "errors"}
    summary = F.lit(None).cast("string") if counters is None else F.concat_ws(", ", *[F.concat(said(k), F.lit(f" {w}")) for k, w in words.items()])
    under = lambda head, xs: F.when(F.lit(both_heads) | (F.size(xs) > 0), F.concat(F.lit(head + "\n"), F.array_join(xs, "\n")))
    trouble = F.concat_ws("\n", F.lit("ISSUES"), under("Sources with nothing found:", "zeros"), under("Sources that failed:", "failures"), F.when(F.col("errors") > 0, F.concat(F.lit("Scoring failed for "), said("errors"), F.lit(" listings"))), F.lit(None if crash is None else f"Scoring ended early: {crash or 'unknown error'}").cast("string"))
    scoring = None if counters is None else F.concat_ws("\n", F.lit("SCORING"), *[F.concat(F.lit(f"  {n.capitalize()}: "), said(n)) for n in names])
    body = F.concat_ws("\n\n", *([] if counters is None else [F.concat(F.lit("SUMMARY: "), summary)]), F.when(issues, trouble), F.concat(F.lit("SOURCES\n"), F.array_join("every", "\n")), *([] if scoring is None else [scoring]))
    return both.select("total", "failed_sources", "zero_sources", issues.alias("has_issues"), scoring_issues.alias("scoring_issues"), subject.alias("subject"), summary.alias("summary"), body.alias("body"))


def run_status(runs: DataFrame) -> DataFrame:
    """id and status of each digest run."""
    s = F.when(F.col("skipped").isNotNull(), "Skipped").when((F.col("total_failed") > 0) & (F.col("total_sent") > 0), "Partial").when(F.col("total_failed") > 0, "Failed").when(F.col("completed_at").isNull(), "Running").otherwise("OK")
    return runs.select("id", s.alias("status"))


def recent_digests(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("ran_at"), F.desc("id")).limit(limit)


def run_detail(runs: DataFrame, logs: DataFrame, run_id: str) -> DataFrame:
    """A run with its deliveries in order of sending."""
    own = logs.select("digest_run_id", F.col("id").alias("log_id"), "status", "error", "sent_at")
    return runs.where(F.col("id") == run_id).withColumnRenamed("id", "digest_run_id").join(own, "digest_run_id", "left").select("digest_run_id", "ran_at", "log_id", "status", "error", "sent_at").orderBy("sent_at", "log_id")


def subscriber_counts(subscribers: DataFrame) -> DataFrame:
    return subscribers.agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"), F.count("*").alias("total"))


def run_rows(found: DataFrame, errors: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each known source of a job: how many it found, and its error if it had one."""
    counts = found.groupBy("source").agg(F.count("*").alias("events_found"))
    first = errors.groupBy("source").agg(F.min("error").alias("error"))
    return sources.join(counts, "source", "left").join(first, "source", "left").select("source", F.coalesce("events_found", F.lit(0)).alias("events_found"), "error")
