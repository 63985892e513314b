"""Scoring listings: what to score, on which text, by a scorer that gives raw text, and how its verdicts are read."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import enrich_description, extract_json, truncate_blurb

# The vocabulary of tags.
TAGS = ("live & loud", "culture fix", "go see", "game on", "screen time", "taste test", "touch grass", "free lah", "last call", "bring someone", "once only", "try lah")
FILTER = "include boolean, reason string"
ENRICHMENT = "struct<blurb:string,tags:array<string>,heads_up:boolean,score:int>"
# Fixed value: the reason that is stored for a verdict that can't be read.
FAILED = "LLM response parse error"


def pending(listings: DataFrame, limit: int | None = None) -> DataFrame:
    rows = listings.where(F.col("included").isNull() & ~F.col("is_duplicate"))
    return rows if limit is None else rows.orderBy("event_date_start", "id").limit(limit)


def remaining(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count_if(F.col("included").isNull() & ~F.col("is_duplicate")).alias("remaining"))


def effective_descriptions(listings: DataFrame, pages: DataFrame, least: int = 100) -> DataFrame:
    """id and description: the enriched or raw one, or, where that is thin, what the landed page gives."""
    said = F.coalesce("enriched_description", "raw_description")
    thin = listings.withColumn("said", said).withColumn("thin", said.isNull() | (F.length(said) < least))
    found = pages.select(F.col("url").alias("source_url"), enrich_description(F.col("html"), F.col("url")).alias("found"))
    joined = thin.where("thin").join(found, "source_url", "left").select("id", F.coalesce("found", "said").alias("description"))
    return joined.union(thin.where("not thin").select("id", F.col("said").alias("description")))


def truthy(v: Column) -> Column:
    """A variant as a condition: false for false, 0, the empty string, null and what is missing, true for anything else."""
    kind = F.schema_of_variant(v)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    return F.when(kind.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(number.isNotNull(), number != 0).otherwise(True)


def filter_verdict(raw: Column) -> Column:
    """struct<include, reason> of a scorer's text; what can't be read is excluded with a reason."""
    v = F.try_parse_json(extract_json(raw))
    read = F.struct(truthy(F.try_variant_get(v, "$.include", "variant")).alias("include"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"))
    return F.when(v.isNull(), F.struct(F.lit(False).alias("include"), F.lit(FAILED).alias("reason"))).otherwise(read)


def enrichment_verdict(raw: Column, title: Column, vocabulary: tuple[str, ...] = TAGS) -> Column:
    """struct<blurb, tags, heads_up, score>; without a blurb or tags, or where nothing can be read, the title and middling values."""
    v = F.try_parse_json(extract_json(raw))
    tags = F.try_variant_get(v, "$.tags", "array<string>")
    blurb = F.try_variant_get(v, "$.blurb", "string")
    score = F.try_variant_get(v, "$.score", "variant")
    kind, number, text = F.schema_of_variant(score), F.try_variant_get(score, "$", "double"), F.try_variant_get(score, "$", "string")
    value = F.when(kind.isNull(), 5.0).when(kind == "VOID", 1.0).when((kind == "STRING") & (F.trim(text) == ""), 1.0).otherwise(F.coalesce(number, F.lit(5.0)))
    clamped = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(value + 0.5))).cast("int")
    known = F.slice(F.filter(tags, lambda t: t.isin(*vocabulary)), 1, 3)
    good = F.struct(truncate_blurb(blurb).alias("blurb"), known.alias("tags"), truthy(F.try_variant_get(v, "$.heads_up", "variant")).alias("heads_up"), clamped.alias("score"))
    short = F.when(F.length(title) > 200, F.concat(F.left(title, F.lit(197)), F.lit("..."))).otherwise(title)
    fallback = F.struct(short.alias("blurb"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("heads_up"), F.lit(5).alias("score"))
    return F.when(tags.isNull() | blurb.isNull(), fallback).otherwise(good)


def scored_by(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str, parallel: int | None = None, batch: int = 20, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """rows with the scorer's raw text as a column; `parallel` bounds how many scorers run at once.

    The scorer gets `batch` rows at a time. If it fails it is asked again, after `pause` seconds, `attempts` times in
    all; then the rows of that batch alone have no text, which decided() leaves for another run.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` string"

    def asked(some: pd.DataFrame) -> list:
        for k in range(attempts):
            try:
                return list(scorer(some))
            except Exception:
                time.sleep(pause if k + 1 < attempts else 0)
        return [None] * len(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [t for k in range(0, len(pdf), batch) for t in asked(pdf.iloc[k : k + batch])]
            yield pdf.assign(**{name: pd.Series(said, index=pdf.index, dtype=object)})

    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, schema)


def observed(scored: DataFrame) -> tuple[DataFrame, Observation]:
    """scored (with filter_raw) with an observation of how many rows were processed, included, excluded and got no answer, which the write of them fills: no second scan."""
    seen = Observation("scoring")
    answer, include = F.col("filter_raw").isNotNull(), filter_verdict(F.col("filter_raw"))["include"]
    return scored.observe(seen, F.count_if(answer).alias("processed"), F.count_if(answer & include).alias("included"), F.count_if(answer & ~include).alias("excluded"), F.count_if(~answer).alias("errors")), seen


def rule_filter(text: Column, wanted: str, unwanted: str) -> Column:
    """A scorer's text by keywords, for runs without a model."""
    include = text.rlike(wanted) & ~text.rlike(unwanted)
    return F.to_json(F.struct(include.alias("include"), F.when(include, "matches").otherwise("no match").alias("reason")))


def rule_enrichment(text: Column, title: Column, tag_rules: dict[str, str], telling: str) -> Column:
    tags = F.filter(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in tag_rules.items()]), lambda t: t.isNotNull())
    score = F.least(F.lit(10), 1 + F.size(F.regexp_extract_all(text, F.lit(telling), F.lit(0))))
    return F.to_json(F.struct(title.alias("blurb"), tags.alias("tags"), (score >= 9).alias("heads_up"), score.alias("score")))


def decided(rows: DataFrame, publish_from: int = 7) -> DataFrame:
    """id and the scored columns, from the columns filter_raw and enrich_raw: excluded rows get nothing, included ones are published by score.

    A row for which the scorer gave nothing at all (null) isn't decided, and stays for another run.
    """
    f, e = filter_verdict(F.col("filter_raw")), enrichment_verdict(F.col("enrich_raw"), F.col("raw_title"))
    both = rows.where("filter_raw is not null").withColumn("f", f).withColumn("e", e)
    inc = F.col("f.include")
    return both.select(
        "id", inc.alias("included"), F.col("f.reason").alias("filter_reason"), F.when(inc, F.col("e.blurb")).alias("blurb"), F.when(inc, F.col("e.tags")).alias("tags"), F.when(inc, F.col("e.score")).alias("score"),
        (inc & F.col("e.heads_up")).alias("is_heads_up"), (inc & (F.col("e.score") >= publish_from)).alias("is_published"),
    )


def counters(scored: DataFrame, listings: DataFrame, duplicates: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """One row: processed, included, excluded, errors, remaining and deduplicated. tried: the rows that were given to the scorer; those it didn't decide are errors."""
    tried = scored if tried is None else tried
    both = tried.select("id").join(scored.select("id", "included"), "id", "left")
    done = both.agg(F.count("included").alias("processed"), F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"), F.count_if(F.col("included").isNull()).alias("errors"))
    left = listings.join(tried.select("id"), "id", "left_anti").join(duplicates.select(F.col("duplicate_id").alias("id")), "id", "left_anti")
    return done.crossJoin(F.broadcast(remaining(left))).crossJoin(F.broadcast(duplicates.agg(F.count_distinct("duplicate_id").alias("deduplicated"))))  # one row each


def intro_input(classified: DataFrame, most: dict[str, int]) -> DataFrame:
    """category and the bullet lines of its first rows."""
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    rows = classified.where(F.col("position") <= F.try_element_at(limit, F.col("category")))
    line = F.concat(F.lit("- "), "raw_title", F.lit(" @ "), "venue")
    return rows.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


def intro_verdict(raw: Column, default_subject: Column) -> Column:
    """struct<intro, subject>: the subject cut to 50 characters; no intro and the default subject where nothing can be read."""
    v = F.try_parse_json(extract_json(raw))
    intro, subject = (F.try_variant_get(v, f"$.{k}", "string") for k in ("intro", "subject"))
    ok = intro.isNotNull() & subject.isNotNull()
    return F.struct(F.when(ok, intro).alias("intro"), F.when(ok, F.left(subject, F.lit(50))).otherwise(default_subject).alias("subject"))
