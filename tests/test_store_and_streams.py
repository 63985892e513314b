import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.operators import digest, scoring, store, telemetry
from larkspur.sources import tables
from larkspur.streaming import streams
from larkspur.streaming.buckets import Buckets

NOW = dt.datetime(2026, 2, 1)
RAW = "source string, source_url string, raw_title string, raw_description string, venue string, event_date_start date, event_date_end date, seq long"


def raw(url, title, said, seq, end=None):
    return ("s", url, title, said, "v", dt.date(2026, 3, 1), end, seq)


def empty(spark):
    return spark.createDataFrame([], tables.DDL["listings"])


def test_upsert_order_and_nulls(spark):
    first = store.upsert_listings(empty(spark), spark.createDataFrame([raw("a", "A", "said", 1, dt.date(2026, 3, 4)), raw("a", "A2", None, 2), raw("b", "B", None, 3)], RAW), F.lit(NOW))
    rows = {r["source_url"]: r for r in first.collect()}
    assert rows["a"]["raw_title"] == "A2" and rows["a"]["raw_description"] == "said" and rows["a"]["event_date_end"] is None and rows["a"]["inserted"] and rows["a"]["included"] is None
    again = store.upsert_listings(first.drop("inserted"), spark.createDataFrame([raw("b", "B2", "new", 1)], RAW), F.lit(NOW + dt.timedelta(1)))
    rows = {r["source_url"]: r for r in again.collect()}
    assert rows["b"]["raw_description"] == "new" and rows["b"]["created_at"] == NOW and rows["b"]["updated_at"] > NOW and not rows["b"]["inserted"] and rows["a"]["updated_at"] == NOW


def test_marking_and_scores(spark):
    current = store.upsert_listings(empty(spark), spark.createDataFrame([raw(u, u, "x", 1) for u in "abc"], RAW), F.lit(NOW)).drop("inserted")
    ids = {r["source_url"]: r["id"] for r in current.collect()}
    pairs = spark.createDataFrame([(ids["a"], ids["b"], 0), (ids["a"], ids["c"], 1)], "duplicate_id string, canonical_id string, seq int")
    marked = {r["source_url"]: r for r in store.mark_duplicates(current, pairs, F.lit(NOW)).collect()}
    assert marked["a"]["duplicate_of"] == ids["c"] and marked["a"]["is_duplicate"] and not marked["b"]["is_duplicate"]
    raws = current.select("id", "raw_title", F.lit('{"include": true, "reason": "r"}').alias("filter_raw"), F.lit('{"blurb": "b", "tags": ["go see"], "score": 8, "heads_up": true}').alias("enrich_raw"))
    scored = {r["source_url"]: r for r in store.apply_scores(current, scoring.decided(raws).where(F.col("id") != ids["c"]), F.lit(NOW)).collect()}
    assert scored["a"]["is_published"] and scored["a"]["is_heads_up"] and scored["a"]["tags"] == ["go see"] and scored["c"]["included"] is None


def test_scorer_hook_and_counters(spark):
    rows = spark.createDataFrame([("1", "jazz"), ("2", "sale")], "id string, raw_title string")
    raws = scoring.scored_by(rows, lambda pdf: pdf["raw_title"].map(lambda t: '{"include": %s, "reason": ""}' % str(t == "jazz").lower()), "filter_raw", parallel=2)
    scored = scoring.decided(raws.withColumn("enrich_raw", F.lit("{broken")))
    assert {(r["id"], r["included"], r["score"]) for r in scored.collect()} == {("1", True, 5), ("2", False, None)}
    live = spark.createDataFrame([("1", None, False), ("2", None, False), ("3", None, False), ("4", None, False)], "id string, included boolean, is_duplicate boolean")
    dup = spark.createDataFrame([("3",)], "duplicate_id string")
    counts = scoring.counters(scored, live, dup)
    assert counts.first().asDict() == {"processed": 2, "included": 1, "excluded": 1, "errors": 0, "remaining": 1, "deduplicated": 1}
    cycle = spark.createDataFrame([("a", 3, None, "ok"), ("b", 0, None, "zero")], "source string, events_found int, error string, status string")
    report = telemetry.pipeline_report(cycle, counts).first()
    assert report["has_issues"] and report["summary"] == "3 found, 1 included, 1 excluded, 1 deduplicated, 0 errors"
    assert report["body"].split("\n\n")[1:3] == ["ISSUES\nSources with nothing found:\n  - b", "SOURCES\n  a: 3 events\n  b: 0 events"] and not report["scoring_issues"]
    bad = spark.createDataFrame([("a", 0, "HTTP 500", "error"), ("c", 2, None, "ok")], "source string, events_found int, error string, status string")
    report = telemetry.pipeline_report(bad, counts.withColumn("errors", F.lit(4)), "out of time").first()
    assert report["scoring_issues"] and "Sources that failed:\n  - a: HTTP 500\nScoring failed for 4 listings\nScoring ended early: out of time" in report["body"] and "  a: FAILED\n  c: 2 events" in report["body"]
    alone = telemetry.pipeline_report(bad.where("source = 'c'")).first()
    assert (alone["has_issues"], alone["subject"], alone["summary"], alone["body"]) == (False, "Sources: alert", None, "SOURCES\n  c: 2 events")


def test_report_with_both_heads(spark):
    schema = "source string, events_found int, error string, status string"
    rows = {"zero": ("a", 0, None, "zero"), "error": ("b", 0, "HTTP 500", "error"), "ok": ("c", 2, None, "ok")}
    said = {}
    for kinds in ("error", "zero", "ok", "zero error"):
        cycle = spark.createDataFrame([rows[k] for k in kinds.split()], schema)
        said[kinds] = [telemetry.pipeline_report(cycle, both_heads=b).first()["body"].partition("SOURCES")[0] for b in (False, True)]
    assert said["error"] == ["ISSUES\nSources that failed:\n  - b: HTTP 500\n\n", "ISSUES\nSources with nothing found:\n\nSources that failed:\n  - b: HTTP 500\n\n"]
    assert said["zero"] == ["ISSUES\nSources with nothing found:\n  - a\n\n", "ISSUES\nSources with nothing found:\n  - a\nSources that failed:\n\n\n"]
    assert said["ok"] == ["", ""] and said["zero error"][0] == said["zero error"][1]


def test_scorer_is_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), "bad" if k == 7 else "good") for k in range(10)], "id string, raw_title string").coalesce(1)
    marks = str(tmp_path)

    def flaky(pdf):
        # the first call for each batch fails, and the batch with the bad row always
        import os

        mark = f"{marks}/{pdf['id'].iloc[0]}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError
        if (pdf["raw_title"] == "bad").any():
            raise ValueError
        return ['{"include": true, "reason": ""}'] * len(pdf)

    scored, seen = scoring.observed(scoring.scored_by(rows, flaky, "filter_raw", batch=3))
    got = {r["id"] for r in scored.collect() if r["filter_raw"] is None}
    assert got == {"6", "7", "8"} and seen.get == {"processed": 7, "included": 7, "excluded": 0, "errors": 3}


def test_resets_spare_duplicates(spark):
    today, now = F.lit("2026-02-01").cast("date"), F.lit(NOW)
    day, old = dt.date(2026, 3, 1), NOW - dt.timedelta(9)
    schema = "id string, source string, event_date_start date, included boolean, filter_reason string, score int, blurb string, is_published boolean, is_heads_up boolean, is_duplicate boolean, updated_at timestamp"
    rows = [("1", "a", day, False, "no", None, None, False, False, False, old), ("2", "a", day, False, "no", None, None, False, False, True, old), ("3", "a", day, True, "y", 6, "b", False, True, False, old), ("4", "a", day, True, "y", 6, "b", False, True, True, old), ("5", "b", day, None, None, None, "kept", False, False, False, old)]
    current = spark.createDataFrame(rows, schema)
    reset = {r["id"]: r for r in store.reset_excluded(current, today, now).collect()}
    assert (reset["1"]["included"], reset["1"]["filter_reason"], reset["1"]["updated_at"]) == (None, None, NOW) and reset["2"]["included"] is False and reset["2"]["updated_at"] == old
    gone = {r["id"]: r for r in store.reset_sources(current, ("a", "b"), today, now).collect()}
    assert gone["3"]["included"] is None and gone["3"]["blurb"] is None and gone["3"]["is_heads_up"] and gone["4"]["blurb"] == "b" and gone["5"]["blurb"] == "kept" and gone["5"]["updated_at"] == old
    up = {r["id"]: r["is_published"] for r in store.republish(current, today, now).collect()}
    assert up == {"1": False, "2": False, "3": True, "4": False, "5": False}


def test_long_chains_and_verdicts(spark):
    from larkspur.operators import dedup

    pairs = spark.createDataFrame([(f"r{k:03d}", f"r{k + 1:03d}", 0) for k in range(300)], "duplicate_id string, canonical_id string, seq int")
    assert {r["canonical_id"] for r in dedup.resolved(pairs).collect()} == {"r300"}
    long = "T" * 199 + ". " + "t" * 50
    texts = spark.createDataFrame([('{"blurb": "b", "tags": [], "heads_up": true}', long), ("{broken", long)], "raw string, title string")
    got = [r[0] for r in texts.select(scoring.enrichment_verdict(F.col("raw"), F.col("title"))).collect()]
    assert got[0]["heads_up"] and got[1]["blurb"] == long[:197] + "..."


def test_effective_descriptions(spark):
    long = "d" * 120
    rows = spark.createDataFrame([("1", "u1", "thin", None), ("2", "u2", long, None), ("3", "u3", None, None)], "id string, source_url string, raw_description string, enriched_description string")
    pages = spark.createDataFrame([("u1", f"<p>{'word ' * 20}</p>")], "url string, html string")
    assert {r["id"]: r["description"] for r in scoring.effective_descriptions(rows, pages).collect()} == {"1": ("word " * 20).strip(), "2": long, "3": None}


def test_digest_promotion_and_intro(spark):
    rows = spark.createDataFrame([(str(k), f"t{k}", "v", k, dt.date(2026, 2, 1), dt.date(2026, 2, 20)) for k in range(1, 6)], "id string, raw_title string, venue string, score int, event_date_start date, event_date_end date")
    seen = spark.createDataFrame([(str(k), "new") for k in range(1, 5)], "event_id string, category string")
    parts = digest.classified(rows, seen, F.lit("2026-02-04").cast("date"))
    got = {(r["category"], r["position"]): r["id"] for r in parts.collect()}
    assert got == {("new", 1): "5", ("new", 2): "4", ("new", 3): "3", ("ongoing", 1): "1", ("ongoing", 2): "2"}
    lines = {r["category"]: r["lines"] for r in scoring.intro_input(parts, {"new": 2, "ongoing": 5}).collect()}
    assert lines == {"new": "- t5 @ v\n- t4 @ v", "ongoing": "- t1 @ v\n- t2 @ v"}
    texts = spark.createDataFrame([('{"intro": "i", "subject": "' + "s" * 60 + '"}',), ('{"intro": "i"}',)], "t string")
    got = [tuple(r[0]) for r in texts.select(scoring.intro_verdict(F.col("t"), F.lit("default"))).collect()]
    assert got == [("i", "s" * 50), (None, "default")]


def test_stream_equals_batch(spark, tmp_path):
    schema = spark.createDataFrame([], RAW).schema
    batches = [[raw("a", "A", "x", 1), raw("b", "B", None, 2)], [raw("a", "A2", None, 3), raw("c", "C", "y", 4)], []]
    want = empty(spark)
    table = Buckets(spark, str(tmp_path / "out"), empty(spark).schema, "source_url").create(8)
    time = lambda n: F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(n))
    files = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "ckpt"), time).awaitTermination()
        want = store.upsert_listings(want, spark.createDataFrame(rows, RAW), time(k)).drop("inserted")
        assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
        files[k] = {str(f) for f in (tmp_path / "out" / "data").rglob("*.parquet")}
    assert want.count() == 3 and files[0] < files[1] and files[2] == files[1]
    # the second batch has two addresses, and so two buckets of eight at most; none of the first one's files were touched
    assert len({f.split("bucket=")[1].split("/")[0] for f in files[1] - files[0]}) <= 2
    # a batch that comes again is no work, and what was replaced can be swept
    assert not table.change(1, spark.createDataFrame(batches[0], RAW), lambda *_: 1 / 0)
    before = sorted(map(str, table.read().collect()))
    assert table.sweep() >= 1 and sorted(map(str, table.read().collect())) == before and table.size() == 8
    assert len({str(f) for f in (tmp_path / "out" / "data").rglob("*.parquet")}) < len(files[2])


def test_a_batch_that_failed_is_written_anew(spark, tmp_path):
    table = Buckets(spark, str(tmp_path), empty(spark).schema, "source_url").create(4)
    rows = spark.createDataFrame([raw(u, u, "x", 1) for u in "abcdefgh"], RAW)
    up = lambda current, batch: store.upsert_listings(current, batch, F.lit(NOW)).drop("inserted")
    table.change(0, rows, up)
    commit, table._commit = table._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.change(1, rows.withColumn("raw_title", F.lit("half done")), up)
    assert {r["raw_title"] for r in table.read().collect()} == set("abcdefgh")
    table._commit = commit
    assert table.change(1, rows.where("source_url < 'c'").withColumn("raw_title", F.lit("new")), up)
    assert sorted(r["raw_title"] for r in table.read().collect()) == [*"cdefgh", "new", "new"]
    assert Buckets(spark, str(tmp_path), empty(spark).schema, "source_url").create(99).size() == 4


def test_stream_health(spark, tmp_path):
    ddl = tables.DDL["scraper_runs"]
    runs = [(str(k), f"src{k % 2}", k, "bad" if k == 3 else None, NOW + dt.timedelta(minutes=4 * k)) for k in range(8)]
    spark.createDataFrame(runs, ddl).coalesce(1).write.parquet(str(tmp_path / "runs"))

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    source = lambda: spark.readStream.schema(ddl).parquet(str(tmp_path / "runs"))
    status = {r["source"]: r["status"] for r in drained(streams.latest_status(source()), "update", "status")}
    assert status == {"src0": "OK", "src1": "OK"}
    windows = drained(streams.health_windows(source()), "update", "windows")
    assert sum(r["runs"] for r in windows) == 8 and sum(r["errors"] for r in windows) == 1
    seen = spark.createDataFrame([("u1", NOW), ("u1", NOW), ("u2", NOW)], "source_url string, fetched_at timestamp")
    seen.coalesce(1).write.parquet(str(tmp_path / "seen"))
    first = drained(streams.first_seen(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "seen"))), "append", "seen")
    assert sorted(r["source_url"] for r in first) == ["u1", "u2"]
