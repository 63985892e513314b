import datetime as dt
import random

from pyspark.sql import functions as F

from larkspur.operators import feeds, search

SCHEMA = "id string, raw_title string, enriched_description string, raw_description string, venue string, tags array<string>, is_published boolean, included boolean, is_duplicate boolean, event_date_start date"


def test_grams_of_patterns():
    assert search.pattern_grams("Jazz") == ["azz", "jaz"] and search.pattern_grams("a%bc_d") == [] and search.pattern_grams("open%air_x") == ["air", "ope", "pen"]


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aBcé ") for _ in range(rng.randint(0, 9)))
    rows = [(str(k), word(), rng.choice([None, word()]), word() * rng.randint(0, 9), word(), rng.choice([None, [], ["abc", "b a"]]), True, True, False, dt.date(2026, 1, 1 + k % 28)) for k in range(300)]
    listings = spark.createDataFrame(rows, SCHEMA)
    search.write_index(listings.where("id < '5'"), str(tmp_path / "index"))
    search.write_index(listings.where("id >= '5'"), str(tmp_path / "index"))
    today = F.lit("2026-01-01").cast("date")
    for words in ("abc", "ABCÉ", "c%bac", "a_ca", "abc,b", "zzz", "é", "a\\\\b", "cab%ab_"):
        found = search.indexed_search(listings, str(tmp_path / "index"), words, today, 50)
        assert [r["id"] for r in found.collect()] == [r["id"] for r in feeds.keyword_search(listings, words, today, 50).collect()], words
    plan = search.indexed_search(listings, str(tmp_path / "index"), "abc", today)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "PartitionFilters: [bucket#" in plan


def test_parts_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in feeds.result_parts(none, "event", F.col("raw_title")).collect()] == [("Found 0 events", 0, "")]
    assert feeds.day_parts(none, F.lit("2026-01-01").cast("date")).collect() == []


def test_an_index_has_a_row_for_each_gram_of_a_block(spark, tmp_path):
    """Not for each gram of a listing, of which most share theirs; and grams are characters, whatever they are."""
    rows = [(str(k), f"A\0b\U0001f600c {k % 7}", None, "the same words " * 9 + "日本語" * (k % 2), "ab", ["c", None, "dé"], True, True, False, dt.date(2026, 1, 1)) for k in range(500)] + [(None, "", None, None, None, None, True, True, False, None)]
    listings = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    path = str(tmp_path / "index")
    search.write_index(listings, path)
    index = spark.read.schema(search.SCHEMA).parquet(path)
    assert index.count() < 500
    for words in ("a\0b", "b\U0001f600C", "本語日", "語 ", "abc", "C,DÉ", "same%日本", " 3"):
        found = search.indexed_search(listings, path, words, F.lit("2026-01-01").cast("date"), 50)
        assert [r["id"] for r in found.collect()] == [r["id"] for r in feeds.keyword_search(listings, words, F.lit("2026-01-01").cast("date"), 50).collect()], words


def test_grams_of_a_block_against_a_plain_count():
    rng = random.Random(4)
    for alphabet in ("ab", "".join(chr(k) for k in rng.sample(range(0x4E00, 0x9FFF), 3000)), "".join(chr(k) for k in range(0x20000, 0x20000 + 60_000))):
        fields = [["".join(rng.choices(alphabet, k=rng.choice([0, 2, 3, 400]))) for _ in range(2)] for _ in range(60)]
        grams, place = search.distinct_grams(fields)
        want = sorted({(search.gram_number(t[k : k + 3]), i) for i, own in enumerate(fields) for t in own for k in range(len(t) - 2)})
        assert list(zip(grams.tolist(), place.tolist(), strict=True)) == want
    assert [len(x) for x in search.distinct_grams([[""], []])] == [0, 0]
    # characters so many that gram and place don't fit one number
    wide = [["".join(chr(k) for k in range(0x10000, 0x10000 + 900_000, 1))]] + [["xyz"]] * 40
    grams, place = search.distinct_grams(wide)
    assert len(grams) == 899_998 + 40 and grams[:40].tolist() == [search.gram_number("xyz")] * 40 and place[:40].tolist() == list(range(1, 41))
