import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import dates as D
from larkspur.functions import text as T
from larkspur.operators import dedup, scoring


def values(spark, make, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in sorted(rows.select("i", make(F.col("t")).alias("v")).collect(), key=lambda r: r["i"]) for r in [(r["v"],)]]


def d(text):
    return dt.date.fromisoformat(text) if text else None


def test_display_dates(spark):
    cases = {"21 Feb 2026": ("2026-02-21", None), "20 – 22 Feb 2026": ("2026-02-20", "2026-02-22"), "21 Feb – 15 Mar 2026": ("2026-02-21", "2026-03-15"), "31 Feb 2026": None, "21 feb 2026": None, "soon": None, None: None}
    got = values(spark, lambda c: D.parse_display_date(c, F.lit("2026-09-09T10:00")), list(cases))
    for (start, end), want in zip(got, cases.values(), strict=True):
        assert (start, end) == ((d(want[0]), d(want[1])) if want else (d("2026-09-09"), None))


def test_scape_dates(spark):
    cases = {"26 Feb - 31 Mar 2026": ("2026-02-26", "2026-03-31"), "18 - 19 Apr 2026": ("2026-04-18", "2026-04-19"), "7 Mar 2026, 7:30PM - 10PM": ("2026-03-07", None), "7 Mar 2026, 7:30 pm": ("2026-03-07", None), "May - June 2026": ("2026-05-01", None), "March 2026": ("2026-03-01", None)}
    assert [(r["start"], r["end"]) for r in values(spark, D.parse_scape, list(cases))] == [(d(a), d(b)) for a, b in cases.values()]


def test_kallang_dates(spark):
    cases = {"24 Jan 2026, Saturday - 15 Mar 2026, Sunday": ("2026-01-24", "2026-03-15"), "27, 28 & 29 Mar 2026, Friday, Saturday & Sunday": ("2026-03-27", "2026-03-29"), "14, 15, 18 Mar 2026": ("2026-03-14", "2026-03-18"), "22 Feb 2026, Sunday": ("2026-02-22", None)}
    assert [(r["start"], r["end"]) for r in values(spark, D.parse_kallang, list(cases))] == [(d(a), d(b)) for a, b in cases.values()]


def test_srt_dates(spark):
    cases = {"Now till 28 Mar 2026": ("2026-02-01", "2026-03-28"), "now till 28 Mar": ("2026-02-01", "2026-03-28"), "Now till 5 Jan": ("2026-02-01", "2027-01-05"), "From 13 May 2026": ("2026-05-13", None), "22 Apr - 9 May 2026": ("2026-04-22", "2026-05-09"), "22 - 30 Apr 2026": ("2026-04-22", "2026-04-30"), "7 Mar 2026": ("2026-03-07", None)}
    got = values(spark, lambda c: D.parse_srt(c, F.lit("2026-02-01").cast("date")), list(cases))
    assert [(r["start"], r["end"]) for r in got] == [(d(a), d(b)) for a, b in cases.values()]


def test_other_dates(spark):
    assert values(spark, D.parse_long, ["29 March 2026", "x"]) == [d("2026-03-29"), None]
    assert values(spark, D.iso_date, ["2026-03-01 09:00:00 +0800", "2026-02-31", "", None]) == [d("2026-03-01"), None, None, None]
    days = ["2026-02-20", "2026-02-21", "2026-02-22", "2026-02-23"]  # Friday to Monday
    assert values(spark, lambda c: D.upcoming_friday(c.cast("date")), days) == [d(x) for x in ("2026-02-20", "2026-02-20", "2026-02-27", "2026-02-27")]
    assert values(spark, lambda c: D.header_label(c.cast("date")), ["2026-02-21"]) == ["SAT 21 FEB"]
    assert values(spark, lambda c: D.compact_range(c.cast("date"), F.lit("2026-03-03").cast("date")), ["2026-02-28", "2026-03-03", "2026-03-01"]) == ["28 FEB — 3 MAR", None, "1 — 3 MAR"]
    assert values(spark, lambda c: F.struct(*D.visible_week(c.cast("date"), 0)), ["2026-02-22"])[0] == (d("2026-02-22"), d("2026-02-22"))


def test_text_functions(spark):
    assert values(spark, T.normalize_title, ["The Musée of 2026 Art!", "a b 1999", ""]) == [["muse", "art"], ["b", "1999"], []]
    assert values(spark, T.normalize_venue, ["Hall 2026 Centre, SG"]) == [["2026"]]
    assert values(spark, T.normalize_url, ["HTTP://A.com:80", "https://a.com/x/?q=1#t", "not a url", "https://a.com:8443/"]) == ["http://a.com/", "https://a.com/x/", "not a url", "https://a.com:8443/"]
    assert values(spark, T.extract_json, ["x ```json\n{\"a\": 1}\n``` y", " {\"a\": 2} "]) == ['{"a": 1}', '{"a": 2}']
    long = "word " * 60
    assert values(spark, T.truncate_blurb, ["short", "a" * 250, "x" * 120 + ". " + "y" * 120, long]) == ["short", "a" * 200 + "...", "x" * 120 + ".", ("word " * 40).rstrip() + "..."]
    assert values(spark, T.email_normalized, [" A@B.co ", "a@b", "a" * 250 + "@b.co"]) == ["a@b.co", None, None]


def test_enrichment_of_pages(spark):
    long = "A description that is well over fifty characters in its length, surely."
    pages = {
        f'<meta property="og:description" content="{long}"><body>x</body>': long,
        f"<meta content='{long}' name='description'><body>x</body>": long,
        f'<meta name="description" content="short"><body><nav>menu</nav><p>{long}</p></body>': long,
        "<body>tiny</body>": None,
    }
    assert values(spark, lambda c: T.enrich_description(c, F.lit("https://x")), list(pages)) == list(pages.values())
    ld = f'<script type="application/ld+json">{{"description": "<p>{long}</p>"}}</script>'
    assert values(spark, lambda c: T.enrich_description(c, F.lit("https://www.eventbrite.sg/e/1")), [ld]) == [long]
    assert values(spark, lambda c: T.enrich_description(c, F.lit("https://x"), F.lit("image/png")), [ld * 3]) == [None]


VERDICTS = {
    '```json\n{"include": true, "reason": "ok"}\n```': (True, "ok"),
    '{"include": "false", "reason": "text"}': (True, "text"),
    '{"include": 0, "reason": "zero"}': (False, "zero"),
    '{"include": "", "reason": "empty"}': (False, "empty"),
    '{"include": null}': (False, ""),
    '{"reason": "missing"}': (False, "missing"),
    "{broken": (False, scoring.FAILED),
}


def test_filter_verdicts(spark):
    assert [tuple(r) for r in values(spark, scoring.filter_verdict, list(VERDICTS))] == list(VERDICTS.values())


def test_enrichment_verdicts(spark):
    one = lambda score, tags='["go see", "nonsense", "game on", "last call", "free lah"]': f'{{"blurb": "b", "tags": {tags}, "heads_up": 1, "score": {score}}}'
    texts = [one('"7"'), one("null"), one("6.5"), one("99"), one('"x"'), '{"blurb": "b", "tags": []}', '{"blurb": "b"}', "{broken", '{"tags": []}']
    got = values(spark, lambda c: scoring.enrichment_verdict(c, F.lit("title")), texts)
    assert [r["score"] for r in got] == [7, 1, 7, 10, 5, 5, 5, 5, 5]
    assert got[0]["tags"] == ["go see", "game on", "last call"] and got[0]["heads_up"] and got[0]["blurb"] == "b"
    assert [r["blurb"] for r in got[6:]] == ["title"] * 3 and got[5]["tags"] == []


WORDS = st.lists(st.sampled_from(["jazz", "night", "live", "art", "the", "fair"]), max_size=5).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(pairs=st.lists(st.tuples(WORDS, WORDS), min_size=5, max_size=20))
def test_titles_match_as_told(spark, pairs):
    def told(a, b):
        a, b = ([w for w in x.split() if w != "the"] for x in (a, b))
        if not a or not b:
            return False
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return set(short) <= set(long) or sum(w in a for w in b) >= (2 if min(len(a), len(b)) < 4 else 3)

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", dedup.titles_match(T.normalize_title(F.col("a")), T.normalize_title(F.col("b"))).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [told(a, b) for a, b in pairs]


@pytest.mark.parametrize("n", [3, 7])
def test_canonical_choice(spark, n):
    r = "included boolean, raw_description string, created_at int"
    rows = spark.createDataFrame([((True, "x", 9), (None, "xxxx", 1)), ((None, "x" * n, 5), (None, "xx", 1)), ((None, "x", 5), (None, "y", 1)), ((None, "x", 1), (None, "y", 1))], f"a struct<{r.replace(' ', ':').replace(',:', ',')}>, b struct<{r.replace(' ', ':').replace(',:', ',')}>")
    assert [x[0] for x in rows.select(dedup.canonical_first(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]


def test_chains_are_resolved(spark):
    pairs = spark.createDataFrame([("i", "j", 0), ("j", "k", 1), ("i", "k", 2)], "duplicate_id string, canonical_id string, seq int")
    assert {(r[0], r[1]) for r in dedup.resolved(pairs).collect()} == {("i", "k"), ("j", "k")}
    found = dedup.sweep([("i", 1, 0), ("j", 2, 0), ("k", 3, 0)], {("i", "j"), ("i", "k"), ("j", "k")})
    assert found == [("i", "j", 0), ("i", "k", 1), ("j", "k", 2)]
