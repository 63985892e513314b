import datetime as dt
import json

from pyspark.sql import functions as F

from larkspur.sources import landed as L
from larkspur.sources import tables

NOW = dt.datetime(2026, 2, 1)


def page(source, body, page_no=1, url="https://list", kind="application/json"):
    return (source, NOW, page_no, url, kind, body if isinstance(body, str) else json.dumps(body))


def rows(df):
    return [tuple(r[c] for c in ("source_url", "raw_title", "raw_description", "venue", "event_date_start", "event_date_end")) for r in df.orderBy("seq").collect()]


def frame(spark, *pages):
    return spark.createDataFrame(list(pages), L.LANDED)


def d(t):
    return dt.date.fromisoformat(t)


def test_eventbrite(spark):
    e = {"name": "A", "summary": "s", "url": "https://e.sg/a?x=1", "start_date": "2026-03-01", "end_date": "2026-03-01", "primary_venue": {"name": "V"}, "is_online_event": False, "is_cancelled": False}
    data = {"search_data": {"events": {"results": [e, e | {"name": "again"}, e | {"url": "https://e.sg/b", "is_online_event": True}, e | {"url": "https://e.sg/c", "primary_venue": None}, e | {"url": "https://e.sg/d", "summary": "", "end_date": "2026-03-04"}]}}}
    got = rows(L.eventbrite(frame(spark, page("eventbrite", f"<script>window.__SERVER_DATA__ = {json.dumps(data)};</script>", kind="text/html"), page("eventbrite", "<html>no data</html>", 2))))
    assert got == [("https://e.sg/a", "A", "s", "V", d("2026-03-01"), None), ("https://e.sg/d", "A", None, "V", d("2026-03-01"), d("2026-03-04"))]


def test_esplanade(spark):
    x = {"PageData": {"Title": "T", "Description": "D", "Url": "/t"}, "Genres": ["a", "b"], "DisplayDate": "20 – 22 Feb 2026", "Venue": "Hall", "PerformerName": None, "IsPastEvent": False, "IsLiveStreamEvent": False, "IsOnDemandEvent": False}
    body = {"Listings": [x, x | {"IsPastEvent": True}, x | {"Venue": None}, x | {"DisplayDate": "soon", "PerformanceStartDate": "2026-05-05T00:00", "Genres": None, "PageData": {"Title": "U", "Url": "https://o/u"}}, x | {"DisplayDate": "soon"}]}
    assert rows(L.esplanade(frame(spark, page("esplanade", body)))) == [("https://www.esplanade.com/t", "T", "D | a, b", "Hall", d("2026-02-20"), d("2026-02-22")), ("https://o/u", "U", None, "Hall", d("2026-05-05"), None)]


def test_sportplus(spark):
    e = {"title": " Run ", "description": " d ", "slug": "run", "status": 0, "location": {"name": "Park"}, "scheduling": {"startDateFormatted": "29 March 2026", "endDateFormatted": "29 March 2026"}}
    data = {"appsWarmupData": {"app": {"w1": {"events": {"events": [e, e | {"status": 1}]}}, "w2": {"events": {"events": [e | {"slug": None, "title": "Swim"}]}}, "w3": {}}}}
    got = rows(L.sportplus(frame(spark, page("sportplus", f'<script type="application/json" id="wix-warmup-data">{json.dumps(data)}</script>', url="https://page"))))
    assert sorted(got) == [("https://page", "Swim", "d", "Park", d("2026-03-29"), None), ("https://www.sportplus.sg/event-details/run", "Run", "d", "Park", d("2026-03-29"), None)]


def test_peatix(spark):
    e = {"id": 5, "name": "P", "datetime": "2026-03-01 09:00:00 +0800", "datetime_end": "2026-03-02 09:00", "venue_name": None, "isOnline": False}
    body = {"json_data": {"events": [e, e | {"id": 6, "isOnline": True}, e | {"id": 7, "venue_name": "xxxonlineeventxxx"}, e | {"id": 8, "thumb_venue": "Online Event"}]}}
    detail = page("peatix", {"json_data": {"event": {"description": "<p>a</p><p>b</p>"}}}, url="https://peatix.com/event/5", kind="detail")
    assert rows(L.peatix(frame(spark, page("peatix", body), detail, page("peatix", {"results": [e | {"id": 9, "venue_name": "V"}]}, 2), page("peatix", "{broken", 3)))) == [
        ("https://peatix.com/event/5", "P", "a b", "Singapore", d("2026-03-01"), d("2026-03-02")), ("https://peatix.com/event/9", "P", None, "V", d("2026-03-01"), d("2026-03-02"))]


def test_fever_and_tessera(spark):
    p = {"id": 1, "plan_id": 2, "name": "F", "date_from": None, "first_active_session_date": "2026-03-01T10:00", "place": {"name": "X"}}
    detail = page("fever", {"meta": {"description": "D"}, "venue_name": "Y"}, url="https://feverup.com/m/2", kind="detail")
    got = rows(L.fever(frame(spark, page("fever", {"plans": [p, p | {"name": "Gift  Card"}, p | {"extra": {"timeless": True}}, p | {"is_sold_out": True}, {"id": 3, "name": "G", "date_from": "2026-04-01", "date_to": "2026-04-02"}]}), detail)))
    assert got == [("https://feverup.com/m/2", "F", "D", "Y", d("2026-03-01"), None), ("https://feverup.com/m/3", "G", None, "Singapore", d("2026-04-01"), d("2026-04-02"))]
    e = {"slug": "s", "title": "T", "startDate": "2026-03-01", "venue": "plain"}
    body = {"data": [e, e | {"slug": "o", "venue": {"name": "object"}}, e | {"slug": "x", "category": "health-wellness"}, e | {"slug": "y", "categories": ["a", "business-professional"]}]}
    detail = page("tessera", {"description": "<b>d</b>", "venue": {"name": "better"}}, url="https://www.yourtessera.com/e/o", kind="detail")
    assert rows(L.tessera(frame(spark, page("tessera", body), detail))) == [("https://www.yourtessera.com/e/s", "T", None, "plain", d("2026-03-01"), None), ("https://www.yourtessera.com/e/o", "T", "d", "better", d("2026-03-01"), None)]


def test_html_cards(spark):
    card = '<div class="event-card col-lg-4"><div><a class="event-card__title" href="/x"> T <b>1</b></a></div><p class="event-card__location">V</p><span class="event-card__time">27, 28 &amp; 29 Mar 2026</span><p class="event-card__desc">D</p></div>'
    got = rows(L.thekallang(frame(spark, page("thekallang", f"<div>{card}{card.replace('V</p>', '</p>')}</div>", kind="text/html"))))
    assert got == [("https://www.thekallang.com.sg/x", "T 1", "D", "V", d("2026-03-27"), d("2026-03-29"))]
    link = '<li><a href="https://www.scape.sg/whats-on/a"><h3>S</h3><p>Community</p><p>6 Mar 2026 | 7:30PM</p><p>7:30 pm</p><p>The Ground</p><p>The Tree</p></a></li><a href="https://www.scape.sg/whats-on/"><h3>no</h3></a>'
    assert rows(L.scape(frame(spark, page("scape", link, kind="text/html")))) == [("https://www.scape.sg/whats-on/a", "S", None, "The Tree", d("2026-03-06"), None)]
    show = '<a href="/show/a/"><h4>Play</h4><p>Now till 28 Mar | Big Hall</p></a><a href="/show/b/"><h4>Two</h4><p>7 Mar 2026</p></a><a href="/show/c"><p>no title</p></a>'
    today = F.lit("2026-02-01").cast("date")
    assert rows(L.srt(frame(spark, page("srt", show, kind="text/html")), today)) == [("https://www.srt.com.sg/show/a/", "Play", None, "Big Hall", d("2026-02-01"), d("2026-03-28")), ("https://www.srt.com.sg/show/b/", "Two", None, "KC Arts Centre", d("2026-03-07"), None)]


def test_cards_come_a_hundred_pages_at_a_time(spark):
    card = '<div class="event-card col-lg-4"><a href="/x/{}" class="event-card__title">t{}</a><p class="event-card__desc"> d </p></div>'
    rows = spark.createDataFrame([page("thekallang", card.format(k, k) * 2, k) for k in range(300)], L.LANDED)
    found = L.html_cards(rows, ("div", ("event-card", "col-lg-4"), ""), {"title": ("", ("event-card__title",), ""), "desc": ("", ("event-card__desc",), "")})
    assert {(r["page_no"], r["pos"], r["href"], *[tuple(t) for t in r["texts"]]) for r in found.collect()} == {(k, p, f"/x/{k}", ("title", f"t{k}"), ("desc", "d")) for k in range(300) for p in (0, 1)}
    plan = found._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan


def test_bookmyshow_and_run_all(spark):
    today = F.lit("2026-02-01").cast("date")
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    event = {"@type": "Event", "name": "B", "startDate": "2026-02-03T10:00", "endDate": "", "description": "<p>x</p> y", "location": {"name": "L"}}
    pages = [page("bookmyshow", '<script type="application/ld+json">{bad</script>' + ld({"@type": "Org"}) + ld([event]), url="https://b/en/events/1", kind="text/html"), page("bookmyshow", ld(event | {"startDate": "2026-01-20"}), url="https://b/en/events/2", kind="text/html"), page("bookmyshow", ld(event | {"eventAttendanceMode": "OnlineEvent"}), url="https://b/en/events/3", kind="text/html")]
    site = page("bookmyshow", "<loc>https://b/en/events/1</loc><loc>https://b/en/about</loc><loc>https://b/en/events/9</loc>", kind="sitemap")
    both = frame(spark, *pages, site, page("fever", "{broken"))
    found = L.all_sources(both, today)
    assert rows(found) == [("https://b/en/events/1", "B", "x y", "L", d("2026-02-03"), None)]
    assert {tuple(r) for r in L.source_report(both, found).collect()} == {("bookmyshow", 1, None), ("fever", 0, "body is no JSON")}
    assert [r["url"] for r in L.unknown_urls(L.sitemap_urls(both), found).collect()] == ["https://b/en/events/9"]


def test_content_area(spark):
    from larkspur.functions.content import content_area

    cases = [
        ('<div class="a entry-content b"><div>one</div><div>two <b>three</b></div></div><div>after</div>', "onetwo three", "onetwo three"),
        ('<p>before</p><article>first<div class="entry-content">inner</div></article><div class="entry-content">second</div>', "firstinner", "firstinner"),
        ('<nav><article>menu</article></nav><main>body <script>if (a < b) {"</main>"}</script>text</main><main> more</main>', "body text more", "body text"),
        ('<head><title>t</title><style>x</style></head><body>plain&nbsp;&amp; &lt;b&gt;<footer>foot<footer>er</footer></footer></body>', "plain & <b>", "plain & <b>"),
        ('<div class="entry-content"><div>never closed', "never closed", "never closed"),
        ('<div class="entry-content"> </div><main>not this</main>', None, None),
        ('<div class="entry-contents">x</div>' + "y" * 3000, "x" + "y" * 1999, "x" + "y" * 1999),
        ("<br/><div class=content />a<div class='content'>b</div>", "ab", "ab"),
        ("", None, None), (None, None, None), ("<b>" * 20_000 + "deep" + "</i>" * 20_000, "deep", "deep"),
    ]
    frame = spark.createDataFrame([(k, h) for k, (h, *_) in enumerate(cases)], "k int, html string")
    got = frame.select("k", content_area(F.col("html"), L.SCAPE_AREA, main=True).alias("a"), content_area(F.col("html"), L.SRT_AREA).alias("b")).orderBy("k").collect()
    assert [(r["a"], r["b"]) for r in got] == [c[1:] for c in cases]


def test_content_area_with_references_cut_short(spark):
    import duckdb

    from larkspur.functions.content import content_area
    from larkspur.plans import queries as plans

    cut = '<div class="ad">les&amp;&ampcut</div><article>a&amp; b&#39;s &lt;c&gt; d & e&lt f&#38 g&#x21;</article>'
    got = spark.createDataFrame([(cut,)], "html string").select(*[content_area(F.col("html"), ("article",), ended=e) for e in (False, True)]).first()
    assert tuple(got) == ("a& b's <c> d & e< f& g!", "a& b's <c> d & e&lt f&#38 g!")
    pages = spark.createDataFrame([(1, "u", cut.replace("&#x21;", ""))], "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [cut.replace("&#x21;", "")])
    query = plans.QUERIES["content_areas"].__closure__
    found = next(x.cell_contents for x in query if getattr(x.cell_contents, "__name__", "") == "content_areas")(pages)
    assert [tuple(r) for r in found.select("page_id", "advert", "article").collect()] == c.sql(plans.ORACLE_SQL["content_areas"]).fetchall()


def test_content_areas_has_whole_texts(spark):
    import duckdb

    from larkspur.plans import queries as plans

    said = [("ad " * 1500).strip(), "wort &amp; text " * 3000 + "ende"]
    html = f'<div class="ad">{said[0]}</div><p>x</p><article><p>{said[1]}</p></article>'
    query = next(x.cell_contents for x in plans.QUERIES["content_areas"].__closure__ if getattr(x.cell_contents, "__name__", "") == "content_areas")
    found = query(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [html])
    got = [tuple(r) for r in found.select("page_id", "advert", "article").collect()]
    assert got == [(1, said[0], said[1].replace("&amp;", "&"))] == c.sql(plans.ORACLE_SQL["content_areas"]).fetchall()


def test_detail_pages_describe_their_listings(spark):
    link = lambda k: f'<a href="https://www.scape.sg/whats-on/{k}"><h3>{k}</h3><p>6 Mar 2026</p></a>'
    detail = lambda k, body: page("scape", body, 0, f"https://www.scape.sg/whats-on/{k}", "detail")
    pages = [page("scape", link("a") + link("b"), 1, kind="text/html"), page("scape", link("c"), 2, kind="text/html"), detail("a", '<div class="post-content">said of a</div><div>no</div>'), detail("c", "<body>said of c"), detail("c", "<body>said of c"), page("scape", "HTTP 500", 3, kind="error")]
    assert [(r[1], r[2]) for r in rows(L.scape(frame(spark, *pages)))] == [("a", "said of a"), ("b", None), ("c", "said of c")]


def test_dead_letters_leave_the_others_alone(spark):
    good = {"plans": [{"id": 1, "name": "F", "date_from": "2026-03-01"}]}
    pages = [page("fever", good), page("fever", "{broken", 3), page("fever", {"other": 1}, 2), page("fever", "no json", 0, "https://feverup.com/m/1", "detail"), page("tessera", {"data": []}), page("srt", "<p>nothing</p>", kind="text/html")]
    landed = frame(spark, *pages)
    found = L.all_sources(landed, F.lit("2026-02-01").cast("date"))
    assert {tuple(r) for r in L.source_report(landed, found).collect()} == {("fever", 1, "no list of listings"), ("tessera", 0, None), ("srt", 0, None)}
    assert {(r["source"], r["page_no"], r["message"]) for r in L.dead_letters(landed).collect()} == {("fever", 2, "no list of listings"), ("fever", 3, "body is no JSON"), ("fever", 0, "detail is no JSON")}
    assert L.dead_letters(landed.limit(0)).collect() == []


def test_tables_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("1", "src0", 3, None, NOW)], tables.DDL["scraper_runs"])
    for _ in range(2):
        tables.append(run, str(tmp_path), "scraper_runs")
    assert tables.read(spark, str(tmp_path), "scraper_runs").count() == 2 and len(tables.schema("listings")) == 22
