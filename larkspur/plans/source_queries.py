"""Queries of the ten sources: every listing is written as its source's page would say it, and read back by the source's function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import written
from ..sources import landed as L
from .queries import DAY, _said, day, query

c = F.col


def _json(**fields: Column) -> Column:
    """JSON of the fields that aren't null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _html(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _iso(date: Column) -> Column:
    return F.concat(date.cast("string"), F.lit("T10:00:00"))


def _named(name: Column) -> Column:
    return F.struct(name.alias("name"))


PER_PAGE = 8


def entries() -> dict[str, Column]:
    """A listing as each source's page has it. Listings of tag 5 are said to be online, over, sold out or of an excluded category, where a source knows that."""
    title, venue, s, e, gone, text = c("raw_title"), c("venue"), c("event_date_start"), c("event_date_end"), c("tag_no") == 5, c("raw_description")
    long = lambda d: F.date_format(d, "d MMMM yyyy")
    full = lambda d: F.date_format(d, "d MMM yyyy, EEEE")
    span = F.when(e.isNull(), full(s)).otherwise(F.concat(full(s), F.lit(" - "), full(e)))
    field = lambda kind, name, text: F.concat(F.lit(f'<{kind} class="event-card__{name}">'), _html(text), F.lit(f"</{kind}>"))
    return {
        "eventbrite": _json(name=title, summary=text, url=F.concat(F.lit("https://e.sg/"), "id", F.lit("?x=1")), start_date=s.cast("string"), end_date=e.cast("string"), primary_venue=_named(venue), is_online_event=gone),
        "esplanade": _json(PageData=F.struct(title.alias("Title"), text.alias("Description"), F.concat(F.lit("/t/"), "id").alias("Url")), PerformerName=F.when(c("tag_no") % 2 == 0, F.concat(F.lit("P"), c("tag_no").cast("string"))), Genres=F.array(F.lit("g"), c("tag_no").cast("string")), DisplayDate=_said(True), Venue=venue, IsPastEvent=gone),
        "sportplus": _json(title=title, description=text, slug=c("id"), status=gone.cast("int"), location=_named(venue), scheduling=F.struct(long(s).alias("startDateFormatted"), long(e).alias("endDateFormatted"))),
        "peatix": _json(id=c("id"), name=title, datetime=F.concat(s.cast("string"), F.lit(" 09:00:00 +0800")), datetime_end=_iso(e), venue_name=venue, isOnline=gone),
        "fever": _json(id=c("id"), name=title, date_from=_iso(s), date_to=_iso(e), place=_named(venue), sold_out=gone),
        "tessera": _json(slug=c("id"), title=title, startDate=_iso(s), end_date=_iso(e), venue=venue, category=F.when(gone, "health-wellness").otherwise("music")),
        "thekallang": F.concat(F.lit('<div class="event-card col-lg-4"><a href="/x/'), "id", F.lit('" class="event-card__title">'), _html(title), F.lit("</a>"), field("p", "location", venue), field("span", "time", span), field("p", "desc", text), F.lit("</div>")),
        "scape": F.concat(F.lit('<a href="https://www.scape.sg/whats-on/'), "id", F.lit('"><h3>'), _html(title), F.lit("</h3><p>"), _said(False), F.lit(", 7:30PM - 10PM</p><p>Community</p><p>"), venue, F.lit("</p></a>")),
        "srt": F.concat(F.lit('<a href="/show/'), "id", F.lit('"><h4>'), _html(title), F.lit("</h4><p>"), _said(True), F.lit(" | "), venue, F.lit("</p></a>")),
        "bookmyshow": F.substring(_json(name=title, startDate=_iso(s), endDate=_iso(e), description=F.concat(F.lit("<p>"), text, F.lit("</p>")), location=_named(venue)), 2, 1 << 30),
    }


#: What stands before, between and after the listings of a page.
AROUND = {
    "eventbrite": ('<script>window.__SERVER_DATA__ = {"search_data":{"events":{"results":[', ",", "]}}};</script>"),
    "esplanade": ('{"Listings":[', ",", "]}"),
    "sportplus": ('<script id="wix-warmup-data">{"appsWarmupData":{"app":{"w":{"events":{"events":[', ",", "]}}}}}</script>"),
    "peatix": ('{"json_data":{"events":[', ",", "]}}"),
    "fever": ('{"plans":[', ",", "]}"),
    "tessera": ('{"data":[', ",", "]}"),
    "thekallang": ("<main>", "", "</main>"),
    "scape": ("<ul>", "", "</ul>"),
    "srt": ("<ul>", "", "</ul>"),
    "bookmyshow": ('<script type="application/ld+json">{"@type":"Event",', "", "</script>"),
}


def _detail_page(inside: str, area: str, around: str) -> Column:
    """A page whose text, in two parts of nested elements, lies in one of three places, by the listing's number; what follows the area is no part of it."""
    text = _html(F.col("raw_description"))
    half = (F.length("raw_description") / 2).cast("int")
    cut = F.concat(F.lit("<div><div>"), _html(F.substring("raw_description", 1, half)), F.lit("</div>"), F.lit("<script>var x = 1;</script><span>"), _html(F.substring(F.col("raw_description"), half + 1, F.lit(1 << 30))), F.lit("</span></div>"))
    top = "<html><head><title>No text</title></head><body><nav><div>Menu</div></nav>"
    end = "<footer>About us</footer></body></html>"
    say = lambda before, x, after: F.concat(F.lit(top + before), x, F.lit(after + end))
    n = F.col("no") % 3
    return F.when(n == 0, say(inside, cut, area)).when(n == 1, say(f"<main>{around}", text, "</main>")).otherwise(say("<p>", text, "</p>"))


def details() -> dict[str, tuple[Column, Column]]:
    """Address and body of the detail pages of the sources that have such. Listings of odd numbers have another venue there."""
    moved = F.when(c("no") % 2 == 1, F.concat(c("venue"), F.lit(" annex")))
    at = lambda base: F.concat(F.lit(base), c("id"))
    return {
        "peatix": (at("https://peatix.com/event/"), _json(json_data=F.struct(F.struct(F.concat(F.lit("<p>"), c("raw_description"), F.lit("</p>")).alias("description")).alias("event")))),
        "fever": (at("https://feverup.com/m/"), _json(meta=F.struct(c("raw_description").alias("description")), venue_name=moved)),
        "tessera": (at("https://www.yourtessera.com/e/"), _json(description=F.concat(F.lit("<b>"), c("raw_description"), F.lit("</b>")), venue=F.when(moved.isNotNull(), _named(moved)))),
        "scape": (at("https://www.scape.sg/whats-on/"), _detail_page('<div class="wide"><div class="top entry-content">', '</div><div class="related">Other listings</div></div>', "")),
        "srt": (at("https://www.srt.com.sg/show/"), _detail_page('<div class="wide"><section class="show-content">', "</section><section>Other shows</section></div>", "")),
    }


_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_BARE = "trim(regexp_replace(regexp_replace(raw_description, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_MOVED = "CASE WHEN no % 2 = 1 THEN concat(venue, ' annex') ELSE venue END"
_AREA = f"nullif(substr({_FLAT.format('raw_description')}, 1, 2000), '')"

#: For each source the address of a listing, in SQL, which listings it gives, their descriptions and venues.
EXPECTED = {
    "eventbrite": ("'https://e.sg/' || id", "raw_title <> '' AND tag_no <> 5", "nullif(raw_description, '')", "venue"),
    "esplanade": ("'https://www.esplanade.com/t/' || id", "raw_title <> '' AND tag_no <> 5", "concat_ws(' | ', nullif(raw_description, ''), CASE WHEN tag_no % 2 = 0 THEN concat('P', tag_no) END, concat('g, ', tag_no))", "venue"),
    "sportplus": ("'https://www.sportplus.sg/event-details/' || id", "raw_title <> '' AND tag_no <> 5", "nullif(trim(raw_description), '')", "venue"),
    "peatix": ("'https://peatix.com/event/' || id", "tag_no <> 5", f"nullif({_BARE}, '')", "venue"),
    "fever": ("'https://feverup.com/m/' || id", "tag_no <> 5", "nullif(raw_description, '')", _MOVED),
    "tessera": ("'https://www.yourtessera.com/e/' || id", "tag_no <> 5", f"nullif({_BARE}, '')", _MOVED),
    "thekallang": ("'https://www.thekallang.com.sg/x/' || id", "raw_title <> ''", "nullif(regexp_replace(raw_description, '^\\s+|\\s+$', '', 'g'), '')", "venue"),
    "scape": ("'https://www.scape.sg/whats-on/' || id", "raw_title <> ''", _AREA, "venue"),
    "srt": ("'https://www.srt.com.sg/show/' || id", "raw_title <> ''", _AREA, "venue"),
    "bookmyshow": ("'https://b.example/en/events/' || id", f"event_date_start >= DATE '{DAY}' - 7", _BARE, "venue"),
}


def landed(rows: DataFrame, name: str) -> DataFrame:
    """Pages of PER_PAGE listings, in order of their numbers, and the detail pages of these listings. One source tells a part of its listings again on the page after, under another title."""
    html = name in ("eventbrite", "sportplus", "thekallang", "scape", "srt", "bookmyshow")
    kind = F.lit("text/html" if html else "application/json")
    no = c("id").cast("long")
    rows = rows.withColumn("no", no)
    page = F.floor(no / (1 if name == "bookmyshow" else PER_PAGE)) + 1
    told = rows.select(page.alias("page_no"), "no", entries()[name].alias("entry"))
    if name == "eventbrite":
        again = rows.where(no % 5 == 0).withColumn("raw_title", F.lit("Told again"))
        told = told.union(again.select(page + 1, "no", entries()[name]))
    before, between, after = AROUND[name]
    body = F.concat(F.lit(before), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "entry"))), lambda x: x["entry"]), between), F.lit(after))
    url = F.concat(F.lit("https://b.example/en/events/"), F.min("no").cast("string"))
    source, at = F.lit(name).alias("source"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at")
    pages = told.groupBy("page_no").agg(body.alias("body"), url.alias("url"))
    out = pages.select(source, at, F.col("page_no").cast("int").alias("page_no"), "url", kind.alias("content_type"), "body")
    if name in details():
        address, said = details()[name]
        out = out.unionByName(rows.select(source, at, F.lit(0).alias("page_no"), address.alias("url"), F.lit("detail").alias("content_type"), said.alias("body")))
    return out


def _register(name: str) -> None:
    url, where, said, venue = EXPECTED[name]
    title = "coalesce(nullif(raw_title, ''), 'Untitled Event')" if name == "bookmyshow" else "raw_title"

    def found(rows: DataFrame) -> DataFrame:
        pages = landed(rows, name)
        listed = L.SOURCES[name](pages, day()) if name in ("srt", "bookmyshow") else L.SOURCES[name](pages)
        return listed.select("source_url", "raw_title", "raw_description", "venue", "event_date_start", "event_date_end")

    found.__name__ = f"source_{name}"
    query("listings", f"SELECT {url} AS source_url, {title} AS raw_title, {said} AS raw_description, {venue} AS venue, event_date_start, nullif(event_date_end, event_date_start) AS event_date_end FROM (SELECT *, CAST(id AS BIGINT) AS no FROM listings) WHERE {where}")(found)


for _name in EXPECTED:
    _register(_name)

# Bodies that can't be read, and what is said of them; of each source one for each 40th of its listings.
BROKEN = {
    "eventbrite": ("text/html", "<html>no data</html>", "no server data"),
    "esplanade": ("application/json", "{broken", "body is no JSON"),
    "sportplus": ("text/html", "<script id=\"wix-warmup-data\">{broken</script>", "warm-up data is no JSON"),
    "peatix": ("application/json", "{\"json_data\": 3}", "no list of listings"),
    "fever": ("error", "Listing returned 503", "Listing returned 503"),
    "tessera": ("detail", "<html>", "detail is no JSON"),
    "thekallang": ("text/html", " ", "empty body"),
    "scape": ("error", None, "fetch failed"),
    "srt": ("text/html", None, "empty body"),
    "bookmyshow": ("error", "Sitemap returned 404", "Sitemap returned 404"),
}


def all_landed(rows: DataFrame) -> DataFrame:
    """Listings dealt to the sources by their tags, with bodies that can't be read after the others of their page. Every source reads its own listings alone, and its pages are made once."""
    dealt = written(rows.select("id", "raw_title", "venue", "event_date_start", "event_date_end", "tag_no", "raw_description", (c("tag_no") % 10).alias("dealt")), "dealt")
    pages = None
    for k, name in enumerate(EXPECTED):
        own = dealt.where(c("dealt") == k).drop("dealt")
        kind, body, _ = BROKEN[name]
        no = c("id").cast("long")
        bad = own.where(no % 40 == k).select(F.lit(name).alias("source"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), no.cast("int").alias("page_no"), F.concat(F.lit("https://bad.example/"), "id").alias("url"), F.lit(kind).alias("content_type"), F.lit(body).cast("string").alias("body"))
        both = landed(own, name).unionByName(bad)
        pages = both if pages is None else pages.unionByName(both)
    return written(pages, "source")


_CASES = " ".join(f"WHEN {k} THEN {where}" for k, (_, where, *_) in enumerate(EXPECTED.values()))
_NAMES = ", ".join(f"'{n}'" for n in EXPECTED)
_SAYS = ", ".join(f"'{m}'" for *_, m in BROKEN.values())
_BAD = "CAST(id AS BIGINT) % 40 = tag_no % 10"


@query("listings", f"""SELECT [{_NAMES}][tag_no % 10 + 1] AS source, count(*) FILTER (WHERE CASE tag_no % 10 {_CASES} END) AS events_found,
CASE WHEN count(*) FILTER ({_BAD}) > 0 AND any_value(tag_no % 10) <> {list(BROKEN).index("tessera")} THEN [{_SAYS}][any_value(tag_no % 10) + 1] END AS error FROM listings GROUP BY tag_no % 10""")
def all_sources_report(rows):
    """Every source goes on beside its broken pages; the one whose detail pages are broken has no error."""
    pages = all_landed(rows)
    return L.source_report(pages, L.all_sources(pages, day()))


@query("listings", f"SELECT [{_NAMES}][tag_no % 10 + 1] AS source, CAST(id AS INT) AS page_no, concat('https://bad.example/', id) AS url, [{_SAYS}][tag_no % 10 + 1] AS message FROM listings WHERE {_BAD}")
def source_failures(rows):
    """The landed bodies that can't be read, each with what is wrong."""
    return L.dead_letters(all_landed(rows)).select("source", "page_no", "url", "message")
