"""Landed payloads, one row a page, to raw listings.

landed: source, fetched_at, page_no, url, content_type, body. Detail payloads
are landed rows too, whose url is the listing's. Site knowledge is in the
functions below; each takes the landed rows of its source. Rows without a start
date are no listings. Every function gives LISTING's columns.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.content import content_area
from ..functions.text import normalize_url, resolve_url, strip_tags

LANDED = "source string, fetched_at timestamp, page_no int, url string, content_type string, body string"
LISTING = ("source", "source_url", "raw_title", "raw_description", "venue", "event_date_start", "event_date_end", "seq")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _listings(rows: DataFrame, source: str, url: Column, title: Column, description: Column, venue: Column, start: Column, end: Column) -> DataFrame:
    """Listings in order of page and place; seq is that order."""
    out = rows.select(F.lit(source).alias("source"), url.alias("source_url"), title.alias("raw_title"), description.alias("raw_description"), venue.alias("venue"), start.alias("event_date_start"), D.end_or_null(start, end).alias("event_date_end"), (F.col("page_no").cast("long") * 100_000 + F.col("pos")).alias("seq"))
    return out.where("event_date_start is not null and source_url is not null")


def _variants(landed: DataFrame, list_of: Callable[[Column], Column]) -> DataFrame:
    """A row for each element, v, of the list that list_of finds in a page's body."""
    found = landed.where("content_type not in ('detail', 'error')").withColumn("items", list_of(F.try_parse_json("body")))
    return found.select("page_no", F.posexplode("items").alias("pos", "v"))


def _text(path: str, v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", "string")


def _flag(path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col("v"), f"$.{path}", "boolean"), F.lit(False))


def _details(landed: DataFrame) -> DataFrame:
    return landed.where("content_type = 'detail'").select(F.col("url").alias("at"), F.try_parse_json("body").alias("d")).dropDuplicates(["at"])


EVENT = "struct<name:string,summary:string,url:string,start_date:string,end_date:string,primary_venue:struct<name:string>,is_online_event:boolean,is_cancelled:boolean>"


def eventbrite(landed: DataFrame) -> DataFrame:
    """Results in a page's server data; of listings with one address the first seen counts."""
    data = F.regexp_extract("body", r"window\.__SERVER_DATA__\s*=\s*(\{[\s\S]*?\});", 1)
    parsed = F.from_json(data, f"struct<search_data:struct<events:struct<results:array<{EVENT}>>>>")
    rows = landed.select("page_no", F.posexplode(parsed["search_data"]["events"]["results"]).alias("pos", "e"))
    live = ~F.coalesce("e.is_online_event", F.lit(False)) & ~F.coalesce("e.is_cancelled", F.lit(False))
    rows = rows.where(live & (F.col("e.primary_venue.name") != "") & (F.col("e.name") != "") & (F.col("e.url") != ""))
    out = _listings(rows, "eventbrite", normalize_url(F.col("e.url")), F.col("e.name"), _filled(F.col("e.summary")), F.col("e.primary_venue.name"), D.iso_date(F.col("e.start_date")), D.iso_date(F.col("e.end_date")))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("source_url").orderBy("seq"))).where("n = 1").drop("n")


PERFORMANCE = "struct<PageData:struct<Title:string,Description:string,Url:string>,Genres:array<string>,DisplayDate:string,Venue:string,PerformerName:string,PerformanceStartDate:string,IsPastEvent:boolean,IsLiveStreamEvent:boolean,IsOnDemandEvent:boolean>"


def esplanade(landed: DataFrame) -> DataFrame:
    """Performances to come on site; the description joins what there is of text, performer and genres."""
    rows = landed.select("page_no", F.posexplode(F.from_json("body", f"struct<Listings:array<{PERFORMANCE}>>")["Listings"]).alias("pos", "e"))
    gone = [F.coalesce(f"e.{c}", F.lit(False)) for c in ("IsPastEvent", "IsLiveStreamEvent", "IsOnDemandEvent")]
    rows = rows.where(~gone[0] & ~gone[1] & ~gone[2] & (F.col("e.PageData.Title") != "") & (F.col("e.Venue") != ""))
    said = _filled(F.concat_ws(" | ", _filled(F.col("e.PageData.Description")), _filled(F.col("e.PerformerName")), _filled(F.array_join("e.Genres", ", "))))
    when = D.parse_display_date(_filled(F.col("e.DisplayDate")), F.col("e.PerformanceStartDate"))
    return _listings(rows, "esplanade", resolve_url(F.col("e.PageData.Url"), "https://www.esplanade.com"), F.col("e.PageData.Title"), said, F.col("e.Venue"), when["start"], when["end"])


WIX = "struct<title:string,description:string,slug:string,status:int,location:struct<name:string>,scheduling:struct<startDateFormatted:string,endDateFormatted:string>>"


def sportplus(landed: DataFrame) -> DataFrame:
    """Events of all widgets in a page's warm-up data."""
    data = F.regexp_extract("body", r"(?is)<script[^>]*id=[\"']wix-warmup-data[\"'][^>]*>(.*?)</script>", 1)
    parsed = F.from_json(data, f"struct<appsWarmupData:map<string,map<string,struct<events:struct<events:array<{WIX}>>>>>>")
    widgets = F.flatten(F.transform(F.map_values(parsed["appsWarmupData"]), lambda m: F.map_values(m)))
    events = F.flatten(F.filter(F.transform(widgets, lambda w: w["events"]["events"]), lambda e: e.isNotNull()))
    rows = landed.select("page_no", "url", F.posexplode(events).alias("pos", "e"))
    title, venue = F.trim("e.title"), F.trim("e.location.name")
    rows = rows.where((F.col("e.status") == 0) & (title != "") & (venue != ""))
    at = F.when(F.col("e.slug") != "", F.concat(F.lit("https://www.sportplus.sg/event-details/"), F.col("e.slug"))).otherwise(F.col("url"))
    return _listings(rows, "sportplus", at, title, _filled(F.trim("e.description")), venue, D.parse_long(F.col("e.scheduling.startDateFormatted")), D.parse_long(F.col("e.scheduling.endDateFormatted")))


# The places where a page's list may be.
PEATIX_LISTS = ("$.json_data", "$.json_data.events", "$.json_data.results", "$", "$.events", "$.results")


def peatix(landed: DataFrame) -> DataFrame:
    """Events that aren't online, under any of the places where the list may be, with their details' descriptions."""
    rows = _variants(landed, lambda v: F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in PEATIX_LISTS]))
    online = _flag("isOnline") | (F.coalesce(_text("venue_name"), F.lit("")) == "xxxonlineeventxxx") | (F.lower(F.coalesce(_text("thumb_venue"), F.lit(""))) == "online event")
    rows = rows.where(~online).withColumn("at", F.concat(F.lit("https://peatix.com/event/"), _text("id"))).join(_details(landed), "at", "left")
    said = _filled(strip_tags(_text("json_data.event.description", "d")))
    start = D.iso_date(F.coalesce(_filled(_text("datetime_start")), _text("datetime")))
    return _listings(rows, "peatix", F.col("at"), _text("name"), said, F.coalesce(_filled(_text("venue_name")), F.lit("Singapore")), start, D.iso_date(_text("datetime_end")))


def fever(landed: DataFrame) -> DataFrame:
    """Plans that are dated and on sale; details override the venue."""
    rows = _variants(landed, lambda v: F.coalesce(F.try_variant_get(v, "$.plans", "array<variant>"), F.try_variant_get(v, "$.results", "array<variant>")))
    gone = _flag("extra.timeless") | _flag("sold_out") | _flag("is_sold_out") | F.coalesce(_text("name").rlike(r"(?i)gift\s*card"), F.lit(False))
    at = F.concat(F.lit("https://feverup.com/m/"), F.coalesce(_text("plan_id"), _text("id")))
    rows = rows.where(~gone).withColumn("at", at).join(_details(landed), "at", "left")
    venue = F.coalesce(_filled(_text("venue_name", "d")), _filled(_text("venue_name")), _filled(_text("place.name")), F.lit("Singapore"))
    start = D.iso_date(F.coalesce(_filled(_text("date_from")), _text("first_active_session_date")))
    end = D.iso_date(F.coalesce(_filled(_text("date_to")), _text("last_active_session_date")))
    return _listings(rows, "fever", F.col("at"), _text("name"), _filled(_text("meta.description", "d")), venue, start, end)


# Categories that are no listings.
TESSERA_EXCLUDED = ("health-wellness", "business-professional")


def tessera(landed: DataFrame) -> DataFrame:
    """Events outside the excluded categories; a venue is a text or an object with a name, and details override it."""
    rows = _variants(landed, lambda v: F.try_variant_get(v, "$.data", "array<variant>"))
    categories = F.coalesce(F.try_variant_get(F.col("v"), "$.categories", "array<string>"), F.array().cast("array<string>"))
    every = F.concat(F.array(_text("category"), _text("categorySlug")), categories)
    rows = rows.where(~F.exists(every, lambda c: F.coalesce(c.isin(*TESSERA_EXCLUDED), F.lit(False))))
    rows = rows.withColumn("at", F.concat(F.lit("https://www.yourtessera.com/e/"), _text("slug"))).join(_details(landed), "at", "left")

    def venue(v: str) -> Column:
        plain = F.when(F.schema_of_variant(F.try_variant_get(F.col(v), "$.venue", "variant")) == "STRING", _text("venue", v))
        return F.coalesce(_filled(plain), _filled(_text("venue.name", v)))

    start = D.iso_date(F.coalesce(_filled(_text("start_date")), _text("startDate")))
    end = D.iso_date(F.coalesce(_filled(_text("end_date")), _text("endDate")))
    return _listings(rows, "tessera", F.col("at"), _text("title"), _filled(strip_tags(_text("description", "d"))), F.coalesce(venue("d"), venue("v"), F.lit("Singapore")), start, end)


class _Cards(HTMLParser):
    """Texts by name inside each card. A card and its fields are told by (tag, class words, href prefix)."""

    def __init__(self, card: tuple, fields: dict[str, tuple]):
        super().__init__()
        self.card, self.fields, self.depth, self.open, self.cards = card, fields, 0, [], []

    def _is(self, spec: tuple, tag: str, attrs: dict[str, str]) -> bool:
        name, classes, href = spec
        return (not name or tag == name) and set(classes) <= set((attrs.get("class") or "").split()) and (attrs.get("href") or "").startswith(href)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if self.depth == 0:
            if self._is(self.card, tag, named):
                self.cards.append({"href": named.get("href") or "", "texts": []})
                self.depth, self.open = 1, []
            return
        if tag == self.card[0] or not self.card[0] and tag == "div":
            self.depth += 1
        for field, spec in self.fields.items():
            if self._is(spec, tag, named):
                if named.get("href") and not self.cards[-1]["href"]:
                    self.cards[-1]["href"] = named["href"]
                self.cards[-1]["texts"].append([field, ""])
                self.open.append((tag, len(self.cards[-1]["texts"]) - 1))

    def handle_endtag(self, tag: str) -> None:
        if self.depth and self.open and self.open[-1][0] == tag:
            self.open.pop()
        if self.depth and (tag == self.card[0] or not self.card[0] and tag == "div"):
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        for _, k in self.open:
            self.cards[-1]["texts"][k][1] += data


def html_cards(landed: DataFrame, card: tuple, fields: dict[str, tuple]) -> DataFrame:
    """page_no, pos, href and texts (pairs of field and trimmed text, in page order) of the cards of landed pages."""

    # a hundred pages at a time, whatever their size: a batch of Arrow would be ten thousand
    @F.udf("array<struct<href:string,texts:array<struct<field:string,text:string>>>>", useArrow=False)
    def cards(body: str | None) -> list[tuple]:
        parser = _Cards(card, fields)
        parser.feed(body or "")
        return [(c["href"], [(f, t.strip()) for f, t in c["texts"]]) for c in parser.cards]

    pages = landed.where("content_type not in ('detail', 'error')")
    return pages.select("page_no", F.posexplode(cards("body")).alias("pos", "c")).select("page_no", "pos", "c.href", "c.texts")


def _field(name: str) -> Column:
    return F.get(F.transform(F.filter("texts", lambda t: t["field"] == name), lambda t: t["text"]), 0)


def thekallang(landed: DataFrame) -> DataFrame:
    fields = {k: ("", (f"event-card__{k}",), "") for k in ("title", "location", "time", "desc")}
    rows = html_cards(landed, ("div", ("event-card", "col-lg-4"), ""), fields).where((_field("title") != "") & (_field("location") != ""))
    when = D.parse_kallang(_field("time"))
    return _listings(rows, "thekallang", resolve_url(F.col("href"), "https://www.thekallang.com.sg"), _field("title"), _filled(_field("desc")), _field("location"), when["start"], when["end"])


# Paragraphs that name a category.
SCAPE_CATEGORIES = ("media & entertainment", "creative arts", "entrepreneurship & careers", "community", "sports & wellness")


# Where the detail pages of two sources have their text.
SCAPE_AREA = (".entry-content", ".post-content", ".wp-block-group", "article")
SRT_AREA = ("main", "article", ".content", ".show-content", ".entry-content")


def _described(rows: DataFrame, landed: DataFrame, said: Column) -> DataFrame:
    """Rows with `said`, the text of the detail page of their address `at`, null where none has landed."""
    details = landed.where("content_type = 'detail'").select(F.col("url").alias("at"), "body").dropDuplicates(["at"])
    return rows.join(details.select("at", said.alias("said")), "at", "left")


def scape(landed: DataFrame) -> DataFrame:
    """The first paragraph with a year is the date; the last one that is no date, time or category is the venue. The description is the detail page's."""
    base = "https://www.scape.sg/whats-on/"
    rows = html_cards(landed, ("a", (), base), {"title": ("h3", (), ""), "p": ("p", (), "")})
    rows = rows.where((F.col("href") != base) & ~F.col("href").contains("/page/") & (_field("title") != ""))
    lines = F.filter(F.transform(F.filter("texts", lambda t: t["field"] == "p"), lambda t: t["text"]), lambda t: t != "")
    dated = F.get(F.filter(lines, lambda p: p.rlike(r"\b\d{4}\b")), 0)
    place = F.filter(lines, lambda p: ~p.rlike(r"\b\d{4}\b") & ~p.rlike(r"^\d{1,2}:\d{2}") & ~F.lower(p).isin(*SCAPE_CATEGORIES) & (F.length(p) > 1))
    when = D.parse_scape(F.trim(F.regexp_replace(dated, r"\s*\|.*$", "")))
    rows = _described(rows.withColumn("at", F.col("href")), landed, content_area(F.col("body"), SCAPE_AREA, main=True))
    return _listings(rows, "scape", F.col("at"), _field("title"), F.col("said"), F.coalesce(F.try_element_at(place, F.lit(-1)), F.lit("*SCAPE")), when["start"], when["end"])


def srt(landed: DataFrame, today: Column) -> DataFrame:
    """The first paragraph is the date, and the venue after a bar. The description is the detail page's."""
    rows = html_cards(landed, ("a", (), "/show/"), {"title": ("h4", (), ""), "p": ("p", (), "")}).where(_field("title") != "")
    parts = F.transform(F.split(F.coalesce(_field("p"), F.lit("")), r"\|"), lambda t: F.trim(t))
    when = D.parse_srt(F.get(parts, 0), today)
    rows = _described(rows.withColumn("at", resolve_url(F.col("href"), "https://www.srt.com.sg")), landed, content_area(F.col("body"), SRT_AREA))
    return _listings(rows, "srt", F.col("at"), _field("title"), F.col("said"), F.coalesce(_filled(F.get(parts, 1)), F.lit("KC Arts Centre")), when["start"], when["end"])


def sitemap_urls(landed: DataFrame) -> DataFrame:
    """url of each event page that a site map names."""
    found = F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    return landed.where("content_type = 'sitemap'").select(found.alias("url")).where(F.col("url").contains("/en/events/")).distinct()


def unknown_urls(urls: DataFrame, listings: DataFrame) -> DataFrame:
    """What isn't stored yet, and so is worth fetching."""
    return urls.join(listings.select(F.col("source_url").alias("url")), "url", "left_anti")


def bookmyshow(landed: DataFrame, today: Column, most: int | None = None) -> DataFrame:
    """The first event in a page's structured data, alone or in a list, unless it is online or over a week past. most: a page count, as a feature."""
    pages = landed.where("content_type = 'text/html'")
    if most is not None:
        pages = pages.orderBy("url").limit(most)
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    each = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(F.try_parse_json(b), "$", "array<variant>"), F.filter(F.array(F.try_parse_json(b)), lambda v: v.isNotNull()))))
    rows = pages.withColumn("v", F.get(F.filter(each, lambda v: F.try_variant_get(v, "$['@type']", "string") == "Event"), 0)).where("v is not null").withColumn("pos", F.lit(0))
    start = D.iso_date(_text("startDate"))
    rows = rows.where(~F.coalesce(_text("eventAttendanceMode").contains("Online"), F.lit(False)) & D.recent_enough(start, today))
    return _listings(rows, "bookmyshow", F.col("url"), F.coalesce(_filled(_text("name")), F.lit("Untitled Event")), strip_tags(_text("description")), F.coalesce(_filled(_text("location.name")), F.lit("Singapore")), start, D.iso_date(_text("endDate")))


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "eventbrite": eventbrite, "esplanade": esplanade, "sportplus": sportplus, "peatix": peatix, "fever": fever, "tessera": tessera,
    "thekallang": thekallang, "scape": scape, "srt": srt, "bookmyshow": bookmyshow,
}


def all_sources(landed: DataFrame, today: Column) -> DataFrame:
    """Listings of all sources. Bodies that can't be read give none, whatever the others hold."""
    out = None
    for name, f in SOURCES.items():
        own = landed.where(F.col("source") == name)
        rows = f(own, today) if name in ("srt", "bookmyshow") else f(own)
        rows = rows.select(*LISTING)
        out = rows if out is None else out.unionByName(rows)
    return out


# where a source's listings lie in its pages: the block of data in a page, or places of the list in a JSON body
_BLOCKS = {"eventbrite": (r"window\.__SERVER_DATA__\s*=\s*(\{[\s\S]*?\});", "server data"), "sportplus": (r"(?is)<script[^>]*id=[\"']wix-warmup-data[\"'][^>]*>(.*?)</script>", "warm-up data")}
_LISTS = {"esplanade": ("$.Listings",), "peatix": PEATIX_LISTS, "fever": ("$.plans", "$.results"), "tessera": ("$.data",)}


def dead_letters(landed: DataFrame) -> DataFrame:
    """source, page_no, url, content_type and message of every landed body that can't be read; the others are not affected.

    A fetch that failed lands as content_type error, with what happened as its body. Detail pages are told as such:
    the listings that they belong to stay, without a description.
    """
    c = F.col
    html_detail = c("source").isin("scape", "srt")
    parsed = F.try_parse_json("body")
    reason = F.when(c("content_type") == "error", F.coalesce(_filled(c("body")), F.lit("fetch failed"))).when(F.coalesce(F.trim("body"), F.lit("")) == "", "empty body")
    reason = reason.when((c("content_type") == "detail") & ~html_detail & parsed.isNull(), "detail is no JSON").when(c("content_type") == "detail", None)
    for name, (pattern, what) in _BLOCKS.items():
        block = F.regexp_extract("body", pattern, 1)
        own = c("source") == name
        reason = reason.when(own & (block == ""), f"no {what}").when(own & F.try_parse_json(block).isNull(), f"{what} is no JSON")
    for name, places in _LISTS.items():
        own = c("source") == name
        listed = F.coalesce(*[F.try_variant_get(parsed, p, "array<variant>") for p in places])
        reason = reason.when(own & parsed.isNull(), "body is no JSON").when(own & listed.isNull(), "no list of listings")
    return landed.select("source", "page_no", "url", "content_type", reason.alias("message")).where("message is not null")


def source_report(landed: DataFrame, found: DataFrame) -> DataFrame:
    """source, how many listings it gave, and as error the message of its first page that couldn't be read, null if all could. A detail page is no error of its source."""
    pages = landed.groupBy("source").agg(F.count("*").alias("pages"))
    counts = found.groupBy("source").agg(F.count("*").alias("events_found"))
    first = dead_letters(landed).where("content_type <> 'detail'").groupBy("source").agg(F.min(F.struct("page_no", "url", "message")).alias("first"))
    return pages.join(counts, "source", "left").join(first, "source", "left").select("source", F.coalesce("events_found", F.lit(0)).alias("events_found"), F.col("first.message").alias("error"))
