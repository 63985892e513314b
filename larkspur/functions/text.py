"""Text functions on columns; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a title or a venue, and the code points that count as a blank.
TITLE_STOP_WORDS = ("the", "a", "an", "in", "at", "of", "and", "for", "to", "singapore", "sg")
VENUE_STOP_WORDS = ("the", "at", "of", "and", "singapore", "sg", "centre", "center", "hall", "room", "studio")
BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&amp;", "&"))


def plain_blanks(c: Column) -> Column:
    return F.translate(c, BLANKS, " " * len(BLANKS))


def _tokens(c: Column, stop: tuple[str, ...]) -> Column:
    words = F.split(F.regexp_replace(F.lower(plain_blanks(c)), r"[^\w\s]", ""), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop))


def normalize_title(c: Column) -> Column:
    """Telling words of a title, in order and with repeats: no stop words, no years."""
    return F.filter(_tokens(c, TITLE_STOP_WORDS), lambda w: ~w.rlike(r"^20\d{2}$"))


def normalize_venue(c: Column) -> Column:
    return _tokens(c, VENUE_STOP_WORDS)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def decoded(c: Column) -> Column:
    """The usual character references, the ampersand last."""
    for name, said in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(said))
    return c


def normalize_url(c: Column) -> Column:
    """Origin and path; what is no web address stays as it is."""
    scheme, host, path = (F.regexp_extract(c, r"^(?i)(https?)://([^/?#]+)([^?#]*)", k) for k in (1, 2, 3))
    scheme = F.lower(scheme)
    host = F.regexp_replace(F.lower(host), F.when(scheme == "http", ":80$").otherwise(":443$"), F.lit(""))
    return F.when(scheme == "", c).otherwise(F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path)))


def resolve_url(c: Column, base: str) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(base), c))


def truncate_blurb(c: Column, most: int = 200) -> Column:
    """Cut at the last full stop if it leaves over half, else at the last blank, else anywhere."""
    head = F.substring(c, 1, most)
    stop = F.when(head.contains("."), most + 1 - F.instr(F.reverse(head), ".")).otherwise(0)
    blank = F.when(head.contains(" "), most + 1 - F.instr(F.reverse(head), " ")).otherwise(0)
    return F.when(F.length(c) <= most, c).when(stop - 1 > most // 2, F.left(head, stop)).when(blank > 1, F.concat(F.left(head, blank - 1), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def extract_json(c: Column) -> Column:
    """What the first fenced block holds, else the whole text."""
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    return F.trim(F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c), F.lit(" \n\t\r"))


def prompt_text(title: Column, description: Column, venue: Column, dates: Column | None = None, source: Column | None = None) -> Column:
    lines = [F.concat(F.lit("Title: "), title), F.concat(F.lit("Description: "), F.coalesce(F.nullif(description, F.lit("")), F.lit("N/A"))), F.concat(F.lit("Venue: "), venue)]
    lines += [F.concat(F.lit(f"{n}: "), c) for n, c in (("Dates", dates), ("Source", source)) if c is not None]
    return F.concat_ws("\n", *lines)


def email_normalized(c: Column) -> Column:
    """Trimmed and in lower case; null if it is no address."""
    e = F.lower(F.trim(c))
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(e) <= 254), e)


def _meta(html: Column, key: str, name: str) -> Column:
    before = F.regexp_extract(html, rf"(?is)<meta[^>]*\b{key}\s*=\s*[\"']{name}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    after = F.regexp_extract(html, rf"(?is)<meta[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*\b{key}\s*=\s*[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))


def body_text(html: Column) -> Column:
    """Text of a page without scripts, styles, menus, headers and footers; adjacent elements are not parted."""
    c = html
    for tag in ("script", "style", "nav", "header", "footer"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    return F.trim(F.regexp_replace(plain_blanks(decoded(c)), r"\s+", " "))


def article_text(html: Column, most: int = 2000) -> Column:
    """Text of the content area if there is one, else of the body."""
    article = F.regexp_extract(html, r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)\s*>", 1)
    return F.left(body_text(F.when(article != "", article).otherwise(html)), F.lit(most))


def enrich_description(html: Column, url: Column, content_type: Column | None = None, most: int = 2000) -> Column:
    """The best description that a page offers: structured data, then social and plain meta, then the body; null if all are short."""
    ld = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    said = F.coalesce(F.get_json_object(ld, "$.description"), F.get_json_object(ld, "$.about"), F.get_json_object(ld, "$[0].description"), F.get_json_object(ld, "$[0].about"))
    structured = F.when(url.contains("eventbrite"), F.trim(F.regexp_replace(said, "<[^>]*>", "")))
    found = [structured, decoded(_meta(html, "property", "og:description")), decoded(_meta(html, "name", "description")), body_text(html)]
    best = F.coalesce(*[F.when(F.length(x) > 50, F.left(x, F.lit(most))) for x in found])
    return best if content_type is None else F.when(content_type.rlike("(?i)html|text/plain"), best)


def page_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.coalesce(decoded(_meta(html, "property", "og:title")), F.nullif(F.trim(decoded(title)), F.lit("")), F.lit("Untitled Event"))


def page_venue(html: Column, url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?i)https?://([^/?#:]+)", 1)
    return F.coalesce(decoded(_meta(html, "property", "og:site_name")), F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit("")))


def preview_description(html: Column, url: Column, most: int = 500) -> Column:
    """What a preview says of a page: its best description, or its meta tags' one however short; null if there is none."""
    meta = [F.nullif(decoded(_meta(html, k, n)), F.lit("")) for k, n in (("property", "og:description"), ("name", "description"))]
    return F.left(F.coalesce(enrich_description(html, url), *meta), F.lit(most))


def listing_block(when: Column, title: Column, venue: Column, blurb: Column, enriched: Column, raw: Column, tags: Column, url: Column) -> Column:
    """A listing as lines; empty ones are left out."""
    said = F.coalesce(F.nullif(blurb, F.lit("")), F.nullif(enriched, F.lit("")), F.left(raw, F.lit(500)))
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n", *[F.nullif(x, F.lit("")) for x in (when, title, venue, said, tag_line, url)])


def detail_block(start: Column, end: Column, title: Column, venue: Column, blurb: Column, enriched: Column, raw: Column, tags: Column, source: Column, url: Column) -> Column:
    """A listing in full; blank lines part its sections."""
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    dates = F.when(end.isNotNull() & (end != start), F.concat(iso(start), F.lit(" – "), iso(end))).otherwise(iso(start))
    said = F.coalesce(F.nullif(enriched, F.lit("")), F.nullif(blurb, F.lit("")), F.left(raw, F.lit(2000)), F.lit(""))
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n", title, dates, venue, F.lit(""), said, tag_line, F.lit(""), F.concat(F.lit("Source: "), source), url)
