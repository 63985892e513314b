"""Main text of web pages after the removal of site templates.

Each page is read once into its blocks of text and the hashes of the element
subtrees around them; a subtree's hash is made of its own text and the hashes of
the subtrees in it. Spark counts the hashes by host over distinct main texts; a
subtree that is, with a confidence of 99.9 %, on at least `share` of a host's texts
belongs to the site and goes with all it holds, whatever it is called. Of what
lies in an article or in main nothing goes in that way, however often a heading or
a closing paragraph recurs; but an article as a whole, as a teaser is one, does if
the page has other text. Menus, headers, footers, asides, forms, adverts, notices and comments
are also known by element, role or class. A class counts only if all of its words
are known ones, so that "cookie-notice" does, and "no-sidebar" or "related-work"
don't; paragraphs, headings, lists' items and the like in an article are text
whatever their class, and its parts may be called header or related.

The main text is that of the article elements, or that of main if more of its
text lies outside of them than in all articles, else of main, else of the body.
A block ends where a block element starts or ends; white space in a block is one
space, and blocks are joined by line feeds in page order.

Texts are one if their longest blocks, which make up nine tenths of the
characters, are the same: reposts of an article with another advert, menu, title
or remark count once, so that the article doesn't look like a template.

Nulls: a null html gives an empty text, a null url is a host of its own.
Unclosed elements end with what holds them; time and memory are in proportion to
the page, however deep they nest. Very long pages are read whole. Repeated rows
give repeated rows. An empty table gives no rows. Columns other than page_id, url
and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to, new_path, saved, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter picture progress q rp rt ruby s samp small source span strike strong sub sup svg time tt u var wbr".split())
_DROPPED = frozenset("script style noscript template iframe head title nav header footer aside form button select textarea input svg canvas object embed audio video dialog menu option fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
_BESIDE = frozenset("area articles bar block bottom box button buttons container content form global group inner item items left links list main page panel post posts primary right row secondary section site slot stories top unit wrap wrapper".split())
_RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_WORDS = re.compile(r"[^a-z0-9]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: In an article these are text whatever their class says, and these words of a class say nothing.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre table tr td th figure figcaption".split())
_IN_ARTICLE = frozenset("header footer related banner teaser notice notices copyright disclaimer respond".split())
_WALLS = frozenset("html body article main section div table td th ul ol dl blockquote figure aside nav header footer form details".split())


def _unwanted(tag: str, raw: str, in_article: bool) -> bool:
    if tag in _DROPPED:
        return True
    known = _CLASSES - _IN_ARTICLE if in_article else _CLASSES
    if not raw or "=" not in raw and "hidden" not in raw:
        return False
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and tag not in ("html", "body") and not (in_article and tag in _TEXT):
            for said in value.split():
                words = [w for w in _WORDS.split(said) if w and not w.isdigit()]
                if not known.isdisjoint(words) and all(w in known or w in _BESIDE for w in words):
                    return True
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class _Open:
    """The open elements: tag, whether it starts unwanted content, its number, its hash so far. Where the last of a kind is, is known without a search."""

    def __init__(self) -> None:
        self.stack: list[list] = []
        self.by_tag: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.cells: list[int] = []  # those walls that are cells of a table
        self.blocks: list[int] = []

    def push(self, element: list) -> None:
        tag, depth = element[0], len(self.stack)
        self.stack.append(element)
        self.by_tag.setdefault(tag, []).append(depth)
        if tag in ("td", "th"):
            self.cells.append(depth)
        elif tag in _WALLS:
            self.walls.append(depth)
        if tag not in _INLINE:
            self.blocks.append(depth)

    def pop(self) -> list:
        element = self.stack.pop()
        depth = len(self.stack)
        self.by_tag[element[0]].pop()
        for kept in (self.walls, self.cells, self.blocks):
            if kept and kept[-1] == depth:
                kept.pop()
        return element

    def last(self, *tags: str) -> int:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=-1)

    def wall(self, cells: bool = True) -> int:
        """The last element that an end or a start of an element in it doesn't reach past."""
        return max(self.walls[-1] if self.walls else -1, self.cells[-1] if cells and self.cells else -1)


def read_page(html: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The blocks of the main text in page order, each with the number of the element it lies in and that of the outermost
    article, else main, around it, -1 if none; of each element the number of the one around it, -1 if none, and its subtree's hash."""
    import xxhash

    open_ = _Open()
    stack = open_.stack
    around: list[int] = []
    hashes: list[int] = []
    blocks: list[tuple[str, int, int, bool, bool]] = []
    text: list[str] = []
    held: list[list[str]] = []
    dropped = articles = mains = 0
    article = main_at = -1

    def flush() -> None:
        if text:
            said = " ".join(unescape("".join(text)).split())
            text.clear()
            if said and stack:
                stack[-1][3].update(said.encode("utf-8", "surrogatepass"))
            if said and not dropped:
                blocks.append((said, stack[-1][2] if stack else -1, article if articles else main_at, articles > 0, mains > 0))

    def close_to(depth: int) -> None:
        nonlocal dropped, articles, mains, main_at
        while len(stack) > depth:
            if stack[-1][0] not in _INLINE or stack[-1][1]:
                flush()
            tag, bad, number, own = open_.pop()
            if bad and tag in _INLINE:
                text[:] = held.pop()
            hashes[number] = own.intdigest() - (1 << 63)
            if stack:
                stack[-1][3].update(own.digest())
            dropped -= bad
            articles -= tag == "article"
            mains -= tag == "main"
            if not mains:
                main_at = -1

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in _INLINE:
                flush()
            depth = open_.last(tag)
            if depth < 0 or tag not in _WALLS and open_.wall() > depth:
                continue
            if tag not in _INLINE or not open_.blocks or open_.blocks[-1] < depth:
                close_to(depth)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE:
            flush()
            depth = open_.last("p", *_CLOSES.get(tag, ()))
            if depth >= 0 and depth >= open_.wall(cells=tag not in ("tr", "td", "th")):
                close_to(depth)
        if tag in _VOID or m[3].endswith("/") and tag == "svg":
            continue
        if tag in _RAW:
            end = _RAW_ENDS[tag].search(html, at)
            at = end.end() if end else n
            continue
        bad = _unwanted(tag, m[3], articles > 0)
        if bad and tag in _INLINE:
            # it parts no block: what was said before it goes on after it
            held.append(text[:])
            text.clear()
        elif bad:
            flush()
        around.append(stack[-1][2] if stack else -1)
        hashes.append(0)
        open_.push([tag, bad, len(around) - 1, xxhash.xxh3_64(m[0].encode("utf-8", "surrogatepass"))])
        dropped += bad
        if tag == "article" and not articles:
            article = len(around) - 1
        if tag == "main" and not mains:
            main_at = len(around) - 1
        articles += tag == "article"
        mains += tag == "main"
    flush()
    close_to(0)
    flush()
    size = lambda some: sum(len(b[0]) for b in some)
    inside, main = [b for b in blocks if b[3]], [b for b in blocks if b[4]]
    # an article that is less than what main has around it is not the main text
    chosen = main if size([b for b in main if not b[3]]) > size(inside) else inside or main or blocks
    return [b[:3] for b in chosen], list(zip(around, hashes, strict=True))


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


PARSED = "page_id long, url string, host string, main long, blocks array<struct<text:string,at:int,article:int>>, elements array<struct<around:int,subtree:bigint>>"


def longest_blocks(texts: list[str]) -> list[str]:
    """The longest blocks, as many as make up nine tenths of the characters, in order of their text."""
    left = 9 * sum(map(len, texts)) / 10
    out = []
    for t in sorted(texts, key=lambda t: (-len(t), t)):
        if left <= 0:
            break
        left -= len(t)
        out.append(t)
    return sorted(out)


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        block = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("article", pa.int32())]))
        element = pa.list_(pa.struct([("around", pa.int32()), ("subtree", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                urls = some.column("url").to_pylist()
                read = [read_page(h or "") for h in some.column("html").to_pylist()]
                mains = [xxhash.xxh3_64_intdigest("\n".join(longest_blocks([b[0] for b in blocks])).encode("utf-8", "surrogatepass")) - (1 << 63) for blocks, _ in read]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": some.column("page_id"), "url": some.column("url"), "host": [host_of(u) for u in urls], "main": pa.array(mains, pa.int64()),
                        "blocks": pa.array([[{"text": t, "at": e, "article": a} for t, e, a in blocks] for blocks, _ in read], block), "elements": pa.array([[{"around": a, "subtree": h} for a, h in elements] for _, elements in read], element),
                    }
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, PARSED)


def least_share(seen: F.Column, pages: F.Column, z: float = 3.29) -> F.Column:
    """The share that `seen` of `pages` prove (Wilson's lower bound, of 99.9 %)."""
    p, over = seen / pages, z * z / pages
    return (p + over / 2 - z * F.sqrt(p * (1 - p) / pages + over / pages / 4)) / (1 + over)


def templates(parsed: DataFrame, hosts: DataFrame, share: float, total: int) -> DataFrame:
    """host and subtree of what recurs in many distinct main texts of a host. hosts: host, its main texts and its rows."""
    held = parsed.select("host", "main", F.explode(F.array_distinct("elements.subtree")).alias("subtree")).distinct()
    counted = held.groupBy("host", "subtree").agg(F.count("*").alias("seen")).where("seen > 1")
    return joined_to(counted, hosts, ["host"], "rows", total).where(least_share(F.col("seen"), F.col("mains")) >= share).select("host", "subtree")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of pages without the elements whose subtrees are gone."""
    for batch in batches:
        out = []
        for blocks, elements, gone in zip(*(batch.column(c).to_pylist() for c in ("blocks", "elements", "gone")), strict=True):
            lost, without = [], frozenset(gone or ())
            for e in elements:  # an element comes after the one around it
                lost.append(e["subtree"] in without or e["around"] >= 0 and lost[e["around"]])
            # an article goes as a whole, and only if others stay
            some = any(b["article"] >= 0 and not lost[b["article"]] for b in blocks)
            gone_of = lambda b, some=some, lost=lost: (some and lost[b["article"]]) if b["article"] >= 0 else b["at"] >= 0 and lost[b["at"]]
            out.append("\n".join(b["text"] for b in blocks if not gone_of(b)))
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": pa.array([len(t) for t in out], pa.int64())})


def main_text(pages: DataFrame, share: float = 0.3) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    spark = pages.sparkSession
    small_batches(spark)
    path = new_path(spark, "parsed")
    _parsed(pages).write.option("compression", "zstd").parquet(path)
    parsed = spark.read.schema(PARSED).parquet(path)
    hosts = saved(parsed.groupBy("host").agg(F.count_distinct("main").alias("mains"), F.count("*").alias("rows")), "hosts")
    total = max(1, parsed.count())
    # a template is on a share of its host's pages, so that a host has few for each element of a page
    by_host = templates(parsed, hosts, share, total).groupBy("host").agg(F.collect_set("subtree").alias("gone"))
    facts = saved(hosts.join(by_host, "host", "left"), "templates")
    met = joined_to(parsed.select("page_id", "url", "host", "blocks", "elements"), facts.select("host", "rows", "gone"), ["host"], "rows", total)
    return met.select("page_id", "url", "blocks", "elements", "gone").mapInArrow(_without, "page_id long, url string, text string, n_chars long")
