"""Date functions on columns: one engine for the date texts of all sources, and calendar arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAY, YEAR, DASH = r"(\d{1,2})", r"(\d{4})", r"\s*[-–—]\s*"


def month_number(name: Column, short_only: bool = False) -> Column:
    """1 to 12, null for what is no month; short_only takes exactly Jan to Dec."""
    known = {m.capitalize() if short_only else m: i + 1 for i, m in enumerate(MONTHS)}
    if not short_only:
        known |= {m: i + 1 for i, m in enumerate(LONG_MONTHS)} | {"sept": 9}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(table, name if short_only else F.lower(name))


def built(year: Column, month: Column, day: Column) -> Column:
    """A date; null for an impossible one."""
    return F.try_to_date(F.format_string("%s-%02d-%s", year, month, F.lpad(day, 2, "0")), "yyyy-MM-dd")


@dataclass(frozen=True)
class Rule:
    """A pattern, and the start and end made of its groups. The first rule whose pattern fits and whose start is a date wins."""

    pattern: str
    start: Callable[[list[Column]], Column]
    end: Callable[[list[Column]], Column]


def _nothing(_: list[Column]) -> Column:
    return F.lit(None).cast("date")


def _date(y: int, m: int, d: int, short: bool = False) -> Callable[[list[Column]], Column]:
    return lambda g: built(g[y], month_number(g[m], short), g[d])


def _first_of_month(y: int, m: int) -> Callable[[list[Column]], Column]:
    return lambda g: built(g[y], month_number(g[m]), F.lit("1"))


def parsed(text: Column, rules: list[Rule], groups: int = 5) -> Column:
    """struct<start: date, end: date> by the first rule that fits, null if none does."""
    out = []
    for r in rules:
        g = [text, *[F.regexp_extract(text, r.pattern, k) if r.pattern.count("(") - r.pattern.count("(?") >= k else F.lit("") for k in range(1, groups + 1)]]
        start = r.start(g)
        out.append(F.when(text.rlike(r.pattern) & start.isNotNull(), F.struct(start.alias("start"), r.end(g).alias("end"))))
    return F.coalesce(*out)


W3 = r"(\w{3})"
DISPLAY = [
    Rule(rf"^{DAY}\s+{W3}\s+{YEAR}$", _date(3, 2, 1, True), _nothing),
    Rule(rf"^{DAY}{DASH}{DAY}\s+{W3}\s+{YEAR}$", _date(4, 3, 1, True), _date(4, 3, 2, True)),
    Rule(rf"^{DAY}\s+{W3}{DASH}{DAY}\s+{W3}\s+{YEAR}$", _date(5, 2, 1, True), _date(5, 4, 3, True)),
]
WORD = r"([A-Za-z]+)"
SCAPE = [
    Rule(rf"{DAY}\s+{WORD}\s*-\s*{DAY}\s+{WORD}\s+{YEAR}", _date(5, 2, 1), _date(5, 4, 3)),
    Rule(rf"{DAY}\s*-\s*{DAY}\s+{WORD}\s+{YEAR}", _date(4, 3, 1), _date(4, 3, 2)),
    Rule(rf"{DAY}\s+{WORD}\s+{YEAR}", _date(3, 2, 1), _nothing),
    Rule(rf"{WORD}\s*-\s*{WORD}\s+{YEAR}", _first_of_month(3, 1), _nothing),
    Rule(rf"{WORD}\s+{YEAR}", _first_of_month(2, 1), _nothing),
]
SINGLE = [Rule(rf"{DAY}\s+{WORD}\s+{YEAR}", _date(3, 2, 1), _nothing)]


def parse_display_date(text: Column, performance: Column) -> Column:
    """A day, or a range within or across months; else the first ten characters of the performance date."""
    fallback = F.struct(F.try_to_date(F.left(performance, F.lit(10)), "yyyy-MM-dd").alias("start"), F.lit(None).cast("date").alias("end"))
    return F.coalesce(parsed(F.trim(text), DISPLAY), fallback)


def parse_scape(text: Column) -> Column:
    """Day or month ranges after times of day are gone; months alone start on their first day and have no end."""
    # Fixed value: the times of day that go.
    clock = r"(?i),?\s*\d{1,2}:\d{2}\s*(?:am|pm)(?:\s*-\s*\d{1,2}:\d{2}\s*(?:am|pm))?"
    return parsed(F.trim(F.regexp_replace(text, clock, "")), SCAPE)


def parse_kallang(text: Column) -> Column:
    """Two dates with ' - ' between, or a list of days of one month, or a day."""
    days = F.filter(F.split(F.regexp_replace(F.regexp_extract(text, r"^([\d,\s&]+)\s+[A-Za-z]+\s+\d{4}", 1), "[&\\s]+", ","), ","), lambda d: d != "")
    month, year = (F.regexp_extract(text, r"^[\d,\s&]+\s+([A-Za-z]+)\s+(\d{4})", k) for k in (1, 2))
    several = F.struct(built(year, month_number(month), F.try_element_at(days, F.lit(1))).alias("start"), built(year, month_number(month), F.try_element_at(days, F.lit(-1))).alias("end"))
    sides = F.split(text, " - ")
    both = F.struct(parsed(F.get(sides, 0), SINGLE)["start"].alias("start"), parsed(F.get(sides, 1), SINGLE)["start"].alias("end"))
    return F.when(text.contains(" - "), both).when(F.size(days) > 1, several).otherwise(parsed(text, SINGLE))


def parse_srt(text: Column, today: Column) -> Column:
    """Also 'Now till' a day, with or without a year, and 'From' a day. A day without a year that is past is next year's."""

    def till(g: list[Column]) -> Column:
        this = built(F.year(today).cast("string"), month_number(g[2]), g[1])
        return F.when(this < today, built((F.year(today) + 1).cast("string"), month_number(g[2]), g[1])).otherwise(this)

    now = lambda end: lambda g: F.when(end(g).isNotNull(), today)
    with_year = _date(3, 2, 1)
    rules = [
        Rule(rf"^(?i)now\s+till\s+{DAY}\s+{WORD}\s+{YEAR}$", now(with_year), with_year),
        Rule(rf"^(?i)now\s+till\s+{DAY}\s+{WORD}$", now(till), till),
        Rule(rf"^(?i)from\s+{DAY}\s+{WORD}\s+{YEAR}$", with_year, _nothing),
        Rule(rf"{DAY}\s+{WORD}\s*[-–]\s*{DAY}\s+{WORD}\s+{YEAR}", _date(5, 2, 1), _date(5, 4, 3)),
        Rule(rf"{DAY}\s*[-–]\s*{DAY}\s+{WORD}\s+{YEAR}", _date(4, 3, 1), _date(4, 3, 2)),
        *SINGLE,
    ]
    return parsed(F.trim(text), rules)


def parse_long(text: Column) -> Column:
    return parsed(F.trim(text), [Rule(rf"^{DAY}\s+{WORD}\s+{YEAR}$", _date(3, 2, 1), _nothing)])["start"]


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def end_or_null(start: Column, end: Column) -> Column:
    return F.nullif(end, start)


def add_days(d: Column, n: int) -> Column:
    return F.date_add(d, n)


def monday_of(d: Column) -> Column:
    return F.to_date(F.date_trunc("week", d))


def sunday_of(d: Column) -> Column:
    return F.date_add(monday_of(d), 6)


def upcoming_friday(d: Column) -> Column:
    """This week's Friday on Friday and Saturday, else the next one."""
    n = F.dayofweek(d)  # Sunday is 1
    return F.date_add(d, F.when(n == 7, -1).otherwise(6 - n))


def digest_window(d: Column) -> tuple[Column, Column]:
    return d, F.date_add(d, 3)


def visible_week(d: Column, offset: int) -> tuple[Column, Column]:
    """Today to Sunday for the current week, else Monday to Sunday of the week at that offset."""
    if offset == 0:
        return d, sunday_of(d)
    start = F.date_add(monday_of(d), 7 * offset)
    return start, F.date_add(start, 6)


def header_label(d: Column) -> Column:
    return F.upper(F.date_format(d, "EEE d MMM"))


def compact_range(start: Column, end: Column) -> Column:
    """As 22 — 24 FEB or 28 FEB — 3 MAR, null for a single day."""
    month = lambda d: F.upper(F.date_format(d, "MMM"))
    day = lambda d: F.dayofmonth(d).cast("string")
    same = F.concat(day(start), F.lit(" — "), day(end), F.lit(" "), month(start))
    other = F.concat(day(start), F.lit(" "), month(start), F.lit(" — "), day(end), F.lit(" "), month(end))
    return F.when(end.isNull() | (end == start), None).when(month(start) == month(end), same).otherwise(other)


def short_label(d: Column) -> Column:
    return F.date_format(d, "d MMM")


def long_label(start: Column, end: Column) -> Column:
    said = lambda d: F.date_format(d, "EEE, d MMM yyyy")
    return F.when(end.isNull() | (end == start), said(start)).otherwise(F.concat(said(start), F.lit(" – "), said(end)))


def today_in(ts: Column, zone: str = "Asia/Singapore") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def recent_enough(start: Column, today: Column, days: int = 7) -> Column:
    return start >= F.date_sub(today, days)
