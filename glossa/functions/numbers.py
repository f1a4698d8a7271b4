"""Numbers, dates, seasons and measurements in words, and their normal forms.

Dates are text, `YYYY-MM-DD` with X for what isn't known; ranges are two dates joined by ` -- `. Numbers in norms are
written as doubles, `2.0`. The recogniser is a grammar of the rule engine whose actions give mentions their norms.
"""

from __future__ import annotations

import calendar
import datetime
import re
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from glossa.plans.lineage import spread
from glossa.plans.rules import Mention, State, extract_from, read_rules

# English number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "dozen": 12}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m}
UNKNOWN_DATE, REFERENCE = "XXXX-XX-XX", "ref-date"
#: First and last day of a season, as month and day.
# Fixed values.
SEASONS = {"winter": ((12, 21), (3, 20)), "spring": ((3, 20), (6, 21)), "summer": ((6, 21), (9, 22)), "autumn": ((9, 22), (12, 21)), "fall": ((9, 22), (12, 21))}
#: First and last day of the weeks of a month, but for the last ones, which are counted back from its end. Fixed values.
WEEKS = {"first week": (1, 7), "second week": (8, 14), "third week": (15, 21), "fourth week": (22, 28), "first two weeks": (1, 14), "second two weeks": (15, 28)}
LAST_WEEKS = {"last week": 6, "last two weeks": 13, "last three weeks": 20}
#: Holidays on a fixed day.
HOLIDAYS = {"christmas": (12, 25), "christmas eve": (12, 24), "halloween": (10, 31), "independence day": (7, 4), "valentine 's day": (2, 14), "new year 's eve": (12, 31), "new year 's day": (1, 1), "boxing day": (12, 26)}
#: Holidays on a weekday of a month: month, weekday (Monday is 0), and which of them (-1: the last).
WEEKDAY_HOLIDAYS = {
    "martin luther king day": (1, 0, 3), "presidents day": (2, 0, 3), "mothers day": (5, 6, 2), "memorial day": (5, 0, -1), "fathers day": (6, 6, 3),
    "labor day": (9, 0, 1), "columbus day": (10, 0, 2), "thanksgiving": (11, 3, 4),
}
#: Holidays at a number of days from Easter Sunday.
EASTER_HOLIDAYS = {"ash wednesday": -46, "palm sunday": -7, "good friday": -2, "easter": 0, "easter sunday": 0, "easter monday": 1, "ascension day": 39, "pentecost": 49, "corpus christi": 60}
#: Unit to its canonical name and class.
MEASURES = {
    "km": ("km", "LENGTH"), "kilometer": ("km", "LENGTH"), "kilometre": ("km", "LENGTH"), "m": ("m", "LENGTH"), "meter": ("m", "LENGTH"), "metre": ("m", "LENGTH"), "cm": ("cm", "LENGTH"), "mm": ("mm", "LENGTH"),
    "mile": ("mile", "LENGTH"), "kg": ("kg", "WEIGHT"), "kilogram": ("kg", "WEIGHT"), "g": ("g", "WEIGHT"), "gram": ("g", "WEIGHT"), "t": ("t", "WEIGHT"), "ton": ("t", "WEIGHT"), "tonne": ("t", "WEIGHT"),
    "ha": ("ha", "AREA"), "hectare": ("ha", "AREA"), "acre": ("acre", "AREA"), "l": ("l", "VOLUME"), "liter": ("l", "VOLUME"), "litre": ("l", "VOLUME"), "day": ("d", "TIME"), "hour": ("h", "TIME"), "year": ("year", "TIME"), "month": ("month", "TIME"),
    "foot": ("ft", "LENGTH"), "feet": ("ft", "LENGTH"), "ft": ("ft", "LENGTH"), "inch": ("in", "LENGTH"), "inches": ("in", "LENGTH"), "yard": ("yd", "LENGTH"), "pound": ("lb", "WEIGHT"), "lb": ("lb", "WEIGHT"),
    "ounce": ("oz", "WEIGHT"), "oz": ("oz", "WEIGHT"), "gallon": ("gal", "VOLUME"), "second": ("s", "TIME"), "minute": ("min", "TIME"), "week": ("week", "TIME"),
}
for _short, _long in (("k", "kilo"), ("h", "hecto"), ("d", "deci"), ("c", "centi"), ("m", "milli")):  # metric prefixes
    for _base, _names, _class in (("m", ("meter", "metre"), "LENGTH"), ("g", ("gram",), "WEIGHT"), ("l", ("liter", "litre"), "VOLUME")):
        for _name in (_short + _base, *(_long + n for n in _names)):
            MEASURES.setdefault(_name, (_short + _base, _class))
del MEASURES["dm"], MEASURES["dl"], MEASURES["dg"], MEASURES["hm"]  # also found as other abbreviations


def _numeric(word: str) -> float | None:
    word = re.sub(r"(st|nd|rd|th|s)$", "", word.replace(",", "").replace("+", ""))
    try:
        if m := re.fullmatch(r"([-]?[\d.]+)/(\d+)", word):
            return float(m[1]) / float(m[2])
        return float(word)
    except (ValueError, ZeroDivisionError):
        return None


def _ordinal(word: str) -> str:
    if word in ORDINALS:
        return next(w for w, n in UNITS.items() if n == ORDINALS[word])
    if word.endswith("tieth"):
        return word[:-4] + "y"
    return word[:-2] if word.endswith("th") and (word[:-2] in UNITS or word[:-2] in SCALES) else word


def parse_number(words: list[str]) -> float | None:
    """The number that tokens stand for: digits, words, both mixed, or a fraction; None if they stand for none."""
    parts = [p for w in words for p in (re.split("-", w.lower()) if re.fullmatch(r"[a-zA-Z]+-[a-zA-Z]+", w) else [w.lower()])]
    sign = 1.0
    if parts and parts[0] in ("-", "minus", "negative", "+"):
        sign, parts = (1.0 if parts[0] == "+" else -1.0), parts[1:]
    if not parts:
        return None
    if "/" in parts and parts.count("/") == 1:
        i = parts.index("/")
        a, b = parse_number(parts[:i]), parse_number(parts[i + 1 :])
        return sign * a / b if a is not None and b else None
    total = group = 0.0
    seen = False
    for i, p in enumerate(parts):
        p = _ordinal(p)
        if p == "and" and seen:
            continue
        if p in ("a", "an") and i == 0 and len(parts) > 1:
            group, seen = 1.0, True
        elif p in UNITS or p in TENS:
            group, seen = group + (UNITS.get(p) if p in UNITS else TENS[p]), True
        elif (scale := SCALES.get(p) or SCALES.get(p.removesuffix("s"))) is not None:
            group, seen = (group or 1.0) * scale, True
            if scale >= 1000:
                total, group = total + group, 0.0
        elif (n := _numeric(p)) is not None:
            group, seen = group + n, True
        else:
            return None
    return sign * (total + group) if seen else None


def make_date(day=None, month=None, year=None, approx: bool = False) -> str:
    """`YYYY-MM-DD`; parts that are missing or 0 are X, short years get X in front. month: a number or a name."""
    if isinstance(month, str) and not month.isdigit():
        month = next((n for name, n in MONTHS.items() if name[:3] == month.lower()[:3]), None)
    part = lambda x, n: str(int(x)).zfill(n) if x not in (None, "") and int(x) else "X" * n
    y = str(year).rjust(4, "X") if year not in (None, "", 0) else "XXXX"
    return f"{y}-{part(month, 2)}-{part(day, 2)}" + (" [APPROX]" if approx else "")


def span(a: str, b: str) -> str:
    """A range; an unknown year of its start is that of its end."""
    if a.startswith("XXXX") and a != UNKNOWN_DATE and re.match(r"\d{4}", b):
        a = b[:4] + a[4:]
    return f"{a} -- {b}"


def season_range(season: str, year: int | None = None) -> str:
    """First and last day of a season; one that turns the year ends in the next."""
    (m1, d1), (m2, d2) = SEASONS[season.lower()]
    return f"{make_date(d1, m1, year)} -- {make_date(d2, m2, year + 1 if year and m2 < m1 else year)}"


def easter(year: int) -> datetime.date:
    """Easter Sunday of the Gregorian calendar."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    month, day = divmod(h + w - 7 * ((a + 11 * h + 22 * w) // 451) + 114, 31)
    return datetime.date(year, month, day + 1)


def holiday_date(name: str, year: int | None) -> str | None:
    """The day of a holiday; a movable one has none without a year."""
    name = name.lower()
    if name in HOLIDAYS:
        month, day = HOLIDAYS[name]
        return make_date(day, month, year)
    if year is None:
        return None
    if name in EASTER_HOLIDAYS:
        return (easter(year) + datetime.timedelta(EASTER_HOLIDAYS[name])).isoformat()
    month, weekday, which = WEEKDAY_HOLIDAYS[name]
    days = [d for d in calendar.Calendar().itermonthdates(year, month) if d.month == month and d.weekday() == weekday]
    return days[which - (which > 0)].isoformat()


def season_end(season: str, year: int | None) -> str:
    return season_range(season, year).split(" -- ")[1]


def season_start(season: str, year: int | None) -> str:
    return season_range(season, year).split(" -- ")[0]


def week_days(week: str, month: int) -> tuple[int, int]:
    """First and last day of the weeks that words name; the last ones from the month's length in a year of 365 days."""
    week = week.lower()
    if week in LAST_WEEKS:
        end = calendar.monthrange(2001, month)[1]
        return end - LAST_WEEKS[week], end
    for short, long in (("1st", "first"), ("2nd", "second"), ("3rd", "third"), ("4th", "fourth")):
        week = week.replace(short, long)
    return WEEKS[week if week in WEEKS else week.split()[0] + " week"]


def part_of(date: str, part: float) -> str:
    """A day, or a month, at a share of a month or year: 0 its start, 0.5 its middle, 1 its end."""
    y, m, d = date[:10].split("-")
    if d == "XX" and m != "XX":
        days = calendar.monthrange(int(y) if y.isdigit() else 2001, int(m))[1]
        return make_date(max(1, int(days * part)), m, y)
    return make_date(None, max(1, int(12 * part)), y) if m == "XX" else date


def unit_norm(words: list[str]) -> tuple[str, str | None]:
    """Canonical unit and its class; an unknown one is its own name without a class."""
    text = " ".join(words).lower()
    return MEASURES.get(text) or MEASURES.get(text.removesuffix("s")) or (text, None)


_MONTH = "|".join(f"{m}|{m[:3]}[.]?" for m in MONTHS)
_HOLIDAYS = " | ".join(" ".join(f"[word=/(?i)^{w}$/]" for w in name.split()) for name in sorted([*HOLIDAYS, *WEEKDAY_HOLIDAYS, *EASTER_HOLIDAYS], key=lambda n: (-len(n.split()), n)))
GRAMMAR = f"""
vars:
  num: '/^[+-]?([0-9][0-9,]*([.][0-9]+)?|[.][0-9]+)$/'
  numword: '/(?i)^({"|".join([*UNITS, *TENS, *SCALES])})(-[a-z]+)?$/'
  month: '/(?i)^({_MONTH})$/'
  season: '/(?i)^({"|".join(SEASONS)})$/'
  year: '/^(1[0-9]|20)[0-9][0-9]$/'
  day: '/^([1-9]|[12][0-9]|3[01])(st|nd|rd|th)?$/'
rules:
- {{name: number, label: NUMBER, type: token, priority: 1, action: number, pattern: "([word=${{num}}] [word=${{numword}}]* | [word=${{numword}}] (and? [word=${{numword}}])*)"}}
- {{name: number-range, label: NUMBER-RANGE, type: token, priority: 2, action: range, pattern: "@a:NUMBER [word=/^(-|to)$/] @b:NUMBER | [word=between] @a:NUMBER and @b:NUMBER"}}
- {{name: one-token-range, label: NUMBER-RANGE, type: token, priority: 2, action: range, pattern: "[word=/^[0-9]+-[0-9]+$/]"}}
- {{name: ymd, label: DATE, type: token, priority: 3, action: date, pattern: "[word=/^[0-9]{{4}}[-\\\\/][0-9]{{1,2}}[-\\\\/][0-9]{{1,2}}$/]"}}
- {{name: dmy, label: DATE, type: token, priority: 3, action: date, pattern: "[word=/^[0-9]{{1,2}}[-\\\\/][0-9]{{1,2}}[-\\\\/][0-9]{{4}}$/]"}}
- {{name: month-day-year, label: DATE, type: token, priority: 3, action: date, pattern: "(?<month>[word=${{month}}]) (?<day>[word=${{day}}]) (','? (?<year>[word=${{year}}]))?"}}
- {{name: day-month-year, label: DATE, type: token, priority: 3, action: date, pattern: "(?<day>[word=${{day}}]) of? (?<month>[word=${{month}}]) (','? (?<year>[word=${{year}}]))?"}}
- {{name: month-year, label: DATE, type: token, priority: 3, action: date, pattern: "(?<month>[word=${{month}}]) (',' | of)? (?<year>[word=${{year}}])"}}
- {{name: month, label: DATE, type: token, priority: 3, action: date, pattern: "(?<=[word=/(?i)^(in|of|since|until|by|during|from|to|before|after)$/]) (?<month>[word=${{month}}]) (?![word=${{day}}] | [word=${{year}}])"}}
- {{name: in-year, label: DATE, type: token, priority: 3, action: date, pattern: "(?<=[word=/(?i)^(in|since|until|by|during|from|to|before|after)$/]) (?<year>[word=${{year}}])"}}
- {{name: holiday, label: DATE, type: token, priority: 3, action: holiday, pattern: "(?<holiday>{_HOLIDAYS}) ([word=/(?i)^(in|of|,)$/]? (?<year>[word=${{year}}]))?"}}
- {{name: ym, label: DATE, type: token, priority: 3, action: date, pattern: "[word=/^[0-9]{{4}}[-\\\\/][0-9]{{1,2}}$/]"}}
- {{name: my, label: DATE, type: token, priority: 3, action: date, pattern: "[word=/^[0-9]{{1,2}}[-\\\\/][0-9]{{4}}$/]"}}
- {{name: short-ymd, label: DATE, type: token, priority: 3, action: date, pattern: "[word=/^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}$/]"}}
- {{name: years, label: DATE-RANGE, type: token, priority: 3, action: years, pattern: "[word=/^(1[0-9]|20)[0-9][0-9]-(1[0-9]|20)[0-9][0-9]$/]"}}
- {{name: vague-season, label: DATE-RANGE, type: token, priority: 3, action: years, pattern: "[word=/^(1[0-9]|20)[0-9][0-9](WS|DS)$/]"}}
- {{name: months, label: DATE-RANGE, type: token, priority: 5, action: months, pattern: "[word=/(?i)^(from|between)$/]? (?<m1>[word=${{month}}]) [word=/(?i)^(to|until|and|-)$/] (?<m2>[word=${{month}}]) (',' | of | in)? (?<year>[word=${{year}}])"}}
- {{name: days, label: DATE-RANGE, type: token, priority: 5, action: days, pattern: "[word=/(?i)^(from|between)$/] (?<number>[word=${{day}}]) [word=/(?i)^(to|until|and|-)$/] @b:DATE"}}
- {{name: week, label: DATE-RANGE, type: token, priority: 5, action: week, pattern: "(?<week>[word=/(?i)^(first|1st|second|2nd|third|3rd|fourth|4th|last)$/] [word=/(?i)^week$/] | [word=/(?i)^(first|second|last)$/] [word=/(?i)^(two|three)$/] [word=/(?i)^weeks$/]) of (?<month>[word=${{month}}])"}}
- {{name: weeks, label: DATE-RANGE, type: token, priority: 5, action: weeks, pattern: "[word=/(?i)^between$/] [word=/(?i)^the$/]? (?<w1>[word=/(?i)^(first|1st|second|2nd)$/]) [word=/(?i)^week$/]? [word=/(?i)^(and|to)$/] [word=/(?i)^the$/]? (?<w2>[word=/(?i)^(second|2nd|third|3rd|fourth|4th|last)$/]) [word=/(?i)^weeks?$/] of (?<month>[word=${{month}}])"}}
- {{name: season, label: DATE-RANGE, type: token, priority: 3, action: season, pattern: "(?<season>[word=${{season}}]) [word=/(?i)^(in|of)$/]? (?<year>[word=${{year}}]) | (?<year>[word=${{year}}]) (?<season>[word=${{season}}])"}}
- {{name: seasons, label: DATE-RANGE, type: token, priority: 5, action: seasons, pattern: "[word=/(?i)^(from|between)$/]? (?<s1>[word=${{season}}]) (?<y1>[word=${{year}}])? [word=/(?i)^(to|and|-)$/] (?<s2>[word=${{season}}]) [word=/(?i)^(in|of)$/]? (?<y2>[word=${{year}}])"}}
- {{name: season-since, label: DATE-RANGE, type: token, priority: 5, action: season-open, pattern: "[word=/(?i)^(since|from)$/] (?<season>[word=${{season}}]) [word=/(?i)^(in|of)$/]? (?<year>[word=${{year}}])?"}}
- {{name: season-until, label: DATE-RANGE, type: token, priority: 5, action: season-open, pattern: "[word=/(?i)^(until|through)$/] (?<season>[word=${{season}}]) [word=/(?i)^(in|of)$/]? (?<year>[word=${{year}}])?"}}
- {{name: season-before, label: DATE-RANGE, type: token, priority: 5, action: season-open, pattern: "[word=/(?i)^(before|prior|previous)$/] to? (?<season>[word=${{season}}]) [word=/(?i)^(in|of)$/]? (?<year>[word=${{year}}])?"}}
- {{name: season-after, label: DATE-RANGE, type: token, priority: 5, action: season-open, pattern: "[word=/(?i)^(after|beyond|following)$/] (?<season>[word=${{season}}]) [word=/(?i)^(in|of)$/]? (?<year>[word=${{year}}])?"}}
- {{name: part, label: DATE, type: token, priority: 4, action: part, pattern: "[word=/(?i)^(start|beginning|middle|mid|end)$/] of? @date:DATE"}}
- {{name: approx, label: DATE, type: token, priority: 4, action: approx, pattern: "[word=/(?i)^(around|about|circa)$/] @date:DATE"}}
- {{name: from-to, label: DATE-RANGE, type: token, priority: 5, action: dates, pattern: "[word=/(?i)^(from|between)$/] @a:DATE [word=/^(to|until|and|-)$/] @b:DATE"}}
- {{name: since, label: DATE-RANGE, type: token, priority: 5, action: dates, pattern: "[word=/(?i)^since$/] @a:DATE"}}
- {{name: until, label: DATE-RANGE, type: token, priority: 5, action: dates, pattern: "[word=/(?i)^(until|till)$/] @b:DATE"}}
- {{name: before, label: DATE-RANGE, type: token, priority: 5, action: dates, pattern: "[word=/(?i)^before$/] @b:DATE"}}
- {{name: after, label: DATE-RANGE, type: token, priority: 5, action: dates, pattern: "[word=/(?i)^after$/] @a:DATE"}}
- {{name: percentage, label: PERCENTAGE, type: token, priority: 6, action: measure, pattern: "@n:NUMBER [word=/^(%|percent)$/]"}}
- {{name: measurement, label: MEASUREMENT, type: token, priority: 6, action: measure, pattern: "@n:NUMBER (?<unit>[word=/(?i)^({"|".join(u for u in MEASURES if len(u) > 1)}|m|g|t|l)s?$/])"}}
- {{name: measurement-range, label: MEASUREMENT, type: token, priority: 6, action: measure, pattern: "@n:NUMBER-RANGE (?<unit>[word=/(?i)^({"|".join(u for u in MEASURES if len(u) > 1)}|m|g|t|l)s?$/])"}}
"""
_RULES: list = []


def _normed(m: Mention, norm: str | None, label: str | None = None) -> list[Mention]:
    return [] if norm is None else [replace(m, labels=(label or m.label,), attachments=(("norm", norm),))]


def norm_of(m: Mention) -> str | None:
    return dict(m.attachments).get("norm")


def _actions(words: list[list[str]]) -> dict:
    def text(m: Mention) -> list[str]:
        return words[m.sent][m.start : m.end]

    def first(m: Mention, role: str) -> str | None:
        return " ".join(text(m.of(role)[0])) if m.of(role) else None

    def known(m: Mention, role: str) -> str | None:
        return norm_of(m.of(role)[0]) if m.of(role) else None

    def number(m: Mention):
        n = parse_number(text(m))
        return _normed(m, None if n is None else str(n))

    def number_range(m: Mention):
        a, b = (known(m, "a"), known(m, "b")) if m.of("a") else map(lambda x: str(float(x)), text(m)[0].split("-"))
        return _normed(m, f"{a} -- {b}")

    def date(m: Mention):
        w = text(m)
        if m.found_by == "ymd":
            y, mo, d = re.split("[-/]", w[0])
        elif m.found_by == "dmy":
            d, mo, y = re.split("[-/]", w[0])
        elif m.found_by == "ym":
            (y, mo), d = re.split("[-/]", w[0]), None
        elif m.found_by == "my":
            (mo, y), d = re.split("[-/]", w[0]), None
        elif m.found_by == "short-ymd":
            y, mo, d = w[0].split("-")
        else:
            d, mo, y = (first(m, r) for r in ("day", "month", "year"))
            d = re.sub("[a-z]+$", "", d) if d else None
        if not str(mo or 0).isalpha() and str(mo or 0).isdigit() and int(mo or 0) > 12 or int(d or 0) > 31:
            return []
        return _normed(m, make_date(d, mo.rstrip(".") if isinstance(mo, str) else mo, y))

    def dates(m: Mention):
        a, b = known(m, "a"), known(m, "b")
        open_ = {"since": (a, REFERENCE), "until": (REFERENCE, b), "before": (UNKNOWN_DATE, b), "after": (a, UNKNOWN_DATE)}.get(m.found_by, (a, b))
        return _normed(m, span(*open_))

    def part(m: Mention):
        share = {"start": 0.0, "beginning": 0.0, "middle": 0.5, "mid": 0.5, "end": 1.0}[text(m)[0].lower()]
        return _normed(m, part_of(known(m, "date"), share))

    def measure(m: Mention):
        unit, kind = unit_norm(text(m.of("unit")[0])) if m.of("unit") else ("%", None)
        return _normed(m, f"{known(m, 'n')} {unit}", f"MEASUREMENT-{kind}" if kind else m.label)

    def year_of(m: Mention, role: str = "year") -> int | None:
        return int(first(m, role)) if m.of(role) else None

    def years(m: Mention):
        w = text(m)[0]
        a, b = w.split("-") if "-" in w else (w[:4], w[:4])
        return _normed(m, f"{make_date(None, None, a)} -- {make_date(None, None, b)}")

    def months(m: Mention):
        return _normed(m, " -- ".join(make_date(None, first(m, r).rstrip("."), first(m, "year")) for r in ("m1", "m2")))

    def days(m: Mention):
        b, n = known(m, "b"), int(re.sub("[a-z]+$", "", first(m, "number")))
        return _normed(m, f"{b[:8]}{n:02} -- {b}") if re.fullmatch(r"[0-9X]{4}-[0-9]{2}-[0-9]{2}", b) else []

    def of_month(m: Mention, *weeks: str):
        month = int(make_date(None, first(m, "month").rstrip("."))[5:7])
        a, b = week_days(weeks[0], month)[0], week_days(weeks[-1], month)[1]
        return _normed(m, f"{make_date(a, month)} -- {make_date(b, month)}")

    def seasons(m: Mention):
        y2 = year_of(m, "y2")
        return _normed(m, f"{season_end(first(m, 's1'), year_of(m, 'y1') or y2)} -- {season_start(first(m, 's2'), y2)}")

    def season_open(m: Mention):
        s, y = first(m, "season"), year_of(m)
        a, b = {
            "season-since": (season_end(s, y), REFERENCE), "season-until": (REFERENCE, season_start(s, y)),
            "season-before": (UNKNOWN_DATE, season_start(s, y)), "season-after": (season_end(s, y), UNKNOWN_DATE),
        }[m.found_by]
        return _normed(m, f"{a} -- {b}")

    each = {
        "holiday": lambda m: _normed(m, holiday_date(first(m, "holiday"), year_of(m))), "years": years, "months": months, "days": days,
        "week": lambda m: of_month(m, first(m, "week")), "weeks": lambda m: of_month(m, first(m, "w1") + " week", first(m, "w2") + " week"),
        "seasons": seasons, "season-open": season_open, "season": lambda m: _normed(m, season_range(first(m, "season"), year_of(m))),
        "number": number, "range": number_range, "date": date, "dates": dates, "part": part, "measure": measure,
        "approx": lambda m: _normed(m, known(m, "date") + " [APPROX]"),
    }

    def safe(f):
        def act(ms: list[Mention], _: State) -> list[Mention]:
            out = []
            for m in ms:
                try:
                    out += f(m)
                except (ValueError, KeyError, TypeError, IndexError):
                    continue  # what can't be normalised isn't a mention
            return out

        return act

    return {k: safe(f) for k, f in each.items()}


def recognise(sentences: list[list[str]]) -> list[tuple[int, int, int, str, str]]:
    """(sentence, start, end, label, norm) of numeric mentions that no other contains."""
    if not _RULES:
        _RULES.extend(read_rules(GRAMMAR))
    found = [m for m in extract_from([{"words": s} for s in sentences], _RULES, _actions(sentences)) if norm_of(m)]
    order = {m: i for i, m in enumerate(found)}
    holds = lambda a, b: a.sent == b.sent and a.start <= b.start and a.end >= b.end and ((a.end - a.start, order[a]) > (b.end - b.start, order[b]))
    kept = [m for m in found if not any(holds(o, m) for o in found if o is not m)]
    return sorted((m.sent, m.start, m.end, m.label, norm_of(m)) for m in kept)


def label_tokens(words: list[str], found: list[tuple[int, int, str, str]]) -> tuple[list[str], list[str]]:
    """BIO labels and norms of a sentence's tokens."""
    labels, norms = ["O"] * len(words), [""] * len(words)
    for start, end, label, norm in found:
        for i in range(start, end):
            labels[i], norms[i] = ("B-" if i == start else "I-") + label, norm
    return labels, norms


NORMS = ArrayType(StructType([StructField("label", StringType()), StructField("norm", StringType())]))


def _norms(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"label": r[3], "norm": r[4]} for r in recognise([t.split()])] if t else [] for t in texts], dtype=object)


@F.pandas_udf(NORMS)
def norms_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The numeric mentions of each text, whose tokens blanks part; the grammar is read once a worker."""
    for batch in texts:
        yield _norms(batch)


def _normed_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(_norms=_norms(batch["_said"]))


def with_norms(rows: DataFrame, text: str, out: str = "norms") -> DataFrame:
    """rows with `out`, the numeric mentions of `text` as norms_of gives them. Each different text is recognised once, wherever its rows are."""
    different = rows.select(F.col(text).alias("_said")).where("_said is not null").distinct()
    normed = spread(different).mapInPandas(_normed_texts, different.schema.add("_norms", NORMS))  # which no filter is moved through
    joined = rows.join(normed, F.col(text) == F.col("_said"), "left")
    return joined.select(*(rows[c] for c in rows.columns), F.coalesce("_norms", F.array().cast(normed.schema["_norms"].dataType)).alias(out))


@F.pandas_udf(DoubleType())
def numbers_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The number that each text's words stand for; null if they stand for none."""
    for batch in texts:
        yield pd.Series([parse_number(t.split()) if t else None for t in batch], dtype="float64")
