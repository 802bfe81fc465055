"""The query language: words, phrases, exclusions and ``key:value`` filters, read into a value.

Everything here runs on the driver and touches no data.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from datetime import time as clock
from zoneinfo import ZoneInfo

MAX_LONG = (1 << 63) - 1

# Names that filters accept.
MONTHS = "January February March April May June July August September October November December".split()
COLORS = "red orange yellow green teal blue purple pink brown black white gray".split()
CONTENT_KINDS = "url email phone code color text".split()
SIZE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
SIZE_WORDS = {
    "empty": (0, 1),
    "tiny": (0, 10 << 10),
    "small": (10 << 10, 100 << 10),
    "medium": (100 << 10, 1 << 20),
    "large": (1 << 20, 16 << 20),
    "huge": (16 << 20, 128 << 20),
    "gigantic": (128 << 20, MAX_LONG),
}
SORTS = {
    "newest": "newest", "date": "newest", "recent": "newest", "oldest": "oldest", "largest": "largest", "size": "largest",
    "biggest": "largest", "smallest": "smallest", "name": "name", "relevance": "relevance", "best": "relevance",
}

_TOKEN = re.compile(r"""(?P<neg>-?)(?:(?P<key>[A-Za-z]+):)?(?:"(?P<quoted>[^"]*)"?|(?P<bare>\S+))""")
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+))\s*([A-Za-z]*)\s*")
_ISO_DAY = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?")


@dataclass(frozen=True)
class ActiveFilter:
    key: str
    value: str
    label: str


@dataclass
class ParsedQuery:
    terms: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    collections: list[str] = field(default_factory=list)
    colors: list[str] = field(default_factory=list)
    has: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    pinned: bool = False
    orientation: str | None = None
    since: int | None = None
    until: int | None = None
    size: tuple[int, int] | None = None
    width: tuple[int, int] | None = None
    height: tuple[int, int] | None = None
    sort: str | None = None
    filters: list[ActiveFilter] = field(default_factory=list)


def parse_number(text: str, units: bool) -> int | None:
    """A number of at least 0 with an optional unit of bytes, rounded half away from zero."""
    m = _NUMBER.fullmatch(text)
    if not m or (m[2] and not units) or m[2].lower() not in SIZE_UNITS:
        return None
    value = float(m[1])
    return int(math.floor(value * SIZE_UNITS[m[2].lower()] + 0.5)) if value >= 0 else None


def parse_range(text: str, units: bool) -> tuple[int, int] | None:
    """``>x``, ``>=x``, ``<x``, ``<=x``, ``a..b``, ``a-b``, ``x`` or a size word, as [from, to)."""
    if units and text in SIZE_WORDS:
        return SIZE_WORDS[text]
    for sign, bounds in ((">=", lambda n: (n, MAX_LONG)), ("<=", lambda n: (0, n + 1)), (">", lambda n: (n + 1, MAX_LONG)), ("<", lambda n: (0, n))):
        if text.startswith(sign):
            n = parse_number(text[len(sign) :], units)
            return None if n is None else bounds(n)
    for mark in ("..", "-"):
        if mark in text:
            low, high = (parse_number(x, units) for x in text.split(mark, 1))
            return None if low is None or high is None else (low, high + 1)
    n = parse_number(text, units)
    return None if n is None else (n, n + 1)


def _following_month(year: int, month: int) -> date:
    return date(year + month // 12, month % 12 + 1, 1)


def parse_dates(text: str, now: datetime) -> tuple[int, int, str] | None:
    """A date word, month name, or year with optional month and day: [start, end) in epoch ms, and a label."""
    zone = now.tzinfo or ZoneInfo("UTC")
    today = now.date()

    def span(start: date, end: date, label: str) -> tuple[int, int, str]:
        midnight = lambda d: int(datetime.combine(d, clock(), zone).timestamp() * 1000)
        return midnight(start), midnight(end), label

    days = lambda n: today + timedelta(days=n)
    words = {"today": (0, 1, "Today"), "yesterday": (-1, 0, "Yesterday"), "week": (-6, 1, "Last 7 days"), "month": (-29, 1, "Last 30 days"), "year": (-364, 1, "Last 12 months")}
    if text in words:
        first, last, label = words[text]
        return span(days(first), days(last), label)
    if len(text) >= 3 and text.isascii() and text.isalpha():
        for month, name in enumerate(MONTHS, 1):
            if name.lower().startswith(text):
                year = today.year - (month > today.month)
                return span(date(year, month, 1), _following_month(year, month), f"{name} {year}")
    m = _ISO_DAY.fullmatch(text)
    if not m:
        return None
    try:
        year, month, day = (x and int(x) for x in m.groups())
        if month is None:
            return span(date(year, 1, 1), date(year + 1, 1, 1), str(year))
        if day is None:
            return span(date(year, month, 1), _following_month(year, month), f"{MONTHS[month - 1]} {year}")
        start = date(year, month, day)
        return span(start, start + timedelta(days=1), start.isoformat())
    except ValueError:
        return None


def _apply(out: ParsedQuery, key: str, value: str, now: datetime) -> tuple[str, str, str] | None:
    """Takes a filter in; gives what to echo of it (key, value, label), or None if it is none."""
    low = value.lower()
    many = {"tag": (out.tags, f"Tag: {value}"), "collection": (out.collections, f"Collection: {value}"), "in": (out.folders, f"In “{value}”")}
    if key in many and low:
        many[key][0].append(low)
        return key, low, many[key][1]
    if key == "path" and low:
        out.paths.append(low.replace("\\", "/"))
        return key, low, f"Path has “{value}”"
    if key in ("date", "dm", "before", "after") and (found := parse_dates(low, now)):
        start, end, label = found
        if key == "before":
            out.until = start
            return key, low, f"Before {label}"
        out.since = start
        if key == "after":
            return key, low, f"Since {label}"
        out.until = end
        return "date", low, label
    if key == "color" and (color := "gray" if low == "grey" else low) in COLORS:
        out.colors.append(color)
        return key, color, f"Color: {color}"
    if key == "has" and low in CONTENT_KINDS:
        out.has.append(low)
        return key, low, f"Has {low}"
    if key == "is" and low == "pinned":
        out.pinned = True
        return key, low, "Pinned"
    if key == "is" and low in ("landscape", "portrait"):
        out.orientation = low
        return key, low, low.capitalize()
    if key == "ext" and (exts := [e for e in (x.strip().lstrip(".") for x in re.split("[;,|]", low)) if e]):
        out.exts += exts
        return key, low, f"Type: {', '.join(exts)}"
    if key in ("size", "width", "height") and (bounds := parse_range(low, key == "size")):
        setattr(out, key, bounds)
        return key, low, f"Size {low}" if key == "size" else f"{key.capitalize()} {low} px"
    if key == "sort" and low in SORTS:
        out.sort = SORTS[low]
        return key, out.sort, f"Sorted by {out.sort}"
    return None


def parse_query(text: str, now: datetime | None = None) -> ParsedQuery:
    """Reads a query. What is no known filter stays a search term; a negated filter excludes its own text."""
    now = now or datetime.now(ZoneInfo("UTC"))
    out = ParsedQuery()
    for m in _TOKEN.finditer(text):
        value = (m["quoted"] if m["quoted"] is not None else m["bare"]).strip()
        words = out.excludes if m["neg"] else out.terms
        if m["key"] is None:
            if value:
                words.append(value.lower())
            continue
        key = m["key"].lower()
        echo = None if m["neg"] else _apply(out, key, value, now)
        if echo:
            out.filters.append(ActiveFilter(*echo))
        else:
            words.append(f"{key}:{value}".lower())
    return out
