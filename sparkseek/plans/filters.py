"""Parsed filters as one Column predicate, so Catalyst can push what a scan can use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.text import ascii_lower
from sparkseek.plans.query import MAX_LONG, ParsedQuery
from sparkseek.plans.request import SearchRequest

TEXT_COLUMNS = ("text", "name", "note", "user_tags_json")


def _ascii(value: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in value)


def holds(column: str, value: str) -> Column:
    """The column has the value in it; only ASCII letters match in either case."""
    return F.coalesce(ascii_lower(F.col(column)).contains(_ascii(value)), F.lit(False))


def within(column: str, bounds: tuple[int | None, int | None]) -> list[Column]:
    low, high = bounds
    return [F.col(column) >= low] * (low is not None and low > -MAX_LONG) + [F.col(column) < high] * (high is not None and high < MAX_LONG)


def in_folder(start: str) -> Column:
    """Some folder of the path starts with this; the file name does not count."""
    folder = F.substr(F.col("path"), F.lit(1), F.length("path") - F.length("name"))
    return ascii_lower(F.translate(folder, "\\", "/")).contains("/" + _ascii(start))


def has_element(column: str, value: str) -> Column:
    return F.coalesce(F.exists(column, lambda x: ascii_lower(x) == _ascii(value)), F.lit(False))


def predicates(p: ParsedQuery, request: SearchRequest | None = None) -> list[Column]:
    """Conditions that all must hold; cheap comparisons come first."""
    out: list[Column] = [~F.col("hidden")]
    out += within("mtime", (p.since, p.until))
    for column, bounds in (("size", p.size), ("width", p.width), ("height", p.height)):
        out += within(column, bounds) if bounds else []
    if p.pinned:
        out.append(F.col("pinned"))
    if p.orientation:
        out.append(F.col("width") > F.col("height") if p.orientation == "landscape" else F.col("height") > F.col("width"))
    if request and request.expand_group is not None:
        group = request.expand_group
        out.append((F.col("group_id") == group) | (F.col("id") == group))
    out += [F.array_contains("tags", f"c:{c}") for c in p.colors] + [F.array_contains("tags", f"h:{h}") for h in p.has]
    out += [has_element("user_tags", t) for t in p.tags] + [has_element("collections", c) for c in p.collections]
    if p.exts:
        out.append(reduce(Column.__or__, [ascii_lower(F.col("name")).endswith("." + _ascii(e)) for e in p.exts]))
    out += [in_folder(f) for f in p.folders]
    out += [F.coalesce(ascii_lower(F.translate("path", "\\", "/")).contains(_ascii(x)), F.lit(False)) for x in p.paths]
    out += [~reduce(Column.__or__, [holds(c, x) for c in TEXT_COLUMNS]) for x in p.excludes]
    return out


def apply_filters(catalog: DataFrame, p: ParsedQuery, request: SearchRequest | None = None, feedback: DataFrame | None = None) -> DataFrame:
    """Rows that every filter lets through, without those dismissed for this very query."""
    out = catalog.filter(reduce(Column.__and__, predicates(p, request)))
    if feedback is not None and request is not None and request.feedback_key:
        dismissed = feedback.filter(F.col("query") == request.feedback_key).select(F.col("shot_id").alias("id"))
        out = out.join(dismissed, "id", "left_anti")
    return out
