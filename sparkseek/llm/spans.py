"""Places of regular-expression matches, from built-in functions only, in time linear in the text (times a logarithm)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: begin and end in code points (end exclusive), the matched text, and one group of it.
SPAN = "struct<begin: int, end: int, match: string, part: string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sums of the first, the first two, ... numbers: each pass adds what stands twice as far before."""
    reach = lambda k: F.call_function("shiftleft", F.lit(1), k)
    earlier = lambda sums, i, k: F.when(i >= reach(k), F.get(sums, i - reach(k))).otherwise(0)
    add = lambda sums, k: F.transform(sums, lambda x, i: x + earlier(sums, i, k))
    passes = lambda x: F.ceil(F.log2(F.size(x).cast("double"))).cast("int")
    return let(numbers, lambda x: F.when(F.size(x) < 2, x).otherwise(F.aggregate(F.sequence(F.lit(0), passes(x) - 1), x, add)))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Every leftmost non-overlapping match of the pattern, as an array of SPAN.

    The pieces between matches and the matches alternate, so running sums of their lengths give
    the places. The pattern must not match the empty string, nor loop over groups unless possessively,
    as the engine recurses there.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = {"part": F.regexp_extract_all(text, F.lit(pattern), F.lit(group))} if group else {}
    pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), matches.alias("match"), *(c.alias(k) for k, c in parts.items()))

    def placed(found: Column) -> Column:
        ends = running_sums(F.transform(found, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
        part = (lambda x: x["part"]) if group else (lambda x: x["match"])
        span = lambda x, end: F.struct((end - F.length(x["match"])).alias("begin"), end.alias("end"), x["match"].alias("match"), part(x).alias("part"))
        return F.filter(F.zip_with(found, ends, span), lambda s: s["match"].isNotNull())

    return let(pieces, placed)


def spans_where(test: Column, text: Column, pattern: str, group: int = 0) -> Column:
    """The spans where the test holds, else none; the test should be cheap and true wherever a match is."""
    return F.when(F.coalesce(test, F.lit(False)), spans(text, pattern, group)).otherwise(F.array().cast(f"array<{SPAN}>"))


def before(found: Column, place: Column) -> Column:
    """How many of the spans, which are in order, begin before the place: by halving."""
    passes = F.ceil(F.log2(F.size(found).cast("double") + 1)).cast("int")

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        left = (low < high) & (F.get(found, middle)["begin"] < place)
        return F.struct(F.when(left, middle + 1).otherwise(low).alias("low"), F.when((low < high) & ~left, middle).otherwise(high).alias("high"))

    search = F.aggregate(F.sequence(F.lit(1), passes), F.struct(F.lit(0).alias("low"), F.size(found).alias("high")), halve)["low"]
    return F.when(F.size(found) == 0, 0).otherwise(search)


def touches(found: Column, begin: Column, end: Column) -> Column:
    """Whether a span from begin to end overlaps one of the spans, which are in order and apart from each other."""
    last = let(before(found, end), lambda n: F.when(n > 0, F.get(found, n - 1)["end"] > begin).otherwise(False))
    return F.when(F.size(found) == 0, False).otherwise(last)


def listed(kinds: dict[str, Column], by_kind: bool = False) -> Column:
    """``kind:begin:end`` of all spans, comma-joined; by begin and then kind as listed, or the other way."""
    def keyed(found: Column, order: int, kind: str) -> Column:
        place = lambda s: (F.lit(order).alias("order"), s["begin"].alias("begin"))
        return F.transform(found, lambda s: F.struct(*(place(s) if by_kind else place(s)[::-1]), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*(keyed(found, i, k) for i, (k, found) in enumerate(kinds.items())))
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")
