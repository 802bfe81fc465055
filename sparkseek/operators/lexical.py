"""Lexical ranking: substring match, weighted BM25 and whole words.

A long term (three characters or more) is a group of spellings, of which one must be a substring
of some text column, letters in either case. A short term must be one with only ASCII letters in
either case. BM25 counts every spelling as a phrase; a row's length is its number of trigrams
over all indexed columns, the folded text included, and document counts cover the whole catalog.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.text import has_word, literal, overlaps_itself
from sparkseek.operators.checkpoints import cut
from sparkseek.plans.filters import TEXT_COLUMNS, holds
from sparkseek.plans.request import COLUMN_WEIGHTS

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: The columns of a row that a hit shows; texts, geometry and vectors are read for one page only.
SHOWN = ("id", "path", "name", "folder", "mtime", "size", "width", "height", "stage", "pinned", "colors", "group_id")
_WEIGHT = {c: COLUMN_WEIGHTS["user_tags" if c == "user_tags_json" else c] for c in TEXT_COLUMNS}


def split_terms(terms: list[str]) -> tuple[list[list[str]], list[str]]:
    """Long terms as groups of one spelling, and short terms."""
    return [[t] for t in terms if len(t) >= 3], [t for t in terms if len(t) < 3]


def _low(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def contains_phrase(phrase: str) -> Column:
    return reduce(Column.__or__, [_low(c).contains(phrase) for c in TEXT_COLUMNS])


def occurrences(text: Column, phrase: str) -> Column:
    """How often the phrase stands in the text; occurrences may overlap."""
    if overlaps_itself(phrase):
        return F.regexp_count(text, F.lit(f"(?={literal(phrase)})"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def trigrams() -> Column:
    """How many trigrams the row's indexed columns have together, the folded text included."""
    lengths = [F.length(F.coalesce(F.col(c), F.lit(""))) for c in TEXT_COLUMNS] + [F.coalesce("norm_length", F.lit(0))]
    return reduce(Column.__add__, [F.greatest(n - 2, F.lit(0)) for n in lengths])


def corpus_statistics(catalog: DataFrame, phrases: list[str]) -> tuple[int, float, dict[str, int]]:
    """Rows, mean trigrams of a row, and rows with each phrase, over hidden and unread rows too."""
    counts = [F.count_if(contains_phrase(p)).alias(f"n{i}") for i, p in enumerate(phrases)]
    row = catalog.agg(F.count("*").alias("rows"), F.avg(trigrams()).alias("mean"), *counts).first()
    return row["rows"], float(row["mean"] or 0.0), {p: row[f"n{i}"] for i, p in enumerate(phrases)}


def bm25(phrases: list[str], statistics: tuple[int, float, dict[str, int]]) -> Column:
    """Minus the weighted BM25 score: the smaller, the better."""
    rows, mean, holding = statistics
    length = trigrams().cast("double") / F.lit(mean or 1.0)
    total = F.lit(0.0)
    for p in phrases:
        n = holding[p]
        idf = math.log((rows - n + 0.5) / (n + 0.5))
        frequency = reduce(Column.__add__, [occurrences(_low(c), p) * F.lit(w) for c, w in _WEIGHT.items()])
        total = total + F.lit(idf if idf > 0 else LEAST_IDF) * frequency * F.lit(K1 + 1) / (frequency + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length))
    return -total


def haystack() -> Column:
    return F.lower(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in ("text", "note", "user_tags_json", "name"))))


def whole_words(groups: list[list[str]], short: list[str]) -> Column:
    """How many of the terms stand as whole words, by any spelling."""
    hay = haystack()
    tests = [reduce(Column.__or__, [has_word(hay, t) for t in g]) for g in groups] + [has_word(hay, t) for t in short]
    return reduce(Column.__add__, [F.when(t, 1).otherwise(0) for t in tests], F.lit(0))


def matches(groups: list[list[str]], short: list[str]) -> Column:
    long_tests = [reduce(Column.__or__, [contains_phrase(t) for t in g]) for g in groups]
    short_tests = [reduce(Column.__or__, [holds(c, t) for c in TEXT_COLUMNS]) for t in short]
    return reduce(Column.__and__, long_tests + short_tests, F.lit(True))


def text_hits(catalog: DataFrame, eligible: DataFrame, groups: list[list[str]], short: list[str], near: bool = False, statistics: tuple[int, float, dict[str, int]] | None = None) -> DataFrame:
    return counted_hits(catalog, eligible, groups, short, near, statistics)[0]


def counted_hits(catalog: DataFrame, eligible: DataFrame, groups: list[list[str]], short: list[str], near: bool = False, statistics: tuple[int, float, dict[str, int]] | None = None) -> tuple[DataFrame, int]:
    """What a hit shows of the matching rows of eligible, with whole, r (BM25), score, bucket, kind and evidence; and how many these are.

    The score is r over the smallest r of the result, and its bucket is a quarter of that scale.
    Texts are read once for the statistics, unless these are given, and once for the hits, which
    are kept without them.
    """
    phrases = list(dict.fromkeys(t for g in groups for t in g))
    shown = [c for c in SHOWN if c in eligible.columns]
    found = eligible.filter(matches(groups, short)).withColumn("whole", whole_words(groups, short))
    r = bm25([t for g in groups for t in g], statistics or corpus_statistics(catalog, phrases)) if phrases else F.lit(0.0)
    found = cut(found.select(*shown, "whole", r.alias("r")))
    worst, count = found.agg(F.coalesce(F.min("r"), F.lit(0.0)), F.count("*")).first()
    score = F.col("r") / F.lit(worst) if worst < 0 else F.lit(1.0)
    bucket = F.floor(F.col("r") / F.lit(worst) * 4).cast("long") if worst < 0 else F.lit(0).cast("long")
    wanted = len(groups) + len(short)
    kind = F.lit("near") if near else F.when(F.col("whole") >= wanted, "text").otherwise("partial")
    found = found.withColumns({"score": score, "bucket": bucket, "complete": F.col("whole") >= wanted, "kind": kind, "lane": F.lit(int(near))})
    return found.withColumn("evidence", F.array("kind")), count


def ranking() -> list[Column]:
    """Exact before near; all terms whole first; then more whole words, better bucket, newer, smaller id."""
    return [F.asc("lane"), F.desc("complete"), F.desc("whole"), F.desc("bucket"), F.desc("mtime"), F.asc("id")]
