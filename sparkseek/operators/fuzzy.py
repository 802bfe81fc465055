"""Spelling and misread tolerance over the catalog's own vocabulary."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkseek.functions.text import fold, words


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    older: list[int] = []
    old, new = list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j - 1] + (x != y), old[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, old = old, new
    return old[-1]


def _osa_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def osa_distance(a: Column, b: Column) -> Column:
    """Arrow-batched; filter by Levenshtein distance first, which is at most twice as large."""
    return F.pandas_udf(_osa_pairs, IntegerType())(a, b)


def vocabulary(catalog: DataFrame) -> DataFrame:
    """(word, n, fold) over texts, file names without their ending, notes and tags of shown rows."""
    stem = F.regexp_replace("name", r"(?s)^(.*)\.[^.]*$", "$1")
    columns = F.concat(*(words(c) for c in (F.col("text"), stem, F.col("note"), F.col("user_tags_json"))))
    counted = catalog.filter(~F.col("hidden")).select(F.explode(columns).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.withColumn("fold", fold(F.col("word")))


def fold_groups_of_words(vocab: DataFrame) -> DataFrame:
    """(fold, words): the words that look alike, where there is more than one."""
    return vocab.groupBy("fold").agg(F.array_sort(F.collect_list("word")).alias("words")).filter(F.size("words") > 1)


def misreads(vocab: DataFrame, term: str) -> DataFrame:
    """(word): other words that look like the term."""
    return vocab.filter((F.col("fold") == fold(F.lit(term))) & (F.col("word") != term)).select("word")


def corrections(vocab: DataFrame, term: str) -> DataFrame:
    """(word, n, typos) of words that the term may have meant; the best is the first by (typos, -n, word)."""
    most = 1 if len(term) == 4 else 2
    near = vocab.filter(F.col("word").startswith(term[:1]) & (F.abs(F.length("word") - len(term)) <= most))
    near = near.filter(F.levenshtein("word", F.lit(term), 2 * most) >= 0)
    return near.select("word", "n", osa_distance(F.col("word"), F.lit(term)).alias("typos")).filter(F.col("typos") <= most)


def correct(vocab: DataFrame, term: str) -> str | None:
    """The likeliest correction of a term that is in no word at all."""
    if len(term) <= 3 or not vocab.filter(F.col("word").contains(term)).isEmpty():
        return None
    best = corrections(vocab, term).orderBy("typos", F.desc("n"), "word").first()
    return best and best["word"]


def spellings(vocab: DataFrame, groups: list[list[str]]) -> tuple[list[list[str]], list[tuple[str, str]]]:
    """Each long term with its misreads and its correction, and the corrections made."""
    out, fixes = [], []
    for (term, *_) in groups:
        group = [term]
        if len(term) >= 4:
            group += [r["word"] for r in misreads(vocab, term).orderBy("word").collect()]
            if fix := correct(vocab, term):
                fixes.append((term, fix))
                group.append(fix)
        out.append(group)
    return out, fixes


def corrected_query(query: str, fixes: list[tuple[str, str]]) -> str:
    """The query as typed, with the first whole-word occurrence of each corrected term replaced."""
    for term, fix in fixes:
        query = re.sub(rf"\b{re.escape(term)}\b", lambda _, fix=fix: fix, query, count=1, flags=re.IGNORECASE)
    return query
