"""The engine's functions under SQL names, for use in spark.sql."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sparkseek.functions.text import ACCENTED, LOOKALIKE_FROM, LOOKALIKE_PAIRS, LOOKALIKE_TO, color_name


def _fold_sql() -> str:
    s = "lower(s)"
    for old, new in LOOKALIKE_PAIRS:
        s = f"replace({s}, '{old}', '{new}')"
    plain = "".join(p * len(m) for p, m in ACCENTED.items())
    return f"translate(translate({s}, '{''.join(ACCENTED.values())}', '{plain}'), '{LOOKALIKE_FROM}', '{LOOKALIKE_TO}')"


#: Functions that are expressions of built-in ones, so that they cost what these do.
EXPRESSIONS = {
    "fold(s STRING) RETURNS STRING": _fold_sql(),
    "ascii_lower(s STRING) RETURNS STRING": "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "hash_distance(a STRING, b STRING) RETURNS INT": "CASE WHEN a RLIKE '^[+]?[0-9A-Fa-f]{1,16}$' AND b RLIKE '^[+]?[0-9A-Fa-f]{1,16}$' THEN bit_count(CAST(conv(a, 16, -10) AS BIGINT) ^ CAST(conv(b, 16, -10) AS BIGINT)) ELSE 64 END",
    "word_list(s STRING) RETURNS ARRAY<STRING>": r"filter(split(lower(coalesce(s, '')), '[^\\p{IsAlphabetic}\\p{N}]+'), w -> length(w) >= 3)",
    r"has_word(s STRING, term STRING) RETURNS BOOLEAN": r"s RLIKE concat('(?<![\\p{IsAlphabetic}\\p{N}])\\Q', term, '\\E(?![\\p{IsAlphabetic}\\p{N}])')",
    "quantise(v ARRAY<FLOAT>) RETURNS ARRAY<INT>": "transform(v, x -> CAST(round(CAST(x AS DOUBLE) / (greatest(CAST(array_max(transform(v, y -> abs(y))) AS DOUBLE), 1e-12) / 127D)) AS INT))",
}


def _sql_of(spark: SparkSession, column: Column, name: str) -> str:
    """The SQL of a column over one string column of this name; for expressions without lambdas."""
    one = spark.createDataFrame([], f"{name} string").select(column.alias("value"))
    return one._jdf.queryExecution().analyzed().expressions().head().child().sql()


class Words:
    """Table function: a row for each word of three letters or digits or more."""

    def eval(self, text: str):
        for word in re.findall(r"[^\W_]{3,}", text or ""):
            yield (word.lower(),)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    from sparkseek.operators.fuzzy import _osa_pairs

    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION color_name(hex STRING) RETURNS STRING RETURN {_sql_of(spark, color_name(F.col('hex')), 'hex')}")
    spark.udf.register("osa_distance", F.pandas_udf(_osa_pairs, IntegerType()))
    spark.udtf.register("words", F.udtf(Words, returnType="word: string"))
    return [head.partition("(")[0] for head in EXPRESSIONS] + ["color_name", "osa_distance", "words"]
