"""Exact filtered vector search over quantised vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST = 1e-12
LEVELS = 127


class Embedder(Protocol):
    """What turns texts and images into vectors; searches work without one."""

    version: str
    ready: bool

    def embed_text(self, text: str) -> Sequence[float] | None: ...

    def embed_image(self, image) -> Sequence[float] | None: ...


def normalise(v: Sequence[float]) -> list[float]:
    norm = max(math.sqrt(sum(x * x for x in v)), LEAST)
    return [x / norm for x in v]


def normalise_column(v: Column) -> Column:
    """The same for a column of vectors."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(LEAST))
    return F.transform(v, lambda x: x.cast("double") / norm)


def blend(image: Sequence[float], text: Sequence[float]) -> list[float]:
    """The direction halfway between an image's vector and a text's."""
    return normalise([a + b for a, b in zip(image, text)])


def usable_query(v: Sequence[float] | None, dim: int) -> bool:
    return v is not None and len(v) == dim and all(math.isfinite(x) for x in v)


def scale_of(v: Column) -> Column:
    return F.greatest(F.array_max(F.transform(v, F.abs)).cast("double"), F.lit(LEAST)) / F.lit(float(LEVELS))


def quantise(v: Column) -> Column:
    """Whole numbers from -127 to 127, rounded half away from zero."""
    scale = scale_of(v)
    return F.transform(v, lambda x: F.round(x.cast("double") / scale).cast("byte"))


def with_quantised(df: DataFrame, column: str = "embedding") -> DataFrame:
    """df with scale and quantised, which take an eighth of the doubles' room."""
    return df.withColumn("scale", scale_of(F.col(column))).withColumn("quantised", F.transform(column, lambda x: F.round(x.cast("double") / F.col("scale")).cast("byte")))


def dot(v: Column, query: Sequence[float]) -> Column:
    """Inner product with a fixed vector, inside the JVM."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def dot_batched(v: Column, query: Sequence[float]) -> Column:
    """The same by Arrow batches; faster for long vectors."""
    q = np.asarray(query, dtype=np.float64)

    def score(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.stack([np.asarray(x, dtype=np.float64) for x in vectors]) @ q) if len(vectors) else pd.Series([], dtype="float64")

    return F.pandas_udf(score, DoubleType())(v)


def searchable(catalog: DataFrame, version: str | None, dim: int) -> DataFrame:
    """Shown rows with a vector of this model and length."""
    out = catalog.filter(~F.col("hidden") & F.col("embedding").isNotNull() & (F.size("embedding") == dim))
    return out if version is None else out.filter(F.col("embedding_version") == version)


def nearest(eligible: DataFrame, query: Sequence[float], least: float, k: int | None = None, batched: bool = False) -> DataFrame:
    """(id, score) of all rows at least this near, or of the k nearest: filters come before scores."""
    rows = with_quantised(eligible.select("id", "embedding"))
    score = F.col("scale") * (dot_batched if batched else dot)(F.col("quantised"), query)
    found = rows.select("id", score.alias("score")).filter(F.col("score") >= least)
    return found if k is None else found.orderBy(F.desc("score"), "id").limit(k)


def nearest_of_prompts(eligible: DataFrame, queries: list[Sequence[float]], least: float) -> DataFrame:
    """(id, score): the best score of any of the vectors, in one pass."""
    rows = with_quantised(eligible.select("id", "embedding"))
    scores = [F.col("scale") * dot(F.col("quantised"), q) for q in queries]
    return rows.select("id", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score")).filter(F.col("score") >= least)


def prompts(terms: list[str]) -> list[str]:
    """The query itself, and for a single word of letters a caption of a photo too."""
    raw = " ".join(terms)
    return [raw, f"a photo of a {raw}."] if len(terms) == 1 and raw.isalpha() else [raw]
