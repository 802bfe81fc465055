"""The router: a request over a catalog becomes one DataFrame of hits, and what goes with it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparkseek.operators import fuzzy, vectors
from sparkseek.operators.caches import Caches
from sparkseek.operators.fusion import fold_groups, reciprocal_rank_fusion
from sparkseek.operators.lexical import SHOWN, counted_hits, ranking, split_terms
from sparkseek.operators.lines import with_highlights
from sparkseek.operators.ordering import shuffle_columns, sort_columns, with_rank
from sparkseek.plans.filters import apply_filters
from sparkseek.plans.query import SORTS, ActiveFilter, parse_query
from sparkseek.plans.request import MIN_HYBRID, MIN_SIMILAR, MIN_VISUAL, NEAR_BELOW, SearchRequest

@dataclass
class SearchResult:
    """hits holds what is shown of all folded hits, to be put in order; page and envelope answer for one page."""

    hits: DataFrame
    order: list[Column]
    request: SearchRequest
    terms: list[str]
    catalog: DataFrame
    spellings: list[str] = field(default_factory=list)
    filters: list[ActiveFilter] = field(default_factory=list)
    text_count: int = 0
    did_you_mean: str | None = None
    corrected: bool = False
    semantic: bool = False
    began: float = field(default_factory=time.monotonic)

    def rows(self) -> tuple[list, bool]:
        """The page's rows with highlights, and whether another page follows.

        Lines are read for the page alone: its ids go to the scan as a filter. Spellings are
        highlighted too if a hit of the page is near.
        """
        size = self.request.page
        got = self.hits.orderBy(*self.order).offset(self.request.offset).limit(size + 1).collect()
        more, got = len(got) > size, got[:size]
        terms = self.terms + (self.spellings if any("near" in r["evidence"] for r in got) else [])
        lines = self.catalog.filter(F.col("id").isin([r["id"] for r in got])).select("id", "lines")
        marks = {r["id"]: r for r in with_highlights(lines, terms).drop("lines").collect()} if got else {}
        blank = {"highlights": [], "snippet": None}
        return [Row(**r.asDict(), **({k: marks[r["id"]][k] for k in blank} if r["id"] in marks else blank)) for r in got], more

    def envelope(self) -> dict:
        """The answer for one page as the API gives it."""
        rows, more = self.rows()
        took = int((time.monotonic() - self.began) * 1000)
        return {
            "hits": [r.asDict(recursive=True) for r in rows], "textCount": self.text_count, "hasMore": more, "nextOffset": self.request.offset + len(rows),
            "query": self.request.q, "mode": self.request.lane, "tookMs": took, "filters": [vars(f) for f in self.filters],
            "semantic": self.semantic, "didYouMean": self.did_you_mean, "corrected": self.corrected,
        }

    def ranked(self) -> DataFrame:
        return with_rank(self.hits, self.order)


def display(df: DataFrame) -> DataFrame:
    """What a hit shows of its row: the direct folder, whether it is read, and addresses with a cache key."""
    parent = F.regexp_replace(F.translate("path", "\\", "/"), r"/?[^/]*$", "")
    address = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("id"), F.lit("?v="), F.col("mtime"))
    return df.withColumns({"folder": parent, "indexed": F.col("stage") >= 1, "thumb": address("thumb"), "file": address("file")})


def _empty(catalog: DataFrame) -> DataFrame:
    return _listed(catalog.limit(0), "recent")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in SHOWN if c in df.columns))


def _listed(df: DataFrame, kind: str, score: Column | float = 0.0) -> DataFrame:
    return _shown(df).withColumns({"kind": F.lit(kind), "evidence": F.array(F.lit(kind)), "score": score if isinstance(score, Column) else F.lit(score)})


def search(catalog: DataFrame, request: SearchRequest, embedder: vectors.Embedder | None = None, feedback: DataFrame | None = None, now: datetime | None = None, dim: int = 512, caches: Caches | None = None, version: str = "") -> SearchResult:
    """Answers a request over a catalog that has the columns of ``schema.conform``.

    With caches, the vocabulary is kept for this version of the catalog.
    """
    began = time.monotonic()
    p = parse_query(request.q, now)
    sort = p.sort or SORTS.get(request.sort or "")
    eligible = apply_filters(catalog, p, request, feedback)
    fold = request.expand_group is None
    ready = embedder is not None and embedder.ready

    def result(hits: DataFrame, order: list[Column], **more) -> SearchResult:
        folded = fold_groups(hits, order, fold)
        return SearchResult(display(folded), order, request, list(p.terms), catalog, filters=p.filters, semantic=ready, began=began, **more)

    if request.wants_image:
        if request.lane == "text":
            raise ValueError("Image similarity requires All or Visual mode")
        found = _similar(catalog, eligible, request, p.terms, embedder, dim) if ready else None
        order = sort_columns(sort) if sort else [F.desc("score"), F.asc("id")]
        return result(found if found is not None else _empty(catalog), order)
    if not p.terms:
        order = shuffle_columns() if request.shuffle else sort_columns(sort, browsing=True) if sort and sort != "relevance" else sort_columns("newest", browsing=True)
        return result(_listed(eligible, "recent"), order)

    groups, short = split_terms(p.terms)
    text, count, more = None, 0, {}
    if request.lane != "visual":
        text, count = counted_hits(catalog, eligible, groups, short)
        if count < NEAR_BELOW and any(len(g[0]) >= 4 for g in groups):
            text, count, more = _with_near(catalog, eligible, request, groups, short, text, count, caches, version)
    visual = None
    if request.lane != "text" and ready:
        queries = [v for v in map(embedder.embed_text, vectors.prompts(p.terms)) if vectors.usable_query(v, dim)]
        if queries:
            found = vectors.nearest_of_prompts(vectors.searchable(eligible, embedder.version, dim), queries, MIN_VISUAL)
            visual = found.join(_shown(eligible), "id").withColumns({"kind": F.lit("visual"), "evidence": F.array(F.lit("visual"))})
    explicit = sort if sort and sort != "relevance" else None
    if request.lane == "visual":
        return result(visual if visual is not None else _empty(catalog), sort_columns(explicit) if explicit else [F.desc("score"), F.asc("id")])
    if request.lane == "text":
        lanes = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "partial", 1).otherwise(2)
        return result(text, [lanes.asc(), *sort_columns(explicit)] if explicit else ranking(), text_count=count, **more)
    first = with_rank(text.select("id", "kind", "evidence", "lane", "complete", "whole", "bucket", "mtime"), ranking()).select("id", "rank", "kind", "evidence")
    second = with_rank(visual.select("id", "kind", "evidence", "score"), [F.desc("score"), F.asc("id")]).select("id", "rank", "kind", "evidence") if visual is not None else first.limit(0)
    fused = reciprocal_rank_fusion(first, second).join(_shown(eligible), "id")
    return result(fused, sort_columns(explicit) if explicit else [F.desc("score"), F.asc("id")], text_count=count, **more)


def _with_near(catalog, eligible, request, groups, short, text, exact, caches, version):
    make = lambda: fuzzy.vocabulary(catalog)
    vocab = caches.get("vocabulary", version, make) if caches else make().persist()
    spelled, fixes = fuzzy.spellings(vocab, groups)
    if not caches:
        vocab.unpersist()
    if all(len(g) == 1 for g in spelled):
        return text, exact, {}
    rest = eligible.join(text.select("id"), "id", "left_anti")
    near, some = counted_hits(catalog, rest, spelled, short, near=True)
    more = {"spellings": [t for g in spelled for t in g[1:]] if some else []}
    if fixes and some:
        more |= {"did_you_mean": fuzzy.corrected_query(request.q, fixes), "corrected": exact == 0}
    return text.unionByName(near), exact + some, more


def _similar(catalog, eligible, request, terms, embedder, dim) -> DataFrame | None:
    if request.similar_to is not None:
        row = catalog.filter((F.col("id") == request.similar_to) & (F.col("embedding_version") == embedder.version)).select("embedding").first()
        query = row and row["embedding"]
    else:
        query = embedder.embed_image(request.image_path if request.image_path is not None else request.image)
    if not vectors.usable_query(query, dim):
        return None
    least = MIN_SIMILAR
    if terms and (text := embedder.embed_text(" ".join(terms))) is not None:
        query, least = vectors.blend(query, text), MIN_HYBRID
    if request.similar_to is not None:
        eligible = eligible.filter(F.col("id") != request.similar_to)
    found = vectors.nearest(vectors.searchable(eligible, embedder.version, dim), query, least)
    return found.join(_shown(eligible), "id").withColumns({"kind": F.lit("similar"), "evidence": F.array(F.lit("similar"))})


def get_item(catalog: DataFrame, item: int) -> DataFrame:
    """One row with every column, the actions in its text and the live size of its group; hidden rows too."""
    from sparkseek.functions.text import detect_actions

    row = catalog.filter(F.col("id") == item)
    sizes = catalog.filter(~F.col("hidden") & F.col("group_id").isNotNull()).join(row.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.count("*").alias("group_size"))
    return display(row.join(sizes, "group_id", "left").withColumn("actions", detect_actions(F.col("text"))))


def paths_of(catalog: DataFrame, ids: list[int]) -> DataFrame:
    """(place, id, path) in the order of the ids; path is null for ids that are not there."""
    wanted = catalog.sparkSession.createDataFrame(list(enumerate(ids)), "place int, id long")
    return wanted.join(catalog.select("id", "path"), "id", "left").select("place", "id", "path").orderBy("place")


def latest(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~F.col("hidden")).orderBy(F.desc("mtime"), "id").limit(1)
