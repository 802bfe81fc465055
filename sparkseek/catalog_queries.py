"""The catalog queries that the driver runs, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.operators import bursts, evaluation, fusion, fuzzy, lexical, ordering, stats, vectors
from sparkseek.operators.search import search
from sparkseek.plans.filters import apply_filters
from sparkseek.plans.query import parse_query
from sparkseek.plans.request import SearchRequest
from sparkseek.registry import QUERIES, SQL, query
from sparkseek.sources import files
from sparkseek.sources.tables import documents_catalog, events_catalog, orders_catalog, pages_catalog, table

NOW = datetime(2024, 1, 10, 15, 0, tzinfo=ZoneInfo("UTC"))

CAT = """
WITH lab AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
cat AS (
  SELECT d.doc_id AS id, 'doc' || d.doc_id || '.' || d.lang AS name, '/lib/' || source AS folder,
    '/lib/' || source || '/' || lang || '/doc' || d.doc_id || '.' || lang AS path, n_chars AS size,
    1704067200000 + (d.doc_id // 40) * 86400000 + (d.doc_id % 40) * 20000 AS mtime, coalesce(text, '') AS text,
    list_filter([CASE WHEN q = 1 THEN 'quality' END, CASE WHEN t = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS user_tags,
    CAST(to_json(list_filter([CASE WHEN q = 1 THEN 'quality' END, CASE WHEN t = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS VARCHAR) AS user_tags_json,
    [lang] AS collections, d.doc_id % 10 = 0 AS pinned, d.doc_id % 50 = 49 AS hidden, 1 + d.doc_id % 1920 AS width, 1 + n_chars % 1080 AS height
  FROM documents d LEFT JOIN lab USING (doc_id)
)
"""
_ACCENTS = "".join(T.ACCENTED.values())
_PLAIN = "".join(p * len(m) for p, m in T.ACCENTED.items())


def _fold_sql(s: str) -> str:
    return f"translate(translate(replace(replace(replace(lower({s}), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '{_ACCENTS}', '{_PLAIN}'), '{T.LOOKALIKE_FROM}', '{T.LOOKALIKE_TO}')"


def _words_sql(s: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({s}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3)"


# Filters of the query language

FILTERS = {
    "filter_in_folder": ("in:src1", "contains(lower(left(path, length(path) - length(name))), '/src1')"),
    "filter_path": ("path:de/doc1", "contains(lower(path), 'de/doc1')"),
    "filter_ext": ("ext:de;.fr", "(ends_with(lower(name), '.de') OR ends_with(lower(name), '.fr'))"),
    "filter_size_words": ("size:tiny", "size >= 0 AND size < 10240"),
    "filter_size_range": ("size:1k..4kb", "size >= 1024 AND size < 4097"),
    "filter_width_height": ("width:>100 height:<=500", "width >= 101 AND height >= 0 AND height < 501"),
    "filter_date_week": ("date:week", "mtime >= 1704326400000 AND mtime < 1704931200000"),
    "filter_date_before_after": ("after:2024-01-03 before:2024-01-08", "mtime >= 1704240000000 AND mtime < 1704672000000"),
    "filter_date_month": ("dm:jan", "mtime >= 1704067200000 AND mtime < 1706745600000"),
    "filter_tag": ("tag:Toxic", "list_contains(user_tags, 'toxic')"),
    "filter_collection": ("collection:fr", "list_contains(collections, 'fr')"),
    "filter_exclude": ('-und -"of the"', "NOT (contains(lower(text), 'und') OR contains(name, 'und') OR contains(user_tags_json, 'und')) AND NOT contains(lower(text), 'of the')"),
    "filter_excluded_filter": ("-ext:de -http://x -in:the", "NOT (contains(lower(text), 'ext:de') OR contains(lower(text), 'http://x') OR contains(lower(text), 'in:the'))"),
    "filter_unknown_key": ("-note:x size:1e9zz ext:en", "NOT contains(lower(text), 'note:x') AND ends_with(lower(name), '.en')"),
    "filter_orientation": ("is:portrait", "height > width"),
    "filter_landscape_pinned": ("is:landscape is:pinned", "width > height AND pinned"),
    "filter_hidden": ("", "true"),
    "filter_date_year": ("date:2024", "mtime >= 1704067200000 AND mtime < 1735689600000"),
    "filter_date_day": ("date:2024-01-05", "mtime >= 1704412800000 AND mtime < 1704499200000"),
    "filter_date_year_month": ("date:2024-1", "mtime >= 1704067200000 AND mtime < 1706745600000"),
    "filter_date_yesterday": ("date:yesterday", "mtime >= 1704758400000 AND mtime < 1704844800000"),
    "filter_date_invalid": ("-date:2024-13", "NOT contains(lower(text), 'date:2024-13')"),
    "filter_size_exact": ("size:<=2kb", "size < 2049"),
    "filter_size_dash": ("size:1.5k-0.002mb", "size >= 1536 AND size < 2098"),
    "filter_size_word_small": ("size:small", "size >= 10240 AND size < 102400"),
    "filter_phrase_quotes": ('path:"src1/en" in:"src1"', "contains(lower(path), 'src1/en') AND contains(lower(left(path, length(path) - length(name))), '/src1')"),
}


def _filtering(text: str):
    return lambda spark, d: apply_filters(documents_catalog(spark, d), parse_query(text, NOW), SearchRequest(q=text)).select("id", "name", "size")


for _name, (_text, _where) in FILTERS.items():
    QUERIES[_name] = _filtering(_text)
    SQL[_name] = f"{CAT} SELECT id, name, size FROM cat WHERE NOT hidden AND {_where}"


@query("filter_content_kinds", "SELECT event_id AS id FROM events WHERE event_type = 'click'")
def filter_content_kinds(spark, d):
    events = events_catalog(spark, d).withColumn("tags", F.transform("tags", lambda t: F.concat(F.lit("h:"), F.when(t == "click", "url").otherwise(t))))
    return apply_filters(events, parse_query("has:url", NOW)).select("id")


@query("filter_color", "SELECT event_id AS id FROM events WHERE event_type = 'error'")
def filter_color(spark, d):
    events = events_catalog(spark, d).withColumn("tags", F.transform("tags", lambda t: F.concat(F.lit("c:"), F.when(t == "error", "gray").otherwise("red"))))
    return apply_filters(events, parse_query("color:grey", NOW)).select("id")


@query("feedback_anti", f"{CAT} SELECT id FROM cat WHERE NOT hidden AND pinned AND id % 7 <> 0")
def feedback_anti(spark, d):
    text = " IS:pinned "
    feedback = documents_catalog(spark, d).filter("id % 7 = 0").select(F.lit("is:pinned").alias("query"), F.col("id").alias("shot_id"))
    return apply_filters(documents_catalog(spark, d), parse_query(text, NOW), SearchRequest(q=text), feedback).select("id")


@query("expand_group", "SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id = 3 OR conv_id * 1000 + turn = 3")
def expand_group(spark, d):
    from sparkseek.schema import conform

    c = table(spark, d, "conversations")
    rows = conform(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("group_id"), "text"))
    return apply_filters(rows, parse_query("", NOW), SearchRequest(expand_group=3)).select("id")


# Orders and pages


def _ranked(order, page=None):
    def run(spark, d):
        rows = documents_catalog(spark, d).filter(~F.col("hidden")).select("id", "name", "size", "mtime")
        ranked = ordering.with_rank(rows, order()).select("id", "rank")
        return ranked if page is None else ranked.filter(F.col("rank").between(*page))

    return run


ORDERS = {
    "browse_newest": (lambda: ordering.sort_columns("newest", browsing=True), "mtime DESC, id DESC"),
    "sort_newest": (lambda: ordering.sort_columns("newest"), "mtime DESC, id"),
    "sort_oldest": (lambda: ordering.sort_columns("oldest"), "mtime, id"),
    "sort_largest": (lambda: ordering.sort_columns("largest"), "size DESC, id"),
    "sort_smallest": (lambda: ordering.sort_columns("smallest"), "size, id"),
    "sort_name": (lambda: ordering.sort_columns("name"), "lower(name), id"),
    "browse_shuffle": (ordering.shuffle_columns, "(id * 1103515245 + 12345) & 2147483647, id"),
}
for _name, (_order, _by) in ORDERS.items():
    QUERIES[_name] = _ranked(_order)
    SQL[_name] = f"{CAT} SELECT id, row_number() OVER (ORDER BY {_by}) AS rank FROM cat WHERE NOT hidden"
QUERIES["page_offset"] = _ranked(ORDERS["sort_largest"][0], (121, 240))
SQL["page_offset"] = f"{CAT} SELECT * FROM (SELECT id, row_number() OVER (ORDER BY size DESC, id) AS rank FROM cat WHERE NOT hidden) WHERE rank BETWEEN 121 AND 240"


# Text

_COLUMNS = {"name": 4.0, "lower(text)": 1.0, "user_tags_json": 2.0}


def _match_sql(terms: list[str]) -> str:
    return " AND ".join("(" + " OR ".join(f"contains({c}, '{t}')" for c in _COLUMNS) + ")" for t in terms)


def _bm25_sql(terms: list[str]) -> str:
    """A common table ``hits`` of shown matching rows with r, to stand after CAT."""
    tf = lambda c, t: f"(length({c}) - length(replace({c}, '{t}', ''))) / {len(t)}.0"
    f = {t: " + ".join(f"{w} * {tf(c, t)}" for c, w in _COLUMNS.items()) for t in terms}
    n = ", ".join(f"count(*) FILTER (WHERE {_match_sql([t])}) AS n{i}" for i, t in enumerate(terms))
    length = f"greatest(length(name) - 2, 0) + greatest(length(text) - 2, 0) + greatest(length(user_tags_json) - 2, 0) + greatest(length({_fold_sql('text')}) - 2, 0)"
    idf = lambda i: f"(CASE WHEN ln((rows - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((rows - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END)"
    score = " + ".join(f"{idf(i)} * ({f[t]}) * 2.2 / (({f[t]}) + 1.2 * (0.25 + 0.75 * ({length}) / mean))" for i, t in enumerate(terms))
    return f", st AS (SELECT count(*) AS rows, avg({length}) AS mean, {n} FROM cat), hits AS (SELECT cat.*, -({score}) AS r FROM cat, st WHERE NOT hidden AND {_match_sql(terms)})"


def _hits(spark, d, terms: list[str]) -> DataFrame:
    catalog = documents_catalog(spark, d)
    return lexical.text_hits(catalog, apply_filters(catalog, parse_query("", NOW)), *lexical.split_terms(terms))


@query("text_match", f"{CAT} SELECT id FROM cat WHERE NOT hidden AND {_match_sql(['ation', 'the'])}")
def text_match(spark, d):
    catalog = documents_catalog(spark, d)
    return apply_filters(catalog, parse_query("", NOW)).filter(lexical.matches([["ation"], ["the"]], [])).select("id")


@query("short_term_match", f"{CAT} SELECT id FROM cat WHERE NOT hidden AND {_match_sql(['ü'])}".replace("lower(text)", "text"))
def short_term_match(spark, d):
    return apply_filters(documents_catalog(spark, d), parse_query("", NOW)).filter(lexical.matches([], ["ü"])).select("id")


_TERMS = ["idiot", "stupid"]


@query("text_bm25", f"{CAT}{_bm25_sql(['tion'])} SELECT id, round(r, 6) AS r FROM hits")
def text_bm25(spark, d):
    return _hits(spark, d, ["tion"]).select("id", F.round("r", 6).alias("r"))


def _whole_sql(t: str) -> str:
    hay = "lower(text || chr(10) || '' || chr(10) || user_tags_json || chr(10) || name)"
    return f"CASE WHEN regexp_matches({hay}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN 1 ELSE 0 END"


@query(
    "text_rank_chain",
    f"{CAT}{_bm25_sql(['idiot'])}, scored AS (SELECT id, mtime, {_whole_sql('idiot')} AS whole, r / min(r) OVER () AS score FROM hits)"
    " SELECT id, CASE WHEN whole >= 1 THEN 'text' ELSE 'partial' END AS kind, round(score, 6) AS score,"
    " row_number() OVER (ORDER BY whole >= 1 DESC, whole DESC, floor(score * 4) DESC, mtime DESC, id) AS rank FROM scored",
)
def text_rank_chain(spark, d):
    hits = _hits(spark, d, ["idiot"]).select("id", "kind", F.round("score", 6).alias("score"), "lane", "complete", "whole", "bucket", "mtime")
    return ordering.with_rank(hits, lexical.ranking()).select("id", "kind", "score", "rank")


_WHOLE_IDIOT = _whole_sql("idiot")


@query("has_word", f"{CAT} SELECT id, {_whole_sql('the')} = 1 AS whole FROM cat")
def has_word(spark, d):
    return documents_catalog(spark, d).select("id", T.has_word(lexical.haystack(), "the").alias("whole"))


@query("fold_text", f"SELECT doc_id AS id, md5({_fold_sql('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(T.fold(F.col("text"))).alias("folded"))


@query("words", f"SELECT doc_id AS id, len({_words_sql('text')}) AS n FROM documents")
def words(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(T.words(F.col("text"))).cast("long").alias("n"))


_VOCAB = (
    f"{CAT}, said AS (SELECT unnest(list_concat(list_concat({_words_sql('text')}, {_words_sql(chr(114) + 'egexp_replace(name, ' + repr('[.][^.]*$') + ', ' + repr('') + ')')}), {_words_sql('user_tags_json')})) AS word"
    f" FROM cat WHERE NOT hidden), vocab AS (SELECT word, count(*) AS n, {_fold_sql('word')} AS fold FROM said GROUP BY word)"
)


@query("vocab_counts", f"{_VOCAB} SELECT word, n, fold FROM vocab")
def vocab_counts(spark, d):
    return fuzzy.vocabulary(documents_catalog(spark, d))


@query("vocab_fold", f"{_VOCAB} SELECT fold, array_to_string(list_sort(list(word)), ' ') AS words FROM vocab GROUP BY fold HAVING count(*) > 1")
def vocab_fold(spark, d):
    return fuzzy.fold_groups_of_words(fuzzy.vocabulary(documents_catalog(spark, d))).select("fold", F.array_join("words", " ").alias("words"))


@query("misreads", f"{_VOCAB} SELECT word FROM vocab WHERE fold = {_fold_sql(chr(39) + 'ldlot' + chr(39))} AND word <> 'ldlot'")
def misreads(spark, d):
    return fuzzy.misreads(fuzzy.vocabulary(documents_catalog(spark, d)), "ldlot")


_NEAR = "word LIKE 's%' AND abs(length(word) - 6) <= 2"
#: DuckDB's distances count bytes, so other letters stand as one that is in no term.
_PLAIN_WORD = "regexp_replace(word, '[^a-z0-9]', '~', 'g')"


@query("correction_candidates", f"{_VOCAB} SELECT word, n FROM vocab WHERE {_NEAR} AND levenshtein({_PLAIN_WORD}, 'stuped') <= 4")
def correction_candidates(spark, d):
    vocab = fuzzy.vocabulary(documents_catalog(spark, d))
    near = vocab.filter(F.col("word").startswith("s") & (F.abs(F.length("word") - 6) <= 2))
    return near.filter(F.levenshtein("word", F.lit("stuped"), 4) >= 0).select("word", "n")


@query("corrections_osa", f"{_VOCAB} SELECT word, n, damerau_levenshtein({_PLAIN_WORD}, 'stuipd') AS typos FROM vocab WHERE {_NEAR} AND damerau_levenshtein({_PLAIN_WORD}, 'stuipd') <= 2")
def corrections_osa(spark, d):
    return fuzzy.corrections(fuzzy.vocabulary(documents_catalog(spark, d)), "stuipd")


@query("line_overlap", "WITH x AS (SELECT doc_id, list_distinct(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS l FROM documents WHERE text <> '') SELECT a.doc_id AS id, round(len(list_intersect(a.l, b.l)) / greatest(len(a.l), len(b.l))::DOUBLE, 6) AS score FROM x a JOIN x b ON b.doc_id = a.doc_id + 20 WHERE len(a.l) >= 4 AND len(b.l) >= 4 AND len(list_intersect(a.l, b.l)) / greatest(len(a.l), len(b.l))::DOUBLE >= 0.7 UNION ALL SELECT a.doc_id, 1.0 FROM x a JOIN x b ON b.doc_id = a.doc_id + 20 WHERE len(a.l) < 4 OR len(b.l) < 4")
def line_overlap(spark, d):
    lines = table(spark, d, "documents").filter("text <> ''").select("doc_id", bursts.distinct_lines(F.col("text")).alias("l"))
    later = lines.select((F.col("doc_id") - 20).alias("doc_id"), F.col("l").alias("m"))
    score = bursts.similarity(F.col("l"), F.col("m"), F.lit(3).cast("long"), F.lit(3).cast("long"))
    return lines.join(later, "doc_id").select(F.col("doc_id").alias("id"), F.round(score, 6).alias("score")).filter("score is not null")


# Actions and other scalars

_NOTES = "'Your code is ' || (1000 + o_orderkey) || chr(10) || 'call +1 555 ' || (1000 + o_orderkey % 9000) || ' 1234 #' || lpad(CAST(o_orderkey % 999 AS VARCHAR), 3, '0') || ' or user' || o_custkey || '@mail.example.org, see https://shop.example.com/o?id=' || o_orderkey || '.'"
_ACTIONS = {
    "email": "'user' || o_custkey || '@mail.example.org'",
    "url": "'https://shop.example.com/o?id=' || o_orderkey",
    "code": "CAST(1000 + o_orderkey AS VARCHAR)",
    "phone": "'+1 555 ' || (1000 + o_orderkey % 9000) || ' 1234'",
    "color": "'#' || lpad(CAST(o_orderkey % 999 AS VARCHAR), 3, '0')",
}


def _notes(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_NOTES.replace("chr(10)", "char(10)").replace("VARCHAR", "STRING")).alias("note"))


for _kind, _value in _ACTIONS.items():

    def _action(spark, d, kind=_kind):
        found = T.detect_actions(F.col("note"), (kind,))
        return _notes(spark, d).select("id", F.array_join(F.transform(found, lambda a: a["value"]), " ").alias("value"))

    query(f"actions_{_kind}", f"SELECT o_orderkey AS id, {_value} AS value FROM orders")(_action)


@query("action_tags", "SELECT o_orderkey AS id, 'h:code h:color h:email h:phone h:url h:text' AS tags FROM orders")
def action_tags(spark, d):
    return _notes(spark, d).select("id", F.array_join(T.action_tags(F.col("note")), " ").alias("tags"))


_HEX = "printf('#%02x%02x%02x', (p_partkey * 37) % 256, (p_partkey * 101) % 256, (p_partkey * 11) % 256)"
_HSL = """
WITH c AS (SELECT p_partkey AS id, ((p_partkey * 37) % 256) / 255.0::DOUBLE AS r, ((p_partkey * 101) % 256) / 255.0::DOUBLE AS g, ((p_partkey * 11) % 256) / 255.0::DOUBLE AS b FROM part),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
n AS (SELECT *, (hi + lo) / 2 AS l, hi - lo AS d FROM m),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * l - 1)) END AS s,
  CASE WHEN d = 0 THEN 0 WHEN hi = r THEN ((g - b) / d * 60 + 360) % 360 WHEN hi = g THEN ((b - r) / d + 2) * 60 ELSE ((r - g) / d + 4) * 60 END AS hue FROM n)
SELECT id, CASE WHEN l < 0.12 THEN 'black' WHEN l > 0.92 AND s < 0.5 THEN 'white' WHEN s < 0.15 THEN 'gray' WHEN hue < 15 OR hue >= 345 THEN 'red'
  WHEN hue < 45 THEN CASE WHEN l < 0.4 THEN 'brown' ELSE 'orange' END WHEN hue < 70 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 195 THEN 'teal'
  WHEN hue < 255 THEN 'blue' WHEN hue < 290 THEN 'purple' ELSE 'pink' END AS name FROM h
"""


def _part_colors(spark, d) -> DataFrame:
    two = lambda k: F.lower(F.lpad(F.hex((F.col("p_partkey") * k) % 256), 2, "0"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("#"), two(37), two(101), two(11)).alias("hex"))


@query("color_name", _HSL)
def color_name(spark, d):
    return _part_colors(spark, d).select("id", T.color_name(F.col("hex")).alias("name"))


_SIGNS = "SELECT vec_id, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b) AS bits FROM embeddings"


@query("hamming", f"WITH s AS ({_SIGNS}) SELECT a.vec_id AS a, b.vec_id AS b, hamming(a.bits, b.bits) AS bits FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 OR b.vec_id = a.vec_id + 37")
def hamming(spark, d):
    """Every vector's signs against those of two later ones."""
    nibble = lambda v, i: F.lower(F.conv(F.array_join(F.slice(v, 4 * i + 1, 4), ""), 2, 16))
    bits = F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0"))
    s = table(spark, d, "embeddings").select("vec_id", bits.alias("v"))
    s = s.select("vec_id", F.concat(*(nibble(F.col("v"), i) for i in range(16))).alias("h"))
    other = s.select(F.col("vec_id").alias("b"), F.col("h").alias("g"))
    later = s.withColumn("b", F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 37)))
    return later.join(other, "b").select(F.col("vec_id").alias("a"), "b", T.hamming(F.col("h"), F.col("g")).cast("long").alias("bits"))


@query("parse_links", "SELECT page_id AS id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^(http|https|mailto):')")
def parse_links(spark, d):
    return pages_catalog(spark, d).filter(T.openable(F.col("source_url"))).select("id", F.try_parse_url("source_url", F.lit("HOST")).alias("host"))


# Vectors and fusion


def _query_vector(spark, d, item: int) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == item).first()["embedding"])


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_Q = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 7)"
_QUANT = "WITH s AS (SELECT vec_id, label, greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 1e-12) / 127.0 AS scale, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS id, label, scale, list_transform(v, lambda x: round(x / scale)) AS z FROM s)"


@query("quantise", f"{_QUANT} SELECT id, round(scale, 9) AS scale, array_to_string(list_transform(z, lambda x: CAST(x AS INTEGER)), ' ') AS z FROM q")
def quantise(spark, d):
    q = vectors.with_quantised(_vectors(spark, d))
    return q.select("id", F.round("scale", 9).alias("scale"), F.array_join(F.col("quantised").cast("array<string>"), " ").alias("z"))


@query("vector_top_k", f"{_QUANT} SELECT id, round(scale * list_inner_product(z, {_Q}), 6) AS score FROM q WHERE id <> 7 ORDER BY scale * list_inner_product(z, {_Q}) DESC, id LIMIT 20")
def vector_top_k(spark, d):
    return vectors.nearest(_vectors(spark, d).filter("id <> 7"), _query_vector(spark, d, 7), -1.0, k=20).select("id", F.round("score", 6).alias("score"))


@query("vector_filtered", f"{_QUANT} SELECT id, round(scale * list_inner_product(z, {_Q}), 6) AS score FROM q WHERE label = 3 AND scale * list_inner_product(z, {_Q}) >= 0.05")
def vector_filtered(spark, d):
    return vectors.nearest(_vectors(spark, d).filter("label = 3"), _query_vector(spark, d, 7), 0.05).select("id", F.round("score", 6).alias("score"))


@query("vector_batched", f"{_QUANT} SELECT id, round(scale * list_inner_product(z, {_Q}), 6) AS score FROM q WHERE scale * list_inner_product(z, {_Q}) >= 0.1")
def vector_batched(spark, d):
    return vectors.nearest(_vectors(spark, d), _query_vector(spark, d, 7), 0.1, batched=True).select("id", F.round("score", 6).alias("score"))


_Q8 = _Q.replace("vec_id = 7", "vec_id = 8")


@query("prompt_max", f"{_QUANT} SELECT id, round(scale * greatest(list_inner_product(z, {_Q}), list_inner_product(z, {_Q8})), 6) AS score FROM q WHERE scale * greatest(list_inner_product(z, {_Q}), list_inner_product(z, {_Q8})) >= 0.1")
def prompt_max(spark, d):
    both = [_query_vector(spark, d, 7), _query_vector(spark, d, 8)]
    return vectors.nearest_of_prompts(_vectors(spark, d), both, 0.1).select("id", F.round("score", 6).alias("score"))


@query(
    "rrf_fusion",
    "WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),"
    " b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(text, 'er'))"
    " SELECT id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score, CASE WHEN a.rank IS NULL THEN 'visual' ELSE 'text' END AS kind,"
    " concat_ws(' ', CASE WHEN a.rank IS NOT NULL THEN 'text' END, CASE WHEN b.rank IS NOT NULL THEN 'visual' END) AS evidence FROM a FULL JOIN b USING (id)",
)
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "text")
    kind = lambda df, k: df.withColumns({"kind": F.lit(k), "evidence": F.array(F.lit(k))})
    a = kind(ordering.with_rank(docs.drop("text"), [F.desc("n_chars"), F.asc("id")]), "text")
    b = kind(ordering.with_rank(docs.filter(F.col("text").contains("er")).drop("text"), [F.asc("id")]), "visual")
    return fusion.reciprocal_rank_fusion(a, b).select("id", F.round("score", 9).alias("score"), "kind", F.array_join("evidence", " ").alias("evidence"))


@query("fold_groups", "SELECT min_by(conv_id * 1000 + turn, turn) AS id, count(*) AS group_size, array_to_string(list_sort(list_distinct(list(role))), ' ') AS evidence FROM conversations GROUP BY conv_id")
def fold_groups(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("group_id"), F.array("role").alias("evidence"))
    return fusion.fold_groups(c, [F.asc("id")]).select("id", "group_size", F.array_join(F.array_sort("evidence"), " ").alias("evidence"))


# Bursts

_EV = """
WITH e AS (SELECT event_id AS id, user_id % 12 AS folder, epoch_ms(ts) AS ms, xor((event_id // 3 * 40503) % 1048576 * 4096, (1 << CAST(event_id % 7 AS INTEGER))::BIGINT) AS h FROM events),
p AS (SELECT a.id AS a, b.id AS b, b.ms AS b_ms, 1 - bit_count(xor(a.h, b.h)) / 64.0 AS score FROM e a JOIN e b ON a.folder = b.folder AND a.id <> b.id AND abs(a.ms - b.ms) <= 600000 WHERE bit_count(xor(a.h, b.h)) <= 6)
"""


def _event_bursts(spark, d) -> DataFrame:
    """Events in twelve folders; hashes of neighbours in time differ in few bits or in many."""
    i = F.col("id")
    h = ((F.floor(i / 3) * 40503) % 1048576 * 4096).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 7).cast("int")))
    return events_catalog(spark, d).withColumns({"dhash": h.cast("long"), "folder": (F.col("folder").cast("long") % 12).cast("string")})


@query("burst_pairs", f"{_EV} SELECT a, b, round(score, 6) AS score FROM p")
def burst_pairs(spark, d):
    return bursts.burst_pairs(_event_bursts(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@query("best_neighbours", f"{_EV} SELECT a AS id, b AS neighbour, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b_ms, b) = 1")
def best_neighbours(spark, d):
    return bursts.best_neighbours(_event_bursts(spark, d)).select("id", "neighbour", F.round("score", 6).alias("score"))


#: Documents of even ids twice, a minute apart; every third of the second ones breaks its lines more often.
_DOC_BURST = f"""{CAT}, w AS (SELECT id // 2 * 2 + k AS id, folder, (id // 2 * 600 + k * 60) * 1000 AS mtime, CASE WHEN k = 0 OR id % 3 > 0 THEN text ELSE replace(text, ' the', chr(10) || 'the') END AS text FROM cat, (SELECT unnest([0, 1]) AS k) WHERE id % 2 = 0),
x AS (SELECT id, folder, mtime, list_distinct(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS l, text FROM w),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.l, b.l)) / greatest(len(a.l), len(b.l))::DOUBLE AS score FROM x a JOIN x b
  ON a.folder = b.folder AND a.id <> b.id AND abs(a.mtime - b.mtime) <= 600000 WHERE len(a.l) >= 4 AND len(b.l) >= 4 AND a.text <> '' AND b.text <> '')"""


def _lined(spark, d) -> DataFrame:
    """Every document of an even id twice, a minute apart, some with more lines; hashes differ in every bit, so that only lines make bursts."""
    rows = documents_catalog(spark, d).filter(F.col("id") % 2 == 0).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when((F.col("k") == 0) | (F.col("id") % 3 > 0), F.col("text")).otherwise(F.replace("text", F.lit(" the"), F.lit("\nthe")))
    mtime = (F.floor(F.col("id") / 2) * 600 + F.col("k") * 60) * 1000
    return rows.withColumns({"text": text, "mtime": mtime.cast("long"), "dhash": F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lit(-1)).cast("long"), "id": F.col("id") + F.col("k"), "hidden": F.lit(False)}).drop("k")


@query("burst_lines", f"{_DOC_BURST} SELECT a, b, round(score, 6) AS score FROM p WHERE score >= 0.7")
def burst_lines(spark, d):
    return bursts.burst_pairs(_lined(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


def _one_hash(spark, d) -> DataFrame:
    """Events that all look alike: bursts by time alone."""
    return events_catalog(spark, d).withColumn("dhash", F.lit(5).cast("long"))


_CHAINS = """WITH e AS (SELECT event_id AS id, user_id, epoch_ms(ts) AS ms FROM events),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 600000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, id) AS run FROM g)"""


@query("burst_components", f"{_EV.replace('WITH e', 'WITH RECURSIVE e')}, reach AS (SELECT a AS id, a AS r FROM p UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.id) SELECT id, min(r) AS group_id FROM reach GROUP BY id")
def burst_components(spark, d):
    return bursts.burst_components(_event_bursts(spark, d))


@query("burst_chains", f"{_CHAINS} SELECT id, min(id) OVER (PARTITION BY user_id, run) AS group_id FROM r QUALIFY count(*) OVER (PARTITION BY user_id, run) > 1")
def burst_chains(spark, d):
    return bursts.burst_components(_one_hash(spark, d))


@query("burst_ingest_order")
def burst_ingest_order(spark, d):
    """In ingest order, which no SQL follows; the tests compare it with the rule by hand."""
    return bursts.group_bursts(_event_bursts(spark, d), "ingest")


# Ingest

_DIFF = """WITH found AS (SELECT '/a/' || o_orderkey || '.png' AS path, o_orderkey * 10 AS mtime, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 3 <> 0),
known AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '/b/' ELSE '/a/' END || o_orderkey || '.png' AS path, o_orderkey * 10 AS mtime, 0 AS size FROM orders WHERE o_orderkey % 4 <> 0)
SELECT path, id, CASE WHEN id IS NULL THEN 'new' WHEN f.mtime IS NULL AND path LIKE '/b/%' THEN 'kept' WHEN f.mtime IS NULL THEN 'gone'
  WHEN f.mtime <> k.mtime OR f.size <> k.size THEN 'changed' ELSE 'same' END AS change FROM found f FULL JOIN known k USING (path)"""


@query("catalog_diff", _DIFF)
def catalog_diff(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k)
    path = lambda root: F.concat(root, k, F.lit(".png"))
    found = orders.filter(k % 3 != 0).select(path(F.lit("/a/")).alias("path"), F.lit("/a").alias("folder"), F.concat(k, F.lit(".png")).alias("name"), (k * 10).alias("mtime"), F.when(k % 5 == 0, 1).otherwise(0).cast("long").alias("size"))
    known = orders.filter(k % 4 != 0).select(k.alias("id"), path(F.when(k % 7 == 0, "/b/").otherwise("/a/")).alias("path"), F.lit("/a").alias("folder"), (k * 10).alias("mtime"), F.lit(0).cast("long").alias("size"))
    return files.catalog_diff(found, known, ["/a", "/b"], complete=["/a"]).select("path", "id", "change")


@query("sidecar_import", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'https://x.example/' || o_orderkey ELSE '' END AS source_url FROM orders")
def sidecar_import(spark, d):
    k = F.col("id")
    catalog = orders_catalog(spark, d)
    body = F.to_json(F.struct(F.when(k % 3 == 0, 2).otherwise(1).alias("version"), F.col("name").alias("imageName"), F.concat(F.lit("https://x.example/"), k).alias("sourceUrl"), F.lit("T").alias("title")))
    sidecars = catalog.filter(k % 2 == 0).select(F.concat(F.lit("/o/order"), k, F.lit(".capture.json")).alias("path"), F.lit(100).cast("long").alias("length"), body.cast("binary").alias("content"))
    return files.import_sidecars(catalog, sidecars, "capture").select("id", "source_url")


@query("path_rules", "SELECT doc_id AS id, CASE WHEN source = 'src3' THEN NULL WHEN source = 'src5' THEN '/lib/src5' ELSE '/lib' END AS root, lang = 'fr' AS skipped FROM documents")
def path_rules(spark, d):
    return documents_catalog(spark, d).select("id", files.root_of(F.col("path"), ["/lib", "/lib/src5"], ["/lib/src3"]).alias("root"), files.skipped(F.col("path"), "/lib", ("FR",)).alias("skipped"))


# Statistics


@query("stats_totals", f"{CAT} SELECT count(*) AS items, sum(size) AS bytes, count(*) FILTER (WHERE text <> '') AS with_text FROM cat WHERE NOT hidden")
def stats_totals(spark, d):
    return stats.totals(documents_catalog(spark, d))


@query("stats_folders", f"{CAT} SELECT folder, count(*) AS items FROM cat WHERE NOT hidden GROUP BY folder")
def stats_folders(spark, d):
    return stats.folders(documents_catalog(spark, d))


@query(
    "stats_months",
    "WITH s AS (SELECT strftime(m, '%Y-%m') AS month FROM range(TIMESTAMP '1997-07-01', TIMESTAMP '1998-07-01', INTERVAL 1 MONTH) t(m))"
    " SELECT month, count(o_orderkey) AS items FROM s LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m') = month GROUP BY month",
)
def stats_months(spark, d):
    return stats.months(orders_catalog(spark, d), datetime(1998, 6, 15))


@query("stats_colors", f"SELECT name, min_by(hex, id) AS hex, count(*) AS items FROM ({_HSL}) JOIN (SELECT p_partkey AS id, {_HEX} AS hex FROM part) USING (id) GROUP BY name ORDER BY items DESC, name LIMIT 8")
def stats_colors(spark, d):
    rows = _part_colors(spark, d).select("id", F.array("hex").alias("colors"), F.lit(False).alias("hidden"))
    return stats.colors(rows)


@query("status_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 9 > 0) AS read, count(embedding) AS embedded, count(*) FILTER (WHERE doc_id % 9 = 0 OR doc_id % 7 = 3) AS errors, count(*) FILTER (WHERE doc_id % 4 = 1) AS sharp FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id % 50 <> 49")
def status_counts(spark, d):
    i = F.col("id")
    rows = documents_catalog(spark, d, vectors=True).withColumns({"stage": F.when(i % 9 == 0, -1).otherwise(F.col("stage")), "error": F.when(i % 7 == 3, "bad"), "ocr": (i % 4 == 1).cast("int")})
    return stats.status(rows, "v1")


@query("failures", "SELECT o_orderkey AS id, 'Could not be read' AS message FROM orders WHERE o_orderstatus = 'F'")
def failures(spark, d):
    return stats.failures(orders_catalog(spark, d).withColumn("stage", F.when(F.col("text") == "F", -1).otherwise(1))).select("id", "message")


@query("bounded_count", "SELECT least(count(*), 41) AS n FROM orders WHERE o_orderstatus = 'O'")
def bounded_count(spark, d):
    waiting = orders_catalog(spark, d).withColumn("stage", F.when(F.col("text") == "O", 0).otherwise(1))
    return stats.waiting(waiting).agg(F.count("*").alias("n"))


@query(
    "page_sections",
    "WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos, strftime(o_orderdate, '%B %Y') AS title FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500),"
    " n AS (SELECT *, CASE WHEN title = lag(title) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS new FROM p), r AS (SELECT *, sum(new) OVER (ORDER BY pos) AS run FROM n)"
    " SELECT run, title, min(pos) AS first, count(*) AS rows FROM r GROUP BY run, title",
)
def page_sections(spark, d):
    order = [F.desc("mtime"), F.asc("id")]
    rows = orders_catalog(spark, d).orderBy(*order).limit(500)
    return stats.sections(rows, order, stats.section(F.col("mtime"), datetime(2030, 1, 1)))


@query(
    "eval_metrics",
    "WITH r AS (SELECT conv_id AS query, turn + 1 AS rank, turn AS id, role FROM conversations), w AS (SELECT query, count(*) AS wanted FROM r WHERE role = 'assistant' GROUP BY query),"
    " h AS (SELECT query, count(*) FILTER (WHERE role = 'assistant') AS hits, min(CASE WHEN role = 'assistant' THEN rank END) AS first FROM r WHERE rank <= 4 GROUP BY query)"
    " SELECT query, round(hits / 4.0, 6) AS precision, round(hits / wanted::DOUBLE, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank FROM h JOIN w USING (query)",
)
def eval_metrics(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query"), (F.col("turn") + 1).alias("rank"), F.col("turn").alias("id"), "role")
    relevant = c.filter("role = 'assistant'").select("query", "id")
    found = evaluation.evaluate(c.select("query", "rank", "id"), relevant, c.select("query").distinct().withColumn("k", F.lit(4)))
    return found.filter(F.col("recall").isNotNull()).select("query", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "reciprocal_rank")))


# The router


@query("search_text", SQL["text_rank_chain"].replace("score, 6) AS score,", "score, 6) AS score,", 1))
def search_text(spark, d):
    found = search(documents_catalog(spark, d), SearchRequest(q="idiot", mode="text"), now=NOW)
    return found.ranked().select("id", "kind", F.round("score", 6).alias("score"), "rank")


@query("search_browse", f"{CAT} SELECT id, row_number() OVER (ORDER BY mtime, id) AS rank FROM cat WHERE NOT hidden AND ends_with(name, '.de') AND size >= 1025")
def search_browse(spark, d):
    return search(documents_catalog(spark, d), SearchRequest(q="ext:de size:>1k sort:oldest"), now=NOW).ranked().select("id", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked text search with an exclusion."""
    found = search(documents_catalog(spark, sf_dir), SearchRequest(q="tion -und sort:relevance", mode="text"), now=NOW)
    return found.ranked().select("rank", "id", "path", "kind", F.round("score", 6).alias("score")).orderBy("rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sparkseek import more_queries  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from sparkseek import more_queries  # noqa: F401

    return dict(SQL)
