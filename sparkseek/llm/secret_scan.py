"""Secret scans with corpus-wide ownership frequencies.

Three patterns find the base spans: assignments, access keys and hexadecimal runs. The method
then looks at values over the whole corpus. Every candidate value, a base one or a token that
only looks like a credential (GENERIC: long, with letters and digits mixed), is hashed, and the
distinct repositories and owners that hold a hash are counted. That gives every value a class:
``copied`` if WIDE owners or more hold it (an example that went around), ``shared`` if several
do, and of those with one owner ``live`` if it looks like a credential and ``plain`` if not.
Live generic tokens are added as spans of kind ``owned``; base spans stay whatever their class.

Only hashes move: (hash, owner, repository) is counted before it moves, so a value copied into a
third of all rows is a few rows an owner. Counts of such values go back to the rows by a
broadcast, the others by a shuffle. The result of the scan is kept once, in the checkpoint
folder, without texts.

Here an owner is a document's source, and a repository is a source and language.

Defined cases: a null or empty text has no spans; a null owner or repository is one of its own;
repeated rows get the same answer and count once; very long texts and many matches take time in
proportion, times a logarithm; an empty table gives an empty result; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, join_split, load
from sparkseek.llm.spans import SPAN, listed, spans_where, touches

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
# A run is maximal where it is found, so asking for its length in the pattern drops short runs only.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9_-]{24,}"
WIDE = 3
KINDS = ("assign", "access", "hex")
JUDGED = "struct<begin: int, order: int, end: int, kind: string, class: string, owners: long, repositories: long>"


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind, in the order in which kinds are listed."""
    assign = spans_where(text.rlike(ASSIGN_HINT), text, ASSIGN, 2)
    return {
        "assign": F.filter(assign, lambda s: F.length(s["part"]) >= 6),
        "access": spans_where(text.contains("AKIA"), text, ACCESS),
        "hex": spans_where(text.rlike(HEX), text, HEX),
    }


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, many different characters, no run of one, and none of the usual placeholders."""
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (letters >= 4) & (digits >= 4) & (kinds >= 10) & ~value.rlike(r"(.)\1{5}|(?i:example|sample|placeholder|changeme|xxxx|your)")


def _value(span: Column) -> Column:
    return F.when(span["part"] != "", span["part"]).otherwise(span["match"])


def scan(docs: DataFrame, text: str, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """One row per row of docs: a row number, the owner and repository, the kept columns in a struct, base spans, and generic candidates."""
    t = F.col(text).cast("string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).alias("none"))
    found = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), name(owner).alias("owner"), name(repository).alias("repository"), *(c.alias(k) for k, c in base_spans(t).items()), spans_where(t.rlike(GENERIC), t, GENERIC).alias("generic"))

    def apart(s: Column) -> Column:
        return looks_live(s["match"]) & ~(touches(F.col("assign"), s["begin"], s["end"]) | touches(F.col("access"), s["begin"], s["end"]) | touches(F.col("hex"), s["begin"], s["end"]))

    return found.withColumn("generic", F.filter("generic", apart))


def ownership(values: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories, places) over all rows of values (value_hash, owner, repository)."""
    once = values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("places"))
    by_owner = once.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"))


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "repository", keep: tuple[str, ...] = ("doc_id",), wide: int = WIDE) -> DataFrame:
    """The kept columns; arrays of spans assign, access, hex and owned; judged, an array of JUDGED for all of these by place; and counts of base values by class."""
    rows = cut(scan(docs, text, owner, repository, list(keep)))

    def tagged(kind: str, order: int) -> Column:
        value = lambda s: F.struct(F.xxhash64(_value(s)).alias("value_hash"), looks_live(_value(s)).alias("live"), s["begin"].alias("begin"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit("owned" if kind == "generic" else kind).alias("kind"))
        return F.transform(F.col(kind), value)

    every = F.concat(*(tagged(k, i) for i, k in enumerate((*KINDS, "generic"))))
    values = rows.filter(F.size("assign") + F.size("access") + F.size("hex") + F.size("generic") > 0)
    values = cut(values.select("row", "owner", "repository", F.explode(every).alias("x")).select("row", "owner", "repository", "x.*"))
    held = join_split(values, cut(ownership(values)), "value_hash", "places")
    name = F.when(F.col("owners") >= wide, "copied").when(F.col("owners") > 1, "shared").when(F.col("live"), "live").otherwise("plain")
    held = held.withColumn("class", name).filter((F.col("kind") != "owned") | (F.col("class") == "live"))
    of = lambda c: F.count_if((F.col("kind") != "owned") & (F.col("class") == c))
    per_row = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "order", "end", "kind", "class", "owners", "repositories"))).alias("judged"), *(of(c).alias(f"n_{c}") for c in ("live", "shared", "copied")))
    out = rows.join(per_row, "row", "left")
    judged = F.coalesce("judged", F.array().cast(f"array<{JUDGED}>"))
    blank = F.lit("")
    owned = F.transform(F.filter(judged, lambda j: j["kind"] == "owned"), lambda j: F.struct(j["begin"].alias("begin"), j["end"].alias("end"), blank.alias("match"), blank.alias("part"))).cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("long")
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), *KINDS, owned.alias("owned"), judged.alias("judged"), *(F.coalesce(f"n_{c}", zero).alias(f"n_{c}") for c in ("live", "shared", "copied")))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repository"))
    found = find_secrets(docs)
    base = {k: F.col(k) for k in KINDS}
    count = lambda k: F.size(k).cast("long")
    classes = F.array_join(F.transform("judged", lambda j: F.concat_ws(":", j["kind"], j["begin"], j["end"], j["class"])), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(base | {"owned": F.col("owned")}).alias("spans"), classes.alias("classes"), count("owned").alias("n_owned"), "n_live", "n_shared", "n_copied",
    )


def _found_sql(kind: str, order: int, pattern: str, group: int = 0) -> str:
    """SQL for (r, kind, o, b, e, v) of all matches of a pattern in d(r, t), by running sums of the lengths of pieces."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {order} AS o, b, b + length(m) AS e, v FROM (
    SELECT r, m, v, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (
      SELECT r, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
        SELECT r, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs, string_split_regex(t, '{quoted}') AS gs FROM d) WHERE len(ms) > 0)
    WINDOW w AS (PARTITION BY r ORDER BY i))"""


_LIVE_SQL = r"""length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND len(list_distinct(string_split(v, ''))) >= 10
    AND len(list_filter(list_distinct(string_split(v, '')), lambda c: contains(v, repeat(c, 6)))) = 0 AND NOT regexp_matches(v, '(?i:example|sample|placeholder|changeme|xxxx|your)')"""

#: The same with whole values in place of their hashes.
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS (
  {_found_sql("assign", 0, ASSIGN, 2)}
  UNION ALL {_found_sql("access", 1, ACCESS)}
  UNION ALL {_found_sql("hex", 2, HEX)}
), kept AS (SELECT * FROM base WHERE kind <> 'assign' OR length(v) >= 6),
generic AS (SELECT * FROM ({_found_sql("owned", 3, GENERIC)}) g WHERE {_LIVE_SQL} AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.r = g.r AND k.b < g.e AND g.b < k.e)),
every AS (SELECT x.*, owner, repository FROM (SELECT * FROM kept UNION ALL SELECT * FROM generic) x JOIN d USING (r)),
held AS (SELECT v, count(DISTINCT owner) AS owners FROM every GROUP BY v),
judged AS (SELECT * FROM (SELECT e.*, CASE WHEN owners >= {WIDE} THEN 'copied' WHEN owners > 1 THEN 'shared' WHEN {_LIVE_SQL} THEN 'live' ELSE 'plain' END AS class FROM every e JOIN held USING (v)) WHERE kind <> 'owned' OR class = 'live'),
rows AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'owned') AS n_owned,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (kind <> 'owned') AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans,
    string_agg(kind || ':' || b || ':' || e || ':' || class, ',' ORDER BY b, o) AS classes,
    count(*) FILTER (kind <> 'owned' AND class = 'live') AS n_live, count(*) FILTER (kind <> 'owned' AND class = 'shared') AS n_shared, count(*) FILTER (kind <> 'owned' AND class = 'copied') AS n_copied
  FROM judged GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_owned", "n_live", "n_shared", "n_copied"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(classes, '') AS classes
FROM d LEFT JOIN rows USING (r)
"""
