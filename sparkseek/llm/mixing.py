"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed in cells of (source, language, topic). The cells' weights are raked in turn to
each target marginal until every marginal is within TOLERANCE of its target, or for MAX_ROUNDS
rounds. A document's factor is its cell's raked share over its share of all tokens. A hash of the
id decides what is sampled, so the sample is the same whenever and wherever it is drawn.

One size is set for the sample: the largest of which cells, kept whole, would miss at most MISS in
all, but no less than KEEP of the tokens in cells that the targets name. A cell that would need more
tokens than it has is kept whole, what it lacks is left to the others, and those are raked again,
until no further cell is full. So the probabilities are the same multiple of the factors where no
cell is full, and rare cells don't set the size of the sample.

Targets default to the observed shares raised to TEMPERATURE and scaled to 1 for each of the
three, which lifts rare values and lowers dominant ones. A caller may give a table of targets
(value, target) for a marginal instead; values that it lacks are not sampled, and its values
that the data lack are left out before the rest are scaled to 1.

A topic is a surface class of the text that ``surface_topic`` derives, unless the caller names a
column or asks for WORDS, which are learnt from all documents (and cost several times as much as all
else). Words (runs of
LEAST_LETTERS letters or more, in lower case) are counted by documents and by occurrences. A word that
is about something comes in bursts: its occurrences stand in fewer documents than chance would spread
them over (residual inverse document frequency). The TOPICS words with the largest number of
occurrences times that measure, of those in at least LEAST_SHARE of the documents, name the topics; a
document's topic is the first of these that stands in it, or ``other``, or ``empty`` if it has no text.
Tokens are runs of characters other than space.

Only the table of cells is raked: one row per combination that occurs, summed before anything
moves, so a source with a third of all rows is one row per language and topic. Up to SMALL_CELLS of
them are raked by windows over the cells of a value; more by grouped sums that are joined back, so
that a language with most of the cells is not one task.

Defined cases: a null source, language or topic is a value of its own (``\\0null``); a null or
empty text has no tokens, weighs nothing and is kept with the probability of its cell (1 where the
whole cell weighs nothing); rows with a null id share one draw; repeated rows are drawn alike; an
empty table gives an empty result; a very long text is read whole; in ``mix`` input columns named as
output columns are replaced, and ``sample`` gives back all columns as they are, whatever they are
called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import cut, load, unit

#: For source, language and topic: 1 keeps the observed shares, 0 makes all values equal.
TEMPERATURE = {"source": 0.7, "lang": 0.9, "topic": 0.95}
TOLERANCE = 1e-6
MAX_ROUNDS = 50
#: The share of the named tokens that is sampled at least, and the share of the sample that full cells may lack beyond that.
KEEP = 0.5
MISS = 0.01
#: Cells that are raked by windows at most, and raking rounds of one job.
SMALL_CELLS = 50_000
ROUNDS_AT_ONCE = 4
#: More rows than this are joined by a shuffle.
BROADCAST_CELLS = 50_000
#: Topics, and the letters and the share of documents that a word needs to name one.
TOPICS = 12
LEAST_LETTERS = 4
LEAST_SHARE = 0.002
BUCKETS = 1 << 20
#: Bits by which a word must stand in fewer documents than chance would spread it over.
LEAST_RESIDUAL = 0.25
#: The topic that stands for words learnt from all documents, as no column is called so.
WORDS = "\0words"
MARGINS = ("source", "lang", "topic")
_OUT = ("topic", "n_tokens", "factor", "keep_probability", "draw", "sampled")
_NULL = "\0null"


def token_count(text: Column) -> Column:
    """How many runs of characters other than white space the text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def surface_topic(text: Column) -> Column:
    """A class of the text by its surface: table, shouting, marked, list or prose; empty without text."""
    n = F.length(text)
    without = lambda chars: reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)
    share = lambda rest: (n - F.length(rest)) / n
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(share(without("|")) > 0.03, "table")
        .when(share(F.regexp_replace(text, "[A-Z]+", "")) > 0.3, "shouting")
        .when(share(without("#$%&*")) > 0.05, "marked")
        .when(share(without("\n")) > 0.02, "list")
        .otherwise("prose")
    )


def words_of(text: Column) -> Column:
    """The words of a text that may name a topic, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{%d,}" % LEAST_LETTERS), F.lit(0))


def learn_topics(docs: DataFrame, text: str = "text", topics: int = TOPICS, least_share: float = LEAST_SHARE) -> list[str]:
    """The words that name topics, the strongest first, from all documents. Ties go to the word that sorts first.

    Most words are rare, and a word in enough documents falls in a bucket with at least as many. So
    buckets of words are counted first, and then the words of buckets with enough (fewer than words
    a document over least_share), which is exact and moves little.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    total = docs.count()
    least = max(2.0, total * least_share)
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))
    counted = docs.select(F.explode(F.array_distinct(F.transform(words_of(body), bucket))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    full = cut(counted.filter(F.col("n") >= least).select("bucket"))  # at most BUCKETS rows
    runs = F.transform(F.array_sort(words_of(body)), lambda w: F.struct(w.alias("word"), bucket(w).alias("bucket")))
    each = docs.select(F.explode(_marked(runs)).alias("x")).select("x.*").join(F.broadcast(full), "bucket", "left_semi")
    words = each.groupBy("word").agg(F.count_if("first").alias("documents"), F.count("*").alias("occurrences"))
    return [r["word"] for r in strongest(words, total, topics, least).collect()]


def _marked(words: Column) -> Column:
    """Sorted words, each with whether it is the first of its kind."""
    def each(words: Column) -> Column:
        first = lambda x, i: F.when(i == 0, True).otherwise(F.get(words, i - 1)["word"] != x["word"])
        return F.transform(words, lambda x, i: F.struct(x["word"].alias("word"), x["bucket"].alias("bucket"), first(x, i).alias("first")))

    return F.get(F.transform(F.array(words), each), F.lit(0))


def strongest(words: DataFrame, total: int, topics: int, least: float) -> DataFrame:
    """(word) of words (word, documents, occurrences) that are the most about something, topics of them at most."""
    n = F.lit(float(max(1, total)))
    by_chance = n * (1 - F.exp(-F.col("occurrences") / n))
    residual = F.log2(by_chance / F.col("documents"))
    often = words.filter(F.col("documents") >= least)
    scored = often.filter(residual >= LEAST_RESIDUAL).select("word", (F.col("occurrences") * residual).alias("strength"))
    return scored.orderBy(F.desc("strength"), "word").limit(topics).select("word")


def word_topic(text: Column, topics: list[str]) -> Column:
    """The first of the topics that is a word of the text; ``other`` without one, ``empty`` without text."""
    named = F.get(F.array_intersect(F.array(*map(F.lit, topics)).cast("array<string>"), words_of(text)), F.lit(0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").otherwise(F.coalesce(named, F.lit("other")))


def _targets(cells: DataFrame, margin: str, given: DataFrame | None, temperature: float) -> DataFrame:
    """(margin, target) with targets that sum to 1, over the values that carry tokens."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).filter(F.col("n") > 0)
    if given is None:
        raw = own.select(margin, F.pow(F.col("n"), F.lit(temperature)).alias("raw"))
    else:
        named = given.select(F.coalesce(F.col(given.columns[0]).cast("string"), F.lit(_NULL)).alias(margin), F.col(given.columns[1]).cast("double").alias("raw"))
        raw = own.join(named.filter(F.col("raw") > 0), margin).select(margin, "raw")
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(margin, (F.col("raw") / F.lit(float(total))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, small: int = SMALL_CELLS) -> DataFrame:
    """cells (the margins and tokens) with share, their raked share of the whole. Targets stand beside the cells."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("share", F.col("tokens") / F.lit(float(max(1, total))))
    for margin, target in targets.items():
        now = now.join(target.select(margin, F.col("target").alias(f"to{margin}")), margin, "left").fillna(0.0, [f"to{margin}"])
    now = cut(now)
    few = now.count() <= small
    now = cut(now.coalesce(1)) if few else now
    kept = now.columns
    at_once = ROUNDS_AT_ONCE if few else 1
    for _ in range(0, rounds, at_once):
        for _ in range(at_once):
            now = now.withColumn("_off", F.lit(0.0))
            for margin in targets:
                now = _scaled(now, margin) if few else _scaled_by_groups(now, margin)
        now = cut(now.select(*kept, "_off"))
        if (now.agg(F.max("_off")).first()[0] or 0.0) <= tolerance:
            break
        now = now.select(kept)
    return now.select(*cells.columns, "share")


def _times(now: DataFrame, margin: str, got: Column) -> DataFrame:
    """Shares brought to the target of the margin where they sum to got, and how far they were off."""
    now = now.withColumn("_by", F.when(got > 0, F.col(f"to{margin}") / got).otherwise(0.0)).withColumn("share", F.col("share") * F.col("_by"))
    return now.withColumn("_off", F.when(F.col("share") > 0, F.greatest("_off", F.abs(F.col("_by") - 1))).otherwise(0.0))


def _scaled(now: DataFrame, margin: str) -> DataFrame:
    return _times(now, margin, F.sum("share").over(Window.partitionBy(margin)))


def _scaled_by_groups(now: DataFrame, margin: str) -> DataFrame:
    """The same by a grouped sum that is joined back; now is cut, so it is read twice and not made twice."""
    sums = now.groupBy(margin).agg(F.sum("share").alias("_got"))
    return cut(_times(now.join(sums, margin), margin, F.col("_got")).drop("_got", "_by"))


def sample_size(cells: DataFrame, keep: float = KEEP, miss: float = MISS) -> float:
    """The share of all tokens to sample, from cells (supply, share).

    What full cells lack, as a share of the sample, is convex in the inverse of its size and made of
    straight pieces, so Newton's steps from the largest size end after finitely many at the answer.
    """
    named = float(cells.filter("share > 0").agg(F.sum("supply")).first()[0] or 1.0)
    size = named
    while True:
        short = F.col("share") * size > F.col("supply")
        want, have = cells.filter(short).agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum("supply"), F.lit(0.0))).first()
        if want - have / size <= miss + 1e-9:
            break
        size = have / (want - miss)
    return max(size, keep * named)


def allot(cells: DataFrame, size: float) -> DataFrame:
    """(the margins, keep_probability) for a sample of this size, from cells (supply, share)."""
    keys = [c for c in cells.columns if c not in ("supply", "share")]
    full = F.col("kept") > F.col("supply") * (1 + 10 * TOLERANCE)
    free = cut(cells.select(*keys, "supply", (F.col("share") * size).alias("kept")))
    done, left = [], size
    while not free.filter(full).isEmpty():
        done.append(free.filter(full).select(*keys, F.lit(1.0).alias("keep_probability")))
        left -= free.filter(full).agg(F.sum("supply")).first()[0]
        rest = free.filter(~full)
        goals = {}
        for m in keys:
            own = free.groupBy(m).agg((F.sum("kept") - F.sum(F.when(full, F.col("supply")).otherwise(0.0))).alias("raw"), F.max(F.when(full, 0.0).otherwise(F.col("kept"))).alias("open"))
            own = cut(own.filter((F.col("open") > 0) & (F.col("raw") > 0)).select(m, "raw"))
            goals[m] = own.select(m, (F.col("raw") / F.lit(float(own.agg(F.sum("raw")).first()[0] or 1.0))).alias("target"))
        raked = rake(rest.select(*keys, "supply", F.col("kept").alias("tokens")), goals)
        free = cut(raked.select(*keys, "supply", (F.col("share") * max(0.0, left)).alias("kept")))
    done.append(free.select(*keys, F.least(F.col("kept") / F.col("supply"), F.lit(1.0)).alias("keep_probability")))
    return reduce(DataFrame.unionByName, done)


def drawn(docs: DataFrame, kept: Column, slim: bool, id_col: str, text: str, source: str, lang: str, topic: str | None, targets: dict[str, DataFrame] | None, temperature: dict[str, float], seed: str, keep: float, miss: float) -> DataFrame:
    """(kept, topic, n_tokens, factor, keep_probability, draw) of the rows of docs.

    slim says that kept holds no texts: then the rows are kept once they are counted, else they are read twice.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL))
    draw = unit(F.coalesce(F.col(id_col).cast("string"), F.lit(_NULL)), F.lit(seed))
    body = F.col(text).cast("string")
    about = surface_topic(body) if topic is None else word_topic(body, learn_topics(docs, text)) if topic == WORDS else named(topic)
    rows = docs.select(kept.alias("kept"), draw.alias("draw"), named(source).alias("_source"), named(lang).alias("_lang"), about.alias("_topic"), token_count(body).alias("n_tokens"))
    rows = cut(rows) if slim else rows
    keys = [f"_{m}" for m in MARGINS]
    cells = cut(rows.groupBy(*keys).agg(F.sum("n_tokens").cast("double").alias("tokens")))
    goals = {f"_{m}": cut(_targets(cells, f"_{m}", (targets or {}).get(m), temperature[m])) for m in MARGINS}
    raked = cut(rake(cells, goals))
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    supply = cut(raked.filter("tokens > 0").select(*keys, (F.col("tokens") / total).alias("supply"), "share"))
    kept_share = allot(supply, sample_size(supply, keep, miss))
    factors = raked.select(*keys, F.when(F.col("tokens") > 0, F.col("share") * total / F.col("tokens")).alias("factor"))
    factors = cut(factors.join(kept_share, keys, "left"))
    if factors.count() <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    return rows.join(factors, keys).select("kept", F.col("_topic").alias("topic"), "n_tokens", "factor", F.coalesce("keep_probability", F.lit(1.0)).alias("keep_probability"), "draw")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: dict[str, DataFrame] | None = None, temperature: dict[str, float] = TEMPERATURE, seed: str = "mix", keep: float = KEEP, miss: float = MISS, columns: list[str] | None = None) -> DataFrame:
    """The columns of docs (all, if not named) with topic, n_tokens, factor, keep_probability, draw and sampled."""
    kept = [c for c in (docs.columns if columns is None else columns) if c not in _OUT]
    rows = drawn(docs, F.struct(*kept), text not in kept, id_col, text, source, lang, topic, targets, temperature, seed, keep, miss)
    return rows.select(*(F.col("kept")[c].alias(c) for c in kept), *_OUT[:-1], (F.col("draw") < F.col("keep_probability")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: dict[str, DataFrame] | None = None, temperature: dict[str, float] = TEMPERATURE, seed: str = "mix", keep: float = KEEP, miss: float = MISS) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    rows = drawn(docs, F.struct(*docs.columns), False, id_col, text, source, lang, topic, targets, temperature, seed, keep, miss)
    return rows.filter(F.col("draw") < F.col("keep_probability")).select("kept.*")


def op4_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(docs, columns=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("keep_probability", 6).alias("keep_probability"), "sampled")
