r"""Personal data by bootstrapped contextual extraction.

Four patterns find the seeds, which are the base spans: e-mail addresses, IP addresses, payment
cards (Luhn) and phone numbers. The method then learns contexts. An instance is a base span as a
whole, or a token that could be an identifier (digits or an at sign in it, six characters or more)
and lies in no base span. Its lexical patterns are three: the word before it, the word after it
(words with digits stand as their shape), and its own shape (runs of digits, of letters, and other
characters as they are, with lengths).

Patterns and instances form a graph over the whole corpus, which is scored in rounds. Seeds are
known at first. A pattern's precision is the share of its distinct instances that are known, drawn
towards the share of all by SMOOTH instances; patterns of SUPPORT known instances or more that are
more precise than the share of all speak for the places where they stand. There the odds of the
strongest pattern and half of what the others add are put together, and a place of CONFIDENT or
more, one of whose words speaks, is a find of kind ``context``. Its instance is known in the next
round, and so finds further words and shapes. An instance's own vote never counts for itself: it is
part of a pattern's known instances only once other instances have made it known, and is then
taken out where it is judged. Rounds end when they find no new instance; known ones stay known.

The graph is made of hashes of (word before, word after, shape, instance), counted before they
move, so a pattern or instance in a third of all rows is one edge for each of its partners. What
speaks is joined back by a broadcast for the patterns of many places and by a shuffle for the
others.

Defined cases: a null or empty text has no spans; at either end of a text the word is empty, which
is a pattern like any other; repeated rows get the same answer and count once; very long texts and
many matches take time in proportion, times a logarithm; an empty table gives an empty result;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, join_split, load
from sparkseek.llm.spans import SPAN, before, let, listed, spans_where, touches

# \G or the start of a run: the leftmost match begins at one of them, so runs are not read again from each place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A chain of digits is maximal where it is found, so asking for 13 drops short chains only.
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with digits or an at sign.
TOKEN = r"(?<![^\s])[^\s]*[0-9@][^\s]*"
#: The last and the first token of a piece of text that begins or ends with a space.
LAST, FIRST = r"(?<![^\s])([^\s]++)\s*\z", r"\A\s++([^\s]++)"
#: Characters of an instance at least.
LEAST_LENGTH = 6
SMOOTH = 2.0
CONFIDENT = 0.9
SUPPORT = 5
KINDS = ("email", "ip", "card", "phone")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits has a valid check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind, in the order in which kinds are listed."""
    ip = spans_where(text.rlike(IP), text, IP)
    card = spans_where(text.rlike(CARD), text, CARD)
    phone = spans_where(text.rlike(r"\+[0-9]"), text, PHONE)
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    part_ok = lambda p: F.when(small(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255).otherwise(False)
    number = lambda s: F.length(_digits(s["match"]))
    return {
        "email": spans_where(text.contains("@"), text, EMAIL),
        "ip": F.filter(ip, lambda s: F.forall(F.split(s["match"], r"\."), part_ok)),
        "card": F.filter(card, lambda s: F.when(number(s).between(13, 19), luhn(_digits(s["match"]))).otherwise(False)),
        "phone": F.filter(phone, lambda s: number(s).between(9, 15)),
    }


def shape(token: Column) -> Column:
    """The token with digits as 9 and letters as a, in runs with their lengths up to 9."""
    plain = F.regexp_replace(F.regexp_replace(token, r"[0-9]", "9"), r"\p{L}", "a")
    return F.regexp_replace(F.regexp_replace(plain, "9{10,}", "9+"), "a{3,}", "a+")


def _word(raw: Column) -> Column:
    """A neighbour as a pattern: in lower case without punctuation around it; its shape if it has digits."""
    word = F.lower(F.regexp_replace(raw, r"^[^\p{L}0-9]+|[^\p{L}0-9:=#]+$", ""))
    return F.when(word.rlike("[0-9]"), shape(word)).otherwise(word)


def tokens_with_neighbours(text: Column) -> Column:
    """The tokens with digits or at signs: begin, end, match, and the words left and right of them.

    A neighbour is the nearest token of the piece between two matches, or else the next match.
    """
    test = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    pieces = F.when(test, F.split(text, TOKEN)).otherwise(F.array().cast("array<string>"))

    def joined(x: Column) -> Column:
        found, pieces = x["found"], x["pieces"]

        def each(s: Column, i: Column) -> Column:
            left, right = F.regexp_extract(F.get(pieces, i), LAST, 1), F.regexp_extract(F.get(pieces, i + 1), FIRST, 1)
            left = F.when(left != "", left).when(i > 0, F.get(found, i - 1)["match"]).otherwise("")
            right = F.when(right != "", right).otherwise(F.coalesce(F.get(found, i + 1)["match"], F.lit("")))
            return F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["match"].alias("match"), _word(left).alias("left"), _word(right).alias("right"))

        return F.transform(found, each)

    return let(F.struct(spans_where(test, text, TOKEN).alias("found"), pieces.alias("pieces")), joined)


def _instance(begin: Column, end: Column, value: Column, left: Column, right: Column, seed: bool) -> Column:
    form = shape(value)
    key = F.xxhash64(value)
    place = F.xxhash64(key, left, right, form)
    return F.struct(begin.alias("begin"), end.alias("end"), place.alias("place"), key.alias("instance"), F.concat(F.lit("<"), left).alias("left"), F.concat(F.lit(">"), right).alias("right"), F.concat(F.lit("="), form).alias("shape"), F.lit(seed).alias("seed"))


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per row of docs: a row number, the kept columns in a struct, base spans, and instances with their patterns."""
    t = F.col(text).cast("string")
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), *(c.alias(k) for k, c in base_spans(t).items()), tokens_with_neighbours(t).alias("tokens"))

    def whole(s: Column) -> Column:
        first, last = before(F.col("tokens"), s["begin"] + 1) - 1, before(F.col("tokens"), s["end"]) - 1
        side = lambda i, c: F.coalesce(F.get("tokens", F.greatest(i, F.lit(0)))[c], F.lit(""))
        return _instance(s["begin"], s["end"], s["match"], side(first, "left"), side(last, "right"), True)

    def single(s: Column) -> Column:
        value = F.regexp_replace(s["match"], r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "")
        begin = s["end"] - F.length(F.regexp_replace(s["match"], r"^[^\p{L}0-9+]+", ""))
        return _instance(begin, begin + F.length(value), value, s["left"], s["right"], False)

    free = lambda s: ~(touches(F.col("email"), s["begin"], s["end"]) | touches(F.col("ip"), s["begin"], s["end"]) | touches(F.col("card"), s["begin"], s["end"]) | touches(F.col("phone"), s["begin"], s["end"]))
    others = F.filter(F.transform(F.filter("tokens", free), single), lambda x: x["end"] - x["begin"] >= LEAST_LENGTH)
    instances = F.concat(*(F.transform(k, whole) for k in KINDS), others)
    return rows.select("row", "kept", *KINDS, F.when(F.size("tokens") > 0, instances).otherwise(F.array().cast(_INSTANCES)).alias("instances"))


_INSTANCES = "array<struct<begin: int, end: int, place: long, instance: long, left: string, right: string, shape: string, seed: boolean>>"


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(p, F.lit(1 - 1e-4)))
    return F.log(p / (1 - p))


def pattern_precision(edges: DataFrame, known: DataFrame, share: float, support: int = SUPPORT, smooth: float = SMOOTH) -> DataFrame:
    """(pattern, k, n, precision): the patterns of enough known instances that are more precise than the share of all.

    edges holds distinct (pattern, instance), known distinct (instance).
    """
    stats = edges.join(known.select("instance", F.lit(1).alias("is_known")), "instance", "left").groupBy("pattern").agg(F.count("is_known").alias("k"), F.count("*").alias("n"))
    precision = (F.col("k") + F.lit(smooth * share)) / (F.col("n") + F.lit(smooth))
    return stats.filter(F.col("k") >= support).withColumn("precision", precision).filter(F.col("precision") > share)


def judge(spoken: DataFrame, share: float, smooth: float = SMOOTH) -> DataFrame:
    """(place, instance, score) of places from rows (place, instance, pattern, k, n, own): own says that the instance is among the known ones."""
    own = F.col("own").cast("int")
    precision = (F.col("k") - own + F.lit(smooth * share)) / (F.col("n") - own + F.lit(smooth))
    lift = F.greatest(_logit(precision) - _logit(F.lit(share)), F.lit(0.0))
    rows = spoken.withColumn("lift", lift).filter(F.col("lift") > 0)
    odds = _logit(F.lit(share)) + (F.max("lift") + F.sum("lift")) / 2
    found = rows.groupBy("place", "instance").agg(odds.alias("odds"), F.max(~F.col("pattern").startswith("=")).alias("word"))
    return found.filter("word").select("place", "instance", (1 / (1 + F.exp(-F.col("odds")))).alias("score"))


def bootstrap(places: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT, smooth: float = SMOOTH) -> DataFrame:
    """(place, score, places) of what contexts find in places (place, instance, left, right, shape, seed, places).

    places says how often the place stands in the corpus; a place is distinct.
    """
    edges = places.select("place", "instance", F.explode(F.array("left", "right", "shape")).alias("pattern"))
    graph = cut(edges.select("pattern", "instance").distinct())
    seeds = cut(places.filter("seed").select("instance").distinct())
    total = places.agg(F.count_distinct("instance")).first()[0]
    known, count, taken = seeds, seeds.count(), None
    other = cut(edges.join(seeds, "instance", "left_anti"))
    while True:
        share = count / max(1, total)
        good = cut(pattern_precision(graph, known, share, support, smooth).drop("precision"))
        marked = other.join(known.select("instance", F.lit(True).alias("own")), "instance", "left").withColumn("own", F.coalesce("own", F.lit(False)))
        spoken = join_split(marked, good.withColumn("weight", F.col("n")), "pattern", "weight")
        taken = cut(judge(spoken, share, smooth).filter(F.col("score") >= confident))
        now = cut(known.unionByName(taken.select("instance")).distinct())
        found = now.count()
        if found == count:
            break
        known, count = now, found
    return taken.join(places.select("place", "places"), "place").select("place", "score", "places")


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """The kept columns, and arrays of spans: email, ip, card, phone, context."""
    rows = cut(scan(docs, text, list(keep)))
    tokens = rows.filter(F.size("instances") > 0).select("row", F.explode("instances").alias("t")).select("row", "t.*")
    any_ = lambda c: F.any_value(c).alias(c)
    places = cut(tokens.groupBy("place").agg(any_("instance"), any_("left"), any_("right"), any_("shape"), F.max("seed").alias("seed"), F.count("*").alias("places")))
    taken = cut(bootstrap(places, confident, support))
    blank = F.lit("")
    span = F.struct("begin", "end", blank.alias("match"), blank.alias("part"))
    hits = join_split(tokens.filter(~F.col("seed")).select("row", "begin", "end", "place"), taken.select("place", "places"), "place", "places")
    found = hits.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("context"))
    out = rows.join(found, "row", "left")
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), *KINDS, F.coalesce("context", F.array().cast(f"array<{SPAN}>")).alias("context"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {k: F.col(k) for k in KINDS}
    every = base | {"context": F.col("context")}
    count = lambda k: F.size(k).cast("long")
    total = count("email") + count("ip") + count("card") + count("phone") + count("context")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(listed(base, by_kind=True), 256).alias("base_sha256"),
        listed(every, by_kind=True).alias("spans"), count("context").alias("n_context"), total.alias("n_all"),
    )
