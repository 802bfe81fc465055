"""Chat formatting that first collapses cumulative snapshots of one conversation.

A log that is written after every turn holds each conversation many times, each time as a prefix
of the next. For every turn, a rolling hash of all turns up to it is kept; a conversation whose
whole hash is the hash of a proper prefix of another is dropped by an anti-join, and of equal
conversations the one with the smallest id stays. What is left is rendered.

The rolling hash of a prefix is the sum, over its turns, of two XXH64 of (place, role, text), kept
in 32-bit lanes so that sums of up to 2**31 turns cannot overflow, together with the number of
turns. Being a sum, it can be made in two steps: places and sums within segments of a
conversation, then running totals over segments. So a conversation of any length is dealt over
many tasks up to the rendering, which makes one row of it. Only hashes move until then, and
prefix hashes are deduplicated before they are moved. Conversations whose turn numbers lie in one
segment skip the second step.

Turns are ordered by turn, then role and text; nulls come first. A turn's place is its rank in
that order, so gaps in turn numbers don't matter.

Defined cases: rows with a null conv_id belong to no conversation and are left out; a null role
renders as ``unknown`` and a null text as an empty text, but differ from those in the hash;
repeated rows are turns of their own; control marks within texts are broken up, so that a text
can't end its turn; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import cut, load

#: Turns of one conversation whose numbers are within a segment of this width are summed in one task.
SEGMENT = 4_096
#: Conversations of several segments that are broadcast at most.
BROADCAST_CONVERSATIONS = 100_000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_LANES = ("a", "b", "c", "d")


def _content(salt: str = "") -> Column:
    """A hash of a turn's role and text, in which nulls differ from empty ones."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _lanes_of(n: str = "n") -> dict[str, Column]:
    mask = F.lit(0xFFFFFFFF)
    one, two = F.xxhash64(n, "x", "y"), F.xxhash64("y", n, "x")
    return {"a": one.bitwiseAND(mask), "b": F.shiftrightunsigned(one, 32), "c": two.bitwiseAND(mask), "d": F.shiftrightunsigned(two, 32)}


def _prefix(sums: list[Column]) -> Column:
    return F.concat_ws(":", "n", F.concat(*(F.lpad(F.hex(s), 16, "0") for s in sums)))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h, last): the hash of the first n turns, for every n; last marks the whole.

    Conversations of one segment, as nearly all are, take one exchange and one sort. Those of several
    are told first, by their turn numbers, and dealt by segments.
    """
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))  # null turns come first
    # Rows that tie in turn are ordered by their hashes: equal rows are interchangeable.
    rows = turns.select("conv_id", segment.alias("segment"), "turn", _content().alias("x"), _content("second").alias("y"))
    span = rows.groupBy("conv_id").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    several = cut(span.filter(F.col("low") < F.col("high")).select("conv_id"))
    count = several.count()
    if not count:
        return _in_one_segment(rows)
    several = F.broadcast(several) if count <= BROADCAST_CONVERSATIONS else several
    return _in_one_segment(rows.join(several, "conv_id", "left_anti")).unionByName(_in_segments(rows.join(several, "conv_id", "left_semi")))


def _in_one_segment(rows: DataFrame) -> DataFrame:
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "x", "y")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    rows = rows.withColumns(_lanes_of()).withColumns({f"to_{k}": F.sum(k).over(upto) for k in _LANES} | {"length": F.count("*").over(whole)})
    return rows.select("conv_id", "n", _prefix([F.col(f"to_{k}") for k in _LANES]).alias("h"), (F.col("n") == F.col("length")).alias("last"))


def _in_segments(rows: DataFrame) -> DataFrame:
    """The same in two steps: places and sums within segments, then running totals over them."""
    key = ["conv_id", "segment"]
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*key).orderBy("turn", "x", "y")
    rows = rows.withColumn("i", F.row_number().over(within)).join(starts, key).withColumn("n", (F.col("start") + F.col("i")).cast("long"))
    rows = rows.select(*key, "n", *(c.alias(k) for k, c in _lanes_of().items()))
    sums = rows.groupBy(*key).agg(*(F.sum(k).alias(k) for k in _LANES), F.max("n").alias("end"))
    base = sums.select(*key, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"base_{k}") for k in _LANES), F.max("end").over(Window.partitionBy("conv_id")).alias("length"))
    upto = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"to_{k}": F.sum(k).over(upto) for k in _LANES}).join(base, key)
    return rows.select("conv_id", "n", _prefix([F.col(f"to_{k}") + F.col(f"base_{k}") for k in _LANES]).alias("h"), (F.col("n") == F.col("length")).alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another."""
    hashes = cut(prefix_hashes(turns))
    ends = hashes.filter("last").groupBy("h").agg(F.min("conv_id").alias("conv_id"), F.max("n").alias("n_turns"), F.count("*").alias("n_copies"))
    inner = hashes.filter(~F.col("last")).select("h").distinct()
    return ends.join(inner, "h", "left_anti").select("conv_id", "n_turns", "n_copies")


def render(role: Column, text: Column) -> Column:
    """One turn between control marks; marks within the text are broken up."""
    broken = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    name = F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[^A-Za-z0-9_-]", "_")
    return F.concat(F.lit(OPEN), name, F.lit("\n"), broken, F.lit(f"{CLOSE}\n"))


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): one rendered row per maximal conversation."""
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).filter(F.col("conv_id").isNotNull())
    rows = turns.join(maximal_conversations(turns), "conv_id")
    rows = rows.select("conv_id", "n_turns", "n_copies", F.struct("turn", _content().alias("x"), _content("second").alias("y"), render(F.col("role"), F.col("text")).alias("chat")).alias("t"))
    chat = F.array_join(F.transform(F.array_sort(F.collect_list("t"), _by_place), lambda t: t["chat"]), "")
    return rows.groupBy("conv_id").agg(F.any_value("n_turns").alias("n_turns"), F.any_value("n_copies").alias("n_copies"), chat.alias("chat"))


def _by_place(a: Column, b: Column) -> Column:
    """Orders turns as their places are: null turn numbers first, ties by hash."""
    first = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return first.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(0)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(load(spark, sf_dir, "conversations"))


#: Names the same conversations without hashes: by comparing whole lists of turns.
OP6_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), wholes AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS said, count(*) AS n_turns,
         string_agg('<|im_start|>' || regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_-]', '_', 'g') || chr(10)
           || replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
  FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT md5(CAST(list_slice(said, 1, n.n) AS VARCHAR)) AS h
  FROM wholes, LATERAL (SELECT unnest(range(1, n_turns)) AS n) n
)
SELECT min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS n_copies, min_by(chat, conv_id) AS chat
FROM wholes WHERE md5(CAST(said AS VARCHAR)) NOT IN (SELECT h FROM prefixes) GROUP BY said
"""
