"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of WINDOW consecutive words of the benchmark items, and the whole of
an item with fewer words. Patterns of one length are searched together. A text is read through
blocks of BLOCK words: a shift table says how far the reading place may jump when a block ends
there; a block that ends no pattern and lies in none lets it jump over almost a whole window. At
shift 0, the bucket of the block holds the patterns that end in it, and the whole window is
compared.

A shift table is a sorted array of block hashes with a byte each, the buckets are a sorted array of
the hashes of last blocks with the place of each pattern in the words of all items, and comparison is
of the words themselves, so a benchmark word takes about 30 bytes of a Python worker.

The tables are made on the executors from the item texts. These are sent out in groups whose
bytes are bounded: the benchmark is measured first, and one larger than GROUP_BYTES is searched
group by group. Documents are then kept once with row numbers, and each group's pass gives row
numbers and hits only. Items longer than a chunk are cut into chunks that overlap by a window less
one word.

Defined cases: a null text has no words and no hits; so has a text without word characters; a
null item text has no windows; items with a null id count as the item with the empty id; equal
items hit together and are both listed; an empty benchmark hits nothing; repeated rows get the
same answer; a very long text is read whole, with memory in proportion to its words; an empty table
gives an empty result; in ``mark`` input columns named as output columns are replaced, and
``drop_contaminated`` gives back all columns as they are, whatever they are called.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, free_prefix, load

WINDOW = 13
BLOCK = 3
GROUP_BYTES = 16 << 20
CHUNK_WORDS = 20_000

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest is a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OUT = {"n_words": "long", "hit_spans": "array<struct<begin: long, end: long>>", "hit_items": "array<string>"}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


class Table:
    """Shift table and buckets for patterns of one length: windows of that many of the words, by place."""

    def __init__(self, words: list[bytes], starts: np.ndarray, length: int, block: int):
        self.words, self.length, self.block = words, length, min(block, length)
        self.far = length - self.block + 1
        begins = np.zeros(len(words) + 1, dtype=bool)  # of blocks of patterns
        for i in range(self.far):
            begins[starts + i] = True
        places = np.flatnonzero(begins)
        hashes = np.array([_hash(words[i : i + self.block]) for i in places.tolist()], dtype=np.uint64)
        shift = np.full(len(words) + 1, self.far, dtype=np.int64)  # from a block's begin to the end of the pattern that is nearest
        for back in range(self.far):
            at = starts + self.far - 1 - back
            shift[at] = np.minimum(shift[at], back)
        blocks, group = np.unique(hashes, return_inverse=True)
        least = np.full(len(blocks), self.far, dtype=np.int64)
        np.minimum.at(least, group, shift[places])
        self.blocks, self.shifts = array("Q", blocks.tobytes()), array("B", least.astype(np.uint8).tobytes())
        last = hashes[np.searchsorted(places, starts + self.far - 1)]
        order = np.argsort(last, kind="stable")
        self.lasts, self.starts = array("Q", last[order].tobytes()), array("q", starts[order].astype(np.int64).tobytes())

    def step(self, key: int) -> int:
        """How far the reading place may jump when a block of this hash ends there."""
        i = bisect_left(self.blocks, key)
        return self.shifts[i] if i < len(self.blocks) and self.blocks[i] == key else self.far

    def patterns(self, window: list[bytes], key: int) -> list[int]:
        """Where the patterns equal to the window begin, of those whose last block has this hash."""
        found = range(bisect_left(self.lasts, key), bisect_right(self.lasts, key))
        return [s for s in (self.starts[i] for i in found) if self.words[s : s + self.length] == window]


class Searcher:
    """Tables for patterns of several lengths over the words of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, block: int = BLOCK):
        if window > 255:
            raise ValueError("a window has 255 words at most")
        pool: dict[bytes, bytes] = {}  # one object for each word
        words: list[bytes] = []
        self.items, self.begins = [], array("q")
        starts: dict[int, list[np.ndarray]] = {}
        for item, own in items:
            length = min(window, len(own))
            if length:
                self.items.append(item)
                self.begins.append(len(words))
                starts.setdefault(length, []).append(len(words) + np.arange(len(own) - length + 1))
                words += [pool.setdefault(w, w) for w in own]
        self.tables = [Table(words, np.concatenate(s), length, block) for length, s in starts.items()]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The word spans (begin, end) that occurrences cover, joined, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(words)
        for table in self.tables:
            at, length, size, step = table.length, table.length, table.block, table.step
            while at <= n:
                key = _hash(words[at - size : at])
                jump = step(key)
                if jump:
                    at += jump
                    continue
                found = table.patterns(words[at - length : at], key)
                if found:
                    spans.append((at - length, at))
                    items.update(self.items[bisect_right(self.begins, s) - 1] for s in found)
                at += 1
        return joined(spans), items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CHUNK_WORDS - window + 1)
    for batch in batches:
        ids, texts = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text.encode() if text else None)
            for i in range(0, max(1, len(words) - window + 1), step) if words else ():
                ids.append(item)
                texts.append(b" ".join(words[i : i + CHUNK_WORDS]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])


def _searcher(sent) -> Searcher:
    """The searcher of a broadcast group, made once a Python worker."""
    if not hasattr(sent, "searcher"):
        items, window, block = sent.value
        sent.searcher = Searcher([(i, t.encode().split()) for i, t in items], window, block)
    return sent.searcher


def _search(batches: Iterator[pa.RecordBatch], sent, text: int, kept: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns of each batch and what is found in its texts."""
    searcher = _searcher(sent)
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        column = batch.column(text)
        texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        counts, spans, items = [], [], []
        for t in texts:
            words = words_of(t.as_py())
            found = searcher.search(words)
            counts.append(len(words))
            spans.append([{"begin": b, "end": e} for b, e in found[0]])
            items.append(sorted(found[1]))
        arrays = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *arrays], names=[*(batch.schema.names[i] for i in kept), *names])


def _union_of_spans(spans: Column) -> Column:
    """Spans of several passes, joined where they meet."""
    def add(state: Column, s: Column) -> Column:
        open_ = state["open"]
        meets = s["begin"] <= open_["end"]
        wider = F.struct(open_["begin"].alias("begin"), F.greatest(open_["end"], s["end"]).alias("end"))
        return F.when(meets, F.struct(state["done"].alias("done"), wider.alias("open"))).otherwise(F.struct(F.concat(state["done"], F.array(open_)).alias("done"), s.alias("open")))

    kind = _OUT["hit_spans"]
    ordered = F.array_sort(spans)
    start = F.struct(F.array().cast(kind).alias("done"), F.get(ordered, F.lit(0)).alias("open"))
    joined_up = F.aggregate(F.slice(ordered, F.lit(2), F.size(ordered)), start, add, lambda state: F.concat(state["done"], F.array(state["open"])))
    return F.when(F.size(spans) == 0, F.array().cast(kind)).otherwise(joined_up)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, group_bytes: int = GROUP_BYTES, prefix: str = "") -> DataFrame:
    """docs with n_words, hit_spans (word spans that occurrences cover, joined) and hit_items (sorted), each after the prefix."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    chunks = cut(items.mapInArrow(partial(_chunks, window=window), "item string, text string"))
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    groups = 1 if size <= group_bytes else -(-2 * size // group_bytes)  # a group is half full on average
    out = {f"{prefix}{c}": t for c, t in _OUT.items()}
    kept = [c for c in docs.columns if c not in out or c == text]
    schema = lambda df: ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, *out.items()])

    def send(group: int):
        own = chunks if groups == 1 else chunks.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group)
        return docs.sparkSession.sparkContext.broadcast(([(r["item"], r["text"]) for r in own.collect()], window, block))

    if groups == 1:
        df = docs.select(*kept, F.col(text).cast("string").alias(free_prefix(docs, "_text"))) if dict(docs.dtypes)[text] != "string" else docs.select(kept)
        place = len(df.columns) - 1 if len(df.columns) > len(kept) else kept.index(text)
        columns = [i for i, c in enumerate(kept) if c not in out]
        return df.mapInArrow(partial(_search, sent=send(0), text=place, kept=columns, names=list(out)), schema(docs.select(*(kept[i] for i in columns))))
    row = free_prefix(docs, "_row")
    rows = cut(docs.select(F.monotonically_increasing_id().alias(row), *kept))
    texts = rows.select(row, F.col(text).cast("string").alias("text"))
    passes = [texts.mapInArrow(partial(_search, sent=send(g), text=1, kept=[0], names=list(_OUT)), schema_of_pass(row)) for g in range(groups)]
    counts = cut(passes[0].select(row, "n_words"))
    hits = reduce(DataFrame.unionByName, [cut(p.filter(F.size("hit_items") > 0)) for p in passes])
    found = hits.groupBy(row).agg(_union_of_spans(F.flatten(F.collect_list("hit_spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("items"))
    named = counts.join(found, row, "left").select(F.col(row), F.col("n_words").alias("n"), F.coalesce("spans", F.array().cast(_OUT["hit_spans"])).alias("s"), F.coalesce("items", F.array().cast("array<string>")).alias("i"))
    named = named.toDF(row, *out)
    return rows.select(row, *(c for c in kept if c not in out)).join(named, row).drop(row)


def schema_of_pass(row: str) -> str:
    return ", ".join(f"{c} {t}" for c, t in {row: "long", **_OUT}.items())


def n_hit(spans: str = "hit_spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def is_contaminated(prefix: str = "") -> Column:
    """Some word is hit, and at least a twentieth of all words."""
    hit = n_hit(f"{prefix}hit_spans")
    return (hit > 0) & (20 * hit >= F.col(f"{prefix}n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with its columns as they are."""
    prefix = free_prefix(docs, "_found_")
    return mark(docs, benchmark, prefix=prefix, **options).filter(~is_contaminated(prefix)).select(docs.columns)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, load(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("hit_items"), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


#: The same by comparing every window of the benchmark with every window of the documents.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), w AS (
  SELECT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), t AS (
  SELECT r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)
), m AS (
  SELECT DISTINCT r, i, n, item FROM t JOIN w USING (n, g)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
