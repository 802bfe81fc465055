"""Language identification with one interpolated Kneser-Ney character model per language.

A text is reduced to lower-case letters with single spaces between runs of them. Character
4-grams are counted per language over all rows that may be learnt from, in numpy within
partitions and then in Spark. From the counts, every language gets an interpolated Kneser-Ney
model (one absolute discount per order, continuation counts below the highest order, a uniform
floor). A language's model is a sorted array of 64-bit hashes of its n-grams for each order, with
their log-probabilities, and a like pair for contexts with the weights of the lower order. A text's
language is the one with the lowest cross-entropy per character.

Rejection is calibrated on all training rows whose language the models find: a text is rejected if
its cross-entropy lies further above its language's usual value (the median) than SLACK times the
distance that a share QUANTILE of its language's rows stay within, where a distance is scaled by the
root of the length. A language with fewer than LEAST_ROWS such rows takes this distance from the rows
of all languages, and one without any the usual value, too. A text without a letter is also rejected.

All 4-grams are kept, so discounts and continuation counts come from all, and no language is lost;
the model grows with the distinct (language, 4-gram) pairs of the corpus: about 20 bytes each. It is
measured before it is sent out. Languages of up to MODEL_BYTES together are sent at once; more are
scored group by group, each over all rows, with the cross-entropies found so far carried along.

Defined cases: a null text and a text without a letter get ``und``, score 0 and are rejected; rows
with a null language teach nothing; ties go to the language that sorts first; with no row to
learn from, every text is ``und``; repeated rows get the same answer; a very long text is read whole
in steps of a bounded size; an empty table gives none; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, free_prefix, load, training_row

ORDER = 4
SLACK = 2.5
QUANTILE = 0.999
LEAST_ROWS = 1000
#: Bins in which calibration counts a unit of cross-entropy and of distance.
ENTROPY_BINS, DISTANCE_BINS = 1000, 100
#: Characters that one step of the scorer or counter holds.
STEP = 1 << 20
#: Bytes of the languages' models that are broadcast and held at once.
MODEL_BYTES = 512 << 20
_SPACE = 32
#: An odd multiplier: multiplication modulo 2**64 is one-to-one and spreads packed n-grams evenly.
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter in 16 bits, or the space."""
    table = np.full(0x110000, _SPACE, dtype=np.uint16)
    for start, end in ((0, 0x3400), (0x3400, 0xD800), (0xE000, 0x20000), (0x20000, 0x32000)):
        for i in range(start, end):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = (ord(low) if len(low) == 1 else i) % 0xFFFB
    return table


def symbols(text: str | None) -> np.ndarray:
    """The letters of a text, with one space before, after and between runs; empty without letters."""
    if not text:
        return np.empty(0, dtype=np.uint16)
    got = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = got == _SPACE
    if space.all():
        return got[:0]
    keep = ~space
    keep[1:] |= ~space[:-1]
    got = got[keep]
    return np.concatenate([got[int(got[0] == _SPACE) :], np.full(int(got[-1] != _SPACE), _SPACE, dtype=np.uint16)])


_PAD = np.full(ORDER - 1, _SPACE, dtype=np.uint16)


def packed(parts: list[np.ndarray], heads: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of each part, packed in 64 bits; the length of each part.

    Before a part stands its head of ORDER - 1 characters, which are spaces if heads are not given.
    """
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    row = np.concatenate([x for pair in zip(heads or [_PAD] * len(parts), parts) for x in pair]).astype(np.uint64)
    grams = row.copy()
    for back in range(1, ORDER):
        grams[back:] |= row[:-back] << np.uint64(16 * back)
    real = np.ones(len(row), dtype=bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for i in range(ORDER - 1):
        real[starts + i] = False
    return grams[real], lengths


def _steps(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
    """Texts with letters, as (places, symbols, heads), about STEP characters at a time; a longer text comes in pieces."""
    at, parts, heads, size = [], [], [], 0
    for i, text in enumerate(texts):
        s = symbols(text)
        for begin in range(0, len(s), STEP):
            at.append(i)
            parts.append(s[begin : begin + STEP])
            heads.append(s[begin - ORDER + 1 : begin] if begin else _PAD)
            size += len(parts[-1])
            if size >= STEP:
                yield at, parts, heads
                at, parts, heads, size = [], [], [], 0
    if at:
        yield at, parts, heads


def _merge(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys = np.concatenate([p[0] for p in pieces])
    counts = np.concatenate([p[1] for p in pieces])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(keys[first], np.add.reduceat(counts, first))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, 4-gram) of a partition, merged whenever they have grown."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = batch.column(1)
        for lang in sorted(set(langs)):
            own = [texts[i].as_py() for i, x in enumerate(langs) if x == lang]
            for _, parts, heads in _steps(own):
                pieces = held.setdefault(lang, [])
                keys, counts = np.unique(packed(parts, heads)[0], return_counts=True)
                pieces.append((keys, counts.astype(np.int64)))
                if len(pieces) >= 16:
                    held[lang] = _merge(pieces)
    for lang, pieces in held.items():
        keys, counts = _merge(pieces)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows of docs with a language."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    partial_counts = rows.filter(F.col("text").isNotNull()).mapInArrow(_count, "lang string, gram long, n long")
    return partial_counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Values by hashed key, found in a sorted array of hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys * _MIX
        order = np.argsort(hashed)
        self.hashes, self.values = hashed[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found) of each key."""
        hashed = keys * _MIX
        row = np.searchsorted(self.hashes, hashed)
        row[row == len(self.hashes)] = 0
        return row, self.hashes[row] == hashed if len(self.hashes) else np.zeros(len(keys), dtype=bool)

    @property
    def bytes(self) -> int:
        return self.hashes.nbytes + self.values.nbytes


def _suffix(grams: np.ndarray, k: int) -> np.ndarray:
    """The last k characters of packed grams."""
    return grams & np.uint64((1 << 16 * k) - 1)


class Language:
    """The Kneser-Ney model of one language."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, floor: float):
        """grams: distinct packed ORDER-grams in order; counts: how often they occur; floor: the chance of any character."""
        by_order = {ORDER: (grams, counts.astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):  # a lower order counts the distinct characters before
            own, n = np.unique(_suffix(by_order[k + 1][0], k), return_counts=True)
            by_order[k] = own, n.astype(np.float64)
        self.floor = np.log(floor)
        self.grams: dict[int, Lookup] = {}
        self.contexts: dict[int, Lookup] = {}
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(1, ORDER + 1):
            g, c = by_order[k]
            n1, n2 = np.sum(c == 1), np.sum(c == 2)
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            before, context, kinds = np.unique(g >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(context, weights=c, minlength=len(before))
            weights = discount * kinds / total
            lower = np.full(len(g), floor) if below is None else below[1][np.searchsorted(below[0], _suffix(g, k - 1))]
            p = weights[context] * lower + np.maximum(c - discount, 0) / total[context]
            self.grams[k], self.contexts[k] = Lookup(g, np.log(p)), Lookup(before, np.log(weights))
            below = g, p

    def log_p(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """The log-probability of the last character of each k-gram."""
        if k == 0:
            return np.full(len(grams), self.floor, dtype=np.float32)
        row, found = self.grams[k].find(grams)
        out = self.grams[k].values[row]
        if not found.all():
            lost = np.flatnonzero(~found)
            rest = self.log_p(_suffix(grams[lost], k - 1), k - 1)
            context, known = self.contexts[k].find(grams[lost] >> np.uint64(16))
            rest[known] += self.contexts[k].values[context[known]]
            out[lost] = rest
        return out

    @property
    def bytes(self) -> int:
        return sum(x.bytes for part in (self.grams, self.contexts) for x in part.values())


class Model:
    """Kneser-Ney models of several languages, and what calibrates their rejection."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        """grams and counts: per language, distinct packed ORDER-grams in order and how often they occur."""
        alphabet = len(np.unique(np.concatenate([np.unique(_suffix(g, 1)) for g in grams]))) + 1
        self.langs, self.floor = langs, float(np.log(1.0 / alphabet))
        self.models = [Language(g, c, 1.0 / alphabet) for g, c in zip(grams, counts)]
        self.usual = np.zeros(len(langs))
        self.limit = np.full(len(langs), np.inf)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy of each text in each language, letters and spaces scored)."""
        sums = np.zeros((len(texts), len(self.models)))
        lengths = np.zeros(len(texts), dtype=np.int64)
        for at, parts, heads in _steps(texts):
            grams, n = packed(parts, heads)
            distinct, place = np.unique(grams, return_inverse=True)
            begins = np.cumsum(n) - n
            for i, model in enumerate(self.models):
                np.add.at(sums[:, i], at, np.add.reduceat(model.log_p(distinct)[place], begins, dtype=np.float64))
            np.add.at(lengths, at, n)
        return np.where(lengths[:, None] > 0, -sums / np.maximum(lengths, 1)[:, None], np.nan), lengths

    def groups(self, most: int) -> list[Model]:
        """Parts of the model in turn, whose languages take up to most bytes together (or are one language)."""
        out: list[Model] = []
        size = 0
        for model in self.models:
            if not out or size + model.bytes > most:
                out.append(copy(self))
                out[-1].models, size = [], 0
            out[-1].models.append(model)
            size += model.bytes
        return out

    def distance(self, entropy: np.ndarray, lang: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return (entropy - self.usual[lang]) * np.sqrt(np.minimum(lengths, 400))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        return self.decide(*self.entropies(texts))

    def decide(self, h: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The same from the cross-entropies in all languages and the lengths."""
        some = n > 0
        best = np.where(some, np.argmin(np.where(some[:, None], h, 0), axis=1), 0)
        low = h[np.arange(len(n)), best]
        with np.errstate(invalid="ignore"):
            share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
            rejected = ~some | (self.distance(low, best, n) > self.limit[best])
        score = np.where(some, share * np.where(rejected, 0.5, 1.0), 0.0)
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], score, low, rejected


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", slack: float = SLACK, model_bytes: int = MODEL_BYTES) -> Model | None:
    """A model of the languages of docs, from rows that may be learnt from; None if there are none."""
    rows = docs.filter(training_row(F.col(doc_id)) & F.col(lang).isNotNull())
    counted = cut(gram_counts(rows, text, lang))
    table = counted.toArrow()
    if not table.num_rows:
        return None
    langs = sorted(table["lang"].unique().to_pylist())
    codes = pc.index_in(table["lang"], value_set=pa.array(langs, table["lang"].type)).to_numpy()
    grams, counts = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.lexsort((grams, codes))
    bounds = np.searchsorted(codes[order], np.arange(1, len(langs)))
    model = Model(langs, np.split(grams[order], bounds), np.split(counts[order], bounds))
    _calibrate(model, rows, text, lang, slack, model_bytes)
    return model


def _quantiles(measured: DataFrame, value: Column, bins: int, share: float) -> tuple[dict[int, float], dict[int, int]]:
    """(quantile, rows) of the value by language, exact to a bin; -1 stands for all languages together."""
    counted = measured.groupBy("lang", F.floor(value * bins).alias("bin")).agg(F.count("*").alias("k")).toArrow()
    lang, at, k = (counted[c].to_numpy() for c in ("lang", "bin", "k"))
    found, rows = {}, {}
    for i in [-1, *np.unique(lang).tolist()] if len(k) else []:
        own = np.flatnonzero(lang == i) if i >= 0 else np.arange(len(k))
        own = own[np.argsort(at[own], kind="stable")]
        upto = np.cumsum(k[own])
        rows[i] = int(upto[-1])
        found[i] = float((at[own[np.searchsorted(upto, share * upto[-1])]] + 1) / bins)
    return found, rows


def _measure(batches: Iterator[pa.RecordBatch], sent, text: int, first: bool, added: list[str]) -> Iterator[pa.RecordBatch]:
    """Appends the lengths and the cross-entropies in the languages sent, or these alone to what is there."""
    for batch in batches:
        h, n = sent.value.entropies(batch.column(text).to_pylist())
        if first:
            kept, h = batch.columns, list(h)
        else:
            kept, h = batch.columns[:-2], [np.concatenate([old, new]) for old, new in zip(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), h)]
        names = batch.schema.names[: len(kept)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(h, pa.list_(pa.float64()))], names=[*names, *added])


def measured(rows: DataFrame, groups: list[Model], text: str, prefix: str = "") -> DataFrame:
    """rows with n and h, after the prefix: the letters and spaces scored, and the cross-entropies in all languages in order."""
    sc = rows.sparkSession.sparkContext
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{prefix}n` long, `{prefix}h` array<double>"])
    place = rows.columns.index(text)
    for i, group in enumerate(groups):
        rows = rows.mapInArrow(partial(_measure, sent=sc.broadcast(group), text=place, first=i == 0, added=[f"{prefix}n", f"{prefix}h"]), schema)
        if i + 1 < len(groups):
            rows = cut(rows)
    return rows


def _calibrate(model: Model, rows: DataFrame, text: str, lang: str, slack: float, model_bytes: int) -> None:
    """Sets each language's usual value and limit from all rows known to be in it."""
    named = F.array_position(F.lit(model.langs), F.col("lang")).cast("long") - 1
    texts = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = measured(texts, model.groups(model_bytes), "text").filter((F.col("n") > 0) & (named >= 0))
    entropy = F.element_at("h", (F.col("lang") + 1).cast("int"))
    seen = cut(found.select(named.alias("lang"), "n", "h").filter(F.array_position("h", F.array_min("h")) == F.col("lang") + 1).select("lang", entropy.alias("entropy"), "n"))
    everywhere = range(len(model.langs))
    usual, n_rows = _quantiles(seen, F.col("entropy"), ENTROPY_BINS, 0.5)
    model.usual[:] = [usual.get(i, usual.get(-1, -model.floor)) for i in everywhere]
    above = (F.col("entropy") - F.element_at(F.lit(model.usual.tolist()), (F.col("lang") + 1).cast("int"))) * F.sqrt(F.least("n", F.lit(400)))
    far, _ = _quantiles(seen, above, DISTANCE_BINS, QUANTILE)
    reach = [far[i] if n_rows.get(i, 0) >= LEAST_ROWS else far.get(-1, 0.0) for i in everywhere]
    model.limit[:] = [slack * max(0.0, x) + 1e-9 for x in reach]


_OUT = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}


def _predict(batches: Iterator[pa.RecordBatch], sent, text: int, kept: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        lang, score, entropy, rejected = model.predict(batch.column(text).to_pylist())
        found = [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *found], names=[*batch.schema.names[:kept], *names])


def _decide(batches: Iterator[pa.RecordBatch], sent, kept: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        h = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, len(model.langs))
        lang, score, entropy, rejected = model.decide(h, batch.column(batch.num_columns - 2).to_numpy())
        found = [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *found], names=[*batch.schema.names[:kept], *names])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, prefix: str = "", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """The kept columns of docs (all, if not named) with lang_pred, score, cross_entropy and rejected.

    The prefix stands before these names; columns of docs with such a name are replaced.
    """
    out = {f"{prefix}{c}": t for c, t in _OUT.items()}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in out]
    if model is None:
        values = (F.lit("und"), F.lit(0.0), F.lit(None).cast("double"), F.lit(True))
        return docs.select(*kept, *(v.alias(c) for c, v in zip(out, values)))
    sc = docs.sparkSession.sparkContext
    hidden = free_prefix(docs, "_text")
    carried = text in kept and dict(docs.dtypes)[text] == "string"  # then the text need not be sent twice
    rows = docs.select(*kept) if carried else docs.select(*kept, F.col(text).cast("string").alias(hidden))
    place = kept.index(text) if carried else len(kept)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*docs.select(*kept).dtypes, *out.items()])
    groups = model.groups(model_bytes)
    if len(groups) == 1:
        return rows.mapInArrow(partial(_predict, sent=sc.broadcast(model), text=place, kept=len(kept), names=list(out)), schema)
    limits = copy(model)
    limits.models = []
    return measured(rows, groups, text if carried else hidden, free_prefix(rows, "_measured_")).mapInArrow(partial(_decide, sent=sc.broadcast(limits), kept=len(kept), names=list(out)), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = identify(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
