"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters are mined from a bounded sample of labelled rows that may be learnt from (SAMPLE_ROWS, by
hash of the id). A lexicon voter is a word or the beginning of a word; it says toxic from some
number of distinct words on and else abstains. Pattern voters look at the surface (shouting,
exclamations), one says clean where no lexicon voter speaks, and the given label is one voter
more. A generative model of two classes estimates by expectation maximisation how often each
voter gives each vote in each class. Voters that agree beyond what the classes explain are
grouped by the correlation of their residuals, and the members of a group share one voice; the
model is then estimated again. Posterior labels train a logistic regression on whether one, two or
three distinct words of a text have a feature, and that alone gives the scores. Every whole text is
read. Texts of the sample are reduced to their distinct words and surface counts where they lie, so
the driver holds no texts.

Defined cases: a null or empty text has the score of a text without features; rows with a null
label teach nothing; a row whose labels differ counts for each; with no labelled rows, or rows of
one class only, every score is that class's share (0 without rows); repeated rows get the same
answer; an empty table gives an empty result; other columns are ignored or, in ``score``, kept,
whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import free_prefix, load, training_row

SAMPLE_ROWS = 8_000
MIN_DOCUMENTS = 5
FEATURES = 300
LEVELS = 3
LEXICON_VOTERS = 80
STARTS = range(3, 9)
#: Standard deviations by which a feature must tell the classes apart.
SURE = 4.0
SAME_VOICE = 0.6
#: Words whose features a Python worker remembers.
REMEMBERED = 300_000

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Observed:
    """What the learning sees of a text: its distinct words in lower case, and counts over the whole of it."""

    words: list[str]
    letters: int
    capitals: int
    exclamations: int


def observe(text: str | None) -> Observed:
    text = text or ""
    return Observed(sorted(set(_WORD.findall(text.lower()))), sum(map(str.isalpha, text)), sum(map(str.isupper, text)), text.count("!"))


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in STARTS if n <= len(word))]


class LabelModel:
    """Class-conditional vote frequencies; votes are 0, 1 or -1 for an abstention."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 25):
        self.voice = np.ones(votes.shape[1])
        seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)  # row, voter, vote
        posterior = self._fit(seen, start, rounds)
        self.voice = 1.0 / self._groups(seen, posterior)
        self.posterior = self._fit(seen, start, rounds)

    def _fit(self, seen: np.ndarray, posterior: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            toxic = np.einsum("i,ijk->jk", posterior, seen) + 0.5
            clean = np.einsum("i,ijk->jk", 1 - posterior, seen) + 0.5
            ratio = np.log(toxic / toxic.sum(axis=1, keepdims=True)) - np.log(clean / clean.sum(axis=1, keepdims=True))
            odds = np.einsum("ijk,jk->i", seen, ratio * self.voice[:, None]) + np.log(prior / (1 - prior))
            posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.accuracy = ratio
        return posterior

    def _groups(self, seen: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """For each voter, how many voters (itself included) correlate with it given the classes."""
        says = seen[:, :, 2] - seen[:, :, 1]
        weight = np.stack([posterior, 1 - posterior])
        means = weight @ says / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        rest = says - weight.T @ means
        deviation = np.sqrt((rest**2).mean(axis=0))
        both = rest.T @ rest / len(rest) / np.maximum(np.outer(deviation, deviation), 1e-12)
        return np.maximum(1, (both > SAME_VOICE).sum(axis=1))


class Classifier:
    """Logistic regression on words and beginnings of words: one weight for each level of distinct words."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.place = {f: i for i, f in enumerate(features)}
        self.steps = np.cumsum(weights.reshape(LEVELS, -1), axis=0)  # by level less one, and feature
        self.bias = bias
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> Counter:
        found: Counter = Counter()
        known, place = self.known, self.place
        for word in set(_WORD.findall((text or "").lower())):
            own = known.get(word)
            if own is None:
                own = tuple(place[f] for f in features_of(word) if f in place)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = own
            if own:
                found.update(own)
        return found

    def score(self, text: str | None) -> float:
        odds = self.bias + sum(self.steps[min(n, LEVELS) - 1, j] for j, n in self.counts(text).items())
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _z(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """How far a feature's share of toxic rows lies from the share of all, in standard deviations."""
    both, share = in_toxic + in_clean, toxic / (toxic + clean)
    return (in_toxic - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 0.25))


def fit(texts: list[Observed], labels: np.ndarray, feature_count: int = FEATURES, voters: int = LEXICON_VOTERS) -> Classifier:
    """A classifier from labelled texts as observed, by way of the label model."""
    toxic, clean = int(labels.sum()), int((1 - labels).sum())
    if not toxic or not clean:
        share = float(labels.mean()) if len(labels) else 0.0
        return Classifier([], np.empty(0), float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    pool: dict[str, str] = {}  # one object for each word, as most stand in many texts
    bags = [tuple(pool.setdefault(w, w) for w in t.words) for t in texts]
    del pool
    frequency: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for bag, label in zip(bags, labels):
        frequency[int(label)].update({f for word in bag for f in features_of(word)})
    names = [f for f in frequency[0] | frequency[1] if frequency[0][f] + frequency[1][f] >= MIN_DOCUMENTS]
    in_toxic = np.array([frequency[1][f] for f in names], dtype=np.float64)
    in_clean = np.array([frequency[0][f] for f in names], dtype=np.float64)
    likely = np.argsort(-np.abs(_z(in_toxic, in_clean, toxic, clean)), kind="stable")[: 8 * feature_count]
    names = [names[i] for i in likely]
    place = {f: i for i, f in enumerate(names)}
    counts = np.zeros((len(bags), len(names)), dtype=np.uint8)
    for row, bag in zip(counts, bags):
        for word in bag:
            for f in features_of(word):
                if (j := place.get(f)) is not None and row[j] < LEVELS:
                    row[j] += 1
    _, first = np.unique(counts, axis=1, return_index=True)  # a beginning that says the same as another is left out
    at_level = np.stack([_z((counts[labels == 1] >= t).sum(axis=0), (counts[labels == 0] >= t).sum(axis=0), toxic, clean) for t in range(1, LEVELS + 1)])
    strength = np.abs(at_level).max(axis=0)
    best = [i for i in first[np.argsort(-strength[first], kind="stable")][:feature_count] if strength[i] >= SURE]
    names, counts, at_level = [names[i] for i in best], counts[:, best], at_level[:, best]
    votes = _votes(texts, counts, labels, at_level, voters)
    posterior = LabelModel(votes, np.where(labels == 1, 0.9, 0.05)).posterior
    weights, bias = _regress(np.concatenate([counts >= t for t in range(1, LEVELS + 1)], axis=1).astype(np.float32), posterior)
    return Classifier(names, weights, bias)


def _votes(texts: list[Observed], counts: np.ndarray, labels: np.ndarray, at_level: np.ndarray, voters: int) -> np.ndarray:
    """A column for each voter: lexicon voters, patterns, silence of the lexicons, and the label."""
    columns = []
    for j in np.argsort(-at_level.max(axis=0), kind="stable")[:voters]:
        if at_level[:, j].max() >= SURE:
            columns.append(np.where(counts[:, j] > int(np.argmax(at_level[:, j])), 1, -1))
    silent = np.all([c < 0 for c in columns], axis=0) if columns else np.ones(len(texts), dtype=bool)
    letters = np.array([max(1, t.letters) for t in texts])
    shouting = np.array([t.capitals for t in texts]) > 0.6 * letters
    exclaims = np.array([t.exclamations for t in texts]) > 0.02 * letters
    columns += [np.where(silent, 0, -1), np.where(shouting, 1, -1), np.where(exclaims, 1, -1), labels]
    return np.stack(columns, axis=1)


def _regress(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam over all rows."""
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    y = y.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        gradient = np.append(x.T @ (p - y) / np.float32(len(y)) + np.float32(ridge) * w[:-1], (p - y).mean()).astype(np.float32)
        m, v = np.float32(0.9) * m + np.float32(0.1) * gradient, np.float32(0.999) * v + np.float32(0.001) * gradient**2
        w -= np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w[:-1].astype(np.float64), float(w[-1])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [observe(t.as_py()) for t in batch.column(2)]
        counts = [pa.array([getattr(x, c) for x in seen], pa.int64()) for c in ("letters", "capitals", "exclamations")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.words for x in seen], pa.list_(pa.string())), *counts], names=["_id", "label", "words", "letters", "capitals", "exclamations"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).filter(training_row(F.col("_id")) & F.col("label").isin(0, 1)).distinct()
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    chosen = F.broadcast(chosen.limit(2 * sample_rows))  # at most that many pairs of numbers
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(chosen, "_id").limit(2 * sample_rows)
    id_type = dict(rows.dtypes)["_id"]
    seen = rows.select("_id", "label", "text").mapInArrow(_observe, f"_id {id_type}, label int, words array<string>, letters long, capitals long, exclamations long")
    table = seen.toArrow().sort_by([("_id", "ascending"), ("label", "ascending")])
    texts = [Observed(*x) for x in zip(*(table[c].to_pylist() for c in ("words", "letters", "capitals", "exclamations")))]
    return fit(texts, np.array(table["label"].to_pylist(), dtype=np.int64))


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        scores = pa.array([model.score(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not named) with score; a column of that name is replaced."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes), "score double"])
    hidden = free_prefix(docs, "_text")
    return docs.select(*kept, F.col(text).cast("string").alias(hidden)).mapInArrow(partial(_score, sent=sent), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, load(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
