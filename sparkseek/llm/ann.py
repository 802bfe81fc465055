"""Approximate nearest neighbours by inner product, over balanced posting lists.

Vectors get one more component that makes all of equal length (so the largest inner product is
the smallest distance), and a bounded sample of them is halved along its main direction again
and again, which gives balanced cells; their means are the centroids. A graph of near centroids is
held in memory and searched by beam. Every vector goes to the list of its nearest centroid, and a
boundary vector also to the next lists, up to REPLICAS in all, whose distance is within
REPLICA_RATIO of the nearest. A query reads the lists whose centroid distance is within a
ratio of its nearest centroid's. That ratio is calibrated on the sample, against brute force
there, to reach TARGET_RECALL.

Only the centroids come from a sample (SAMPLE_ROWS); every row is in the index and every query is
answered; a query whose lists hold fewer than k rows is compared with all rows instead. Small lists that follow each other are read in one task of about BLOCK_ROWS rows, which
passes on the k best of each query; a large list is read in blocks of as many, and its queries in
blocks too, so neither a hot list nor a hot query group lands in one task. Scores are inner products of the
original components in double precision; ties go to the smaller id.

Defined cases: vectors that are null, empty or zero, hold a null or non-finite component, or have
a null id take no part; vectors of different lengths have no inner product, so each length is
searched by itself; of rows that share an id and a length, the one with the smallest vector counts,
and of lengths that share an id, each has ranks of its own; fewer candidates than k are all
returned; ties go to the smaller id; an empty table gives an empty result; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkseek.llm.common import cut, load

K = 20
LIST_ROWS = 512
SAMPLE_ROWS = 40_000
MAX_LISTS = 4_096
REPLICAS = 2
REPLICA_RATIO = 1.005
TARGET_RECALL = 0.96
CALIBRATION_QUERIES = 200
DEGREE = 16
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 4_096


def _even(v: np.ndarray, most: float) -> np.ndarray:
    """v with a last component that makes every row's norm equal to most."""
    rest = np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", v, v)))
    return np.column_stack([v, rest])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def balanced_centroids(v: np.ndarray, lists: int) -> np.ndarray:
    """Means of cells of almost equal size, from halving v along its main direction."""
    cells, out = [(np.arange(len(v)), lists)], []
    rng = np.random.default_rng(0)
    while cells:
        rows, n = cells.pop()
        if n <= 1 or len(rows) < 2:
            out.append(v[rows].mean(axis=0))
            continue
        part = v[rows] - v[rows].mean(axis=0)
        axis = rng.standard_normal(v.shape[1])
        for _ in range(8):
            axis = part.T @ (part @ axis)
            axis /= max(np.linalg.norm(axis), 1e-30)
        low = n // 2
        order = np.argsort(part @ axis, kind="stable")
        at = len(rows) * low // n
        cells += [(rows[order[:at]], low), (rows[order[at:]], n - low)]
    return np.array(out)


class Router:
    """Centroids with a graph that is searched by beam."""

    def __init__(self, centroids: np.ndarray, most: float):
        self.most = most
        self.centroids = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        near = np.empty((n, 0), dtype=np.int64)
        if degree > 0:
            near = np.concatenate([np.argsort(_distances(centroids[i : i + 256], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 256)])
        ring = (np.arange(n)[:, None] + np.array([1, max(1, n // 3), max(1, n // 2)])) % n  # keeps the graph connected
        self.graph = np.concatenate([near, ring], axis=1)
        self.ratio, self.beam = 1.0, min(n, 8)

    def nearest(self, v: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of the nearest centroids that the beam search finds, nearest first."""
        n, rows = len(self.centroids), np.arange(len(v))
        beam = min(beam, n)
        starts = np.unique(np.linspace(0, n - 1, min(n, max(8, beam))).astype(np.int64))
        d = _distances(v, self.centroids[starts])
        seen = np.zeros((len(v), n), dtype=bool)
        seen[:, starts] = True
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids, d = starts[order], np.take_along_axis(d, order, axis=1)
        if d.shape[1] < beam:
            gap = beam - d.shape[1]
            ids, d = np.pad(ids, ((0, 0), (0, gap))), np.pad(d, ((0, 0), (0, gap)), constant_values=np.inf)
        spread = np.zeros(ids.shape, dtype=bool)
        while True:
            open_ = ~spread & np.isfinite(d)
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return ids, d
            at = np.argmax(open_[live], axis=1)
            spread[live, at] = True
            to = self.graph[ids[live, at]]
            new = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            gap = v[live][:, None, :] - self.centroids[to]
            far = np.where(new, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.inf)
            twice = np.zeros(to.shape, dtype=bool)  # a centroid that the ring and the neighbours both name
            sorted_to = np.argsort(to, axis=1, kind="stable")
            inner = np.take_along_axis(to, sorted_to, axis=1)
            np.put_along_axis(twice, sorted_to[:, 1:], inner[:, 1:] == inner[:, :-1], axis=1)
            far[twice] = np.inf
            all_d = np.concatenate([d[live], far], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            d[live] = np.take_along_axis(all_d, order, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], to], axis=1), order, axis=1)
            spread[live] = np.take_along_axis(np.concatenate([spread[live], np.zeros(to.shape, dtype=bool)], axis=1), order, axis=1)

    def lists_of(self, v: np.ndarray) -> np.ndarray:
        """True where a row of v belongs in a list; (rows, REPLICAS) of lists and of that."""
        ids, d = self.nearest(_even(v, self.most), max(8, 2 * REPLICAS))
        ids, d = ids[:, :REPLICAS], d[:, :REPLICAS]
        keep = d <= REPLICA_RATIO * d[:, :1]
        keep &= np.isfinite(d)
        return ids, keep

    def lists_for(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for queries: the lists whose distance is within the ratio of the nearest."""
        ids, d = self.nearest(np.column_stack([q, np.zeros(len(q))]), self.beam)
        return ids, np.isfinite(d) & (d <= self.ratio * d[:, :1])

    def calibrate(self, v: np.ndarray, k: int) -> None:
        """Sets the ratio and the beam so that the wanted share of true neighbours within v is read."""
        chosen = np.arange(0, len(v), max(1, len(v) // CALIBRATION_QUERIES))
        q = v[chosen]
        routed = [self.lists_of(v[i : i + 1024]) for i in range(0, len(v), 1024)]
        ids, keep = (np.concatenate(x) for x in zip(*routed))
        d = _distances(np.column_stack([q, np.zeros(len(q))]), self.centroids)
        ratios = d / np.maximum(d.min(axis=1, keepdims=True), 1e-12)
        k = min(k, max(1, len(v) - 1))
        need = np.full((len(q), k), np.inf)
        for n, own in enumerate(chosen):  # one query at a time, as all scores at once would not be small
            scores = v @ q[n]
            scores[own] = -np.inf
            best = np.argsort(-scores, kind="stable")[:k]
            need[n] = np.where(keep[best], ratios[n][ids[best]], np.inf).min(axis=1)
        self.ratio = float(np.quantile(need, TARGET_RECALL, method="higher")) * (1 + 1e-9)
        self.beam = int(min(len(self.centroids), max(8, 1.1 * (ratios <= self.ratio).sum(axis=1).max())))


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))) & F.forall("v", finite))
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("id", F.size("v")).alias("ids")).first()
    return rows if counts["n"] == counts["ids"] else rows.groupBy("id", F.size("v").alias("length")).agg(F.min("v").alias("v")).select("id", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _route(batches: Iterator[pa.RecordBatch], sent, queries: bool) -> Iterator[pa.RecordBatch]:
    router = sent.value
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            ids, keep = (router.lists_for if queries else router.lists_of)(_matrix(batch.column(1)))
            row, place = np.nonzero(keep)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row, place].astype(np.int32)), *taken.columns], names=["list", "id", "v"])


def best_in_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of the block for each query; ties to smaller ids."""
    out = []
    step = max(1, (1 << 21) // max(1, len(v)))
    for at in range(0, len(q), step):
        part, part_ids = q[at : at + step], q_ids[at : at + step]
        scores = part @ v.T
        scores[part_ids[:, None] == ids[None, :]] = -np.inf
        least = np.partition(scores, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(part), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
        i, j = np.nonzero((scores >= (least - slack)[:, None]) & np.isfinite(scores))
        exact = np.concatenate([(part[i[s : s + 65536]] * v[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)] or [np.empty(0)])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(part)))
        top = np.arange(len(i)) - first[i] < k
        out.append((part_ids[i[top]], ids[j[top]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (q_ids[:0], ids[:0], np.empty(0))


def _scorer(k: int):
    def score(table: pa.Table) -> pa.Table:
        asks, lists = table.column("asks").to_numpy().astype(bool), table.column("list").to_numpy()
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
        parts = [(ids[:0], ids[:0], np.empty(0))]
        for name in np.unique(lists[asks]):
            q, own = np.flatnonzero(asks & (lists == name)), np.flatnonzero(~asks & (lists == name))
            if len(own):
                parts.append(best_in_block(ids[q], v[q], ids[own], v[own], k))
        query, found, scores = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((found, -scores, query))
        query, found, scores = query[order], found[order], scores[order]
        new = np.ones(len(query), dtype=bool)  # a replica in another list of the task is the same neighbour
        new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
        query, found, scores = query[new], found[new], scores[new]
        top = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({"query_id": query[top], "vec_id": found[top], "score": scores[top]})

    return score


def router_for(rows: DataFrame, total: int, k: int = K, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> Router:
    """Centroids, graph and calibrated ratio from a bounded sample, by hash of the id."""
    share = min(1.0, sample_rows / max(1, total))
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else rows
    v = _matrix(chosen.limit(2 * sample_rows).toArrow().column("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = float(np.sqrt(rows.agg(F.max(square)).first()[0] or 0.0))
    lists = int(min(max_lists, max(1, total // list_rows), max(1, len(v) // 8)))
    router = Router(balanced_centroids(_even(v, most), lists), most)
    router.calibrate(v, k)
    return router


_FOUND = "query_id long, vec_id long, score double"


def _compared(lists: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): per task the k best of each query, from rows (list, id, v) and queries that read the lists."""
    grid = lists.groupBy("list").agg(F.count("*").alias("n")).join(asks.groupBy("list").agg(F.count("*").alias("q")), "list")
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    upto = F.sum(F.least("n", F.lit(BLOCK_ROWS))).over(Window.orderBy("list"))  # at most MAX_LISTS rows
    grid = grid.select("list", F.floor(upto / BLOCK_ROWS).cast("int").alias("task"), blocks("n", BLOCK_ROWS).alias("rows"), blocks("q", BLOCK_QUERIES).alias("cols"))
    grid = F.broadcast(cut(grid))
    slot = F.xxhash64("id", F.lit("grid"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = lists.join(grid, "list").select("task", "list", F.pmod(slot, F.col("rows")).cast("int").alias("row"), each("cols").alias("col"), F.lit(False).alias("asks"), "id", "v")
    asks = asks.join(grid, "list").select("task", "list", each("rows").alias("row"), F.pmod(slot, F.col("cols")).cast("int").alias("col"), F.lit(True).alias("asks"), "id", "v")
    return lists.unionByName(asks).groupBy("task", "row", "col").applyInArrow(_scorer(k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(by)).filter(F.col("rank") <= k)  # a replica ranks like its other copy
    return ranked.select("query_id", "rank", "vec_id", "score").dropDuplicates(["query_id", "rank"])


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", router: Router | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds.

    is_query is an expression over a column ``id``. A router that is given serves vectors of its length.
    """
    rows = cut(usable(vectors, id_col, vec_col))
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # one, as a rule
    found = [_search_length(rows if len(lengths) == 1 else rows.filter(F.size("v") == n), is_query, k, router) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search_length(rows: DataFrame, is_query: Column, k: int, router: Router | None) -> DataFrame:
    total = rows.count()
    if router is None or router.centroids.shape[1] != len(rows.first()["v"]) + 1:
        router = router_for(rows, total, k)
    sent = rows.sparkSession.sparkContext.broadcast(router)
    schema = f"list int, id long, v {dict(rows.dtypes)['v']}"
    lists = cut(rows.mapInArrow(partial(_route, sent=sent, queries=False), schema))
    queries = rows.filter(is_query)
    asks = cut(queries.mapInArrow(partial(_route, sent=sent, queries=True), schema))
    best = cut(_best(_compared(lists, asks, k), k))
    wanted = min(k, total - 1)
    full = best.filter(F.col("rank") == wanted).select(F.col("query_id").alias("id"))
    short = cut(queries.join(full, "id", "left_anti")) if wanted else queries.limit(0)
    if short.isEmpty():
        return best
    whole = lambda df: df.select(F.lit(0).alias("list"), "id", "v")
    again = _best(_compared(whole(rows), whole(short), k), k)
    return best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(again.columns).unionByName(again)


def op8_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
