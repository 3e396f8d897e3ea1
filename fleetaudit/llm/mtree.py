"""Exact top-k search by inner product in an M-tree.

Metric: vectors get one more component, the root of (largest squared norm less own squared norm), a
query gets 0. Among such vectors a smaller Euclidean distance is a larger inner product, so the metric
tree answers inner products exactly.

Index: a bounded sample of rows gives the routing objects of the top level. Each vector goes to the
nearest one; a routing object with more than ``SUBTREE`` vectors has several subtrees, dealt by hash,
so a hot one is split. A subtree is cut into pages of at most ``PAGE`` vectors by routing objects of
its own; a page stores its covering radius and, sorted, each vector's distance to the page's routing
object. Every valid row is indexed.

Search: blocks of queries meet each subtree. Pages come best first, by the smallest distance their
radius allows; a query leaves out pages, and within a page the vectors, whose bound exceeds its k-th
best so far. Each subtree gives k rows per query at most; the last ranking joins them. Distances only
decide what to skip, with a margin for rounding; scores are exact integers.

Components are floor(scale * x). Rows whose vector is null, or holds null or non-finite components,
take no part; vectors of another length than the query's are no candidates. Ties go to the smaller
id. Rows that share an id are all candidates for others and none for each other; such an id asks
once, with its smallest vector. Queries with fewer candidates return all.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import staged
from .text import extended

ROUTES = 64  # routing objects of the top level, at most
SUBTREE = 4096
PAGE = 64
QUERIES = 256  # in a block
NONE = -(1 << 62)  # score of no row


def integers(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``v`` (array of long) of the rows that take part."""
    usable = (F.col(vector).isNotNull() & (F.size(vector) > 0)
              & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.where(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if bound < 2 ** 53 else a @ b.T


class Subtree:
    """Pages of at most ``PAGE`` vectors around routing objects, with radii and parent distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        lifted = _lift(vectors, top)
        self.pages = []
        stack = [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            # Routing objects far from each other: the first row, then the row farthest from it.
            far = _distances(lifted[rows[:1]], lifted[rows])[0]
            other = rows[far.argmax()]
            if len(rows) > PAGE and far.max() > 0:
                near = _distances(lifted[other:other + 1], lifted[rows])[0] < far
                parts = [rows[near], rows[~near]]
            else:
                parts = [rows[i:i + PAGE] for i in range(0, len(rows), PAGE)]
            if len(parts) > 1:
                stack += [p for p in parts if len(p)]
                continue
            centre = lifted[rows].mean(axis=0)
            route = lifted[rows[((lifted[rows] - centre) ** 2).sum(axis=1).argmin()]]
            distance = _distances(route[None], lifted[rows])[0]
            inner = np.argsort(distance, kind="stable")
            self.pages.append((ids[rows][inner], vectors[rows][inner], distance[inner]))
            self.pages[-1] += (route, float(distance.max()))
        self.routes = np.array([p[3] for p in self.pages])
        self.radii = np.array([p[4] for p in self.pages])

    def search(self, ids: np.ndarray, queries: np.ndarray, top: float, k: int):
        """The k best of each query in this subtree: query number, row id, score."""
        point = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
        norms = (point * point).sum(axis=1)
        to_route = _distances(point, self.routes)
        bound = np.maximum(to_route - self.radii, 0)
        best_score = np.full((len(queries), k), NONE)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        limit = np.full(len(queries), np.inf)  # distance of the k-th best so far, rounded up
        for page in np.argsort(bound.min(axis=0), kind="stable"):
            active = np.flatnonzero(bound[:, page] <= limit)
            if not len(active):
                continue
            rows, vectors, parent, _, _ = self.pages[page]
            # Parent distances are sorted: outside this range no active query can improve.
            reach = to_route[active, page]
            low, high = np.searchsorted(parent, (reach - limit[active]).min()), np.searchsorted(parent, (reach + limit[active]).max(), "right")
            if low >= high:
                continue
            score = _products(queries[active], vectors[low:high])
            own = rows[low:high][None] == ids[active][:, None]
            score = np.concatenate([np.where(own, NONE, score), best_score[active]], axis=1)
            found = np.concatenate([np.where(own, np.iinfo(np.int64).max, np.broadcast_to(rows[low:high], own.shape)), best_id[active]], axis=1)
            if score.shape[1] > 2 * k:  # keep what reaches the k-th score, ties with it included
                worst = np.partition(score, -k, axis=1)[:, -k]
                width = int((score >= worst[:, None]).sum(axis=1).max())
                keep = np.argpartition(-score, min(width, score.shape[1]) - 1, axis=1)[:, :max(width, k)]
                score, found = np.take_along_axis(score, keep, 1), np.take_along_axis(found, keep, 1)
            order = np.lexsort((found, -score), axis=1)[:, :k]
            best_score[active], best_id[active] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
            worst = best_score[active, -1]
            squared = norms[active] + top - 2 * worst.astype(np.float64)
            limit[active] = np.where(worst == NONE, np.inf, np.sqrt(np.maximum(squared, 0)) * (1 + 1e-9) + 1e-3)
        number, rank = np.nonzero(best_score > NONE)
        return number, best_id[number, rank], best_score[number, rank]


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.int64).tobytes()


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, routes: int = ROUTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows, other than itself, of each row that ``queries`` marks."""
    data = staged(integers(df, key, vector, scale).withColumn("width", F.size("v")), "vectors")
    asks = staged(integers(df.where(queries), key, vector, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v")), "queries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # At most ``routes`` rows of each length in use reach the driver, those with the smallest hash.
    lengths = data.groupBy("width").agg(F.max(norm).alias("top"), F.count("*").alias("n")).orderBy("width").collect()
    plan = {}
    for r in lengths:
        want = min(routes, max(1, r["n"] // 1024))
        rows = data.where(F.col("width") == r["width"]).orderBy(F.xxhash64("id", "v"), "id").limit(want).collect()
        plan[r["width"]] = (r["top"], np.array([x["v"] for x in rows], np.int64))
    sent = df.sparkSession.sparkContext.broadcast(plan)

    def place(batches):
        for b in batches:
            width = b.column(2).to_numpy()
            out = np.zeros(len(width), np.int32)
            for w in np.unique(width):
                top, objects = sent.value[int(w)]
                at = np.flatnonzero(width == w)
                v = b.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), int(w))
                for i in range(0, len(at), 4096):
                    out[at[i:i + 4096]] = _distances(_lift(v[i:i + 4096], top), _lift(objects, top)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "route"])

    placed = staged(data.mapInArrow(place, extended(data, "route int")), "routed")
    sizes = placed.groupBy("width", "route").agg(F.count("*").alias("n"))
    # Widths times routes, a bounded number of rows.
    counts = sizes.orderBy("width", "route").collect()
    numbered, base = [], 0
    for r in counts:
        parts = math.ceil(r["n"] / SUBTREE)
        numbered.append((r["width"], r["route"], parts, base))
        base += parts
    schema = "width int, route int, parts long, base long"
    numbers = df.sparkSession.createDataFrame(numbered, schema)
    trees = placed.join(F.broadcast(numbers), ["width", "route"]).withColumn("tree", F.col("base") + F.pmod(F.xxhash64("id", "v"), F.col("parts")))
    spans = numbers.groupBy("width").agg(F.min("base").alias("low"), F.max(F.col("base") + F.col("parts")).alias("high"))

    def block(batches):
        for b in batches:
            width = b.column(2).to_numpy()
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for i in range(0, len(at), QUERIES):
                    part = b.take(pa.array(at[i:i + QUERIES]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(w)], pa.int32()), pa.array([_pack(part.column(0).to_numpy())]), pa.array([_pack(part.column(1).flatten().to_numpy())])],
                                                     ["width", "ids", "v"])

    asked = asks.mapInArrow(block, "width int, ids binary, v binary")
    asked = asked.join(F.broadcast(spans), "width").withColumn("tree", F.explode(F.sequence("low", F.col("high") - 1))).select("tree", "width", "ids", "v")
    # A subtree's rows come first in its partition, then the blocks of queries, one at a time.
    both = (trees.select("tree", F.lit(0).alias("kind"), "width", F.col("id"), "v", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("qs"))
            .unionByName(asked.select("tree", F.lit(1).alias("kind"), "width", F.lit(0).cast("long").alias("id"), F.lit(None).cast("array<bigint>").alias("v"), "ids", F.col("v").alias("qs"))))
    both = both.repartition("tree").sortWithinPartitions("tree", "kind", "id")

    def search(batches):
        tree, built, rows = None, None, []
        for b in batches:
            names, kind, width = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            edges = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (kind[1:] != kind[:-1])))
            for i, j in zip(edges, np.append(edges[1:], len(names))):
                w = int(width[i])
                if names[i] != tree:
                    tree, built, rows = names[i], None, []
                if kind[i] == 0:
                    part = b.slice(i, j - i)
                    rows.append((part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(j - i, w)))
                    continue
                top = sent.value[w][0]
                if built is None:
                    built = Subtree(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), top)
                    rows = []
                for q in range(i, j):
                    ids = np.frombuffer(b.column(5)[q].as_py(), np.int64)
                    number, found, score = built.search(ids, np.frombuffer(b.column(6)[q].as_py(), np.int64).reshape(len(ids), w), top, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[number]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    near = both.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
