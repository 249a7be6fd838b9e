"""Approximate nearest neighbours by cosine, over learned partitions.

On a bounded sample: an exact neighbour graph, cut into equal parts by recursive bisection (each part
is halved at the median of the graph's slowest smooth mode, so few neighbours are
separated), and a small network trained to tell a vector's part from the parts of its neighbours.
The network puts every vector of the table into its most probable part and sends each query to the
most probable ones, where it is compared exactly, in double precision. How many is measured: the
fewest that find `recall` of the neighbours of sample rows which training didn't see.

Where a part would hold more than `part_rows` rows it is divided again: a second graph, cut and network,
learned in a task from a bounded sample of the part's own rows, route within it. So the parts grow in
number with the table and not in size; a query goes to the most probable of all of them.

Parts are dealt out in blocks of rows against blocks of queries, so that neither a large part nor a
vector with many copies fills one task. Part counts and networks come to the driver, vectors don't.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import kept


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors, itself left out."""
    k = min(k, len(vectors) - 1)
    out = np.zeros((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 512):
        near = vectors[at:at + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part numbers (a power of two of them), equal in size, that separate few neighbours."""
    n, k = graph.shape
    ends = np.stack([np.repeat(np.arange(n), k), graph.ravel()])
    ends = np.concatenate([ends, ends[::-1]], axis=1)
    part, random = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(int(math.log2(parts))):
        inside = part[ends[0]] == part[ends[1]]  # edges within a part still hold it together
        a, b = ends[0][inside], ends[1][inside]
        degree = np.bincount(a, minlength=n) + 1e-9
        size = np.bincount(part, degree)
        mode = random.standard_normal(n)
        for _ in range(60):  # power iteration towards the slowest mode in every part at once
            mode = 0.5 * mode + 0.5 * np.bincount(a, mode[b], n) / degree
            mode -= (np.bincount(part, mode * degree) / size)[part]
            mode /= np.sqrt(np.bincount(part, mode * mode * degree) / size)[part] + 1e-300
        order = np.lexsort((mode, part))
        first = np.searchsorted(part[order], part[order])
        count = np.bincount(part)[part[order]]
        upper = np.zeros(n, np.int64)
        upper[order] = (np.arange(n) - first) * 2 >= count
        part = 2 * part + upper
    return part


@dataclass
class Router:
    """One hidden layer; `probabilities` ranks the parts of unit vectors."""

    parts: int
    weights: list[np.ndarray]

    @classmethod
    def train(cls, vectors: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int,
              hidden: int = 256, epochs: int = 30, seed: int = 7) -> Router:
        random, (n, width) = np.random.default_rng(seed), vectors.shape
        target = np.zeros((n, parts))
        np.add.at(target, (np.arange(n), part), 1.0)
        for column in graph.T:
            np.add.at(target, (np.arange(n), part[column]), 1.0 / graph.shape[1])
        target /= target.sum(axis=1, keepdims=True)
        w = [random.standard_normal((width, hidden)) / math.sqrt(width), np.zeros(hidden),
             random.standard_normal((hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]
        model, mean, square, step = cls(parts, w), [0 * x for x in w], [0 * x for x in w], 0
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(n), max(1, n // 256)):
                x, step = vectors[rows], step + 1
                pre = x @ w[0] * 4 + w[1]
                layer = np.maximum(pre, 0)
                error = (model._softmax(layer @ w[2] + w[3]) - target[rows]) / len(rows)
                back = (error @ w[2].T) * (pre > 0)
                slopes = [4 * x.T @ back, back.sum(axis=0), layer.T @ error, error.sum(axis=0)]
                for i, slope in enumerate(slopes):
                    mean[i] = 0.9 * mean[i] + 0.1 * slope
                    square[i] = 0.999 * square[i] + 0.001 * slope * slope
                    w[i] -= 0.005 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
        return model

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return self._softmax(np.maximum(vectors @ w[0] * 4 + w[1], 0) @ w[2] + w[3])


@dataclass
class Index:
    """Parts of one or two levels: `fine` routes within the coarse parts that are divided. Part numbers run
    through the coarse parts; `first` is each one's first number."""

    coarse: Router
    fine: dict[int, Router]

    def __post_init__(self) -> None:
        sizes = [self.fine[c].parts if c in self.fine else 1 for c in range(self.coarse.parts)]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        """The part that holds each unit vector: the most probable one of its most probable coarse part."""
        top = self.coarse.probabilities(vectors).argmax(axis=1)
        out = self.first[top].copy()
        for c in np.unique(top).tolist():
            if c in self.fine:
                own = np.flatnonzero(top == c)
                out[own] += self.fine[c].probabilities(vectors[own]).argmax(axis=1)
        return out

    def probabilities(self, vectors: np.ndarray, closest: int = 32) -> np.ndarray:
        """Of every part; the networks of the `closest` most probable coarse parts are asked, others' parts
        share their coarse part's probability."""
        top = self.coarse.probabilities(vectors)
        sizes = np.diff(self.first)
        out = np.repeat(top / sizes, sizes, axis=1)
        near = np.argsort(np.argsort(-top, axis=1, kind="stable"), axis=1) < closest
        for c, router in self.fine.items():
            own = np.flatnonzero(near[:, c])
            out[own, self.first[c]:self.first[c + 1]] = top[own, c, None] * router.probabilities(vectors[own])
        return out

    def probes_for(self, recall: float, queries: np.ndarray, rows: np.ndarray, k: int) -> int:
        """The fewest probes that reach a share of the queries' k nearest rows."""
        if not len(queries):
            return self.parts
        homes, ranks = self.homes(rows), []
        for at in range(0, len(queries), 64):
            own = queries[at:at + 64]
            near = np.argsort(-(own @ rows.T), axis=1, kind="stable")[:, :k]
            place = np.argsort(np.argsort(-self.probabilities(own), axis=1, kind="stable"), axis=1)
            ranks.append(np.take_along_axis(place, homes[near], axis=1).ravel())
        ranks = np.sort(np.concatenate(ranks))
        return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1


def _learned(vectors: np.ndarray, parts: int, degree: int, hidden: int) -> Router | None:
    """A router over balanced parts of unit vectors, of at least 8 each; none for a single part."""
    while parts > 1 and len(vectors) < 8 * parts:
        parts //= 2
    if parts <= 1:
        return None
    graph = neighbour_graph(vectors, degree)
    return Router.train(vectors, graph, balanced_parts(graph, parts), parts, hidden)


def _divided(placed: DataFrame, wanted: dict[int, int], sample: int, degree: int, hidden: int) -> dict[int, Router]:
    """Second-level routers of the coarse parts in `wanted` (part: how many), each learned in a task."""
    if not wanted:
        return {}
    mark = F.xxhash64("row", "vec_id")
    salted = Window.partitionBy("part", F.pmod(mark, F.lit(64))).orderBy(mark, "row")
    each = -(-sample // 64)
    own = placed.filter(F.col("part").isin(list(wanted))).withColumn("at", F.row_number().over(salted)) \
        .filter(F.col("at") <= each).select("part", "vector")

    def train(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        router = _learned(_unit(_matrix(rows.column("vector"))), wanted[part], degree, hidden)
        small = None if router is None else pickle.dumps(Router(router.parts, [w.astype(np.float32) for w in router.weights]))
        return pa.table({"part": pa.array([part], pa.int32()), "router": pa.array([small], pa.binary())})

    found = own.groupBy("part").applyInArrow(train, "part int, router binary").collect()  # one a coarse part
    return {r.part: pickle.loads(r.router) for r in found if r.router is not None}


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def part_count(rows: int, most: int = 256) -> int:
    """Parts for a table: the power of two at or below half the root of its rows."""
    return 1 << int(math.log2(min(most, max(1.0, math.sqrt(rows) / 2))))


def _best(queries: pa.Table, rows: pa.Table, k: int) -> tuple[list[np.ndarray], ...]:
    """Per query its k best rows: largest cosine, then least id."""
    own, ids = queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
    row = rows.column("row").to_numpy()
    q, x = _matrix(queries.column("vector")), _matrix(rows.column("vector"))
    unit, size_q, size_x = _unit(x), np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    out: tuple[list[np.ndarray], ...] = ([], [], [], [])
    for at in range(0, len(q), 256):
        near = _unit(q[at:at + 256]) @ unit.T
        near[own[at:at + 256, None] == ids[None, :]] = -np.inf
        edge = near.min(axis=1) if near.shape[1] <= k else np.partition(near, -k, axis=1)[:, -k]
        for i in range(len(near)):  # products differ in the last bits by place, so scores are made anew
            c = np.flatnonzero((near[i] >= edge[i] - 1e-9) & (near[i] > -np.inf))
            score = (x[c] * q[at + i]).sum(axis=1) / (size_q[at + i] * size_x[c])
            first = np.lexsort((row[c], ids[c], -score))[:k]
            out[0].append(np.full(len(first), own[at + i], np.int64))
            out[1].append(ids[c[first]])
            out[2].append(row[c[first]])
            out[3].append(score[first])
    return out


def nearest(
    table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5,
    parts: int | None = None, recall: float = 0.95, sample: int = 8192, degree: int = 10,
    block: int = 16_384, query_block: int = 16_384, part_rows: int = 65_536, router_bytes: int = 64 << 20,
) -> DataFrame:
    """Per query its k nearest other rows found: query_id, rank (from 1), vec_id, score.

    Null, zero and non-finite vectors, vectors of another length than most, and rows
    without an id take no part. Usable rows are numbered and stored with their numbers. Repeated rows are
    candidates each; a row with the query's id is the query's own. An id that asks in several rows gets one
    answer: a candidate counts once, with the largest cosine that any of the id's rows has with it. A query
    probes further parts until they hold k rows of other ids. An empty table gives no rows. `sample` bounds the rows that a network is learned from, not those that
    the index holds; `part_rows` is the size that parts are cut to, by estimate.
    """
    spark = table.sparkSession
    found = "query_id long, rank int, vec_id long, score double"
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                        is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable("vector"))
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return spark.createDataFrame([], found)
    rows = rows.filter(F.size("vector") == sizes.width)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    learned = _unit(_matrix(chosen.column(0)))
    learned, unseen = learned[len(learned) // 8:], learned[:len(learned) // 8]
    router = _learned(learned, parts or part_count(sizes["count"]), degree, 256) or \
        Router(1, [np.zeros((sizes.width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    index = Index(router, {})

    def put(rows: DataFrame, index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part = shared.value.homes(_unit(_matrix(batch.column(1))))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(part, pa.int32())],
                                                     names=["vec_id", "vector", "asks", "row", "part"])

        return kept(rows.mapInArrow(assign, "vec_id long, vector array<double>, asks boolean, row long, part int"))

    def counts(placed: DataFrame, parts: int) -> np.ndarray:
        count = np.zeros(parts, np.int64)
        for row in placed.groupBy("part").count().collect():  # one row a part
            count[row.part] = row["count"]
        return count

    placed = put(rows, index)
    count = counts(placed, index.parts)
    # All second-level networks together are at most `router_bytes`; where that is little, parts stay larger.
    most = int(min(256, (router_bytes / (4 * max(1, int((count > part_rows).sum()))) / 64) - sizes.width))
    wanted = {c: 1 << math.ceil(math.log2(n / part_rows)) for c, n in enumerate(count.tolist()) if n > part_rows}
    wanted = {c: min(n, 1 << int(math.log2(most))) for c, n in wanted.items()} if most > 1 else {}
    fine = _divided(placed, wanted, sample, degree, 64)
    if fine:
        index = Index(router, fine)
        placed = put(rows, index)
        count = counts(placed, index.parts)
    probes = index.probes_for(recall, unseen, learned, k)
    parts, shared = index.parts, spark.sparkContext.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for start in range(0, batch.num_rows, 256):
                own = batch.slice(start, 256)
                order = np.argsort(-shared.value.probabilities(_unit(_matrix(own.column(1)))), axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                same = own.column(2).to_numpy()[:, None]  # rows of the query's id may fill a part
                at, nth = np.nonzero((np.arange(parts) < probes) | (before < k + same))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(at)), own.column(1).take(pa.array(at)),
                     pa.array(order[at, nth].astype(np.int32))], names=["query_id", "vector", "part"])

    same = placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("same"), F.max("asks").alias("asks")).filter("asks")
    asked = kept(placed.filter("asks").select("vec_id", "vector").distinct()
                 .join(same, "vec_id").select("vec_id", "vector", "same")
                 .mapInArrow(route, "query_id long, vector array<double>, part int"))
    asks = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    layout = [(p, max(1, math.ceil(int(count[p]) / block)), max(1, math.ceil(asks.get(p, 0) / query_block)))
              for p in range(parts)]
    plan = F.broadcast(spark.createDataFrame(layout, "part int, blocks int, query_blocks int"))
    at = ["part", "block", "query_block"]
    deal = lambda n, *names: F.pmod(F.xxhash64(*names), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "part").select(
        "part", every("blocks").alias("block"), deal("query_blocks", "query_id", "vector").alias("query_block"), "query_id", "vector")
    right = placed.join(plan, "part").select(
        "part", deal("blocks", "row").alias("block"), every("query_blocks").alias("query_block"), "vec_id", "row", "vector")

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        best = ([], [], [], []) if not queries.num_rows or not members.num_rows else _best(queries, members, k)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, t)
                         for n, x, t in zip(("query_id", "vec_id", "row", "score"), best, kinds, strict=True)})

    local = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(
        compare, "query_id long, vec_id long, row long, score double")
    once = local.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
