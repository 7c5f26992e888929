"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts (recursive bisection: an
eigenvector of the graph, split at its median, then balanced swaps that shorten the cut).  A small
network learns in which parts a vector and its neighbours lie; every row is indexed under its likeliest part, and a
query is routed to its likeliest parts until they hold so much probability as reached ``AIM`` recall on
queries that neither the graph nor the training has seen.
(Dong et al., "Learning space partitions for nearest neighbor search".)  All candidates of those parts
are scored, in blocks of bounded size, so that no part, however full, is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, ROWS_PER_PART, GRAPH_K, HIDDEN, AIM = 8192, 48, 10, 96, 0.93
#: the part of a row's label that its neighbours' parts make up
SHARED = 0.8
#: rows of a block of candidates and of a block of queries
BLOCK, QUERY_BLOCK = 4096, 4096


class Router(NamedTuple):
    """Weights of the network, and the probability that a query's parts hold together."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    enough: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each vector, likeliest first, and the probability of those before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is indexed under."""
        return self.order(x)[0][:, 0]


def neighbours(x: np.ndarray, y: np.ndarray, k: int, own: bool = False, block: int = 1024) -> np.ndarray:
    """For each row of ``x`` the ``k`` rows of ``y`` of largest inner product; with ``own`` a row is not its own neighbour."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ y.T
        if own:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(ends: tuple[np.ndarray, np.ndarray], n: int, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """A balanced side (0 or 1) for each of ``n`` nodes, with few edges between the sides. ``ends``: each edge in both directions."""
    a, b = ends
    degree = np.bincount(a, minlength=n) + 1e-9
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, np.int64)
    side[np.argsort(v, kind="stable")[n // 2 :]] = 1
    for _ in range(rounds):
        ones = np.bincount(a, side[b].astype(float), n)
        gain = np.where(side == 1, degree - 2 * ones, 2 * ones - degree)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        better = int((gain[left[:m]] + gain[right[:m]] > 1e-6).sum()) // 2
        if not better:
            break
        side[left[:better]], side[right[:better]] = 1, 0
    return side


def balanced_parts(ends: tuple[np.ndarray, np.ndarray], n: int, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node by recursive bisection; ``parts`` is a power of two."""
    if parts == 1 or n < 2:
        return np.zeros(n, np.int64)
    side, out = bisect(ends, n, rng), np.empty(n, np.int64)
    for s in (0, 1):
        own, at = np.flatnonzero(side == s), np.full(n, -1)
        at[own] = np.arange(len(own))
        a, b = at[ends[0]], at[ends[1]]
        inside = (a >= 0) & (b >= 0)
        out[own] = s * (parts // 2) + balanced_parts((a[inside], b[inside]), len(own), parts // 2, rng)
    return out


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 30, rate: float = 0.005) -> Router:
    """A network of one hidden layer by minibatch Adam; ``target``: the share of each part in a row's label."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = target.shape[1]
    w = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        shuffled = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            some = shuffled[i : i + 128]
            hidden = np.maximum(x[some] @ w[0] + w[1], 0)
            z = hidden @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - target[some]) / len(some)
            back = (p @ w[2].T) * (hidden > 0)
            t += 1
            for j, g in enumerate((x[some].T @ back, back.sum(0), hidden.T @ p, p.sum(0))):
                m[j], s[j] = 0.9 * m[j] + 0.1 * g, 0.999 * s[j] + 0.001 * g * g
                w[j] -= rate * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*w, 1.0)


def fit(x: np.ndarray, k: int, parts: int, aim: float = AIM, seed: int = 7) -> Router:
    """The router of a sample.

    A quarter of the sample stays out of graph and training.  The parts' probability that is ``enough`` is the least
    at which one half of it, as queries, finds ``aim`` of its nearest rows in the other half, as many as would be its
    share of ``k``; so neither queries nor rows have been seen.  Where the table is larger than the sample, neighbours
    are nearer and recall is higher.
    """
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    asked, unseen, own = np.split(x, [len(x) // 8, len(x) // 4])
    while parts > 1 and len(own) < parts * ROWS_PER_PART // 2:
        parts //= 2
    if parts == 1 or len(own) <= GRAPH_K or not len(asked):
        return train_router(x[:0], np.zeros((0, 1)), rng)
    near = neighbours(own, own, GRAPH_K, own=True)
    a, b = np.repeat(np.arange(len(own)), GRAPH_K), near.ravel()
    label = np.eye(parts)[balanced_parts((np.concatenate([a, b]), np.concatenate([b, a])), len(own), parts, rng)]
    router = train_router(own, (1 - SHARED) * label + SHARED * label[near].mean(1), rng)
    order, before = router.order(asked)
    near = neighbours(asked, unseen, max(1, min(k, len(x) - 1) * len(unseen) // len(x)))
    needed = np.take_along_axis(np.argsort(order, axis=1), router.parts(unseen)[near], axis=1)
    # a standard error more, so that a small sample's luck doesn't lower recall
    aim = min(1.0, aim + (aim * (1 - aim) / len(asked)) ** 0.5)
    return router._replace(enough=float(np.quantile(np.take_along_axis(before, needed, axis=1), aim)) + 1e-9)


def usable(vectors: DataFrame, vec_col: str) -> Column:
    """Whether a row takes part: its vector has no null or non-finite component and is not zero."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _route_task(router: Router, every: bool):
    """Adds each row's own part, or (``every``) all parts that a query is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order, before = router.order(_matrix(batch.column("v")))
                asked = before < router.enough if every else np.arange(order.shape[1])[None, :] < np.ones((len(order), 1))
                at = pa.array(np.concatenate([[0], np.cumsum(asked.sum(1))]).astype(np.int32))
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(at, pa.array(order[asked].astype(np.int32)))], names=["vec_id", "v", "parts"])

    return run


def _score_group(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qid, cid = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        out = []
        if len(qid) and len(cid):
            q, c = _matrix(queries["v"]), _matrix(rows["v"])
            slack = 1e-10 * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
            most = min(k, len(cid)) - 1
            for a in range(0, len(qid), 256):
                near = q[a : a + 256] @ c.T
                near[qid[a : a + 256, None] == cid[None, :]] = -np.inf
                least = -np.partition(-near, most, axis=1)[:, most] - slack[a : a + 256]
                row, col = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                # the best again, component by component in one order, so that equal vectors have equal scores wherever they stand
                score = np.zeros(len(row))
                for d in range(c.shape[1]):
                    score += q[a + row, d] * c[col, d]
                order = np.lexsort((cid[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.searchsorted(row, np.arange(len(near)))
                keep = np.arange(len(row)) - first[row] < k
                out.append((qid[a + row[keep]], cid[col[keep]], score[keep]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return run


def _search(indexed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query among the rows of its parts. ``queries``: vec_id, v and part, a row for each part."""
    n_rows = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part: few
    n_queries = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if not n_rows or not n_queries:
        return indexed.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)

    def blocks(n: dict[int, int], size: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(int(x)) for p, c in n.items() for x in (p, -(-c // size))]), F.col("part"))

    def spread(df: DataFrame, own: dict[int, int], size: int, other: dict[int, int], other_size: int, names: tuple[str, str]) -> DataFrame:
        df = df.where(F.col("part").isin(list(other))).withColumn(names[0], F.pmod(F.xxhash64("vec_id"), blocks(own, size)).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), (blocks(other, other_size) - 1).cast("int"))))

    rows = spread(indexed, n_rows, BLOCK, n_queries, QUERY_BLOCK, ("rows_block", "query_block"))
    asked = spread(queries, n_queries, QUERY_BLOCK, n_rows, BLOCK, ("query_block", "rows_block"))
    key = ["part", "rows_block", "query_block"]
    scored = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_score_group(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows of one id that with the least vector; the ids that are repeated are found first, so that other vectors are not shuffled."""
    repeated = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    return written(rows.join(repeated, "vec_id", "left_anti").unionByName(one), "distinct-ids")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, aim: float = AIM) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows of largest inner product found for each query.

    Scores are in double precision on the given vectors; ties go to the smaller id; a query's own id is left out.
    Rows whose vector is null, zero, of another length than most, or holds null or non-finite components take no
    part, nor do null ids.  Of rows of one id that with the least vector takes part (compared component by component).
    A query whose parts hold fewer than ``k`` rows is searched in all parts.  No rows give no rows; other columns are not
    read.  The number of parts grows with the square root of the rows, as far as the sample can tell them apart.
    """
    rows = vectors.where(usable(vectors, vec_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], none)
    rows = _one_per_id(rows.where(F.size("v") == sizes["d"]))
    drawn = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # at most `sample` vectors
    parts = 1 << int(np.log2(max(1, min(sizes["count"] ** 0.5, sample // ROWS_PER_PART))))
    router = fit(_matrix(drawn["v"]), k, parts, aim)
    schema = "vec_id long, v array<double>, parts array<int>"
    indexed = written(rows.select("vec_id", "v").mapInArrow(_route_task(router, False), schema).select("vec_id", "v", F.col("parts")[0].alias("part")), "ann-index")
    asked = rows.where("asked").select("vec_id", "v")
    queries = asked.mapInArrow(_route_task(router, True), schema).select("vec_id", "v", F.explode("parts").alias("part"))
    found = written(_search(indexed, queries, k), "ann-found")
    if router.enough < 1:
        full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        short = written(asked.join(full, "vec_id", "left_anti"), "ann-short")
        if not short.isEmpty():
            every = F.explode(F.array(*[F.lit(i) for i in range(router.b2.size)])).alias("part")
            again = _search(indexed, short.select("vec_id", "v", every), k)
            found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
