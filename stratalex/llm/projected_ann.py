"""Approximate nearest neighbours by largest inner product: stable projections, a kd-tree, a chi-square stop.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2), where M is the largest norm: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest row has the largest inner product. ``DIMS`` Gaussian (2-stable)
projections map each row to a point; for two rows at distance d the squared distance of their points over d^2 follows
a chi-square law with DIMS degrees of freedom. A kd-tree orders the points of a block. A query goes through leaves in the
order of their distance and verifies the rows whose projected distance is within reach: beyond it, a row that beats
the query's k-th best would lie with probability below 1 - ``confidence`` only. It stops at the first leaf beyond.

All rows are indexed. Candidates are dealt into blocks of bounded size by a hash, so copies of one hot vector spread over all
blocks. A query first searches one block; its k-th best there is the bound that it takes to all others, where queries
stream past the index: a task holds one block, however many queries there are, and every candidate is moved twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, saved

DIMS, LEAF = 16, 64
#: Pairs that are scored at a time.
PAIRS = 8_192


def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection on the distribution function for an even number of degrees of freedom."""
    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def kd_order(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree that splits at the median of the widest axis."""
    leaves, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        axis = np.ptp(points[rows], axis=0).argmax()
        half = len(rows) // 2
        part = rows[np.argpartition(points[rows, axis], half)]
        stack += [part[:half], part[half:]]
    return leaves


class ProjectedIndex:
    """The kd-tree of one block of candidates. ``verified`` counts the pairs whose inner product was computed."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, reach: float, seed: int = 5):
        self.reach, d = reach, rows.shape[1]
        self.axes = np.random.default_rng(seed).normal(size=(d + 1, DIMS))
        lift = np.sqrt(np.maximum(0, reach**2 - (rows**2).sum(1)))
        points = rows @ self.axes[:d] + lift[:, None] * self.axes[d]
        leaves = kd_order(points)
        order = np.concatenate(leaves)
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.first = np.r_[0, np.cumsum([len(x) for x in leaves])]
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])
        self.verified = 0

    def scores(self, queries: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products of pairs, one by one: a matrix product may round equal rows differently."""
        self.verified += len(q)
        out = np.empty(len(q))
        for a in range(0, len(q), PAIRS):
            out[a : a + PAIRS] = np.einsum("ij,ij->i", queries[q[a : a + PAIRS]], self.rows[x[a : a + PAIRS]])
        return out

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, confidence: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of each query's best rows other than its own, by product and then by id; -1 where there
        are fewer. Rows below a query's ``bound`` are of no use to it."""
        n, leaves = len(queries), len(self.low)
        best = np.full((n, k), -np.inf)
        who = np.full((n, k), -1, np.int64)
        floor = np.full(n, -np.inf) if bound is None else bound
        points = queries @ self.axes[: queries.shape[1]]
        away = np.zeros((n, leaves))
        for j in range(DIMS):
            p = points[:, j : j + 1]
            away += np.maximum(0, np.maximum(self.low[:, j] - p, p - self.high[:, j])) ** 2
        order = np.argsort(away, 1, kind="stable")
        level = np.take_along_axis(away, order, 1)
        stop = chi_square_quantile(confidence, DIMS)
        norm = (queries**2).sum(1) + self.reach**2
        own, all_ = (points**2).sum(1), (self.points**2).sum(1)
        slack = 1e-12 * self.reach**2
        radius = lambda q: stop * np.maximum(0, norm[q] - 2 * np.maximum(best[q, -1], floor[q])) + 1e-9 * norm[q]  # noqa: E731  inf until there is a bound
        live, a, step = np.arange(n), 0, 4
        while True:
            live = live[level[live, a] <= radius(live)]
            if not len(live):
                return who, best
            b = min(leaves, a + step)
            turn = order[live, a:b]
            flat = np.argsort(turn, axis=None, kind="stable")
            of, leaf = live[flat // turn.shape[1]], turn.ravel()[flat]
            limit = radius(of)
            cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
            pairs_q, pairs_x = [], []
            for c, e in zip(cuts[:-1], cuts[1:]):
                x, y = self.first[leaf[c]], self.first[leaf[c] + 1]
                q = of[c:e]
                # squared projected distances less those of the queries
                apart = all_[x:y] - 2 * points[q] @ self.points[x:y].T
                qi, xi = np.nonzero((apart <= (limit[c:e] - own[q] + 1e-9 * norm[q])[:, None]) & (ids[q][:, None] != self.ids[x:y]))
                pairs_q.append(q[qi])
                pairs_x.append(x + xi)
            q, x = np.concatenate(pairs_q), np.concatenate(pairs_x)
            s = self.scores(queries, q, x)
            use = s >= np.maximum(best[q, -1], floor[q]) - slack
            q, s, i = q[use], s[use], self.ids[x[use]]
            touched = np.unique(q)
            q = np.r_[q, np.repeat(touched, k)]
            s, i = np.r_[s, best[touched].ravel()], np.r_[i, who[touched].ravel()]
            by = np.lexsort((i, -s, q))
            q, s, i = q[by], s[by], i[by]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            keep = rank < k
            best[q[keep], rank[keep]], who[q[keep], rank[keep]] = s[keep], i[keep]
            a, step = b, min(step * 2, 64)
            if a == leaves:
                return who, best


FOUND = "query_id long, vec_id long, score double"


def searched(rows: DataFrame, reach: float, k: int, confidence: float, batch: int = 4_000_000) -> DataFrame:
    """What the queries of ``rows`` (dims, block, asks, vec_id, v, bound) find among the other rows of their block. Candidates
    come first; queries then stream past their index, as many at a time as make ``batch`` projected distances."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, there, index = None, [], None
        for p in parts:
            for (dims, block, asks), part in p.groupby(["dims", "block", "asks"], sort=False):
                if (dims, block) != key:
                    key, there, index = (dims, block), [], None
                if not asks:
                    there.append((part.vec_id.to_numpy(), np.stack(part.v.to_numpy())))
                    continue
                if index is None and there:
                    index = ProjectedIndex(np.concatenate([x[0] for x in there]), np.concatenate([x[1] for x in there]), reach)
                    there = []
                if index is None:
                    continue
                step = max(1, batch // len(index.ids))
                for a in range(0, len(part), step):
                    some = part.iloc[a : a + step]
                    ids = some.vec_id.to_numpy()
                    who, best = index.search(ids, np.stack(some.v.to_numpy()), k, confidence, some.bound.to_numpy(float))
                    found = who.ravel() != -1
                    yield pd.DataFrame({"query_id": np.repeat(ids, k)[found], "vec_id": who.ravel()[found], "score": best.ravel()[found]})

    spread = rows.repartition("dims", "block").sortWithinPartitions("dims", "block", "asks")
    return lean(spread).mapInPandas(run, FOUND)


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, block_rows: int | None = None, confidence: float = 0.9) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``query_every`` its ``k`` rows of the
    largest inner product found, ties to the smaller vec_id. ``block_rows`` bounds a task's rows: by default a 64th of all,
    at least 16,384 and at most 262,144.

    A vector that is null, empty, zero or holds a null or non-finite component takes no part, nor does a null vec_id; vectors of
    different lengths aren't compared. Rows that repeat a vec_id: the one of the smallest vector (in array order) is taken, so that an id
    appears once. Fewer candidates than ``k``: all. Other columns are not read; an empty table gives no rows."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & good)
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("dims", F.size("v"))
    )
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    blocks = max(1, -(-sizes.n // (block_rows or min(262_144, max(16_384, sizes.n // 64)))))
    reach = math.sqrt(sizes.m or 1.0) * (1 + 1e-12)
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    fields = ["dims", "block", "asks", "vec_id", "v", "bound"]
    there = rows.withColumns({"block": block, "asks": F.lit(0), "bound": F.lit(-math.inf)}).select(fields)
    asked = rows.filter(F.col("vec_id") % query_every == 0).withColumns({"block": block, "asks": F.lit(1), "bound": F.lit(-math.inf)}).select(fields)
    found = searched(there.unionByName(asked), reach, k, confidence)
    if blocks > 1:
        found = saved(found, "found")
        kth = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        bound = F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(-math.inf))
        other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("block")))
        far = asked.drop("bound").join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumns({"bound": F.coalesce(bound, F.lit(-math.inf)), "block": other})
        found = found.unionByName(searched(there.unionByName(far.select(fields)), reach, k, confidence))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
