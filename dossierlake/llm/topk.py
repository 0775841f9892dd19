"""Exact top-k by inner product, with no-random-access aggregation over sorted lists.

Vectors become integers (floor of ``scale`` times each component). Candidates are dealt by id into blocks of bounded
size, a stated set of queries into blocks likewise; each pair of blocks is one group. In a group every dimension has a
list sorted by value. A query reads all its lists in step, from the end its weight prefers, and keeps for every
candidate a lower bound (unread components at their worst) and an upper bound (unread components at the lists' present
depth). A candidate whose upper bound stays below the k-th best lower bound is out. Lists are read on, ``STEPS`` times at
most, until no outsider can qualify; scores are resolved only then, for the candidates that are left. The best k of every
block meet in a window by query.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do null ids; a shorter
vector counts as padded with zeros; ties go to the smaller id; a query is never its own candidate; with fewer than k
candidates all are returned; identical repeated query rows count once, repeated candidate rows each; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
ASK_ROWS = 128
STEPS = 8


def integers(vectors: DataFrame, vec_id: str, vec: str, scale: int = 1024) -> DataFrame:
    """``(vec_id, v)``: array<bigint> of the rows that take part."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("v")).where("vec_id is not null and v is not null").where(fine)
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Lists:
    """The sorted lists of one block of candidates, read in step for all queries of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0).astype(np.float64)

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, exact scores) of the block's best k for each query."""
        n, dims = self.x.shape
        up, down = np.maximum(q, 0).T.astype(np.float64), np.minimum(q, 0).T.astype(np.float64)
        most, least = self.sorted[-1], self.sorted[0]
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(most), np.abs(least))) + 1e-6
        # what is read of each list, from its upper end and from its lower end, and where it is unread yet
        read, unread = np.zeros((2, n, dims)), np.ones((2, n, dims))
        left = dict(enumerate([np.flatnonzero(self.ids != i) for i in query_ids]))
        columns, start = np.arange(dims), 0
        for step in range(1, STEPS + 1):
            open_ = [j for j, rows in left.items() if len(rows) > k]
            depth = -(-n * step // STEPS)
            if not open_ or depth == start:
                break
            for side, rows in ((0, slice(n - depth, n - start)), (1, slice(start, depth))):
                at = self.order[rows]
                read[side, at, columns], unread[side, at, columns] = self.sorted[rows], 0
            start = depth
            top, bottom = self.sorted[n - depth], self.sorted[depth - 1]  # the lists' present depth, from either end
            seen = read[0] @ up[:, open_] + read[1] @ down[:, open_]
            lower = seen + unread[0] @ (up[:, open_] * least[:, None]) + unread[1] @ (down[:, open_] * most[:, None])
            upper = seen + unread[0] @ (up[:, open_] * top[:, None]) + unread[1] @ (down[:, open_] * bottom[:, None])
            for c, j in enumerate(open_):
                rows = left[j]
                low = lower[rows, c]
                kth = np.partition(low, len(low) - k)[len(low) - k]
                left[j] = rows[upper[rows, c] + slack[j] >= kth]
        for j, rows in left.items():
            score = self.x[rows] @ q[j]
            best = np.lexsort((self.ids[rows], -score))[:k]
            yield query_ids[j], self.ids[rows][best], score[best]


def search(spark: SparkSession, vectors: DataFrame, vec_id: str, vec: str, queries: Column, k: int = 10, scale: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows that ``queries`` picks, against all rows."""
    ready = integers(vectors, vec_id, vec, scale)
    asked = ready.where(queries).distinct()
    n, m = ready.count(), asked.count()
    blocks, turns = max(1, -(-n // block_rows)), max(1, -(-m // 1024))
    dealt = ready.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"), "vec_id", "v")
    asking = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int").alias("t"), "vec_id", "v")

    def found(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        width = max(rows["v"].map(len).max(), asks["v"].map(len).max())
        lists, out = Lists(rows["vec_id"].to_numpy(), _matrix(rows["v"], width)), []
        asked_ids, asked_x = asks["vec_id"].to_numpy(), _matrix(asks["v"], width)
        for at in range(0, len(asks), ASK_ROWS):
            for i, ids, scores in lists.best(asked_ids[at : at + ASK_ROWS], asked_x[at : at + ASK_ROWS], k):
                out.append(pd.DataFrame({"query_id": np.full(len(ids), i), "vec_id": ids, "score": scores}))
        return pd.concat(out)

    parts = dealt.groupBy("b", "t").cogroup(asking.groupBy("b", "t")).applyInPandas(found, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
