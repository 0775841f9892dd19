"""Centroid clustering (Lloyd's rounds) over integer vectors with an incremental distance matrix.

Every vector keeps its exact integer dot product with every centroid. When a centroid moves, the products change only by the
components in which it moved: product += sum over these of vector component * change. The nearest centroid follows from
|c|^2 - 2 * product. What a round passes on is a written table: vector, products, cluster before and after. The sums of the
clusters are kept on the driver (clusters * components whole numbers) and change only by the vectors that changed their
cluster; tasks add these up before the shuffle, so no cluster is ever gathered.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part and give no row;
repeated rows are vectors of their own; vectors with a null id take part, but no centroid starts from them; ties go to the
smaller centroid; an empty cluster keeps its centroid; fewer vectors than clusters give fewer centroids; an empty table
gives no rows; a component of 2^27 or more (x of 131,072) is an error, as sums might leave 64 bits; other columns are
ignored, keys are carried by place and may not be named as a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import output_names, remove, replaced, written

CLUSTERS, ROUNDS, DIMS, SEED, LARGEST = 8, 10, 64, 3, 1 << 27
RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def kept(vectors: DataFrame, keys: Sequence[str], vector: str, dims: int = DIMS) -> DataFrame:
    """k0, k1, ... and the whole-number vector v of the rows that take part."""
    fine = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    v = F.when(F.exists(whole, lambda x: F.abs(x) >= LARGEST), F.raise_error(F.lit("a vector component is 131,072 or more"))).otherwise(whole)
    return vectors.where(fine).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64, copy=False)


def lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def assigned(state: DataFrame, change: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """``state`` with its products moved by ``change`` (clusters x components) and every vector at its nearest centroid."""
    k, dims = change.shape
    moved = [np.flatnonzero(row) for row in change]
    squares = (centroids * centroids).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, dots = matrix(b["v"], dims), matrix(b["dots"], k).copy()
            for c, at in enumerate(moved):
                if at.size:
                    dots[:, c] += v[:, at] @ change[c, at]
            near = (squares - 2 * dots).argmin(1).astype(np.int32)
            yield replaced(b, {"dots": lists(dots), "was": b["cluster"], "cluster": pa.array(near)})

    return state.mapInArrow(run, state.schema)


def moves(state: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster, part, total): signed sums of the vectors that came and went; part -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), object)  # whole numbers of any size
        for b in batches:
            v = np.hstack([matrix(b["v"], dims), np.ones((b.num_rows, 1), np.int64)])
            for name, sign in (("cluster", 1), ("was", -1)):
                at = b[name].to_numpy(zero_copy_only=False)
                for c in range(k):
                    total[c] += sign * v[at == c].sum(0)
        c, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(np.where(j == dims, -1, j), pa.int32()), pa.array([str(x) for x in total[c, j]], pa.string())], ["cluster", "part", "total"])

    parts = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, part int, total string")
    return parts.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def cluster(spark: SparkSession, vectors: DataFrame, keys: Sequence[str] = ("vec_id",), vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """``keys`` (the first is the id) plus cluster, distance, cluster_inertia, inertia and the digest of the centroid."""
    output_names(keys, RESULTS)
    names = [f"k{i}" for i in range(len(keys))]
    rows = kept(vectors, keys, vector, dims)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k0").cast("string")), 256)
    starts = rows.where("k0 is not null").select(rank.alias("r"), "v").orderBy("r", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in starts], np.int64).reshape(-1, dims)
    k = len(centroids)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    if not k:
        empty = rows.where("false").select(*[F.col(n).alias(c) for n, c in zip(names, keys)])
        return empty.selectExpr("*", "cast(null as int) as cluster", *[f"cast(null as {t}) as {n}" for n, t in zip(RESULTS[1:], ("long", "long", "long", "string"))])
    state = rows.select(*names, "v", square.alias("norm"), F.array_repeat(F.lit(0).cast("long"), k).alias("dots"), F.lit(-1).alias("cluster"), F.lit(-1).alias("was"))
    state = state.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in state.schema]))
    change, sums, paths = centroids, np.zeros((k, dims + 1), object), []
    for i in range(rounds + 1):
        state = written(spark, assigned(state, change, centroids), "centroids")
        paths.append(state.inputFiles()[:1])
        for old in paths[:-1]:  # the table before is no longer read
            remove(spark, old[0].rsplit("/", 1)[0]) if old else None
        paths = paths[-1:]
        if i == rounds:
            break
        for r in moves(state, k, dims).collect():  # k * (dims + 1) rows at most
            sums[r["cluster"], r["part"]] += int(r["total"])
        new = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, centroids)], np.int64)
        change, centroids = new - centroids, new
        if not change.any():  # all further rounds would leave everything as it is
            break
    squares = F.array(*[F.lit(int(x)) for x in (centroids * centroids).sum(1)])
    at = F.col("cluster") + 1
    state = state.withColumn("distance", F.element_at(squares, at) - 2 * F.element_at("dots", at) + F.col("norm"))
    inertia = {r[0]: int(r[1]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(k)])
    return state.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "cluster", "distance", F.element_at(own, at).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(x) for x in digest]), at).alias("centroid_sha256"))


def _oracle() -> str:
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS c, e FROM (SELECT sha256(concat('{SEED}:', CAST(vec_id AS VARCHAR))) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS + 1):
        # distances as 128-bit sums over the components; the smaller centroid wins a tie
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, e, x.d AS d, x.c AS c FROM (SELECT vec_id, e, (SELECT min(struct_pack(d := CAST(list_sum(list_transform(range(1, {DIMS + 1}), lambda j: (v.e[j] - c.e[j]) * (v.e[j] - c.e[j]))) AS BIGINT), c := c)) FROM c{i} c) AS x FROM v))")
        if i < ROUNDS:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS e FROM (SELECT c, j, CAST((sum(e[j]) - ((sum(e[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM a{i}, (SELECT unnest(range(1, {DIMS + 1})) AS j) GROUP BY c, j) GROUP BY c)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c0.c, coalesce(s.e, c0.e) AS e FROM c{i} c0 LEFT JOIN s{i} s ON s.c = c0.c)")
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} k ON k.c = a.c"""


ORACLE = _oracle()
