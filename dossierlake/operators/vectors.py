"""Exact nearest vectors of a batch of queries, by blocks around pivots.

Every vector goes to its nearest pivot, a vector drawn from the table; the vectors of a pivot (and of one ``facet``, such as
the life cycle that a query must match) lie in blocks of about ``BLOCK_ROWS`` rows. A block knows how far its farthest
vector is from its pivot, so by the triangle inequality none of its vectors is nearer to a query than the query's distance to
the pivot less that radius. A query first meets the blocks that may be nearest, until they hold k rows; then those
whose bound is no farther than the k-th distance found. In a block all its queries meet all its vectors in one matrix
product; only what the product cannot tell from the best k is measured component by component.

Vectors and queries that are null, of another length than most queries ask for (``dims``), or hold null or non-finite
components take no part; ties go to the smaller id; queries find nothing in an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import kept

#: Pivots (held on the driver and broadcast), vectors in a block, queries that meet a block in one task.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 64, 4096, 1024


def usable(v: str, dims: int) -> Column:
    return F.col(v).isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rows_of(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _measured(df: DataFrame, column: str, pivots: np.ndarray, nearest: bool) -> DataFrame:
    """``df`` with its distances to the pivots: to all (``far``, an array), or the nearest pivot alone (``pivot``, ``r``)."""
    dims = pivots.shape[1]
    names = df.columns
    more = "pivot int, r double" if nearest else "far array<double>"
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = rows_of(b[column], dims)
            square = (v * v).sum(1)[:, None] - 2 * (v @ pivots.T) + (pivots * pivots).sum(1)[None]
            if nearest:
                at = square.argmin(1)
                found = [pa.array(at.astype(np.int32)), pa.array(np.sqrt(((v - pivots[at]) ** 2).sum(1)))]
            else:
                far = np.sqrt(np.maximum(square, 0.0))
                found = [pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, len(pivots), dtype=np.int32)), pa.array(far.ravel()))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *found], [*names, *(["pivot", "r"] if nearest else ["far"])])

    return df.mapInArrow(run, kind)


def _best(k: int, dims: int):
    """Of one block: the best ``k`` of its vectors for each of the queries that meet it."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, v, ids = rows_of(queries["q"], dims), rows_of(vectors["embedding"], dims), vectors["vec_id"].to_numpy()
        names, found = queries["query_id"], []
        if len(q) and len(v):
            lengths = (v * v).sum(1)
            product = lengths[None] - 2 * (q @ v.T)
            for i in range(len(q)):
                cut = min(k, len(v)) - 1
                slack = 1e-9 * (1 + lengths.max() + (q[i] * q[i]).sum())
                at = np.flatnonzero(product[i] <= np.partition(product[i], cut)[cut] + slack)
                apart = np.add.accumulate((q[i] - v[at]) ** 2, axis=1)[:, -1]  # one component after another
                order = np.lexsort((ids[at], apart))[:k]
                found.append((np.full(order.size, i), ids[at[order]], apart[order]))
        which, hit, apart = (np.concatenate([f[j] for f in found]) if found else np.empty(0, t) for j, t in ((0, np.int64), (1, ids.dtype), (2, np.float64)))
        return pa.table({"query_id": names.take(pa.array(which)), "vec_id": pa.array(hit, vectors["vec_id"].type), "distance": pa.array(apart)})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, dims: int, facet: str | None = None, pivots: int = PIVOTS, block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, distance (squared), rank) and a report (query_id, blocks, read). ``queries``: query_id, q and, with
    ``facet``, an array ``facets`` of the facets it may meet; ``vectors``: vec_id, embedding and the facet."""
    one = F.lit("") if facet is None else F.coalesce(F.col(facet).cast("string"), F.lit(""))
    rows = vectors.where(usable("embedding", dims)).select("vec_id", "embedding", one.alias("facet"))
    spark, kind = vectors.sparkSession, f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, distance double"
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(pivots).collect()
    if not drawn:
        return spark.createDataFrame([], f"{kind}, rank int"), spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, blocks long, read long")
    centre = np.array([r[0] for r in drawn], np.float64)
    placed = kept(_measured(rows, "embedding", centre, True), "placed")
    many = placed.groupBy("facet", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("m"))
    placed = kept(placed.join(many, ["facet", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("m")).cast("int")).drop("m"), "blocks")
    blocks = placed.groupBy("facet", "pivot", "part").agg(F.count("*").alias("n"), F.max("r").alias("radius"))
    facets = F.array(F.lit("")) if facet is None else F.array_distinct(F.col("facets"))
    asked = queries.where(usable("q", dims)).select("query_id", "q", facets.alias("facets"))
    chunks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = kept(_measured(asked, "q", centre, False).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")), "asked")
    wide = asked.select("query_id", "chunk", F.explode("facets").alias("facet"), F.posexplode("far").alias("pivot", "far")) if facet is None else asked.select("query_id", "chunk", "far", F.explode("facets").alias("facet")).select("query_id", "chunk", "facet", F.posexplode("far").alias("pivot", "far"))
    bounds = kept(wide.join(blocks, ["facet", "pivot"]).select("query_id", "chunk", "facet", "pivot", "part", "n", F.greatest(F.col("far") - F.col("radius"), F.lit(0.0)).alias("bound"), "far"), "bounds")
    order = Window.partitionBy("query_id").orderBy("bound", "far", "facet", "pivot", "part")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = kept(bounds.withColumn("__before", before).where(F.col("__before") < k).drop("__before"), "seeds")
    key = ["facet", "pivot", "part", "chunk"]

    def measured(pairs: DataFrame) -> DataFrame:
        here = placed.join(pairs.select(*key).distinct(), key[:3]).select("vec_id", "embedding", *[F.col(c).alias(f"v_{c}") for c in key])
        left = pairs.select("query_id", *key).join(asked.select("query_id", "q"), "query_id")
        return left.groupBy(*key).cogroup(here.groupBy(*[f"v_{c}" for c in key])).applyInArrow(_best(k, dims), kind)

    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = kept(top(measured(seeds)), "first")
    kth = first.where(F.col("rank") == k).select("query_id", (F.sqrt("distance") * (1 + 1e-9) + 1e-9).alias("kth"))
    rest = bounds.join(seeds, ["query_id", *key[:3]], "left_anti").join(kth, "query_id", "left").where("kth is null or bound <= kth")
    rest = kept(rest.select("query_id", *key), "rest")
    hits = kept(top(first.drop("rank").unionByName(measured(rest))), "hits")
    read = seeds.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("read"))
    return hits, bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")
