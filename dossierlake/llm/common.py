"""Helpers shared by the operators: the folder all executors share, written intermediate tables, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh one of our own only where it is unset and the
    session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``written`` through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


atexit.register(_clean)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts can be long: bound the rows of an Arrow batch, and so the memory of a Python worker. Its bytes are bounded by
    spark.sql.execution.arrow.maxBytesPerBatch; a session that asks for fewer rows keeps its setting."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def output_names(keys: Sequence[str], results: Sequence[str]) -> None:
    """Keys are carried under names of their own, but in the result they stand beside the operator's columns."""
    clash = sorted({k.lower() for k in keys} & {r.lower() for r in results}) or sorted({k for k in keys if [*keys].count(k) > 1})
    if clash:
        raise ValueError(f"keys may not be named {', '.join(clash)}: rename them before the call")


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with some columns in place of its own."""
    return pa.RecordBatch.from_arrays([columns.get(n, batch[n]) for n in batch.schema.names], batch.schema.names)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, the smallest node that links reach.

    Alternates the large-star and small-star contractions: each round sends every node's neighbours to its smallest
    neighbour, so the edges turn into stars in O(log^2 n) rounds. All work is joins and grouped minima (combined before
    the shuffle); a hot node's rows can be split by Spark's skew join, as its minimum is one row. Edges with a null end
    are dropped; a self-loop gives a component of its own. No edges, no rows.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    current = written(spark, pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = current.where("u = v")
        large = large.union(own).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        current = written(spark, small, "edges")
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    star = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
