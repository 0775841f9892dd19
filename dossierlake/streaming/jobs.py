"""Structured Streaming jobs: continuous audits, index refresh, repeat suppression, live statistics, task state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from . import segments


def source(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file as it appears in its folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


#: Errors that a document's own data raise, and signs that a cluster failed instead.
DATA = ("PythonException", "SparkRuntimeException", "SparkArithmeticException", "SparkDateTimeException", "SparkNumberFormatException", "USER_RAISED_EXCEPTION")
CLUSTER = ("ExecutorLost", "FetchFailed", "OutOfMemory", "No space left", "Python worker exited unexpectedly")


def _of_data(e: Exception) -> bool:
    said = f"{type(e).__name__} {e}"
    return any(x in said for x in DATA) and not any(x in said for x in CLUSTER)


def _failing(df: DataFrame, run: Callable[[DataFrame], DataFrame], mark: Column, depth: int = 0, rest: int = 0) -> dict[int, str]:
    """Marks of the documents whose own audit raises, with their errors: a part that raises is halved until one is left."""
    part = df.where(F.pmod(mark, F.lit(1 << depth)) == rest)
    try:
        run(part).write.format("noop").mode("overwrite").save()
        return {}
    except Exception as e:
        if not _of_data(e):
            raise
        marks = part.select(mark.alias("m")).distinct().limit(2).collect()
        if len(marks) == 1:
            return {marks[0]["m"]: str(e)[:500]}
        if not marks:
            raise
    return _failing(df, run, mark, depth + 1, rest) | _failing(df, run, mark, depth + 1, rest + (1 << depth))


def audit(stream: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Each micro-batch is audited once and written under its number, so a replayed batch overwrites itself. ``run`` audits each
    document by itself and tells what is wrong with a document in a column ``error`` of its rows: these go to the failed table,
    however many they are, and the others stand. A ``run`` that raises for a document instead is tried on ever smaller parts
    of the batch to find it, which is dear; other errors fail the batch, which the stream tries again when it is started anew."""
    mark = F.xxhash64(key)

    def batch(df: DataFrame, n: int) -> None:
        bad: dict[int, str] = {}
        where = f"{out}/batch={n}"
        try:
            run(df).write.mode("overwrite").parquet(where)
        except Exception as e:
            if not _of_data(e):
                raise
            bad = _failing(df, run, mark)
            if not bad:
                raise
            run(df.where(~mark.isin(list(bad)))).write.mode("overwrite").parquet(where)
        spark = df.sparkSession
        raised = df.select(key, mark.alias("__m")).join(spark.createDataFrame(list(bad.items()), "__m long, error string"), "__m").select(key, "error").distinct()
        rows = spark.read.parquet(where)
        if "error" in rows.columns:
            raised = raised.unionByName(rows.where("error is not null").select(key, "error").distinct())
        raised.write.mode("overwrite").parquet(f"{failed}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guarded(run: Callable[[DataFrame], DataFrame], checks: Sequence[tuple[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    """A ``run`` that is given only the documents that pass all checks (what is wrong, and a condition that holds where it is;
    null counts as wrong): the others come back with the first error."""

    def both(df: DataFrame) -> DataFrame:
        wrong = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(what)) for what, bad in checks])
        told = df.withColumn("error", wrong)
        return run(told.where("error is null").drop("error")).unionByName(told.where("error is not null").select("doc_id", "error"), allowMissingColumns=True)

    return both


def index(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the index of ``segments`` up to date with a stream of new and changed rules."""
    return stream.writeStream.foreachBatch(lambda df, n: segments.refresh(df, out, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_states(events: DataFrame) -> DataFrame:
    """Tasks as their events (task_id, event_no, kind, status, path, error) leave them: ``update`` sets status, path and error,
    ``status`` the status alone, ``delete`` removes the task unless it is added anew."""
    gone = F.max(F.when(F.col("kind") == "delete", F.col("event_no")))
    after = events.groupBy("task_id").agg(gone.alias("gone"))
    live = events.join(after, "task_id").where((F.col("kind") != "delete") & (F.col("gone").isNull() | (F.col("event_no") > F.col("gone"))))
    whole = F.when(F.col("kind") != "status", F.col("event_no"))
    return live.groupBy("task_id").agg(F.max_by("status", "event_no").alias("status"), tx.blank(F.max_by("path", whole)).alias("path"), tx.blank(F.max_by("error", whole)).alias("error"))


def first_requests(stream: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """The first request of each key within its time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def live_statistics(stream: DataFrame, ts: str = "created_at", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls and hits by window and status; a window ends ``late`` after the newest call."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, window), "status")
    return rows.agg(F.count("*").alias("calls"), F.sum(F.col("cache_hit").cast("int")).alias("hits")).select(F.col("window.start").alias("start"), "status", "calls", "hits")


def task_state(stream: DataFrame) -> DataFrame:
    """The latest status of each task."""
    return stream.groupBy("task_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a streaming result over what is there and return the table it fills: Parquet files beside the checkpoint, by
    batch number, or, in complete mode, those of the last batch alone."""
    spark, out = df.sparkSession, f"{checkpoint}-table"
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{out}/batch=none")

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else n}")

    q = df.writeStream.outputMode(mode).queryName(name).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)
