"""Task states over a stream, and audits that meet many bad documents."""

from dossierlake.streaming import cache, jobs, tasks
from pyspark.sql import functions as F


def test_many_bad_documents_cost_one_run(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("bad")).otherwise("good text").alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    runs = []

    def run(df):
        runs.append(1)
        return df.select("doc_id", F.length("text").alias("n"))

    checks = [("no text", F.col("text") == ""), ("bad", F.col("text") == "bad")]
    jobs.audit(jobs.source(spark, f"{tmp_path}/in", docs.schema), jobs.guarded(run, checks), f"{tmp_path}/out", f"{tmp_path}/failed", f"{tmp_path}/check").awaitTermination()
    lost = {r.doc_id: r.error for r in spark.read.parquet(f"{tmp_path}/failed").collect()}
    assert lost == {i: ("no text", "bad")[i % 3] for i in range(3000) if i % 3 < 2} and len(runs) == 1
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").where("error is null").collect()} == set(range(2, 3000, 3))


def test_transitions_follow_the_table(spark, tmp_path):
    def put(rows):
        spark.createDataFrame([(*r, None, None) if len(r) == 3 else r for r in rows], tasks.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drained():
        schema = spark.createDataFrame([], tasks.EVENT).schema
        with cache.keyed_state(spark):
            return jobs.drain(tasks.transitions(jobs.source(spark, f"{tmp_path}/in", schema, files=1)), f"tasks_{tmp_path.name}", "append", f"{tmp_path}/check")

    put([(1, 2, "start"), (1, 1, "submit"), (2, 1, "submit"), (2, 2, "start"), (2, 3, "cancel"), (3, 1, "start"), (4, 1, "submit"), (4, None, "start"), (5, 1, "odd")])
    put([(1, 3, "pause"), (1, 4, "done", "early", None), (2, 4, "done", "x", None), (1, 2, "start"), (3, 2, "submit")])
    steps = drained()
    assert {r.task_id: (r.status, r.path) for r in tasks.latest(steps).collect()} == {1: ("PAUSED", ""), 2: ("CANCELLED", ""), 3: ("PENDING", ""), 4: ("PENDING", ""), 5: ("", "")}
    put([(1, 5, "resume"), (1, 6, "fail", None, "why"), (2, 5, "submit"), (2, 6, "start"), (2, 7, "done", "y", None), (2, 8, "approve")])
    steps = drained()  # a new query goes on from the state of the old one
    assert {r.task_id: (r.status, r.error) for r in tasks.latest(steps).collect()}[1] == ("FAILED", "why")
    assert [(r.kind, r.accepted) for r in steps.where("task_id = 2").orderBy("event_no").collect()] == [("submit", True), ("start", True), ("cancel", True), ("done", False), ("submit", True), ("start", True), ("done", True), ("approve", True)]
