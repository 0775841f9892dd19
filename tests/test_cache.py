"""The response cache: lifetimes by outcome, revival, restart from the checkpoint, state that goes."""

from dossierlake.streaming import cache, jobs
from pyspark.sql import functions as F

KIND = "request_id long, cache_key string, at long, status string"
DAY = 24 * 3600


def plain(rows, lives):
    end, out = {}, {}
    for i, key, at, status in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = key in end and at <= end[key]
        if not out[i] and lives.get(status, 0) > 0:
            end[key] = at + lives[status]
    return out


def drained(spark, tmp_path, lives=cache.LIVES):
    schema = spark.createDataFrame([], KIND).schema
    stream = jobs.source(spark, f"{tmp_path}/in", schema, files=1).select("request_id", "cache_key", F.timestamp_seconds("at").alias("created_at"), "status")
    with cache.keyed_state(spark):
        found = jobs.drain(cache.decided(stream, lives), f"cache_{tmp_path.name}", "append", f"{tmp_path}/check")
    return {r.request_id: r.hit for r in found.collect()}


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_lifetimes_of_both_outcomes(spark, tmp_path):
    t = 1_700_000_000
    rows = [(1, "a", t, "success"), (2, "a", t + 30 * DAY, "success"), (3, "a", t + 30 * DAY + 1, "success"), (4, "a", t + 60 * DAY + 1, "failed"), (5, "a", t + 60 * DAY + 2, "failed")]
    rows += [(11, "b", t, "failed"), (12, "b", t + 600, "success"), (13, "b", t + 601, "success"), (14, "b", t + 601 + 30 * DAY, "failed"), (15, "b", t + 602 + 30 * DAY, "failed"), (16, "b", t + 603 + 30 * DAY, "success")]
    rows += [(21, None, t, "success"), (22, None, t + 1, "success"), (31, "c", t, "odd"), (32, "c", t, "success"), (33, "c", t, "success")]
    put(spark, tmp_path, [*rows, (41, "d", None, "success"), (42, "d", None, "success")])
    assert drained(spark, tmp_path) == plain(rows, cache.LIVES) | {41: False, 42: False}


def test_restart_goes_on_and_expired_entries_leave(spark, tmp_path):
    t = 1_700_000_000
    one = [(1, "a", t, "success"), (2, "b", t, "failed"), (3, "c", t, "success")]
    two = [(4, "a", t + 5, "success"), (5, "b", t + 500, "failed"), (6, "b", t + 700, "failed")]
    three = [(7, "z", t + 90 * DAY, "success")]  # the watermark passes all ends
    four = [(8, "a", t + 91 * DAY, "failed"), (9, "z", t + 91 * DAY, "failed"), (10, "y", t + 91 * DAY, "success")]
    for part in (one, two, three, four):
        put(spark, tmp_path, part)
        found = drained(spark, tmp_path)  # a new query on the old checkpoint each time
    assert found == plain(one + two + three + four, cache.LIVES)
    assert found[4] and found[5] and not found[6] and not found[8] and found[9]
    state = spark.read.format("statestore").option("stateVarName", "end").load(f"{tmp_path}/check")
    assert {r.key.cache_key for r in state.collect()} == {"a", "y", "z"}  # b and c have gone
    assert drained(spark, tmp_path) == found  # nothing new: nothing decided twice
