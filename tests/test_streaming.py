import pytest
from dossierlake.operators import index as ix
from dossierlake.operators import retrieval as rt
from dossierlake.streaming import jobs, segments
from pyspark.sql import functions as F


def start(spark, tmp_path, run):
    docs = spark.createDataFrame([(i, "bad" if i in (3, 11) else f"text {i}") for i in range(20)], "doc_id long, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = jobs.source(spark, f"{tmp_path}/in", docs.schema)
    return jobs.audit(stream, run, f"{tmp_path}/out", f"{tmp_path}/failed", f"{tmp_path}/check")


def test_audit_loses_only_the_failing_documents(spark, tmp_path):
    checked = F.when(F.col("text") == "bad", F.raise_error(F.lit("no such text")).cast("int")).otherwise(F.length("text"))
    start(spark, tmp_path, lambda df: df.select("doc_id", checked.alias("n"))).awaitTermination()
    good = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    lost = {r.doc_id: r.error for r in spark.read.parquet(f"{tmp_path}/failed").collect()}
    assert good == set(range(20)) - {3, 11} and set(lost) == {3, 11} and all("no such text" in e for e in lost.values())


def test_audit_fails_the_batch_when_the_cluster_does(spark, tmp_path):
    def run(df):
        raise RuntimeError("ExecutorLostFailure")

    with pytest.raises(Exception, match="ExecutorLostFailure"):
        start(spark, tmp_path, run).awaitTermination()


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drain_keeps_its_rows_out_of_the_driver(spark, tmp_path, mode):
    docs = spark.range(40).select("id", (F.col("id") % 4).alias("k"))
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = jobs.source(spark, f"{tmp_path}/in", docs.schema, files=1)  # several batches
    rows = stream if mode == "append" else stream.groupBy("k").count()
    found = jobs.drain(rows, f"drained_{mode}", mode, f"{tmp_path}/check")
    want = [(i, i % 4) for i in range(40)] if mode == "append" else [(k, 10) for k in range(4)]
    assert sorted(map(tuple, found.collect())) == want
    assert found.inputFiles() and not spark.catalog.tableExists(f"drained_{mode}")


def test_index_refresh_drops_retired_and_replays(spark, tmp_path):
    row = "rule_id long, status string, content string, is_washed boolean, condensed_content string"
    make = lambda *r: spark.createDataFrame([(i, s, t, False, "") for i, s, t in r], row)
    out = str(tmp_path / "index")
    segments.refresh(make((1, "active", "a b"), (2, "active", "b"), (3, "inactive", "c")), out, 0)
    changed = make((1, "active", "a d"), (2, "inactive", "b"), (3, "active", "c"))
    for _ in range(2):
        segments.refresh(changed, out, 1)
        assert {(r.rule_id, r.term) for r in segments.postings_now(spark, out).collect()} == {(1, "a"), (1, "d"), (3, "c")}
    segments.refresh(changed, out, 2)
    assert segments.manifest(spark, out)["segments"][-1]["name"] == "segment-1" and segments.postings_now(spark, out).count() == 3


def test_statistics_equal_a_rebuild_after_many_batches(spark, tmp_path):
    import random

    draw, out, now = random.Random(8), str(tmp_path / "index"), {}
    row = "rule_id long, status string, content string, is_washed boolean, condensed_content string"
    for n in range(20):
        some = {draw.randrange(40): ("inactive" if draw.random() < 0.2 else "active", " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(0, 6)))) for _ in range(draw.randrange(0, 9))}
        now |= some
        segments.refresh(spark.createDataFrame([(i, s, t, False, "") for i, (s, t) in some.items()], row).coalesce(1), out, n)
    state = segments.manifest(spark, out)
    assert len(state["segments"]) <= 2 * (segments.FAN - 1) and max(s["level"] for s in state["segments"]) == 2 - (len(state["segments"]) > 4)
    whole = ix.build(rt.active_texts(spark.createDataFrame([(i, s, t, False, "") for i, (s, t) in now.items()], row)))
    terms, stats = segments.statistics(spark, out)
    assert {tuple(r) for r in terms.collect()} == {(r.term, r.df) for r in whole.idf.collect()}
    assert stats.first().n == whole.stats.first().n and abs(stats.first().avgdl - whole.stats.first().avgdl) < 1e-12
    asked = spark.createDataFrame([(1, "a b"), (2, "h")], "query_id int, query string")
    found = [{(r.query_id, r.rule_id, round(r.score, 9)) for r in ix.search(i, asked, 5, floor=-9.0)[0].collect()} for i in (whole, segments.searchable(spark, out))]
    assert found[0] == found[1] and found[0]


def test_task_states(spark):
    rows = [(1, 1, "update", "PENDING", "", ""), (1, 2, "update", "DONE", "p", ""), (1, 3, "status", "CANCELLED", None, None), (2, 1, "update", "PENDING", "", ""), (2, 2, "delete", None, None, None), (3, 1, "delete", None, None, None), (3, 2, "update", "FAILED", None, "why")]
    events = spark.createDataFrame(rows, "task_id int, event_no int, kind string, status string, path string, error string")
    assert {tuple(r) for r in jobs.task_states(events).collect()} == {(1, "CANCELLED", "p", ""), (3, "FAILED", "", "why")}


def test_first_rules_are_indexed_where_they_lie(spark, tmp_path, monkeypatch):
    rows, plain, out = [], segments.ix.counted, str(tmp_path / "index")

    def counted(df, *more, **named):
        rows.append(df)
        return plain(df, *more, **named)

    monkeypatch.setattr(segments.ix, "counted", counted)
    rules = spark.createDataFrame([(1, "active", "a b", False, ""), (None, "active", "c", False, "")], "rule_id long, status string, content string, is_washed boolean, condensed_content string")
    segments.refresh(rules, out, 0)
    assert "Join" not in rows[0]._jdf.queryExecution().optimizedPlan().toString()  # nothing is held yet, so no text moves
    segments.refresh(rules, out, 1)
    assert rows[1].count() == 0 and {(r.rule_id, r.term) for r in segments.postings_now(spark, out).collect()} == {(1, "a"), (1, "b")}
