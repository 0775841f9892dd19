"""The block index and the vector blocks against scoring everything, and what they skip."""

import math
import random

from dossierlake.operators import index as ix
from dossierlake.operators import retrieval as rt
from dossierlake.operators import vectors as vc
from pyspark.sql import functions as F


def corpus(spark, n=6000):
    draw = random.Random(2)
    word = lambda: f"w{int(draw.paretovariate(0.9)) % 900}"
    topic = lambda i: f"topic{i // 500}" if draw.random() < 0.6 else word()
    rows = [(i, " ".join([word() for _ in range(draw.randrange(4, 40))] + [topic(i), topic(i)])) for i in range(n)]
    return spark.createDataFrame(rows + [(n, ""), (n + 1, None), (n + 2, "w1 " * 3000)], "rule_id int, text string").repartition(4, "rule_id").sortWithinPartitions("rule_id")


def test_block_search_equals_scoring_everything(spark):
    texts = corpus(spark)
    queries = spark.createDataFrame([(1, "topic3 w5"), (2, "topic7 topic7 w1 w2"), (3, "w1 w3 w8"), (4, "nowhere"), (5, ""), (6, "w2"), (7, None)], "query_id int, query string")
    index = ix.build(texts)
    full = rt.top(rt.bm25(queries, texts), 10, [F.round("score", 9).desc(), F.asc("rule_id")])
    want = {(r.query_id, r.rank): (r.rule_id, round(r.score, 7)) for r in full.collect()}
    hits, report = ix.search(index, queries, 10)
    assert {(r.query_id, r.rank): (r.rule_id, round(r.score, 7)) for r in hits.collect()} == want and len(want) > 30
    blocks = {r.query_id: (r.read, r.blocks) for r in report.collect()}
    assert blocks[1][0] < blocks[1][1] / 2 and blocks[2][0] < blocks[2][1]  # topics lie together: most blocks are skipped
    # a filter of the rows comes before the cut
    keep = lambda rows: rows.where("rule_id % 7 = 0")
    whole = rt.top(rt.bm25(queries, texts).where("rule_id % 7 = 0"), 5, [F.round("score", 9).desc(), F.asc("rule_id")])
    some, _ = ix.search(index, queries, 5, keep=keep)
    assert {(r.query_id, r.rank, r.rule_id) for r in some.collect()} == {(r.query_id, r.rank, r.rule_id) for r in whole.collect()}
    assert ix.search(ix.build(texts.limit(0)), queries, 3)[0].count() == 0


def test_facets_repeated_keys_and_many_queries_equal_scoring_everything(spark, monkeypatch):
    texts = corpus(spark, 1500)
    index = ix.build(texts.withColumn("f", F.when(F.col("rule_id") % 5 > 0, F.concat(F.lit("f"), F.col("rule_id") % 5))), facet="f")
    assert index.blocks.count() <= 1503 // ix.BLOCK_ROWS + 4  # a block is a row: postings are not rows of their own
    queries = spark.createDataFrame([(i, f"topic{i % 3} w{1 + i % 7} w2") for i in range(30)], "query_id int, query string")
    allowed = queries.select("query_id", F.explode(F.array(F.concat(F.lit("f"), F.col("query_id") % 5), F.lit("f3"))).alias("facet"))
    fits = F.col("rule_id") % 5 == 3
    whole = rt.bm25(queries, texts).where(fits | ((F.col("rule_id") % 5 > 0) & (F.col("rule_id") % 5 == F.col("query_id") % 5)))
    rows = lambda df: {(r.query_id, r["rank"], r.rule_id, round(r.score, 7)) for r in df.collect()}
    by = [F.round("score", 9).desc(), F.asc("rule_id")]
    assert rows(ix.search(index, queries, 4, allowed=allowed)[0]) == rows(rt.top(whole, 4, by))
    monkeypatch.setattr(ix, "QUERY_ROWS", 7)  # several passes
    assert rows(ix.search(index, queries, 4, allowed=allowed)[0]) == rows(rt.top(whole, 4, by))
    twice = texts.unionByName(texts.where("rule_id < 40"))  # scores of a repeated key add up
    assert rows(ix.search(ix.build(twice), queries, 3)[0]) == rows(rt.top(rt.bm25(queries, twice), 3, by))


def test_postings_need_no_shuffle(spark):
    rows = ix.postings(spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "rule_id int, text string"))
    assert {(r.rule_id, r.term, r.tf, r.dl) for r in rows.collect()} == {(1, "a", 1, 3), (1, "b", 2, 3)}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_vector_blocks_equal_all_distances(spark):
    draw = random.Random(9)
    centres = [[draw.uniform(-5, 5) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + draw.gauss(0, 0.3) for x in centres[i % 12]], "GEN" if i % 3 else "A") for i in range(3000)]
    rows += [(9000 + i, [1.0] * 8, "B") for i in range(600)]  # one vector many times
    bad = [(1, None, "A"), (2, [1.0], "A"), (3, [1.0] * 7 + [None], "A"), (4, [math.nan] * 8, "A"), (5, [math.inf] * 8, "A")]
    vectors = spark.createDataFrame(rows + [(10000 + i, v, p) for i, v, p in bad], "vec_id long, embedding array<double>, phase string")
    asked = [(i, rows[i * 37][1], ["GEN", "A"] if i % 2 else ["B"]) for i in range(40)] + [(50, [1.0] * 8, ["B", "B", "GEN"]), (51, None, ["A"]), (52, [1.0], ["A"])]
    queries = spark.createDataFrame(asked, "query_id int, q array<double>, facets array<string>")

    def plain(q, fits):
        found = []
        for i, v, p in rows:
            if fits(p):
                s = 0.0
                for a, b in zip(q, v):
                    s += (a - b) ** 2
                found.append((s, i))
        return [i for _, i in sorted(found)[:7]]

    hits, report = vc.nearest(queries, vectors, 7, 8, "phase", pivots=16, block=100)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: plain(q, set(f).__contains__) for i, q, f in asked if i < 51}
    read = {r.query_id: (r.read, r.blocks) for r in report.collect()}
    assert sum(a for a, _ in read.values()) < sum(b for _, b in read.values()) / 2
    # no facet: every vector may be met; fewer vectors than asked for; none at all
    few = spark.createDataFrame([(7, [0.0, 0.0]), (8, [1.0, 0.0])], "vec_id long, embedding array<float>")
    ask = spark.createDataFrame([("x", [1.0, 0.0])], "query_id string, q array<float>")
    assert [(r.vec_id, r.distance, r.rank) for r in vc.nearest(ask, few, 5, 2)[0].orderBy("rank").collect()] == [(8, 0.0, 1), (7, 1.0, 2)]
    assert vc.nearest(ask, few.limit(0), 5, 2)[0].count() == 0


def test_fusion_without_ids(spark):
    lists = spark.createDataFrame([(1, None, "a", 1, "x"), (1, None, "b", 2, "x"), (1, None, "a", 3, "y"), (1, 5, "a", 2, "x"), (1, 5, "b", 1, "z")], "query_id int, rule_id int, engine string, rank int, content string")
    found = {(r.rule_id, r.content): r.score for r in rt.fuse(lists, content="content").collect()}
    assert found == {(None, "x"): 1 / 61 + 1 / 62, (None, "y"): 1 / 63, (5, "x"): 1 / 62 + 1 / 61}


def test_blocks_are_read_in_small_row_groups(spark, monkeypatch):
    """Spark's reader unpacks a row group at once, so one of all blocks of a task does not fit an executor."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(ix, "GROUP_BLOCKS", 4)
    texts, queries = corpus(spark), spark.createDataFrame([(1, "topic3 w5"), (2, "w1 w2")], "query_id int, query string")
    index = ix.build(texts)
    groups = [m.row_group(i).num_rows for f in index.blocks.inputFiles() for m in [pq.read_metadata(f.removeprefix("file:"))] for i in range(m.num_row_groups)]
    assert sum(groups) >= 6003 // ix.BLOCK_ROWS and max(groups) <= 4
    full = rt.top(rt.bm25(queries, texts), 10, [F.round("score", 9).desc(), F.asc("rule_id")])
    assert {(r.query_id, r["rank"], r.rule_id) for r in ix.search(index, queries, 10)[0].collect()} == {(r.query_id, r["rank"], r.rule_id) for r in full.collect()}


def test_pieces_of_batches_hold_all_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 5, 4, 9)]
    assert [b["x"].to_pylist() for b in ix.pieces(iter(batches), 4)] == [[0, 1, 2, 3], [4], [0, 1, 2, 3], [0, 1, 2, 3], [4, 5, 6, 7], [8]]
