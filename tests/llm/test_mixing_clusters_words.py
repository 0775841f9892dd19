"""Mixing, centroid clustering and spelling variants against brute force and on the defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import centroids, mixing, queries, variants

SMALL = "/root/testdata/sf0.001"


# --- mixing ---


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, h int, k0 int, target int")
    found = mixing.mix(spark, docs, ["doc_id"], **more).collect()
    assert len(found) == len(rows)
    return found


def filled(sizes, weights, share=1.5, epochs=2):
    """Plain water-filling: {source: target}."""
    wanted, capped = share * sum(sizes.values()), set()
    while True:
        free = wanted - sum(epochs * sizes[s] for s in capped)
        left = sum(weights[s] for s in sizes if s not in capped)
        goal = {s: epochs * sizes[s] if s in capped else weights[s] * free / left for s in sizes}
        over = {s for s in sizes if s not in capped and goal[s] > epochs * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mixing_against_plain_water_filling(spark):
    draw = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(draw.randrange(60))), draw.choice(["a", "b", "b", "b", "c", "d", None]), 1, 2, 3) for i in range(400)]
    found = mixed(spark, rows)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    names = sorted((s for s in sizes if s), key=str) + [None]
    goal = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    taken, source = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in found:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and math.isclose(r["target"], goal[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    assert any(g == 2 * sizes[s] for s, g in goal.items())  # one source at its cap
    again = {r["doc_id"]: r["taken"] for r in mixed(spark, rows)}
    assert again == {r["doc_id"]: r["taken"] for r in found}
    other = {r["doc_id"]: r["taken"] for r in mixed(spark, rows, seed="other")}
    assert other != again


def test_mixing_defined_cases(spark):
    rows = [(1, None, None, 0, 0, 0), (None, "", "a", 0, 0, 0), (2, "\x0b\t ", "a", 0, 0, 0), (3, "x y", "b", 0, 0, 0), (3, "x y", "b", 0, 0, 0)]
    found = mixed(spark, rows)
    assert sorted(r["size"] for r in found) == [0, 0, 0, 2, 2]
    assert sum(r["taken"] for r in found) == 6  # 150 % of four words, all from the one source that has any
    assert mixed(spark, []) == []
    # many repeated rows share alike; a weight of nothing gives nothing
    rows = [(7, "one two three four", "a", 0, 0, 0)] * 30 + [(8, "x " * 40, "z", 0, 0, 0)]
    found = mixed(spark, rows, weigh=lambda s, t: t.withColumn("weight", F.when(F.col("source") == "a", 1.0)))
    assert {(r["doc_id"], r["taken"], r["target"]) for r in found} == {(7, 8, 240.0), (8, 0, 0.0)}
    with pytest.raises(ValueError, match="size"):
        mixing.mix(spark, spark.createDataFrame([(1, "t", "s")], "size int, text string, source string"), ["size"])


def test_mixing_is_native(spark):
    plan = queries.op11_source_mixing(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- clustering ---


def lloyd(rows, k=8, rounds=10):
    """Plain rounds over (id, whole-number vector): [(id, cluster, distance)], centroids."""
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    cents = [list(v) for _, v in start]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cents)), key=lambda c: (dist(v, cents[c]), c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)].append(v)
        for c, vs in own.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, near(v), dist(v, cents[near(v)])) for i, v in rows], cents


def test_clusters_against_plain_rounds(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(150)] + [(200, [0.5] * 64)] * 40
    bad = [(300, None), (301, [0.1] * 63), (302, [0.1] * 63 + [None]), (303, [float("nan")] * 64), (304, [float("inf")] * 64), (305, [])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id bigint, embedding array<double>, cluster2 string, dots int")
    found = centroids.cluster(spark, vectors).collect()
    want, cents = lloyd([(i, [math.floor(1024 * x) for x in v]) for i, v in rows])
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found) == Counter(want)
    own = Counter()
    for _, c, d in want:
        own[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    assert all(r["cluster_inertia"] == own[r["cluster"]] and r["inertia"] == sum(own.values()) and r["centroid_sha256"] == digest[r["cluster"]] for r in found)


def test_clusters_defined_cases(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert centroids.cluster(spark, spark.createDataFrame([], kind)).collect() == []
    few = centroids.cluster(spark, spark.createDataFrame([(1, [0.25] * 64), (None, [0.25] * 64), (2, [0.25] * 64)], kind)).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in few] == [(0, 0, 0)] * 3  # ties go to the smaller centroid
    with pytest.raises(ValueError, match="distance"):
        centroids.cluster(spark, spark.createDataFrame([(1, [0.5] * 64)], "distance int, embedding array<double>"), ["distance"])
    with pytest.raises(Exception, match="131,072"):
        centroids.cluster(spark, spark.createDataFrame([(1, [1e9] * 64)], "vec_id int, embedding array<double>")).collect()


# --- spelling variants ---


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def plain(words, times=10):
    """{word: (form, root, n, n_near, form_n)}, by comparing all with all."""
    near = {w: [u for u in words if one_apart(w, u)] for w in words}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def vocabulary(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    return {w: n for w, n in count.items() if n >= 2}


def told(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


def test_variants_of_the_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = told(queries.op13_spelling_variants(spark, SMALL))
    words = vocabulary([(r[0], r[1]) for r in rows])
    assert {w: v[2] for w, v in found.items()} == words
    some = sorted(words)[::7]
    near = {w: [u for u in words if abs(len(u) - len(w)) < 2 and one_apart(w, u)] for w in some}
    assert {w: found[w][3] for w in some} == {w: len(us) for w, us in near.items()}


@pytest.mark.parametrize("cells", [variants.CELLS, 200])
def test_variants_against_all_pairs(spark, cells):
    draw = random.Random(11)
    words = {}
    for alphabet, size in (("ab", 7), ("ab", 8), ("abé", 9), ("aß", 12), ("xyz", 7)):
        for _ in range(60):
            words["".join(draw.choice(alphabet) for _ in range(size))] = int(10 ** (draw.random() * 4)) + 2
    words |= {"a" * k: 3**k for k in range(7, 14)} | {"q" * 300: 2, "q" * 301: 50}
    vocab = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = told(variants.forms(spark, vocab, cells=cells))
    assert found == plain(words)
    assert any(v[1] not in (v[0], w) for w, v in found.items())  # a chain of two forms at least


def test_variants_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Straßen1straßen straßeñ", "x"), (None, "straßen", "x"), (3, "short words", "x"), (4, "z" * 5000, "y"), (5, "Z" * 5000, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    assert {w: v[2] for w, v in told(variants.group(spark, docs)).items()} == vocabulary([r[:2] for r in rows])
    assert told(variants.group(spark, spark.createDataFrame([], "doc_id bigint, text string"))) == {}


# --- their SQL ---


def test_sql_of_clusters(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    found = queries.op12_centroids(spark, SMALL)
    names = sorted(found.columns)
    want = con.execute(queries.ORACLES["op12_centroids"]).df()[names]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.itertuples(index=False, name=None))
