import collections
import hashlib
import math
import os
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from dossierlake.llm import common, decontamination, jaccard, licenses, queries, suffixes, token_counts, topk, toxicity, urls
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def read(spark, name, where=SMALL):
    return spark.read.parquet(f"{where}/{name}.parquet")


# --- components ---


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 400)] + [(5, 5), (3, None), (900, 7), (901, 900)]
    got = {r.node: r.component for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 400), 900, 901]} | {5: 5}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_raise_when_they_have_not_settled(spark):
    with pytest.raises(RuntimeError, match="settled"):
        common.components(spark, spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), max_rounds=1)


# --- n-gram Jaccard join ---


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_jaccard(rows):
    sets, parent, inv = [], {}, collections.defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()))
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        seen = collections.Counter(j for x in s for j in inv[x])
        for j, n in seen.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = top(i), top(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            inv[x].append(k)
    return sorted((i, len(s), top(i)) for i, s in sets)


def groups(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies():
    rng, vocab = np.random.default_rng(1), [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocab, 120))
    rows, i = [], 10
    for _ in range(60):  # a group of near copies that drift apart: a link chain longer than any one pair
        base = list(base)
        base[int(rng.integers(len(base)))] = f"x{i}"
        rows.append((i, " ".join(base)))
        i += 1
    line = " ".join(rng.choice(vocab, 30))
    for _ in range(80):  # a passage that many unrelated texts hold
        rows.append((i, line + " " + " ".join(rng.choice(vocab, int(rng.integers(3, 60))))))
        i += 1
    for n in (1, 3, 4, 5, 6, 9, 10):  # sizes where the bound turns
        for cut in (0, 1):
            rows.append((i, " ".join(f"s{n}_{k}" for k in range(n + 4 + cut))))
            i += 1
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "A b C"), (5, "a B c"), (6, "É é x y z w"), (7, "é é x y z w"), (8, "a b c"), (9, "w " * 40000 + "end")]


def test_jaccard_equals_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 0, 0, "s") for i, t in rows], "doc_id long, text string, node int, n int, component string")
    assert groups(jaccard.join(spark, docs)) == brute_jaccard(rows)


def test_jaccard_edge_rows(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (9, "q")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark, docs).collect()}
    assert got == {(4, 2, 2), (None, 2, None), (2, 2, 2), (9, 1, 9)}
    kept = sorted((r.doc_id is None, r.doc_id) for r in jaccard.keep_one(spark, docs).collect())
    assert kept == [(False, 2), (False, 9), (True, None)]
    assert jaccard.join(spark, docs.limit(0)).count() == 0


def test_jaccard_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    assert groups(queries.op2_ngram_jaccard(spark, SMALL)) == brute_jaccard(rows)


def test_jaccard_counts_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 16)
    monkeypatch.setattr(jaccard, "SLICE", 64)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], [(1000 + i, t) for i, t in enumerate(["a b c d e f", "A b c d e f", "", None, "x y", "x y z"])]
    for k in range(90):  # near copies of one text with up to three places changed: some pairs link and some do not
        w = list(base)
        for at in rng.integers(0, 120, k % 4):
            w[at] = f"n{k}_{at}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.links_verified for r in jaccard.join(spark, docs).collect()}
    sets = {i: frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in rows}
    other = set(sets.values()) - {frozenset()}
    want = {i: sum(t != s and 100 * len(s & t) >= 80 * len(s | t) for t in other) for i, s in sets.items()}
    assert got == want and max(want.values()) > 3 * jaccard.NEIGHBOURS and len({want[k] for k in range(90)}) > 5


# --- suffix-array deduplication ---


def brute_repeats(texts, size):
    xs = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[s : s + size] for x in xs for s in range(len(x) - size + 1))
    out = []
    for x in xs:
        mark = np.zeros(len(x) + 1, np.int32)
        for s in range(len(x) - size + 1):
            if seen[x[s : s + size]] > 1:
                mark[s] += 1
                mark[s + size] -= 1
        gone = np.cumsum(mark)[: len(x)] > 0
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def repeat_texts():
    rng = np.random.default_rng(3)
    piece = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared = [piece(n) for n in (399, 400, 401, 700, 1500)]
    texts = [None, "", "short", "x" * 399, "x" * 900, "ab" * 600, piece(5000)]
    for s in shared:
        for _ in range(6):
            texts.append(piece(int(rng.integers(0, 300))) + s[: int(rng.integers(380, len(s) + 1))] + piece(int(rng.integers(0, 300))))
    texts += [texts[-1], piece(300) + shared[3] + shared[3][:450], shared[4] + piece(40) + shared[4]]
    return texts


@pytest.mark.parametrize("group", [4096, 3])
def test_suffixes_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    texts = repeat_texts()
    docs = spark.createDataFrame([(None if k % 5 == 0 else k // 2, t, "d", 1) for k, t in enumerate(texts)], "doc_id long, text string, d string, runs int")
    got = suffixes.dedup(spark, docs, ["doc_id"]).select("n_bytes", (F.col("n_bytes") - F.length("kept")).alias("r"), F.size("runs").alias("s"), F.sha2("kept", 256).alias("h")).collect()
    assert sorted(map(tuple, got)) == brute_repeats(texts, 400)
    assert suffixes.dedup(spark, docs.limit(0), ["doc_id"]).count() == 0


def test_suffixes_on_documents(spark):
    texts = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    got = queries.op4_suffix_dedup(spark, SMALL).collect()
    assert sorted(tuple(r)[1:-1] for r in got) == brute_repeats(list(texts.values()), 400)
    told, sure, may = {r.doc_id for r in got if r.has_passage}, brute_passages(texts, 51), brute_passages(texts, 40)
    assert sure <= told <= may


def brute_passages(texts, width):
    """Keys of the texts that share a run of ``width`` words with another one."""
    held = collections.defaultdict(set)
    for k, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        for i in range(len(w) - width + 1):
            held[b" ".join(w[i : i + width])].add(k)
    return {k for ks in held.values() if len(ks) > 1 for k in ks}


@pytest.mark.parametrize("length, shared", [(39, False), (51, True), (52, True), (300, True)])
def test_passages_across_white_space_and_case(spark, length, shared):
    rng = np.random.default_rng(length)
    piece = lambda n: [f"Wort{k}" for k in rng.integers(0, 10**6, n)]
    passage, copy = piece(length), piece(60)
    texts = {0: " ".join(piece(70) + passage + piece(3)), 1: "\n".join(piece(1) + passage).upper(), 2: "\t".join(passage), 3: " ".join(copy), 4: " ".join(copy), 5: " ".join(piece(400)), 6: " ".join(["a"] * 500), 7: "", 8: None}
    docs = spark.createDataFrame([(t, "x", 1) for t in texts.values()], "text string, d string, g int").repartition(3)
    told = {r.d for r in suffixes.passages(spark, docs).collect()}
    marks = {r.k: r.d for r in spark.createDataFrame(list(texts.items()), "k long, text string").select("k", F.xxhash64("text").alias("d")).collect()}
    want = {3, 4} | ({0, 1, 2} if shared else set())
    assert {k for k, d in marks.items() if d in told and texts[k]} == want == brute_passages(texts, 51)
    assert suffixes.passages(spark, docs.limit(0)).count() == 0


def test_deep_shallow_sorts_and_measures(monkeypatch):
    rng = np.random.default_rng(5)
    strings = [bytes(rng.choice([97, 98], int(rng.integers(0, 300)))) for _ in range(60)] + [b"a" * n for n in (0, 63, 64, 65, 200, 200)] + [b"a" * 150 + bytes([n]) for n in range(9)] + [b"a\0", b"a"]
    groups_ = rng.integers(0, 2, len(strings))
    order, lcp = suffixes.deep_shallow(strings, groups_)
    assert [(groups_[i], strings[i]) for i in order] == sorted((groups_[i], strings[i]) for i in range(len(strings)))
    for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
        assert n == (-1 if groups_[a] != groups_[b] else suffixes.common_prefix(strings[a], strings[b]))


# --- token counts ---


def test_token_rollups(spark, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op5_token_counts(spark, SMALL).collect()}
    want = collections.defaultdict(lambda: (0, 0))
    for r in read(spark, "documents").collect():
        n, m = want[r.source, r.lang]
        want[r.source, r.lang] = n + 1, m + len(enc.encode_ordinary(r.text or ""))
    assert got == dict(want)

    store, path = str(tmp_path / "store"), P.path("byte_bpe_50k.tiktoken")
    put = lambda name, rows, kind="op string, doc_id long, source string, lang string, text string, extra int": token_counts.commit(spark, store, name, spark.createDataFrame(rows, kind), path, P.PATTERN, "v1")
    count = lambda t: len(enc.encode_ordinary(t))
    totals = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.totals(spark, store).collect()}
    assert token_counts.totals(spark, store).count() == 0
    one = [("insert", 1, "a", "en", "one two three", 0), ("insert", 2, "a", "en", None, 0), ("insert", 3, None, "de", "vier", 0), ("insert", None, "a", "en", "five", 0)]
    assert put("b1", one) and not put("b1", one)
    assert totals() == {("a", "en"): (3, count("one two three") + count("five")), (None, "de"): (1, count("vier"))}
    assert put("b2", [("revise", 1, "b", "en", "now much longer than before", 0), ("delete", 3, None, None, None, 0), ("delete", 77, "a", "en", "x", 0)])
    assert not put("b2", [("delete", 2, "a", "en", None, 0)])
    assert totals() == {("a", "en"): (2, count("five")), ("b", "en"): (1, count("now much longer than before"))}
    assert put("b3", [("insert", 9, "c", "en", "x", 1), ("delete", 9, "c", "en", None, 2), ("insert", 8, "c", "en", "long " * 50000, 1)], "op string, doc_id long, source string, lang string, text string, seq int")
    assert totals()["c", "en"] == (1, count("long " * 50000))
    assert put("b4", []) and totals()["b", "en"][0] == 1


def test_token_rollups_take_off_all_versions_and_compact(spark, tmp_path, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(token_counts, "PART_ROWS", 4)
    store, path = str(tmp_path / "store"), P.path("byte_bpe_50k.tiktoken")
    kind = "op string, doc_id long, source string, lang string, text string, seq int, part int"

    def put(name, version, *rows):
        return token_counts.commit(spark, store, name, spark.createDataFrame([(*r, 7) for r in rows], kind), path, P.PATTERN, version)

    totals = lambda: {(r.source, r.tokenizer): r.n_docs for r in token_counts.totals(spark, store).collect()}
    assert put("a", "v1", ("insert", 1, "s", "en", "one", 1), ("insert", 2, "s", "en", "two", 1))
    assert put("b", "v2", ("insert", 1, "s", "en", "one", 1))
    assert totals() == {("s", "v1"): 2, ("s", "v2"): 1}
    assert put("c", "v2", ("delete", 1, None, None, None, 1)) and not put("c", "v2", ("delete", 2, None, None, None, 1))
    assert totals() == {("s", "v1"): 1}
    # of two changes with one seq a single one counts, also if they are equal
    assert put("d", "v1", ("insert", 5, "t", "en", "x", 1), ("insert", 5, "u", "en", "y", 1), ("insert", 6, "w", "en", "z", 1), ("insert", 6, "w", "en", "z", 1))
    assert sum(n for (s, _), n in totals().items() if s in "tu") == 1 and totals()["w", "v1"] == 1
    for k in range(6):
        assert put(f"e/{k}", "v1", *[("insert", 100 + 10 * k + i, "m", "en", "w", 1) for i in range(6)])
    assert totals()["m", "v1"] == 36 and token_counts.live(spark, store).count() == 1 + 2 + 36
    kept = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store" / "live").rglob("*.parquet")}
    assert put("e/../6", "v1", *[("delete", 100 + i, None, None, None, 1) for i in range(0, 60, 2)])
    assert {k: f.stat().st_mtime_ns for f in (tmp_path / "store" / "live").rglob("*.parquet") if (k := str(f)) in kept} == kept  # deletes rewrite nothing
    before = totals()
    assert before["m", "v1"] == 18 and token_counts.live(spark, store).count() == 1 + 2 + 18
    token_counts.compact(spark, store)  # one segment stays, and what was in force
    assert totals() == before and token_counts.live(spark, store).count() == 1 + 2 + 18 and len(list((tmp_path / "store" / "live").iterdir())) == 1
    # a batch's name is any text, and counts as committed after a compaction too
    assert not any(put(n, "v1", ("insert", 900, "x", "en", "w", 1)) for n in ("e/0", "e/../6", "a"))
    assert put("e", "v1", ("revise", 101, "n", "en", "w", 1), ("insert", None, "n", "en", "w", 1)) and totals()["m", "v1"] == 17 and totals()["n", "v1"] == 2
    assert put("f", "v1", *[("delete", 100 + i, None, None, None, 1) for i in range(60)]) and ("m", "v1") not in totals() and totals()["n", "v1"] == 1


# --- decontamination ---


def test_tiles_are_longest_first_and_do_not_overlap():
    known = decontamination._Numbers()
    n = lambda t: decontamination.numbers(t, known)
    item, doc = "a b c d e f g h i j k l", "x g h i j k l y a b c d e f z a b c d e"
    tiles = decontamination.tile(n(item), n(doc))
    assert sorted(t[2] for t in tiles) == [6, 6] and {t[0] for t in tiles} == {0, 6}
    assert decontamination.tile(n("a b c d"), n("a b c d")) == [] and decontamination.tile(n("a b c d"), n("a b c d"), 4) == [(0, 0, 4)]
    assert decontamination.tile(n("q q q q q q"), n("q q q q q q q q q q q q")) == [(0, 0, 6)]


def brute_tiles(item, doc, least):
    a, b, out = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        for x in range(k):
            a[i + x] = b[j + x] = True
        out += k


def test_tiles_equal_brute_force():
    rng, known = np.random.default_rng(2), decontamination._Numbers()
    for _ in range(60):
        item, doc = ([f"t{x}" for x in rng.integers(0, 4, int(rng.integers(1, 40)))] for _ in range(2))
        tiles = decontamination.tile(decontamination.numbers(" ".join(item), known), decontamination.numbers(" ".join(doc), known), 3)
        assert sum(t[2] for t in tiles) == brute_tiles(item, doc, 3)


def test_leaks(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again today"), (2, "one two"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "x y z")], "item_id long, text string")
    rows = [(1, "so THE quick, brown fox jumps over the lazy dog again today!"), (2, "zeta eta theta iota kappa and then alpha beta gamma delta epsilon"), (3, "one three two"), (4, "well one two"), (5, None), (6, ""), (7, "word " * 60000 + "one two"), (None, "one two"), (4, "well one two")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, leaks string, item_id int")
    want = sorted([(1, 1), (2, 4), (4, 2), (4, 2), (7, 2), (-1, 2)])
    for words_ in (1_000_000, 8):  # in one block, and in several
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", words_)
        got = decontamination.mark(spark, docs, bench, ["doc_id"]).select("doc_id", F.explode("leaks.item_id").alias("i")).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.i) for r in got) == want
    assert decontamination.mark(spark, docs, bench.limit(0), ["doc_id"]).where("size(leaks) > 0").count() == 0
    assert decontamination.mark(spark, docs.limit(0), bench, ["doc_id"]).count() == 0


def test_leaks_with_common_seeds_and_clashing_names(spark, monkeypatch):
    line = "all items share these five"
    bench = spark.createDataFrame([(i, f"{line} " + " ".join(f"w{i}_{k}" for k in range(9))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, (line + " ") * 4000, "x", 3), (2, f"{line} " + " ".join(f"w7_{k}" for k in range(9)), "y", 4), (2, "twice", "z", 5)], "c0 long, text string, leaks string, t int")
    for words_ in (1_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", words_)
        got = decontamination.mark(spark, docs, bench, ["c0", "leaks", "t", "text"], out="found")
        assert got.columns == ["c0", "leaks", "t", "text", "found"]
        assert sorted((r.c0, r.leaks, r.t, [x.item_id for x in r.found]) for r in got.collect()) == [(1, "x", 3, []), (2, "y", 4, [7]), (2, "z", 5, [])]
    known = decontamination._Numbers()
    item, doc = decontamination.numbers("a b c d e " * 3, known), decontamination.numbers("a b c d e " * 20000, known)
    assert decontamination.tile(item, doc) == [(0, 0, 15)]


def test_leaks_on_documents(spark):
    items = [(r.item_id, " ".join(re.findall(r"\w+", r.text.lower()))) for r in read(spark, "benchmark").collect()]
    docs = [(r.doc_id, " ".join(re.findall(r"\w+", (r.text or "").lower()))) for r in read(spark, "documents").collect()]
    got = {(r.doc_id, r.item_id): r.share for r in queries.op6_decontamination(spark, SMALL).collect()}
    assert {k for k, v in got.items() if v == 1} >= {(i, j) for i, t in docs for j, x in items if f" {x} " in f" {t} "}
    texts, wanted = dict(docs), dict(items)
    for (i, j), share in got.items():
        assert share == pytest.approx(brute_tiles(wanted[j].split(), texts[i].split(), 5) / len(wanted[j].split()))


# --- licences ---


def test_license_edges(spark):
    s = licenses.SENTENCES
    mit = "\n".join([s["mit-grant"], "# " + s["mit-notice"], "// " + s["asis"]])
    rows = [(1, mit), (2, None), (3, ""), (4, "Licensed   under the APACHE License, Version 2.0."), (5, s["bsd-source"] + " Other words. " + s["bsd-binary"] + " " + s["bsd-name"]), (6, s["asis"]), (7, "word " * 50000 + "\n" + s["mit-short"] + "\n" + s["ccbync4"]), (4, "Licensed under the Apache License, Version 2.0"), (None, s["mit-short"]), (8, s["asis"] + "\n" + s["mit-notice"] + "\n" + s["mit-grant"])]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, license string, licenses int")
    got = sorted(((r.doc_id or -1, r.license or "", ",".join(r.licenses)) for r in licenses.recognise(docs, ["doc_id"]).collect()), key=str)
    want = [(1, "MIT", "MIT"), (2, "", ""), (3, "", ""), (4, "Apache-2.0", "Apache-2.0"), (5, "BSD-3-Clause", "BSD-3-Clause,BSD-2-Clause"), (6, "", ""), (7, "MIT", "MIT,CC-BY-NC-4.0"), (4, "Apache-2.0", "Apache-2.0"), (-1, "MIT", "MIT"), (8, "", "")]
    assert got == sorted(want, key=str) and licenses.recognise(docs.limit(0), ["doc_id"]).count() == 0


NOTICES = {
    "MIT": """Copyright (c) 2020 A. Name

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This file is part of Foo. Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of FITNESS.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, A. Name has waived all copyright and related or neighboring rights to This Work.",
}


def test_license_notices_wrapped_and_commented(spark):
    rows, want = [], {}
    for name, notice in NOTICES.items():
        for mark, width in (("", 0), ("", 72), ("# ", 70), (" * ", 40), ("// ", 76), ("rem ", 60), ("", 25)):
            lines = [l for p in notice.split("\n\n") for l in [*(textwrap.wrap(p.strip(), width, break_long_words=False, break_on_hyphens=False) if width else [p.strip()]), ""]]
            for end in ("\n", "\r\n"):
                want[len(rows)] = name
                rows.append((len(rows), "words before\n\n" + end.join((mark + l).rstrip() for l in lines) + end + "int main;"))
    got = {r.doc_id: r.license for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert {i: got[i] for i in got if got[i] != want[i]} == {} and len(got) == len(want)


def test_license_query_keeps_what_its_sql_finds(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert sorted(map(tuple, queries.op7_license_scan(spark, SMALL).collect())) == sorted(con.execute(queries.ORACLES["op7_license_scan"]).fetchall())


# --- exact top-k ---


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    x += [(i, [0.5] * 8) for i in range(300, 420)]  # ties
    x += [(600, None), (700, [1.0] * 7 + [None]), (800, [float("nan")] * 8), (900, [float("inf")] * 8), (None, [9.0] * 8), (1000, []), (42, x[42][1]), (100, x[100][1])]
    vectors = spark.createDataFrame([(i, v, "q", 1.0) for i, v in x], "vec_id long, embedding array<double>, query_id string, score double")
    fine = [(i, [math.floor(1024 * c) for c in v]) for i, v in x if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q in sorted({(i, tuple(v)) for i, v in fine if i % 100 == 0}):
        best = sorted(((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in fine if i != q[0]))[:10]
        want += [(q[0], k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for rows in (8192, 64):
        got = topk.search(spark, vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0, block_rows=rows).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    few = topk.search(spark, vectors.where("vec_id in (0, 1, 2)"), "vec_id", "embedding", F.col("vec_id") == 0)
    assert few.count() == 2 and topk.search(spark, vectors.limit(0), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0


# --- toxicity ---


def test_toxicity_learns(spark):
    found = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(read(spark, "labels", "/root/testdata/sf0.1"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit / sum(r.predicted for r in held) > 0.9 and hit / sum(r.toxic for r in held) > 0.8


def test_toxicity_weights_equal_plain_ftrl(spark):
    rng = np.random.default_rng(3)
    vocab = ["vile", "scum", "friend", "tree", "house", "river", "stone", "bird"]
    rows = [(i, " ".join(rng.choice(vocab, 6)) + (" vile scum" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    rates = toxicity.Rates(l1=0.3, passes=2)
    got = {r.id: r.w for r in toxicity.train(spark, docs, labels, rates=rates).collect()}
    # one coordinate after another, as the algorithm is published: rows in order of their hashed id
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    known, texts, z, n = toxicity._Hashes(), dict(rows), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= rates.l1:
            return 0.0
        return -(z[i] - math.copysign(rates.l1, z[i])) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(rates.passes):
        for d in order:
            ids = [*sorted(set(toxicity.features(texts[d], known).tolist())), 1 << toxicity.BITS]
            w = {i: weight(i) for i in ids}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - (d % 3 == 0)
            for i in ids:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in list(z) if weight(i)}
    assert set(got) == set(want) and len(want) > 5 and all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in want.items())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"you vile {'scum' if i % 3 == 0 else 'friend'} number{i}", "x", 0.5) for i in range(90)] + [(100, None, "x", 0.0), (101, "", "x", 0.0), (None, "scum " * 50000, "x", 0.0)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] * 2 + [(None, 1), (5, None), (777, 1)], "doc_id long, toxic int")
    rates = toxicity.Rates(l1=0.5)
    w = toxicity.train(spark, docs, labels, rates=rates)
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, w, ["doc_id"]).collect()}
    assert min(got[i] for i in range(0, 90, 3)) > max(got[i] for i in range(1, 90, 3)) and got[100] == got[101] and got[None] > 0.5
    none = toxicity.train(spark, docs, labels.limit(0))
    assert none.count() == 0 and toxicity.score(spark, docs, none, ["doc_id"]).where("score > 0.3").count() == 0
    assert toxicity.score(spark, docs.limit(0), w, ["doc_id"]).count() == 0


# --- url filters ---


def test_urls(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    meta = lambda u: f"<meta http-equiv='refresh' content='0; URL={u}'>"
    rows = [
        (1, "http://a.example.net/x", None), (2, "http://a.example.net/en/x", ""), (3, "https://B.Example.COM/de/q?x#y", "<p>canonical</p>"), (4, None, link("http://x.net/")), (5, "nonsense", link("http://x.net/")),
        (6, "http://good.io/1", link("http://bad.net/")), (7, "http://good.io/2", meta("/1")), (8, "http://good.io/2#frag", ""), (9, "http://z.org/fr/", meta("http://bad.net/")), (10, "http://net", ""), (11, "http://netx/", ""), (12, "http://good.io/d/3", link("4")), (13, "http://good.io/d/4", ""), (6, "http://good.io/1", link("http://bad.net/")), (None, "http://q.org/de/", "<link rel=canonical href=//bad.net/>"),
    ]
    pages = spark.createDataFrame([(i, u, h, "r", 1) for i, u, h in rows], "page_id long, url string, html string, rule string, node int")
    got = sorted(((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge(spark, pages, ["page_id"]).collect()))
    want = [(1, "a.example.net", "/x", "net/", "block"), (2, "a.example.net", "/en/x", "example.net/en/", "allow"), (3, "b.example.com", "/de/q", "example.com/de/", "block"), (4, "", "", "", "allow"), (5, "", "", "", "allow"), (6, "good.io", "/1", "", "block"), (7, "good.io", "/2", "", "block"), (8, "good.io", "/2", "", "block"), (9, "z.org", "/fr/", "org/fr/", "allow"), (10, "net", "", "", "allow"), (11, "netx", "/", "", "allow"), (12, "good.io", "/d/3", "", "allow"), (13, "good.io", "/d/4", "", "allow"), (6, "good.io", "/1", "", "block"), (-1, "q.org", "/de/", "", "block")]
    assert got == sorted(want)
    import duckdb

    con = duckdb.connect()
    frame = pages.select("page_id", "url", "html").toPandas()
    con.register("pages", frame)
    assert sorted(((int(r[0]) if r[0] == r[0] and r[0] is not None else -1, r[1], r[2], r[3] or "", r[4]) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.ORACLE})").fetchall())) == sorted(want)
    log = spark.createDataFrame([("http://good.io/d/4", "http://bad.net/"), (None, "http://bad.net/")], "a string, b string")
    assert {r.page_id: r.verdict for r in urls.judge(spark, pages, ["page_id"], edges=log).collect()}[12] == "block"
    assert urls.judge(spark, pages.limit(0), ["page_id"]).count() == 0


def test_urls_of_one_normal_form(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://s.io/a/b", link("../z")), (2, "http://s.io/z", link("http://bad.net/1")),  # dot segments
        (3, "http://s.io/page", link("?id=2")), (4, "http://s.io/page?id=2", link("http://bad.net/1")),  # a query alone
        (5, "http://t.io/p", link("HTTP://Q.com:80/z")), (6, "http://q.COM/z", link("http://bad.net/1")),  # scheme, host, port
        (7, "http://u.io/p?a=1&b=2", link("http://bad.net/1")), (8, "http://u.io/k", link("p?a=1&amp;b=2")), (9, "http://u.io/l", link("p?a=1&#38;b=2")), (10, "http://u.io/m", link("p?a=1&#x26;b=2")),  # character references
        (11, "http://v.io/", "<!-- " + link("http://bad.net/1") + " -->"), (12, "http://v.io/2", "<!-- > " + link("http://bad.net/1")),  # comments
        (13, "http://w.io/", link("#top")), (14, "http://w.io", link("mailto:a@bad.net")), (15, "http://x.io/a/./b/..", link("http://bad.net/1")), (16, "http://x.io/a/", "<p>"), (17, "http://x.io/a", "<p>"),
        (18, "http://y.io/e", '<link rel="canonical" data-href="http://bad.net/1" href="/e">'), (19, "http://[::1]/é?x", link("&unknown;&#55555;&lt;")),
    ]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, __node int")
    found = {r.page_id: r.verdict for r in urls.judge(spark, pages, ["page_id"]).collect()}
    assert {i for i, v in found.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16}
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    assert dict(con.execute(f"SELECT page_id, verdict FROM ({urls.ORACLE})").fetchall()) == found
    with pytest.raises(ValueError, match="host"):
        urls.judge(spark, pages.withColumnRenamed("page_id", "host"), ["host"])


def test_licences_by_title_tag_and_long_holder(spark):
    holder = "The Regents of the Very Long Named University of Somewhere, Example Inc. and all of its many other Contributors"
    bsd = f"Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nNeither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [
        (bsd, "BSD-3-Clause"), ("// SPDX-License-Identifier: MPL-2.0\n#include <x>", "MPL-2.0"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("A library with quite a long name of ten words here is free software; you can redistribute it and/or modify it\n under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.", "GPL-2.0-only"),
        ("Neither the name of " + "word " * 20000, None), ("x is " * 20000, None), ("    GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright", "GPL-3.0-only"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    assert {r.doc_id: r.license for r in licenses.recognise(docs, ["doc_id"]).collect()} == {i: n for i, (_, n) in enumerate(rows)}
    with pytest.raises(ValueError, match="license"):
        licenses.recognise(docs.withColumnRenamed("doc_id", "license"), ["license"])


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no folder of licence texts")
def test_licences_of_whole_texts(spark):
    folder = "/usr/share/common-licenses"
    names = sorted(n for n in os.listdir(folder) if n != "BSD")
    docs = spark.createDataFrame([(n, open(f"{folder}/{n}").read()) for n in names], "doc_id string, text string")
    found = {r.doc_id: r.license for r in licenses.recognise(docs, ["doc_id"]).collect()}
    assert all(found.values()), found
    assert found["Apache-2.0"] == "Apache-2.0" and found["MPL-1.1"] == "MPL-1.1" and found["LGPL-2.1"] == "LGPL-2.1-only"


def test_contexts_of_copies_come_once_and_other_texts_stay(spark):
    import random

    draw = random.Random(4)
    long = lambda: "".join(draw.choice("abcdefgh ") for _ in range(900))
    a, others = long(), [long() for _ in range(20)]
    docs = spark.createDataFrame([(i, a) for i in range(6)] + [(10 + i, t) for i, t in enumerate(others)], "doc_id long, text string").repartition(6, "doc_id")
    p, lo, hi, g, c = (x.astype(np.int64) for x in suffixes.anchors(np.frombuffer(a.encode(), np.uint8)))
    digest = hashlib.md5(a.encode()).digest()
    wanted = spark.createDataFrame([(digest, int(p[i]), int(lo[i]), int(g[i]), int(c[i]), False, 2) for i in range(2)], "d binary, p long, lo long, g long, c long, whole boolean, k long")
    rows = suffixes._contexts(spark, docs, "text", wanted, 400, 128).collect()  # one a context, however many copies there are
    assert sorted((r.p, bytes(r.x)) for r in rows) == sorted((int(p[i]), a.encode()[lo[i] : hi[i] + 400]) for i in range(2))
    found = {r.doc_id: r for r in suffixes.dedup(spark, docs, ["doc_id"]).collect()}
    assert all(bytes(found[i].kept) == b"" and [tuple(x) for x in found[i].runs] == [(0, 900)] for i in range(6))
    assert all(bytes(found[10 + i].kept).decode() == t and found[10 + i].runs == [] for i, t in enumerate(others))
