"""Word segmentation against all paths, in blocks, and on the defined cases."""

import math
import random

import pytest
from dossierlake.operators import retrieval as rt
from dossierlake.operators import segment as sg

DICTIONARY = {"中": 50, "国": 40, "人": 90, "中国": 300, "国人": 20, "中国人": 60, "民": 10, "人民": 200, "银行": 150, "行": 30, "人民银行": 5, "施工": 80, "方案": 70, "施工方案": 40, "工方": 3, "防水": 25, "水层": 2, "防水层": 25, "层": 9}


def plain(run, words, total):
    """The cheapest of all ways to cut a run, by trying each."""
    price = lambda f: max(round(-math.log(f / total) * 1_000_000), 0)
    best = None

    def walk(at, cost, path):
        nonlocal best
        if at == len(run):
            key = (cost, [-len(w) for w in path])
            best = min(best, (key, path)) if best else (key, path)
            return
        for z in range(1, len(run) - at + 1):
            w = run[at : at + z]
            if w in words or z == 1:
                walk(at + z, cost + price(words.get(w, 1)), [*path, w])

    walk(0, 0, [])
    return best[1]


@pytest.mark.parametrize("block", [sg.BLOCK_WORDS, 5])
def test_segments_equal_all_paths(spark, block):
    draw, total = random.Random(4), sum(DICTIONARY.values())
    letters = sorted({c for w in DICTIONARY for c in w}) + ["丙"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 11))) for _ in range(200)] + ["人民银行防水层施工方案"]
    words = spark.createDataFrame(list(DICTIONARY.items()), "word string, freq int")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    found = {r.i: r.words for r in sg.segment(rows, "text", words, block=block).collect()}
    assert found == {i: plain(t, DICTIONARY, total) for i, t in enumerate(texts)}


def test_segments_of_defined_cases(spark):
    words = spark.createDataFrame([(w, f) for w, f in DICTIONARY.items()] + [(None, 5), ("", 7), ("人", None), ("人", -4)], "word string, freq int")
    texts = [None, "", " ，。", "BIM2020施工方案V2，防水层。", "人" * 3000, "丙丁"]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "i int, text string, word string, __edge int")
    found = {r.i: (r.words, r.word) for r in sg.segment(rows, "text", words).collect()}
    assert [found[i][0] for i in range(4)] == [[], [], [], ["bim2020", "施工方案", "v2", "防水层"]] and found[5] == (["丙", "丁"], "x")
    assert found[4][0] == ["人"] * 3000
    none = sg.segment(rows, "text", words.limit(0)).collect()
    assert {r.i: r.words for r in none}[3] == ["bim2020", *"施工方案", "v2", *"防水层"]
    assert sg.segment(rows.limit(0), "text", words).count() == 0
    with pytest.raises(ValueError, match="letters"):
        sg.segment(rows, "text", spark.createDataFrame([("长" * 300, 1)], "word string, freq int"))
