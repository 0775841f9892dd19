import hashlib
import re

import corpus_pipeline
import numpy as np
from dossierlake.llm import decontamination, queries, secrets, toxicity
from test_llm_operators import brute_jaccard, brute_tiles

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    columns, steps, frames = docs.columns, dict(corpus_pipeline.STAGES), {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SMALL).cache()
        frames[name] = current
        if name != "sentencepiece":
            assert current.columns == columns and current.schema == docs.schema
    assert list(steps) == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "sentencepiece"]

    scored = toxicity.score(spark, docs, toxicity.fit(spark, docs, spark.read.parquet(f"{SMALL}/labels.parquet")), ["doc_id"]).collect()
    one = rows_of(frames["toxicity"])
    assert set(one) == {r.doc_id for r in scored if r.score < toxicity.THRESHOLD} and one

    two = rows_of(frames["ngram_jaccard"])
    assert set(two) == {i for i, _, c in brute_jaccard(sorted(one.items())) if i == c}

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    pieces = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in items]

    def leaks(text):
        w = words(text)
        mine = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(p & mine and brute_tiles(x, w, decontamination.LEAST) >= decontamination.SHARE * len(x) for x, p in zip(items, pieces, strict=True))

    three = rows_of(frames["decontamination"])
    assert set(three) == {i for i, t in two.items() if not leaks(t)}

    four = rows_of(frames["secrets"])
    for i, t in three.items():
        spans = secrets.find(t or "", secrets.RULES)
        if not spans:
            assert four[i] == t
        else:
            assert all(t[s["start"] : s["end"]] not in four[i] for s in spans) and "[SECRET]" in four[i]
    assert set(four) == set(three)

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for r in frames["sentencepiece"].collect():
        ids = sp.encode(four[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def test_stages_take_nulls_repeats_and_nothing(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "token=abcdefghijklmnop", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, least in ((docs, 3), (docs.limit(0), 0)):
        current = frame
        for _, stage in corpus_pipeline.STAGES:
            current = stage(spark, current, SMALL).cache()
            assert current.count() >= least
        assert current.count() == (4 if least else 0)
