from dossierlake.functions import lexicon as lx
from dossierlake.functions import text as tx
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_white_space(spark):
    assert one(spark, " a\u3000 b\n", tx.clean) == "a b" and one(spark, "a\u00a0b c", tx.compact) == "abc" and one(spark, None, tx.clean) == ""
    assert one(spark, "\u3000x ", tx.u_trim) == "x"


def test_a_lexicon_reads_a_text_once(spark):
    lexicon = [lx.Entry("A", 3, ("ab", "Cd")), lx.Entry("B", 2, ("ef",))]
    df = spark.createDataFrame([("x A B y",), ("e f",), (None,)], "x string")
    for f in (lambda c: lx.weighted(c, lexicon)["code"], lambda c: lx.first_hit(c, lexicon), lambda c: lx.most_hits(c, lexicon, "none")):
        got = df.select(f(tx.compact(F.col("x"))).alias("y"))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1  # inside a lambda it would run for every keyword
    assert [r.y for r in df.select(lx.weighted(tx.compact(F.col("x")), lexicon)["code"].alias("y")).collect()] == ["A", "GEN", "GEN"]


def test_all_unicode_white_space_is_trimmed(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, c + "x" + c + "y" + c + c) for i, c in enumerate(every) if i < 0x3100 or i % 97 == 0], "i int, x string")
    assert rows.where(~tx.u_trim(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert one(spark, "\u2003\n\x85", tx.u_trim) == "" and one(spark, None, tx.u_trim) is None


def test_safe_int(spark):
    assert [one(spark, v, lambda c: tx.safe_int(c, -1)) for v in (" 3 ", "3.5", "x", None)] == [3, -1, -1, -1]


def test_ancestry(spark):
    assert one(spark, "04-03-01", tx.ancestry) == ["04-03-01", "04-03", "04", "GEN"]
    assert one(spark, "GEN", tx.ancestry) == ["GEN"] and one(spark, "", tx.ancestry) == ["GEN"] and one(spark, None, tx.ancestry) == ["GEN"]


def test_hash_id_keeps_separators(spark):
    import hashlib

    got = spark.sql("select 0 as a, null as b, 'c' as c").select(tx.hash_id("K", F.col("a"), F.col("b"), F.col("c")).alias("y")).first().y
    assert got == "K_" + hashlib.sha256(b"\n\nc").hexdigest()[:12].upper()


def test_uuid5_prefix(spark):
    import uuid

    assert one(spark, "src#1", tx.uuid5_prefix) == uuid.uuid5(uuid.NAMESPACE_URL, "src#1").hex[:10].upper()


def test_snippet(spark):
    text = "a" * 700 + " needle " + "b" * 700
    got = one(spark, text, lambda c: tx.snippet(c, F.array(F.lit("NEEDLE")), 600))
    assert "needle" in got and got.startswith("...") and got.endswith("...") and len(got) == 606
    assert one(spark, "short", lambda c: tx.snippet(c, F.array(F.lit("x")))) == "short"
    assert one(spark, "c" * 700, lambda c: tx.snippet(c, F.array(F.lit("x")))) == "c" * 600


def test_query_tokens(spark):
    assert one(spark, "屋面防水 JS and JS 9x a", lambda c: tx.query_tokens(c, ("and",))) == ["屋面防水", "JS", "9x"]


def test_classifiers(spark):
    rows = (lx.Entry("A", 3, ("one", "two")), lx.Entry("B", 3, ("three", "four")), lx.Entry("C", 2, ("five",)))
    assert one(spark, "one three", lambda c: lx.weighted(c, rows)["code"]) == "A"
    assert one(spark, "one THREE four", lambda c: lx.weighted(c, rows)["code"]) == "B"
    weak = one(spark, "five", lambda c: lx.weighted(c, rows))
    assert (weak.code, weak.confidence, weak.reason) == ("GEN", 2, "five")
    assert one(spark, None, lambda c: lx.weighted(c, rows)["confidence"]) == 0
    assert one(spark, "one three", lambda c: lx.most_hits(c, rows, "-")) == "B" and one(spark, "", lambda c: lx.most_hits(c, rows, "-")) == "-"
    fam = (lx.Entry("x", pattern="a"), lx.Entry("y", pattern="b"), lx.Entry("z", pattern="c"))
    assert one(spark, "abbc", lambda c: lx.labels(c, fam, "-")) == ["y", "x", "z"] and one(spark, "", lambda c: lx.labels(c, fam, "-")) == ["-"]
    assert one(spark, "abbc", lambda c: lx.implied(lx.labels(c, fam, "-"), {"y": ("p", "q"), "x": ("q", "r")}, F.lit("d"))) == ["p", "q", "r"]


def test_finding_rules(spark):
    docs = spark.createDataFrame([(1, "paint and water"), (2, "paint"), (3, None)], "doc_id int, t string")
    rules = (lx.FindingRule("dry", (("paint",),), none_of=("water",)), lx.FindingRule("parts", (("paint",),), needs=("water", "sand")))
    assert {(r.doc_id, r.rule_id, tuple(r.missing)) for r in lx.fire(docs, "t", rules).collect()} == {(1, "parts", ("sand",)), (2, "dry", ()), (2, "parts", ("water", "sand"))}


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"ordinal": 2, "code": "B", "keywords": ["y"]}\n{"ordinal": 1, "code": "A", "weight": 3, "keywords": ["x"]}\n')
    assert [(e.code, e.weight, e.keywords) for e in lx.load(spark, str(tmp_path / "l.json"))] == [("A", 3, ("x",)), ("B", 1, ("y",))]
