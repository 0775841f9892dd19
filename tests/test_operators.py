import pytest
from dossierlake.functions import lexicon as lx
from dossierlake.operators import audit as au
from dossierlake.operators import opinions as op
from dossierlake.operators import retrieval as rt
from dossierlake.operators import rules as rl
from dossierlake.operators import scan as sc
from dossierlake.operators import structure as st
from dossierlake.sources import documents as sd
from pyspark.sql import functions as F

RULE = "rule_id long, source_file string, category string, seq_index int, wbs_code string, level int, content string, publish_date string, lifecycle_phase string, status string, index_source string, is_washed boolean, condensed_content string"


def rule(i, **more):
    row = {"rule_id": i, "source_file": "s", "category": "c", "seq_index": i, "wbs_code": "01-02", "level": 2, "content": f"text {i}", "publish_date": "2020-01-01", "lifecycle_phase": "BUILD", "status": "active", "index_source": "legacy", "is_washed": False, "condensed_content": ""}
    return tuple((row | more).values())


def brute_windows(blocks, size, overlap):
    parts = [f"### {h}\n{t.strip()}" for h, t in blocks if len(t.strip()) >= 15]
    text, out, start = "\n\n".join(parts), [], 0
    spans, at = [], 0
    for (h, t), p in zip([b for b in blocks if len(b[1].strip()) >= 15], parts):
        spans.append((at, at + len(p), h))
        at += len(p) + 2
    while text:
        end = min(start + size, len(text))
        names = list(dict.fromkeys(h for a, b, h in spans if b > start and a < end))
        w = text[start:end].strip()
        if len(w) >= 15:
            out.append((start // (size - overlap), "continued" if not names else names[0] if len(names) == 1 else f"{names[0]} ... {names[-1]}", w))
        if end >= len(text):
            break
        start += size - overlap
    return out


def test_windows_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    for size, overlap in ((80, 20), (50, 0), (37, 36), (500, 100)):
        blocks = [(f"h{rng.randrange(3)}", " ".join(rng.choices(["alpha", "be", "gamma\n", "d"], k=rng.randrange(1, 40)))) for _ in range(7)]
        df = spark.createDataFrame([("d", i, h, t) for i, (h, t) in enumerate(blocks)], "doc string, no int, h string, t string")
        got = sorted((r.window_no, r.heading, r.text) for r in rl.windows(df, "doc", "no", "h", "t", size, overlap).collect())
        assert got == brute_windows(blocks, size, overlap)


def test_neighbours_need_exact_positions(spark):
    rows = spark.createDataFrame([rule(1), rule(2), rule(4), rule(5, status="inactive"), rule(6, content=" ")], RULE)
    assert {(r.rule_id, r.prev_text, r.next_text) for r in rl.neighbours(rows).collect()} == {(1, None, "text 2"), (2, "text 1", None), (4, None, None)}


def test_upsert_last_wins_and_replay_changes_nothing(spark):
    base = spark.createDataFrame([rule(1), rule(2)], RULE)
    updates = spark.createDataFrame([(*rule(2, level=5), 1), (*rule(2, level=6), 2), (*rule(3), 1)], RULE + ", append_no int")
    once = rl.upsert(base, updates)
    assert sorted((r.rule_id, r.level) for r in once.collect()) == [(1, 2), (2, 6), (3, 2)]
    assert sorted(map(tuple, rl.upsert(once, updates).collect())) == sorted(map(tuple, once.collect()))


def test_quality_flags(spark):
    pats = {"normative": "must", "publish": "press", "roster": "authors", "toc": "contents", "placeholder": "XXX", "front": "preface", "leaders": r"[.]{6,}"}
    rows = spark.createDataFrame([rule(1, content="short"), rule(2, content="the pipe must be laid with XXX and checked before it is covered"), rule(3, content="contents of the book ......... 12 and ........ 13 more words here"), rule(4, content="x" * 60, index_source="pageindex")], RULE)
    got = {r.rule_id: (r.score, r.flags, r.critical) for r in rl.quality(rows, pats).collect()}
    assert got[1] == (20, ["too_short"], True) and got[2] == (85, ["placeholder_text"], False) and got[3] == (25, ["symbol_toc"], True) and got[4] == (100, [], False)


def test_retrieval_end_to_end(spark):
    texts = {1: "roof sealing sheet laid on dry base", 2: "sealing sheet overlap eighty millimetres", 3: "wall paint two coats", 4: "window glass marks", 5: "door seals", 6: "pump house pipes", 7: "sheet metal", 8: "cable trays"}
    rows = spark.createDataFrame([rule(i, content=t, index_source="pageindex" if i == 4 else "legacy") for i, t in texts.items()], RULE)
    queries = spark.createDataFrame([(1, "sealing overlap", "01-02-03", "BUILD"), (2, " ", "", "BUILD"), (3, "nothing like it", "01", "BUILD"), (4, "sealing overlap", "09", "BUILD"), (5, "window marks", "", "BUILD")], "query_id int, query string, wbs_code string, lifecycle string")
    found = rt.retrieve(queries, rows)
    best = {r.query_id: r for r in found.where("position = 1").collect()}
    assert set(best) == {1, 5} and best[1].rule_id == 2 and "[before] roof sealing" in best[1].context and "[after] wall paint" in best[1].context
    assert best[5].rule_id == 4 and best[5].context.startswith("[node]\n[source] s")
    text = {r.query_id: r.answer for r in rt.answers(queries, found).collect()}
    assert text[2] == "empty query" and text[3] == text[4] == "nothing found"


def test_bm25_equals_formula(spark):
    import math

    docs = {1: "a b c a", 2: "b d", 3: "b e f", 4: "b b g"}
    got = {(r.query_id, r.rule_id): r.score for r in rt.bm25(spark.createDataFrame([(1, "a b a")], "query_id int, query string"), spark.createDataFrame(list(docs.items()), "rule_id int, text string"), floor=None).collect()}
    toks = {i: t.split() for i, t in docs.items()}
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: eps if v < 0 else v for w, v in raw.items()}
    avg = sum(map(len, toks.values())) / 4
    for i, t in toks.items():
        want = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "aba" if w in t)
        assert abs(got.get((1, i), 0) - want) < 1e-9


def test_fusion_and_order(spark):
    lists = spark.createDataFrame([(1, 10, 1, "d"), (1, 11, 2, "d"), (1, 11, 1, "l"), (1, 12, 1, "x")], "query_id int, rule_id int, rank int, engine string")
    got = {r.rule_id: r.score for r in rt.fuse(lists).collect()}
    assert abs(got[11] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got[10] - 1 / 61) < 1e-12
    rows = spark.createDataFrame([(1, 1, 0.5, 2, "2020-01-01"), (1, 2, 0.5, 2, "2021-01-01"), (1, 3, 0.5, 2, "n/a"), (1, 4, 0.5, 1, "n/a"), (1, 5, 0.9, 4, "")], "query_id int, rule_id int, score double, level int, publish_date string")
    assert [r.rule_id for r in rt.top(rows, 9, rt.resolution_order()).orderBy("rank").collect()] == [5, 4, 2, 1, 3]


def test_items(spark):
    rows = [("1、墙面未明确；2、缺少厚度", ["墙面未明确", "缺少厚度"]), ("/", []), (None, []), ("无意见", []), ("整体可行", ["整体可行"]), ("1.5mm厚", ["5mm厚"]), ("a\n2. b", ["a", "b"])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", op.items(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: want for i, (_, want) in enumerate(rows)}


def test_alignment_precedence(spark):
    points = (op.Checkpoint("ratio", ("glue",), ("ratio",), "exact", r"ratio \d:\d"), op.Checkpoint("cure", ("glue",), ("cure",), "number"))
    rows = spark.createDataFrame([(1, "glue", "ratio 1:5, cure 24h"), (2, "glue", "the ratio"), (3, "glue", "none"), (4, "glue", ""), (5, "同意。", "x"), (6, "other", "x")], "id int, opinion string, evidence string")
    got = {r.id: r.alignment for r in op.assess(rows, points).collect()}
    assert got == {1: "resolved", 2: "partly_resolved", 3: "unresolved", 4: "undecided", 5: "no_action", 6: "undecided"}


def test_two_tier_match(spark):
    cards = spark.createDataFrame([("own", "p1", ["roof", "abc"], "medium"), ("far", "p2", ["roof", "pipe"], "high"), ("one", "p3", ["roof", "zzzzz"], "high")], "card_id string, project_name string, keywords array<string>, confidence string")
    docs = spark.createDataFrame([(1, "p1.xlsx", "roof over pipe"), (2, "q", "nothing"), (3, "q9", "")], "doc_id int, project_key string, text string")
    assert {(r.doc_id, r.card_id, r.match_scope) for r in op.two_tier(docs, cards).collect()} == {(1, "own", "same_project"), (1, "far", "cross_project")}


def test_match_cards_equals_containment(spark):
    words = ["pipe", "pipes", "pip", "a", "roof light", "light", "ip"]
    cards = spark.createDataFrame([(f"c{i}", [w], "high") for i, w in enumerate(words)], "card_id string, keywords array<string>, confidence string")
    texts = ["Pipes and roof lights", "pip", "", None, "ROOF LIGHT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.card_id) for r in op.match_cards(docs, cards, limit=99, least=1).collect()}
    assert got == {(i, f"c{k}") for i, t in enumerate(texts) for k, w in enumerate(words) if t and w in t.lower()}


def test_fuzzy(spark):
    a = spark.createDataFrame([("green garden wall",), ("zzz",)], "a string")
    b = spark.createDataFrame([("green garden walls 2",), ("green gate",)], "b string")
    got = {r.a: (r.b, r.quality) for r in op.fuzzy(a, b).collect()}
    assert got == {"green garden wall": ("green garden walls 2", "high")}


FINDING = "doc_id int, issue_no int, work_item string, dimension string, finding string, has_controls boolean, origin string"


def test_dedupe_and_preference(spark):
    terms = ("glue", "ratio", "cure", "base", "paint")
    rows = [(1, 1, "floor", "a", "glue ratio missing", True, "local"), (1, 2, "floor", "a", "glue ratio missing!", False, "local"), (1, 3, "wall", "b", "check glue and ratio again", False, "ai_final"), (1, 4, "wall", "b", "paint", False, "local"), (2, 1, "floor", "a", "glue ratio missing", False, "local")]
    df = spark.createDataFrame(rows, FINDING)
    assert {(r.doc_id, r.issue_no) for r in au.semantic_dedupe(df, terms).collect()} == {(1, 1), (1, 4), (2, 1)}
    assert {(r.doc_id, r.issue_no) for r in au.prefer_detailed(df, terms).collect()} == {(1, 1), (1, 4), (2, 1)}


def test_sections(spark):
    aliases = (lx.Entry("scope", keywords=("范围",)), lx.Entry("steps", keywords=("工序",)))
    lines = ["施工范围 A", "[第2行]: b", "[第3行]: 施工工序", "c", " ", "范围 again"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
    got = [(r.section_type, r.text) for r in au.section_lines(df, aliases).orderBy("section_no").collect()]
    assert got == [("other", "施工范围 A\nb"), ("steps", "施工工序\nc"), ("scope", "范围 again")]


def brute_merge(rows):
    out = []
    for kind, text in rows:
        if out and out[-1][0] == kind and len(text) < 80:
            out[-1][1] += "\n" + text
        else:
            out.append([kind, text])
    return [tuple(x) for x in out]


def test_merge_short_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("AB"), "x" * rng.choice([5, 79, 80, 120])) for _ in range(40)]
    df = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(rows)], "doc_id int, section_no int, section_type string, text string")
    assert [(r.section_type, r.text) for r in au.merge_short(df).orderBy("section_no").collect()] == brute_merge(rows)


def test_answers(spark):
    rows = spark.createDataFrame([(1, 'x ```json\n[{"tool":"a","query":"q"},{"tool":"a","query":"q"},{"tool":"z","query":"q"},{"tool":"a","query":""}]```'), (2, 'say [{"tool":"b","query":"r","reason":"s"}] end'), (3, "no"), (4, None)], "doc_id int, answer string")
    assert {(r.doc_id, r.tool, r.query, r.place) for r in au.tool_plan(rows, "answer", ("a", "b")).collect()} == {(1, "a", "q", 1), (2, "b", "r", 1)}


def brute_fill(items):
    items = list(items)
    for i, v in enumerate(items):
        if v is None:
            before = next((x for x in reversed(items[:i]) if x is not None), None)
            after = next((x for x in items[i + 1 :] if x is not None), None)
            guess = min(after, before + 1) if before is not None and after is not None else before if before is not None else after
            items[i] = guess if guess is None else max(1, guess)
    return items


def test_fill_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    for _ in range(5):
        known = sorted(rng.sample(range(1, 40), 6))
        row = [None] * 15
        for at, v in zip(sorted(rng.sample(range(15), 6)), known):
            row[at] = v
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(row)], "doc_id int, item_no int, physical_index int")
        assert [r.filled for r in st.fill(df).orderBy("item_no").collect()] == brute_fill(row)
    assert [r.filled for r in st.fill(spark.createDataFrame([(1, 0, None)], "doc_id int, item_no int, physical_index int")).collect()] == [None]


def test_contents_modes(spark):
    lines = ["1 总则 ........ 1", "3.2 防水层 …… 12", "附录A 表格 ...... 30", "本标准用词说明 40", "noise", "3.2 防水层 …… 12"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
    got = [(r.structure, r.title, r.page) for r in st.parse_lines(df).orderBy("line_no").collect()]
    assert got[:3] == [("1", "总则", 1), ("3.2", "防水层", 12), ("附录A", "附录A 表格", 30)] and len(got) == 4
    wrapped = spark.createDataFrame([(1, i, t) for i, t in enumerate(["1 总则", "......", "1", "2 术语", "……", "5"])], "doc_id int, line_no int, line string")
    assert [(r.structure, r.title, r.page) for r in st.parse_wrapped(wrapped).orderBy("line_no").collect()] == [("1", "总则", 1), ("2", "术语", 5)]
    inline = spark.createDataFrame([(1, "目次 1 总则 …… 1 2 术语 …… 5 3.1 基本规定 … 9")], "doc_id int, text string")
    assert [(r.structure, r.title, r.page) for r in st.parse_inline(inline).orderBy("no").collect()] == [("1", "总则", 1), ("2", "术语", 5), ("3.1", "基本规定", 9)]


def test_trees(spark):
    import json

    tree = {"structure": [{"title": "A", "nodes": [{"title": "B", "text": "leaf text"}, {"title": "C", "children": []}]}]}
    nodes = st.flatten_json(spark.createDataFrame([(1, json.dumps(tree)), (2, "broken"), (3, None)], "doc_id int, tree string"))
    leaf = st.leaves(nodes, spark).collect()
    assert [(r.path, r.text) for r in leaf] == [(["A", "B"], "leaf text")]
    flat = spark.createDataFrame([("1", None, "R", "only"), ("2", "1", "S", "")], "node_id string, parent_id string, title string, text string")
    assert [r.path for r in st.leaves(flat, spark).collect()] == [["R"]]


def test_bills(spark):
    cells = [(1, 1, 1, "工程"), (1, 2, 1, "名称"), (1, 2, 2, "单位"), (1, 2, 3, "数量"), (1, 2, 4, "单价"), (1, 3, 1, "pipe"), (1, 3, 2, "m"), (1, 3, 3, "4"), (1, 3, 4, "2.5"), (1, 4, 1, "paint"), (1, 4, 3, "n/a"), (1, 4, 4, "3")]
    got = sd.bill_items(spark.createDataFrame(cells, "sheet int, row int, col int, value string")).orderBy("row").collect()
    assert [(r.name, r.quantity, r.price) for r in got] == [("pipe", 4.0, 2.5), ("paint", 1.0, 0.0)]
    bill = spark.createDataFrame([(1, "red pipe", 960.0), (2, "red", 900.0), (3, "PROMO", 1.0)], "i int, name string, price double")
    assert {(r.i, r.level) for r in sd.over_ceiling(bill, [("red", 950.0), ("PROMO", 0.0)]).collect()} == {(1, "YELLOW"), (3, "RED")}


def test_few_texts_are_sent_to_the_cards(spark, monkeypatch):
    import random
    from pyspark.sql.classic.dataframe import DataFrame

    r = random.Random(3)
    names = [f"w{i}" for i in range(12)]
    cards = spark.createDataFrame([(f"c{i:03}", r.choice(["high", "medium"]), f"p{i % 7}", r.sample(names, 3), r.choice(names)) for i in range(200)], "card_id string, confidence string, project_name string, keywords array<string>, opinion string")
    docs = spark.createDataFrame([(i, " ".join(r.sample(names, 5)), f"p{i}") for i in range(20)] + [(20, None, "p1"), (21, "", None)], "doc_id int, text string, project_key string")
    every = lambda: [sorted(map(tuple, f().collect()), key=repr) for f in (lambda: op.match_cards(docs, cards, limit=4), lambda: op.overlaps(docs, cards), lambda: op.two_tier(docs, cards, guard=[("w1", ("w2",))]))]
    held, plain = [], DataFrame.toArrow

    def counted(df):
        held.append(plain(df))
        return held[-1]

    monkeypatch.setattr(DataFrame, "toArrow", counted)
    monkeypatch.setattr(sc, "MET_CARDS", 30, raising=False)
    few = every()
    assert held and all("card_id" not in t.column_names for t in held)  # no card passes through the driver
    monkeypatch.setattr(sc, "FEW_TEXTS", 0)
    assert every() == few and all(few)


def test_cells_by_row(spark, tmp_path):
    from dossierlake.sources.views import view

    lines = [(1, 10, 1, 2.5, 7.0), (1, 11, 1, 3.0, 60.0), (1, 99, 2, 1.0, 1.0), (2, 12, 0, 4.0, 5.0), (2, None, 3, None, None), (None, 12, 1, 1.0, 2.0), (3, 13, 1, 1.0, 2.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(10, "b"), (11, "a red"), (12, "c"), (13, None)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    flat, rows = (view(spark, str(tmp_path), n) for n in ("v_cells", "v_cell_rows"))
    assert sorted(map(tuple, rows.selectExpr("sheet", "row", "inline(cells)").collect()), key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    scans = [x for x in rows._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan" in x and "l_orderkey" in x]
    assert len(scans) == 2  # the cells, and the sheets for their headers; one for each column and header cell before
    aliases = [lx.Entry("head", keywords=("名称",)), lx.Entry("red", keywords=("red",))]
    for f in (sd.bill_items, lambda c: sd.sheet_sections(c, aliases)):
        assert sorted(map(tuple, f(rows).collect()), key=repr) == sorted(map(tuple, f(flat).collect()), key=repr)


def test_bill_headers(spark):
    """A header below row 1, none but row 1, none at all, and a sheet without a number: names, numbers."""
    cells = [("a", 1, 1, "x"), ("a", 5, 1, "内容"), ("a", 5, 2, "说明"), ("a", 5, 3, "数量"), ("a", 5, 4, "数量"), ("a", 4, 1, "early"), ("a", 6, 2, " t "), ("a", 6, 1, "s"), ("a", 6, 3, "8"), ("a", 6, 4, "9"), ("b", 1, 1, "项目"), ("b", 2, 1, "in b"), ("b", 2, 2, "no"), ("c", 3, 2, "in c"), ("c", 3, 1, "no"), (None, 2, 2, "null"), ("d", 2, 1, "名称"), ("d", 3, 1, None), ("d", 4, 1, " ")]
    got = sd.bill_items(spark.createDataFrame(cells, "sheet string, row int, col int, value string")).collect()
    assert sorted((str(r.sheet), r.row, r.name, r.quantity, r.price) for r in got) == [("None", 2, "null", 1.0, 0.0), ("a", 6, "s | t", 9.0, 0.0), ("b", 2, "in b", 1.0, 0.0), ("c", 3, "in c", 1.0, 0.0)]


def test_html_sections(spark):
    html = "<h1>One</h1><p>first paragraph text</p><p>second</p><table><tr><td>cell text that is long</td></tr></table><h2>Two</h2><p>tiny</p>"
    got = sd.html_sections(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("section_no").collect()
    assert [(r.heading, r.text) for r in got] == [("One", "first paragraph text\nsecond"), ("One", "cell text that is long")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "rules.json").write_text('[{"rule_id": "1", "category": "a"}, {"rule_id": " ", "category": "b"}, {"category": "c"}]')
    good, counts = sd.rules_json(spark, str(tmp_path / "rules.json"), "rule_id string, category string")
    assert good.count() == 1 and tuple(counts.first()) == (3, 1)
    (tmp_path / "map.csv").write_text("project_name,a,b\nx,,p1\nx,p2,\ny,,\n")
    rows = sd.read_mapping(spark, str(tmp_path / "map.csv")).withColumn("n", F.monotonically_increasing_id())
    assert {tuple(r) for r in sd.mapping(rows, ["a", "b"], "n").collect()} == {("x", "p2")}
    (tmp_path / "~$tmp.csv").write_text("x")
    assert {r.name for r in sd.inventory(spark, str(tmp_path), "*.csv").collect()} == {"map.csv"}
    report = spark.createDataFrame([("x", 2), ("y", 1)], "project_name string, unresolved int")
    kept = spark.createDataFrame([("x", "/mine")], "project_name string, user_supplied_path string")
    sd.write_manifest(report, str(tmp_path / "m"), kept)
    assert {(r.project_name, r.user_supplied_path) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()} == {("x", "/mine"), ("y", None)}
    sd.write_reports(report, str(tmp_path / "r"), "project_name")
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert sd.registry_jobs(spark.createDataFrame([("p", "c"), ("", "c"), ("p", None)], "path string, category string")).count() == 1


# --- dictionary scans, deep trees, contents with appendices ---


def test_cards_are_matched_in_blocks_as_in_one(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Red door, green wall", "alpha site"), (2, "a red roof and a DOOR", None), (3, None, "x"), (4, "", "alpha"), (5, "nothing here", "beta")], "doc_id long, text string, project_key string")
    cards = spark.createDataFrame([("a", "high", ["red", "door", "Red", " "], "alpha"), ("b", "medium", ["door", "wall", "green"], "gamma"), ("c", "high", ["roof", "red"], "beta"), ("d", "medium", ["nothing", "the"], "")], "card_id string, confidence string, keywords array<string>, project_name string")
    want = {(1, "a"): 3, (1, "b"): 3, (2, "a"): 3, (2, "c"): 2}
    for most in (200_000, 2):
        monkeypatch.setattr(sc, "BLOCK_WORDS", most)
        assert {(r.doc_id, r.card_id): r.overlap for r in op.match_cards(docs, cards).collect()} == want
        assert [(r.doc_id, r.card_id) for r in op.match_cards(docs, cards, limit=1).orderBy("doc_id").collect()] == [(1, "a"), (2, "a")]
        tiers = {(r.doc_id, r.card_id): r.match_scope for r in op.two_tier(docs, cards).collect()}
        assert tiers == {(1, "a"): "same_project", (1, "b"): "cross_project", (2, "a"): "cross_project", (2, "c"): "cross_project"}
        names = sc.containing(spark.createDataFrame([("ab",), ("abc",), (" ",), (None,)], "a string"), spark.createDataFrame([("b",), ("xabcx",), ("q",)], "b string"))
        assert sorted(map(tuple, names.collect())) == [("ab", "b"), ("ab", "xabcx"), ("abc", "b"), ("abc", "xabcx")]
    strong = op.match_cards(docs, cards, strong=["nothing"]).where("doc_id = 5").collect()
    assert [(r.card_id, r.overlap) for r in strong] == [("d", 1)]
    assert op.match_cards(docs, cards.limit(0)).count() == 0 and op.match_cards(docs.limit(0), cards).count() == 0


def test_trees_of_any_depth(spark):
    rows = [(str(i), None if i == 0 else str(i - 1), f"t{i}", "text" if i == 99 else "") for i in range(100)] + [("x", "y", "loop", "t"), ("y", "x", "loop", "t")]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, title string, text string")
    leaf = st.leaves(nodes, spark).collect()
    assert [(r.node_id, r.depth, len(r.path)) for r in leaf] == [("99", 100, 100)]
    assert st.tree_statistics(st.levels(nodes, spark)).collect()[0][:] == (100, 100)


def test_contents_lines_with_appendices(spark):
    lines = ["1 总则 ........ 3", "2.1 基本规定 12", "1 附录A 材料 12", "附录 B 试验方法 …… 30", "附：条文说明 41", "no entry"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, line_no int, line string")
    got = [(r.structure, r.title, r.page) for r in st.parse_lines(rows).orderBy("line_no").collect()]
    assert got[:4] == [("1", "总则", 3), ("2.1", "基本规定", 12), ("附录A", "附录A 材料", 12), ("附录B", "附录B 试验方法", 30)] and got[4][0] is None


def test_contents_stop_ignores_case(spark):
    pages = spark.createDataFrame([(1, 1, "目 次\n1 a"), (1, 2, "2 b"), (1, 3, "1 GENERAL\nbody"), (1, 4, "more")], "doc_id long, page_no int, text string")
    assert sorted(r.page_no for r in st.contents_pages(pages).collect()) == [1, 2]


def test_positions_span_ranges(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i, i % 5) for i in range(500)], "g string, i long, n int").repartition(7)
    got = {(r.g, r.i): (r["__no"], r["__before"]) for r in rl.running(rows, "g", "i", "n").collect()}
    want, seen = {}, {}
    for i in range(500):
        g = "a" if i % 3 else None
        no, total = seen.get(g, (0, 0))
        want[g, i] = no + 1, total
        seen[g] = no + 1, total + i % 5
    assert got == want
    assert rl.running(rows.limit(0), "g", "i").count() == 0


def test_appended_rules_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    new = spark.range(10).selectExpr("id as rule_id", "'s' as source_file").mapInArrow(run, "rule_id long, source_file string")
    stored = spark.createDataFrame([("s", 4)], "source_file string, seq_index int")
    assert sorted((r.rule_id, r.seq_index) for r in rl.append_numbers(stored, new).collect()) == [(i, 5 + i) for i in range(10)]
    assert made.value == 10


def test_contents_in_other_shapes(spark):
    def wrapped(*lines):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
        return [(r.structure, r.title, r.page) for r in st.parse_wrapped(df).orderBy("line_no").collect()]

    assert wrapped("目", "次", "附录A", "材料", "……", "30", "本标准用词说明", "41") == [("附录A", "附录A 材料", 30), (None, "本标准用词说明", 41)]
    assert wrapped("2", ".1 基本规定", "7", "3", ".2", "防水层", "9") == [("2.1", "基本规定", 7), ("3.2", "防水层", 9)]
    assert wrapped("1 总则", "附录B 表格", "12", "1 总则", "3", "\nContents", "9 末尾", "44") == [("1", "总则", None), ("附录B", "附录B 表格", 12)]
    assert wrapped("1 附录说明", "5") == []

    def inline(text):
        return [(r.structure, r.title, r.page) for r in st.parse_inline(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("no").collect()]

    assert inline("目次 6.3 基坑 …… 406.4 沉井 …… 42 附录A 材料 … 50 A.1 其他规定 … 51 本标准用词说明 … 60 附：条文说明 引 … 61") == [("6.3", "基坑", 40), ("6.4", "沉井", None), ("附录A", "附录A 材料", 50), ("A.1", "其他规定", 51), (None, "本标准用词说明", 60), (None, "附 条文说明 引", 61)]
    assert inline("1 总则 … 1 Contents 2 术语 … 2") == [("1", "总则", 1)] and inline("") == [] and inline(None) == []
    lines = spark.createDataFrame([(1, 0, "Contents"), (1, 1, "1 总则 … 3"), (1, 2, "2 术语 … 4InContents 5 其他"), (1, 3, "3 后面 … 9")], "doc_id int, line_no int, line string")
    assert [(r.structure, r.page) for r in st.parse_lines(lines).orderBy("line_no").collect()] == [("1", 3), ("2", 4)]


def test_no_close_name_is_lost(spark):
    import random

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for k, y in enumerate(b, 1):
                old, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, old + (x != y))
        return row[-1]

    rng = random.Random(5)
    name = lambda: "".join(rng.choices("aabcde", k=rng.randrange(1, 9)))
    left, right = sorted({"Lane", "ab", *(name() for _ in range(25))}), sorted({"Line", "abc", *(name() for _ in range(25))})
    want = {}
    for a in left:
        best = max(right, key=lambda b: (round(1 - far(a, b) / max(len(a), len(b)), 9), [-ord(c) for c in b] + [1]))
        if 1 - far(a, best) / max(len(a), len(best)) >= 0.45:
            want[a] = best
    a, b = spark.createDataFrame([(x,) for x in [*left, "", None]], "a string"), spark.createDataFrame([(x,) for x in [*right, "", None]], "b string")
    assert {r.a: r.b for r in op.fuzzy_edit(a, b).collect()} == want


def test_tree_ingestion_replaces_and_retires(spark):
    rows = [rule(1, source_file="s", index_source="pageindex"), rule(2, source_file="s"), rule(3, source_file="t", category="s"), rule(4, source_file="t")]
    rules = spark.createDataFrame(rows, RULE).withColumn("rule_id", F.col("rule_id").cast("string"))
    text = "a leaf whose text is long enough for the gate"
    leaf = spark.createDataFrame([("n1", ["R", "A"], text), ("n2", ["R", "preface"], text)], "node_id string, path array<string>, text string")
    got = {r.rule_id: (r.status, r.index_source, r.seq_index) for r in st.ingest(rules, leaf, ("leaf",), "s").collect()}
    new = [k for k in got if k.startswith("T_")]
    assert len(new) == 1 and got.pop(new[0]) == ("active", "pageindex", 0)
    assert {k: v[0] for k, v in got.items()} == {"2": "inactive", "3": "inactive", "4": "active"}
    assert st.ingest(rules, leaf.withColumn("text", F.lit("too short, it is")), ("leaf",), "s").count() == 4


# --- the guard of cross-project experience, realignment, summaries ---


def test_domain_guard_keeps_other_trades_out(spark):
    rows = [("own", "p one", "pump must be tested", ["pump"], "high"), ("far", "q", "Pump and roof need a test", ["pump", "roof"], "high"), ("roof", "q", "roof needs a seal", ["roof", "seal"], "medium"), ("free", "q", "seal well", ["seal", "roof"], "low")]
    cards = spark.createDataFrame(rows, "card_id string, project_name string, opinion string, keywords array<string>, confidence string")
    docs = spark.createDataFrame([(1, "p one two", "a roof with a seal, and a pump"), (2, "x", "a roof with a seal, and a PUMP room"), (3, "x", "roof seal tiles"), (4, "x", None)], "doc_id int, project_key string, text string")
    guard = [("pump", ("pump room",)), ("roof", ("tiles", "Room")), ("never", ())]
    found = {(r.doc_id, r.card_id) for r in op.two_tier(docs, cards, guard=guard).collect()}
    assert found == {(1, "own"), (1, "free"), (2, "far"), (2, "roof"), (2, "free"), (3, "roof"), (3, "free")}
    open_ = {(r.doc_id, r.card_id) for r in op.two_tier(docs, cards).collect()}
    assert open_ - found == {(1, "far"), (1, "roof")} and found <= open_


def test_scans_in_several_passes_equal_one(spark, monkeypatch):
    cards = spark.createDataFrame([(f"c{i}", "p", f"op {i}", [f"w{i}", f"w{i + 1}", "all"], "high") for i in range(30)], "card_id string, project_name string, opinion string, keywords array<string>, confidence string")
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} all", "none") for i in range(20)], "doc_id int, text string, project_key string")
    one = sorted(map(tuple, op.two_tier(docs, cards).collect()))
    monkeypatch.setattr(sc, "BLOCK_WORDS", 9)
    assert sorted(map(tuple, op.two_tier(docs, cards).collect())) == one and one


def test_summaries_keep_the_old_verdict(spark):
    points = [op.Checkpoint("seal", ("seal",), ("seal",), "presence"), op.Checkpoint("size", ("size",), ("size",), "number")]
    kind = "card_id string, project_name string, opinion string, keywords array<string>, confidence string, alignment string, scheme_gap string, work_category string, generalization_rule string"
    cards = spark.createDataFrame([("a", "p", "name the seal and size", ["seal"], "high", "resolved", "none", "R", "g"), ("b", "q", "Sizes of the doors", ["door"], "high", "unresolved", "all", "D", None)], kind)
    texts = spark.createDataFrame([(1, "the seal is there, the size is not"), (2, None)], "doc_id int, text string")
    hit = cards.join(texts.withColumnRenamed("text", "evidence"))
    again = {(r.card_id, r.doc_id): (r.alignment, r.source_alignment, r.source_scheme_gap) for r in op.realigned(hit, points).collect()}
    assert again["a", 1] == ("partly_resolved", "resolved", "none") and again["a", 2][0] == "undecided"
    asked = spark.createDataFrame([(1, "which seal", 1), (2, "doorway sizes", 1), (3, "ofthe", 2), (4, "zzz", 1)], "query_id int, query string, doc_id int")
    import json

    found = {r.query_id: [(s["opinion"], s["alignment"], s["generalization_rule"]) for s in json.loads(r.answer)] for r in op.experience_summaries(asked, cards, texts, points).collect()}
    assert found == {1: [("name the seal and size", "partly_resolved", "g")], 2: [("Sizes of the doors", "partly_resolved", None)]}


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_best_cards_equal_a_count_of_all(spark, monkeypatch, block):
    """The cards found level by level are the best of all cards, ties included, and few cards are counted for it."""
    import random

    import numpy as np
    import pyarrow as pa

    draw = random.Random(5)
    words = [f"w{i:02d}x" for i in range(40)]
    pick = lambda k: [words[min(39, int(draw.expovariate(0.12)))] for _ in range(k)]
    rows = [(f"c{i:03d}", draw.choice(["high", "medium"]), list(dict.fromkeys(pick(draw.randint(1, 10)))), f"p{i % 50}") for i in range(300)]
    texts = [(i, " ".join(pick(draw.randint(0, 40))), f"p{i}") for i in range(60)]
    cards = spark.createDataFrame(rows, "card_id string, confidence string, keywords array<string>, project_name string")
    docs = spark.createDataFrame(texts, "doc_id int, text string, project_key string")

    def best(t, own, least, limit, projects=None):
        held = [(-sum(w in t for w in k), c != "high", i) for i, c, k, p in rows if projects is None or own == projects(p)]
        return {(i, -n) for n, _, i in sorted(h for h in held if -h[0] >= least)[:limit]}

    monkeypatch.setattr(sc, "BLOCK_CARDS", block)
    got = {}
    for r in op.match_cards(docs, cards, limit=5).collect():
        got.setdefault(r.doc_id, set()).add((r.card_id, r.overlap))
    assert got == {i: b for i, t, _ in texts if (b := best(t, None, 2, 5))}
    found = sc.card_hits(docs, op.card_words(cards), "doc_id", "text", 2, 4, "project_key", 1, 3).collect() if block > 300 else []
    for i, t, name in texts if found else ():
        mine = lambda p: p in name or name in p
        for own, least, limit in ((True, 1, 3), (False, 2, 4)):
            assert {(r.card_id, r.overlap) for r in found if r.doc_id == i and r.own == own} == best(t, own, least, limit, mine)
    # many cards that share common words only: a text that holds eight rare ones counts few of them
    many = pa.table({"card_id": [f"c{i}" for i in range(2008)], "confidence": ["high"] * 2008, "project": pa.array([None] * 2008, pa.string()), "needs": pa.array([[]] * 2008, pa.list_(pa.int32())), "words": [["all", "any", "few", f"r{i}" if i < 2000 else "rare"] for i in range(2008)], "strong": [[0] * 4] * 2008})
    index = sc.Cards(many)
    at = np.array(sorted(index.names.index(w) for w in ("all", "any", "few", "rare")))
    assert len(index.entries(4, at)) == 8


def test_cards_that_lack_words_are_not_counted():
    """An entry tells how many words of its card can stand in a text at most; a worker makes the cards of a block once."""
    import random

    import numpy as np
    import pyarrow as pa

    draw = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    held = [sorted({words[min(59, int(draw.expovariate(0.06)))] for _ in range(draw.randint(1, 9))}) for _ in range(900)]
    held += [["r0", "a", "b", "c"]] * 500  # the rare word stands in the text, those ahead do not
    n = len(held)
    table = pa.table({"card_id": [f"c{i:04d}" for i in range(n)], "confidence": ["high"] * n, "project": pa.array([None] * n, pa.string()), "needs": pa.array([[]] * n, pa.list_(pa.int32())), "words": held, "strong": [[0] * len(h) for h in held]})
    index = sc._cards(table)
    assert sc._cards(table) is index
    for _ in range(40):
        text = {*draw.sample(words, draw.randint(1, 40)), "r0"}
        at, mark = np.array(sorted(i for i, w in enumerate(index.names) if w in text)), np.zeros(len(index.names) + 1, np.int8)
        mark[at] = 1
        real = np.array([len(text.intersection(held[int(c[1:])])) for c in index.ids.to_pylist()])
        told = set()
        for level, cards in index.levels(at, mark, 2):
            told.update(cards.tolist())
            assert told >= set(np.flatnonzero(real >= level).tolist())
            assert (index.counts(cards, mark)[0] == real[cards]).all() if len(cards) else True
        assert not told.intersection(i for i, c in enumerate(index.ids.to_pylist()) if int(c[1:]) >= 900)


def test_texts_are_read_once_for_all_opinions(spark):
    points = [op.Checkpoint("seal", ("seal",), ("seal",), "presence"), op.Checkpoint("size", ("size",), ("size",), "number")]
    rest = [op.Checkpoint("photo", (), ("photo",), "presence")]
    said = spark.createDataFrame([("a", "name the seal and size"), ("b", "doors"), ("c", "the size")], "card_id string, opinion string")
    texts = spark.createDataFrame([(1, "the seal is there, the size 5 mm"), (2, None), (3, ""), (4, "a photo of one size")], "doc_id int, evidence string")
    kept = ("card_id", "doc_id", "alignment", "assessments", "covered", "partial", "absent")
    whole = op.assess(said.join(texts), points, rest).select(*kept)
    read = op.read(texts, points, rest)
    assert max(len(r.evidence or "") for r in read.collect()) == 1
    once = op.assess(said.join(read), points, rest).select(*kept)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, whole.collect()))
    missed = op.assess(said.withColumn("doc_id", F.lit(9)).join(read, "doc_id", "left"), points, rest)
    assert {(r.alignment, *r.covered) for r in missed.collect()} == {("undecided",)}


def test_opinions_are_read_once_for_all_texts(spark):
    points = [op.Checkpoint("seal", ("seal",), ("seal",), "presence"), op.Checkpoint("size", ("size",), ("size",), "number")]
    rest = [op.Checkpoint("photo", (), ("photo",), "presence")]
    said = spark.createDataFrame([("a", "the size: name the seal"), ("b", "doors, and the price"), ("c", "/"), ("d", None)], "card_id string, opinion string").withColumn("work_category", F.lit("all"))
    texts = spark.createDataFrame([(1, "the seal is there, the size 5 mm", "cross_project"), (2, None, "same_project"), (3, "a photo of one size", "same_project")], "doc_id int, evidence string, match_scope string")
    known = op.worded(op.asked(said, points, rest), (":", ","), "price")
    assert {(r.card_id, tuple(r.wanted), r.idle, r.work_item, r.hinted) for r in known.where("opinion is not null").collect()} == {("a", ("seal", "size"), False, "thesize", False), ("b", ("photo",), False, "doors", True), ("c", ("photo",), True, "all", False)}
    rows = lambda cards: op.assess(cards.join(texts), points, rest)
    kept = ("card_id", "doc_id", "alignment", "assessments", "covered", "partial", "absent")
    assert sorted(map(repr, rows(known).select(*kept).collect())) == sorted(map(repr, rows(said).select(*kept).collect()))
    found = lambda cards: sorted(map(repr, op.card_findings(rows(cards), (":", ","), {"size": "give it"}, "price").collect()))
    assert found(known) == found(said) and len(found(known)) > 3
    # what tells of an opinion is no part of the plan where cards and texts have met
    top = op.card_findings(rows(known), (":", ","), {"size": "give it"}, "price")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "price" not in top


def test_audit_reads_matched_cards_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        seen.add(1)
        return x

    lines = spark.createDataFrame([(i, 1, f"pipe {i}") for i in range(6)], "doc_id int, line_no int, line string")
    cards = spark.createDataFrame([(i, "c", 2, "name the pipe", "R") for i in range(6)], "doc_id int, card_id string, overlap int, opinion string, work_category string").withColumn("opinion", told.asNondeterministic()("opinion"))
    out = au.run(lines.select("doc_id"), lines, [lx.Entry("scope", keywords=("zzz",))], [lx.FindingRule("r", (("pipe",),), none_of=("x",), message="m")], ("pipe",), cards)
    assert out.count() == 6 and seen.value == 6


def test_cards_come_back_from_written_rules(spark):
    from dossierlake.plans import review

    plan = review.s15w(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower()


def test_dedupe_takes_many_documents_a_call(spark):
    rows = [(i, k, "floor", "a", t, False, "local") for i in range(3) for k, t in ((2, "glue ratio missing!"), (1, "glue ratio missing"), (3, "paint"))]
    out = au.semantic_dedupe(spark.createDataFrame([*rows, (7, 1, None, None, None, None, None)], FINDING), ("glue", "ratio"))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == [f.split()[0] for f in FINDING.split(", ")]
    assert {(r.doc_id, r.issue_no) for r in out.collect()} == {(i, k) for i in range(3) for k in (1, 3)} | {(7, 1)}


def test_titles_meet_pages_in_groups_of_any_size(spark, monkeypatch):
    from dossierlake.operators import structure as st

    titles = [(1, 1, "Alpha beta gamma delta"), (1, 2, "Alpha beta gamma epsilon"), (1, 3, "beta"), (1, 4, " - "), (1, 5, None), (1, 6, "nowhere"), (2, 1, "Alpha beta gamma delta"), (2, 2, "x1"), (3, 1, "beta"), (None, 1, "beta")]
    items = spark.createDataFrame([(d, i, "1", t) for d, i, t in titles] + [(4, i, "1", f"head of many titles {i:03d}") for i in range(300)], "doc_id long, item_no int, structure string, title string")
    rows = [(1, 1, "alpha BETA; gamma"), (1, 2, "so: Alpha-beta gamma epsilon."), (1, 3, "alphabetagammadelta, beta"), (2, 7, "X 1"), (2, 5, "ax1"), (2, 9, None)]
    rows += [(4, p, " ".join(f"Head of many titles {i:03d}." for i in range(300) if i % 20 == p)) for p in range(20)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    want = {(1, 1): 3, (1, 2): 2, (1, 3): 1, (2, 2): 5} | {(4, i): i % 20 for i in range(300)}
    got = lambda: {(r.doc_id, r.item_no): r.found_page for r in st.align(items, pages).collect()}
    assert got() == want
    monkeypatch.setattr(st, "TITLES", 40)  # a document in several groups of titles and of pages
    monkeypatch.setattr(st, "LETTERS", 500)
    assert got() == want
    assert "MapInArrow" not in st.align(items, pages)._jdf.queryExecution().executedPlan().toString()  # no dictionary of all titles
