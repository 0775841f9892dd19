"""Conditions written as data: distances, order, numbers, bounds, values; in rules, in checkpoints and in SQL."""

import json

import duckdb
import pytest
from dossierlake.functions import conditions as cn
from dossierlake.functions import lexicon as lx
from dossierlake.operators import opinions as op
from pyspark.sql import functions as F

TEXTS = [
    "先做水沟及成品保护，再铺EPDM面层", "EPDM铺装完成后施工水沟", "水沟与EPDM。先后另行说明", "固化不少于24小时后开放使用", "养护；24小时", "24h内完成养护", "胶水配比 3:1", "配比见厂家说明",
    "基层含水率≤8%，平整度 2m 靠尺", "厚度12.5mm", "厚度 3 mm，间距 900mm", "", None, "a.b*c (x) [1]", "AT LEAST 5 coats of paint", "paint 2 coats",
]
SPECS = {
    "order": {"or": [{"before": [["先"], ["水沟"]], "within": 40, "stop": "。；"}, {"before": [["水沟"], {"pattern": "成品保护[^。；]{0,80}epdm"}], "within": 80, "stop": "。；"}]},
    "reversed": {"before": [["EPDM"], ["水沟"]], "within": 220, "stop": "。；"},
    "cure": {"near": [["固化", "养护", "开放使用"], {"number": ["小时", "h", "天"]}], "within": 40},
    "mix": {"before": [["配比", "比例"], {"pattern": r"\d+\s*[:：]\s*\d+"}], "within": 30},
    "bound": {"threshold": True},
    "thick": {"value": ["厚度"], "unit": ["mm"], "within": 5, "least": 10},
    "thin": {"value": ["厚度", "间距"], "unit": ["mm"], "within": 5, "most": 5},
    "marks": {"all": ["a.b*c", "(X)"]},
    "near marks": {"near": [["[1]"], ["b*c"]], "within": 6, "stop": "@"},
    "none": {"not": {"any": ["水", "coats", " "]}},
    "both": {"and": [{"any": ["paint"]}, {"not": {"threshold": True}}]},
    "nothing": {"and": []},
}
WANT = {
    "order": {0}, "reversed": {1}, "cure": {3, 5}, "mix": {6}, "bound": {3, 8, 14}, "thick": {9}, "thin": {10}, "marks": {13}, "near marks": {13}, "both": {15}, "nothing": set(range(16)),
    "none": {3, 4, 5, 7, 9, 10, 11, 12, 13},
}


def test_conditions_by_hand_and_in_sql(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    found = rows.select("i", *[cn.compiled(json.dumps(s), F.col("text")).alias(n.replace(" ", "_")) for n, s in SPECS.items()]).collect()
    con = duckdb.connect()
    con.register("t", rows.toPandas())
    for name, spec in SPECS.items():
        got = {r.i for r in found if r[name.replace(" ", "_")]}
        assert got == {i for i, hit in con.execute(f"SELECT i, {cn.as_sql(spec, 'text')} FROM t").fetchall() if hit}, name
        assert got == WANT[name], name
    for bad in ({}, {"any": [], "not": {}}, {"nearby": []}, {"near": [["a"], {"any": ["b"]}]}):
        with pytest.raises(ValueError):
            cn.compiled(bad, F.col("text"))


def test_rules_from_a_table(spark):
    kind = "rule_id string, priority int, when string, message string, points array<struct<name: string, condition: string>>"
    table = [("cure", 2, json.dumps({"any": ["固化", "养护"]}), "curing", [("time", json.dumps(SPECS["cure"]))]), ("turn", 1, json.dumps(SPECS["reversed"]), "order", None), ("all", 2, None, "always", [])]
    rules = lx.finding_rules(spark.createDataFrame(table, kind))
    assert [r.rule_id for r in rules] == ["turn", "all", "cure"]
    fired = lx.fire(spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string"), "text", rules).where("rule_id <> 'all'").collect()
    assert {(r.i, r.rule_id, tuple(r.missing)) for r in fired} == {(1, "turn", ()), (4, "cure", ("time",))}


def test_checkpoints_by_order_and_by_attribution(spark):
    turn = op.Checkpoint("turn", ("水沟",), (), "cases", cases=(("covered", json.dumps(SPECS["order"])), ("missing", json.dumps(SPECS["reversed"])), ("vague", json.dumps({"any": ["水沟", "EPDM"]}))))
    rows = spark.createDataFrame([("水沟交接", t, ["样板", "图纸"]) for t in TEXTS[:4]] + [("其他", "有图纸", ["样板", "图纸"]), ("其他", "x", None)], "opinion string, evidence string, artifacts array<string>")
    found = [[(a.name, a.status) for a in r.assessments] for r in op.assess(rows, [turn], F.col("artifacts")).collect()]
    assert found == [[("turn", "covered")], [("turn", "missing")], [("turn", "vague")], [("turn", "missing")], [("样板", "missing"), ("图纸", "covered")], []]
