"""Registered queries: opinions, evidence, findings, structure, bills, calls, tasks and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import conditions as cn
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import audit as au
from ..operators import index as ix
from ..operators import opinions as op
from ..operators import retrieval as rt
from ..operators import rules as rl
from ..operators import scan as sc
from ..operators import structure as st
from ..sources import documents as sd
from ..sources.shared import shared_path
from ..sources.views import ctes, view
from ..streaming import cache, jobs, segments, tasks
from .corpus import placed, rule_index
from .fixture import ATTRIBUTIONS, CONDITIONS, FAMILIES, FINDINGS, FOCUS, GUARD, GUIDE, INTENTS, LEX, ORDERED, PRICES, PROFILES, REFERENCES, STOP, family_values, lex_values, sql_case, sql_list
from .registry import query

TERMS = ("tion", "ing", "que", "ent", "der", "und")
POINTS = (
    op.Checkpoint("grant", ("the", "des"), ("license", "tion"), "presence"),
    op.Checkpoint("order", ("ing", "que"), ("and", "eau"), "exact", "(and|eau)[^.]{0,30}(the|la)"),
    op.Checkpoint("amount", ("ung", "re"), ("er", "ou"), "number"),
)
FALLBACK = (op.Checkpoint("basis", (), ("an", "en"), "presence"), op.Checkpoint("photo", (), ("photo",), "number"))
HINTS = (lx.Entry("rule", pattern="the|der"), lx.Entry("logic", pattern="and|que"))
ALIASES = (lx.Entry("scope", keywords=("license", "copyright")), lx.Entry("method", keywords=("www", "mail", "@")), lx.Entry("accept", keywords=("%%%", "|")))
ITEMS = r"CASE WHEN trim({c}) IN ('', '/', '无', '无意见') THEN []::VARCHAR[] WHEN len({p}) > 0 THEN {p} ELSE [{f}] END"


def opinions(spark, d):
    return view(spark, d, "v_opinions")


def words(c, limit=10):
    return tx.query_tokens(c, STOP, limit, "[A-Za-z]{4,}")


def sql_words(c, limit=10):
    every = f"regexp_extract_all({c}, '[A-Za-z]{{4,}}')"
    return f"list_filter(list_filter({every}, lambda t, i: list_position({every}, t) = i), lambda t: NOT list_contains({sql_list(STOP)}, t))[1:{limit}]"


# --- opinions ---

_FLAT = "replace(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(13), chr(10)), chr(10), ' / ')"
_PARTS = rf"list_filter(list_transform(string_split_regex({_FLAT}, '(?:^|[；;/]\s*)\d+[、.．]\s*'), lambda p: trim(p, ' ；;/')), lambda p: p <> '')"


@query("c15_split_items", f"SELECT conv_id, turn, CAST(i AS INT) AS item_index, items[i] AS opinion FROM (SELECT conv_id, turn, {ITEMS.format(c='text', p=_PARTS, f=_FLAT)} AS items FROM conversations) t, LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i) u")
def c15(spark, d):
    return op.load(view(spark, d, "conversations").withColumnRenamed("text", "opinion")).select("conv_id", "turn", "item_index", "opinion")


COUNTS = f"fam(o, code, pat) AS (VALUES {family_values()}), cnt AS (SELECT row_index, item_index, o, code, len(regexp_extract_all(opinion, pat)) AS n FROM v_opinions, fam), hit AS (SELECT *, row_number() OVER (PARTITION BY row_index, item_index ORDER BY n DESC, o) AS k FROM cnt WHERE n > 0)"


def condition_rules(spark):
    """The rules of the fixture as a table, read back in order."""
    kind = "rule_id string, priority int, when string, message string, points array<struct<name: string, condition: string>>"
    return lx.finding_rules(spark.createDataFrame([(*r[:4], list(r[4])) for r in CONDITIONS], kind))


_TEXT = "text"
_RULED = sorted(CONDITIONS, key=lambda r: (r[1], r[0]))
_FIRED = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ordinal, '{r[0]}' AS rule_id, '{r[3]}' AS message, array_to_string(gaps, ',') AS missing FROM (SELECT doc_id, text, list_filter([{', '.join(f'CASE WHEN NOT {cn.as_sql(c, _TEXT)} THEN {n!r} END' for n, c in r[4])}]::VARCHAR[], lambda x: x IS NOT NULL) AS gaps FROM :src) WHERE {cn.as_sql(r[2], 'text')}" + (" AND len(gaps) > 0" if r[4] else "")
    for i, r in enumerate(_RULED)
)


@query("c14_condition_rules", "SELECT doc_id, rule_id, message, missing FROM (" + _FIRED.replace(":src", "documents") + ")")
def c14c(spark, d):
    fired = lx.fire(view(spark, d, "documents"), "text", condition_rules(spark))
    return fired.select("doc_id", "rule_id", "message", F.array_join("missing", ",").alias("missing"))


@query("c3_dimension", ctes("v_opinions", more=COUNTS) + "SELECT v.row_index, v.item_index, coalesce(code, 'complete') AS dimension FROM v_opinions v LEFT JOIN (SELECT * FROM hit WHERE k = 1) h ON h.row_index = v.row_index AND h.item_index = v.item_index")
def c3(spark, d):
    return opinions(spark, d).select("row_index", "item_index", lx.top_label(F.col("opinion"), FAMILIES, "complete").alias("dimension"))


@query("c4_patterns", ctes("v_opinions", more=COUNTS) + "SELECT v.row_index, v.item_index, coalesce(string_agg(code, ',' ORDER BY k), 'judgement') AS labels FROM v_opinions v LEFT JOIN hit h ON h.row_index = v.row_index AND h.item_index = v.item_index GROUP BY 1, 2")
def c4(spark, d):
    return opinions(spark, d).select("row_index", "item_index", F.array_join(lx.labels(F.col("opinion"), FAMILIES, "judgement"), ",").alias("labels"))


@query("c5_attributions", ctes("v_opinions", more=COUNTS) + "SELECT v.row_index, v.item_index, coalesce(max(code) FILTER (WHERE k = 1), 'judgement') AS attribution, coalesce(string_agg(code, ',' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4), '') AS secondary FROM v_opinions v LEFT JOIN hit h ON h.row_index = v.row_index AND h.item_index = v.item_index GROUP BY 1, 2")
def c5(spark, d):
    found = opinions(spark, d).withColumn("l", lx.labels(F.col("opinion"), FAMILIES, "judgement"))
    return found.select("row_index", "item_index", F.get("l", F.lit(0)).alias("attribution"), F.array_join(F.slice("l", 2, 3), ",").alias("secondary"))


_LISTS = ", ".join(f"('{k}', {sql_list(v)})" for k, v in INTENTS.items())


@query("c6_intents", ctes("v_opinions", more=f"{COUNTS}, lists(code, l) AS (VALUES {_LISTS}), every AS (SELECT row_index, item_index, flatten(list(l ORDER BY k)) AS f FROM hit JOIN lists USING (code) GROUP BY 1, 2)") + "SELECT v.row_index, v.item_index, coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ','), 'none') AS intents FROM v_opinions v LEFT JOIN every e ON e.row_index = v.row_index AND e.item_index = v.item_index")
def c6(spark, d):
    codes = lx.labels(F.col("opinion"), FAMILIES, "judgement")
    return opinions(spark, d).select("row_index", "item_index", F.array_join(lx.implied(codes, INTENTS, F.lit("none")), ",").alias("intents"))


def classified(spark, d):
    return op.classify(opinions(spark, d), LEX, FAMILIES, FAMILIES, INTENTS).withColumn("keywords", words(F.col("opinion")))


@query("c7_attribution_bundle", ctes("v_opinions", more=f"""{COUNTS}, lists(code, l) AS (VALUES {_LISTS}), every AS (SELECT row_index, item_index, flatten(list(l ORDER BY k)) AS f FROM hit JOIN lists USING (code) GROUP BY 1, 2),
lab AS (SELECT v.row_index, v.item_index, max(code) FILTER (WHERE k = 1) AS a, coalesce(string_agg(code, ',' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4), '') AS s FROM v_opinions v LEFT JOIN hit h ON h.row_index = v.row_index AND h.item_index = v.item_index GROUP BY 1, 2),
lex(o, code, w, kw) AS (VALUES {lex_values()}), n AS (SELECT row_index, item_index, code, len(list_filter(kw, lambda k: contains(lower(opinion), k))) AS n FROM v_opinions, lex), cat AS (SELECT row_index, item_index, coalesce(max_by(code, (n, code)) FILTER (WHERE n > 0), 'OTHER') AS c FROM n GROUP BY 1, 2)""") + """
SELECT lab.row_index, lab.item_index, c AS work_category, coalesce(a, 'complete') AS dimension, coalesce(a, 'judgement') AS pattern, s AS secondary,
 coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ','), coalesce(a, 'complete')) AS intents
FROM lab JOIN cat ON cat.row_index = lab.row_index AND cat.item_index = lab.item_index LEFT JOIN every e ON e.row_index = lab.row_index AND e.item_index = lab.item_index""")
def c7(spark, d):
    return classified(spark, d).select("row_index", "item_index", "work_category", "dimension", "pattern", F.array_join("secondary", ",").alias("secondary"), F.array_join("intents", ",").alias("intents"))


@query("c8_evidence_type", ctes("v_opinions") + "SELECT row_index, item_index, CASE WHEN regexp_matches(opinion, 'the|der') THEN 'rule' WHEN regexp_matches(opinion, 'and|que') THEN 'logic' ELSE 'experience' END AS evidence_type FROM v_opinions")
def c8(spark, d):
    return opinions(spark, d).select("row_index", "item_index", op.evidence_type(F.col("opinion"), HINTS, F.lit(""), "logic").alias("evidence_type"))


@query("c9_document_types", "SELECT page_id, CASE WHEN contains(lower(url), '/en/') AND contains(lower(url), '.net') THEN 'both' WHEN contains(lower(url), '/en/') THEN 'scheme' WHEN contains(lower(url), '.net') THEN 'cost' ELSE 'other' END AS kind FROM pages")
def c9(spark, d):
    return view(spark, d, "pages").select("page_id", op.document_type(F.col("url"), ("/en/",), (".net",)).alias("kind"))


@query("c10_extension_rules", ctes("v_opinions", more=f"lex(o, code, w, kw) AS (VALUES {lex_values()}), h AS (SELECT row_index, item_index, string_agg(code, ',' ORDER BY o) AS codes FROM v_opinions, lex WHERE len(list_filter(kw, lambda k: contains(lower(opinion), k))) > 0 GROUP BY 1, 2)") + "SELECT v.row_index, v.item_index, coalesce(codes, 'DEFAULT') AS codes FROM v_opinions v LEFT JOIN h ON h.row_index = v.row_index AND h.item_index = v.item_index")
def c10(spark, d):
    return opinions(spark, d).select("row_index", "item_index", F.array_join(op.extensions(F.col("opinion"), LEX, F.lit("DEFAULT")), ",").alias("codes"))


_LEX_WORDS = sql_list([k for e in LEX for k in e.keywords])


@query("c11_trigger_words", ctes("v_opinions", more=f"a AS (SELECT row_index, item_index, list_concat(list_filter({_LEX_WORDS}, lambda k: contains(lower(opinion), lower(k))), list_filter(regexp_extract_all(opinion, '[A-Za-z0-9]{{2,}}|[一-鿿]{{2,8}}'), lambda t: NOT list_contains({sql_list(STOP)}, t))) AS w FROM v_opinions)") + "SELECT row_index, item_index, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i)[1:10], ',') AS words FROM a")
def c11(spark, d):
    return opinions(spark, d).select("row_index", "item_index", F.array_join(op.triggers(F.col("opinion"), LEX, STOP), ",").alias("words"))


@query("c13_section_types", ctes("v_lines") + "SELECT doc_id, line_no, coalesce(CASE WHEN contains(lower(line), 'license') OR contains(lower(line), 'copyright') THEN 'scope' WHEN contains(lower(line), 'www') OR contains(lower(line), 'mail') OR contains(lower(line), '@') THEN 'method' WHEN contains(line, '%%%') OR contains(line, '|') THEN 'accept' END, 'none') AS section_type FROM v_lines")
def c13(spark, d):
    return view(spark, d, "v_lines").select("doc_id", "line_no", lx.first_hit(F.col("line"), ALIASES, "none").alias("section_type"))


@query("c14_finding_rules", """
SELECT doc_id, 'no_license' AS rule_id, '' AS missing FROM documents WHERE (contains(lower(text), 'the ') OR contains(lower(text), 'der ')) AND NOT contains(lower(text), 'license')
UNION ALL SELECT doc_id, 'parts', array_to_string(m, ',') FROM (SELECT doc_id, list_filter(['license', 'ouen', 'quell'], lambda w: NOT contains(lower(text), w)) AS m FROM documents
  WHERE (contains(lower(text), 'tion') OR contains(lower(text), 'ción')) AND (contains(lower(text), 'ing') OR contains(lower(text), 'que'))) WHERE len(m) > 0
UNION ALL SELECT doc_id, 'markup', '' FROM documents WHERE contains(text, '%%%') OR contains(text, '***')""")
def c14(spark, d):
    found = lx.fire(view(spark, d, "documents").select("doc_id", "text"), "text", FINDINGS)
    return found.select("doc_id", "rule_id", F.array_join("missing", ",").alias("missing"))


_NAMED = "SELECT conv_id, turn, text, coalesce(p_name, 'nothing like it') AS project_name FROM conversations LEFT JOIN part ON p_partkey = conv_id + 1"
_MAPPED = "SELECT DISTINCT p_name AS project_name, concat(p_name, '.docx') AS path FROM part WHERE p_name LIKE 'small%'"


@query("c16_matched_load", f"""WITH nm AS ({_NAMED}), mp AS ({_MAPPED}), i AS (SELECT conv_id, turn, project_name, CAST(i AS INT) AS item_index FROM (SELECT *, {ITEMS.format(c='text', p=_PARTS, f=_FLAT)} AS items FROM nm) t, LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i) u),
b AS (SELECT DISTINCT concat(p_name, ' ', p_type) AS b FROM part), s AS (SELECT a.project_name, b, 1 - levenshtein(a.project_name, b) / greatest(length(a.project_name), length(b)) AS score FROM (SELECT DISTINCT project_name FROM nm WHERE project_name NOT IN (SELECT project_name FROM mp)) a, b),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY round(score, 9) DESC, b) AS k FROM s WHERE score >= 0.45) WHERE k = 1)
SELECT i.conv_id, i.turn, item_index, i.project_name, coalesce(path, concat(b, '.xlsx'), '') AS matched_file, CASE WHEN path IS NOT NULL THEN 'mapping' WHEN b IS NOT NULL THEN 'fuzzy' ELSE '' END AS match_type,
 CASE WHEN path IS NOT NULL THEN 'mapped' WHEN b IS NULL THEN 'none' WHEN contains(i.project_name, b) OR contains(b, i.project_name) THEN 'high' WHEN score >= 0.68 THEN 'medium' ELSE 'low' END AS quality
FROM i LEFT JOIN mp ON mp.project_name = i.project_name LEFT JOIN f ON f.project_name = i.project_name""")
def c16m(spark, d):
    part = view(spark, d, "part")
    said = view(spark, d, "conversations").join(part.select((F.col("p_partkey") - 1).alias("conv_id"), F.col("p_name").alias("project_name")), "conv_id", "left")
    rows = op.load(said.select("conv_id", "turn", F.coalesce("project_name", F.lit("nothing like it")).alias("project_name"), F.col("text").alias("opinion")))
    mapping = part.where("p_name LIKE 'small%'").select(F.col("p_name").alias("project_name"), F.concat("p_name", F.lit(".docx")).alias("path")).distinct()
    found = op.match_sources(rows, part.select(F.concat(F.concat_ws(" ", "p_name", "p_type"), F.lit(".xlsx")).alias("name")), mapping)
    out = op.classify(rows, LEX, FAMILIES, FAMILIES, INTENTS).join(found, "project_name", "left")
    return out.select("conv_id", "turn", "item_index", "project_name", tx.blank(F.col("matched_file")).alias("matched_file"), tx.blank(F.col("match_type")).alias("match_type"), F.coalesce("quality", F.lit("none")).alias("quality"))


@query("c16_opinion_load")
def c16(spark, d):
    rows = op.load(opinions(spark, d).drop("item_index"))
    return op.classify(rows, LEX, FAMILIES, FAMILIES, INTENTS).select("row_index", "item_index", "project_name", "work_category", "dimension", "pattern", F.array_join("intents", ",").alias("intents"))


#: The given opinions, some of which say no more than a fixed remark.
REMARKS = """o AS (SELECT row_index, item_index, CASE row_index % 5 WHEN 0 THEN '无' WHEN 1 THEN concat('同意 ', opinion) WHEN 2 THEN concat(' 亮点', opinion) WHEN 3 THEN '/' ELSE opinion END AS opinion FROM v_opinions)"""


@query("f2_non_actionable", ctes("v_opinions", more=REMARKS) + "SELECT row_index, item_index FROM o WHERE trim(opinion) IN ('无', '/', '') OR starts_with(trim(opinion), '同意') OR starts_with(trim(opinion), '亮点')")
def f2(spark, d):
    kind, said = F.col("row_index") % 5, F.col("opinion")
    rows = opinions(spark, d).withColumn("opinion", F.when(kind == 0, "无").when(kind == 1, F.concat(F.lit("同意 "), said)).when(kind == 2, F.concat(F.lit(" 亮点"), said)).when(kind == 3, "/").otherwise(said))
    return rows.where(op.non_actionable(F.col("opinion"))).select("row_index", "item_index")


@query("f3_promotion", ctes("v_opinions") + "SELECT row_index, item_index FROM v_opinions WHERE trim(opinion) NOT IN ('无', '/', '') AND NOT starts_with(trim(opinion), '同意') AND NOT (length(trim(opinion)) <= 8 AND ends_with(trim(opinion), ':')) AND (contains(opinion, 'tion') OR row_index % 4 IN (0, 2))")
def f3(spark, d):
    kind = F.when(F.col("row_index") % 4 == 0, "complete").when(F.col("row_index") % 4 == 2, "logic").otherwise("method")
    keep = op.promotes(F.col("opinion"), kind, F.contains("opinion", F.lit("tion")), ("complete", "logic"))
    return opinions(spark, d).where(keep).select("row_index", "item_index")


@query("f12_domain_guard", ctes("v_opinions") + "SELECT row_index, item_index FROM v_opinions WHERE NOT (contains(lower(opinion), 'ing') AND NOT contains(lower(opinion), 'tion')) AND NOT (contains(lower(opinion), 'que') AND NOT contains(lower(opinion), 'eau'))")
def f12(spark, d):
    ok = F.lit(True)
    for term, alias in (("ing", "tion"), ("que", "eau")):
        ok = ok & ~(tx.contains_any(F.col("opinion"), (term,)) & ~tx.contains_any(F.col("opinion"), (alias,)))
    return opinions(spark, d).where(ok).select("row_index", "item_index")


@query("p15_templates", ctes("v_opinions", more=COUNTS) + "SELECT v.row_index, v.item_index, CASE coalesce(code, 'none') WHEN 'complete' THEN concat('name the parts of ', project_name) WHEN 'method' THEN concat('explain ', project_name) ELSE 'look again' END AS template FROM v_opinions v LEFT JOIN (SELECT * FROM hit WHERE k = 1) h ON h.row_index = v.row_index AND h.item_index = v.item_index")
def p15(spark, d):
    choice = lx.top_label(F.col("opinion"), FAMILIES, "none")
    text = op.template(choice, {"complete": "name the parts of {name}", "method": "explain {name}"}, "look again", name=F.col("project_name"))
    return opinions(spark, d).select("row_index", "item_index", text.alias("template"))


_CARD_ID = "concat('EXP_', upper(left(sha256(concat('conv_', CAST(row_index AS VARCHAR), chr(10), CASE WHEN row_index = 0 THEN '' ELSE CAST(row_index AS VARCHAR) END, chr(10), CASE WHEN item_index = 0 THEN '' ELSE CAST(item_index AS VARCHAR) END, chr(10), opinion)), 12)))"
#: Cards with their triggers (one row each), and the triggers of a card in every document, as SQL.
MATCH = f"""cw AS (SELECT *, {sql_words('opinion')} AS k FROM v_opinions),
lab AS (SELECT v.row_index, v.item_index, count(h.code) FILTER (WHERE h.k BETWEEN 2 AND 4) AS s FROM v_opinions v LEFT JOIN hit h ON h.row_index = v.row_index AND h.item_index = v.item_index GROUP BY 1, 2),
cards AS (SELECT row_index, item_index, {_CARD_ID} AS card_id, project_name, opinion, k, CASE WHEN s = 0 THEN 'medium' ELSE 'high' END AS confidence FROM cw JOIN lab USING (row_index, item_index)),
wd AS (SELECT DISTINCT card_id, confidence, project_name, unnest(k) AS word FROM cards),
tr AS (SELECT DISTINCT lower(word) AS low FROM wd),
th AS (SELECT doc_id, low FROM documents JOIN tr ON contains(lower(text), low)),
m AS (SELECT doc_id, card_id, confidence, project_name, count(*) AS overlap FROM th JOIN wd ON lower(word) = low GROUP BY 1, 2, 3, 4)"""
_PLACE = "row_number() OVER (PARTITION BY {g} ORDER BY overlap DESC, confidence = 'high' DESC, card_id)"
KINDS = f"""lex(o, code, w, kw) AS (VALUES {lex_values()}), lexn AS (SELECT row_index, item_index, code, len(list_filter(kw, lambda k: contains(lower(opinion), k))) AS n FROM v_opinions, lex),
cat AS (SELECT row_index, item_index, coalesce(max_by(code, (n, code)) FILTER (WHERE n > 0), 'OTHER') AS work_category FROM lexn GROUP BY 1, 2),
full_cards AS (SELECT c.*, work_category, coalesce(h.code, 'complete') AS dimension FROM cards c JOIN cat USING (row_index, item_index) LEFT JOIN (SELECT row_index, item_index, code FROM hit WHERE hit.k = 1) h USING (row_index, item_index))"""
CARDS = ctes("v_opinions", more=f"{COUNTS}, {MATCH}, {KINDS}")


#: Attribution of every card's opinion as SQL: the codes, then the texts that follow from them.
_ACOUNTS = COUNTS.replace("fam", "afam").replace("cnt", "acnt").replace("hit AS", "ahit AS").replace(family_values(), family_values(ATTRIBUTIONS))
_FIELD = lambda name: sql_case("professional_attribution", {k: name(p) for k, p in PROFILES.items()}, "judgement")
BUNDLE = f"""{_ACOUNTS}, lists(code, l) AS (VALUES {_LISTS}),
pl AS (SELECT row_index, item_index, max(code) FILTER (WHERE k = 1) AS c, string_agg(code, ',' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4) AS s, flatten(list(l ORDER BY k)) AS f FROM hit JOIN lists USING (code) GROUP BY 1, 2),
al AS (SELECT row_index, item_index, max(code) FILTER (WHERE k = 1) AS c, string_agg(code, ',' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4) AS s FROM ahit GROUP BY 1, 2),
codes AS (SELECT fc.*, coalesce(pl.c, 'judgement') AS problem_pattern, coalesce(pl.s, '') AS secondary_patterns, coalesce(al.c, 'judgement') AS professional_attribution, coalesce(al.s, '') AS secondary_professional_attributions,
 coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ','), {sql_case("dimension", *GUIDE.usual)}) AS review_intents FROM full_cards fc LEFT JOIN pl USING (row_index, item_index) LEFT JOIN al USING (row_index, item_index)),
bundle AS (SELECT *, {sql_case("problem_pattern", GUIDE.labels, "judgement")} AS problem_pattern_label, {_FIELD(lambda p: p.label)} AS professional_attribution_label, {_FIELD(lambda p: p.question)} AS engineer_question,
 {_FIELD(lambda p: p.cause)} AS root_cause, {_FIELD(lambda p: p.principle)} AS generalization_rule, {_FIELD(lambda p: ";".join(p.checks))} AS review_questions, {_FIELD(lambda p: ";".join(p.artifacts))} AS required_artifacts,
 CASE WHEN contains(opinion, 'license') OR contains(opinion, 'MIT ') THEN 'grant at risk' WHEN problem_pattern = 'split' THEN 'price at risk' WHEN problem_pattern = 'logic' THEN 'order at risk' WHEN dimension = 'complete' THEN 'gaps on site' ELSE 'loop stays open' END AS risk_if_ignored,
 {sql_case("problem_pattern", *[t.replace("{category}", "{work_category}") if isinstance(t, str) else {k: v.replace("{category}", "{work_category}") for k, v in t.items()} for t in GUIDE.fixes])} AS fix_template,
 array_to_string(list_filter(q, lambda t, i: list_position(q, t) = i), ' ') AS standard_query
 FROM (SELECT *, list_concat(k[1:5], CASE WHEN work_category <> 'OTHER' THEN [work_category] ELSE [] END, CASE WHEN dimension = 'complete' THEN ['material', 'acceptance'] ELSE ['sequence'] END) AS q FROM codes))"""
BUNDLED = ctes("v_opinions", more=f"{COUNTS}, {MATCH}, {KINDS}, {BUNDLE}")
FIELDS = "problem_pattern problem_pattern_label secondary_patterns professional_attribution professional_attribution_label secondary_professional_attributions engineer_question review_intents root_cause risk_if_ignored generalization_rule review_questions required_artifacts fix_template standard_query".split()


def attributed(spark, d):
    return op.attribute(classified(spark, d), GUIDE)


def plain(df, *names, by=","):
    """Columns with their arrays as text."""
    kinds = dict(df.dtypes)
    return [F.array_join(n, ";" if n in ("review_questions", "required_artifacts") else by).alias(n) if kinds[n] == "array<string>" else F.col(n) for n in names]


@query("c7_full_attribution", BUNDLED + f"SELECT row_index, item_index, {', '.join(FIELDS)} FROM bundle")
def c7f(spark, d):
    rows = attributed(spark, d)
    return rows.select("row_index", "item_index", *plain(rows, *FIELDS))


@query("p15_text_builders", BUNDLED + f"SELECT row_index, item_index, {sql_case('dimension', {'complete': '{work_category} needs its parts named'}, '{work_category} needs its order')} AS background, CASE dimension WHEN 'complete' THEN concat('[', o, '] points are missing') ELSE concat('[', o, '] check the order') END AS reason, risk_if_ignored, fix_template, {sql_case('work_category', FOCUS, 'all')} AS focus, concat('the expert asks: ', engineer_question) AS intent FROM (SELECT *, trim(regexp_replace(opinion, '\\s+', ' ', 'g')) AS o FROM bundle)")
def p15b(spark, d):
    c, t = F.col, op.template
    rows = attributed(spark, d)
    return rows.select("row_index", "item_index", t(c("dimension"), *GUIDE.backgrounds, category=c("work_category")).alias("background"), t(c("dimension"), *GUIDE.reasons, opinion=tx.clean(c("opinion"))).alias("reason"), "risk_if_ignored", "fix_template", t(c("work_category"), FOCUS, "all").alias("focus"), F.concat(F.lit("the expert asks: "), "engineer_question").alias("intent"))


@query("c8_evidence_reference", CARDS + "SELECT row_index, item_index, CASE WHEN regexp_matches(opinion, 'the|der') THEN CASE WHEN contains(lower(opinion), 'license') THEN 'STD-1' WHEN contains(lower(concat(opinion, ' ', work_category)), 'tion') OR contains(lower(concat(opinion, ' ', work_category)), 'ger') THEN 'STD-2' ELSE 'experience' END WHEN regexp_matches(opinion, 'and|que') THEN 'own text' ELSE 'experience' END AS evidence_ref FROM full_cards")
def c8r(spark, d):
    return with_reference(classified(spark, d)).select("row_index", "item_index", "evidence_ref")


def with_reference(rows):
    c = F.col("opinion")
    rows = rows.withColumn("evidence_type", op.evidence_type(c, HINTS, F.lit(""), "logic"))
    return rows.withColumn("evidence_ref", op.evidence_reference(c, F.col("work_category"), F.col("evidence_type"), REFERENCES, "rule", "logic", "own text", "experience"))


def whole_cards(spark, d):
    """All opinions as cards of 43 fields, judged against the document of their row."""
    rows = with_reference(attributed(spark, d))
    lines = view(spark, d, "v_lines").withColumnRenamed("doc_id", "row_index")
    found = op.snippets(op.evidence(rows.select("row_index", "item_index", "opinion", "keywords"), lines, "row_index"), "row_index")
    proof = F.struct("place", F.struct("source_file", "location", "matched_keywords", "text", "match_score").alias("e"))
    found = found.groupBy("row_index", "item_index").agg(F.transform(F.sort_array(F.collect_list(proof)), lambda s: s["e"]).alias("scheme_evidence"))
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("row_index"), F.col("text").alias("evidence"), F.col("source").alias("matched_file"))
    rows = rows.join(found, ["row_index", "item_index"], "left").join(docs, "row_index", "left")
    none = F.array().cast(found.schema["scheme_evidence"].dataType)
    rows = rows.withColumns({"scheme_evidence": F.coalesce("scheme_evidence", none), "engineer": F.lit(""), "project_type": F.lit("scheme"), "file_type": F.lit("txt"), "scheme_related": F.col("row_index") % 2 == 0, "evidence": tx.blank(F.col("evidence"))})
    return op.full_cards(op.assess(rows, POINTS, FALLBACK), GUIDE)


@query("p11_search_queries", CARDS + "SELECT row_index, item_index, array_to_string(list_filter(q, lambda t, i: list_position(q, t) = i), ' ') AS query FROM (SELECT row_index, item_index, list_concat(k[1:5], CASE WHEN work_category <> 'OTHER' THEN [work_category] ELSE [] END, CASE WHEN dimension = 'complete' THEN ['material', 'acceptance'] ELSE ['sequence'] END) AS q FROM full_cards)")
def p11(spark, d):
    q = op.search_query(F.col("keywords"), F.col("work_category"), F.col("dimension"), GUIDE)
    return classified(spark, d).select("row_index", "item_index", q.alias("query"))


@query("p13_cards", CARDS + "SELECT card_id, project_name, work_category, dimension, confidence, array_to_string(k, ',') AS keywords FROM full_cards")
def p13(spark, d):
    return op.cards(classified(spark, d)).select("card_id", "project_name", "work_category", "dimension", "confidence", F.array_join("keywords", ",").alias("keywords"))


@query("p14_card_rules", CARDS + "SELECT card_id AS rule_id, project_name AS source_file, row_index * 100 + item_index AS seq_index, md5(t) AS content, left(t, 700) AS condensed_content FROM (SELECT *, concat('[experience] ', work_category, ' / ', dimension, chr(10), 'opinion: ', opinion, chr(10), 'keywords: ', array_to_string(k, ', ')) AS t FROM full_cards)")
def p14(spark, d):
    return op.card_rules(op.cards(classified(spark, d))).select("rule_id", "source_file", "seq_index", F.md5("content").alias("content"), "condensed_content")


@query("s15_cards_back", CARDS + "SELECT card_id, project_name, md5(opinion) AS opinion, CAST(len(k) AS INT) AS n_keywords FROM full_cards")
def s15(spark, d):
    schema = "card_id string, project_name string, opinion string, keywords array<string>"
    return op.cards_of(op.card_rules(op.cards(classified(spark, d))), schema).select("card_id", "project_name", F.md5("opinion").alias("opinion"), F.size("keywords").alias("n_keywords"))


STATUS = """
CASE WHEN NOT (contains(lower(e), 'license') OR contains(lower(e), 'tion')) THEN 'missing' ELSE 'covered' END AS s_grant,
CASE WHEN NOT (contains(lower(e), 'and') OR contains(lower(e), 'eau')) THEN 'missing' WHEN regexp_matches(e, '(and|eau)[^.]{0,30}(the|la)') THEN 'covered' ELSE 'vague' END AS s_order,
CASE WHEN NOT (contains(lower(e), 'er') OR contains(lower(e), 'ou')) THEN 'missing' WHEN regexp_matches(e, '\\d+\\s*(?:[:：]\\s*\\d+|小时|h|H|天|日|d|D|mm|cm|m|%|遍|级)|[≥≤]|不超过|不小于|不少于') THEN 'covered' ELSE 'vague' END AS s_amount,
CASE WHEN NOT (contains(lower(e), 'an') OR contains(lower(e), 'en')) THEN 'missing' ELSE 'covered' END AS s_basis,
CASE WHEN NOT contains(lower(e), 'photo') THEN 'missing' WHEN regexp_matches(e, '\\d+\\s*(?:[:：]\\s*\\d+|小时|h|H|天|日|d|D|mm|cm|m|%|遍|级)|[≥≤]|不超过|不小于|不少于') THEN 'covered' ELSE 'vague' END AS s_photo
""".replace("\\\\", "\\")
ALIGN = f"""src AS (SELECT v.row_index, v.item_index, opinion AS o, coalesce(x.text, '') AS e FROM v_opinions v LEFT JOIN documents x ON x.doc_id = v.row_index),
p AS (SELECT *, {STATUS}, list_filter([CASE WHEN contains(lower(o), 'the') OR contains(lower(o), 'des') THEN 'grant' END, CASE WHEN contains(lower(o), 'ing') OR contains(lower(o), 'que') THEN 'order' END, CASE WHEN contains(lower(o), 'ung') OR contains(lower(o), 're') THEN 'amount' END], lambda x: x IS NOT NULL) AS t FROM src),
w AS (SELECT *, CASE WHEN len(t) > 0 THEN t ELSE ['basis', 'photo'] END AS names FROM p),
a AS (SELECT *, list_transform(names, lambda n: CASE n WHEN 'grant' THEN s_grant WHEN 'order' THEN s_order WHEN 'amount' THEN s_amount WHEN 'basis' THEN s_basis ELSE s_photo END) AS st FROM w),
v AS (SELECT row_index, item_index, e, names, st, CASE WHEN trim(o) IN ('无', '/', '') OR starts_with(trim(o), '同意') OR starts_with(trim(o), '亮点') THEN 'no_action' WHEN e = '' THEN 'undecided'
  WHEN list_contains(st, 'covered') AND NOT list_contains(st, 'vague') AND NOT list_contains(st, 'missing') THEN 'resolved'
  WHEN list_contains(st, 'covered') OR list_contains(st, 'vague') THEN 'partly_resolved' ELSE 'unresolved' END AS alignment FROM a)"""


def assessed(spark, d, docs=None):
    docs = (view(spark, d, "documents") if docs is None else docs).select(F.col("doc_id").alias("row_index"), F.col("text").alias("evidence"))
    return op.assess(opinions(spark, d).join(docs, "row_index", "left").withColumn("evidence", tx.blank(F.col("evidence"))), POINTS, FALLBACK)


_WHOLE = ctes("v_opinions", more=f"{COUNTS}, {MATCH}, {KINDS}, {BUNDLE}, {ALIGN}")
_JUDGED = "SELECT b.*, alignment, array_to_string(list_filter(names, lambda n, i: st[i] = 'covered'), ',') AS covered_points, array_to_string(list_filter(names, lambda n, i: st[i] = 'vague'), ',') AS partial_points, array_to_string(list_filter(names, lambda n, i: st[i] = 'missing'), ',') AS missing_points, e FROM bundle b JOIN v USING (row_index, item_index)"
_GAP = """CASE WHEN alignment = 'no_action' THEN 'agreed or praised: no finding' WHEN alignment = 'undecided' AND e = '' THEN 'no passage of the source to compare with' WHEN alignment = 'undecided' THEN 'no point to compare' WHEN alignment = 'resolved' THEN 'the source covers every point'
 ELSE concat_ws('; ', CASE WHEN covered_points <> '' THEN concat('covered: ', replace(covered_points, ',', ', ')) END, CASE WHEN partial_points <> '' THEN concat('vague: ', replace(partial_points, ',', ', ')) END, CASE WHEN missing_points <> '' THEN concat('missing: ', replace(missing_points, ',', ', ')) END) END"""
SHOWN = [f for f in FIELDS if f not in ("standard_query",)]


@query("p13_whole_cards", _WHOLE + f"SELECT card_id AS id, row_index AS source_row, item_index AS source_item, work_category, dimension, {', '.join(SHOWN)}, alignment AS alignment_status, covered_points, partial_points, missing_points, {_GAP} AS scheme_gap, array_to_string(k, ',') AS trigger_keywords, CASE WHEN row_index % 2 = 0 AND len(k) > 0 THEN 'high' ELSE 'medium' END AS confidence FROM ({_JUDGED})")
def p13w(spark, d):
    rows = whole_cards(spark, d)
    return rows.select(*plain(rows, "id", "source_row", "source_item", "work_category", "dimension", *SHOWN, "alignment_status", "covered_points", "partial_points", "missing_points", "scheme_gap", "trigger_keywords", "confidence"))


@query("p14_whole_card_rules", _WHOLE + f"SELECT card_id AS rule_id, row_index * 100 + item_index AS seq_index, concat_ws(' | ', work_category, dimension, professional_attribution_label, alignment, opinion, {_GAP}, generalization_rule)[1:700] AS condensed_content FROM ({_JUDGED})")
def p14w(spark, d):
    return op.full_card_rules(whole_cards(spark, d)).select("rule_id", "seq_index", "condensed_content")


@query("s15_whole_cards_back", _WHOLE + "SELECT card_id AS id, problem_pattern, v.alignment AS alignment_status FROM bundle JOIN v USING (row_index, item_index)")
def s15w(spark, d):
    cards = whole_cards(spark, d)
    rules = ix.kept(op.full_card_rules(cards), "rules")
    return op.cards_of(rules, cards.schema).select("id", "problem_pattern", "alignment_status")


@query("e1_checkpoints", ctes("v_opinions", more=ALIGN) + "SELECT row_index, item_index, array_to_string(names, ',') AS names FROM v")
def e1(spark, d):
    return opinions(spark, d).select("row_index", "item_index", F.array_join(op.expected(F.col("opinion"), POINTS, FALLBACK), ",").alias("names"))


@query("e2_checkpoint_status", ctes("v_opinions", more=ALIGN) + "SELECT row_index, item_index, array_to_string(st, ',') AS statuses FROM v")
def e2(spark, d):
    return assessed(spark, d).select("row_index", "item_index", F.array_join(F.transform("assessments", lambda a: a["status"]), ",").alias("statuses"))


_TURN = " ".join(f"WHEN {cn.as_sql(c, 'text')} THEN '{n}'" for n, c in ORDERED)


@query("e2_ordered_checkpoints", f"SELECT doc_id, CASE {_TURN} ELSE 'missing' END AS status FROM documents")
def e2o(spark, d):
    """A checkpoint that the order of two mentions decides, over whole texts."""
    point = op.Checkpoint("turn", ("ing",), (), "cases", cases=ORDERED)
    return view(spark, d, "documents").select("doc_id", op.status(point, F.col("text")).alias("status"))


_ARTIFACTS = "CASE professional_attribution " + " ".join(f"WHEN '{k}' THEN {sql_list(p.artifacts)}" for k, p in PROFILES.items()) + " END"


@query("e1_attributed_checkpoints", _WHOLE + f"SELECT row_index, item_index, array_to_string(n, ',') AS names, array_to_string(list_transform(n, lambda x, i: CASE WHEN len(t) > 0 THEN st[i] WHEN contains(lower(e), lower(x)) THEN 'covered' ELSE 'missing' END), ',') AS statuses FROM (SELECT b.row_index, b.item_index, t, a.e, st, CASE WHEN len(t) > 0 THEN names ELSE {_ARTIFACTS} END AS n FROM bundle b JOIN a USING (row_index, item_index))")
def e1a(spark, d):
    """Opinions that trigger no checkpoint are checked for what their attribution requires."""
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("row_index"), F.col("text").alias("evidence"))
    rows = op.assess(attributed(spark, d).join(docs, "row_index", "left"), POINTS, F.col("required_artifacts"))
    each = lambda f: F.array_join(F.transform("assessments", lambda a: a[f]), ",")
    return rows.select("row_index", "item_index", each("name").alias("names"), each("status").alias("statuses"))


@query("e3_alignment", ctes("v_opinions", more=ALIGN) + "SELECT row_index, item_index, alignment FROM v")
def e3(spark, d):
    return assessed(spark, d).select("row_index", "item_index", "alignment")


@query("u5_point_sets", ctes("v_opinions", more=ALIGN) + "SELECT row_index, item_index, array_to_string(list_filter(names, lambda n, i: st[i] = 'covered'), ',') AS covered, array_to_string(list_filter(names, lambda n, i: st[i] = 'missing'), ',') AS absent FROM v")
def u5(spark, d):
    return assessed(spark, d).select("row_index", "item_index", F.array_join("covered", ",").alias("covered"), F.array_join("absent", ",").alias("absent"))


@query("a11_status_distribution", ctes("v_opinions", more=ALIGN) + "SELECT concat('conv_', CAST(row_index AS VARCHAR)) AS project_name, concat('{', string_agg(concat('\"', alignment, '\":', CAST(n AS VARCHAR)), ',' ORDER BY alignment), '}') AS statuses FROM (SELECT row_index, alignment, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1")
def a11(spark, d):
    return op.status_distribution(assessed(spark, d))


_OPEN = ALIGN.replace("LEFT JOIN documents x ON x.doc_id = v.row_index", "LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') x ON x.doc_id = v.row_index")


@query("a2_gap_report", ctes("v_opinions", more=_OPEN) + "SELECT concat('conv_', CAST(row_index AS VARCHAR)) AS project_name, count(*) AS total, count(*) FILTER (WHERE alignment = 'undecided') AS unresolved, count(*) FILTER (WHERE alignment = 'undecided' AND e = '') AS without_evidence FROM v GROUP BY 1 HAVING unresolved > 0")
def a2(spark, d):
    """Projects whose source is in a language that was not collected have no evidence."""
    docs = view(spark, d, "documents").where("lang <> 'fr'")
    rows = assessed(spark, d, docs).withColumn("work_category", F.lit("all"))
    return op.gap_report(rows).select("project_name", "total", "unresolved", "without_evidence")


_REASON = "CASE WHEN row_index % 5 = 0 THEN 'no_file' WHEN e = '' AND row_index % 7 < 3 THEN 'mismatch' WHEN e = '' THEN 'no_evidence' WHEN len(names) = 0 THEN 'no_checkpoint' ELSE 'review' END"
_FILE = "CASE WHEN row_index % 5 <> 0 THEN concat('file ', CAST(row_index % 3 AS VARCHAR), '.', CAST(item_index % 2 AS VARCHAR)) END"


@query("a2_gap_reasons", ctes("v_opinions", more=ALIGN) + f"""SELECT project_name, count(*) AS total, count(*) FILTER (WHERE o) AS unresolved, round(count(*) FILTER (WHERE o) / count(*), 9) AS ratio, coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (WHERE o AND f IS NOT NULL)), ','), '') AS matched_files,
 {', '.join(f"count(*) FILTER (WHERE o AND r = '{r}') AS {n}" for r, n in (('no_file', 'without_file'), ('mismatch', 'mismatched'), ('no_evidence', 'without_evidence'), ('review', 'to_review')))}, min_by(r, item_index) FILTER (WHERE o) AS needed
 FROM (SELECT concat('conv_', CAST(row_index AS VARCHAR)) AS project_name, item_index, alignment = 'unresolved' OR alignment = 'partly_resolved' AS o, {_REASON} AS r, {_FILE} AS f FROM v) GROUP BY 1 HAVING unresolved > 0""")
def a2r(spark, d):
    """Every reason: what is open is what is not resolved; files are matched to four projects in five, some of them poorly."""
    n = F.col("row_index")
    rows = assessed(spark, d).withColumns({"work_category": F.lit("all"), "matched_file": F.when(n % 5 != 0, F.concat(F.lit("file "), (n % 3).cast("string"), F.lit("."), (F.col("item_index") % 2).cast("string"))), "match_score": F.when(n % 7 < 3, 0.3).otherwise(0.9)})
    rows = rows.withColumn("alignment", F.when(F.col("alignment").isin("unresolved", "partly_resolved"), "open").otherwise(F.col("alignment")))
    back = F.create_map(*[F.lit(x) for k, v in op.NEEDED.items() for x in (v, k)])
    found = op.gap_report(rows, "open").withColumn("needed", back[F.col("needed_source")])
    return found.select("project_name", "total", "unresolved", F.round("ratio", 9).alias("ratio"), "matched_files", "without_file", "mismatched", "without_evidence", "to_review", "needed")


@query("k6_group_order", ctes("v_opinions", more=ALIGN) + "SELECT project_name, unresolved FROM (SELECT concat('conv_', CAST(row_index AS VARCHAR)) AS project_name, count(*) FILTER (WHERE alignment = 'partly_resolved') AS unresolved FROM v GROUP BY 1) WHERE unresolved > 0 ORDER BY unresolved DESC, project_name")
def k6(spark, d):
    by = op.gap_report(assessed(spark, d).withColumn("work_category", F.lit("all")), "partly_resolved").select("project_name", "unresolved")
    return by.orderBy(F.desc("unresolved"), "project_name")


@query("a1_facets", ctes("v_opinions", more=COUNTS) + "SELECT 'pattern' AS facet, code AS value, count(*) AS n FROM hit GROUP BY 2 UNION ALL SELECT 'project_name', project_name, count(*) FROM v_opinions GROUP BY 2")
def a1(spark, d):
    rows = opinions(spark, d).withColumn("pattern", F.filter(lx.labels(F.col("opinion"), FAMILIES, ""), lambda x: x != ""))
    return op.facets(rows, ["project_name"], ["pattern"])


_FACETS = ("dimension", "work_category", "problem_pattern", "professional_attribution", "risk_if_ignored", "confidence")


@query("a1_all_facets", BUNDLED + " UNION ALL ".join(["SELECT 'project_name' AS facet, project_name AS value, count(*) AS n FROM bundle GROUP BY 2", *[f"SELECT '{f}', {f}, count(*) FROM bundle GROUP BY 2" for f in _FACETS], "SELECT 'review_intents', x, count(*) FROM (SELECT unnest(string_split(review_intents, ',')) AS x FROM bundle) GROUP BY 2"]))
def a1f(spark, d):
    rows = attributed(spark, d).withColumn("confidence", F.when(F.size("secondary") == 0, "medium").otherwise("high"))
    return op.facets(rows, ["project_name", *_FACETS], ["review_intents"])


def _examples(column: str, k: int) -> str:
    return BUNDLED + f"SELECT {column}, count(*) AS n, array_to_string(list(project_name ORDER BY row_index, item_index)[1:{k}], ',') AS examples FROM bundle GROUP BY 1"


@query("a3_pattern_examples", _examples("problem_pattern", 5))
def a3p(spark, d):
    rows = op.with_examples(attributed(spark, d), "problem_pattern", ["row_index", "item_index"], 5, ["project_name", "opinion", "root_cause"])
    return rows.select("problem_pattern", "n", F.array_join(F.transform("examples", lambda e: e["project_name"]), ",").alias("examples"))


@query("a3_attribution_examples", _examples("professional_attribution", 6))
def a3a(spark, d):
    rows = op.with_examples(attributed(spark, d), "professional_attribution", ["row_index", "item_index"], 6, ["project_name", "opinion", "engineer_question"])
    return rows.select("professional_attribution", "n", F.array_join(F.transform("examples", lambda e: e["project_name"]), ",").alias("examples"))


_TOP = "(SELECT work_category, string_agg(concat({c}, ':', CAST(n AS VARCHAR)), ',' ORDER BY n DESC, s) AS t FROM (SELECT *, row_number() OVER (PARTITION BY work_category ORDER BY n DESC, s) AS k FROM (SELECT work_category, {c}, count(*) AS n, min((row_index, item_index)) AS s FROM bundle GROUP BY 1, 2)) WHERE k <= {k} GROUP BY 1)"


@query("a3_category_methods", BUNDLED + f"SELECT work_category, n, p.t AS top_patterns, q.t AS top_dimensions FROM (SELECT work_category, count(*) AS n FROM bundle GROUP BY 1) JOIN {_TOP.format(c='problem_pattern', k=5)} p USING (work_category) JOIN {_TOP.format(c='dimension', k=4)} q USING (work_category)")
def a3c(spark, d):
    rows = op.category_methods(attributed(spark, d), ["row_index", "item_index"])
    text = lambda n: F.array_join(F.transform(n, lambda s: F.concat_ws(":", s["code"], s["n"].cast("string"))), ",").alias(n)
    return rows.select("work_category", "n", text("top_patterns"), text("top_dimensions"))


@query("a3_methodology", ctes("v_opinions", more=f"{COUNTS}, one AS (SELECT v.row_index, v.item_index, project_name, coalesce(code, 'judgement') AS pattern FROM v_opinions v LEFT JOIN (SELECT * FROM hit WHERE k = 1) h ON h.row_index = v.row_index AND h.item_index = v.item_index)") + "SELECT project_name, pattern, n, place FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY n DESC, pattern) AS place FROM (SELECT project_name, pattern, count(*) AS n FROM one GROUP BY 1, 2)) WHERE place <= 5")
def a3(spark, d):
    rows = opinions(spark, d).withColumn("pattern", lx.top_label(F.col("opinion"), FAMILIES, "judgement"))
    return op.top_values(rows, "project_name", "pattern", 5)


@query("w3_first_rows", ctes("v_opinions") + "SELECT project_name, row_index, item_index, place FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY row_index, item_index) AS place FROM v_opinions) WHERE place <= 2")
def w3(spark, d):
    return op.first_rows(opinions(spark, d), "project_name", ["row_index", "item_index"], 2).select("project_name", "row_index", "item_index", "place")


@query("w4_latest_corrections", "SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS k FROM conversations) WHERE k <= 3")
def w4(spark, d):
    return rt.top(view(spark, d, "conversations"), 3, [F.desc("conv_id"), F.desc("turn")], "role", "k").select("role", "conv_id", "turn")


_BEST = "(SELECT project_name, n FROM (SELECT project_name, sum({e}) AS n FROM v_opinions GROUP BY 1) WHERE n > 0 {w} ORDER BY n DESC, project_name LIMIT 1)"
_OCC = lambda w: f"CAST((length(opinion) - length(replace(opinion, '{w}', ''))) / {len(w)} AS BIGINT)"


@query("a15_representatives", ctes("v_opinions", more=f"one AS {_BEST.format(e=_OCC('tion'), w='')}, two AS {_BEST.format(e=_OCC('que'), w='AND project_name NOT IN (SELECT project_name FROM one)')}") + "SELECT 'nouns' AS spec, project_name FROM one UNION ALL SELECT 'clauses', project_name FROM two")
def a15(spark, d):
    picks = op.representatives(opinions(spark, d), [("nouns", ("tion",)), ("clauses", ("que",))])
    return spark.createDataFrame(picks, "spec string, project_name string")


@query("a16_benchmark_cases", ctes("v_opinions", more=f"one AS {_BEST.format(e=_OCC('tion'), w='')}") + "SELECT project_name, count(*) AS n, string_agg(opinion, '|' ORDER BY item_index) AS opinions FROM v_opinions WHERE project_name IN (SELECT project_name FROM one) GROUP BY 1")
def a16(spark, d):
    rows = opinions(spark, d)
    picks = spark.createDataFrame(op.representatives(rows, [("nouns", ("tion",))]), "spec string, project_name string")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_index", "opinion"))), lambda s: s["opinion"]), "|")
    return rows.join(picks, "project_name", "left_semi").groupBy("project_name").agg(F.count("*").alias("n"), text.alias("opinions"))


@query("a16_case_facets", ctes("v_opinions", more=f"{COUNTS}, {MATCH}, {KINDS}, one AS {_BEST.format(e=_OCC('tion'), w='')}, two AS {_BEST.format(e=_OCC('que'), w='AND project_name NOT IN (SELECT project_name FROM one)')}, pick AS (SELECT 'nouns' AS spec, project_name FROM one UNION ALL SELECT 'clauses', project_name FROM two)") + "SELECT spec, project_name, count(*) AS n, array_to_string(list_sort(list(DISTINCT dimension)), ',') AS dimensions, array_to_string(list_sort(list(DISTINCT work_category)), ',') AS work_categories FROM pick JOIN full_cards USING (project_name) GROUP BY 1, 2")
def a16f(spark, d):
    cases = op.benchmark_cases(classified(spark, d), [("nouns", ("tion",)), ("clauses", ("que",))])
    return cases.select("spec", "project_name", F.size("opinions").cast("long").alias("n"), F.array_join("dimensions", ",").alias("dimensions"), F.array_join("work_categories", ",").alias("work_categories"))


EVIDENCE = f"""kw AS (SELECT row_index, item_index, opinion, {sql_words('opinion')} AS k FROM v_opinions),
hit AS (SELECT row_index, item_index, k, line_no, line, len(list_filter(k, lambda w: contains(lower(line), lower(w)))) AS hits FROM kw JOIN v_lines ON doc_id = row_index
 WHERE NOT (contains(line, 'the') AND NOT contains(opinion, 'tion'))),
ev AS (SELECT *, row_number() OVER (PARTITION BY row_index, item_index ORDER BY hits DESC, length(line), line_no) AS place FROM hit WHERE hits > 0)"""


_AROUND = r"""sn AS (SELECT *, length(t) AS n, list_min(list_filter(list_transform(k, lambda w: instr(lower(t), lower(w))), lambda p: p > 0)) AS f FROM (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM ev WHERE place <= 3)),
sw AS (SELECT *, greatest(0, f - 201) AS a, least(n, greatest(0, f - 201) + 600) AS z FROM sn),
sx AS (SELECT *, CASE WHEN z - a < 600 THEN greatest(0, z - 600) ELSE a END AS g FROM sw)"""


@query("j11_evidence_lines", ctes("v_opinions", "v_lines", more=f"{EVIDENCE}, {_AROUND}") + "SELECT row_index, item_index, line_no, CAST(hits AS INT) AS match_score, place, CAST(row_index AS VARCHAR) AS source_file, concat('line ', CAST(line_no + 1 AS VARCHAR)) AS location, array_to_string(list_filter(k, lambda w: contains(lower(line), lower(w)))[1:6], ',') AS matched_keywords, CASE WHEN n <= 600 THEN t WHEN f IS NULL THEN left(t, 600) ELSE concat(CASE WHEN g > 0 THEN '...' ELSE '' END, substring(t, g + 1, z - g), CASE WHEN z < n THEN '...' ELSE '' END) END AS text FROM sx")
def j11(spark, d):
    rows = opinions(spark, d).withColumn("keywords", words(F.col("opinion")))
    lines = view(spark, d, "v_lines").withColumnRenamed("doc_id", "row_index")
    found = op.snippets(op.evidence(rows, lines, "row_index", noise=[("the", "tion")]), "row_index")
    return found.select("row_index", "item_index", "line_no", "match_score", "place", "source_file", "location", F.array_join("matched_keywords", ",").alias("matched_keywords"), "text")


@query("f5_evidence_noise", ctes("v_lines", "v_opinions") + "SELECT row_index, item_index, line_no FROM v_opinions JOIN v_lines ON doc_id = row_index WHERE contains(line, 'the') AND NOT contains(opinion, 'tion')")
def f5(spark, d):
    lines = view(spark, d, "v_lines").withColumnRenamed("doc_id", "row_index")
    return opinions(spark, d).join(lines, "row_index").where(op.is_noise(F.col("line"), F.col("opinion"), [("the", "tion")])).select("row_index", "item_index", "line_no")


@query("j12_evidence_fallback", ctes("v_opinions", "v_lines", more=EVIDENCE.replace("\n WHERE NOT (contains(line, 'the') AND NOT contains(opinion, 'tion'))", "") + ", sn AS (SELECT row_index, item_index, string_agg(line, ' ' ORDER BY place) AS s FROM ev WHERE place <= 3 GROUP BY 1, 2)") + "SELECT v.row_index, v.item_index, md5(CASE WHEN s IS NOT NULL THEN s WHEN v.row_index % 2 = 0 THEN coalesce(text, '') ELSE '' END) AS evidence FROM v_opinions v LEFT JOIN sn ON sn.row_index = v.row_index AND sn.item_index = v.item_index LEFT JOIN documents ON doc_id = v.row_index")
def j12(spark, d):
    rows = opinions(spark, d).withColumn("keywords", words(F.col("opinion")))
    lines = view(spark, d, "v_lines").withColumnRenamed("doc_id", "row_index")
    texts = view(spark, d, "documents").select(F.col("doc_id").alias("row_index"), "text")
    out = op.with_evidence(rows, lines, texts, "row_index", ["row_index", "item_index"], F.col("row_index") % 2 == 0)
    return out.select("row_index", "item_index", F.md5("evidence").alias("evidence"))


@query("j6_same_project", ctes("v_opinions") + "SELECT DISTINCT a.project_name AS a, b.c AS b FROM v_opinions a, (SELECT DISTINCT concat('conv_', CAST(doc_id AS VARCHAR)) AS c FROM documents) b WHERE contains(a.project_name, b.c) OR contains(b.c, a.project_name)")
def j6(spark, d):
    docs = view(spark, d, "documents").select(F.concat(F.lit("conv_"), F.col("doc_id")).alias("b"))
    a, b = opinions(spark, d).select(F.col("project_name").alias("a")).distinct(), docs.distinct()
    return sc.containing(a, b)


@query("j7_fuzzy_edit", """
WITH a AS (SELECT DISTINCT p_name AS a FROM part), b AS (SELECT DISTINCT concat(p_name, ' ', p_type) AS b FROM part),
s AS (SELECT a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS score FROM a, b)
SELECT a, b, round(score, 6) AS score, CASE WHEN contains(a, b) OR contains(b, a) THEN 'high' WHEN score >= 0.68 THEN 'medium' ELSE 'low' END AS quality
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS k FROM s WHERE score >= 0.45) WHERE k = 1""")
def j7(spark, d):
    names = view(spark, d, "part")
    best = op.fuzzy_edit(names.select(F.col("p_name").alias("a")), names.select(F.concat_ws(" ", "p_name", "p_type").alias("b")))
    return best.withColumn("score", F.round("score", 6))


@query("j7_fuzzy_ratio")
def j7r(spark, d):
    names = view(spark, d, "part")
    return op.fuzzy(names.select(F.col("p_name").alias("a")), names.select(F.concat_ws(" ", "p_name", "p_type").alias("b")))


def carded(spark, d):
    return op.cards(classified(spark, d))


@query("r8_match_cards", ctes("v_opinions", more=f"{COUNTS}, {MATCH}") + f"SELECT doc_id, card_id, overlap, place FROM (SELECT *, {_PLACE.format(g='doc_id')} AS place FROM m WHERE overlap >= 2) WHERE place <= 8")
def r8(spark, d):
    return op.match_cards(view(spark, d, "documents"), carded(spark, d))


_SHUT = " OR ".join(f"(contains(lo, '{t.lower()}') AND NOT ({' OR '.join(f"contains(lt, '{a.lower()}')" for a in own)}))" for t, own in GUARD)
TIERS = f"""tm AS (SELECT m.*, concat('conv_', CAST(doc_id AS VARCHAR)) AS key, NOT ({_SHUT}) AS ok FROM m JOIN (SELECT DISTINCT card_id, lower(opinion) AS lo FROM cards) USING (card_id) JOIN (SELECT doc_id, lower(text) AS lt FROM documents) USING (doc_id)),
tw AS (SELECT *, contains(key, project_name) OR contains(project_name, key) AS own FROM tm),
tp AS (SELECT *, {_PLACE.format(g='doc_id, own')} AS place FROM tw WHERE own OR (overlap >= 2 AND ok)),
tn AS (SELECT *, count(*) FILTER (WHERE own AND place <= 8) OVER (PARTITION BY doc_id) AS n FROM tp),
tier AS (SELECT doc_id, card_id, overlap, place, CASE WHEN own THEN 'same_project' ELSE 'cross_project' END AS match_scope FROM tn WHERE (own AND place <= 8) OR (NOT own AND n < 4 AND place <= least(4, 8 - n)))"""


@query("r9_two_tier_match", ctes("v_opinions", more=f"{COUNTS}, {MATCH}, {TIERS}") + "SELECT doc_id, card_id, overlap, place, match_scope FROM tier")
def r9(spark, d):
    docs = view(spark, d, "documents").withColumn("project_key", F.concat(F.lit("conv_"), F.col("doc_id")))
    return op.two_tier(docs, carded(spark, d), guard=GUARD)


_REALIGN = ALIGN.replace("src AS (SELECT v.row_index, v.item_index, opinion AS o, coalesce(x.text, '') AS e FROM v_opinions v LEFT JOIN documents x ON x.doc_id = v.row_index)", "src AS (SELECT doc_id AS row_index, card_id AS item_index, opinion AS o, text AS e FROM b8 JOIN cards USING (card_id) JOIN documents USING (doc_id))")


_OLD = ALIGN.replace("src AS (", "osrc AS (").replace("FROM src)", "FROM osrc)")
for _n in "pwav":
    _OLD = _OLD.replace(f"\n{_n} AS (", f"\no{_n} AS (").replace(f"FROM {_n})", f"FROM o{_n})")
_POINT_TEXTS = ", ".join(f"array_to_string(list_filter(names, lambda n, i: st[i] = '{s}'), ',') AS {c}_points" for s, c in (("covered", "covered"), ("vague", "partial"), ("missing", "missing")))


@query("e4_realigned_cards", ctes("v_opinions", more=f"{COUNTS}, {MATCH}, b8 AS (SELECT * FROM (SELECT doc_id, card_id, {_PLACE.format(g='doc_id')} AS place FROM m WHERE overlap >= 2) WHERE place <= 8), {_REALIGN}, {_OLD}, old AS (SELECT DISTINCT card_id, alignment AS source_alignment, {_GAP} AS source_scheme_gap FROM (SELECT *, {_POINT_TEXTS} FROM ov) JOIN cards USING (row_index, item_index))") + f"SELECT row_index AS doc_id, item_index AS card_id, alignment, missing_points AS absent, {_GAP} AS scheme_gap, source_alignment, source_scheme_gap FROM (SELECT *, {_POINT_TEXTS} FROM v) JOIN old ON old.card_id = item_index")
def e4(spark, d):
    docs, cards = view(spark, d, "documents"), ix.kept(op.asked(told_cards(spark, d), POINTS, FALLBACK), "told")
    rows = op.match_cards(docs, carded(spark, d)).join(cards, "card_id").join(op.read(docs.select("doc_id", F.col("text").alias("evidence")), POINTS, FALLBACK), "doc_id")
    return op.realigned(rows, POINTS, FALLBACK).select("doc_id", "card_id", "alignment", F.array_join("absent", ",").alias("absent"), "scheme_gap", "source_alignment", "source_scheme_gap")


def told_cards(spark, d):
    """Whole cards with what a realignment needs of them."""
    names = {"id": "card_id", "source_project": "project_name", "source_opinion": "opinion", "alignment_status": "alignment", "trigger_keywords": "keywords"}
    same = ("scheme_gap", "work_category", "generalization_rule", "confidence")
    return whole_cards(spark, d).select(*[F.col(a).alias(b) for a, b in names.items()], *same)


MARKERS = (":", ",", " the ", ".")
WORDING = {"order": "name the order", "amount": "give a number"}


@query("p21_work_items", ctes("v_opinions") + r"""
, t AS (SELECT row_index, item_index, regexp_replace(opinion, '\s+', '', 'g') AS x FROM v_opinions),
p AS (SELECT *, list_min(list_filter([instr(x, ':'), instr(x, ','), instr(x, '.')], lambda q: q > 1)) AS f FROM t),
s AS (SELECT *, trim(regexp_replace(left(x, f - 1), '^[0-9一二三四五六七八九十]+[、.)）]\s*', ''), ' ，。；:：') AS w FROM p)
SELECT row_index, item_index, CASE WHEN f IS NOT NULL AND length(w) BETWEEN 2 AND 18 THEN w ELSE 'general' END AS work_item FROM s""")
def p21(spark, d):
    return opinions(spark, d).select("row_index", "item_index", op.work_item(F.col("opinion"), (":", ",", "."), F.lit("general")).alias("work_item"))


@query("p22_recommendations", ctes("v_opinions", more=ALIGN + ", r AS (SELECT row_index, item_index, list_filter(names, lambda n, i: st[i] = 'vague') AS pa, list_filter(names, lambda n, i: st[i] = 'missing') AS ab FROM v)") + """
SELECT row_index, item_index, concat_ws(chr(10), CASE WHEN len(pa) > 0 THEN concat('make exact: ', array_to_string(pa, ', ')) END, CASE WHEN len(ab) > 0 THEN concat('add: ', array_to_string(ab, ', ')) END,
 CASE WHEN len(list_intersect(list_concat(pa, ab), ['order', 'amount'])) > 0 THEN concat('write: ', array_to_string(list_transform(list_filter(list_concat(pa, ab), lambda n: n IN ('order', 'amount')), lambda n: CASE n WHEN 'order' THEN 'name the order' ELSE 'give a number' END), '; ')) END, 'as built') AS text FROM r""")
def p22(spark, d):
    rows = assessed(spark, d)
    return rows.select("row_index", "item_index", op.recommendation(F.col("partial"), F.col("absent"), WORDING, F.lit("as built")).alias("text"))


@query("e5_card_findings")
def e5(spark, d):
    docs, cards = view(spark, d, "documents").withColumn("project_key", F.concat(F.lit("conv_"), F.col("doc_id"))), carded(spark, d)
    said = ix.kept(op.worded(op.asked(cards.select("card_id", "opinion", "work_category"), POINTS, FALLBACK), MARKERS, "price|cost"), "said")
    hit = op.two_tier(docs, cards, guard=GUARD).join(said, "card_id").join(op.read(docs.select("doc_id", F.col("text").alias("evidence")), POINTS, FALLBACK), "doc_id")
    return op.card_findings(op.assess(hit, POINTS, FALLBACK), MARKERS, WORDING, "price|cost").select("doc_id", "card_id", "work_item", "alignment", "recommendation")


@query("r10_experience_search")
def r10(spark, d):
    """What was found for each query, aligned to the document of the query's number and summarised."""
    docs = view(spark, d, "documents")
    asked = view(spark, d, "v_queries").withColumn("doc_id", F.col("query_id"))
    return op.experience_summaries(asked, told_cards(spark, d), docs, POINTS, FALLBACK)


@query("r11_evidence_fetch")
def r11(spark, d):
    queries = view(spark, d, "v_queries")
    kind = F.when(F.col("query_id") % 3 == 0, "standards").when(F.col("query_id") % 3 == 1, "experience").otherwise("snippet")
    actions = queries.select(F.col("query_id").alias("doc_id"), "query_id", kind.alias("tool"), "query")
    found = rt.answers(queries, rt.retrieve(queries, placed(spark, d), stop=STOP, index=rule_index(spark, d)))
    summaries = op.experience_summaries(queries.withColumn("doc_id", F.col("query_id")), told_cards(spark, d), view(spark, d, "documents"), POINTS, FALLBACK)
    return op.fetch(actions, found, summaries, view(spark, d, "documents")).select("doc_id", "query_id", "tool", F.md5("answer").alias("answer"))


# --- findings ---


@query("u3_keep_first", ctes("v_findings") + "SELECT doc_id, issue_no, dimension FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY issue_no) AS k FROM v_findings) WHERE k = 1")
def u3(spark, d):
    return au.keep_first(view(spark, d, "v_findings"), ["doc_id", "dimension"], ["issue_no"]).select("doc_id", "issue_no", "dimension")


#: Findings f (doc_id, issue_no, work_item, dimension, finding, has_controls, origin) taken in order, each against those kept.
GREEDY = rf"""fx AS MATERIALIZED (SELECT *, regexp_replace(coalesce(finding, ''), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+', '', 'g') AS x, list_filter({sql_list(TERMS)}, lambda w: contains(lower(coalesce(finding, '')), w)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY issue_no) AS k FROM f),
kept(doc_id, k, l) AS (
 SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(no BIGINT, x VARCHAR, t VARCHAR[], w VARCHAR, d VARCHAR, c BOOLEAN)[]) FROM fx
 UNION ALL SELECT doc_id, k, CASE WHEN len(list_filter(l, lambda e: (e.w = w AND e.d = d AND left(e.x, 32) = left(x, 32)) OR (e.x <> '' AND x <> '' AND (contains(x, e.x) OR contains(e.x, x)))
   OR (len(list_intersect(e.t, t)) >= 2 AND ((ai AND e.c) OR len(list_intersect(e.t, t)) >= CASE WHEN e.w = w AND e.d = d THEN 3 ELSE 4 END)))) > 0 THEN l
  ELSE list_append(l, {{'no': no, 'x': x, 't': t, 'w': w, 'd': d, 'c': c}}) END
 FROM (SELECT kept.doc_id, fx.k, l, CAST(fx.issue_no AS BIGINT) AS no, fx.x, fx.t, fx.work_item AS w, fx.dimension AS d, fx.has_controls AS c, starts_with(fx.origin, 'ai_') AS ai FROM kept JOIN fx ON fx.doc_id = kept.doc_id AND fx.k = kept.k + 1)),
chosen AS (SELECT doc_id, unnest(l).no AS issue_no FROM (SELECT doc_id, max_by(l, k) AS l FROM kept GROUP BY 1))"""


@query("u4_semantic_dedupe", ctes("v_findings", more="f AS (SELECT * FROM v_findings), " + GREEDY, recursive=True) + "SELECT doc_id, issue_no FROM chosen")
def u4(spark, d):
    return au.semantic_dedupe(view(spark, d, "v_findings"), TERMS).select("doc_id", "issue_no")


_DET = f"t AS (SELECT *, list_filter({sql_list(TERMS)}, lambda w: contains(lower(finding), w)) AS t FROM v_findings), det AS (SELECT DISTINCT doc_id, unnest(t) AS w FROM t WHERE has_controls)"


@query("j14_prefer_detailed", ctes("v_findings", more=_DET) + "SELECT doc_id, issue_no FROM t WHERE has_controls OR NOT EXISTS (SELECT 1 FROM det WHERE det.doc_id = t.doc_id AND list_contains(t.t, det.w))")
def j14(spark, d):
    return au.prefer_detailed(view(spark, d, "v_findings"), TERMS).select("doc_id", "issue_no")


@query("j10_reviewer_decisions", ctes("v_findings") + "SELECT doc_id, issue_no, CASE WHEN issue_no % 5 = 2 THEN 'revised' ELSE dimension END AS dimension FROM v_findings WHERE issue_no % 5 <> 1")
def j10(spark, d):
    rows = view(spark, d, "v_findings")
    first = rows.select("doc_id", F.col("issue_no").alias("candidate_index"), F.lit(1).alias("decision_no"), F.when(F.col("issue_no") % 5 == 1, "Drop").when(F.col("issue_no") % 5 == 2, " revise ").otherwise("keep").alias("action"), F.when(F.col("issue_no") % 5 == 2, "revised").otherwise("").alias("dimension"))
    late = first.withColumn("decision_no", F.lit(2)).withColumn("action", F.lit("drop"))
    return au.decide(rows, first.unionByName(late), ["dimension"]).select("doc_id", "issue_no", "dimension")


@query("a10_group_findings", ctes("v_findings") + "SELECT doc_id, work_item, count(*) AS n, string_agg(CAST(issue_no AS VARCHAR), ',' ORDER BY issue_no) AS issues FROM v_findings GROUP BY 1, 2 UNION ALL SELECT DISTINCT doc_id, 'overall', 0, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v_findings)")
def a10(spark, d):
    rows = au.group(view(spark, d, "v_findings"), view(spark, d, "documents"), ("issue_no",))
    return rows.withColumn("issues", F.array_join(F.transform(F.from_json("issues", "array<struct<issue_no:bigint>>"), lambda s: s["issue_no"].cast("string")), ","))


@query("a14_scorecard", ctes("v_findings", more="t AS (SELECT doc_id, count(*) AS n, string_agg(finding, concat(chr(10), chr(10)) ORDER BY issue_no) AS t FROM v_findings GROUP BY 1)") + f"SELECT doc_id, n, array_to_string(list_filter({sql_list(TERMS)}, lambda w: contains(t, w)), ',') AS found, array_to_string(list_filter({sql_list(TERMS)}, lambda w: NOT contains(t, w)), ',') AS missing, CASE WHEN contains(t, 'license') THEN 'license' ELSE '' END AS forbidden, array_to_string(list_filter(['www', 'der'], lambda w: contains(t, w)), ',') AS suppressed FROM t")
def a14(spark, d):
    return au.scorecard(view(spark, d, "v_findings"), TERMS, ("license",), suppressed=("www", "der"))


@query("a19_failure_notices", ctes("v_findings") + "SELECT doc_id, array_to_string(list_sort(list(DISTINCT dimension))[1:3], ',') AS labels, CAST(count(DISTINCT dimension) AS INT) AS n FROM v_findings WHERE regexp_matches(finding, '^(The|A|En|De)') GROUP BY 1")
def a19(spark, d):
    return au.failure_notices(view(spark, d, "v_findings"), "^(The|A|En|De)", label="dimension", text="finding")


@query("p16_render", ctes("v_findings") + "SELECT doc_id, issue_no, md5(concat('finding: ', finding, chr(10), 'reason: ', dimension, chr(10), 'origin: ', origin)) AS text FROM v_findings")
def p16(spark, d):
    return view(spark, d, "v_findings").select("doc_id", "issue_no", F.md5(au.render()).alias("text"))


@query("p16_render_points", ctes("v_opinions", more=ALIGN) + "SELECT row_index, item_index, concat('finding: ', opinion, chr(10), 'reason: ', alignment, chr(10), 'origin: ', project_name, CASE WHEN len(names) > 0 THEN concat(chr(10), 'points:', chr(10), array_to_string(list_transform(names, lambda n, i: concat('- ', n, ': ', st[i])), chr(10))) ELSE '' END) AS text FROM v JOIN v_opinions USING (row_index, item_index)")
def p16p(spark, d):
    return assessed(spark, d).select("row_index", "item_index", au.render("opinion", "alignment", "project_name", F.col("assessments")).alias("text"))


@query("k5_query_list", ctes("v_findings", more=r"q AS (SELECT doc_id, min(issue_no) AS o, left(regexp_replace(concat(work_item, ' ', finding), '\s+', '', 'g'), 160) AS query FROM v_findings GROUP BY 1, 3)") + "SELECT doc_id, md5(query) AS query, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, query) AS place FROM q) WHERE place <= 6")
def k5(spark, d):
    none = spark.createDataFrame([], "doc_id long, ordinal int, query string")
    return au.query_list(view(spark, d, "v_findings"), none).withColumn("query", F.md5("query"))


@query("p23_answer_arrays", ctes("v_findings") + "SELECT doc_id, issue_no, dimension AS tool FROM v_findings")
def p23(spark, d):
    body = F.concat(F.lit("answer:\n```json\n"), F.to_json(F.array(F.struct(F.col("dimension").alias("tool")))), F.lit("\n```"))
    rows = view(spark, d, "v_findings").select("doc_id", "issue_no", au.json_array(body, "array<struct<tool:string>>").alias("a"))
    return rows.select("doc_id", "issue_no", F.get("a", F.lit(0))["tool"].alias("tool"))


def _answers(spark, d):
    item = F.struct(F.col("dimension").alias("tool"), F.col("finding").alias("query"), F.col("work_item"), "dimension", "finding", F.col("origin").alias("reason"), F.col("work_item").alias("recommendation"))
    return view(spark, d, "v_findings").groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("answer"))


#: The items of the answers as rows, in the order in which they stand in them.
ANSWERED = "an AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dimension, finding, work_item, origin) - 1 AS i FROM v_findings)"


@query("p24_tool_plans", ctes("v_findings", more=ANSWERED + ", ok AS (SELECT doc_id, dimension AS tool, trim(finding) AS q, min(i) AS i FROM an WHERE dimension IN ('complete', 'logic') AND trim(finding) <> '' GROUP BY 1, 2, 3)") + "SELECT doc_id, tool, left(q, 160) AS query, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM ok) WHERE place <= 6")
def p24(spark, d):
    return au.tool_plan(_answers(spark, d), "answer", ("complete", "logic")).select("doc_id", "tool", "query", "place")


@query("p25_answer_findings", ctes("v_findings", more=ANSWERED) + r"SELECT doc_id, CAST(min(i) AS INT) AS issue_no, work_item, CASE WHEN min_by(dimension, i) IN ('complete', 'method') THEN min_by(dimension, i) ELSE 'complete' END AS dimension, 'medium' AS confidence FROM an WHERE regexp_replace(finding, '\s+', '', 'g') <> '' GROUP BY doc_id, work_item, finding")
def p25(spark, d):
    return au.answer_findings(_answers(spark, d), "answer", ("complete", "method")).select("doc_id", "issue_no", "work_item", "dimension", "confidence")


# --- sections and routing ---


@query("s6_located_lines", ctes("v_lines") + "SELECT doc_id, CAST(line_no AS INT) AS line_no, concat('line ', CAST(line_no + 1 AS VARCHAR)) AS location, line FROM v_lines")
def s6(spark, d):
    return sd.located_lines(view(spark, d, "documents"))


@query("s10_cost_context", ctes("v_lines") + "SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS context FROM v_lines WHERE contains(lower(line), 'license') OR contains(lower(line), 'eaux') GROUP BY 1")
def s10(spark, d):
    return sd.cost_context(view(spark, d, "v_lines"), ("license", "eaux")).withColumn("context", F.md5("context"))


@query("f7_file_roles", "SELECT page_id, contains(lower(url), 'ref') OR contains(lower(url), 'html') AS is_cost FROM pages")
def f7(spark, d):
    return view(spark, d, "pages").select("page_id", sd.cost_role(F.col("url"), ("ref", "html")).alias("is_cost"))


_COMPACT = r"regexp_replace(concat(section_type, chr(10), text), '\s+', '', 'g')"


@query("f4_triage", ctes("v_sections") + f"SELECT doc_id, section_no FROM v_sections WHERE length({_COMPACT}) >= 10 AND (section_type <> 'B' OR contains(lower({_COMPACT}), 'tion') OR contains(lower({_COMPACT}), 'ung')) AND (contains(lower({_COMPACT}), 'tion') OR contains(lower({_COMPACT}), 'ung') OR length({_COMPACT}) >= 80)")
def f4(spark, d):
    return view(spark, d, "v_sections").where(au.triage(F.col("section_type"), F.col("text"), ("B",), ("tion", "ung"))).select("doc_id", "section_no")


@query("f8_forward_check", ctes("v_sections") + "SELECT doc_id, section_no FROM v_sections WHERE section_type = 'A' AND (contains(lower(text), 'eau') OR contains(lower(text), 'ing'))")
def f8(spark, d):
    context = F.when(F.col("section_type") == "A", "priced").otherwise(" ")
    return view(spark, d, "v_sections").where(au.forward_check(F.col("text"), context, ("eau", "ing"))).select("doc_id", "section_no")


@query("f9_proximity", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'the')) AND regexp_matches(text, '(the|and)[^.\\n]{0,80}(inst|ouen)[^.\\n]{0,80}(er|an)')")
def f9(spark, d):
    return view(spark, d, "documents").where(tx.contains_any(F.col("text"), ("license", "the")) & F.col("text").rlike(r"(the|and)[^.\n]{0,80}(inst|ouen)[^.\n]{0,80}(er|an)")).select("doc_id")


@query("f14_cost_hints", ctes("v_opinions") + "SELECT row_index, item_index FROM v_opinions WHERE NOT regexp_matches(concat(project_name, ' ', opinion), 'price|cost|tion')")
def f14(spark, d):
    return opinions(spark, d).where(~F.concat_ws(" ", "project_name", "opinion").rlike("price|cost|tion")).select("row_index", "item_index")


@query("f15_line_removal", ctes("v_sections") + "SELECT doc_id, section_no, md5(text) AS text FROM v_sections WHERE NOT (section_type = 'B' AND contains(text, 'er')) AND text <> ''")
def f15(spark, d):
    return au.without_lines(view(spark, d, "v_sections"), "B", "er").select("doc_id", "section_no", F.md5("text").alias("text"))


@query("w8_label_routing", ctes("v_sections", more=f"lex(o, code, w, kw) AS (VALUES {lex_values()}), h AS (SELECT doc_id, section_no, code, o FROM v_sections, lex WHERE len(list_filter(kw, lambda k: contains(lower(text), k))) > 0), l AS (SELECT doc_id, section_no, 'craft' AS label, -2 AS o FROM v_sections UNION ALL SELECT doc_id, section_no, 'accept', -1 FROM v_sections UNION ALL SELECT doc_id, section_no, code, o FROM h)") + "SELECT doc_id, section_no, label, CAST(k - 1 AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY o) AS k FROM l) WHERE k <= 4")
def w8(spark, d):
    return au.route(view(spark, d, "v_sections").select("doc_id", "section_no", "text"), "text", LEX, ("craft", "accept"), 4).select("doc_id", "section_no", "label", "place")


_KIND = "CASE WHEN contains(lower(t), 'license') OR contains(lower(t), 'copyright') THEN 'scope' WHEN contains(lower(t), 'www') OR contains(lower(t), 'mail') OR contains(lower(t), '@') THEN 'method' WHEN contains(t, '%%%') OR contains(t, '|') THEN 'accept' END"
SECTIONS = rf"""tl AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM v_lines), ln AS (SELECT * FROM tl WHERE t <> ''),
kl AS (SELECT *, {_KIND} AS k, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS f FROM ln),
sl AS (SELECT *, sum(CAST(k IS NOT NULL AND NOT f AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM kl),
sec AS (SELECT doc_id, section_no, coalesce(min_by(k, line_no) FILTER (WHERE NOT f AND k IS NOT NULL), 'other') AS section_type, string_agg(t, chr(10) ORDER BY line_no) AS text FROM sl GROUP BY 1, 2)"""


@query("w5_section_split", ctes("v_lines", more=SECTIONS) + "SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, section_type, md5(text) AS text FROM sec")
def w5(spark, d):
    return au.section_lines(view(spark, d, "v_lines"), ALIASES).withColumn("text", F.md5("text"))


MERGED = """nw AS (SELECT *, coalesce(lag(section_type) OVER (PARTITION BY doc_id ORDER BY section_no) <> section_type OR length(text) >= 80, TRUE) AS n FROM {src}),
gr AS (SELECT *, sum(CAST(n AS INT)) OVER (PARTITION BY doc_id ORDER BY section_no) AS g FROM nw),
mrg AS (SELECT doc_id, min(section_no) AS section_no, min(section_type) AS section_type, string_agg(text, chr(10) ORDER BY section_no) AS text FROM gr GROUP BY doc_id, g)"""


@query("w6_merge_short", ctes("v_sections", more=MERGED.format(src="v_sections")) + "SELECT doc_id, section_no, section_type, md5(text) AS text FROM mrg")
def w6(spark, d):
    return au.merge_short(view(spark, d, "v_sections")).withColumn("text", F.md5("text")).select("doc_id", "section_no", "section_type", "text")


@query("a13_complexity", ctes("v_sections") + "SELECT doc_id, array_to_string(list_filter([CASE WHEN sum(length(text)) > 2000 THEN 'long' END, CASE WHEN count(*) >= 5 THEN 'many' END, CASE WHEN bool_or(contains(lower(text), 'license')) THEN 'license' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v_sections GROUP BY 1")
def a13(spark, d):
    docs = view(spark, d, "v_sections").groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("k"), F.max(F.contains(F.lower("text"), F.lit("license"))).alias("l"))
    return au.complexity(docs, [("long", F.col("n") > 2000), ("many", F.col("k") >= 5), ("license", F.col("l"))]).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


#: A document's lines as the audit reads them: trimmed, without row marks, put together.
_READ = r"""ln AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\[第\d+行\]:\s*', ''), '^\s+|\s+$', '', 'g') AS t FROM v_lines),
whole AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line_no) AS text FROM ln WHERE t <> '' GROUP BY 1)"""
_G1 = f"""{_READ}, fired AS ({_FIRED.replace(":src", "whole")}),
f0 AS (SELECT doc_id, 1000 + ordinal AS issue_no, rule_id AS work_item, 'complete' AS dimension, concat_ws(': ', message, nullif(missing, '')) AS finding, FALSE AS has_controls, 'local' AS origin FROM fired),
f AS (SELECT * FROM f0), {GREEDY}"""


@query("g1_local_audit", ctes("v_lines", more=_G1, recursive=True) + "SELECT doc_id, work_item, count(*) AS n, md5(string_agg(concat(CAST(issue_no AS VARCHAR), finding), '|' ORDER BY issue_no)) AS issues FROM f0 JOIN chosen USING (doc_id, issue_no) GROUP BY 1, 2 UNION ALL SELECT doc_id, 'overall', 0, md5('') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f0)")
def g1(spark, d):
    """The audit by rules: conditions on numbers, distances, order and thresholds, from a table."""
    docs = view(spark, d, "documents")
    found = au.run(docs, view(spark, d, "v_lines"), ALIASES, condition_rules(spark), TERMS)
    shape = "array<struct<issue_no:int,finding:string>>"
    listed = F.array_join(F.transform(F.from_json("issues", shape), lambda x: F.concat(x["issue_no"].cast("string"), x["finding"])), "|")
    return found.select("doc_id", "work_item", "n", F.md5(listed).alias("issues"))


@query("g1_audit_with_experience")
def g1x(spark, d):
    docs, cards = view(spark, d, "documents"), carded(spark, d)
    hit = op.match_cards(docs, cards, limit=8).join(cards.select("card_id", "opinion", "work_category"), "card_id")
    return au.run(docs, view(spark, d, "v_lines"), ALIASES, FINDINGS, TERMS, hit)


@query("g2_cross_consistency", ctes("v_sections") + "SELECT doc_id FROM v_sections GROUP BY 1 HAVING bool_or(section_type = 'A' AND contains(lower(text), 'license')) AND bool_or(section_type = 'B' AND (contains(lower(text), 'eau') OR contains(lower(text), 'the')))")
def g2(spark, d):
    by = view(spark, d, "v_sections").groupBy("doc_id").agg(F.max((F.col("section_type") == "A") & tx.contains_any(F.col("text"), ("license",))).alias("a"), F.max((F.col("section_type") == "B") & tx.contains_any(F.col("text"), ("eau", "the"))).alias("b"))
    return by.where("a and b").select("doc_id")


@query("g3_routing_pass", ctes("v_sections", more=f"ok AS (SELECT * FROM v_sections WHERE length({_COMPACT}) >= 10 AND (section_type <> 'B' OR contains(lower({_COMPACT}), 'tion') OR contains(lower({_COMPACT}), 'ung')) AND (contains(lower({_COMPACT}), 'tion') OR contains(lower({_COMPACT}), 'ung') OR length({_COMPACT}) >= 80)), lex(o, code, w, kw) AS (VALUES {lex_values()})") + "SELECT doc_id, section_type, label, count(*) AS n FROM (SELECT doc_id, section_no, section_type, 'craft' AS label FROM ok UNION ALL SELECT doc_id, section_no, section_type, code FROM ok, lex WHERE len(list_filter(kw, lambda k: contains(lower(text), k))) > 0) GROUP BY 1, 2, 3")
def g3(spark, d):
    rows = view(spark, d, "v_sections").where(au.triage(F.col("section_type"), F.col("text"), ("B",), ("tion", "ung")))
    return au.route(rows, "text", LEX, ("craft",), 99).groupBy("doc_id", "section_type", "label").agg(F.count("*").alias("n"))


# --- bills and sheets ---


@query("s8_bill_items", ctes("v_cells", more="i AS (SELECT sheet, row, max(value) FILTER (WHERE col = 1) AS name, max(value) FILTER (WHERE col = 2) AS q, max(value) FILTER (WHERE col = 3) AS p FROM v_cells WHERE row > 2 GROUP BY 1, 2)") + "SELECT sheet, row, name, CASE WHEN try_cast(q AS DOUBLE) IS NULL OR try_cast(p AS DOUBLE) IS NULL THEN 1.0 ELSE CAST(q AS DOUBLE) END AS quantity, CASE WHEN try_cast(q AS DOUBLE) IS NULL OR try_cast(p AS DOUBLE) IS NULL THEN 0.0 ELSE CAST(p AS DOUBLE) END AS price FROM i")
def s8(spark, d):
    return sd.bill_items(view(spark, d, "v_cell_rows"))


@query("s9_sheet_sections")
def s9(spark, d):
    return sd.sheet_sections(view(spark, d, "v_cell_rows"), (lx.Entry("head", keywords=("名称",)), lx.Entry("red", keywords=("red",)))).withColumn("text", F.md5("text"))


@query("j5_price_ceilings", ctes("v_bill") + "SELECT bill_id, row_no, keyword, CASE WHEN ceiling = 0 THEN 'RED' ELSE 'YELLOW' END AS level FROM v_bill, (VALUES ('red', 950.0), ('PROMO', 0.0)) AS t(keyword, ceiling) WHERE contains(name, keyword) AND (ceiling = 0 OR price > ceiling)")
def j5(spark, d):
    return sd.over_ceiling(view(spark, d, "v_bill"), PRICES).select("bill_id", "row_no", "keyword", "level")


@query("s7_html_sections")
def s7(spark, d):
    return sd.html_sections(view(spark, d, "pages")).select("page_id", "section_no", "heading", F.length("text").alias("n_chars"))


@query("s3_rule_json", ctes("v_rules") + "SELECT count(*) AS loaded, count(*) FILTER (WHERE rule_id % 7 <> 0) AS stored FROM v_rules")
def s3(spark, d):
    lines = view(spark, d, "v_rules").select(F.to_json(F.struct(F.when(F.col("rule_id") % 7 != 0, F.col("rule_id").cast("string")).alias("rule_id"), "category")).alias("j"))
    return sd.rules_text(lines, "j", "rule_id string, category string")[1]


@query("s4_source_mapping", "SELECT concat('cust_', CAST(o_custkey AS VARCHAR)) AS project_name, max_by(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END, o_orderkey) AS path FROM orders GROUP BY 1")
def s4(spark, d):
    rows = view(spark, d, "orders").select(F.concat(F.lit("cust_"), F.col("o_custkey")).alias("project_name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(" ").alias("a"), F.col("o_orderstatus").alias("b"), "o_orderkey")
    return sd.mapping(rows, ["a", "b"], "o_orderkey")


@query("s3_rule_json_file", "SELECT count(*) AS loaded, count(*) FILTER (WHERE doc_id % 7 <> 0) AS stored FROM documents")
def s3f(spark, d):
    path = shared_path(spark, "rules_json")
    view(spark, d, "documents").select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("rule_id"), "text").write.json(path)
    return sd.rules_json(spark, path, "rule_id string, text string", lines=True)[1]


@query("s4_mapping_file", "SELECT concat('cust_', CAST(o_custkey AS VARCHAR)) AS project_name, max_by(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END, o_orderkey) AS path FROM orders GROUP BY 1")
def s4f(spark, d):
    path = shared_path(spark, "mapping") + ".csv"
    view(spark, d, "orders").select(F.concat(F.lit("cust_"), F.col("o_custkey")).alias("project_name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("a"), F.col("o_orderstatus").alias("b"), "o_orderkey").write.option("header", True).csv(path)
    return sd.mapping(sd.read_mapping(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long")), ["a", "b"], "o_orderkey")


@query("s5_inventory", "SELECT 'part' AS kind, CAST(count(DISTINCT r_name) AS INT) AS files FROM region")
def s5(spark, d):
    path = shared_path(spark, "files")
    view(spark, d, "region").select("r_name", "r_regionkey").write.partitionBy("r_name").json(path)
    return sd.inventory(spark, path, "part-*").agg(F.lit("part").alias("kind"), F.count("*").cast("int").alias("files"))


@query("s16_registry", "SELECT page_id, url AS path, CASE WHEN page_id % 4 = 0 THEN 'a' ELSE 'b' END AS category FROM pages WHERE url <> '' AND page_id % 4 IN (0, 1)")
def s16(spark, d):
    path = shared_path(spark, "registry")
    kind = F.when(F.col("page_id") % 4 == 0, "a").when(F.col("page_id") % 4 == 1, "b").when(F.col("page_id") % 4 == 2, "")
    view(spark, d, "pages").select("page_id", F.col("url").alias("path"), kind.alias("category")).write.json(path)
    return sd.registry_jobs(spark.read.schema("page_id long, path string, category string").json(path))


# --- structure ---

LEAVES = """tree AS (SELECT node_id, title, text, [title] AS path, 1 AS depth FROM v_tree WHERE parent_id IS NULL UNION ALL SELECT v.node_id, v.title, v.text, list_append(tree.path, v.title), depth + 1 FROM v_tree v JOIN tree ON v.parent_id = tree.node_id),
leaf AS (SELECT * FROM tree WHERE trim(text) <> '' AND node_id NOT IN (SELECT parent_id FROM v_tree WHERE parent_id IS NOT NULL))"""


@query("d2_tree_leaves", ctes("v_tree", more=LEAVES, recursive=True) + "SELECT node_id, array_to_string(path, '>') AS path, depth FROM leaf")
def d2(spark, d):
    return st.leaves(view(spark, d, "v_tree"), spark).select("node_id", F.array_join("path", ">").alias("path"), "depth")


@query("d3_tree_chunks", ctes("v_tree", more=LEAVES, recursive=True) + "SELECT node_id, array_to_string(path, ' > ') AS heading, text FROM leaf WHERE length(trim(text)) >= 15")
def d3(spark, d):
    return st.chunks(st.leaves(view(spark, d, "v_tree"), spark))


@query("f6_front_matter", ctes("v_tree", more=LEAVES, recursive=True) + "SELECT node_id FROM leaf WHERE lower(path[len(path)]) NOT IN ('preface', 'cover') AND lower(path[1]) NOT IN ('preface', 'cover')")
def f6(spark, d):
    return st.leaves(view(spark, d, "v_tree"), spark).where(~st.front_matter(F.col("path"))).select("node_id")


@query("a12_tree_statistics", ctes("v_tree", more=LEAVES, recursive=True) + "SELECT count(*) AS nodes, max(depth) AS max_depth FROM tree")
def a12(spark, d):
    return st.tree_statistics(st.levels(view(spark, d, "v_tree"), spark))


@query("t9_tree_ingestion")
def t9(spark, d):
    return st.tree_records(st.leaves(view(spark, d, "v_tree"), spark), ("balance",), "world").select("rule_id", "title", "content")


@query("t9_tree_job", ctes("v_tree", "v_rules", more=LEAVES, recursive=True) + """SELECT CAST(rule_id AS VARCHAR) AS rule_id, source_file, index_source, CASE WHEN status = 'active' AND index_source <> 'pageindex' AND (source_file = 'en' OR category = 'en') THEN 'inactive' ELSE status END AS status FROM v_rules WHERE source_file <> 'en' OR index_source <> 'pageindex'
UNION ALL SELECT concat('T_', upper(left(sha256(concat('en', chr(10), node_id)), 12))), 'en', 'pageindex', 'active' FROM leaf WHERE lower(path[len(path)]) NOT IN ('preface', 'cover') AND lower(path[1]) NOT IN ('preface', 'cover')""")
def t9j(spark, d):
    rules = view(spark, d, "v_rules").withColumn("rule_id", F.col("rule_id").cast("string"))
    leaf = st.leaves(view(spark, d, "v_tree"), spark)
    return st.ingest(rules, leaf, ("balance",), "en").select("rule_id", "source_file", "index_source", "status")


PAGEQ = r"q AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20) AS fulln, CAST(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_doc_pages GROUP BY 1)"


@query("a6_page_quality", ctes("v_doc_pages", more=PAGEQ) + "SELECT doc_id, pages, fulln AS full_pages, chars, tokens FROM q")
def a6(spark, d):
    return st.page_quality(view(spark, d, "v_doc_pages")).select("doc_id", "pages", F.col("full").alias("full_pages"), "chars", "tokens")


@query("f13_text_layer_gate", ctes("v_doc_pages", more=PAGEQ) + "SELECT doc_id FROM q WHERE chars >= 1000 AND fulln >= pages * 0.2")
def f13(spark, d):
    return st.page_quality(view(spark, d, "v_doc_pages")).where("sufficient").select("doc_id")


_EFFECT = "length(translate(translate(text, chr(10), ''), '|- \t', ''))".replace("\t", "' || chr(9) || '")
_CHUNKS = f"c AS (SELECT doc_id, count(*) AS chunks, sum({_EFFECT}) AS chars, 1 + count(*) % 4 AS pages FROM v_doc_pages GROUP BY 1)"


@query("f13_effective_characters", ctes("v_doc_pages", more=_CHUNKS) + "SELECT doc_id, chunks, CAST(chars AS BIGINT) AS chars, chars >= 50 AND chars >= 20 * pages AS sufficient FROM c")
def f13e(spark, d):
    chunks = view(spark, d, "v_doc_pages")
    return st.chunk_quality(chunks, chunks.groupBy("doc_id").agg((1 + F.count("*") % 4).alias("pages")))


@query("j16_chunk_choice", ctes("v_doc_pages", more=f"a AS (SELECT doc_id, count(*) AS n, sum({_EFFECT}) AS chars FROM v_doc_pages WHERE page_no % 2 = 0 GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM v_doc_pages GROUP BY 1), s AS (SELECT b.doc_id FROM b LEFT JOIN a ON a.doc_id = b.doc_id WHERE NOT coalesce(a.chars >= 1500 AND a.chars >= 50, FALSE) AND b.n > coalesce(a.n, 0))") + "SELECT doc_id, page_no FROM v_doc_pages WHERE page_no % 2 = 0 OR doc_id IN (SELECT doc_id FROM s)")
def j16c(spark, d):
    """The even pages are one parse, all pages another; every document counts as 75 pages, so a parse may be too thin."""
    pages = view(spark, d, "v_doc_pages")
    return st.choose_chunks(pages.where("page_no % 2 = 0"), pages, pages.select("doc_id", F.lit(75).alias("pages")).distinct()).select("doc_id", "page_no")


@query("j16_text_choice", ctes("v_doc_pages") + r", a AS (SELECT doc_id, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS n FROM v_doc_pages WHERE page_no > 1 GROUP BY 1), b AS (SELECT doc_id, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS n FROM v_doc_pages WHERE page_no <= 2 GROUP BY 1), s AS (SELECT b.doc_id FROM b LEFT JOIN a ON a.doc_id = b.doc_id WHERE b.n > coalesce(a.n, -1)) SELECT doc_id, page_no FROM v_doc_pages WHERE page_no > 1 AND doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT doc_id, page_no FROM v_doc_pages WHERE page_no <= 2 AND doc_id IN (SELECT doc_id FROM s)")
def j16(spark, d):
    pages = view(spark, d, "v_doc_pages")
    return st.choose_text(pages.where("page_no > 1"), pages.where("page_no <= 2")).select("doc_id", "page_no")


@query("j15_dense_pages", ctes("v_doc_pages") + ", c AS (SELECT doc_id, max(page_no) + 1 AS n FROM v_doc_pages GROUP BY 1), e AS (SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INT) AS page_no FROM c) SELECT e.doc_id, e.page_no, length(coalesce(text, '')) AS n_chars FROM e LEFT JOIN (SELECT * FROM v_doc_pages WHERE page_no % 3 <> 0) p ON p.doc_id = e.doc_id AND p.page_no = e.page_no")
def j15(spark, d):
    pages = view(spark, d, "v_doc_pages")
    counts = pages.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n"))
    dense = st.densify(pages.where("page_no % 3 <> 0").withColumn("order_no", F.lit(1)), counts)
    return dense.select("doc_id", "page_no", F.length("text").cast("long").alias("n_chars"))


@query("d4_contents_pages", ctes("v_doc_pages") + r", s AS (SELECT doc_id, min(page_no) AS a FROM v_doc_pages WHERE page_no <= 20 AND regexp_matches(text, 'license') GROUP BY 1), r AS (SELECT p.*, a FROM v_doc_pages p JOIN s USING (doc_id) WHERE page_no >= a AND page_no < a + 12), e AS (SELECT doc_id, min(page_no) AS b FROM r WHERE page_no > a AND regexp_matches(regexp_replace(regexp_replace(left(text, 300), '\s+', '', 'g'), '^[^\dA-Za-z一-鿿]+', ''), '^The') GROUP BY 1) SELECT r.doc_id, page_no FROM r LEFT JOIN e ON e.doc_id = r.doc_id WHERE b IS NULL OR page_no < b")
def d4(spark, d):
    return st.contents_pages(view(spark, d, "v_doc_pages"), "license", "^The")


_LEAD = "regexp_replace(regexp_replace(regexp_replace({c}, '[·•…⋯.。:：]+', ' ', 'g'), '\\s+', ' ', 'g'), '^[\\s,，、一\\-—]+|[\\s,，、一\\-—]+$', '', 'g')"
_ENTRY = r"^(\d+(?:\s*\.\s*\d+)*)\s*([一-鿿].+)$"
_APPENDIX = r"^(?:\d+\s*)?(附录\s*[A-Za-zＡ-Ｚａ-ｚ])\s*(.+)$"
_SPECIAL = r"^(本标准用词说明|引用标准名录|附\s*[:：].+)\s*(.*)$"
_IS_APPENDIX = r"regexp_matches(t, '^\d+(?:\s*\.\s*\d+)*\s*附录')"


def _parts(kind: str, pattern: str, where: str) -> str:
    body = _LEAD.format(c=f"regexp_extract(t, '{pattern}', 2)")
    return f"SELECT doc_id, line_no, {kind} AS kind, regexp_extract(t, '{pattern}', 1) AS a, {body} AS body FROM l WHERE regexp_matches(t, '{pattern}'){where}"


TOC = rf"""l AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM v_toc_text WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) >= 3),
m AS ({_parts("1", _ENTRY, f" AND NOT {_IS_APPENDIX}")} UNION ALL {_parts("2", _APPENDIX, "")} UNION ALL {_parts("3", _SPECIAL, f" AND NOT regexp_matches(t, '{_ENTRY}') AND NOT regexp_matches(t, '{_APPENDIX}')")}),
r AS (SELECT *, trim(regexp_replace(body, '((?:\d\s*){{1,3}})\s*$', '')) AS rest, try_cast(regexp_replace(regexp_extract(body, '((?:\d\s*){{1,3}})\s*$', 1), '\s+', '', 'g') AS INT) AS page FROM m),
p AS (SELECT doc_id, line_no, CASE WHEN kind < 3 THEN regexp_replace(a, '\s+', '', 'g') END AS structure, page,
 CASE kind WHEN 1 THEN {_LEAD.format(c="rest")} WHEN 2 THEN trim(concat(regexp_replace(a, '\s+', '', 'g'), ' ', {_LEAD.format(c="rest")})) ELSE trim(concat({_LEAD.format(c="a")}, ' ', rest)) END AS title FROM r),
toc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, structure, title ORDER BY line_no) AS k FROM p WHERE length(title) >= 2) WHERE k = 1)"""


@query("d5_contents_lines", ctes("v_toc_text", more=TOC) + "SELECT doc_id, line_no, structure, title, page FROM toc")
def d5(spark, d):
    return st.parse_lines(view(spark, d, "v_toc_text"))


def _wrapped(spark, d):
    rows = view(spark, d, "v_toc_text")
    parts = F.split(F.regexp_replace("line", r"^([\d.]+) ", "$1 "), " (?=\\.{4})|(?<=\\.) (?=\\d)")
    return rows.select("doc_id", F.posexplode(parts).alias("i", "line"), "line_no").select("doc_id", (F.col("line_no") * 10 + F.col("i")).alias("line_no"), "line")


@query("d6_contents_wrapped")
def d6(spark, d):
    return st.parse_wrapped(_wrapped(spark, d))


def _inline(spark, d):
    return view(spark, d, "v_toc_text").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " ").alias("text"))


@query("d7_contents_inline")
def d7(spark, d):
    return st.parse_inline(_inline(spark, d))


@query("d8_best_parse")
def d8(spark, d):
    lines = view(spark, d, "v_toc_text")
    a = st.parse_lines(lines).withColumnRenamed("line_no", "no")
    b = st.parse_wrapped(_wrapped(spark, d)).withColumnRenamed("line_no", "no")
    c = st.parse_inline(_inline(spark, d))
    return st.best_mode([a, b, c]).select("doc_id", "structure", "title", "page", "mode_no")


@query("d9_contents_accepted", ctes("v_toc_text", more=TOC) + "SELECT doc_id, count(*) AS n, count(page) AS with_page FROM toc GROUP BY 1 HAVING count(*) >= 10 AND count(page) >= 0.75 * count(*)")
def d9(spark, d):
    return st.accepted(st.parse_lines(view(spark, d, "v_toc_text")))


_NORM = r"lower(regexp_replace({c}, '[^\w一-鿿\p{{L}}\p{{N}}]+', '', 'g'))"


@query("j13_contents_alignment", ctes("v_toc", "v_doc_pages") + f"SELECT i.doc_id, item_no, min(page_no) AS found_page FROM v_toc i JOIN v_doc_pages p ON p.doc_id = i.doc_id WHERE {_NORM.format(c='title')} <> '' AND contains({_NORM.format(c='text')}, {_NORM.format(c='title')}) GROUP BY 1, 2")
def j13(spark, d):
    return st.align(view(spark, d, "v_toc"), view(spark, d, "v_doc_pages"))


FILLED = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_no) AS i FROM v_toc),
n AS (SELECT *, last_value(physical_index IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN physical_index IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(physical_index IGNORE NULLS) OVER a AS nv FROM o
 WINDOW b AS (PARTITION BY doc_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY item_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
fl AS (SELECT doc_id, item_no, structure, title, coalesce(physical_index, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN greatest(1, least(nv, pv + i - pi)) WHEN coalesce(pv, nv) IS NOT NULL THEN greatest(1, coalesce(pv, nv)) END) AS filled FROM n)"""


@query("w7_fill_pages", ctes("v_toc", more=FILLED) + "SELECT doc_id, item_no, filled FROM fl")
def w7(spark, d):
    return st.fill(view(spark, d, "v_toc")).select("doc_id", "item_no", "filled")


@query("a18_contents_accuracy", ctes("v_toc", "v_doc_pages") + f"SELECT i.doc_id, item_no, coalesce({_NORM.format(c='title')} <> '' AND contains({_NORM.format(c='text')}, {_NORM.format(c='title')}), FALSE) AS ok FROM v_toc i LEFT JOIN v_doc_pages p ON p.doc_id = i.doc_id AND p.page_no = i.physical_index")
def a18(spark, d):
    return st.verify(view(spark, d, "v_toc"), view(spark, d, "v_doc_pages")).select("doc_id", "item_no", "ok")


@query("a18_accuracy_by_document", ctes("v_toc", "v_doc_pages") + f"SELECT doc_id, count(*) AS n, round(avg(CAST(ok AS INT)), 9) AS accuracy, coalesce(string_agg(CAST(item_no AS VARCHAR), ',' ORDER BY item_no) FILTER (WHERE NOT ok), '') AS failing FROM (SELECT i.doc_id, item_no, coalesce({_NORM.format(c='title')} <> '' AND contains({_NORM.format(c='text')}, {_NORM.format(c='title')}), FALSE) AS ok FROM v_toc i LEFT JOIN v_doc_pages p ON p.doc_id = i.doc_id AND p.page_no = i.physical_index) GROUP BY 1")
def a18d(spark, d):
    found = st.accuracy(st.verify(view(spark, d, "v_toc"), view(spark, d, "v_doc_pages")))
    return found.select("doc_id", "n", F.round("accuracy", 9).alias("accuracy"), F.array_join(F.transform("failing", lambda i: i.cast("string")), ",").alias("failing"))


@query("d10_title_at_start", ctes("v_toc", "v_doc_pages") + f"SELECT i.doc_id, item_no, CASE WHEN coalesce({_NORM.format(c='title')} <> '' AND contains(left({_NORM.format(c='left(text, 300)')}, 80), {_NORM.format(c='title')}), FALSE) THEN 'yes' ELSE 'no' END AS appear_start FROM v_toc i LEFT JOIN v_doc_pages p ON p.doc_id = i.doc_id AND p.page_no = i.physical_index")
def d10(spark, d):
    return st.appears_at_start(view(spark, d, "v_toc"), view(spark, d, "v_doc_pages")).select("doc_id", "item_no", "appear_start")


# --- calls and tasks ---


@query("a5_call_statistics", ctes("v_calls") + "SELECT status, count(*) AS calls, count(*) FILTER (WHERE cache_hit) AS hits FROM v_calls WHERE created_at >= TIMESTAMP '2024-01-10' AND starts_with(caller, 'caller_1') GROUP BY 1")
def a5(spark, d):
    rows = view(spark, d, "v_calls").where((F.col("created_at") >= F.lit("2024-01-10").cast("timestamp")) & F.startswith("caller", F.lit("caller_1")))
    return rows.groupBy("status").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("hits"))


#: Seconds that an answer is kept, by the status of its call; other answers are not kept.
LIVES = {"view": 10 * 86400, "click": 600, "purchase": 2 * 86400}
SQL_LIFE = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIVES.items()) + " ELSE 0 END"


@query("t11_response_cache", ctes("v_calls") + f", s AS (SELECT cache_key, max_by(created_at + to_seconds({SQL_LIFE}), (created_at, event_id)) AS expires FROM v_calls WHERE created_at < TIMESTAMP '2024-01-15' AND {SQL_LIFE} > 0 GROUP BY 1) SELECT event_id, coalesce(expires >= created_at, FALSE) AS hit FROM v_calls v LEFT JOIN s ON s.cache_key = v.cache_key WHERE created_at >= TIMESTAMP '2024-01-15'")
def t11(spark, d):
    """The last stored answer of a key counts, for the lifetime of its outcome."""
    rows, cut = view(spark, d, "v_calls"), F.lit("2024-01-15").cast("timestamp")
    life = F.expr(SQL_LIFE).cast("long")
    end = F.max_by(F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("life") * 1_000_000), F.struct("created_at", "event_id"))
    stored = rows.withColumn("life", life).where((F.col("created_at") < cut) & (F.col("life") > 0)).groupBy("cache_key").agg(end.alias("expires"))
    asked = rows.where(F.col("created_at") >= cut)
    return asked.join(stored, "cache_key", "left").select("event_id", F.coalesce(F.col("expires") >= F.col("created_at").cast("timestamp"), F.lit(False)).alias("hit"))


@query("t12_call_log", ctes("v_calls") + "SELECT status, count(*) AS n FROM v_calls GROUP BY 1")
def t12(spark, d):
    path = shared_path(spark, "calls")
    rows = view(spark, d, "v_calls")
    rows.where("cache_hit").write.mode("append").parquet(path)
    rows.where("not cache_hit").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query("t13_task_state", ctes("v_tasks") + "SELECT project_name, max_by(status, (created_at, task_id)) AS status FROM v_tasks GROUP BY 1")
def t13(spark, d):
    return view(spark, d, "v_tasks").groupBy("project_name").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("status"))


@query("t13_task_transitions", ctes("v_tasks") + "SELECT task_id, CASE WHEN task_id % 7 = 0 THEN 'CANCELLED' ELSE status END AS status, CASE WHEN status = 'COMPLETED' THEN concat('out/', CAST(task_id AS VARCHAR)) ELSE '' END AS path, CASE WHEN status = 'RUNNING' THEN 'late' ELSE '' END AS error FROM v_tasks WHERE task_id % 11 <> 0 OR task_id % 2 = 0")
def t13t(spark, d):
    """Every task is added and updated; some are cancelled; some are deleted, of which the even ones are added anew before."""
    tasks, odd = view(spark, d, "v_tasks"), F.col("task_id") % 2 == 1
    none = F.lit("")

    def event(rows, no, kind, status, path=none, error=none):
        return rows.select("task_id", F.lit(no).alias("event_no"), F.lit(kind).alias("kind"), status.alias("status"), path.alias("path"), error.alias("error"))

    rows = event(tasks.where(~odd & (F.col("task_id") % 11 == 0)), 0, "delete", none)
    rows = rows.unionByName(event(tasks, 1, "update", F.lit("PENDING")))
    path = F.when(F.col("status") == "COMPLETED", F.concat(F.lit("out/"), "task_id")).otherwise("")
    rows = rows.unionByName(event(tasks, 2, "update", F.col("status"), path, F.when(F.col("status") == "RUNNING", "late").otherwise("")))
    rows = rows.unionByName(event(tasks.where("task_id % 7 = 0"), 3, "status", F.lit("CANCELLED")))
    return jobs.task_states(rows.unionByName(event(tasks.where(odd & (F.col("task_id") % 11 == 0)), 4, "delete", none)))


@query("k3_oldest_pending", ctes("v_tasks") + "SELECT task_id, status FROM v_tasks WHERE status = 'PENDING' ORDER BY created_at, task_id LIMIT 1")
def k3(spark, d):
    return view(spark, d, "v_tasks").where("status = 'PENDING'").orderBy("created_at", "task_id").limit(1).select("task_id", "status")


@query("k3_newest_tasks", ctes("v_tasks") + "SELECT task_id, status, row_number() OVER (ORDER BY created_at DESC, task_id) AS place FROM v_tasks ORDER BY place LIMIT 50")
def k3n(spark, d):
    """The list that users see: newest first."""
    newest = view(spark, d, "v_tasks").orderBy(F.desc("created_at"), "task_id").limit(50)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "task_id"))).select("task_id", "status", "place")


@query("s14_grouped_reports", ctes("v_findings") + "SELECT work_item, count(*) AS n FROM v_findings GROUP BY 1")
def s14(spark, d):
    path = shared_path(spark, "reports")
    sd.write_reports(view(spark, d, "v_findings").select("work_item", "doc_id", "finding"), path, "work_item")
    return spark.read.json(path).groupBy("work_item").agg(F.count("*").alias("n"))


@query("s12_analysis_sinks", ctes("v_opinions") + "SELECT count(*) AS n FROM v_opinions")
def s12(spark, d):
    path = shared_path(spark, "cards")
    sd.write_reports(carded(spark, d), path, kind="parquet")
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("s12_three_results", CARDS + "SELECT 'cards' AS name, count(*) AS n FROM full_cards UNION ALL SELECT 'cases', count(DISTINCT project_name) FROM v_opinions UNION ALL SELECT 'methodology', count(DISTINCT work_category) FROM full_cards")
def s12t(spark, d):
    """Cards, cases and methodology written as JSON lines and read back."""
    path, cards = shared_path(spark, "analysis"), carded(spark, d)
    methods = cards.groupBy("work_category").agg(F.count("*").alias("n"))
    sd.write_analysis(cards, op.status_distribution(assessed(spark, d)), methods, path)
    back = [spark.read.json(f"{path}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("cards", "cases", "methodology")]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("s15_cards_from_file", CARDS + "SELECT card_id, md5(opinion) AS opinion FROM full_cards ORDER BY card_id LIMIT 40")
def s15f(spark, d):
    """The file of an analysis comes before the rules; the first forty cards of it."""
    path, cards = shared_path(spark, "analysis"), carded(spark, d)
    sd.write_reports(cards, path)
    found = sd.load_cards(spark, path, "card_id string, opinion string", op.card_rules(cards), 40)
    return found.select("card_id", F.md5("opinion").alias("opinion"))


@query("s13_gap_manifest", ctes("v_opinions", more=ALIGN) + "SELECT project_name, unresolved, CASE WHEN unresolved > 0 THEN concat('{\"to_review\":', CAST(unresolved AS VARCHAR), '}') END AS reasons, CASE WHEN n % 3 = 0 THEN concat('old/', CAST(n AS VARCHAR)) ELSE '' END AS user_supplied_path FROM (SELECT row_index AS n, concat('conv_', CAST(row_index AS VARCHAR)) AS project_name, count(*) FILTER (WHERE alignment = 'partly_resolved') AS unresolved FROM v GROUP BY 1) WHERE unresolved > 0")
def s13(spark, d):
    """A third of the projects have a path that a user entered in the manifest before."""
    report = op.gap_report(assessed(spark, d).withColumn("work_category", F.lit("all")), "partly_resolved")
    old = report.withColumn("n", F.split("project_name", "_")[1].cast("long")).where("n % 3 = 0").select("project_name", F.concat(F.lit("old/"), F.col("n").cast("string")).alias("source_path"))
    path = shared_path(spark, "manifest")
    old.write.option("header", True).csv(path)
    rows = sd.write_manifest(report, shared_path(spark, "manifest"), sd.entered_paths(spark, path))
    return rows.select("project_name", "unresolved", "reasons", "user_supplied_path")


# --- streams ---


@query("x4_live_statistics", ctes("v_calls") + "SELECT date_trunc('minute', created_at) AS start, status, count(*) AS calls, CAST(count(*) FILTER (WHERE cache_hit) AS BIGINT) AS hits FROM v_calls GROUP BY 1, 2")
def x4(spark, d):
    stream = _calls(spark, d)
    out = shared_path(spark, "x4")
    rows = jobs.live_statistics(stream, late="40 days")
    return jobs.drain(rows, f"x4_{out[-8:]}", "complete", out).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _calls(spark, d):
    events = jobs.source(spark, f"{d}/events.parquet", view(spark, d, "events").schema)
    return events.select("event_id", F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "view").alias("cache_hit"), F.col("event_type").alias("status"), F.concat_ws("_", "user_id", "event_type").alias("cache_key"))


@query("x3_first_requests", "SELECT DISTINCT concat(CAST(user_id AS VARCHAR), '_', event_type) AS cache_key FROM events")
def x3(spark, d):
    out = shared_path(spark, "x3")
    return jobs.drain(jobs.first_requests(_calls(spark, d), "cache_key", "created_at", "40 days"), f"x3_{out[-8:]}", "append", out).select("cache_key")


@query("x5_task_state", "SELECT o_custkey AS task_id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def x5(spark, d):
    orders = jobs.source(spark, f"{d}/orders.parquet", view(spark, d, "orders").schema)
    rows = orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("ts"))
    out = shared_path(spark, "x5")
    return jobs.drain(rows.groupBy("task_id").agg(F.max_by("status", "ts").alias("status")), f"x5_{out[-8:]}", "complete", out)


CUT_TEXT = "CASE WHEN doc_id % 5 = 2 THEN left(text, 300) ELSE text END"


def _refreshed(spark, d):
    """All documents arrive; then every rule comes again, a tenth of them retired and a fifth cut; then a tenth comes alone."""
    docs = jobs.source(spark, f"{d}/documents.parquet", view(spark, d, "documents").schema)
    rules = lambda df: df.select(F.col("doc_id").alias("rule_id"), F.when(F.col("doc_id") % 11 == 0, "inactive").otherwise("active").alias("status"), F.col("text").alias("content"), F.lit(False).alias("is_washed"), F.lit("").alias("condensed_content"))
    out = shared_path(spark, "postings")
    jobs.index(rules(docs), out, shared_path(spark, "x2")).awaitTermination()
    again = rules(view(spark, d, "documents").withColumn("text", F.expr(CUT_TEXT))).withColumn("status", F.when(F.col("rule_id") % 10 == 3, "inactive").otherwise(F.col("status")))
    segments.refresh(again, out, 1_000_000)
    segments.refresh(again.where("rule_id % 10 = 4"), out, 1_000_001)  # nothing new
    return out


@query("x2_incremental_index", ctes("v_rules") + "SELECT count(DISTINCT rule_id) AS rules FROM v_rules WHERE status = 'active' AND rule_id % 10 <> 3 AND regexp_matches(content, '[\\p{L}\\p{N}]')")
def x2(spark, d):
    return segments.postings_now(spark, _refreshed(spark, d)).agg(F.countDistinct("rule_id").alias("rules"))


@query("x2_index_statistics", f"""
WITH t AS (SELECT regexp_extract_all(lower({CUT_TEXT}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 10 <> 3 AND trim(text) <> ''),
s AS (SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM t)
SELECT term, count(*) AS df, n, avgdl FROM (SELECT unnest(list_distinct(w)) AS term FROM t), s GROUP BY term, n, avgdl""")
def x2s(spark, d):
    """Document frequencies, number and mean length of the rules in force, from signed changes alone."""
    terms, stats = segments.statistics(spark, _refreshed(spark, d))
    return terms.crossJoin(F.broadcast(stats)).withColumn("avgdl", F.round("avgdl", 6))


def _audited(spark, d):
    """All documents audited as they arrive: the rows of the audit, the failed documents."""
    docs = jobs.source(spark, f"{d}/documents.parquet", view(spark, d, "documents").schema)
    out, failed = shared_path(spark, "audits"), shared_path(spark, "failed")
    checks = [("no text", tx.u_trim(F.col("text")) == ""), ("many stars", F.contains("text", F.lit("***"))), ("odd source", F.col("source").isNull())]
    run = jobs.guarded(lambda df: au.run(df, sd.located_lines(df), ALIASES, FINDINGS, TERMS), checks)
    jobs.audit(docs, run, out, failed, shared_path(spark, "x1")).awaitTermination()
    return spark.read.parquet(out), spark.read.schema("doc_id long, error string").parquet(failed)


@query("x1_continuous_audit")
def x1(spark, d):
    rows, _ = _audited(spark, d)
    return rows.select("doc_id", "work_item", "n", "error")


@query("x1_task_states", """
WITH e AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN contains(text, '***') THEN 'many stars' WHEN source IS NULL THEN 'odd source' END AS error FROM documents)
SELECT doc_id AS task_id, CASE WHEN doc_id % 9 = 0 THEN 'CANCELLED' WHEN doc_id % 11 = 5 THEN 'PAUSED' WHEN error IS NOT NULL THEN 'FAILED' WHEN doc_id % 4 = 1 THEN 'COMPLETED' ELSE 'REVIEW_PENDING' END AS status,
 CASE WHEN doc_id % 9 <> 0 AND doc_id % 11 <> 5 AND error IS NULL AND doc_id % 4 <> 1 THEN concat('out/', CAST(doc_id AS VARCHAR)) ELSE '' END AS path,
 CASE WHEN doc_id % 9 <> 0 AND doc_id % 11 <> 5 THEN coalesce(error, '') ELSE '' END AS error FROM e""")
def x1s(spark, d):
    """Every document is a task: submitted, started, audited; some are cancelled or paused before the result, some approved."""
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("task_id"))
    event = lambda rows, no, kind: rows.select("task_id", F.lit(no).cast("long").alias("event_no"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("error"))
    asked = event(docs, 1, "submit").unionByName(event(docs, 2, "start")).unionByName(event(docs.where("task_id % 9 = 0"), 3, "cancel")).unionByName(event(docs.where("task_id % 11 = 5"), 4, "pause"))
    _, failed = _audited(spark, d)
    told = tasks.outcomes(view(spark, d, "documents"), failed, "doc_id", 5, F.concat(F.lit("out/"), F.col("doc_id").cast("string")))
    path = shared_path(spark, "events")
    asked.unionByName(told).unionByName(event(docs.where("task_id % 4 = 1"), 6, "approve")).write.parquet(path)
    events, out = jobs.source(spark, path, spark.read.parquet(path).schema, files=10_000), shared_path(spark, "x1s")
    with cache.keyed_state(spark):
        return tasks.latest(jobs.drain(tasks.transitions(events), f"x1s_{out[-8:]}", "append", out))


@query("x3_cached_requests", ctes("v_calls", more="""c AS MATERIALIZED (SELECT event_id, user_id AS k, created_at AS t, status, epoch_ms(created_at) AS ms FROM v_calls JOIN events USING (event_id)),
call(k, event_id, ms, ends) AS (
 SELECT k, event_id, ms, CASE WHEN SQL_LIFE > 0 THEN ms + 1000 * SQL_LIFE ELSE ms - 1 END FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, event_id) AS r FROM c) WHERE r = 1
 UNION ALL SELECT k, event_id, ms, CASE WHEN SQL_LIFE > 0 THEN ms + 1000 * SQL_LIFE ELSE ends END FROM (
  SELECT c.k, c.event_id, c.ms, c.status, call.ends, row_number() OVER (PARTITION BY c.k ORDER BY c.ms, c.event_id) AS r FROM call JOIN c ON c.k = call.k AND (c.ms, c.event_id) > (call.ms, call.event_id) AND c.ms > call.ends) WHERE r = 1)""".replace("SQL_LIFE", SQL_LIFE), recursive=True) + "SELECT c.event_id, call.event_id IS NULL AS hit FROM c LEFT JOIN call USING (event_id)")
def x3c(spark, d):
    """Every call of the log decided by a cache with a lifetime for each outcome; a user is a key."""
    events = jobs.source(spark, f"{d}/events.parquet", view(spark, d, "events").schema)
    calls = events.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("cache_key"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("status"))
    out = shared_path(spark, "x3c")
    with cache.keyed_state(spark):
        return jobs.drain(cache.decided(calls, LIVES, late="40 days"), f"x3c_{out[-8:]}", "append", out).select(F.col("request_id").alias("event_id"), "hit")
