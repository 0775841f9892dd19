"""Registered queries: the rule corpus and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import index as ix
from ..operators import retrieval as rt
from ..operators import rules as rl
from ..operators import segment as sg
from ..operators import vectors as vc
from ..sources.views import ctes, view
from .fixture import FAMILIES, LEX, PATTERNS, STOP, lex_values, sql_list
from .registry import query

DISPLAY = "CASE WHEN is_washed AND trim(condensed_content) <> '' THEN condensed_content ELSE content END"
LIVE = "status = 'active' AND trim(content) <> ''"
ANCESTRY = """CASE WHEN wbs_code IN ('', 'GEN') THEN ['GEN'] ELSE list_append(list_reverse(list_transform(range(1, len(string_split(wbs_code, '-')) + 1), lambda i: array_to_string(string_split(wbs_code, '-')[1:i], '-'))), 'GEN') END"""
TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


def placed(spark, d):
    """The rules, numbered within their source by ranges instead of one window over each source."""
    return rl.renumber(view(spark, d, "v_rules"), "source_file", "rule_id")


def rule_index(spark, d):
    """The index of the active rules, from the texts where they lie: numbering them would move them."""
    return ix.build(rt.active_texts(view(spark, d, "v_rules")).withColumn("facet", rt.facet()), facet="facet")


@query("s1_rule_scan", ctes("v_rules") + "SELECT rule_id, source_file, seq_index, status FROM v_rules WHERE status = 'active'")
def s1(spark, d):
    return rl.scan(placed(spark, d)).select("rule_id", "source_file", "seq_index", "status")


@query("s2_rule_lookup", ctes("v_rules") + "SELECT rule_id, wbs_code, level FROM v_rules WHERE rule_id IN (SELECT item_id * 3 FROM benchmark)")
def s2(spark, d):
    ids = view(spark, d, "benchmark").select((F.col("item_id") * 3).alias("rule_id"))
    return rl.lookup(view(spark, d, "v_rules"), ids).select("rule_id", "wbs_code", "level")


#: Rules with what a tree ingestion and a quality audit add to them; of some, the fields are empty.
TOLD = """told AS (SELECT *, CASE WHEN rule_id % 3 = 0 THEN '' ELSE concat('2024-01-0', CAST(1 + rule_id % 9 AS VARCHAR)) END AS ingested, CASE WHEN rule_id % 4 = 1 THEN CAST(rule_id % 50 AS VARCHAR) WHEN rule_id % 4 = 2 THEN 'x' END AS start_index,
 CASE WHEN rule_id % 4 = 1 THEN concat('node ', category) END AS node_title, CASE WHEN rule_id % 5 <> 0 THEN CAST(rule_id % 101 AS VARCHAR) END AS quality_score, rule_id % 2 = 0 AS short, rule_id % 7 = 0 AS washed_out FROM v_rules)"""
_META = """rule_id, CASE WHEN source_file = '' THEN category ELSE source_file END AS source_file, category, wbs_code, lifecycle_phase, status, index_source, level, seq_index, publish_date, is_washed, left(condensed_content, 500) AS condensed_content, md5(left(content, 2000)) AS full_text,
 ingested, coalesce(try_cast(start_index AS INT), -1) AS start_index, -1 AS end_index, coalesce(node_title, '') AS node_title, '' AS node_id, coalesce(CAST(quality_score AS INT), -1) AS quality_score, concat_ws(',', CASE WHEN short THEN 'short' END, CASE WHEN washed_out THEN 'washed_out' END) AS quality_flags, left(content, 500) AS quality_notes"""


def told_rules(spark, d):
    n = F.col("rule_id")
    flags = F.filter(F.array(F.when(n % 2 == 0, "short"), F.when(n % 7 == 0, "washed_out")), lambda x: x.isNotNull())
    start = F.when(n % 4 == 1, (n % 50).cast("string")).when(n % 4 == 2, "x")
    more = {"ingest_time": F.when(n % 3 != 0, F.concat(F.lit("2024-01-0"), (1 + n % 9).cast("string"))), "start_index": start, "node_title": F.when(n % 4 == 1, F.concat(F.lit("node "), "category")), "quality_score": F.when(n % 5 != 0, (n % 101).cast("string")), "quality_flags": flags, "quality_notes": F.col("content")}
    return placed(spark, d).withColumns(more)


@query("s11_vector_payload", ctes("v_rules", more=TOLD) + f"SELECT md5({DISPLAY}) AS document, {_META} FROM told WHERE trim(content) <> ''")
def s11(spark, d):
    return rl.payload(told_rules(spark, d)).withColumn("document", F.md5("document")).withColumn("full_text", F.md5("full_text"))


@query("p1_rule_metadata", ctes("v_rules", more=TOLD) + f"SELECT {_META} FROM told")
def p1(spark, d):
    return rl.metadata(told_rules(spark, d)).withColumn("full_text", F.md5("full_text"))


@query("p2_safe_int", "SELECT page_id, coalesce(try_cast(regexp_extract(url, '[0-9]+') AS INT), -1) AS n FROM pages")
def p2(spark, d):
    return view(spark, d, "pages").select("page_id", tx.safe_int(F.regexp_extract("url", "[0-9]+", 0), -1).alias("n"))


@query("p3_display_text", ctes("v_rules") + f"SELECT rule_id, md5({DISPLAY}) AS text FROM v_rules")
def p3(spark, d):
    return view(spark, d, "v_rules").select("rule_id", F.md5(rl.display_text()).alias("text"))


@query("p4_white_space", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned, length(regexp_replace(text, '\s+', '', 'g')) AS n_compact FROM documents")
def p4(spark, d):
    return view(spark, d, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("cleaned"), F.length(tx.compact(F.col("text"))).cast("long").alias("n_compact"))


@query("p5_code_ancestry", ctes("v_rules") + f"SELECT rule_id, array_to_string({ANCESTRY}, ',') AS chain FROM v_rules")
def p5(spark, d):
    return view(spark, d, "v_rules").select("rule_id", F.array_join(tx.ancestry(F.col("wbs_code")), ",").alias("chain"))


@query("p6_head_tail", "SELECT doc_id, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200) AS head, right(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200) AS tail FROM documents")
def p6(spark, d):
    return view(spark, d, "documents").select("doc_id", tx.head(F.col("text"), 200).alias("head"), tx.tail(F.col("text"), 200).alias("tail"))


@query("p7_stable_ids", ctes("v_rules") + "SELECT rule_id, concat('R_', upper(left(sha256(concat(source_file, chr(10), CASE WHEN seq_index = 0 THEN '' ELSE CAST(seq_index AS VARCHAR) END)), 12))) AS hash_id FROM v_rules")
def p7(spark, d):
    return placed(spark, d).select("rule_id", tx.hash_id("R", F.col("source_file"), F.col("seq_index")).alias("hash_id"))


@query("p7_uuid5_ids", ctes("v_rules") + f"SELECT rule_id, upper(left(sha1(unhex('{tx.NAMESPACE_URL}') || encode(concat(source_file, '#', CAST(seq_index AS VARCHAR)))), 10)) AS uid FROM v_rules")
def p7u(spark, d):
    return placed(spark, d).select("rule_id", tx.uuid5_prefix(F.concat_ws("#", "source_file", "seq_index")).alias("uid"))


@query("p8_fallback_summary")
def p8(spark, d):
    path = F.array("source_file", "category")
    return view(spark, d, "v_rules").select("rule_id", tx.fallback_summary(F.col("source_file"), path, F.col("content"), ("the", "que", "der")).alias("summary"))


@query("p9_snippets", r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
p AS (SELECT doc_id, x, list_min(list_filter([instr(lower(x), 'license'), instr(lower(x), 'idiot')], lambda q: q > 0)) AS f FROM t),
s AS (SELECT *, greatest(0, f - 1 - 200) AS a, least(length(x), greatest(0, f - 1 - 200) + 600) AS b FROM p),
w AS (SELECT *, CASE WHEN b - a < 600 THEN greatest(0, b - 600) ELSE a END AS s FROM s)
SELECT doc_id, md5(CASE WHEN length(x) <= 600 THEN x WHEN f IS NULL THEN left(x, 600)
  ELSE concat(CASE WHEN s > 0 THEN '...' ELSE '' END, substring(x, s + 1, b - s), CASE WHEN b < length(x) THEN '...' ELSE '' END) END) AS snippet FROM w""")
def p9(spark, d):
    words = F.array(F.lit("license"), F.lit("idiot"))
    return view(spark, d, "documents").select("doc_id", F.md5(tx.snippet(F.col("text"), words)).alias("snippet"))


@query("p10_query_tokens", ctes("v_queries") + f"SELECT query_id, array_to_string(list_filter(list_filter(regexp_extract_all(query, '[A-Za-z0-9]{{2,}}'), lambda t, i: list_position(regexp_extract_all(query, '[A-Za-z0-9]{{2,}}'), t) = i), lambda t: NOT list_contains({sql_list(STOP)}, t))[1:8], ' ') AS tokens FROM v_queries")
def p10(spark, d):
    return view(spark, d, "v_queries").select("query_id", F.array_join(tx.query_tokens(F.col("query"), STOP), " ").alias("tokens"))


@query("p12_json_columns", ctes("v_rules") + f"SELECT rule_id, CAST(is_washed AS INT) AS washed, len({ANCESTRY}) AS n_tags, ({ANCESTRY})[1] AS first_tag FROM v_rules")
def p12(spark, d):
    stored = view(spark, d, "v_rules").select("rule_id", F.col("is_washed").cast("int").alias("washed"), F.to_json(tx.ancestry(F.col("wbs_code"))).alias("tags"))
    back = stored.withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
    return back.select("rule_id", "washed", F.size("tags").cast("long").alias("n_tags"), F.get("tags", F.lit(0)).alias("first_tag"))


@query("p17_entity_names", r"SELECT p_partkey, regexp_replace(replace(replace(regexp_replace(regexp_replace(trim(regexp_replace(p_name, '\s+', ' ', 'g')), '(?i)F\d{2}', '', 'g'), '\d{6,8}', '', 'g'), 'part', ''), 'red', ''), '[\s_+\-]+', '', 'g') AS name FROM part")
def p17(spark, d):
    return view(spark, d, "part").select("p_partkey", tx.entity_name(F.col("p_name"), ("part", "red")).alias("name"))


@query("p18_request_keys", """SELECT conv_id, turn, sha256(concat('{"model":"m","role":"', role, '","turn":', CAST(turn AS VARCHAR), '}')) AS request_key FROM conversations""")
def p18(spark, d):
    body = F.to_json(F.struct(F.lit("m").alias("model"), "role", "turn"))
    return view(spark, d, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("request_key"))


@query("p19_title_keys", r"SELECT page_id, lower(regexp_replace(url, '[^\w]+', '', 'g')) AS title_key FROM pages")
def p19(spark, d):
    return view(spark, d, "pages").select("page_id", tx.title_key(F.col("url")).alias("title_key"))


@query("p20_slugs", r"SELECT page_id, left(regexp_replace(regexp_replace(url, '[^\w.\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 120) AS slug FROM pages")
def p20(spark, d):
    return view(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("f1_eligible_rules", ctes("v_rules") + "SELECT rule_id FROM v_rules WHERE status = 'active' AND lifecycle_phase IN ('BUILD', 'GEN') AND index_source <> 'review_experience'")
def f1(spark, d):
    return rl.eligible(view(spark, d, "v_rules"), "BUILD").select("rule_id")


@query("f10_numbers", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\d+\s*(?:[:：]\s*\d+|h|d|mm|cm|m|%)|[≥≤]')")
def f10(spark, d):
    return view(spark, d, "documents").where(F.col("text").rlike(r"\d+\s*(?:[:：]\s*\d+|h|d|mm|cm|m|%)|[≥≤]")).select("doc_id")


@query("f11_keyword_sets", f"SELECT doc_id, len(list_filter({sql_list(['license', 'idiot', 'eaux'])}, lambda k: contains(lower(text), k))) > 0 AS any_hit, array_to_string(list_filter({sql_list(['license', 'the ', 'ción'])}, lambda k: NOT contains(lower(text), k)), ',') AS missing FROM documents")
def f11(spark, d):
    c = F.col("text")
    return view(spark, d, "documents").select("doc_id", tx.contains_any(c, ("license", "idiot", "eaux")).alias("any_hit"), F.array_join(tx.missing(c, ("license", "the ", "ción")), ",").alias("missing"))


@query("j1_neighbours", ctes("v_rules") + f"""
, live AS (SELECT rule_id, source_file, seq_index, regexp_replace({DISPLAY}, '^\\s+|\\s+$', '', 'g') AS t FROM v_rules WHERE {LIVE})
SELECT a.rule_id, right(b.t, 200) AS prev_text, left(c.t, 200) AS next_text FROM live a
LEFT JOIN live b ON b.source_file = a.source_file AND b.seq_index = a.seq_index - 1
LEFT JOIN live c ON c.source_file = a.source_file AND c.seq_index = a.seq_index + 1""")
def j1(spark, d):
    return rl.neighbours(placed(spark, d))


@query("j2_code_matches", ctes("v_rules", "v_queries") + f"SELECT DISTINCT q.query_id, r.rule_id FROM (SELECT query_id, unnest({ANCESTRY}) AS code FROM v_queries) q JOIN v_rules r ON r.wbs_code = q.code")
def j2(spark, d):
    return rl.code_matches(view(spark, d, "v_queries"), view(spark, d, "v_rules"))


def dense(spark, d):
    """The ranked lists of exact vector search over all eligible rules."""
    queries, rules, vectors = view(spark, d, "v_queries"), view(spark, d, "v_rules"), view(spark, d, "embeddings")
    asked = queries.select("query_id", "lifecycle").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return rt.nearest_rules(asked, vectors, rules, 6).select("query_id", F.lit("dense").alias("engine"), "rank", "rule_id")


def retrieved(spark, d):
    """The ranked lists of both engines: BM25 over all active rules, and exact vector search over all eligible ones."""
    queries, rules = view(spark, d, "v_queries"), view(spark, d, "v_rules")
    lexical, _ = ix.search(ix.build(rt.active_texts(rules)), queries, 6)
    return dense(spark, d).unionByName(lexical.select("query_id", F.lit("lexical").alias("engine"), "rank", "rule_id"))


@query("j3_full_texts", ctes("v_retrieval", "v_rules") + "SELECT query_id, engine, h.rule_id, md5(coalesce(nullif(content, ''), 'cut')) AS full_text FROM v_retrieval h LEFT JOIN v_rules r ON r.rule_id = h.rule_id")
def j3(spark, d):
    hits = retrieved(spark, d).withColumn("fallback", F.lit("cut"))
    return rl.full_texts(hits, view(spark, d, "v_rules")).select("query_id", "engine", "rule_id", F.md5("full_text").alias("full_text"))


@query("j4_tag_fallback", ctes("v_rules", "v_queries") + """
, lost AS (SELECT * FROM v_queries WHERE query_id % 2 = 1),
tags AS (SELECT rule_id, level, wbs_code, regexp_extract(content, '[A-Za-z]{4,}') AS tag FROM v_rules WHERE status = 'active'),
hit AS (SELECT DISTINCT query_id, rule_id, t.level FROM lost q JOIN tags t ON tag <> '' AND contains(query, tag) AND (q.wbs_code IN ('', 'GEN') OR q.wbs_code = t.wbs_code))
SELECT query_id, rule_id, level, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, rule_id) AS rank FROM hit) WHERE rank <= 2""")
def j4(spark, d):
    tagged = view(spark, d, "v_rules").where("status = 'active'").withColumn("tags", F.filter(F.array(F.regexp_extract("content", "[A-Za-z]{4,}", 0)), lambda t: t != ""))
    queries = view(spark, d, "v_queries")
    return rt.tag_fallback(queries, queries.where("query_id % 2 = 0"), tagged)


@query("j8_reconcile_index", ctes("v_rules") + "SELECT count(*) FILTER (WHERE b.rule_id IS NULL) AS only_stored, count(*) FILTER (WHERE a.rule_id IS NULL) AS only_indexed, count(*) FILTER (WHERE b.rule_id IS NOT NULL AND b.pd IS NULL) AS lacking, TRUE AS needs_reset, FALSE AS needs_sync FROM (SELECT rule_id FROM v_rules WHERE rule_id % 10 <> 0) a FULL OUTER JOIN (SELECT rule_id, nullif(publish_date, 'n/a') AS pd FROM v_rules WHERE rule_id % 10 <> 1) b ON a.rule_id = b.rule_id")
def j8(spark, d):
    rules = view(spark, d, "v_rules")
    indexed = rules.where("rule_id % 10 <> 1").withColumn("publish_date", F.expr("nullif(publish_date, 'n/a')"))
    return rl.reconcile(rules.where("rule_id % 10 <> 0"), indexed, needed=["publish_date"])


@query("j9_superseded", ctes("v_rules") + "SELECT rule_id, CASE WHEN status = 'active' AND index_source <> 'pageindex' AND (source_file IN ('src1', 'fr') OR category IN ('src1', 'fr')) THEN 'inactive' ELSE status END AS status FROM v_rules")
def j9(spark, d):
    rules = view(spark, d, "v_rules")
    names = spark.createDataFrame([("src1",), ("fr",)], "category string")
    return rl.retire(rules, rl.superseded(rules, names)).select("rule_id", "status")


@query("a4_corpus_statistics", ctes("v_rules") + "SELECT count(*) AS total, count(*) FILTER (WHERE is_washed) AS washed, count(*) FILTER (WHERE status = 'active') AS active, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM v_rules")
def a4(spark, d):
    return rl.statistics(view(spark, d, "v_rules"))


@query("a7_group_template", ctes("v_rules") + """
, c AS (SELECT source_file, wbs_code, count(*) AS n, min(rule_id) AS f FROM v_rules GROUP BY 1, 2)
SELECT source_file, wbs_code, n FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def a7(spark, d):
    return rl.most_common(view(spark, d, "v_rules"), "source_file", "wbs_code", "rule_id")


QUALITY = rf"""
, f AS (SELECT *, length(regexp_replace(content, '\s+', '', 'g')) AS n, regexp_matches(content, '{PATTERNS["normative"]}') AS norm,
  CASE WHEN length(regexp_replace(content, '\s+', '', 'g')) = 0 THEN 1.0 ELSE 1.0 - length(regexp_replace(regexp_replace(content, '\s+', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')) / length(regexp_replace(content, '\s+', '', 'g')) END AS share FROM v_rules),
g AS (SELECT *, list_sort(list_filter([
  CASE WHEN n < 40 THEN 'too_short' END, CASE WHEN share > 0.45 THEN 'mostly_symbols' END,
  CASE WHEN regexp_matches(content, '\|') AND (regexp_matches(content, '[.]{{6,}}') OR share > 0.28) AND NOT norm THEN 'symbol_toc' END,
  CASE WHEN regexp_matches(content, '{PATTERNS["placeholder"]}') THEN 'placeholder_text' END,
  CASE WHEN regexp_matches(content, 'icense') AND NOT norm THEN 'publish_info_only' END,
  CASE WHEN regexp_matches(content, 'anand') AND NOT norm THEN 'people_roster' END,
  CASE WHEN regexp_matches(content, '\*\*\*') AND NOT norm THEN 'frontmatter' END], lambda x: x IS NOT NULL)) AS flags FROM f),
h AS (SELECT *, CAST(greatest(0, least(100, 100 - CASE WHEN list_contains(flags, 'too_short') THEN 80 ELSE 0 END - CASE WHEN list_contains(flags, 'mostly_symbols') THEN 35 ELSE 0 END
  - CASE WHEN list_contains(flags, 'symbol_toc') THEN 75 ELSE 0 END - CASE WHEN list_contains(flags, 'placeholder_text') THEN (CASE WHEN norm THEN 15 ELSE 75 END) ELSE 0 END
  - CASE WHEN list_contains(flags, 'publish_info_only') THEN 70 ELSE 0 END - CASE WHEN list_contains(flags, 'people_roster') THEN 70 ELSE 0 END
  - CASE WHEN list_contains(flags, 'frontmatter') THEN 25 ELSE 0 END + CASE WHEN index_source = 'pageindex' THEN 8 ELSE 0 END)) AS INT) AS score FROM g),
q AS (SELECT *, len(list_intersect(flags, ['too_short', 'symbol_toc', 'publish_info_only', 'people_roster'])) > 0 OR score <= 35 AS critical FROM h)
"""


@query("c12_rule_quality", ctes("v_rules") + QUALITY + "SELECT rule_id, score, array_to_string(flags, ',') AS flags, critical FROM q")
def c12(spark, d):
    return rl.quality(view(spark, d, "v_rules"), PATTERNS).select("rule_id", "score", F.array_join("flags", ",").alias("flags"), "critical")


@query("a8_quality_audit", ctes("v_rules") + QUALITY + ", a AS (SELECT *, CASE WHEN critical AND status = 'active' THEN 'retire' WHEN len(flags) > 0 THEN 'warn' ELSE 'keep' END AS action FROM q) SELECT action, flag, count(*) AS n FROM (SELECT action, unnest(CASE WHEN len(flags) = 0 THEN ['none'] ELSE flags END) AS flag FROM a) GROUP BY 1, 2")
def a8(spark, d):
    rows = rl.quality_audit(view(spark, d, "v_rules"), PATTERNS)
    flags = F.when(F.size("flags") == 0, F.array(F.lit("none"))).otherwise(F.col("flags"))
    return rows.select("action", F.explode(flags).alias("flag")).groupBy("action", "flag").agg(F.count("*").alias("n"))


WEIGHTED = f"""
lex(o, code, w, kw) AS (VALUES {lex_values()}),
hit AS (SELECT id, o, code, least(5, w + len(list_filter(kw, lambda k: contains(x, k))) - 1) AS conf FROM src, lex WHERE len(list_filter(kw, lambda k: contains(x, k))) > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, o) AS k FROM hit) WHERE k = 1)
"""


@query("c1_weighted_classifier", f"WITH src AS (SELECT doc_id AS id, lower(text) AS x FROM documents), {WEIGHTED} SELECT src.id AS doc_id, CASE WHEN coalesce(conf, 0) >= 3 THEN code ELSE 'GEN' END AS code, CAST(coalesce(conf, 0) AS INT) AS confidence FROM src LEFT JOIN best ON best.id = src.id")
def c1(spark, d):
    return view(spark, d, "documents").select("doc_id", lx.weighted(F.col("text"), LEX).alias("h")).select("doc_id", "h.code", "h.confidence")


@query("c2_most_hits", f"""WITH lex(o, code, w, kw) AS (VALUES {lex_values()}), n AS (SELECT doc_id, code, len(list_filter(kw, lambda k: contains(lower(text), k))) AS n FROM documents, lex)
SELECT doc_id, coalesce(max_by(code, (n, code)) FILTER (WHERE n > 0), 'OTHER') AS category FROM n GROUP BY doc_id""")
def c2(spark, d):
    return view(spark, d, "documents").select("doc_id", lx.most_hits(F.col("text"), LEX, "OTHER").alias("category"))


@query("a9_code_backfill", ctes("v_rules") + rf", src AS (SELECT rule_id AS id, lower(regexp_replace(concat(category, content), '\s+', '', 'g')) AS x FROM v_rules WHERE status = 'active' AND wbs_code = 'GEN'), {WEIGHTED} SELECT code AS wbs_code, count(*) AS n FROM best WHERE conf >= 3 GROUP BY 1")
def a9(spark, d):
    return rl.backfill(view(spark, d, "v_rules"), LEX).groupBy("wbs_code").agg(F.count("*").alias("n"))


@query("a17_gate", ctes("v_rules") + "SELECT rule_id, array_to_string(list_filter([CASE WHEN index_source <> 'pageindex' THEN 'not_from_tree' END, CASE WHEN length(trim(content)) < 15 THEN 'short_content' END, CASE WHEN length(trim(content)) < 30 THEN 'short_full_text' END], lambda x: x IS NOT NULL), ',') AS issues FROM v_rules")
def a17(spark, d):
    rows = rl.gate(view(spark, d, "v_rules").withColumn("full_text", F.col("content")))
    return rows.select("rule_id", F.array_join("issues", ",").alias("issues"))


@query("a17_gate_sample", ctes("v_rules") + "SELECT avg(CAST(index_source = 'pageindex' AND length(trim(content)) >= 30 AS INT)) AS pass_ratio, count(*) AS n FROM (SELECT * FROM v_rules ORDER BY md5(concat('0/', CAST(rule_id AS VARCHAR))), rule_id LIMIT 10)")
def a17s(spark, d):
    rows = rl.gate(rl.sample_rows(view(spark, d, "v_rules"), 10).withColumn("full_text", F.col("content")))
    return rows.agg(F.avg(F.col("passed").cast("int")).alias("pass_ratio"), F.count("*").alias("n"))


@query("w1_renumber", ctes("v_rules") + "SELECT rule_id, CAST(row_number() OVER (PARTITION BY category ORDER BY rule_id) - 1 AS INT) AS seq_index FROM v_rules")
def w1(spark, d):
    return rl.renumber(view(spark, d, "v_rules"), "category", "rule_id").select("rule_id", "seq_index")


@query("w2_append_numbers", ctes("v_rules") + "SELECT n.rule_id, CAST(coalesce(t.m, -1) + row_number() OVER (PARTITION BY n.source_file ORDER BY n.rule_id) AS INT) AS seq_index FROM (SELECT * FROM v_rules WHERE rule_id % 2 = 0) n LEFT JOIN (SELECT source_file, max(seq_index) AS m FROM v_rules WHERE rule_id % 2 = 1 GROUP BY 1) t ON t.source_file = n.source_file")
def w2(spark, d):
    rules = placed(spark, d)
    return rl.append_numbers(rules.where("rule_id % 2 = 1"), rules.where("rule_id % 2 = 0")).select("rule_id", "seq_index")


@query("k4_unwashed", ctes("v_rules") + "SELECT rule_id FROM v_rules WHERE NOT is_washed AND status = 'active' ORDER BY rule_id LIMIT 50")
def k4(spark, d):
    return view(spark, d, "v_rules").where("not is_washed and status = 'active'").orderBy("rule_id").limit(50).select("rule_id")


@query("u1_union_kept", ctes("v_rules") + "SELECT rule_id, CASE WHEN rule_id % 3 = 0 THEN 9 ELSE level END AS level FROM v_rules")
def u1(spark, d):
    rules = view(spark, d, "v_rules")
    return rl.union_kept(rules, rules.where("rule_id % 3 = 0").withColumn("level", F.lit(9))).select("rule_id", "level")


@query("u2_replace_source", ctes("v_rules") + "SELECT rule_id, index_source FROM v_rules WHERE index_source <> 'review_experience' UNION ALL SELECT rule_id + 1000000, 'review_experience' FROM v_rules WHERE level = 1")
def u2(spark, d):
    rules = view(spark, d, "v_rules")
    new = rules.where("level = 1").withColumn("rule_id", F.col("rule_id") + 1000000).withColumn("index_source", F.lit(rl.EXPERIENCE))
    return rl.replace_source(rules, new, rl.EXPERIENCE).select("rule_id", "index_source")


def _updates(rules):
    first = rules.where("rule_id % 3 = 0").withColumn("level", F.lit(8)).withColumn("append_no", F.lit(1))
    second = rules.where("rule_id % 6 = 0").withColumn("level", F.lit(9)).withColumn("append_no", F.lit(2))
    new = rules.where("rule_id % 50 = 0").withColumn("rule_id", F.col("rule_id") + 1000000).withColumn("append_no", F.lit(1))
    return first.unionByName(second).unionByName(new)


@query("t2_upsert_batch", ctes("v_rules") + "SELECT rule_id, CASE WHEN rule_id % 6 = 0 THEN 9 WHEN rule_id % 3 = 0 THEN 8 ELSE level END AS level FROM v_rules UNION ALL SELECT rule_id + 1000000, level FROM v_rules WHERE rule_id % 50 = 0")
def t2(spark, d):
    rules = view(spark, d, "v_rules")
    return rl.upsert(rules, _updates(rules)).select("rule_id", "level")


@query("t1_upsert_one", ctes("v_rules") + "SELECT rule_id, CASE WHEN rule_id = (SELECT min(rule_id) FROM v_rules) THEN 7 ELSE level END AS level FROM v_rules")
def t1(spark, d):
    rules = view(spark, d, "v_rules")
    one = rules.join(rules.agg(F.min("rule_id").alias("rule_id")), "rule_id", "left_semi").withColumn("level", F.lit(7)).withColumn("append_no", F.lit(1))
    return rl.upsert(rules, one).select("rule_id", "level")


@query("t3_replace_all", ctes("v_rules") + "SELECT rule_id, CASE WHEN rule_id % 6 = 0 THEN 9 ELSE 8 END AS level FROM v_rules WHERE rule_id % 3 = 0 UNION ALL SELECT rule_id + 1000000, level FROM v_rules WHERE rule_id % 50 = 0")
def t3(spark, d):
    return rl.replace_all(_updates(view(spark, d, "v_rules"))).select("rule_id", "level")


@query("t4_delete", ctes("v_rules") + "SELECT category, count(*) AS n FROM v_rules WHERE rule_id % 4 <> 0 GROUP BY 1")
def t4(spark, d):
    rules = view(spark, d, "v_rules")
    return rl.delete(rules, rules.where("rule_id % 4 = 0")).groupBy("category").agg(F.count("*").alias("n"))


@query("t4_delete_categories", ctes("v_rules") + "SELECT category, count(*) AS n, (SELECT count(*) FROM v_rules WHERE category IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) % 2 = 0)) AS deleted FROM v_rules WHERE category NOT IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) % 2 = 0) GROUP BY 1")
def t4c(spark, d):
    """Categories of an even number of rules go, and are counted."""
    rules = view(spark, d, "v_rules")
    even = rules.groupBy("category").agg(F.count("*").alias("n")).where("n % 2 = 0")
    left, gone = rl.delete_where(rules, "category", even)
    return left.groupBy("category").agg(F.count("*").alias("n")).crossJoin(F.broadcast(gone))


def _edits(rules):
    return rules.where("rule_id % 5 = 1").select("rule_id", F.when(F.col("rule_id") % 2 == 0, 6).alias("level"), F.when(F.col("rule_id") % 3 == 0, "99-01").alias("wbs_code"))


@query("t5_edit", ctes("v_rules") + "SELECT rule_id, CASE WHEN rule_id % 10 = 6 THEN 6 ELSE level END AS level, CASE WHEN rule_id % 15 = 6 THEN '99-01' ELSE wbs_code END AS wbs_code, rule_id % 5 = 1 AS revised FROM v_rules")
def t5(spark, d):
    rules = view(spark, d, "v_rules")
    return rl.edit(rules, _edits(rules), ["level", "wbs_code"]).select("rule_id", "level", "wbs_code", "revised")


@query("t6_batch_edit", ctes("v_rules") + "SELECT rule_id, CASE WHEN rule_id % 10 = 6 THEN 6 ELSE level END AS level, CASE WHEN rule_id % 15 = 6 THEN '99-01' ELSE wbs_code END AS wbs_code, rule_id % 5 = 1 AS revised FROM v_rules WHERE rule_id % 4 <> 0")
def t6(spark, d):
    rules = view(spark, d, "v_rules")
    return rl.batch_edit(rules, _edits(rules), rules.where("rule_id % 4 = 0"), ["level", "wbs_code"]).select("rule_id", "level", "wbs_code", "revised")


@query("t7_wash", ctes("v_rules") + "SELECT rule_id, is_washed OR rule_id % 9 = 0 AS is_washed, CASE WHEN rule_id % 9 = 0 THEN left(content, 50) ELSE condensed_content END AS condensed_content FROM v_rules")
def t7(spark, d):
    rules = view(spark, d, "v_rules")
    return rl.wash(rules, rules.where("rule_id % 9 = 0").withColumn("condensed_content", F.left("content", F.lit(50)))).select("rule_id", "is_washed", "condensed_content")


WINDOWS = r"""
WITH b AS (SELECT {doc} AS doc, {block} AS blk, {heading} AS h, regexp_replace({text}, '^\s+|\s+$', '', 'g') AS t FROM {source}),
k AS (SELECT doc, blk, concat('### ', h, chr(10), t) AS x FROM b WHERE length(t) >= 15),
a AS (SELECT doc, string_agg(x, concat(chr(10), chr(10)) ORDER BY blk) AS x FROM k GROUP BY doc),
w AS (SELECT doc, x, unnest(range(0, CASE WHEN length(x) <= 800 THEN 1 ELSE 1 + CAST(ceil((length(x) - 800) / 600.0) AS BIGINT) END)) AS n FROM a),
z AS (SELECT doc, n, regexp_replace(substring(x, n * 600 + 1, 800), '^\s+|\s+$', '', 'g') AS t FROM w)
SELECT doc AS {name}, CAST(n AS INT) AS window_no, md5(t) AS text_md5, length(t) AS n_chars FROM z WHERE length(t) >= 15"""


@query("d1_windows", WINDOWS.format(doc="doc_id", block="0", heading="source", text="text", source="documents", name="doc_id"))
def d1(spark, d):
    docs = view(spark, d, "documents").withColumn("block", F.lit(0))
    return rl.windows(docs, "doc_id", "block", "source", "text").select("doc_id", "window_no", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


#: Windows over the sections of documents, and the headings of the blocks that each touches.
HEADINGS = r"""
b AS (SELECT doc_id, section_no, section_type AS h, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM v_sections),
k AS (SELECT *, concat('### ', h, chr(10), t) AS x FROM b WHERE length(t) >= 15),
p AS (SELECT *, coalesce(sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k),
a AS (SELECT doc_id, string_agg(x, concat(chr(10), chr(10)) ORDER BY section_no) AS x FROM k GROUP BY 1),
w AS (SELECT doc_id, x, unnest(range(0, CASE WHEN length(x) <= 800 THEN 1 ELSE 1 + CAST(ceil((length(x) - 800) / 600.0) AS BIGINT) END)) AS n FROM a),
z AS (SELECT doc_id, n FROM w WHERE length(regexp_replace(substring(x, n * 600 + 1, 800), '^\s+|\s+$', '', 'g')) >= 15),
l AS (SELECT z.doc_id, n, list(h ORDER BY section_no) FILTER (WHERE h IS NOT NULL) AS l FROM z LEFT JOIN p ON p.doc_id = z.doc_id AND s + length(x) > n * 600 AND s < n * 600 + 800 GROUP BY 1, 2),
u AS (SELECT list_filter(l, lambda h, i: list_position(l, h) = i) AS l FROM l)"""


@query("d1_window_headings", ctes("v_sections", more=HEADINGS.strip()) + "SELECT CASE WHEN l IS NULL OR len(l) = 0 THEN 'continued' WHEN len(l) = 1 THEN l[1] ELSE concat(l[1], ' ... ', l[-1]) END AS heading, count(*) AS n FROM u GROUP BY 1")
def d1h(spark, d):
    sections = view(spark, d, "v_sections")
    return rl.windows(sections, "doc_id", "section_no", "section_type", "text").groupBy("heading").agg(F.count("*").alias("n"))


@query("t10_rebuild_windows", WINDOWS.format(doc="source", block="doc_id", heading="lang", text="text", source="documents", name="source_file"))
def t10(spark, d):
    rows = rl.windows(view(spark, d, "v_rules"), "source_file", "rule_id", "category", "content")
    return rows.select("source_file", "window_no", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("t8_ingest_documents")
def t8(spark, d):
    docs = view(spark, d, "documents").withColumn("block", F.lit(0))
    chunks = rl.windows(docs, "doc_id", "block", "source", "text")
    made = chunks.select(tx.hash_id("K", F.col("doc_id"), F.col("window_no")).alias("rule_id"), F.col("heading").alias("source_file"), lx.weighted(tx.compact(F.concat_ws("\n", "heading", "text")), LEX)["code"].alias("wbs_code"), F.col("window_no"))
    return rl.append_numbers(placed(spark, d), made).select("rule_id", "source_file", "wbs_code", "seq_index")


# --- retrieval ---

BM25 = rf"""
tok AS (SELECT rule_id, {TOKENS.format(c=DISPLAY)} AS t FROM v_rules WHERE {LIVE}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT term, rule_id, dl, count(*) AS tf FROM (SELECT rule_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2, 3),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({TOKENS.format(c="query")}) AS term FROM v_queries) GROUP BY 1, 2),
scored AS (SELECT query_id, rule_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN post USING (term) CROSS JOIN st GROUP BY 1, 2 HAVING score > 0.5)
"""


@query("r1_postings", ctes("v_rules", more=rf"tok AS (SELECT rule_id, {TOKENS.format(c=DISPLAY)} AS t FROM v_rules WHERE {LIVE})") + "SELECT term, rule_id, dl, count(*) AS tf FROM (SELECT rule_id, CAST(len(t) AS INT) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2, 3")
def r1(spark, d):
    return ix.postings(rt.active_texts(view(spark, d, "v_rules")))


@query("r1_term_statistics", ctes("v_rules", more=rf"tok AS (SELECT rule_id, {TOKENS.format(c=DISPLAY)} AS t FROM v_rules WHERE {LIVE})") + "SELECT term, count(DISTINCT rule_id) AS df FROM (SELECT rule_id, unnest(t) AS term FROM tok) GROUP BY 1")
def r1s(spark, d):
    return ix.build(rt.active_texts(view(spark, d, "v_rules"))).idf.select("term", "df")


@query("r2_bm25_topk", ctes("v_rules", "v_queries", more=BM25.strip()) + "SELECT query_id, rule_id, rank, score FROM (SELECT query_id, rule_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rule_id) AS rank FROM scored) WHERE rank <= 5")
def r2(spark, d):
    best, _ = ix.search(ix.build(rt.active_texts(view(spark, d, "v_rules"))), view(spark, d, "v_queries"), 5)
    return best.select("query_id", "rule_id", "rank", F.round("score", 6).alias("score"))


@query("r3_nearest_vectors", """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(q[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)) * (CAST(q[i] AS DOUBLE) - CAST(embedding[i] AS DOUBLE)))) AS distance FROM q, embeddings)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 6""")
def r3(spark, d):
    rows = view(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vc.nearest(asked, rows, 6, rt.DIMS)[0].select("query_id", "vec_id", "rank")


NAMELESS = "CASE WHEN rule_id % 3 <> 0 THEN rule_id END"


@query("r4_nameless_fusion", ctes("v_retrieval", "v_rules") + f"SELECT query_id, coalesce({NAMELESS}, -1) AS rule_id, md5(min(content)) AS content, round(sum(1.0 / (60 + rank)), 9) AS score FROM v_retrieval JOIN v_rules USING (rule_id) GROUP BY query_id, {NAMELESS}, CASE WHEN rule_id % 3 = 0 THEN content END")
def r4n(spark, d):
    """Every third rule has lost its id: its content stands for it."""
    lists = retrieved(spark, d).join(view(spark, d, "v_rules").select("rule_id", "content"), "rule_id").withColumn("rule_id", F.when(F.col("rule_id") % 3 != 0, F.col("rule_id")))
    return rt.fuse(lists, content="content").select("query_id", F.coalesce("rule_id", F.lit(-1)).alias("rule_id"), F.md5("content").alias("content"), F.round("score", 9).alias("score"))


@query("r4_rank_fusion", ctes("v_retrieval") + "SELECT query_id, rule_id, round(sum(1.0 / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines FROM v_retrieval GROUP BY 1, 2")
def r4(spark, d):
    return rt.fuse(retrieved(spark, d)).withColumn("score", F.round("score", 9))


ORDER = "round(score, 12) DESC, level, coalesce(-try_cast(left(replace(publish_date, '-', ''), 8) AS INT), 0), rule_id"
FUSED = f"fused AS (SELECT query_id, rule_id, sum(1.0 / (60 + rank)) AS score FROM v_retrieval GROUP BY 1, 2), cut AS (SELECT query_id, rule_id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM fused JOIN v_rules USING (rule_id))"


@query("k1_resolution_order", ctes("v_retrieval", "v_rules", more=FUSED) + "SELECT query_id, rule_id, rank FROM cut WHERE rank <= 10")
def k1(spark, d):
    merged = rt.fuse(retrieved(spark, d)).join(view(spark, d, "v_rules").select("rule_id", "level", "publish_date"), "rule_id")
    return rt.top(merged, 10, rt.resolution_order()).select("query_id", "rule_id", "rank")


@query("k2_recall_cut", ctes("v_retrieval") + "SELECT query_id, engine, rule_id, rank FROM v_retrieval WHERE rank <= 3")
def k2(spark, d):
    lists = retrieved(spark, d).withColumn("g", F.concat_ws("/", "query_id", "engine"))
    return rt.top(lists, 3, [F.asc("rank")], "g", "k").select("query_id", "engine", "rule_id", "rank")


@query("w9_rank_lists", ctes("v_retrieval") + "SELECT query_id, engine, rule_id, CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY 100 - rank DESC, rule_id) AS INT) AS rank FROM v_retrieval")
def w9(spark, d):
    return rt.ranked(retrieved(spark, d).withColumn("score", 100 - F.col("rank"))).select("query_id", "engine", "rule_id", "rank")


NEAR = f"""live AS (SELECT rule_id, source_file, seq_index, regexp_replace({DISPLAY}, '^\\s+|\\s+$', '', 'g') AS t FROM v_rules WHERE {LIVE}),
near AS (SELECT a.rule_id, coalesce(right(b.t, 200), '') AS p, coalesce(left(c.t, 200), '') AS n FROM live a
 LEFT JOIN live b ON b.source_file = a.source_file AND b.seq_index = a.seq_index - 1 LEFT JOIN live c ON c.source_file = a.source_file AND c.seq_index = a.seq_index + 1)"""
CONTEXT = f"""CASE WHEN index_source = 'pageindex' THEN concat('[node]', chr(10), '[source] ', source_file, chr(10), {DISPLAY}, CASE WHEN trim(content) <> '' THEN concat(chr(10), '[clause] ', content) ELSE '' END)
 WHEN coalesce(p, '') <> '' OR coalesce(n, '') <> '' THEN concat(CASE WHEN p <> '' THEN concat('[before] ', p, chr(10)) ELSE '' END, '[hit] ', {DISPLAY}, CASE WHEN n <> '' THEN concat(chr(10), '[after] ', n) ELSE '' END)
 ELSE {DISPLAY} END"""


@query("r5_expand_context", ctes("v_retrieval", "v_rules", more=NEAR) + f"SELECT query_id, engine, h.rule_id, md5({CONTEXT}) AS context FROM v_retrieval h JOIN v_rules r ON r.rule_id = h.rule_id LEFT JOIN near ON near.rule_id = h.rule_id")
def r5(spark, d):
    return rt.expand(retrieved(spark, d).drop("rank"), placed(spark, d)).withColumn("context", F.md5("context"))


RERANK = f"""words AS (SELECT query_id, list_filter(list_distinct({TOKENS.format(c="query")}), lambda t: length(t) >= 2 AND NOT list_contains({sql_list(STOP)}, t)) AS w FROM v_queries),
ctx AS (SELECT query_id, h.rule_id, rank, {CONTEXT} AS context FROM picked h JOIN v_rules r ON r.rule_id = h.rule_id LEFT JOIN near ON near.rule_id = h.rule_id),
ov AS (SELECT c.query_id, rule_id, rank, context, len(list_filter(w, lambda t: contains(lower(context), t))) AS overlap FROM ctx c JOIN words USING (query_id)),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS position FROM (SELECT *, max(overlap) OVER (PARTITION BY query_id) AS best FROM ov) WHERE overlap > 0 OR best = 0)"""


@query("r6_lexical_rerank", ctes("v_retrieval", "v_rules", more=f"{FUSED}, picked AS (SELECT * FROM cut WHERE rank <= 10), {NEAR}, {RERANK}") + "SELECT query_id, rule_id, CAST(overlap AS INT) AS overlap, position FROM pos")
def r6(spark, d):
    rules, queries = placed(spark, d), view(spark, d, "v_queries")
    merged = rt.fuse(retrieved(spark, d)).join(rules.select("rule_id", "level", "publish_date"), "rule_id")
    cut = rt.top(merged, 10, rt.resolution_order()).select("query_id", "rule_id", "rank")
    return rt.rerank(rt.expand(cut, rules), queries, stop=STOP).select("query_id", "rule_id", "overlap", "position")


RETRIEVE = f"""{BM25.strip()},
chain AS (SELECT query_id, lifecycle, CASE WHEN wbs_code IN ('', 'GEN') THEN NULL ELSE {ANCESTRY} END AS chain FROM v_queries),
fit AS (SELECT s.query_id, s.rule_id, s.score FROM scored s JOIN v_rules r USING (rule_id) JOIN chain c USING (query_id)
 WHERE status = 'active' AND index_source <> 'review_experience' AND (lifecycle_phase = 'GEN' OR lifecycle_phase = lifecycle) AND (chain IS NULL OR list_contains(chain, r.wbs_code))),
lexical AS (SELECT query_id, rule_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rule_id) AS rank FROM fit) WHERE rank <= 6),
fusedl AS (SELECT query_id, rule_id, 1.0 / (60 + rank) AS score FROM lexical),
picked AS (SELECT query_id, rule_id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM fusedl JOIN v_rules USING (rule_id)),
{NEAR}, {RERANK}"""


@query("r7_retrieve_batch", ctes("v_rules", "v_queries", more=RETRIEVE) + "SELECT q.query_id, md5(CASE WHEN trim(query) = '' THEN 'empty query' ELSE coalesce(a, 'nothing found') END) AS answer FROM v_queries q LEFT JOIN (SELECT query_id, string_agg(context, chr(10) ORDER BY position) AS a FROM pos WHERE position <= 2 GROUP BY 1) USING (query_id)")
def r7(spark, d):
    queries = view(spark, d, "v_queries")
    found = rt.retrieve(queries, placed(spark, d), stop=STOP, index=rule_index(spark, d))
    return rt.answers(queries, found).withColumn("answer", F.md5("answer"))


HYBRID = RETRIEVE.replace("fusedl AS (SELECT query_id, rule_id, 1.0 / (60 + rank) AS score FROM lexical)", "fusedl AS (SELECT query_id, rule_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, rule_id, rank FROM lexical UNION ALL SELECT query_id, rule_id, rank FROM v_retrieval WHERE engine = 'dense') GROUP BY 1, 2)").replace("picked AS (SELECT query_id", "picked AS (SELECT * FROM (SELECT query_id").replace("FROM fusedl JOIN v_rules USING (rule_id))", "FROM fusedl JOIN v_rules USING (rule_id)) WHERE rank <= 10)")


@query("r7_retrieve_hybrid", ctes("v_retrieval", "v_rules", "v_queries", more=HYBRID) + "SELECT query_id, position, rule_id, CAST(overlap AS INT) AS overlap FROM pos WHERE position <= 2")
def r7h(spark, d):
    return rt.retrieve(view(spark, d, "v_queries"), placed(spark, d), dense=dense(spark, d), stop=STOP, index=rule_index(spark, d)).select("query_id", "position", "rule_id", "overlap")


# --- words of scripts without spaces ---

#: The words of part names are the dictionary, and names with their spaces taken out are what is cut.
SEGMENT_LEAD = r"""d AS MATERIALIZED (SELECT w, count(*) AS f FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY 1),
total AS (SELECT CAST(sum(f) AS DOUBLE) AS t FROM d),
m AS MATERIALIZED (SELECT map(list(w ORDER BY w), list(c ORDER BY w)) AS cost, max(length(w)) AS longest, CAST(round(-ln(1 / max(t)) * 1000000) AS BIGINT) AS single
 FROM (SELECT w, greatest(CAST(round(-ln(f / t) * 1000000) AS BIGINT), 0) AS c, t FROM d, total)),
p AS MATERIALIZED (SELECT doc_id, line_no, regexp_extract_all(lower(regexp_replace(line, '\s+', '', 'g')), '[a-z]+|[\p{Lo}\p{N}]+') AS l FROM v_toc_text),
runs AS MATERIALIZED (SELECT DISTINCT r FROM (SELECT unnest(l) AS r FROM p) WHERE regexp_full_match(r, '[a-z]+')),
best(r, j, cost, size) AS (
 SELECT r, 0, [CAST(0 AS BIGINT)], CAST([] AS BIGINT[]) FROM runs
 UNION ALL SELECT r, j + 1, list_append(cost, x.c), list_append(size, -x.z) FROM (
  SELECT r, j, b.cost, size, list_min(list_filter(list_transform(range(1, least(longest, j + 1) + 1), lambda z: {'c': coalesce(element_at(m.cost, substr(r, length(r) - j, z))[1], CASE z WHEN 1 THEN single END) + b.cost[j + 2 - z], 'z': -z}), lambda y: y.c IS NOT NULL)) AS x
  FROM best b, m WHERE j < length(r))),
cut(r, size, pos, words) AS (
 SELECT r, size, 1, CAST([] AS VARCHAR[]) FROM best WHERE j = length(r)
 UNION ALL SELECT r, size, pos + size[length(r) - pos + 1], list_append(words, substr(r, pos, size[length(r) - pos + 1])) FROM cut WHERE pos <= length(r)),
done AS (SELECT r, array_to_string(words, '|') AS w FROM cut WHERE pos > length(r))"""


@query("r1_segmented_words", ctes("v_toc_text", more=SEGMENT_LEAD, recursive=True) + "SELECT doc_id, line_no, string_agg(coalesce(w, x), '|' ORDER BY i) AS words FROM (SELECT doc_id, line_no, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM p) LEFT JOIN done ON r = x GROUP BY 1, 2")
def r1w(spark, d):
    words = view(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    lines = view(spark, d, "v_toc_text").withColumn("line", tx.compact(F.col("line")))
    return sg.segment(lines, "line", words, letters="a-z").select("doc_id", "line_no", F.array_join("words", "|").alias("words"))
