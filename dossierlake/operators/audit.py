"""Document audits: sectioning, routing, findings, their dedup, merge, grouping and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx
from . import index as ix

#: Fixed value: the row mark of flattened sheets.
ROW_MARK = r"^\[第\d+行\]:\s*"


def section_lines(lines: DataFrame, aliases: Sequence[lx.Entry], doc: str = "doc_id", no: str = "line_no", line: str = "line", default: str = "other") -> DataFrame:
    """Sections (doc, section_no, section_type, text): a line with an alias opens one, but the first line never does."""
    text = tx.u_trim(F.regexp_replace(tx.u_trim(F.col(line)), ROW_MARK, ""))
    order = Window.partitionBy(doc).orderBy(no)
    rows = lines.select(doc, no, text.alias("t")).where("t <> ''").withColumn("k", lx.first_hit(F.col("t"), aliases))
    rows = rows.withColumn("first", F.row_number().over(order) == 1)
    rows = rows.withColumn("section_no", F.sum((F.col("k").isNotNull() & ~F.col("first")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.coalesce(F.min_by(F.when(~F.col("first"), F.col("k")), F.col(no)), F.lit(default))
    return rows.groupBy(doc, "section_no").agg(kind.alias("section_type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(no, "t"))), lambda s: s["t"]), "\n").alias("text"))


def merge_short(sections: DataFrame, doc: str = "doc_id", least: int = 80) -> DataFrame:
    """A section of fewer than ``least`` characters joins the one before it if that has the same type."""
    order = Window.partitionBy(doc).orderBy("section_no")
    rows = sections.where(tx.u_trim(tx.blank(F.col("text"))) != "")
    new = F.coalesce((F.lag("section_type").over(order) != F.col("section_type")) | (F.length("text") >= least), F.lit(True))
    rows = rows.withColumn("__g", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(doc, "__g").agg(F.min("section_no").alias("section_no"), F.first("section_type").alias("section_type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "text"))), lambda s: s["text"]), "\n").alias("text")).drop("__g")


def without_lines(sections: DataFrame, section_type: str, word: str) -> DataFrame:
    """Lines with ``word`` leave sections of one type; sections left empty go."""
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit(word))), "\n")
    return sections.withColumn("text", F.when(F.col("section_type") == section_type, kept).otherwise(F.col("text"))).where("text <> ''")


def triage(heading: Column, text: Column, noise: Sequence[str], keywords: Sequence[str]) -> Column:
    """At least ten characters; a noise heading needs a keyword; else a keyword or eighty characters."""
    x = tx.compact(F.concat_ws("\n", heading, text))
    key = tx.contains_any(x, keywords)
    return (F.length(x) >= 10) & (~tx.contains_any(heading, noise) | key) & (key | (F.length(x) >= 80))


def route(rows: DataFrame, text: str, labels: Sequence[lx.Entry], fixed: Sequence[str], most: int) -> DataFrame:
    """Labels of each row: the fixed ones, then triggered ones in order of priority, cut at ``most``: (..., label, place)."""
    hit = F.transform(lx.matches(F.col(text), [e for e in labels if e.code not in fixed]), lambda r: r["code"])
    return rows.select(*rows.columns, F.posexplode(F.slice(F.concat(tx.strings(fixed), hit), 1, most)).alias("place", "label"))


def forward_check(text: Column, context: Column, words: Sequence[str]) -> Column:
    return (tx.u_trim(tx.blank(context)) != "") & tx.contains_any(text, words)


def complexity(docs: DataFrame, conditions: Sequence[tuple[str, Column]]) -> DataFrame:
    """Number and names of the conditions that hold: columns of ``docs``, complexity, reasons."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]), lambda x: x.isNotNull())
    return docs.withColumn("reasons", found).withColumn("complexity", F.size("reasons"))


def domain_terms(c: Column, terms: Sequence[str]) -> Column:
    return tx.hits(c, terms)


def prefer_detailed(findings: DataFrame, terms: Sequence[str], text: str = "finding") -> DataFrame:
    """Findings without controls go where they share a domain term with one that has them, in the same document."""
    rows = findings.withColumn("__t", tx.hits(F.col(text), terms))
    detailed = rows.where("has_controls").select("doc_id", F.explode("__t").alias("__term")).distinct()
    lesser = rows.where("not has_controls").select("doc_id", "issue_no", F.explode("__t").alias("__term"))
    gone = lesser.join(detailed, ["doc_id", "__term"], "left_semi").select("doc_id", "issue_no").distinct()
    return rows.drop("__t").join(gone, ["doc_id", "issue_no"], "left_anti")


def keep_first(rows: DataFrame, keys: Sequence, order: Sequence[str]) -> DataFrame:
    """The first row of each key; never an arbitrary one."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def semantic_dedupe(findings: DataFrame, terms: Sequence[str], text: str = "finding") -> DataFrame:
    """Greedy dedup inside a document, in order: a finding goes if an earlier kept one has its key, contains it or is
    contained in it, or shares enough hint terms (two from a model against one with controls, three of one item and
    dimension, else four). Features are columns; the pass that depends on order runs by document, many documents a call."""
    flat = F.regexp_replace(tx.blank(F.col(text)), r"(?U)\W+", "")
    names = findings.columns
    said = F.struct(F.col("issue_no").isNull().alias("__n"), "issue_no", F.struct(*names).alias("row"), flat.alias("x"), tx.hits(F.col(text), terms).alias("t"))
    docs = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(said)).alias("s"))
    part = lambda name: F.col(f"s.{name}")
    fields = ("work_item", "dimension", "origin", "has_controls")
    docs = docs.select(part("row").alias("rows"), part("x"), part("t")).select("rows", "x", "t", *[F.col(f"rows.{f}") for f in fields])

    def chosen(x: list, terms_: list, item: list, dimension: list, origin: list, controls: list) -> list[int]:
        kept, keys = [], set()
        for i, (y, t, w, d, o) in enumerate(zip(x, terms_, item, dimension, origin)):
            words, key = set(t), (w, d, y[:32])
            if key in keys:
                continue
            model = str(o).startswith("ai_")
            for k, other in kept:
                z, same = x[k], len(words & other)
                if (y and z and (y in z or z in y)) or (same >= 2 and ((model and controls[k]) or same >= (3 if (item[k], dimension[k]) == (w, d) else 4))):
                    break
            else:
                keys.add(key)
                kept.append((i, words))
        return [i for i, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [b[c].to_pylist() for c in ("x", "t", *fields)]
            yield pa.RecordBatch.from_arrays([b["rows"], pa.array([chosen(*d) for d in zip(*told)], pa.list_(pa.int32()))], ["rows", "kept"])

    shape = T.StructType([docs.schema["rows"], T.StructField("kept", T.ArrayType(T.IntegerType()))])
    found = docs.mapInArrow(run, shape)
    return found.select(F.explode(F.transform("kept", lambda i: F.get("rows", i))).alias("r")).select("r.*")


def decide(findings: DataFrame, decisions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Reviewer decisions (doc_id, candidate_index, decision_no, action, fields): the first of a candidate counts, keep is
    the default, drop removes, revise overwrites with what is not empty."""
    first = keep_first(decisions, ["doc_id", "candidate_index"], ["decision_no"])
    new = first.select("doc_id", F.col("candidate_index").alias("issue_no"), F.lower(F.trim("action")).alias("__a"), *[F.col(f).alias(f"__{f}") for f in fields])
    rows = findings.join(new, ["doc_id", "issue_no"], "left").where(F.coalesce("__a", F.lit("keep")) != "drop")
    for f in fields:
        rows = rows.withColumn(f, F.when(F.col("__a") == "revise", F.coalesce(F.nullif(f"__{f}", F.lit("")), f)).otherwise(F.col(f)))
    return rows.select(*findings.columns)


def group(findings: DataFrame, docs: DataFrame, fields: Sequence[str] = ("issue_no", "finding"), placeholder: str = "overall") -> DataFrame:
    """(doc_id, work_item, n, issues): findings by work item in order; a placeholder for documents without any."""
    by = findings.groupBy("doc_id", "work_item").agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("issues"))
    bare = docs.select("doc_id").distinct().join(findings.select("doc_id").distinct(), "doc_id", "left_anti")
    return by.unionByName(bare.select("doc_id", F.lit(placeholder).alias("work_item"), F.lit(0).cast("bigint").alias("n"), F.lit("[]").alias("issues")))


def point_lines(assessments: Column) -> Column:
    """Checkpoints as lines, ``- name: status``, in white space of one blank; those without a name or a status go."""
    kept = F.filter(assessments, lambda a: (tx.compact(a["name"]) != "") & (tx.compact(a["status"]) != ""))
    return F.array_join(F.transform(kept, lambda a: F.concat(F.lit("- "), tx.clean(a["name"]), F.lit(": "), tx.clean(a["status"]))), "\n")


def render(finding: str = "finding", reason: str = "dimension", origin: str = "origin", points: Column | None = None) -> Column:
    """A finding as text; ``points``: its assessments, which follow as lines where there are any."""
    head = [F.concat(F.lit("finding: "), F.col(finding)), F.concat(F.lit("reason: "), F.col(reason)), F.concat(F.lit("origin: "), F.col(origin))]
    if points is not None:
        lines = point_lines(F.coalesce(points, F.array().cast("array<struct<name:string,status:string>>")))
        head.append(F.when(lines != "", F.concat(F.lit("points:\n"), lines)))
    return F.concat_ws("\n", *head)


def scorecard(findings: DataFrame, expected: Sequence[str], forbidden: Sequence[str], group_by: str = "doc_id", suppressed: Sequence[str] = ()) -> DataFrame:
    """Of each case: expected words found and missing, forbidden and suppressed words found."""
    text = findings.groupBy(group_by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("issue_no", "finding"))), lambda s: s["finding"]), "\n\n").alias("t"), F.count("*").alias("n"))
    held = lambda words: F.filter(tx.strings(words), lambda w: F.contains("t", w))
    hit = held(expected)
    return text.select(group_by, "n", F.array_join(hit, ",").alias("found"), F.array_join(F.array_except(tx.strings(expected), hit), ",").alias("missing"), F.array_join(held(forbidden), ",").alias("forbidden"), F.array_join(held(suppressed), ",").alias("suppressed"))


def failure_notices(answers: DataFrame, pattern: str, doc: str = "doc_id", label: str = "label", text: str = "text", show: int = 3) -> DataFrame:
    """Of each document whose scorers failed: the first distinct labels and how many there are."""
    bad = answers.where(F.col(text).rlike(pattern)).select(doc, label).distinct()
    return bad.groupBy(doc).agg(F.sort_array(F.collect_set(label)).alias("l")).select(doc, F.array_join(F.slice("l", 1, show), ",").alias("labels"), F.size("l").alias("n"))


def query_list(findings: DataFrame, fallback: DataFrame, limit: int = 6, size: int = 160) -> DataFrame:
    """Search queries of each document: distinct, cut, the first ``limit``; those of ``fallback(doc_id, ordinal, query)`` where
    there is none."""
    own = findings.select("doc_id", F.col("issue_no").alias("ordinal"), F.left(tx.compact(F.concat_ws(" ", "work_item", "finding")), F.lit(size)).alias("query")).where("query <> ''")
    rest = fallback.join(own.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "query")
    first = own.unionByName(rest).groupBy("doc_id", "query").agg(F.min("ordinal").alias("ordinal"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "query"))).where(F.col("place") <= limit).select("doc_id", "query", "place")


# --- model answers as rows ---


def json_array(c: Column, schema: str) -> Column:
    """The array of a model's answer: in a fenced block, or from the first bracket to the last; null if it is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    body = F.coalesce(F.nullif(F.trim(fenced), F.lit("")), F.nullif(bare, F.lit("")), c)
    return F.when(F.startswith(F.trim(body), F.lit("[")), F.from_json(body, schema))


def tool_plan(answers: DataFrame, text: str, tools: Sequence[str], limit: int = 6) -> DataFrame:
    """Valid actions of each answer: allowed tools with a query, distinct, cut, the first ``limit``."""
    rows = answers.select("doc_id", F.posexplode(json_array(F.col(text), "array<struct<tool:string,query:string,reason:string>>")).alias("i", "x"))
    rows = rows.select("doc_id", "i", F.trim("x.tool").alias("tool"), F.trim("x.query").alias("query"), F.left(F.trim(tx.blank(F.col("x.reason"))), F.lit(240)).alias("reason")).where(F.col("tool").isin(*tools) & (tx.blank(F.col("query")) != ""))
    rows = keep_first(rows, ["doc_id", "tool", "query"], ["i"]).withColumn("query", F.left("query", F.lit(160)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).where(F.col("place") <= limit).drop("i")


def answer_findings(answers: DataFrame, text: str, dimensions: Sequence[str], origin: str = "ai_final") -> DataFrame:
    """Findings of each answer that name a finding, a reason and a recommendation; other fields get defaults."""
    shape = "array<struct<work_item:string,dimension:string,finding:string,reason:string,recommendation:string,confidence:string>>"
    rows = answers.select("doc_id", F.posexplode(json_array(F.col(text), shape)).alias("issue_no", "x")).select("doc_id", "issue_no", "x.*")
    for c in ("finding", "reason", "recommendation"):
        rows = rows.where(tx.compact(F.col(c)) != "")
    rows = rows.withColumn("dimension", F.when(F.col("dimension").isin(*dimensions), F.col("dimension")).otherwise(dimensions[0])).withColumn("confidence", F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium"))
    return keep_first(rows.withColumn("origin", F.lit(origin)), ["doc_id", "work_item", "finding"], ["issue_no"])


def run(docs: DataFrame, lines: DataFrame, aliases: Sequence[lx.Entry], rules: Sequence[lx.FindingRule], terms: Sequence[str], cards_: DataFrame | None = None) -> DataFrame:
    """The model-free audit of many documents: sections, declarative rules, experience, dedup, grouping.

    ``cards_(doc_id, card_id, overlap, opinion, work_category)``: experience already matched to documents.
    """
    sections = merge_short(section_lines(lines, aliases))
    text = sections.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "text"))), lambda s: s["text"]), "\n").alias("text"))
    local = lx.fire(text, "text", rules).select("doc_id", (F.lit(1000) + F.col("ordinal")).alias("issue_no"), F.col("rule_id").alias("work_item"), F.lit("complete").alias("dimension"), F.concat_ws(": ", "message", F.nullif(F.array_join("missing", ","), F.lit(""))).alias("finding"), F.lit(False).alias("has_controls"), F.lit("local").alias("origin"))
    found = local
    if cards_ is not None:  # experience comes before rules, so it is what the dedup keeps
        order = Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "card_id")
        found = cards_.select("doc_id", F.row_number().over(order).alias("issue_no"), F.col("work_category").alias("work_item"), F.lit("complete").alias("dimension"), F.col("opinion").alias("finding"), F.lit(True).alias("has_controls"), F.lit("experience").alias("origin")).unionByName(local)
    # each is read more than once: written, so that texts are matched and lines are put together once
    found = ix.kept(found, "found")
    return group(ix.kept(semantic_dedupe(prefer_detailed(found, terms), terms), "issues"), docs)
