"""Upkeep of the rule corpus: scans, metadata, quality, numbering, upserts, edits, retirement, reconciliation, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.shared import shared_path

EXPERIENCE = "review_experience"
TREE = "pageindex"


def scan(rules: DataFrame, status: str | None = "active") -> DataFrame:
    """All rules, or those of a status, by source and position."""
    kept = rules if status is None else rules.where(F.col("status") == status)
    return kept.orderBy("source_file", "seq_index")


def lookup(rules: DataFrame, ids: DataFrame, key: str = "rule_id") -> DataFrame:
    return rules.join(ids.select(key).distinct(), key, "left_semi")


def display_text() -> Column:
    """The condensed text of a washed rule unless it is blank, else the content."""
    return F.when(F.col("is_washed") & (tx.u_trim(tx.blank(F.col("condensed_content"))) != ""), F.col("condensed_content")).otherwise(F.col("content"))


def metadata(rules: DataFrame) -> DataFrame:
    """The 20 fields of search metadata, and project_id where there is one: every field has its default, also where the column
    is not there at all; texts are cut, an array of flags is joined by commas, a source without a name is its category."""
    kinds = dict(rules.dtypes)
    at = lambda name: F.col(name) if name in kinds else F.lit(None).cast("string")
    c = lambda name, default: tx.or_default(at(name).cast("string"), default).alias(name)
    number = lambda name, default: tx.safe_int(at(name), default).alias(name)
    flags = F.array_join("quality_flags", ",") if kinds.get("quality_flags", "").startswith("array") else at("quality_flags")
    more = [F.coalesce(F.col("project_id").cast("string"), F.lit("")).alias("project_id")] if "project_id" in kinds else []
    return rules.select(
        "rule_id", c("category", ""), number("level", 3), c("wbs_code", "GEN"), F.coalesce(F.nullif(at("source_file"), F.lit("")), F.nullif(at("category"), F.lit("")), F.lit("")).alias("source_file"),
        number("seq_index", -1), c("status", "active"), c("publish_date", "2000-01-01"), c("lifecycle_phase", "BUILD"), F.coalesce(at("is_washed").cast("boolean"), F.lit(False)).alias("is_washed"),
        F.left(tx.blank(at("condensed_content")), F.lit(500)).alias("condensed_content"), tx.blank(F.coalesce(F.nullif(at("ingest_time").cast("string"), F.lit("")), at("ingested").cast("string"))).alias("ingested"),
        c("index_source", "legacy"), F.left(tx.blank(at("content")), F.lit(2000)).alias("full_text"), number("start_index", -1), number("end_index", -1), c("node_title", ""), c("node_id", ""),
        number("quality_score", -1), tx.blank(flags).alias("quality_flags"), F.left(tx.blank(at("quality_notes")), F.lit(500)).alias("quality_notes"), *more,
    )


def payload(rules: DataFrame) -> DataFrame:
    """What a vector index takes: rules with an id and content, with their metadata."""
    kept = rules.where((F.trim(F.col("rule_id").cast("string")) != "") & (tx.u_trim(tx.blank(F.col("content"))) != ""))
    return kept.select("rule_id", display_text().alias("document")).join(metadata(kept), "rule_id")


def eligible(rules: DataFrame, lifecycle: str, generic: str = "GEN", with_experience: bool = False) -> DataFrame:
    kept = rules.where((F.col("status") == "active") & F.col("lifecycle_phase").isin(lifecycle, generic))
    return kept if with_experience else kept.where(F.col("index_source") != EXPERIENCE)


def code_matches(queries: DataFrame, rules: DataFrame, generic: str = "GEN") -> DataFrame:
    """(query_id, rule_id) of rules whose code is the query's or one of its ancestors'."""
    chain = queries.select("query_id", F.explode(tx.ancestry(F.col("wbs_code"), generic)).alias("wbs_code"))
    return chain.join(rules.select("rule_id", "wbs_code"), "wbs_code").select("query_id", "rule_id").distinct()


def neighbours(rules: DataFrame, size: int = 200) -> DataFrame:
    """Texts at the exact positions before and after, among active rules with text; the last of repeated positions."""
    live = rules.where((F.col("status") == "active") & (tx.u_trim(tx.blank(F.col("content"))) != ""))
    at = live.groupBy("source_file", "seq_index").agg(F.max_by(display_text(), F.col("rule_id")).alias("t"))
    before = at.select("source_file", (F.col("seq_index") + 1).alias("seq_index"), tx.tail(F.col("t"), size).alias("prev_text"))
    after = at.select("source_file", (F.col("seq_index") - 1).alias("seq_index"), tx.head(F.col("t"), size).alias("next_text"))
    keys = ["source_file", "seq_index"]
    return live.select("rule_id", *keys).join(before, keys, "left").join(after, keys, "left").select("rule_id", "prev_text", "next_text")


def full_texts(hits: DataFrame, store: DataFrame, key: str = "rule_id") -> DataFrame:
    """``hits(key, fallback)`` with the stored whole text, or the fallback where that is missing or empty."""
    whole = store.select(key, F.col("content").alias("__whole"))
    return hits.join(whole, key, "left").select(*hits.columns, F.coalesce(F.nullif("__whole", F.lit("")), "fallback").alias("full_text"))


def reconcile(stored: DataFrame, indexed: DataFrame, key: str = "rule_id", needed: Sequence[str] = ()) -> DataFrame:
    """One row: ids on one side only, rows lacking a metadata field, and whether to rebuild or refresh the index."""
    a, b = stored.select(key).withColumn("__a", F.lit(True)), indexed.select(key, *[F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(needed)]).withColumn("__b", F.lit(True))
    lacks = F.lit(False)
    for i in range(len(needed)):
        lacks = lacks | F.coalesce(F.col(f"__n{i}"), F.lit(False))
    both = a.join(b, key, "full_outer")
    sums = both.agg(F.count_if(F.col("__b").isNull()).alias("only_stored"), F.count_if(F.col("__a").isNull()).alias("only_indexed"), F.count_if(lacks).alias("lacking"))
    reset = (F.col("only_stored") > 0) | (F.col("only_indexed") > 0)
    return sums.select("*", reset.alias("needs_reset"), (~reset & (F.col("lacking") > 0)).alias("needs_sync"))


def superseded(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Active rules not from a tree whose source or category is among ``categories(category)``."""
    live = rules.where((F.col("status") == "active") & (F.col("index_source") != TREE))
    names = categories.select(F.col("category").alias("__c")).distinct()
    by_source = live.join(names, live["source_file"] == F.col("__c"), "left_semi")
    by_category = live.join(names, live["category"] == F.col("__c"), "left_semi").join(names, live["source_file"] == F.col("__c"), "left_anti")
    return by_source.unionByName(by_category)


def retire(rules: DataFrame, ids: DataFrame, key: str = "rule_id") -> DataFrame:
    gone = ids.select(key).distinct().withColumn("__gone", F.lit(True))
    return rules.join(gone, key, "left").withColumn("status", F.when(F.col("__gone"), "inactive").otherwise(F.col("status"))).select(*rules.columns)


def statistics(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("total"), F.count_if("is_washed").alias("washed"), F.count_if(F.col("status") == "active").alias("active"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


def most_common(rules: DataFrame, group: str, column: str, order: str) -> DataFrame:
    """The most common non-empty value of a column by group, ties to the one seen first."""
    counted = rules.where(tx.blank(F.col(column).cast("string")) != "").groupBy(group, column).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    best = F.max_by(F.struct(F.col(column).alias("v"), F.col("__n").alias("n")), F.struct(F.col("__n").alias("n"), (-F.col("__first")).alias("f")))
    return counted.groupBy(group).agg(best.alias("b")).select(group, F.col("b.v").alias(column), F.col("b.n").alias("n"))


# --- quality ---


#: Penalties of the rule-quality score, the length and symbol-share limits and the critical score.
SHORT, SYMBOLS, TOC_SYMBOLS, CRITICAL = 40, 0.45, 0.28, 35
PENALTY = {"too_short": 80, "mostly_symbols": 35, "symbol_toc": 75, "placeholder_text": 75, "placeholder_in_rule": 15, "publish_info_only": 70, "people_roster": 70, "frontmatter": 25}
CRITICAL_FLAGS = ("too_short", "symbol_toc", "publish_info_only", "people_roster")


def symbol_share(c: Column) -> Column:
    """Share of characters that are neither letters nor digits; 1 for blank text."""
    x = tx.compact(c)
    n = F.length(x)
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) / n)


def quality(rules: DataFrame, patterns: dict[str, str], text: str = "content") -> DataFrame:
    """Score 0 to 100, flags in name order, and the critical bit. ``patterns``: normative, publish, roster, toc,
    placeholder, front and leaders."""
    c = tx.blank(F.col(text))
    has = lambda name: c.rlike(patterns[name])
    norm, share = has("normative"), symbol_share(F.col(text))
    flags = {
        "too_short": F.length(tx.compact(F.col(text))) < SHORT,
        "mostly_symbols": share > SYMBOLS,
        "symbol_toc": has("toc") & (has("leaders") | (share > TOC_SYMBOLS)) & ~norm,
        "placeholder_text": has("placeholder"),
        "publish_info_only": has("publish") & ~norm,
        "people_roster": has("roster") & ~norm,
        "frontmatter": has("front") & ~norm,
    }
    loss = F.lit(0)
    for name, hit in flags.items():
        off = F.when(norm, PENALTY["placeholder_in_rule"]).otherwise(PENALTY[name]) if name == "placeholder_text" else F.lit(PENALTY[name])
        loss = loss + F.when(hit, off).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - loss + F.when(F.col("index_source") == TREE, 8).otherwise(0)))
    names = F.sort_array(F.filter(F.array(*[F.when(hit, F.lit(n)) for n, hit in flags.items()]), lambda x: x.isNotNull()))
    rows = rules.select(*rules.columns, score.alias("score"), names.alias("flags"))
    return rows.withColumn("critical", F.arrays_overlap("flags", tx.strings(CRITICAL_FLAGS)) | (F.col("score") <= CRITICAL))


def quality_audit(rules: DataFrame, patterns: dict[str, str], threshold: int = CRITICAL) -> DataFrame:
    """Rules with score, flags, critical, action (retire, warn or keep) and the status that follows."""
    rows = quality(rules, patterns)
    gone = F.col("critical") | (F.col("score") <= threshold)
    action = F.when(gone & (F.col("status") == "active"), "retire").when(F.size("flags") > 0, "warn").otherwise("keep")
    return rows.withColumn("action", action).withColumn("status", F.when(F.col("action") == "retire", "inactive").otherwise(F.col("status")))


def backfill(rules: DataFrame, lexicon: Sequence[lx.Entry], least: int = 3, generic: str = "GEN") -> DataFrame:
    """(rule_id, wbs_code, confidence) that active generic rules would get."""
    kept = rules.where((F.col("status") == "active") & (F.col("wbs_code") == generic))
    hit = lx.weighted(tx.compact(F.concat_ws("\n", F.col("category"), F.lit(""), F.col("content"))), lexicon, least, generic)
    return kept.select("rule_id", hit.alias("h")).where(F.col("h.code") != generic).select("rule_id", F.col("h.code").alias("wbs_code"), F.col("h.confidence").alias("confidence"))


def gate(rules: DataFrame) -> DataFrame:
    """Structural checks of tree rules: issues of each and whether it passes. For a sample, pass ``rules`` through
    ``sample_rows`` first."""
    n = lambda c: F.length(tx.u_trim(tx.blank(F.col(c))))
    tests = [F.when(F.col("index_source") != TREE, "not_from_tree"), F.when(n("content") < 15, "short_content"), F.when(n("full_text") < 30, "short_full_text")]
    if {"start_index", "end_index"} <= set(rules.columns):
        tests.append(F.when((F.col("start_index") >= 0) & (F.col("end_index") >= 0) & (F.col("start_index") > F.col("end_index")), "reversed_pages"))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return rules.withColumn("issues", found).withColumn("passed", F.size("issues") == 0)


def sample_rows(rules: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a hash of their id and the seed, so however they are partitioned: the sampling operator, whose
    limit is its purpose."""
    return rules.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("rule_id").cast("string"))), "rule_id").limit(max(1, n))


# --- numbering ---


def running(rows: DataFrame, group: str, order: str, amount: str | None = None) -> DataFrame:
    """``rows``, which should be narrow, with __no, their place in their group from 1, and __before, the sum of ``amount``
    over the rows before them.

    Ranges of (group, order) are counted apart and moved on by what the ranges before them hold, so a group may span any
    number of tasks. The ranges are written, as both passes must see the same ones.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "ranges")
    value = F.col(amount).cast("long") if amount else F.lit(0).cast("long")
    rows.repartitionByRange(group, order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.schema(rows.select(*rows.columns, F.lit(0).alias("__p")).schema).parquet(path)
    sums = kept.groupBy(F.col(group).alias("__g"), F.col("__p").alias("__q")).agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    earlier = Window.partitionBy("__g").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__g", "__q", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s"))
    here = Window.partitionBy(group, "__p").orderBy(order)
    rest = here.rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("__no", F.row_number().over(here)).withColumn("__before", F.coalesce(F.sum(value).over(rest), F.lit(0)))
    both = placed.join(base, placed[group].eqNullSafe(base["__g"]) & (placed["__p"] == base["__q"]))
    return both.select(*rows.columns, (F.col("__no") + F.col("__n")).alias("__no"), (F.col("__before") + F.col("__s")).alias("__before"))


def renumber(rules: DataFrame, group: str, order: str, key: str = "rule_id") -> DataFrame:
    """Rules numbered from 0 within their group. Only the ids are sorted; ``key`` is unique."""
    at = running(rules.select(*dict.fromkeys([group, order, key])), group, order).select(key, (F.col("__no") - 1).cast("int").alias("__at"))
    kept = [F.col("__at").alias(c) if c == "seq_index" else F.col(c) for c in dict.fromkeys([*rules.columns, "seq_index"])]
    return rules.drop("seq_index").join(at, key).select(*kept)


def append_numbers(stored: DataFrame, new: DataFrame, group: str = "source_file", order: str = "rule_id") -> DataFrame:
    """New rules numbered after the largest position that their source holds. ``order`` is unique. The new rules are made once
    and written: numbering reads them three times."""
    path = shared_path(new.sparkSession, "new")
    new.write.parquet(path)
    new = new.sparkSession.read.schema(new.schema).parquet(path)
    top = stored.groupBy(group).agg(F.max("seq_index").alias("__top"))
    placed = renumber(new, group, order, order).join(top, group, "left")
    return placed.withColumn("seq_index", F.coalesce(F.col("__top"), F.lit(-1)) + F.col("seq_index") + 1).select(*dict.fromkeys([*new.columns, "seq_index"]))


# --- table writes: each returns the new state of the table ---


def last_of(updates: DataFrame, key: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return updates.withColumn("__r", rank).where("__r = 1").drop("__r")


def upsert(base: DataFrame, updates: DataFrame, key: str = "rule_id", order: str = "append_no") -> DataFrame:
    """Base rows that no update names, and the last update of each key."""
    last = last_of(updates, key, order)
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def replace_all(updates: DataFrame, key: str = "rule_id", order: str = "append_no") -> DataFrame:
    return last_of(updates, key, order).drop(order)


def delete(base: DataFrame, ids: DataFrame, key: str = "rule_id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def delete_where(base: DataFrame, column: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the table without the rows whose ``column`` is among ``values``, and one row (deleted): how many went."""
    gone = base.join(values.select(column).distinct(), column, "left_semi")
    return base.join(values.select(column).distinct(), column, "left_anti"), gone.agg(F.count("*").alias("deleted"))


def edit(base: DataFrame, edits: DataFrame, fields: Sequence[str], key: str = "rule_id") -> DataFrame:
    """Fields of ``edits`` that are not null replace those of the base; edited rows are marked as revised."""
    new = edits.select(key, *[F.col(f).alias(f"__{f}") for f in fields]).withColumn("__hit", F.lit(True))
    out = base.join(new, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"__{f}", f))
    return out.withColumn("revised", F.coalesce("__hit", F.lit(False))).select(*base.columns, "revised")


def batch_edit(base: DataFrame, edits: DataFrame, deletes: DataFrame, fields: Sequence[str], key: str = "rule_id") -> DataFrame:
    """Deletes first, then edits; ids that are not there are ignored."""
    return edit(delete(base, deletes, key), edits, fields, key)


def wash(base: DataFrame, washed: DataFrame, key: str = "rule_id") -> DataFrame:
    new = washed.select(key, F.col("condensed_content").alias("__t"))
    out = base.join(new, key, "left").withColumn("is_washed", F.col("is_washed") | F.col("__t").isNotNull()).withColumn("condensed_content", F.coalesce("__t", "condensed_content"))
    return out.select(*base.columns)


def replace_source(base: DataFrame, new: DataFrame, index_source: str) -> DataFrame:
    """Rows of an index source are replaced by ``new``."""
    return base.where(F.col("index_source") != index_source).unionByName(new.select(*base.columns))


def union_kept(kept: DataFrame, new: DataFrame, key: str = "rule_id") -> DataFrame:
    return kept.join(new.select(key), key, "left_anti").unionByName(new.select(*kept.columns))


# --- overlapping windows ---


def windows(blocks: DataFrame, doc: str, block: str, heading: str, text: str, size: int = 800, overlap: int = 200, least: int = 15) -> DataFrame:
    """Windows of ``size`` characters, each ``overlap`` into the one before, over a document's blocks in order.

    A block is its heading line and its text; blocks are two characters apart. Blocks and windows whose stripped text
    has fewer than ``least`` characters are left out; windows left out still advance. Nothing longer than a window is
    ever put together, and the places of blocks come from ``running``, so a document of any length works. The numbers of
    a document's blocks are distinct.
    """
    size, overlap = max(1, size), max(0, min(overlap, max(1, size) - 1))
    step = max(1, size - overlap)
    t = tx.u_trim(tx.blank(F.col(text)))
    h = tx.or_default(tx.u_trim(F.col(heading)), "untitled")
    parts = blocks.select(doc, F.col(block).alias("__b"), h.alias("h"), t.alias("t")).where(F.length("t") >= least).withColumn("x", F.concat(F.lit("### "), F.col("h"), F.lit("\n"), F.col("t")))
    spark, sizes = blocks.sparkSession, shared_path(blocks.sparkSession, "sizes")
    narrow = parts.select(doc, "__b", (F.length("x") + 2).alias("__step"))
    narrow.write.parquet(sizes)  # the texts are measured once, not again to find the ranges
    at = running(spark.read.schema(narrow.schema).parquet(sizes), doc, "__b", "__step")
    at = at.select(doc, "__b", F.col("__no").alias("no"), F.col("__before").alias("start"), (F.col("__before") + F.col("__step") - 2).alias("end"))
    total = at.groupBy(doc).agg(F.max("end").alias("total"), F.max("no").alias("last"))
    # places are narrow: written, their size is known, so texts travel only where it is too large to be sent to them
    placed, path = at.join(total, doc), shared_path(spark, "places")
    placed.write.parquet(path)
    parts = parts.join(spark.read.schema(placed.schema).parquet(path), [doc, "__b"]).withColumn("y", F.when(F.col("no") < F.col("last"), F.concat("x", F.lit("\n\n"))).otherwise(F.col("x")))
    until = F.col("end") + F.when(F.col("no") < F.col("last"), 2).otherwise(0)  # known: the text is not measured again
    count = F.when(F.col("total") <= size, F.lit(1)).otherwise(1 + F.ceil((F.col("total") - size) / F.lit(step)))
    # a window w covers [w * step, w * step + size): the windows that a block touches, without a join
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / F.lit(step)) + 1)
    final = F.least(count - 1, F.ceil(until / F.lit(step)) - 1)
    at = parts.withColumn("w", F.explode(F.when(final >= first, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))))
    lo, hi = F.col("w") * step, F.least(F.col("total"), F.col("w") * step + size)
    piece = F.substring("y", (F.greatest(lo, F.col("start")) - F.col("start") + 1).cast("int"), F.greatest(F.lit(0), F.least(hi, until) - F.greatest(lo, F.col("start"))).cast("int"))
    names = (F.col("end") > lo) & (F.col("start") < hi)
    rows = at.select(doc, "w", "no", piece.alias("piece"), F.when(names, F.col("h")).alias("name"))
    got = rows.groupBy(doc, "w").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "piece"))), lambda s: s["piece"]), "").alias("raw"),
        F.array_distinct(F.transform(F.sort_array(F.filter(F.collect_list(F.struct("no", "name")), lambda s: s["name"].isNotNull())), lambda s: s["name"])).alias("names"),
    )
    label = F.when(F.size("names") == 0, "continued").when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(F.concat(F.get("names", F.lit(0)), F.lit(" ... "), F.element_at("names", -1)))
    return got.select(doc, F.col("w").cast("int").alias("window_no"), label.alias("heading"), tx.u_trim(F.col("raw")).alias("text")).where(F.length("text") >= least)
