"""Sources and sinks: rule JSON, mapping files, file inventories, HTML and sheets as sections, bills, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .shared import shared_path

#: Words of a bill's header and of its text, quantity and price columns.
HEADER = ("特征", "名称", "内容", "单价", "合价", "数量")
ITEM = ("特征", "项目", "名称", "内容", "明细", "描述", "说明", "意见")
QUANTITY = ("数量", "量")
PRICE = ("单", "价")


def rules_json(spark: SparkSession, path: str, schema: str, key: str = "rule_id", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rules of a JSON file, or of a folder of JSON ``lines``, that have an id, and one row of counts (loaded, stored)."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_bad").json(path)
    return _with_id(rows.drop("_bad"), key)


def rules_text(lines: DataFrame, column: str, schema: str, key: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """The same from a column of JSON objects, one a row."""
    return _with_id(lines.select(F.from_json(column, schema).alias("r")).select("r.*"), key)


def _with_id(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    good = tx.blank(F.trim(F.col(key).cast("string"))) != ""
    return rows.where(good), rows.agg(F.count("*").alias("loaded"), F.count_if(good).alias("stored"))


def mapping(rows: DataFrame, paths: Sequence[str], order: str, files: DataFrame | None = None) -> DataFrame:
    """(project_name, path): the first non-empty path column; the last of repeated names; only paths among ``files(path)``."""
    found = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in paths])
    out = rows.select(tx.clean(F.col("project_name")).alias("project_name"), found.alias("path"), order).where("project_name <> '' and path is not null")
    out = out.groupBy("project_name").agg(F.max_by("path", order).alias("path"))
    return out if files is None else out.join(files.select("path").distinct(), "path", "left_semi").select("project_name", "path")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A mapping file: CSV with a header, or JSON records."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.option("multiLine", True).json(path)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, length) of the files under a folder, without temporary ones; their contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").where(~F.startswith("name", F.lit("~$")) & ~F.startswith("name", F.lit(".")))


def html_sections(pages: DataFrame, least: int = 15) -> DataFrame:
    """Sections of HTML: text under the latest heading; tables are sections of their own; short ones go.
    (page_id, section_no, heading, text)."""
    block = r"(?is)<(h[1-6]|p|li|td|table)\b[^>]*>(.*?)</\1>"
    every = F.regexp_extract_all("html", F.lit(block), 0)
    rows = pages.select("page_id", F.posexplode(every).alias("no", "x"))
    rows = rows.select("page_id", "no", F.lower(F.regexp_extract("x", r"^<(\w+)", 1)).alias("tag"), tx.without_markup(F.col("x")).alias("t")).where("t <> ''")
    order = Window.partitionBy("page_id").orderBy("no")
    head = F.col("tag").rlike("^h[1-6]$")
    rows = rows.withColumn("h", F.coalesce(F.last(F.when(head, F.col("t")), ignorenulls=True).over(order), F.lit("untitled")))
    rows = rows.withColumn("section_no", F.sum((head | (F.col("tag") == "table")).cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("no", "t")))), lambda s: s["t"]), "\n")
    return rows.groupBy("page_id", "section_no").agg(F.min_by("h", "no").alias("heading"), text.alias("text")).where(F.length("text") >= least)


def located_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, location, line) of every line that is not blank."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return rows.select(doc, "line_no", F.concat(F.lit("line "), F.col("line_no") + 1).alias("location"), "line")


def full_text(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    return lines.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"))


def _has(c: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def cell_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, cells) of a long cell table (sheet, row, col, value); a table that has its cells by row stays as it is."""
    return cells if "cells" in cells.columns else cells.groupBy("sheet", "row").agg(F.collect_list(F.struct("col", "value")).alias("cells"))


def bill_items(cells: DataFrame) -> DataFrame:
    """Bill items of a long cell table, or of rows of cells (see ``cell_rows``): (sheet, row, name, quantity, price).

    The header is the first row of rows 2 to 14 with a header word, else row 1. Text columns are all that match, the
    quantity and price columns the last that match; if either number does not parse, both fall back to 1 and 0.
    Cells are put together by row once and written; only headers and whole rows meet by sheet.
    """
    spark, path, rows = cells.sparkSession, shared_path(cells.sparkSession, "rows"), cell_rows(cells)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    of = lambda words: F.transform(F.filter("cells", lambda c: _has(c["value"], words)), lambda c: c["col"])
    headed = F.col("row").between(2, 14) & F.exists("cells", lambda c: _has(c["value"], HEADER))
    first = rows.where((F.col("row") == 1) | headed).select("sheet", "row", of(ITEM).alias("items"), F.array_max(of(QUANTITY)).alias("qc"), F.array_max(of(PRICE)).alias("pc"))
    head = first.groupBy("sheet").agg(F.min_by(F.struct(F.col("row").alias("h"), "items", "qc", "pc"), F.when(F.col("row") == 1, 15).otherwise(F.col("row"))).alias("head"))
    body = rows.join(head, "sheet", "left").select("sheet", "row", "cells", F.coalesce("head.h", F.lit(1)).alias("h"), F.coalesce("head.items", F.array()).alias("items"), "head.qc", "head.pc").where("row > h")
    is_text = lambda c: F.array_contains("items", c["col"]) | ((F.size("items") == 0) & (c["col"] == 2))
    texts = F.transform(F.filter("cells", lambda c: is_text(c) & (F.trim(c["value"]) != "")), lambda c: F.struct(c["col"].alias("col"), F.trim(c["value"]).alias("v")))
    at = lambda k: F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == F.col(k)), lambda c: c["value"]))
    got = body.select("sheet", "row", F.array_join(F.transform(F.sort_array(texts), lambda s: s["v"]), " | ").alias("name"), at("qc").alias("q"), at("pc").alias("p"))
    bad = (F.col("q").isNotNull() & F.col("q").try_cast("double").isNull()) | (F.col("p").isNotNull() & F.col("p").try_cast("double").isNull())
    number = lambda c, d: F.when(bad, F.lit(d)).otherwise(F.coalesce(F.col(c).try_cast("double"), F.lit(d)))
    return got.where("name <> ''").select("sheet", "row", "name", number("q", 1.0).alias("quantity"), number("p", 0.0).alias("price"))


def sheet_sections(cells: DataFrame, aliases: Sequence[lx.Entry]) -> DataFrame:
    """Sections of sheets (sheet, section_no, heading, text) of a long cell table, or of rows of cells (see ``cell_rows``): a row
    with an alias opens one, rows before the first go; a sheet without any is one section."""
    told = F.filter("cells", lambda c: F.trim(c["value"]) != "")
    rows = cell_rows(cells).select("sheet", "row", told.alias("told")).where(F.size("told") > 0)
    rows = rows.select("sheet", "row", F.array_join(F.transform(F.sort_array("told"), lambda s: s["value"]), " | ").alias("t"))
    order = Window.partitionBy("sheet").orderBy("row")
    rows = rows.withColumn("k", lx.first_hit(F.col("t"), aliases)).withColumn("section_no", F.sum(F.col("k").isNotNull().cast("int")).over(order)).withColumn("any", F.max(F.col("k").isNotNull()).over(Window.partitionBy("sheet")))
    kept = rows.where((F.col("section_no") > 0) | ~F.col("any"))
    return kept.groupBy("sheet", "section_no").agg(F.coalesce(F.max("k"), F.lit("sheet")).alias("heading"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "t"))), lambda s: s["t"]), "\n").alias("text"))


def over_ceiling(bill: DataFrame, prices: Sequence[tuple[str, float]]) -> DataFrame:
    """Bill rows whose name holds a keyword with a ceiling: RED for a ceiling of nothing, YELLOW above it."""
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(float(p)).alias("ceiling")) for k, p in prices])
    rows = bill.select(*bill.columns, F.explode(F.filter(table, lambda r: F.contains("name", r["keyword"]))).alias("r")).select(*bill.columns, "r.*")
    return rows.where((F.col("ceiling") == 0) | (F.col("price") > F.col("ceiling"))).withColumn("level", F.when(F.col("ceiling") == 0, "RED").otherwise("YELLOW"))


def cost_role(name: Column, cost: Sequence[str]) -> Column:
    return tx.contains_any(name, cost)


def cost_context(lines: DataFrame, words: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """(doc, context): a document's lines with price words, in order."""
    return full_text(lines.where(tx.contains_any(F.col("line"), words)), doc).withColumnRenamed("text", "context")


def write_reports(df: DataFrame, path: str, by: str | None = None, kind: str = "json") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).format(kind).save(path)


def entered_paths(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """(project_name, user_supplied_path) of a manifest that users filled in: CSV with a header, or JSON rows. The path stands
    in user_supplied_path, source_path or path, the first that is not empty; rows without one go."""
    rows = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.option("multiLine", True).json(path)
    names = [F.nullif(tx.clean(F.col(c)), F.lit("")) for c in ("user_supplied_path", "source_path", "path") if c in rows.columns]
    found = rows.select(tx.clean(F.col("project_name")).alias("project_name"), F.coalesce(*names, F.lit(None).cast("string")).alias("user_supplied_path"))
    return found.where("project_name <> '' and user_supplied_path is not null").groupBy("project_name").agg(F.max("user_supplied_path").alias("user_supplied_path"))


def write_manifest(report: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """One CSV row a project, its counters by reason as JSON; paths that users entered before are kept."""
    rows = report
    counters = [c for c in ("without_file", "mismatched", "without_evidence", "without_checkpoint", "to_review") if c in rows.columns]
    if counters:
        pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in counters]), lambda p: p["v"] > 0)
        rows = rows.withColumn("reasons", F.to_json(F.map_from_entries(pairs)))
    if existing is not None:
        rows = rows.join(existing.select("project_name", "user_supplied_path"), "project_name", "left")
    else:
        rows = rows.withColumn("user_supplied_path", F.lit(""))
    rows = rows.withColumn("user_supplied_path", tx.blank(F.col("user_supplied_path")))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return rows


def write_analysis(cards: DataFrame, cases: DataFrame, methodology: DataFrame, folder: str) -> None:
    """The three results of an analysis as JSON lines, each in a folder of its own."""
    for name, df in (("cards", cards), ("cases", cases), ("methodology", methodology)):
        write_reports(df, f"{folder}/{name}")


def load_cards(spark: SparkSession, path: str, schema, rules: DataFrame, limit: int | None = None, order: str = "card_id") -> DataFrame:
    """Cards of the file of an earlier analysis; where there is none, or it is empty, those stored in experience rules. ``limit``:
    only the first so many in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    found = spark.read.schema(schema).json(path) if there else None
    if found is None or found.isEmpty():
        found = rules.where("index_source = 'review_experience'").select(F.from_json("full_text", schema).alias("c")).where("c is not null").select("c.*")
    return found if limit is None else found.orderBy(order).limit(limit)


def registry_jobs(rows: DataFrame) -> DataFrame:
    return rows.where((tx.blank(F.col("path")) != "") & (tx.blank(F.col("category")) != ""))
