"""Document structure: trees, contents pages, contents lines in three modes, page alignment and filling."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import shared_path
from . import rules as rl
from . import scan as sc

#: Titles of front matter, contents markers and entry patterns.
FRONT = ("preface", "front matter", "foreword", "cover", "前言", "目录", "封面", "公告")
MARKER = r"目\s*次"
NUMBERED = r"^(\d+(?:\s*\.\s*\d+)*)\s*(?!附录)([一-鿿].+)$"
APPENDIX = r"^(?:\d+\s*)?(附录\s*[A-Za-zＡ-Ｚａ-ｚ])\s*(.+)$"
SPECIAL = r"^(本标准用词说明|引用标准名录|附\s*[:：].+)\s*(.*)$"
TRAILING_PAGE = r"((?:\d\s*){1,3})\s*$"
ENGLISH, ENGLISH_INLINE = r"(?i)^\s*\d*\s*Contents\b", r"(?i)InContents"
CLOSING = r"本(?:规范|标准)用词说明|引用标准名录|附\s*[:：]\s*条文说明"
INLINE_MARK = (
    r"(?U)(?<![\w一-鿿])(?:附录\s*[A-Za-zＡ-Ｚａ-ｚ](?=\s*[一-鿿])|[A-Za-zＡ-Ｚａ-ｚ]\s*\.\s*\d+(?=\s*[一-鿿])"
    rf"|\d{{1,2}}(?:\s*\.\s*\d+)*(?!\s*(?:{CLOSING}))(?=\s*[一-鿿])|{CLOSING})"
)
GLUED_PAGE = r"([…⋯·.]\s*)(\d{1,3})(?=\d{1,2}\s*[.．]\s*\d+\s*[一-鿿])"


def levels(nodes: DataFrame, spark: SparkSession, key: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """All nodes that a root reaches, with their path of titles and depth (1 for a root).

    The path grows one level a round by an equi-join on the parent, so depth, not size, sets the number of rounds. A level is
    written before the next one reads it, so no level is computed twice. Nodes on a cycle have no root and are left out.
    """
    known = nodes.select(key, parent, "title", "text")
    level, out, depth = known.where(F.col(parent).isNull()).select(key, F.array("title").alias("path"), "text", F.lit(1).alias("depth")), None, 1
    while True:
        level = _kept(spark, level)
        if out is not None and level.isEmpty():
            return out
        out, depth = level if out is None else out.unionByName(level), depth + 1
        level = level.select(F.col(key).alias(parent), "path").join(known, parent).select(key, F.concat("path", F.array(F.col("title"))).alias("path"), "text", F.lit(depth).alias("depth"))


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = shared_path(spark, "tree")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def leaves(nodes: DataFrame, spark: SparkSession, key: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Leaf nodes with text and their path of titles; all nodes with text, where no leaf has any."""
    out = levels(nodes, spark, key, parent)
    inner = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias(key)).distinct()
    full = out.where(tx.u_trim(tx.blank(F.col("text"))) != "")
    ends = full.join(inner, key, "left_anti")
    return full if ends.isEmpty() else ends


def flatten_json(trees: DataFrame, doc: str = "doc_id", tree: str = "tree") -> DataFrame:
    """Node rows (doc, node_id, parent_id, title, text) of nested JSON trees in any of the usual spellings."""
    import json

    @F.pandas_udf("array<struct<node_id:string,parent_id:string,title:string,text:string>>")
    def nodes(c: pd.Series) -> pd.Series:
        def one(raw: str | None) -> list[dict]:
            try:
                root = json.loads(raw or "null")
            except ValueError:
                return []
            first = root if isinstance(root, list) else (root or {}).get("structure") or (root or {}).get("nodes") or [root]
            out, todo = [], [(n, None) for n in reversed(first)]
            while todo:
                n, parent = todo.pop()
                if not isinstance(n, dict):
                    continue
                me = f"{len(out):06d}"
                out.append({"node_id": me, "parent_id": parent, "title": str(n.get("title") or n.get("node_title") or n.get("heading") or "untitled"), "text": str(n.get("text") or n.get("full_text") or n.get("content") or n.get("summary") or "")})
                todo += [(k, me) for k in reversed(n.get("nodes") or n.get("children") or [])]
            return out

        return c.map(one)

    return trees.select(doc, F.explode(nodes(F.col(tree))).alias("n")).select(doc, "n.*")


def front_matter(path: Column) -> Column:
    return F.lower(F.trim(F.element_at(path, -1))).isin(*FRONT) | F.lower(F.trim(F.get(path, F.lit(0)))).isin(*FRONT)


def chunks(leaf: DataFrame, least: int = 15) -> DataFrame:
    return leaf.select("node_id", F.array_join("path", " > ").alias("heading"), "text").where(F.length(tx.u_trim(F.col("text"))) >= least)


def tree_records(leaf: DataFrame, words: Sequence[str], source: str) -> DataFrame:
    """Rule records of tree leaves without front matter: stable id, summary, whole text."""
    kept = leaf.where(~front_matter(F.col("path")))
    return kept.select(tx.hash_id("T", F.lit(source), F.col("node_id")).alias("rule_id"), F.element_at("path", -1).alias("title"), tx.fallback_summary(F.element_at("path", -1), F.col("path"), F.col("text"), words).alias("content"), F.col("text").alias("full_text"), F.lit("pageindex").alias("index_source"), F.lit(source).alias("source_file"))


def ingest(rules: DataFrame, leaf: DataFrame, words: Sequence[str], source: str, least: float = 0.7, sample: int = 10) -> DataFrame:
    """The rule table after a tree is taken in: its records replace those of the same source, older rules of that source or
    category retire. Where fewer than ``least`` of a sample of the records pass the gate, or there are none, nothing changes."""
    new = tree_records(leaf, words, source)
    passed = rl.gate(rl.sample_rows(new, sample)).agg(F.avg(F.col("passed").cast("int"))).first()[0]
    if passed is None or passed < least:
        return rules
    kept = rules.where((F.col("source_file") != source) | (F.col("index_source") != rl.TREE))
    old = rl.superseded(kept, leaf.sparkSession.createDataFrame([(source,)], "category string"))
    made = rl.renumber(new, "source_file", "rule_id").withColumns({"category": F.lit(source), "status": F.lit("active")})
    filled = [F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in rules.dtypes]
    return rl.union_kept(rl.retire(kept, old), made.select(*filled))


def tree_statistics(every: DataFrame) -> DataFrame:
    """Number of nodes of any kind and the largest depth, of what ``levels`` returns."""
    return every.agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))


def page_quality(pages: DataFrame, least: int = 20, chars: int = 1000, share: float = 0.2) -> DataFrame:
    """Of each document: pages, pages with text, characters, tokens, and whether its text layer will do."""
    n = F.length(tx.u_trim(F.col("text")))
    q = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(n >= least).alias("full"), F.sum(n).alias("chars"), F.sum("tokens").alias("tokens"))
    return q.withColumn("sufficient", (F.col("chars") >= chars) & (F.col("full") >= F.col("pages") * share))


def choose_text(original: DataFrame, other: DataFrame, force: bool = False) -> DataFrame:
    """The pages of the text source with more characters, by document; the original on a tie unless forced."""
    a = page_quality(original).select("doc_id", F.col("chars").alias("__a"))
    b = page_quality(other).select("doc_id", F.col("chars").alias("__b"))
    swap = a.join(b, "doc_id", "full_outer").where(F.lit(force) & F.col("__b").isNotNull() | (F.coalesce("__b", F.lit(-1)) > F.coalesce("__a", F.lit(-1)))).select("doc_id")
    return original.join(swap, "doc_id", "left_anti").unionByName(other.join(swap, "doc_id", "left_semi").select(*original.columns))


#: Marks of tables that are no text.
TABLE_MARKS = "|-\n \t"


def chunk_quality(chunks: DataFrame, pages: DataFrame, chars: int = 50, density: int = 20) -> DataFrame:
    """(doc_id, chunks, chars, sufficient) of parsed chunks (doc_id, text): characters without the marks of tables, at least
    ``chars`` of them and ``density`` for each page of ``pages`` (doc_id, pages; a document without counts as one page)."""
    n = F.length(F.translate(tx.blank(F.col("text")), TABLE_MARKS, ""))
    q = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars")).join(pages.select("doc_id", "pages"), "doc_id", "left")
    return q.select("doc_id", "chunks", "chars", ((F.col("chars") >= chars) & (F.col("chars") >= density * F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)))).alias("sufficient"))


def choose_chunks(original: DataFrame, other: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunks of the original where they are sufficient; else those of the source that has more, the original on a tie."""
    a = chunk_quality(original, pages).select("doc_id", F.col("chunks").alias("__a"), "sufficient")
    b = other.groupBy("doc_id").agg(F.count("*").alias("__b"))
    swap = b.join(a, "doc_id", "left").where(~F.coalesce("sufficient", F.lit(False)) & (F.col("__b") > F.coalesce("__a", F.lit(0)))).select("doc_id")
    return original.join(swap, "doc_id", "left_anti").unionByName(other.join(swap, "doc_id", "left_semi").select(*original.columns))


def densify(sparse: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages 1 to the larger of ``counts(doc_id, n)`` and the last page there is; gaps are blank, the last duplicate wins."""
    last = sparse.groupBy("doc_id").agg(F.max("page_no").alias("m"))
    every = counts.join(last, "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n").cast("int"), F.coalesce("m", F.lit(0))))).alias("page_no"))
    one = sparse.groupBy("doc_id", "page_no").agg(F.max_by("text", "order_no").alias("text"))
    return every.join(one, ["doc_id", "page_no"], "left").withColumn("text", tx.blank(F.col("text")))


def contents_pages(pages: DataFrame, marker: str = MARKER, stop: str = r"^(1|第1章|第一章)总则|^(?i:1General)", within: int = 20, span: int = 12) -> DataFrame:
    """(doc_id, page_no): from the first page with the marker up to where the main text starts, ``span`` pages at most."""
    start = pages.where((F.col("page_no") <= within) & F.col("text").rlike(marker)).groupBy("doc_id").agg(F.min("page_no").alias("a"))
    head = F.regexp_replace(tx.compact(F.left("text", F.lit(300))), r"^[^\dA-Za-z一-鿿]+", "")
    rows = pages.join(start, "doc_id").where((F.col("page_no") >= F.col("a")) & (F.col("page_no") < F.col("a") + span))
    ends = rows.where((F.col("page_no") > F.col("a")) & head.rlike(stop)).groupBy("doc_id").agg(F.min("page_no").alias("b"))
    return rows.join(ends, "doc_id", "left").where(F.col("b").isNull() | (F.col("page_no") < F.col("b"))).select("doc_id", "page_no")


def _page(body: Column) -> tuple[Column, Column]:
    digits = F.regexp_replace(F.regexp_extract(body, TRAILING_PAGE, 1), r"\s+", "")
    return F.trim(F.regexp_replace(body, TRAILING_PAGE, "")), F.when(digits != "", digits.cast("int"))


def before_english(lines: DataFrame, doc: str, no: str, line: str) -> DataFrame:
    """The lines before a second, English contents: it starts with a line of its own, or inside one."""
    order = Window.partitionBy(doc).orderBy(no)
    own, inside = (F.row_number().over(order) > 1) & F.col(line).rlike(ENGLISH), F.col(line).rlike(ENGLISH_INLINE)
    rows = lines.withColumn("__own", own).withColumn("__at", F.when(F.col("__own") | inside, F.col(no)))
    rows = rows.withColumn("__cut", F.min("__at").over(Window.partitionBy(doc)))
    kept = rows.where(F.col("__cut").isNull() | (F.col(no) < F.col("__cut")) | ((F.col(no) == F.col("__cut")) & ~F.col("__own")))
    return kept.withColumn(line, F.get(F.split(line, ENGLISH_INLINE), F.lit(0))).select(*lines.columns)


def _first_of_each(entries: DataFrame, doc: str, no: str) -> DataFrame:
    order = Window.partitionBy(doc, "structure", "title").orderBy(no)
    return entries.where(F.length("title") >= 2).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def parse_lines(lines: DataFrame, doc: str = "doc_id", no: str = "line_no", line: str = "line") -> DataFrame:
    """Contents entries, one a line: (doc, no, structure, title, page); the first of repeated ones stays."""
    rows = before_english(lines, doc, no, line).select(doc, no, tx.u_trim(F.col(line)).alias("t")).where(F.length("t") >= 3)

    def entries(pattern: str, title, keep: bool = True) -> DataFrame:
        rest, page = _page(tx.without_leaders(F.regexp_extract("t", pattern, 2)))
        first = F.regexp_extract("t", pattern, 1)
        structure = F.regexp_replace(first, r"\s+", "") if keep else F.lit(None).cast("string")
        return rows.where(F.col("t").rlike(pattern)).select(doc, no, "t", structure.alias("structure"), title(first, rest).alias("title"), page.alias("page"))

    one = entries(NUMBERED, lambda first, rest: tx.without_leaders(rest))
    two = entries(APPENDIX, lambda first, rest: F.trim(F.concat(F.regexp_replace(first, r"\s+", ""), F.lit(" "), tx.without_leaders(rest))))
    three = entries(SPECIAL, lambda first, rest: F.trim(F.concat(tx.without_leaders(first), F.lit(" "), rest)), False).where(~F.col("t").rlike(NUMBERED) & ~F.col("t").rlike(APPENDIX))
    return _first_of_each(one.unionByName(two).unionByName(three).drop("t"), doc, no)


def parse_inline(contents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Contents entries of texts that hold many in one line: markers and the bodies between them, zipped by position. A page
    number that runs into the next marker is cut off it; markers are numbers, appendices, letters or closing titles."""
    flat = F.get(F.split(tx.blank(F.col(text)), r"(?i)\n\s*\d*\s*Contents\b|InContents|\sContents\s"), F.lit(0))
    flat = F.regexp_replace(F.regexp_replace(flat, "#+", " "), r"(?U)\s+", " ")
    flat = F.regexp_replace(F.trim(F.regexp_replace(flat, GLUED_PAGE, "$1$2 ")), rf"^.*?{MARKER}", "")
    marks = F.regexp_extract_all(flat, F.lit(INLINE_MARK), 0)
    bodies = F.slice(F.split(flat, INLINE_MARK), 2, 1 << 30)
    rows = contents.select(doc, F.posexplode(F.arrays_zip(marks.alias("m"), bodies.alias("b"))).alias("no", "z"))
    body = tx.without_leaders(F.col("z.b"))
    rest, page = _page(body)
    mark, name = F.replace(F.regexp_replace("z.m", r"(?U)\s+", ""), F.lit("．"), F.lit(".")), tx.without_leaders(rest)
    closing = mark.rlike(f"^(?:{CLOSING})$")
    titled = F.when(closing, F.trim(F.concat(F.regexp_replace(mark, "附[:：]", "附 "), F.lit(" "), name))).when(F.startswith(mark, F.lit("附录")), F.trim(F.concat(mark, F.lit(" "), name))).otherwise(name)
    return _first_of_each(rows.where(body != "").select(doc, "no", F.when(~closing, mark).alias("structure"), titled.alias("title"), page.alias("page")), doc, "no")


#: The shapes of wrapped contents lines.
W_SKIP = re.compile(r"目|次|目次|[\s·•…⋯.。:：,，、\-—一]+")
W_PAGE = re.compile(r"\d{1,3}")
W_HEADER = re.compile(r"\d+(?:\s*\.\s*\d+)*\s+[一-鿿]")
W_STOP = ("附录", "本标准用词说明", "引用标准名录")
W_SUB, W_SUB_TITLED = re.compile(r"[.．]\s*\d+\s*"), re.compile(r"[.．]\s*\d+\s+[一-鿿]")
W_NUMBERED = re.compile(r"(\d+(?:\s*\.\s*\d+)*)\s+((?!附录)[一-鿿].+)")
W_APPENDIX, W_APPENDIX_ALONE = re.compile(r"(?:\d+\s*)?(附录\s*[A-Za-zＡ-Ｚａ-ｚ])\s*(.+)"), re.compile(r"附录\s*[A-Za-zＡ-Ｚａ-ｚ]")
W_SPECIAL = re.compile(r"本标准用词说明|引用标准名录|附\s*[:：].+")


def _bare(t: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[·•…⋯.。:：]+", " ", t)).strip(" ,，、一-—")


def _wrapped_head(texts: Sequence[str], i: int) -> tuple[tuple[str | None, str] | None, int]:
    """The entry that starts at a line, if any, and the first line after its title."""
    t, *more = texts[i : i + 3]
    after = i + 1
    if W_PAGE.fullmatch(t) and more:
        if W_SUB_TITLED.match(more[0]):
            t, after = t + more[0], i + 2
        elif W_SUB.fullmatch(more[0]) and len(more) > 1 and "一" <= more[1][0] <= "鿿":
            t, after = f"{t}{more[0]} {more[1]}", i + 3
        else:
            return None, after
    elif W_APPENDIX_ALONE.fullmatch(t) and more:
        t, after = f"{t} {more[0]}", i + 2
    entry = None
    if m := W_NUMBERED.fullmatch(t):
        entry = re.sub(r"\s+", "", m[1]), _bare(m[2])
    elif m := W_APPENDIX.fullmatch(t):
        name = re.sub(r"\s+", "", m[1])
        entry = name, f"{name} {_bare(m[2])}".strip()
    elif W_SPECIAL.fullmatch(t):
        entry = None, _bare(t)
    return (entry if entry and len(entry[1]) >= 2 else None), after


def parse_wrapped(lines: DataFrame, doc: str = "doc_id", no: str = "line_no", line: str = "line", ahead: int = 5) -> DataFrame:
    """Contents entries whose number, title, leaders and page may stand on lines of their own. The cursor moves over what it
    has used, so this runs by document, over its few contents pages."""

    def parse(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, t.strip()) for n, t in part.sort_values(no)[[no, line]].itertuples(index=False) if t and t.strip()]
        rows = [(n, t) for n, t in rows if not W_SKIP.fullmatch(t)]
        texts, out, i = [t for _, t in rows], {}, 0
        while i < len(texts):
            at, (entry, i) = i, _wrapped_head(texts, i)
            if entry is None:
                continue
            page = None
            for j, t in enumerate(texts[i : i + ahead], i):
                if W_PAGE.fullmatch(t):
                    page, i = int(t), j + 1
                    break
                if W_HEADER.match(t) or t.startswith(W_STOP):
                    break
            out.setdefault(entry, (part[doc].iloc[0], rows[at][0], *entry, page))
        return pd.DataFrame(list(out.values()), columns=[doc, no, "structure", "title", "page"]).astype({"page": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    kept = before_english(lines, doc, no, line)
    return kept.groupBy(doc).applyInPandas(parse, f"{doc} {kinds[doc]}, {no} {kinds[no]}, structure string, title string, page int")


def best_mode(modes: Sequence[DataFrame], doc: str = "doc_id") -> DataFrame:
    """The parse with most entries that have a page, then most entries, then the first mode, of each document."""
    rows = modes[0].withColumn("mode_no", F.lit(0))
    for i, m in enumerate(modes[1:], 1):
        rows = rows.unionByName(m.withColumn("mode_no", F.lit(i)), allowMissingColumns=True)
    score = rows.groupBy(doc, "mode_no").agg(F.count("page").alias("p"), F.count("*").alias("n"))
    best = score.groupBy(doc).agg(F.max_by("mode_no", F.struct("p", "n", -F.col("mode_no"))).alias("mode_no"))
    return rows.join(best, [doc, "mode_no"], "left_semi")


def accepted(entries: DataFrame, doc: str = "doc_id", least: int = 10, share: float = 0.75) -> DataFrame:
    return entries.groupBy(doc).agg(F.count("*").alias("n"), F.count("page").alias("with_page")).where((F.col("n") >= least) & (F.col("with_page") >= share * F.col("n")))


def _keys(items: DataFrame) -> DataFrame:
    title, whole = tx.title_key(F.col("title")), F.concat(tx.title_key(F.col("structure")), tx.title_key(F.col("title")))
    return items.withColumn("__k", title).withColumn("__w", whole)


#: Letters of a title that are looked up in the pages; titles of a document, and letters of pages, in one group.
ANCHOR, TITLES, LETTERS = 12, 20_000, 1 << 22


def _found(names: list[tuple[str, int, bytes | None]], pages: list[tuple[int, str]]) -> dict[tuple[str, int, bytes | None], int]:
    """The first of the pages, in order, that holds each name: its head, its length and, where it is longer, its digest."""
    wanted, found = {}, {}
    for k in dict.fromkeys(names):
        wanted.setdefault(k[0], {}).setdefault(k[1], {})[k[2]] = k
    machine = sc.automaton(heads := list(wanted))
    for no, text in pages:
        for end, i in machine.iter(text) if text and heads else ():
            start, sizes = end + 1 - len(heads[i]), wanted[heads[i]]
            for n in list(sizes):
                piece = text[start : start + n]
                mark = hashlib.md5(piece.encode(), usedforsecurity=False).digest() if n > len(heads[i]) else None
                if len(piece) == n and (k := sizes[n].pop(mark, None)):
                    found[k] = no
                    if not sizes[n]:
                        del sizes[n]
    return found


def _first_pages(titles: pa.Table, pages: pa.Table) -> pa.Table:
    """Of titles and pages of a group of documents: the first page of its document that holds each title."""
    titles, by_doc, at, first = titles.sort_by("doc_id"), {}, [], []
    for doc, no, text in sorted(zip(*(pages[c].to_pylist() for c in ("doc_id", "page_no", "p")), strict=True)):
        by_doc.setdefault(doc, []).append((no, text))
    rows = enumerate(zip(*(titles[c].to_pylist() for c in ("doc_id", "head", "n", "digest")), strict=True))
    for doc, group in itertools.groupby(rows, lambda r: r[1][0]):
        if doc in by_doc:
            places, names = zip(*((i, k) for i, (_, *k) in group), strict=True)
            names = [tuple(k) for k in names]
            found = _found(names, by_doc[doc])
            hit = [(i, found[k]) for i, k in zip(places, names, strict=True) if k in found]
            at += [i for i, _ in hit]
            first += [no for _, no in hit]
    rows = titles.take(pa.array(at, pa.int64()))
    return pa.table([rows["doc_id"], rows["item_no"], pa.array(first, pages["page_no"].type)], ["doc_id", "item_no", "found_page"])


def align(items: DataFrame, pages: DataFrame, size: int = ANCHOR) -> DataFrame:
    """(doc_id, item_no, found_page): the first page of the document that holds the entry's title.

    Titles and pages meet once, by groups of documents that hold about ``LETTERS`` letters of pages. A document of more
    letters or of more than ``TITLES`` titles has several groups of each, and each of its groups of titles meets each of its
    groups of pages. There, one dictionary scan of a document's pages finds the heads of its titles, ``size`` letters at most,
    and where a head stands the text of the title's length is compared by its MD5 digest: titles travel as head, length and
    digest. Page texts are written once, in the form that is compared. A title with its number before it holds the title alone, so that is enough.
    """
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "pages")
    text = pages.where("doc_id is not null and page_no is not null").select("doc_id", "page_no", tx.title_key(F.col("text")).alias("p"))
    text.write.option("compression", "zstd").parquet(path)
    text = spark.read.schema(text.schema).parquet(path)
    keys = _keys(items).where("__k <> '' and doc_id is not null")
    whole = F.length("__k") > size
    keys = keys.select("doc_id", "item_no", F.left("__k", F.lit(size)).alias("head"), F.length("__k").alias("n"), F.when(whole, F.unhex(F.md5("__k"))).alias("digest"))
    letters = _kept(spark, text.groupBy("doc_id").agg(F.sum(F.length("p")).alias("l")))
    n = -(-(letters.agg(F.sum("l")).first()[0] or 1) // LETTERS)
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int").alias(c)
    wide, long = letters.where(F.col("l") > LETTERS).select("doc_id", parts("l", LETTERS)), keys.groupBy("doc_id").agg(F.count("*").alias("t")).where(F.col("t") > TITLES).select("doc_id", parts("t", TITLES))
    large = _kept(spark, wide.join(long, "doc_id", "full_outer"))  # few documents are so large
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    group, by = F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("g"), ["g", "a", "b"]
    left = keys.join(large, "doc_id", "left").select("doc_id", "item_no", "head", "n", "digest", group, F.pmod(F.xxhash64("head", "digest"), one("t")).cast("int").alias("a"), every("l").alias("b"))
    right = text.join(large, "doc_id", "left").select("doc_id", "page_no", "p", group, every("t").alias("a"), F.pmod(F.xxhash64("page_no"), one("l")).cast("int").alias("b"))
    kinds = dict(items.dtypes) | {"page_no": dict(pages.dtypes)["page_no"]}
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_first_pages, f"doc_id {kinds['doc_id']}, item_no {kinds['item_no']}, found_page {kinds['page_no']}")
    return met.groupBy("doc_id", "item_no").agg(F.min("found_page").alias("found_page"))


def fill(items: DataFrame, low: int = 1, high: Column | int | None = None) -> DataFrame:
    """Missing pages from the nearest known ones: between two, one more for each step after the earlier, up to the later."""
    order = Window.partitionBy("doc_id").orderBy("item_no")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = items.withColumn("__i", F.row_number().over(order))
    known = F.when(F.col("physical_index").isNotNull(), F.struct(F.col("physical_index").alias("v"), F.col("__i").alias("i")))
    rows = rows.withColumn("__b", F.last(known, ignorenulls=True).over(back)).withColumn("__a", F.first("physical_index", ignorenulls=True).over(ahead))
    step = F.col("__b.v") + F.col("__i") - F.col("__b.i")
    guess = F.when(F.col("__b").isNotNull() & F.col("__a").isNotNull(), F.least(F.col("__a"), step)).otherwise(F.coalesce(F.col("__b.v"), F.col("__a")))
    guess = F.greatest(F.lit(low), guess if high is None else F.least(F.lit(high) if isinstance(high, int) else high, guess))
    return rows.withColumn("filled", F.coalesce("physical_index", F.when(guess.isNotNull() & (F.col("__b").isNotNull() | F.col("__a").isNotNull()), guess))).select(*items.columns, "filled")


def verify(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with ``ok``: whether their page holds their title."""
    p = pages.select("doc_id", F.col("page_no").alias("physical_index"), tx.title_key(F.col("text")).alias("__p"))
    rows = _keys(items).join(p, ["doc_id", "physical_index"], "left")
    ok = F.coalesce((F.col("__k") != "") & (F.contains("__p", F.col("__k")) | F.contains("__p", F.col("__w"))), F.lit(False))
    return rows.withColumn("ok", ok).select(*items.columns, "ok")


def accuracy(verified: DataFrame) -> DataFrame:
    """(doc_id, n, accuracy, failing): of each document what ``verify`` found: entries, the share that stands on its page, and
    the numbers of those that do not, in order."""
    wrong = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("item_no"))))
    return verified.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("accuracy"), wrong.alias("failing"))


def appears_at_start(items: DataFrame, pages: DataFrame) -> DataFrame:
    p = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.left(tx.title_key(F.left("text", F.lit(300))), F.lit(80)).alias("__p"))
    rows = _keys(items).join(p, ["doc_id", "physical_index"], "left")
    ok = F.coalesce((F.col("__k") != "") & (F.contains("__p", F.col("__k")) | F.contains("__p", F.col("__w"))), F.lit(False))
    return rows.withColumn("appear_start", F.when(ok, "yes").otherwise("no")).select(*items.columns, "appear_start")
