"""Hybrid retrieval for batches of queries: BM25, exact vector search, rank fusion, expansion, reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import index as ix
from . import rules as rl
from . import scan as sc
from . import vectors as vc

#: Fixed value: the constant of rank fusion.
RANK_CONSTANT = 60
#: Components of a vector.
DIMS = 64


#: What tells which queries a rule may answer.
FACET = ("index_source", "lifecycle_phase", "wbs_code")


def facet() -> Column:
    """The life cycle and the code of a rule in one; null where no query may find it."""
    return F.when(F.col("index_source") != rl.EXPERIENCE, F.to_json(F.array("lifecycle_phase", "wbs_code")))


def active_texts(rules: DataFrame) -> DataFrame:
    """(rule_id, text) of active rules with text, and the columns that ``facet`` reads, where the rules have them."""
    live = rules.where((F.col("status") == "active") & F.col("content").rlike(r"(?U)\S"))
    return live.select("rule_id", rl.display_text().alias("text"), *[c for c in FACET if c in rules.columns])


def bm25(queries: DataFrame, texts: DataFrame, query: str = "query", key: str = "rule_id", floor: float | None = ix.FLOOR) -> DataFrame:
    """(query_id, key, score) of every scored pair above ``floor``: the whole scoring, where all scores are wanted. The best
    rows alone are found by ``index.search``."""
    index = ix.build(texts, key)
    asked = queries.select("query_id", F.explode(tx.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    rows = asked.join(index.idf, "term").join(ix.flat(index), "term").crossJoin(F.broadcast(index.stats))
    scored = rows.groupBy("query_id", key).agg(F.sum(F.col("qf") * F.col("idf") * ix.share()).alias("score"))
    return scored if floor is None else scored.where(F.col("score") > floor)


def top(scored: DataFrame, k: int, by: Sequence[Column], group: str = "query_id", name: str = "rank") -> DataFrame:
    """The best ``k`` of each group; Spark cuts every partition to ``k`` before the shuffle."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col(name) <= k)


def nearest_rules(queries: DataFrame, vectors: DataFrame, rules: DataFrame, k: int, generic: str = "GEN") -> DataFrame:
    """Dense recall with its filter before the cut: (query_id, rule_id, rank) of active rules of the query's life cycle.
    ``queries``: query_id, q, lifecycle; ``vectors``: vec_id, which is the rule's id, and embedding."""
    meta = rules.where((F.col("status") == "active") & (F.col("index_source") != rl.EXPERIENCE)).select(F.col("rule_id").alias("vec_id"), "lifecycle_phase")
    asked = queries.select("query_id", "q", F.array(F.lit(generic), tx.blank(F.col("lifecycle"))).alias("facets"))
    found, _ = vc.nearest(asked, vectors.join(meta.where("lifecycle_phase is not null"), "vec_id"), k, DIMS, "lifecycle_phase")
    return found.select("query_id", F.col("vec_id").alias("rule_id"), "rank")


def ranked(lists: DataFrame) -> DataFrame:
    """(query_id, engine, rank) from scores, ties to the smaller id."""
    w = Window.partitionBy("query_id", "engine").orderBy(F.desc("score"), F.asc("rule_id"))
    return lists.withColumn("rank", F.row_number().over(w))


def fuse(lists: DataFrame, constant: int = RANK_CONSTANT, content: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: (query_id, rule_id, score, engines). With ``content``, rows without an id are
    one where their content is, and that column is returned too."""
    gain = [F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"), F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("engines")]
    if content is None:
        return lists.groupBy("query_id", "rule_id").agg(*gain)
    named = tx.blank(F.col("rule_id").cast("string")) != ""
    keyed = lists.withColumn("__id", F.when(named, F.col("rule_id"))).withColumn("__text", F.when(~named, tx.blank(F.col(content))))
    return keyed.groupBy("query_id", "__id", "__text").agg(*gain, F.min(content).alias(content)).select("query_id", F.col("__id").alias("rule_id"), content, "score", "engines")


def date_key(c: Column) -> Column:
    """Later dates sort first; what is no date sorts after all dates."""
    return F.coalesce(-F.left(F.replace(c, F.lit("-"), F.lit("")), F.lit(8)).try_cast("int"), F.lit(0))


def resolution_order(score: Column | str = "score") -> list[Column]:
    """Score down, level up, date down, then the id."""
    return [F.round(F.col(score) if isinstance(score, str) else score, 12).desc(), F.asc("level"), date_key(F.col("publish_date")).asc(), F.asc("rule_id")]


def expand(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Context of hits (with rule_id): tree nodes get their source and whole clause, others their neighbours."""
    meta = rules.select("rule_id", "source_file", "index_source", rl.display_text().alias("core"), F.col("content").alias("whole"))
    near = rl.neighbours(rules)
    rows = hits.join(meta, "rule_id").join(near, "rule_id", "left")
    node = F.concat(F.lit("[node]\n[source] "), tx.or_default(F.trim("source_file"), "unknown"), F.lit("\n"), F.col("core"), F.when(tx.u_trim(tx.blank(F.col("whole"))) != "", F.concat(F.lit("\n[clause] "), F.col("whole"))).otherwise(""))
    before, after = tx.blank(F.col("prev_text")), tx.blank(F.col("next_text"))
    wide = F.concat(F.when(before != "", F.concat(F.lit("[before] "), before, F.lit("\n"))).otherwise(""), F.lit("[hit] "), F.col("core"), F.when(after != "", F.concat(F.lit("\n[after] "), after)).otherwise(""))
    context = F.when(F.col("index_source") == rl.TREE, node).when((before != "") | (after != ""), wide).otherwise(F.col("core"))
    return rows.select(*hits.columns, context.alias("context"))


def rerank(candidates: DataFrame, queries: DataFrame, text: str = "context", stop: Sequence[str] = (), tokenizer: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """Candidates with at least one query word as a substring, most words first, then by rank; all, where none has one."""
    words = F.filter(F.array_except(F.array_distinct(tokenizer(F.col("query"))), tx.strings(stop)), lambda t: F.length(t) >= 2)
    rows = candidates.join(queries.select("query_id", words.alias("__w")), "query_id")
    rows = rows.withColumn("overlap", F.size(F.filter("__w", lambda t: F.contains(F.lower(text), t)))).drop("__w")
    rows = rows.withColumn("__best", F.max("overlap").over(Window.partitionBy("query_id"))).where((F.col("overlap") > 0) | (F.col("__best") == 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.asc("rank"))
    return rows.withColumn("position", F.row_number().over(order)).drop("__best")


def tag_fallback(queries: DataFrame, found: DataFrame, tagged: DataFrame, k: int = 2, generic: str = "GEN") -> DataFrame:
    """For queries that found nothing: rules one of whose tags stands in the query, of the query's own code."""
    lost = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    tags = tagged.select("rule_id", "level", F.col("wbs_code").alias("__code"), F.explode("tags").alias("tag"))
    word = sc.hits(lost, "query_id", "query", tags, "tag")
    codes = lost.select("query_id", "wbs_code")
    hit = word.join(tags, "tag").join(codes, "query_id").where(tx.blank(F.col("wbs_code")).isin("", generic) | (F.col("wbs_code") == F.col("__code")))
    return top(hit.select("query_id", "rule_id", "level").distinct(), k, [F.asc("level"), F.asc("rule_id")])


def retrieve(queries: DataFrame, rules: DataFrame, n: int = 2, dense: DataFrame | None = None, fused: int = 10, generic: str = "GEN", stop: Sequence[str] = (), index: ix.Index | None = None) -> DataFrame:
    """(query_id, position, rule_id, context): the whole retrieval for a batch of queries.

    ``dense(query_id, rule_id, rank)``: a ranked list of a vector engine, already filtered; ``index``: the index of the
    active texts with their ``facet``, built here where none is given. Ranked lists are written once; texts join only after the cuts.
    """
    live = queries.where(tx.u_trim(F.col("query")) != "")
    fits = rules.where((F.col("status") == "active") & (F.col("index_source") != rl.EXPERIENCE)).select("rule_id", "lifecycle_phase", "wbs_code", "level", "publish_date")
    chain = live.select("query_id", "lifecycle", F.when(tx.blank(F.col("wbs_code")).isin("", generic), F.lit(None)).otherwise(tx.ancestry(F.col("wbs_code"), generic)).alias("chain"))

    kinds = fits.select("lifecycle_phase", "wbs_code").distinct()
    fit = (F.col("lifecycle_phase").isin(generic) | (F.col("lifecycle_phase") == F.col("lifecycle"))) & (F.col("chain").isNull() | F.array_contains("chain", F.col("wbs_code")))
    allowed = kinds.withColumn("index_source", F.lit("")).join(chain, fit).select("query_id", facet().alias("facet"))
    lexical, _ = ix.search(index or ix.build(active_texts(rules).withColumn("facet", facet()), facet="facet"), live, 3 * n, allowed=allowed)
    lists = lexical.select("query_id", "rule_id", "rank", F.lit("lexical").alias("engine"))
    if dense is not None:
        lists = lists.unionByName(dense.select("query_id", "rule_id", "rank", F.lit("dense").alias("engine")))
    merged = fuse(lists).join(fits.select("rule_id", "level", "publish_date"), "rule_id")
    cut = ix.kept(top(merged, fused, resolution_order()).select("query_id", "rule_id", "rank"), "cut")
    best = rerank(expand(cut, rules), live, stop=stop)
    return best.where(F.col("position") <= n).select("query_id", "position", "rule_id", "overlap", "context")


def answers(queries: DataFrame, found: DataFrame, empty: str = "empty query", none: str = "nothing found") -> DataFrame:
    """One text a query: its contexts in order, or the message for an empty query or no hit."""
    text = found.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "context"))), lambda s: s["context"]), "\n").alias("answer"))
    return queries.join(text, "query_id", "left").select("query_id", F.when(tx.u_trim(F.col("query")) == "", empty).otherwise(F.coalesce("answer", F.lit(none))).alias("answer"))
