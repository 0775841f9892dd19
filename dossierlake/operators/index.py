"""A BM25 index in blocks, and the exact best rows of a batch of queries in one pass over the blocks where they lie.

Rows lie in blocks of ``BLOCK_ROWS`` as they were written; a block is one row of the index and holds its terms with their
postings. A task reads its blocks once for a broadcast batch of queries. The largest share that a term gives to a row of the
block bounds the score of all its rows, so of the blocks in hand those with the highest bounds are scored first, and of the
rest only those whose bound reaches the k-th score that the task has found; a block's rows meet its queries in one
matrix product. Each task returns k rows a query at most, so neither postings nor scores are shuffled. The result equals that
of scoring every posting. A larger batch of queries takes more passes.

Terms of a row are counted inside the row, so blocks are written without a shuffle. Rows without terms count in the
statistics and are never found; a query without known terms finds nothing; repeated keys in the index are rows of their
own whose scores add up: where there are any, every score is computed and summed, so a key should stand once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..sources.shared import shared_path
from . import scan as sc

#: BM25 constants and the score floor.
K1, B, EPSILON, FLOOR = 1.5, 0.75, 0.25, 0.5
#: Rows in a block, and blocks of a query that are scored before it has a limit.
BLOCK_ROWS, SEEDS = 64, 4
#: Blocks in a row group: Spark's reader unpacks a row group of wide rows at once. Rows of which a task counts the words at once.
GROUP_BLOCKS, COUNT_ROWS = 32, 1024
#: Queries of a pass and their terms, about; scores held before they are cut to the best; weights of blocks held at once.
QUERY_ROWS, QUERY_TERMS, HELD, CELLS = 512, 20_000, 50_000, 4_000_000


class Index(NamedTuple):
    key: str
    blocks: DataFrame  # keys, facets, dls (one a row); terms, many (rows of each); places, tfs (postings by term)
    idf: DataFrame  # term, df, idf
    stats: DataFrame  # n, avgdl: one row


def kept(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """``df`` written in the shared folder and read again; ``group``: rows in a row group, for rows that are wide."""
    path = shared_path(df.sparkSession, name)
    (df.write if group is None else df.write.option("parquet.block.row.count.limit", group)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows at most."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _counted(t: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a column of words: row, place in ``names`` and count of every distinct word of a row; the names; words of each row."""
    sizes = pc.list_value_length(t).fill_null(0).to_numpy().astype(np.int64)
    coded = t.flatten().dictionary_encode()
    names = coded.dictionary
    one, n = np.unique(np.repeat(np.arange(len(t)), sizes) * max(1, len(names)) + coded.indices.to_numpy(), return_counts=True)
    return one // max(1, len(names)), one % max(1, len(names)), n, names, sizes.astype(np.int32)


def counted(rows: DataFrame, key: str, words: str, outer: bool = False) -> DataFrame:
    """(term, key, dl, tf) of the distinct words of each row; with ``outer``, a row without words has one without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, COUNT_ROWS):
            at, code, tf, names, sizes = _counted(b[words])
            cols = [names.take(pa.array(code)), b[key].take(pa.array(at)), pa.array(sizes[at]), pa.array(tf)]
            yield pa.RecordBatch.from_arrays(cols, ["term", key, "dl", "tf"])
            if outer and not sizes.all():
                bare = np.flatnonzero(sizes == 0)
                none = [pa.nulls(len(bare), pa.string()), b[key].take(pa.array(bare)), pa.array(sizes[bare]), pa.nulls(len(bare), pa.int64())]
                yield pa.RecordBatch.from_arrays(none, ["term", key, "dl", "tf"])

    return rows.select(key, words).mapInArrow(run, f"term string, `{key}` {dict(rows.dtypes)[key]}, dl int, tf long")


def postings(texts: DataFrame, key: str = "rule_id", words: Column | None = None) -> DataFrame:
    """(term, key, tf, dl) of the words of each row: its tokens in ``words``, or those of ``text``. Nothing is shuffled."""
    rows = texts.select(key, (tx.tokens(F.col("text")) if words is None else words).alias("__t"))
    return counted(rows, key, "__t").select("term", key, "dl", "tf")


def inverse(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) from document frequencies; what would be negative is a quarter of the mean."""
    raw = df.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((EPSILON * F.avg("raw")).alias("eps"))  # one row
    return raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf"))


def share(avgdl: str = "avgdl") -> Column:
    """What a posting gives to a score, before the weight of its term."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col(avgdl)))


BLOCK = ["keys", "facets", "dls", "terms", "many", "places", "tfs"]


def block_schema(kind: str) -> str:
    return f"keys array<{kind}>, facets array<string>, dls array<int>, terms array<string>, many array<int>, places array<int>, tfs array<int>"


def packed(keys: pa.Array, facets: pa.Array, dls: np.ndarray, at: np.ndarray, code: np.ndarray, tf: np.ndarray, names: pa.Array, rows: int = BLOCK_ROWS) -> pa.RecordBatch:
    """Rows and their postings (row, place in ``names``, count) as blocks of ``rows`` rows."""
    n = -(-len(dls) // rows)
    order = np.lexsort((at, code, at // rows))
    at, code, tf = at[order], code[order], tf[order]
    block = at // rows
    heads = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])) if len(at) else np.zeros(0, np.int64)
    edges = np.minimum(np.arange(n + 1) * rows, len(dls))
    lists = lambda where, x: pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), x)
    by_term, by_row = np.searchsorted(block[heads], np.arange(n + 1)), np.searchsorted(block, np.arange(n + 1))
    many = np.diff(np.concatenate([heads, [len(at)]])).astype(np.int32)
    cols = [lists(edges, keys), lists(edges, facets), lists(edges, pa.array(dls)), lists(by_term, names.take(pa.array(code[heads]))), lists(by_term, pa.array(many)), lists(by_row, pa.array((at % rows).astype(np.int32))), lists(by_row, pa.array(tf.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(cols, BLOCK)


def build(texts: DataFrame, key: str = "rule_id", words: Column | None = None, facet: str | None = None) -> Index:
    """The index of ``texts`` (key and text, or key and tokens in ``words``): written once. ``facet``: a column that says which
    queries a row is for (see ``search``)."""
    one = F.lit(None) if facet is None else F.col(facet)
    rows = texts.select(key, one.cast("string").alias("__f"), (tx.tokens(F.col("text")) if words is None else words).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, COUNT_ROWS):
            at, code, tf, names, sizes = _counted(b["__t"])
            if len(sizes):
                yield packed(b[key], b["__f"], sizes, at, code, tf, names)

    blocks = kept(rows.mapInArrow(run, block_schema(dict(texts.dtypes)[key])), "blocks", GROUP_BLOCKS)
    stats = kept(blocks.select(F.explode("dls").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats")
    found = blocks.select(F.explode(F.arrays_zip("terms", "many")).alias("x")).groupBy("x.terms").agg(F.sum("x.many").alias("df"))
    return Index(key, blocks, kept(inverse(kept(found.select(F.col("terms").alias("term"), "df"), "counts"), stats), "idf"), stats)


def flat(index: Index) -> DataFrame:
    """(term, key, dl, tf): the postings of an index, one a row."""
    key, kind = index.key, index.blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, _, dls, terms, many, places, tfs = (c[i].values for c in b.columns)
                at = pa.array(np.repeat(np.arange(len(terms)), many.to_numpy()))
                yield pa.RecordBatch.from_arrays([terms.take(at), keys.take(places), dls.take(places), tfs.cast(pa.int64())], ["term", key, "dl", "tf"])

    return index.blocks.select(*BLOCK).mapInArrow(run, f"term string, `{key}` {kind}, dl int, tf long")


class _Asked:
    """A batch of queries: weights of terms by query, and which facets each may meet."""

    def __init__(self, table: pa.Table, facets: bool) -> None:
        self.ids = table["query_id"].combine_chunks()
        terms, weights = table["terms"].combine_chunks(), table["weights"].combine_chunks()
        owner = np.repeat(np.arange(len(self.ids)), terms.value_lengths().to_numpy())
        coded = terms.flatten().dictionary_encode()
        self.terms, code = coded.dictionary, coded.indices.to_numpy()
        self.weight = np.zeros((len(self.terms), len(self.ids)))
        self.weight[code, owner] = weights.flatten().to_numpy()
        self.has = np.zeros(self.weight.shape, np.float32)
        self.has[code, owner] = 1
        self.facets = None
        if facets:
            mine = table["facets"].combine_chunks()
            coded = mine.flatten().dictionary_encode()
            self.facets = coded.dictionary
            self.fits = np.zeros((len(self.facets) + 1, len(self.ids)), bool)  # the last: rows of no facet that is asked for
            self.fits[coded.indices.to_numpy(), np.repeat(np.arange(len(self.ids)), mine.value_lengths().fill_null(0).to_numpy())] = True


def _best(key: str, kind: pa.DataType, k: int | None, avgdl: float, floor: float | None, shared: Broadcast, facets: bool):
    """Of a task's blocks: the best ``k`` rows of each query, or every scored one; then how many blocks could have scored and
    how many were read (rows without a score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(shared.value, facets)
        n = len(asked.ids)
        low, lowest = -np.inf if floor is None else floor, np.full(n, -np.inf)
        blocks, read, held = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        names = ["query_id", key, "score", "place", "blocks", "read"]

        def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            none = pa.nulls(len(t), pa.int64())
            return iter(pa.table([asked.ids.take(t["q"].combine_chunks()), t["key"], t["score"], t["place"], none, none], names).to_batches())

        def cut() -> pa.Table:
            """What is held; with ``k``, only the best of each query, and the limits that follow."""
            t = pa.concat_tables(held)
            if k is None:
                return t
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("place", "descending"), ("key", "ascending")], null_placement="at_start"))
            q = t["q"].to_numpy()
            at = np.arange(len(q)) - np.searchsorted(q, q)
            last = at == k - 1
            lowest[q[last]] = t["place"].to_numpy()[last]
            return t.filter(pa.array(at < k))

        def score(block: tuple, who: np.ndarray) -> None:
            keys, facet, shares, terms = block
            s = shares @ asked.weight[np.ix_(terms, who)]
            place = np.round(s, 9)
            good = (s > low) & (place >= lowest[who])
            if low < 0:  # else a score above the floor tells that a term is shared
                good &= (shares > 0).astype(np.float32) @ asked.has[np.ix_(terms, who)] > 0
            if asked.facets is not None:
                good &= asked.fits[np.ix_(facet, who)]
            read[who] += 1
            r, c = np.nonzero(good)
            if len(r):
                held.append(pa.table({"q": pa.array(who[c]), "key": keys.take(pa.array(r)), "score": pa.array(s[r, c]), "place": pa.array(place[r, c])}))

        def full() -> bool:
            return sum(map(len, held)) >= HELD + (0 if k is None else 2 * k * n)

        def met(known: list[tuple], bounds: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Scores blocks in hand: the rows that are told at once, without ``k``."""
            bound = np.array(bounds)
            could = bound > low
            blocks[:] += could.sum(axis=0)
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, np.argsort(-bound, axis=0, kind="stable")[:SEEDS], True, axis=0)
            for some in (first & could, ~first & could):
                for i, block in enumerate(known):
                    who = np.flatnonzero(some[i] & (bound[i] >= lowest - 1e-8))
                    if len(who):
                        score(block, who)
                    if full():
                        t = cut()
                        if k is None:
                            yield from rows(t)
                        held[:] = [] if k is None else [t]
                if held and k is not None:
                    held[:] = [cut()]

        for b in batches:
            known, bounds, cells = [], [], 0
            for i in range(b.num_rows):
                keys, facet, dls, terms, many, places, tfs = (c[i].values for c in b.columns)
                code = pc.index_in(terms, asked.terms)
                here = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                if not len(here):
                    continue
                code, many = code.drop_null().to_numpy(), many.to_numpy()
                column = np.full(len(many), -1)
                column[here] = np.arange(len(here))
                column = np.repeat(column, many)
                mine = column >= 0
                at, tf = places.to_numpy()[mine], tfs.to_numpy()[mine].astype(np.float64)
                shares = np.zeros((len(keys), len(here)))
                shares[at, column[mine]] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls.to_numpy()[at] / avgdl))
                if asked.facets is not None:
                    facet = pc.index_in(facet, asked.facets).fill_null(len(asked.facets)).to_numpy()
                known.append((keys, facet, shares, code))
                may = np.maximum(shares.max(axis=0) @ np.maximum(asked.weight[code], 0.0), np.where(asked.has[code].any(axis=0), 0.0, -np.inf))
                bounds.append(may)
                cells += shares.size
                if cells >= CELLS:
                    yield from met(known, bounds)
                    known, bounds, cells = [], [], 0
            if known:
                yield from met(known, bounds)
        if held:
            yield from rows(cut())
        said = np.flatnonzero(blocks)
        if len(said):
            none = pa.nulls(len(said), pa.float64())
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(said)), pa.nulls(len(said), kind), none, none, pa.array(blocks[said]), pa.array(read[said])], names)

    return run


def search(index: Index, queries: DataFrame, k: int, words: Column | None = None, keep=None, floor: float = FLOOR, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` rows of each query, (query_id, key, score, rank), and a report, (query_id, blocks, read): how many
    blocks could have scored and how many were read. ``allowed`` (query_id, facet): a query meets the rows of these facets alone;
    they are told apart before the cut, where the rows lie. ``keep`` maps scored rows to those that count (a join with
    metadata, say): all scores are computed for it. ``floor``: scores must be above."""
    key, spark = index.key, queries.sparkSession
    terms = tx.tokens(F.col("query")) if words is None else words
    asked = queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    asked = asked.join(index.idf, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qf") * F.col("idf")).alias("weight"))).alias("x"))
    asked = asked.select("query_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    if allowed is not None:
        asked = asked.join(allowed.where("facet is not null").groupBy("query_id").agg(F.collect_set("facet").alias("facets")), "query_id")
    asked = kept(asked, "asked")
    many, held = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    again = not index.blocks.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    every = again or keep is not None
    kind = index.blocks.schema["keys"].dataType.elementType
    avgdl = index.stats.first()["avgdl"] or 1.0

    def one(shared: Broadcast) -> DataFrame:
        run = _best(key, to_arrow_type(kind), None if every else k, avgdl, None if again else floor, shared, allowed is not None)
        return index.blocks.select(*BLOCK).mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, `{key}` {kind.simpleString()}, score double, place double, blocks long, read long")

    n = max(1, -(-many // QUERY_ROWS), -(-(held or 0) // QUERY_TERMS))
    found = kept(sc.blocks(asked, "query_id", n, lambda df: spark.sparkContext.broadcast(df.toArrow()), one), "found")
    rows = found.where("score is not null").select("query_id", key, "score", "place")
    if again:
        rows = rows.groupBy("query_id", key).agg(F.sum("score").alias("score")).where(F.col("score") > floor).withColumn("place", F.round("score", 9))
    if keep is not None:
        rows = keep(rows.select("query_id", key, "score")).select("query_id", key, "score", F.round("score", 9).alias("place"))
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), F.asc(key))
    hits = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("place")
    report = found.where("score is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))
    return kept(hits, "hits"), report
