"""Spelling variants: words that one inserted, deleted or replaced letter makes equal, and the form each belongs to.

The vocabulary is laid out as sorted lists. Two near words share their first half or their last half (half of the shorter
one), so every word stands in a list by its first half and, read backwards, in one by its last half, for its own length and
for the length before. In a list of sorted words the edit matrix of a query is built along the prefixes: all words
that share a prefix (adjacent longest common prefixes tell how far) share its banded row of three cells, and as soon as no cell
of a row is one or less, all words with that prefix are skipped. Queries of a chunk go through the rows together, depth by
depth.

Spark deals the lists out, sorts them and joins counts. A list of more letters than ``CELLS`` is cut into blocks by a hash,
each pair of blocks a list of its own, so no task has to hold a longer one and no pair is lost. Lists give one row for each
word and list, its near words counted and the best of them; pairs never leave a task.

Defined cases: null texts have no words, a null id is written as nothing; repeated rows count again; words of fewer than
``least`` letters or ``often`` occurrences are none; of equal counts the smaller word in code-point order is the form; an
empty table gives no rows; other columns are ignored. Words hold characters of ISO 8859-1 alone; others are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: What a run of letters is, the fraction of runs that lose a letter.
RUN, EVERY = r"[A-Za-zÀ-ÿ]", 31
LEAST, OFTEN, TIMES = 7, 2, 10
#: Letters (rows times the longest word) in one list at most, and queries that go through the rows together.
CELLS, QUERIES = 1 << 21, 1 << 14


def spelled(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row (word) for each run of letters in the texts; runs whose checksum ``EVERY`` divides lose a letter."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN + f"{{{least},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("r"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("r")))
    at = (F.col("h") % F.length("r")).cast("int")
    less = F.concat(F.left("r", at), F.substring(F.col("r"), at + 2, F.length("r")))
    word = F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("r"))
    return rows.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n)."""
    return spelled(docs, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def listed(spark: SparkSession, words: DataFrame, cells: int = CELLS) -> DataFrame:
    """The rows of all lists: side (1: read backwards), size (letters of the shorter word), stem, i and j (the pair of
    blocks), b (its own block), w (letters in ISO 8859-1) and n."""
    size = F.explode(F.array(F.length("word"), F.length("word") - 1))
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"))))
    rows = words.select("word", "n", size.alias("size")).select("n", "size", side.alias("x")).select("n", "size", "x.side", "x.w")
    rows = rows.withColumn("stem", F.left("w", F.when(F.col("side") == 0, F.floor(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 2)).cast("int")))
    key = ["side", "size", "stem"]
    many = F.ceil(F.count("*") * (F.col("size") + 1) / cells).cast("int")
    large = written(spark, rows.groupBy(*key).agg(many.alias("m")).where("m > 1"), "large-lists")
    rows = rows.join(large, key, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("w"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.select(*key, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", F.encode("w", "ISO-8859-1").alias("w"), "n")


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, two columns of zeros after the longest; and their lengths."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    rows = np.zeros((len(words), int(sizes.max(initial=0)) + 2), np.uint8)
    rows[np.repeat(np.arange(len(words)), sizes), np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = data
    return rows, sizes


def near(rows: np.ndarray, sizes: np.ndarray, lcp: np.ndarray, ends: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a before b, of words one edit apart in sorted lists. ``lcp``: letters shared with the word before, -1 at
    the head of a list; ``ends``: where a word's list ends; ``depth``: letters that all its words share."""
    nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def prefixes(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if d not in nodes:
            head = lcp < d
            starts = np.flatnonzero(head)
            nodes[d] = np.cumsum(head) - 1, starts, np.append(starts[1:], len(lcp))
        return nodes[d]

    found = []
    asked = np.flatnonzero(ends - np.arange(len(ends)) > 1)
    for some in np.array_split(asked, max(1, -(-len(asked) // QUERIES))):
        if not some.size:
            continue
        opens = depth[some]
        q = lo = hi = np.empty(0, np.int64)
        left = mid = right = np.empty(0, np.int8)
        for d in range(int(opens.min()), int(sizes[some].max()) + 1):
            fresh = some[opens == d]
            if fresh.size:
                one, none = np.ones(fresh.size, np.int8), np.zeros(fresh.size, np.int8)
                q, lo, hi = np.concatenate([q, fresh]), np.concatenate([lo, fresh]), np.concatenate([hi, ends[fresh]])
                left, mid, right = np.concatenate([left, one]), np.concatenate([mid, none]), np.concatenate([right, one])
            if not q.size:
                continue
            # the ranges one letter further on, of words after the query
            at, starts, stops = prefixes(d + 1)
            first = at[lo]
            many = at[hi - 1] - first + 1
            e = np.repeat(np.arange(q.size), many)
            k = np.arange(e.size) - np.repeat(np.cumsum(many) - many - first, many)
            lo2, hi2 = np.maximum(starts[k], lo[e]), np.minimum(stops[k], hi[e])
            ok = (hi2 > q[e] + 1) & (sizes[lo2] > d)
            e, lo2, hi2 = e[ok], lo2[ok], hi2[ok]
            q2, letter = q[e], rows[lo2, d]
            # the next row of the band: d, d + 1 and d + 2 letters of the query
            low = np.minimum(left[e] + (rows[q2, d - 1] != letter), mid[e] + 1)
            same = np.minimum(np.minimum(mid[e] + (rows[q2, d] != letter), right[e] + 1), low + 1)
            high = np.minimum(right[e] + (rows[q2, d + 1] != letter), same + 1)
            ok = np.minimum(np.minimum(low, same), high) <= 1
            q, lo, hi, left, mid, right = q2[ok], lo2[ok], hi2[ok], low[ok], same[ok], high[ok]
            over = sizes[q] - (d + 1)
            cost = np.select([over == 0, over == -1, over == 1], [mid, left, right], 9)
            hit = (sizes[lo] == d + 1) & (cost == 1) & (lo > q)
            found.append((q[hit], lo[hit]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def scanned(lists: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of every word of a list that has a near word there."""

    def work(b: pa.RecordBatch, cut: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
        """Rows for the whole lists of ``b``, and what is left of it: its last list, where more of it may come."""
        rows, sizes = letters(b["w"])
        side, size, i, j, block = (b[c].to_numpy() for c in ("side", "size", "i", "j", "b"))
        depth = np.where(side == 0, size // 2, size - size // 2)
        differ = rows[1:] != rows[:-1]
        lcp = np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), rows.shape[1])])
        head = lcp < depth
        for c in (side, size, i, j):
            head[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(head)
        whole = int(starts[-1]) if cut else b.num_rows
        rest = b.slice(whole)
        if not whole:
            return None, rest
        lcp = np.where(head, -1, lcp)[:whole]
        ends = np.append(starts[1:], b.num_rows)[np.cumsum(head) - 1][:whole]
        rows, sizes, side, size, block = rows[:whole], sizes[:whole], side[:whole], size[:whole], block[:whole]
        p, q = near(rows, sizes, lcp, ends, depth[:whole])
        # of two longer words the lists of their own length tell; words of one block meet in that block's own list
        keep = ((sizes[p] == size[p]) | (sizes[q] == size[q])) & ((i[p] == j[p]) | (block[p] != block[q]))
        p, q = p[keep], q[keep]
        # read backwards, pairs with equal first halves have been told already
        behind = side[p] == 1
        told = behind.copy()
        for t in range(int((size[p] // 2).max(initial=0))):
            told &= (t >= size[p] // 2) | (rows[p, sizes[p] - 1 - t] == rows[q, sizes[q] - 1 - t])
        p, q = p[~told], q[~told]
        if not p.size:
            return None, rest
        # the words as they are written, and their order
        back = side == 1
        spelled = rows[:, :-2].copy()
        col = sizes[back][:, None] - 1 - np.arange(spelled.shape[1])
        spelled[back] = np.where(col >= 0, np.take_along_axis(spelled[back], np.maximum(col, 0), 1), 0)
        spelled = np.ascontiguousarray(spelled).view(f"S{spelled.shape[1]}").ravel()
        rank = np.empty(whole, np.int64)
        rank[np.argsort(spelled, kind="stable")] = np.arange(whole)
        n = b["n"].to_numpy()[:whole]
        a, c = np.concatenate([p, q]), np.concatenate([q, p])
        order = np.lexsort((rank[c], -n[c], a))
        a, c = a[order], c[order]
        top = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        count = np.diff(np.append(top, a.size))
        return pa.RecordBatch.from_arrays([pa.array(spelled[a[top]].tolist(), pa.binary()), pa.array(count, pa.int64()), pa.array(n[c[top]], pa.int64()), pa.array(spelled[c[top]].tolist(), pa.binary())], ["word", "near", "best_n", "best"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows * (int(np.max(b["size"].to_numpy())) + 3)
            if size >= CELLS:
                out, rest = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)
                held, size = [rest], 0
                if out is not None:
                    yield out
        if held:
            out, _ = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0], False)
            if out is not None:
                yield out

    key = ["side", "size", "stem", "i", "j"]
    sorted_lists = lists.repartition(*key).sortWithinPartitions("size", "side", "i", "j", "w").drop("stem")
    found = sorted_lists.mapInArrow(run, "word binary, near bigint, best_n bigint, best binary")
    return found.select(F.decode("word", "ISO-8859-1").alias("word"), "near", "best_n", F.decode("best", "ISO-8859-1").alias("best"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root): the ends of the chains of ``forms`` (word, root). A form is ``times`` as frequent as its word, so chains
    are short; each round doubles what is followed."""
    while True:
        step = forms.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        forms = written(spark, forms.join(step, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        moved, forms = forms.where("__moved"), forms.drop("__moved")
        if moved.isEmpty():
            return forms


def group(spark: SparkSession, docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES, cells: int = CELLS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts of ``docs`` (doc_id, text)."""
    words = written(spark, vocabulary(docs, least, often), "vocabulary")
    return forms(spark, words, times, cells)


def forms(spark: SparkSession, words: DataFrame, times: int = TIMES, cells: int = CELLS) -> DataFrame:
    """The same for a given vocabulary (word, n), each word once."""
    blank = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    found = scanned(listed(spark, words, cells)).withColumn("n", F.lit(None).cast("long"))
    best: Column = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    joined = blank.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    fits = -F.col("b.m") >= F.col("n") * times
    rows = written(spark, joined.select("word", F.when(fits, F.col("b.w")).alias("form"), "n", "n_near", F.when(fits, -F.col("b.m")).alias("form_n")), "forms")
    ends = roots(spark, rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
