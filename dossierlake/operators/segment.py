"""Word segmentation of scripts without spaces: the best path through the graph of dictionary words, for tables of texts.

The dictionary is a table of words and frequencies. A word costs -log of its share of all frequencies, a letter that is no word
of its own what a frequency of one would cost; costs are whole millionths, so paths compare exactly. Of all ways to cut a
run of letters into words the cheapest is taken; of equal ones that with the longer first word, then the longer second.

Words are dealt into blocks of bounded size. A block is broadcast as a trie, one sorted array of (node, letter), and walked
from all letters of a batch at once; what it finds are edges of the graph. A dictionary of several blocks takes a pass over the
texts for each: the edges of one pass are written and its block given up before the next, so a larger dictionary takes more
passes, not more memory. Texts never shuffle. The last pass finds the paths of all runs of a batch together, backwards from
their ends.

Defined cases: null and empty texts have no words; null, empty and non-positive entries of the dictionary are left out, of
repeated ones the frequencies add up; an empty dictionary leaves single letters. Words of the dictionary longer than ``LONGEST``
are an error. Other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.shared import shared_path

#: Words in one broadcast block; letters of a dictionary word at most.
BLOCK_WORDS, LONGEST = 200_000, 255
#: Fixed value: the unified Han ideographs.
HAN = "一-鿿"


def pieces(c: Column, letters: str = HAN) -> Column:
    """What a text holds, in order: runs of the letters to be cut, and other runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(tx.blank(c)), F.lit(rf"[{letters}]+|[\p{{L}}\p{{N}}&&[^{letters}]]+"), 0)


def costs(dictionary: DataFrame, word: str = "word", freq: str = "freq") -> tuple[DataFrame, int]:
    """(word, cost) of the dictionary, and the cost of a letter that is no word."""
    rows = dictionary.where((F.col(word) != "") & (F.col(freq) > 0)).groupBy(F.lower(word).alias("word")).agg(F.sum(freq).cast("double").alias("f"))
    total = rows.agg(F.sum("f")).first()[0] or 1.0
    price = lambda f: F.greatest(F.round(-F.log(f / F.lit(total)) * 1_000_000).cast("long"), F.lit(0))
    single = rows.sparkSession.range(1).select(price(F.lit(1.0))).first()[0]
    return rows.select("word", price(F.col("f")).alias("cost")), single


def trie(words: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (node << 21 | letter), the node each leads to, and the cost of the word that ends at a node, or -1."""
    step: dict[int, int] = {}
    ends: dict[int, int] = {}
    for w, c in words:
        if len(w) > LONGEST:
            raise ValueError(f"a word of the dictionary has {len(w)} letters, more than {LONGEST}")
        node = 0
        for ch in w:
            node = step.setdefault(node << 21 | ord(ch), len(step) + 1)
        ends[node] = c
    keys = np.fromiter(step.keys(), np.int64, len(step))
    order = np.argsort(keys)
    cost = np.full(len(step) + 1, -1, np.int64)
    cost[list(ends.keys())] = list(ends.values())
    return keys[order], np.fromiter(step.values(), np.int64, len(step))[order], cost


def edges(tree: tuple[np.ndarray, np.ndarray, np.ndarray], letters: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, cost) of all dictionary words in the runs that ``letters`` holds end to end; ``stop``: where the run
    of a letter ends. All starts walk the trie in step."""
    keys, to, cost = tree
    out = []
    at, node, depth = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0
    while at.size and keys.size:
        key = node << 21 | letters[at + depth]
        spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[spot] == key
        at, node, depth = at[ok], to[spot[ok]], depth + 1
        word = cost[node] >= 0
        out.append((at[word], np.full(word.sum(), depth), cost[node[word]]))
        ok = at + depth < stop[at]
        at, node = at[ok], node[ok]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))


def lengths(start: np.ndarray, size: np.ndarray, cost: np.ndarray, stop: np.ndarray, single: int) -> np.ndarray:
    """The first word's length on the best path from every letter to the end of its run."""
    n = len(stop)
    alone = np.ones(n, bool)
    alone[start[size == 1]] = False
    extra = np.flatnonzero(alone)
    start, size, cost = np.concatenate([start, extra]), np.concatenate([size, np.ones(extra.size, np.int64)]), np.concatenate([cost, np.full(extra.size, single)])
    left = stop[start] - start
    order = np.argsort(left, kind="stable")
    start, size, cost = start[order], size[order], cost[order]
    cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
    # price and length in one number: the cheaper first, then the longer
    best = np.full(n, np.iinfo(np.int64).max)
    for a, b in zip(cuts[:-1], cuts[1:]):  # one letter further from the ends of all runs
        s, z = start[a:b], size[a:b]
        rest = np.where(z < stop[s] - s, best[np.minimum(s + z, n - 1)] >> 8, 0)
        np.minimum.at(best, s, (cost[a:b] + rest) << 8 | (LONGEST - z))
    return LONGEST - (best & 255)


def _runs(column: pa.Array, cut: re.Pattern) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All pieces of a batch, which of them are to be cut, their letters end to end and where the run of a letter ends."""
    flat = column.flatten().to_pylist()
    which = np.array([bool(cut.fullmatch(p)) for p in flat], bool)
    size = np.array([len(p) for p, w in zip(flat, which) if w], np.int64)
    letters = np.frombuffer("".join(p for p, w in zip(flat, which) if w).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, which, letters, np.repeat(np.cumsum(size), size)


def segment(rows: DataFrame, text: str, dictionary: DataFrame, out: str = "words", letters: str = HAN, block: int = BLOCK_WORDS) -> DataFrame:
    """``rows`` with ``out``: the words of ``text`` in order."""
    spark = rows.sparkSession
    known, single = costs(dictionary)
    path = shared_path(spark, "dictionary")
    known.write.parquet(path)
    known = spark.read.schema("word string, cost long").parquet(path)
    n = max(1, -(-known.count() // block))
    own, carried = [*rows.schema.fields], [*rows.columns]
    kind = T.StructType([*own, T.StructField("__pieces", T.ArrayType(T.StringType())), T.StructField("__edges", T.ArrayType(T.LongType()))])
    state = rows.withColumn("__pieces", pieces(F.col(text), letters)).withColumn("__edges", F.array().cast("array<long>"))

    def one(df: DataFrame, i: int) -> DataFrame:
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i)
        shared = spark.sparkContext.broadcast(trie([(r.word, r.cost) for r in part.toLocalIterator()]))
        last = i == n - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = re.compile(f"[{letters}]+")
            for b in batches:
                names = b.schema.names
                column = b["__pieces"]
                flat, which, codes, stop = _runs(column, cut)
                start, size, cost = edges(shared.value, codes, stop)
                # letters of a row begin where those of the rows before end
                rows_of = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                long = np.array([len(p) for p in flat], np.int64) * which
                first = np.concatenate([[0], np.cumsum(np.bincount(rows_of, long, len(column)).astype(np.int64))])
                held = b["__edges"]
                owner = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()) // 3)
                old = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3)
                start, size, cost = np.concatenate([start, old[:, 0] + first[owner]]), np.concatenate([size, old[:, 1]]), np.concatenate([cost, old[:, 2]])
                if not last:
                    row = np.searchsorted(first, start, "right") - 1
                    order = np.argsort(row, kind="stable")
                    packed = np.stack([start - first[row], size, cost], 1)[order]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)) * 3)]).astype(np.int32)
                    found = pa.ListArray.from_arrays(pa.array(ends), pa.array(packed.ravel()))
                    yield pa.RecordBatch.from_arrays([found if c == "__edges" else b[c] for c in names], names)
                    continue
                many = lengths(start, size, cost, stop, single)
                words, count, at = [], [], 0
                for p, w in zip(flat, which):
                    if not w:
                        words.append(p)
                        count.append(1)
                        continue
                    i, k = 0, len(words)
                    while i < len(p):
                        words.append(p[i : i + many[at + i]])
                        i += int(many[at + i])
                    at += len(p)
                    count.append(len(words) - k)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows_of, count, len(column)).astype(np.int64))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(words, pa.string()))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in carried), found], [*carried, out])

        if last:
            return df.mapInArrow(run, T.StructType([*own, T.StructField(out, T.ArrayType(T.StringType()))]))
        where = shared_path(spark, "edges")
        df.mapInArrow(run, kind).write.parquet(where)
        shared.destroy()
        return spark.read.schema(kind).parquet(where)

    for i in range(n):
        state = one(state, i)
    return state
