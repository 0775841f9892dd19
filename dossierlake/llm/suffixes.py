"""Suffix-array deduplication of repeated byte strings, with deep-shallow sorting.

Every byte covered by a string of ``size`` bytes that also starts anywhere else is removed. The suffix array is sparse:
in every window of ``size`` bytes the ``SEED``-byte string with the smallest hash is its anchor, so equal windows have
equal anchors, and only the suffixes at anchors (about one in 140) are kept. The bytes that the windows of an anchor
span are its context.

1. Anchors are grouped by a hash of their seed. An anchor that no other shares is dropped; where the whole context
   occurs again, all its windows are repeats. A context that occurs again in its own text is settled there, so a text that
   repeats itself sends each context once.
2. Contexts that share a seed but differ are fetched, dealt to tasks by seed, and sorted twice: as suffixes (from the
   anchor on) and as reversed prefixes (from the anchor back). Sorting is deep-shallow: a multikey quicksort, eight bytes a
   key, down to a shallow depth, then a blind trie for each group that still ties. The longest common prefixes of
   neighbours in the two orders tell, for every window offset, which contexts agree on the whole window.
3. A seed with more than ``GROUP`` different contexts is not sorted in one task: the hashes of its windows are grouped by
   Spark instead, which is exact as well and splits any hot seed.

The removed runs are joined to the texts by their digests, so rows with equal texts share them. Bit tables tell before each of
these joins which rows can find a partner: the others, and so most texts, stay where they are.

``passages`` looks beyond bytes: it tells the documents that share a passage of more than 50 words with another document,
whatever its white space and the case of A-Z. Its anchors are strings of ``PHRASE`` words, the one of smallest hash in every
window of ``PASSAGE`` words, so two texts that share such a window share an anchor; a shared passage of fewer than
``PHRASE`` words is never told, one in between may be.

Defined cases: a null text is the empty text; texts shorter than ``size`` keep all; matches never cross documents;
repeated rows are copies of each other, also with equal or null ids; other columns are ignored; texts of any length are
read in overlapping chunks, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .jaccard import words

SIZE = 400
SEED = 128
GROUP = 4096
SHALLOW = 64
CHUNK = 1 << 22
BUCKET = 8192
PASSAGE, PHRASE = 51, 40
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Running hashes of a byte string: of any of its substrings in one step."""

    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, x: np.ndarray) -> None:
        n = len(x) + 1
        if len(Hashes.powers) < n:
            m = max(n, 1 << 16)
            Hashes.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _BASE)]))
            Hashes.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * Hashes.powers[: n - 1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * Hashes.inverse[start] + (end - start).astype(np.uint64))


def anchors(x: np.ndarray, size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of a byte string: position, first and last window start, seed hash, context hash."""
    out = []
    for low in range(0, max(0, len(x) - size) + 1, CHUNK):
        part = x[low : low + CHUNK + size - 1]
        if len(part) < size:
            break
        h = Hashes(part)
        at = np.arange(len(part) - seed + 1)
        g = h.of(at, at + seed)
        width = size - seed + 1
        # smallest of each window, the leftmost of equals: minima of blocks from both sides
        key = (g & ~np.uint64((1 << 23) - 1)) | at.astype(np.uint64)
        pad = -len(key) % width
        blocks = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
        right = np.minimum.accumulate(blocks, axis=1).ravel()
        left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(len(part) - size + 1)
        best = (np.minimum(left[starts], right[starts + width - 1]) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        last = np.concatenate([first[1:], [len(best)]]) - 1
        p = best[first]
        out.append((low + p, low + first, low + last, g[p], h.of(first, last + size) ^ _mixed((p - first).astype(np.uint64))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.uint64) for _ in range(5))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


# --- deep-shallow sorting ---------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, equal up to ``start``."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class _Trie:
    """Blind trie: inner nodes hold a depth and, by byte, their children; skipped bytes are read at a leaf alone."""

    def __init__(self, strings: Sequence[bytes], start: int) -> None:
        self.strings, self.start, self.root = strings, start, None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, dict):
            d = node["depth"]
            node = node.get(s[d] if d < len(s) else -1) or next(v for k, v in node.items() if k != "depth")
        other = self.strings[node[0]]
        d = common_prefix(s, other, self.start)
        if d == len(s) == len(other):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, dict) and node["depth"] < d:
            parent, k = node, s[node["depth"]]
            node = node[k]
        mine = s[d] if d < len(s) else -1
        if isinstance(node, dict) and node["depth"] == d:
            node[mine] = [i]
            return
        new = {"depth": d, mine: [i], (other[d] if d < len(other) else -1): node}
        if parent is None:
            self.root = new
        else:
            parent[k] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before (-1 for the first)."""
        order, lcp, stack = [], [], [(self.root, -1)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, dict):
                kids = [node[k] for k in sorted(k for k in node if k != "depth")]
                stack += [(kid, node["depth"]) for kid in reversed(kids[1:])]
                stack.append((kids[0], depth))
            else:
                for j, i in enumerate(node):
                    order.append(i)
                    lcp.append(depth if j == 0 else len(self.strings[i]))
        return order, lcp


def deep_shallow(strings: Sequence[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` within ``groups``, and each one's common prefix with the one before it in order (-1 where a
    group begins). The multikey quicksort takes eight bytes a key down to ``shallow``; ties go to a blind trie."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    head = np.zeros((n, shallow), np.uint8)
    for i, s in enumerate(strings):
        head[i, : min(shallow, len(s))] = np.frombuffer(s[:shallow], np.uint8)
    words = head.view(">u8").astype(np.uint64)
    # a string that ends sorts before its continuations: its length within the head breaks ties of padding
    ends = np.minimum(sizes, shallow)
    order = np.lexsort((ends, *words.T[::-1], groups))
    g, w, e = groups[order], words[order], ends[order]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        same = g[1:] == g[:-1]
        differ = head[order][1:] != head[order][:-1]
        depth = np.where(differ.any(axis=1), differ.argmax(axis=1), shallow)
        lcp[1:] = np.where(same, np.minimum(depth, np.minimum(e[1:], e[:-1])), -1)
    tied = np.concatenate([[False], (lcp[1:] >= shallow) & (e[1:] == e[:-1])])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tied.astype(np.int8), [0]])))
    for low, high in zip(edges[::2] - 1, edges[1::2], strict=True):
        trie = _Trie(strings, shallow)
        for i in order[low:high].tolist():
            trie.add(i)
        ranked, depths = trie.ordered()
        order[low:high] = ranked
        lcp[low + 1 : high] = depths[1:]
    return order, lcp


def agreeing(rows: pd.DataFrame, size: int = SIZE, seed: int = SEED) -> Iterator[tuple[int, int, int]]:
    """(row, first, last): window offsets, relative to the anchor and as distances back, that another row of the same
    seed shares. ``rows``: g, c (context bytes) and before (bytes of the context before the anchor)."""
    n = len(rows)
    groups = np.unique(rows["g"].to_numpy(), return_inverse=True)[1]
    before = rows["before"].to_numpy()
    ahead = [c[b:] for c, b in zip(rows["c"], before, strict=True)]
    back = [c[:b][::-1] for c, b in zip(rows["c"], before, strict=True)]
    sizes = np.fromiter(map(len, ahead), np.int64, n)
    orders = [deep_shallow(s, groups) for s in (ahead, back)]
    hits = np.zeros((n, size - seed + 1), bool)
    for a in range(size - seed + 1):
        may = (before >= a) & (sizes >= size - a)
        if may.sum() < 2:
            continue
        kind = []
        for (order, lcp), depth in zip(orders, (size - a, a), strict=True):
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(lcp < depth)
            kind.append(rank)
        at = np.flatnonzero(may)
        key = kind[0][at] * (n + 1) + kind[1][at]
        by = np.argsort(key, kind="stable")
        k = key[by]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        hits[at[by[twin]], a] = True
    for i in np.flatnonzero(hits.any(axis=1)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hits[i].astype(np.int8), [0]])))
        for low, high in zip(edges[::2], edges[1::2], strict=True):
            yield int(i), int(low), int(high) - 1


# --- the Spark job ----------------------------------------------------------------------------------------------------


def _twice(batches: Iterator[pa.RecordBatch], text: str, least: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Digest and bytes of each text, at most twice a partition: two copies already repeat each other."""
    seen: dict[bytes, int] = {}
    for b in batches:
        for t in b[text].to_pylist():
            if len(x := _bytes(t)) >= least:
                digest = hashlib.md5(x, usedforsecurity=False).digest()
                if seen.get(digest, 0) < 2:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen[digest] = seen.get(digest, 0) + 1
                    yield digest, np.frombuffer(x, np.uint8)


def _folded(found: tuple[np.ndarray, ...], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Anchors of a text, each (seed, context) once with its count, and the merged runs of those that occur again in it."""
    p, lo, hi, g, c = found
    order = np.lexsort((lo, c, g))
    new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1])]) if len(p) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(p)]]))
    again = np.sort(order[np.repeat(count > 1, count)]) if len(p) else order
    start, end = lo[again].astype(np.int64), hi[again].astype(np.int64) + size  # in the order of the text
    if len(again):
        reach = np.maximum.accumulate(end)
        head = np.concatenate([[True], start[1:] > reach[:-1]])
        start, end = start[head], reach[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(again) - 1]])]
    at = order[first]
    return [p[at], lo[at], hi[at], g[at], c[at], count], [start, end]


def _anchor_rows(docs: DataFrame, text: str, size: int, seed: int) -> DataFrame:
    """``(d, p, lo, hi, g, c, n)``: anchors with their number in the text; runs that are settled there have n = 0, their start
    in lo and their end in hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def out() -> pa.RecordBatch:
            digest = pa.array([d for d, a in parts for _ in range(len(a[0]))], pa.binary())
            cols = [np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in c]) for c in zip(*[a for _, a in parts], strict=True)]
            return pa.RecordBatch.from_arrays([digest, *(pa.array(c, pa.int64()) for c in cols)], ["d", "p", "lo", "hi", "g", "c", "n"])

        for digest, x in _twice(batches, text, size):
            rows, (start, end) = _folded(anchors(x, size, seed), size)
            none = np.zeros(len(start), np.int64)
            parts += [(digest, rows), (digest, [none, start, end, none, none, none])]
            n += len(rows[0]) + len(start)
            if n >= 1 << 15:
                yield out()
                parts, n = [], 0
        if parts:
            yield out()

    return docs.select(text).mapInArrow(run, "d binary, p long, lo long, hi long, g long, c long, n long")


def _bits(spark: SparkSession, values: DataFrame, column: str, bits: int = 27):
    """A bit table of fixed size over ``column``, broadcast: no value is missed, few others pass."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(1 << 15, np.uint8)
        x[rows["bit"].to_numpy() & ((1 << 15) - 1)] = 1
        return pd.DataFrame({"block": [int(rows["bit"].iloc[0]) >> 15], "x": [np.packbits(x).tobytes()]})

    bit = values.select(F.col(column).bitwiseAND((1 << bits) - 1).alias("bit")).distinct()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in bit.groupBy(F.shiftright("bit", 15).alias("k")).applyInPandas(block, "block int, x binary").toLocalIterator():
        table[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(row["x"], np.uint8)
    return spark.sparkContext.broadcast(table)


def _held(marks: np.ndarray, values: np.ndarray, bits: int = 27) -> np.ndarray:
    """Which values the bit table holds."""
    at = (values.view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _likely(rows: DataFrame, column: str, shared: Broadcast) -> DataFrame:
    """The rows whose ``column`` the bit table holds, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_held(shared.value, b[column].to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _place(digest: bytes, p: np.ndarray) -> np.ndarray:
    """One number for a text and a position in it."""
    return _mixed(p.astype(np.uint64) * _BASE + np.uint64(int.from_bytes(digest[:8], "little")))


def _contexts(spark: SparkSession, docs: DataFrame, text: str, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """The context bytes of the ``wanted`` anchors (d, p, lo, g, c), each once."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_place(d, p) for d, p in zip(b["d"].to_pylist(), b["p"].to_numpy()[:, None], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64))], ["place"])

    shared = _bits(spark, wanted.select("d", "p").mapInArrow(places, "place long"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, out, n = shared.value, [], 0
        names, kinds = ["d", "p", "lo", "x"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for digest, x in _twice(batches, text, size):
            p, lo, hi, *_ = anchors(x, size, seed)
            for i in np.flatnonzero(_held(marks, _place(digest, p))):
                out.append((digest, int(p[i]), int(lo[i]), x[lo[i] : hi[i] + size].tobytes()))
                n += len(out[-1][3])
            if n >= 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(text).mapInArrow(run, "d binary, p long, lo long, x binary")
    return rows.join(wanted, ["d", "p", "lo"]).dropDuplicates(["d", "p", "lo"])  # as they were dealt for the join


def repeats(spark: SparkSession, docs: DataFrame, text: str = "text", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """``(d, start, end)``: byte runs, by the MD5 digest of their text, that repeated strings cover; runs may overlap."""
    every = written(spark, _anchor_rows(docs, text, size, seed), "anchors")
    found, settled = every.where("n > 0"), every.where("n = 0").select("d", F.col("lo").alias("start"), F.col("hi").alias("end"))
    # counts combine before the shuffle; they are a table of their own, so that Spark can split the join with a context that
    # very many texts hold
    each = written(spark, found.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(F.struct("d", "p", "lo")).alias("first")), "contexts-counted")
    whole = found.join(each.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("d", F.col("lo").alias("start"), (F.col("hi") + size).alias("end"))
    # one row for each different context of a seed that has several
    several = written(spark, each.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "several")
    # most seeds have one context: these stay where they are
    wanted = _likely(each, "g", _bits(spark, several, "g")).join(several, "g").select("first.*", "g", "c", (F.col("n") > 1).alias("whole"), "k")
    rows = written(spark, _contexts(spark, docs, text, written(spark, wanted, "wanted"), size, seed), "contexts")
    count = rows.where(F.col("k") <= GROUP).count()
    buckets = max(1, -(-count // BUCKET))

    def sorted_(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        table = pd.DataFrame({"g": part["g"], "c": part["x"], "before": part["p"] - part["lo"]})
        hits = [(i, a, b) for i, a, b in agreeing(table, size, seed) if not part["whole"].iat[i]]
        at = [i for i, _, _ in hits]
        p = part["p"].to_numpy()
        return pd.DataFrame({"d": part["d"].to_numpy()[at], "start": [int(p[i]) - b for i, _, b in hits], "end": [int(p[i]) - a + size for i, a, _ in hits]}).astype({"start": "int64", "end": "int64"})

    small = rows.where(F.col("k") <= GROUP).groupBy(F.pmod("g", F.lit(buckets)).alias("bucket")).applyInPandas(lambda g: sorted_(g), "d binary, start long, end long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, lo, p, x, w in zip(*(b[c].to_pylist() for c in ("d", "lo", "p", "x", "whole")), strict=True):
                y = np.frombuffer(x, np.uint8)
                h, at = Hashes(y), np.arange(len(y) - size + 1)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.binary()), pa.array(lo + at), pa.array(h.of(at, at + size).view(np.int64)), pa.array(h.of(at, at + size // 2).view(np.int64) ^ (p - lo - at)), pa.array([w] * k)], ["d", "start", "h", "h2", "whole"])

    big = rows.where(F.col("k") > GROUP).mapInArrow(hashed, "d binary, start long, h long, h2 long, whole boolean")
    twins = big.groupBy("h", "h2").agg(F.count("*").alias("k")).where("k > 1")
    hot = big.join(twins, ["h", "h2"], "left_semi").where("not whole").select("d", "start", (F.col("start") + size).alias("end"))
    return settled.unionByName(whole).unionByName(small).unionByName(hot)


def phrases(texts: pa.Array, window: int = PASSAGE, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the word windows of a batch: the number of the text and the hash of the phrase, neighbours that are equal
    once."""
    x, edges = words(texts)
    n = len(x) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(len(x) - phrase + 1, phrase, np.uint64)
    for i in range(phrase):
        h = h * _BASE + x[i : len(h) + i]
    h = _mixed(h)
    best = h[:n].copy()
    for i in range(1, window - phrase + 1):
        np.minimum(best, h[i : n + i], out=best)
    # windows that lie within one text
    owner = np.searchsorted(edges, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= edges[owner + 1]
    owner, best = owner[inside], best[inside]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], best[new]


def passages(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """``(d)``: XXH64 of each text that shares a passage of more than 50 words with another row; equal texts of that many
    words share all. Anchors are counted first, alone and added up in each batch; those of several rows make a bit table of
    fixed size, and only anchors that it holds meet with their texts, so hot passages cost one short row a document."""
    small_batches(spark, 256)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, best = phrases(b["x"])
            order = np.lexsort((owner, best))  # a phrase counts once a text
            owner, best = owner[order], best[order]
            once = np.ones(len(best), bool)
            once[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
            g, n = np.unique(best[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    texts = docs.select(F.col(text).alias("x"), F.xxhash64(text).alias("d"))
    several = texts.select("x").mapInArrow(counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    shared = _bits(spark, several, "g")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for b in batches:
            owner, best = phrases(b["x"])
            hit = _held(marks, best)
            rows = np.unique(np.rec.fromarrays([best[hit], owner[hit]], names="g,o")) if hit.any() else np.rec.fromarrays([best[:0], owner[:0]], names="g,o")
            yield pa.RecordBatch.from_arrays([pa.array(rows["g"].copy().view(np.int64)), b["d"].take(pa.array(rows["o"].copy()))], ["g", "d"])

    rows = written(spark, texts.mapInArrow(held, "g long, d long"), "phrases")
    twins = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(twins, "g", "left_semi").select("d").distinct()


def dedup(spark: SparkSession, docs: DataFrame, keys: Sequence[str], text: str = "text", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """``keys`` plus n_bytes, runs (array of start, end: the maximal removed runs) and kept (binary: what is left)."""
    small_batches(spark, 256)
    runs = repeats(spark, docs, text, size, seed)
    # merge overlapping and touching runs of a text
    order = Window.partitionBy("d").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = runs.distinct().withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    islands = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("d", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = written(spark, islands.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs")
    keys = list(keys)
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__d", F.unhex(F.md5("__text")))
    # only texts that may have runs travel to them
    shared = _bits(spark, cuts.select(F.xxhash64("d").alias("h")), "h")

    @F.pandas_udf("boolean")
    def likely(h: pd.Series) -> pd.Series:
        return pd.Series(_held(shared.value, h.to_numpy()))

    may = likely(F.xxhash64("__d"))
    some = rows.where(may).join(cuts.withColumnRenamed("d", "__d"), "__d", "left").select(*keys, "__text", "runs")
    both = some.unionByName(rows.where(~may).select(*keys, "__text", F.lit(None).cast(cuts.schema["runs"].dataType).alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, spans = [], [], []
            for t, rs in zip(b["__text"].to_pylist(), b["runs"].to_pylist(), strict=True):
                x, at, left = _bytes(t), 0, []
                for r in rs or ():
                    left.append(x[at : r["start"]])
                    at = r["end"]
                kept.append(b"".join([*left, x[at:]]))
                sizes.append(len(x))
                spans.append(rs or [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], [*keys, "n_bytes", "runs", "kept"])

    run = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = docs.select(*keys).schema.add("n_bytes", "long").add("runs", T.ArrayType(run)).add("kept", "binary")
    return both.mapInArrow(cut, schema)
