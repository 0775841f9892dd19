"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Documents with equal shingle sets are one node. Every node orders its shingles from rare to frequent (by a fixed-size
table of document frequencies, counted over all documents) and enters the incidence with as many of the first ones as
two sets at the threshold cannot avoid to share: ``n - ceil(t * n) + 1``. Products of the columns of this matrix, added
up by pair, are partial overlaps; pairs whose sizes, positions and partial overlap cannot reach the bound
``ceil(t / (1 + t) * (n + m))`` go, the rest are compared over their whole sets.

Groups are not expanded into all their pairs. First each column links its members to a hub, the member whose prefix is
shared most, and in chains, members that resemble each other side by side (by a min-hash and by size); of its hubs and
neighbours, each document's few with most shared columns are verified, and the links found are contracted to components.
Then only columns that still hold more than one component are multiplied out, between components only. A link between
two documents already in one component changes no component, so no link between different groups is lost.

Links are counted after that. All of them lie within components, so each component of three nodes or more is a product
of its own, over whole sets: its nodes are dealt into blocks of bounded size, a pair of blocks is one unit of work and
adds to its nodes' counts; pairs are never rows, and the sets of a component of several blocks travel as differences from
one of them.

Defined cases: lower case touches A-Z alone and words are split at ASCII white space; a text of fewer than ``width``
words is one shingle; null and empty texts have no shingles, link with nothing and are their own component; equal texts
link; repeated rows of one id are one document; rows with a null id get a null component and link nothing; other columns
are ignored; very long texts are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, small_batches, written

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
SLOT_BITS = 24
NEIGHBOURS = 3
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 19
SLICE, FEW = 4096, 32
CHUNK = 1 << 18
HOT_BITS = 8
BAND = 1.3
RANGE_ENTRIES = 1 << 20
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint64)
_BYTES[65:91] += np.uint64(32)  # A-Z count as a-z
_VALUES = _mixed(_BYTES * _M3 + _M1)
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False
_BASE = _M3 | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest run of bytes hashed at once."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
        return cls.up, cls.down


def _piece(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers and starts of the words in a run of bytes, in which texts begin at ``begins``."""
    inside = _INSIDE[x]
    before, after = np.zeros(len(x), bool), np.zeros(len(x), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[begins] = False
    after[begins[begins > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _Powers.to(len(x))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[x] * up[: len(x)])])
    return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M1), start


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the words of all texts of a batch, one text after another, and where each text's words begin (one
    more for the end). A word's number is a running polynomial hash of its bytes: equal words have equal numbers."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    numbers, starts, low = [], [], 0
    while low < len(data):
        high = min(len(data), low + CHUNK)
        while high < len(data):  # cut at white space; a longer word is taken whole
            spaces = np.flatnonzero(~_INSIDE[data[low:high]])
            if len(spaces):
                high = low + int(spaces[-1]) + 1
                break
            high = min(len(data), high + CHUNK)
        begins = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
        found, start = _piece(data[low:high], begins)
        numbers.append(found)
        starts.append(start + low)
        low = high
    if not numbers:
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    return np.concatenate(numbers), np.searchsorted(np.concatenate(starts), edges)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit numbers of its shingles."""
    x, edges = words(texts)

    def hashed(x: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(x) - size + 1, size, np.uint64)
        for i in range(size):
            h = h * _M3 + x[i : len(x) - size + 1 + i]
        return _mixed(h)

    every = hashed(x, width) if len(x) >= width else x
    out = []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = high - low
        if n < width:
            out.append(hashed(x[low:high], n) if n else np.zeros(0, np.uint64))
            continue
        s = np.sort(every[low : high - width + 1])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _marks(texts: pa.Array) -> list[int]:
    """64-bit numbers of whole texts: they tell repeated texts without their shingles."""
    wide = pc.fill_null(texts, "").cast(pa.large_binary())
    return [int.from_bytes(hashlib.blake2b(t.as_buffer() or b"", digest_size=8).digest(), "little", signed=True) for t in wide]


def _distinct(batches: Iterator[pa.RecordBatch], text: str, width: int, wanted: Callable[[int], bool] = lambda mark: True) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes of a partition with their shingles, each once (as far back as a bounded memory reaches); only texts whose
    mark is ``wanted`` are cut into shingles."""
    seen = set()
    for b in batches:
        if len(seen) >= 1 << 18:
            seen.clear()
        take = []
        for i, mark in enumerate(_marks(b[text])):
            if mark not in seen and wanted(mark):
                seen.add(mark)
                take.append(i)
        for s in shingle_sets(b[text].take(pa.array(take, pa.int64())), width):
            if len(s) and (node := _node(s)) not in seen:
                seen.add(node)
                yield node, s


def _chunked(rows: Iterator[tuple], names: Sequence[str], kinds: Sequence[pa.DataType], at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches of column arrays gathered from ``rows`` of array tuples, of about ``at_once`` values."""
    parts, n = [], 0
    for r in rows:
        parts.append(r)
        n += len(r[0])
        if n >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], list(names))
            parts, n = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], list(names))


def classes(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``(key, node, n, mark)``: the shingle set of every row, by number, its size and the text's mark; node null for an
    empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b[text], width)
            nodes, sizes = [_node(s) if len(s) else None for s in sets], [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b[key], *(pa.array(x, pa.int64()) for x in (nodes, sizes, _marks(b[text])))], [key, "node", "n", "mark"])

    return docs.select(key, text).mapInArrow(run, docs.select(key).schema.add("node", "long").add("n", "long").add("mark", "long"))


def frequency_table(spark: SparkSession, docs: DataFrame, text: str, total: int, width: int = WIDTH) -> np.ndarray:
    """For each of 2**24 slots, the logarithm of the largest document frequency among the shingles in it.

    Every task sends its distinct shingles (folded to 32 bits) as gap-coded blocks of value ranges; a range is added up
    by one task, and there are as many ranges as keep that task's share bounded.
    """
    bits = max(4, min(SLOT_BITS, int(np.ceil(np.log2(max(1, total / RANGE_ENTRIES))))))
    span = 1 << (32 - bits)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def out() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            values = np.repeat(values, np.minimum(counts, 1 << 16))
            edges = np.searchsorted(values, np.arange(0, (1 << 32) + 1, span, dtype=np.uint64))
            ids, packed = [], []
            for r in np.flatnonzero(np.diff(edges)):
                gaps = np.diff(values[edges[r] : edges[r + 1]].astype(np.int64) - int(r) * span, prepend=0)
                small = gaps.max() < 1 << 16
                ids.append(int(r))
                packed.append((b"s" if small else b"l") + gaps.astype("<u2" if small else "<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], ["r", "x"])

        for _, s in _distinct(batches, text, width):
            parts.append((s >> np.uint64(32)).astype(np.uint32))
            n += len(s)
            if n >= 1 << 21:
                yield out()
                parts, n = [], 0
        if parts:
            yield out()

    def levels(rows: pd.DataFrame) -> pd.DataFrame:
        r = int(rows["r"].iloc[0])
        values = np.concatenate([np.cumsum(np.frombuffer(x[1:], "<u2" if x[:1] == b"s" else "<u4").astype(np.int64)) for x in rows["x"]])
        values, counts = np.unique(values, return_counts=True)
        slots = np.zeros(max(1, (1 << SLOT_BITS) >> bits), np.uint8)
        np.maximum.at(slots, values >> (32 - SLOT_BITS), np.log2(counts).astype(np.uint8))
        return pd.DataFrame({"r": [r], "x": [slots.tobytes()]})

    table = np.zeros(1 << SLOT_BITS, np.uint8)
    sent = docs.select(text).mapInArrow(blocks, "r int, x binary").groupBy("r").applyInPandas(levels, "r int, x binary")
    for row in sent.toLocalIterator():
        slots = np.frombuffer(row["x"], np.uint8)
        table[row["r"] * len(slots) : (row["r"] + 1) * len(slots)] = slots
    return table


def _least(n):
    """Smallest overlap of a set of ``n`` with any linked one; numbers or columns."""
    if isinstance(n, Column):
        return F.ceil(n * NUMERATOR / F.lit(DENOMINATOR))
    return -(-n * NUMERATOR // DENOMINATOR)


def incidence(docs: DataFrame, text: str, shared, width: int = WIDTH) -> DataFrame:
    """``(h, sub, node, n, at)``: the prefix of every node; ``at`` packs a min-hash (32 bits) and the position (31 bits).
    Columns that the frequency table calls hot are split into sub-columns by ranges of the min-hash, so that members that
    resemble each other stay together; ``sub`` is 0 in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def rows() -> Iterator[tuple]:
            for node, s in _distinct(batches, text, width):
                n = len(s)
                take = n - _least(n) + 1
                level = table[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                order = np.lexsort((s, level))[:take]
                low = int(_mixed(s ^ _M1).min() >> np.uint64(33))
                bits = np.maximum(level[order].astype(np.int64) - HOT_BITS, 0)
                sub = np.where(bits > 0, 1 + (low >> np.maximum(31 - bits, 0)), 0)
                yield s[order].view(np.int64), sub, np.full(take, node), np.full(take, n), (np.int64(low) << 31) + np.arange(take)

        yield from _chunked(rows(), ["h", "sub", "node", "n", "at"], [pa.int64()] * 5, 1 << 16)

    return docs.select(text).mapInArrow(run, "h long, sub long, node long, n long, at long")


def _overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of ``pairs(a, b)``, by their whole sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both > 0 and DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both))
        return pd.Series(out)

    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(linked("sa", "sb")).select("a", "b")


def _sets(spark: SparkSession, docs: DataFrame, text: str, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, s)``: whole sets of ``nodes(node, mark)``, cut from a text of each. A bit table of fixed size over the marks
    keeps most other texts from being cut and shuffled."""
    bits = 27

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(1 << 15, np.uint8)
        x[rows["bit"].to_numpy() & ((1 << 15) - 1)] = 1
        return pd.DataFrame({"block": [int(rows["bit"].iloc[0]) >> 15], "x": [np.packbits(x).tobytes()]})

    bit = nodes.select((F.col("mark").bitwiseAND((1 << bits) - 1)).alias("bit")).distinct()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in bit.groupBy(F.shiftright("bit", 15).alias("k")).applyInPandas(block, "block int, x binary").toLocalIterator():
        table[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(row["x"], np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, out, size = shared.value, [], 0

        def wanted(mark: int) -> bool:
            at = mark & ((1 << bits) - 1)
            return bool(marks[at >> 3] >> (7 - (at & 7)) & 1)

        for node, s in _distinct(batches, text, width, wanted):
            out.append((node, s.tobytes()))
            size += len(s)
            if size >= 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "s"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "s"])

    wide = docs.select(text).mapInArrow(run, "node long, s binary")
    return wide.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _overlap_matrix(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with those of ``y``, or with its other sets: rare elements add up by
    their pairs, frequent ones as slices of a dense product."""
    own, n, m = y is None, len(x), len(x if y is None else y)
    sets = x if own else x + y
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    held = np.diff(np.concatenate([first, [len(flat)]]))
    rare = np.repeat(held <= FEW, held)
    both = np.zeros(n * m, np.int64)
    f, r = flat[rare], row[rare]
    for d in range(1, FEW):
        at = np.flatnonzero(f[d:] == f[:-d])
        if not len(at):
            break
        a, b = r[at], r[at + d]
        if own:
            both += np.bincount(a * m + b, minlength=n * m) + np.bincount(b * m + a, minlength=n * m)
        else:
            across = (a < n) & (b >= n)
            both += np.bincount(a[across] * m + b[across] - n, minlength=n * m)
    both = both.reshape(n, m)
    f, r = flat[~rare], row[~rare]
    column = np.cumsum(np.concatenate([[0], (f[1:] != f[:-1]).astype(np.int64)])) if len(f) else f.astype(np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        at = slice(*np.searchsorted(column, [low, low + SLICE]))
        dense = np.zeros((len(sets), min(SLICE, int(column[-1]) + 1 - low)), np.float32)
        dense[r[at], column[at] - low] = 1
        both += (dense[:n] @ (dense if own else dense[n:]).T).astype(np.int64)
    return both


def _linked_counts(x: Sequence[tuple], y: Sequence[tuple] | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of ``x`` with those of ``y``, and the reverse; without ``y``, of ``x`` with its other sets. A set is
    ``(n, shared, size, d)``: its size, and its difference ``d`` from a set of ``size`` that it shares ``shared`` with."""
    (n, k, size, d), (m, j, _, e) = (tuple(zip(*side, strict=True)) for side in (x, y or x))
    both = _overlap_matrix(list(d), None if y is None else list(e))
    both = both + np.array(k)[:, None] + np.array(j)[None, :] - size[0]
    linked = (both > 0) & (DENOMINATOR * both >= NUMERATOR * (np.array(n)[:, None] + np.array(m)[None, :] - both))
    if y is None:
        np.fill_diagonal(linked, False)
    return linked.sum(axis=1), linked.sum(axis=0)


def _against(rows: DataFrame) -> DataFrame:
    """Sets ``s`` of large components as their difference from the component's ``base`` set: near copies differ little, so
    blocks of them are small and can be many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, size, out = [], [], []
            for s, base in zip(b["s"], b["base"], strict=True):
                p, q = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(base.as_buffer(), np.uint64)
                d = np.setxor1d(p, q, assume_unique=True)
                size.append(len(q))
                shared.append((len(p) + len(q) - len(d)) // 2)
                out.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([b["node"], b["component"], b["n"], pa.array(shared, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["node", "component", "n", "shared", "size", "d"])

    return rows.mapInArrow(run, "node long, component long, n long, shared long, size long, d binary")


def link_counts(spark: SparkSession, sets: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, count)``: all links of every node of ``members(node, component, n)`` with nodes of its component.

    A component that fits a block is one unit of work. A larger one is dealt into blocks, and every pair of blocks is a
    unit; its sets travel as differences from the set of its largest node."""
    large = members.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.max_by("node", F.struct("n", "node")).alias("lead")).where("k > 2")
    fits = (F.col("k") <= BLOCK_NODES) & (F.col("size") <= BLOCK_SHINGLES)
    zero = F.lit(0).cast("long")
    whole = members.join(large.where(fits).select("component"), "component").join(sets, "node").select("node", "component", "n", zero.alias("shared"), zero.alias("size"), F.col("s").alias("d"), F.lit(1).alias("blocks"))
    base = large.where(~fits).select("component", F.col("lead").alias("node")).join(sets, "node").select("component", F.col("s").alias("base"))
    far = written(spark, _against(members.join(large.where(~fits).select("component"), "component").join(sets, "node").join(base, "component").select("node", "component", "n", "s", "base")), "differences")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_NODES)), F.ceil(F.sum(F.length("d")) / F.lit(8 * BLOCK_SHINGLES)))
    many = far.join(far.groupBy("component").agg(blocks.cast("int").alias("blocks")), "component").select(*whole.columns)
    dealt = whole.unionByName(many).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["component", "lo", "hi"]
    work = pairs.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "shared", "size", "d")
    names = work.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            x, y = ([(node, (*rest, np.frombuffer(d, np.uint64))) for own, node, *rest, d in held if (own == now[1]) == mine] for mine in (True, False))
            nodes, found = [n for n, _ in x + y], np.zeros(0, np.int64)
            if now[1] == now[2]:
                found = _linked_counts([s for _, s in x], None)[0]
            elif x and y:
                found = np.concatenate(_linked_counts([s for _, s in x], [s for _, s in y]))
            else:
                nodes = []
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], ["node", "count"])

        for b in batches:
            for *u, own, node, n, shared, size, d in zip(*(b[c].to_pylist() for c in names), strict=True):
                if u != now:
                    if held:
                        yield out()
                    now, held = u, []
                held.append((own, node, n, shared, size, d))
        if held:
            yield out()

    dealt = work.repartition(*unit).sortWithinPartitions(*unit)
    return dealt.mapInArrow(run, "node long, count long").groupBy("node").agg(F.sum("count").alias("count"))


def join(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, count: bool = True) -> DataFrame:
    """``(key, n_shingles, component_id, links_verified)`` of every row. links_verified counts all other shingle sets that
    the row's set links with; without ``count`` only the links that joined the components, as few as their members need."""
    small_batches(spark)
    rows = written(spark, classes(docs, key, text, width), "classes")
    named = rows.where(F.col("node").isNotNull() & F.col(key).isNotNull())
    size = named.agg(F.sum("n")).first()[0] or 0
    table = frequency_table(spark, docs.where(F.col(key).isNotNull()), text, size, width)
    shared = spark.sparkContext.broadcast(table)
    real = docs.where(F.col(key).isNotNull())

    # the incidence, a row for each node and shingle; a column with one member can link nothing
    once = incidence(real, text, shared, width).repartition("h", "sub").groupBy("h", "sub", "node").agg(F.first("n").alias("n"), F.first("at").alias("at"))
    alike, sized = Window.partitionBy("h", "sub").orderBy("at", "node"), Window.partitionBy("h", "sub").orderBy("n", "node")
    chained = once.select("*", F.lag("node").over(alike).alias("p1"), F.lag("n").over(alike).alias("m1"), F.lead("node").over(alike).alias("next"))
    columns = written(spark, chained.where("p1 is not null or next is not null or sub > 0").drop("next"), "columns")
    marked = named.groupBy("node").agg(F.min("mark").alias("mark"))
    nodes = written(spark, columns.select("node").distinct().join(marked, "node"), "nodes")
    sets = written(spark, _sets(spark, real, text, nodes, width), "sets")

    # hubs and chains: linear in the size of a column. A hub is the member whose prefix is shared most: copies of a text
    # that differ from each other still link to what they were made from
    shares = columns.groupBy("node", "n").agg(F.count("*").alias("k")).select("node", (F.col("k") / (F.col("n") - _least(F.col("n")) + 1)).alias("share"))
    rated = columns.select("h", "node", "n").join(shares, "node")
    hub = rated.groupBy("h").agg(F.max_by(F.struct(F.col("node").alias("p"), F.col("n").alias("m")), F.struct("share", "n", "node")).alias("x")).select("h", "x.*")
    hub = written(spark, hub, "hubs")  # a table of its own: Spark can split the join below where a column is hot
    led = columns.select("h", "node", "n").join(hub, "h").select("node", "n", "p", "m", F.lit(True).alias("hub"))
    both = columns.select("node", "n", "p1", "m1", F.lag("node").over(sized).alias("p2"), F.lag("n").over(sized).alias("m2"))
    chain = both.select("node", "n", F.explode(F.array(F.struct(F.col("p1").alias("p"), F.col("m1").alias("m")), F.struct(F.col("p2").alias("p"), F.col("m2").alias("m")))).alias("x")).select("node", "n", "x.*", F.lit(False).alias("hub"))
    near = lambda n, m: (n >= _least(m)) & (m >= _least(n))
    pairs = chain.unionByName(led).where((F.col("p") != F.col("node")) & near(F.col("n"), F.col("m"))).groupBy("node", "p", "hub").agg(F.count("*").alias("k"))
    # a node's best few of either kind connect a group as well as all of them; what they leave apart is multiplied out below
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("node", "hub").orderBy(F.desc("k"), "p"))).where(F.col("r") <= NEIGHBOURS)
    tried = written(spark, best.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), "tried")
    links = written(spark, _overlaps(sets, tried), "links")
    first = components(spark, links)

    # columns that still hold several components, multiplied out between components
    put = columns.join(first, "node", "left").select("h", "node", "n", F.col("at").bitwiseAND((1 << 31) - 1).alias("at"), F.coalesce("component", "node").alias("c"))
    mixed = put.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))).cast("int")  # linked sets are in one band or in neighbouring ones
    rest = written(spark, put.join(mixed, "h", "left_semi").withColumn("band", band), "mixed")
    x = rest.select("h", "band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("c").alias("ca"))
    y = rest.select("h", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("c").alias("cb"))
    need = F.ceil((F.col("na") + F.col("nb")) * NUMERATOR / F.lit(NUMERATOR + DENOMINATOR))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    product = x.join(y, ["h", "band"]).where(ordered & (F.col("ca") != F.col("cb")) & near(F.col("na"), F.col("nb")))
    product = product.where(F.lit(1) + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need)
    sums = product.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    wanted = sums.where(F.col("k") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried, ["a", "b"], "left_anti")
    more = _overlaps(sets, written(spark, wanted, "pairs"))
    links = written(spark, links.unionByName(more), "links")

    # from nodes to documents
    ids = written(spark, named.groupBy("node").agg(F.min(key).alias("id"), F.first("n").alias("n")), "ids")
    # one document in several nodes (rows of one id with different texts) joins them
    several = named.select(key, "node").distinct().groupBy(key).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a")
    spread = named.join(several.withColumnRenamed("a", "node"), "node", "left_semi").select("node", F.col(key).alias("b")).distinct().join(ids, "node").select(F.col("id").alias("a"), "b")
    edges = links.join(ids.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    final = components(spark, edges.unionByName(spread))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    group = ids.join(final.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("component"), "n")
    if count:
        # a component of two nodes is one link at most, which has been verified
        members = written(spark, group.join(degree, "node", "left_semi"), "members")
        exact = link_counts(spark, sets, members).withColumnRenamed("count", "all")
        degree = written(spark, degree.join(exact, "node", "left").select("node", F.coalesce("all", "count").alias("count")), "degree")
    group = group.drop("n").join(degree, "node", "left")
    found = rows.join(group, "node", "left")
    alone = F.when(F.col(key).isNotNull(), F.coalesce("component", F.col(key)))
    return found.select(key, F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce("count", F.lit(0)).alias("links_verified"))


def keep_one(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents of a group beyond its smallest id; of repeated rows of that id one stays. Rows
    with a null id stay."""
    found = written(spark, join(spark, docs, key, text, count=False), "groups")
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = docs.join(gone, key, "left_anti").select(*docs.columns)
    again = written(spark, found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return kept.join(again, key, "left_anti").select(*docs.columns).unionByName(once)
