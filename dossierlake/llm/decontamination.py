"""Benchmark decontamination by greedy string tiling.

Seeds of ``least`` shared words name the benchmark items that a document may hold. For each such pair, the longest common
run of unmarked words is found by running Karp-Rabin hashes, verified and marked in both, again and again until no run
of ``least`` words is left; the tiles never overlap. The share of the item's words under tiles decides, so passages in
another order are caught too.

Only items whose shared seeds could cover enough of their words are tiled; the bound is exact, so nothing is lost, and a
seed that all items share makes none of them a candidate by itself.

The benchmark is dealt into blocks of bounded size (``BLOCK_WORDS``). One block is broadcast, and documents never shuffle. Of
several, each is broadcast, used and given up before the next; every pass reads the documents and writes its findings by
row, so a larger benchmark takes more passes, not more memory.

Defined cases: words are runs of letters, digits and underscores in lower case; an item of fewer than ``least`` words
must occur as a whole; items and documents that are null or without words match nothing; repeated items and repeated
documents each count, a row of the result for each; nulls in other columns are passed on; a very long text is read whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

LEAST = 5
SHARE = 0.5
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LEAK = "array<struct<item_id:bigint,share:double,tiles:array<struct<item_start:int,doc_start:int,words:int>>>>"
_TILE = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("tiles", pa.list_(_TILE))]))


class _Numbers(dict):
    """64-bit numbers of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = found
        return found


def numbers(text: str | None, known: _Numbers) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` numbers."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(x) - size + 1, np.uint64)
    for i in range(size):
        h = h * _BASE + x[i : len(x) - size + 1 + i]
    return h


class _Running:
    """Prefix hashes of a sequence: the hash of any window in one step."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.free = x, np.zeros(len(x) + 1, np.int64)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), _BASE)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
        self.sums, self.back = np.concatenate([[np.uint64(0)], np.cumsum(x * powers[:-1])]), inverse
        self.taken = np.zeros(len(x), bool)

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked windows of a size, and their hashes."""
        n = len(self.x) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.taken)])
        at = np.flatnonzero(marks[size:] == marks[:n])
        return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, words), longest first; of equal ones the earliest in the item, then the document."""
    a, b, tiles = _Running(item), _Running(doc), []

    def common(size: int) -> bool:
        return bool(np.isin(a.hashes(size)[1], b.hashes(size)[1]).any())

    most = min(len(item), len(doc))
    while most >= least and common(least):
        low, high = least, most  # a shared window holds shared windows of every smaller size
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        at, h = b.hashes(low)
        places: dict[int, list[int]] = {}
        mine = a.hashes(low)
        for i in np.flatnonzero(np.isin(h, mine[1]))[::-1]:
            places.setdefault(int(h[i]), []).append(int(at[i]))  # the earliest is last
        for i, x in zip(mine[0].tolist(), mine[1].tolist(), strict=True):
            free = places.get(x)
            if not free or a.taken[i : i + low].any():
                continue
            other = []  # places of another run with this hash
            while free:
                j = free.pop()  # a place once taken stays taken, so each is looked at once
                if b.taken[j : j + low].any():
                    continue
                if np.array_equal(item[i : i + low], doc[j : j + low]):
                    a.taken[i : i + low] = b.taken[j : j + low] = True
                    tiles.append((i, j, low))
                    break
                other.append(j)
            free.extend(reversed(other))
        most = low - 1 if low > least else 0
    return tiles


class _Block:
    """Seeds of a block of items: for every seed hash, the items that hold it, once for each place."""

    def __init__(self, items: Sequence[tuple[int, str]], least: int, known: _Numbers) -> None:
        self.items = [(i, x) for i, t in items if len(x := numbers(t, known))]
        self.sizes = np.array([len(x) for _, x in self.items], np.int64)
        self.seeds = []
        for size in sorted({min(least, len(x)) for _, x in self.items}):
            held = [k for k, (_, x) in enumerate(self.items) if min(least, len(x)) == size]
            h = np.concatenate([windows(self.items[k][1], size) for k in held])
            item = np.repeat(held, [len(self.items[k][1]) - size + 1 for k in held])
            order = np.argsort(h, kind="stable")
            self.seeds.append((size, h[order], item[order]))

    def leaks(self, doc: np.ndarray, least: int, share: float) -> list[dict]:
        found: list[int] = []
        for size, hashes, item in self.seeds:
            h = windows(doc, size)
            low = np.searchsorted(hashes, h)
            low[low == len(hashes)] = 0
            h = np.unique(h[hashes[low] == h])
            if not len(h):
                continue
            low = np.searchsorted(hashes, h)
            many = np.searchsorted(hashes, h, "right") - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            places = np.bincount(item[at], minlength=len(self.items))
            # tiles cover no more words than the places of shared seeds do
            found += np.flatnonzero((places > 0) & (places * size >= share * self.sizes)).tolist()
        out = []
        for k in sorted(found):
            i, x = self.items[k]
            tiles = tile(x, doc, min(least, len(x)))
            covered = sum(t[2] for t in tiles) / len(x)
            if covered >= share:
                out.append({"item_id": i, "share": covered, "tiles": [{"item_start": a, "doc_start": b, "words": n} for a, b, n in tiles]})
        return out


def mark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keys: Sequence[str], text: str = "text", least: int = LEAST, share: float = SHARE, out: str = "leaks") -> DataFrame:
    """``keys`` plus ``out``: the items that each document leaks, with their covered share and tiles."""
    small_batches(spark)
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-(size["chars"] or 0) // (BLOCK_WORDS * 4)))
    keys = list(keys)

    def pass_(rows: DataFrame, block: int, names: list[str], every: bool) -> tuple[DataFrame, Broadcast]:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Numbers()
            seeds = _Block(shared.value, least, known)
            for b in batches:
                found = [seeds.leaks(numbers(t, known), least, share) for t in b.column(len(names)).to_pylist()]
                columns = [*(b.column(i) for i in range(len(names))), pa.array(found, _LEAK)]
                some = pa.RecordBatch.from_arrays(columns, [*(f"c{i}" for i in range(len(names))), "leaks"])
                yield some if every else some.filter(pa.array([bool(f) for f in found], pa.bool_()))

        # columns go by place, so no name of the caller's can clash
        wide = rows.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], F.col(text).alias("t"))
        schema = wide.drop("t").schema.add("leaks", T._parse_datatype_string(LEAK))
        return wide.mapInArrow(run, schema), shared

    if blocks == 1:
        return pass_(docs, 0, keys, True)[0].toDF(*keys, out)
    row = f"row{uuid.uuid4().hex}"
    numbered = written(spark, docs.select(*dict.fromkeys([*keys, text])).withColumn(row, F.monotonically_increasing_id()), "documents")
    found = None
    for block in range(blocks):
        some, shared = pass_(numbered, block, [row], False)
        some = written(spark, some, "leaks")
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    all_ = found.groupBy("c0").agg(F.flatten(F.collect_list("leaks")).alias("l")).withColumnRenamed("c0", row)
    kept = numbered.select(*keys, row).join(all_, row, "left")
    return kept.select(*keys, F.coalesce("l", F.array().cast(LEAK)).alias(out))
