"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, their stems (its first four and first five letters), word pairs and pairs with
one word between, hashed to ``BITS`` bits. Training takes a bounded sample of labelled rows (``max_rows``, the smallest
hashes of the ids, so the same rows at any partitioning), and runs the per-coordinate update over it, in ``shards`` that
meet in an average if asked for. L1 leaves a few weights, and those are broadcast. Scoring reads every whole text once.

Defined cases: a null or empty text has no features and scores by the bias alone; with no labelled rows at all every
score is that of a fixed bias, about 0.06; labels that are null or have a null id are left out, repeated labels of an id count as
their maximum; repeated documents each get their row; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

BITS = 22
MAX_ROWS = 12_000
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Rates:
    """alpha and beta: per-coordinate learning rate; l1, l2: penalties; passes over each shard."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    passes: int = 3


class _Hashes(dict):
    """crc32 of a word and of its two stems, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        found = tuple(zlib.crc32(w.encode()) + 1 for w in (word, word[:4], word[:5]))
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = found
        return found


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Ids of a text's features, in order of the text and with repeats."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    both = np.array([hashes[w] for w in words], np.uint64)
    h = both[:, 0]
    parts = [h * _A, both[:, 1] * _B, both[:, 2] * _C, (h[:-1] * _B + h[1:]) * _A, (h[:-2] * _C + h[2:]) * _B]
    return (np.concatenate(parts) >> _SHIFT).astype(np.int64)


def _ftrl(rows: list[np.ndarray], labels: np.ndarray, rates: Rates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with their z and n sums; id ``1 << BITS`` is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rates.passes):
        for ids, y in zip(rows, labels, strict=True):
            w = _weights(z[ids], n[ids], rates)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / rates.alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    used = np.flatnonzero(n)
    return used, z[used], n[used]


def _weights(z: np.ndarray, n: np.ndarray, rates: Rates) -> np.ndarray:
    return np.where(np.abs(z) <= rates.l1, 0.0, -(z - np.sign(z) * rates.l1) / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", eligible: Column | None = None, max_rows: int = MAX_ROWS, rates: Rates = Rates(), shards: int = 1) -> DataFrame:
    """``(id, w)``: the weights that L1 leaves, the bias at id ``1 << BITS``. ``eligible``: condition on ``key`` and the
    label for a row to be learnt from."""
    small_batches(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if eligible is not None:
        known = known.where(eligible)
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    sample = known.orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(key, text).join(F.broadcast(sample), key).select(F.xxhash64(key).alias("h"), text, "__y")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            ids = [np.append(np.unique(features(t, hashes)), 1 << BITS).astype("<u4").tobytes() for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["h"], pa.array(ids, pa.binary()), b["__y"].cast(pa.int32())], ["h", "ids", "y"])

    def learnt(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        ids = [np.frombuffer(x, "<u4") for x in rows["ids"]]  # views; the last of each is the bias
        used, z, n = _ftrl(ids, rows["y"].to_numpy(), rates)
        return pd.DataFrame({"id": used, "z": z, "n": n})

    parts = rows.mapInArrow(featured, "h long, ids binary, y int").withColumn("shard", F.pmod("h", F.lit(shards)))
    sums = parts.groupBy("shard").applyInPandas(lambda g: learnt(g), "id long, z double, n double")
    # a shard that never saw a coordinate would have left it at zero
    mean = sums.groupBy("id").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n"))
    size = F.abs("z") - rates.l1
    w = -F.signum("z") * size / ((rates.beta + F.sqrt("n")) / rates.alpha + rates.l2)
    return mean.where(size > 0).select("id", w.alias("w"))


def score(spark: SparkSession, docs: DataFrame, weights: DataFrame, keys: Sequence[str], text: str = "text", out: str = "score") -> DataFrame:
    """``keys`` plus the score, 0 to 1, of every whole text."""
    small_batches(spark)
    found = weights.toPandas()  # at most one row per hash value, as L1 leaves far fewer
    bias = float(found.loc[found["id"] == 1 << BITS, "w"].sum()) if len(found) else -2.7
    kept = found[found["id"] < 1 << BITS].sort_values("id")
    shared, keys = spark.sparkContext.broadcast((kept["id"].to_numpy(np.int64), kept["w"].to_numpy(np.float64), bias)), list(keys)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, w, bias = shared.value
        known = np.zeros(1 << BITS, bool)
        known[ids] = True
        hashes = _Hashes()
        for b in batches:
            out_ = []
            for t in b[text].to_pylist():
                f = features(t, hashes)
                hit = np.unique(f[known[f]])
                out_.append(1 / (1 + np.exp(-np.clip(w[np.searchsorted(ids, hit)].sum() + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(out_, pa.float64())], [*keys, out])

    return docs.select(*dict.fromkeys([*keys, text])).mapInArrow(scored, docs.select(*keys).schema.add(out, "double"))


def held_out(key: Column) -> Column:
    """The fold that labels are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return written(spark, train(spark, docs, labels, eligible=~held_out(F.col("doc_id"))), "weights")
