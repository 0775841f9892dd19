"""Token counts as delta-maintained rollups.

A batch of changes (``op``: insert, delete or revise; ``doc_id``, source, lang, text) is tokenized once; an insert adds its
count, a delete takes the document's live counts off, under whatever tokenizer versions they stand, a revision does both.
The store keeps, by batch, the signed deltas of the totals and the totals that they lead to, a segment of the new entries
of documents, dealt into parts of about ``PART_ROWS`` rows by a hash of the id, and the ids that the batch deleted or revised:
these hide entries of earlier batches. A commit reads the parts that may hold its deleted and revised documents, and rewrites
nothing; ``compact`` writes the entries in force as one segment and removes what no manifest in force needs.

A commit is one small manifest, made last by a rename: it names the batch, all segments and the totals in force. Its file
name holds a digest of the batch's name, which may be any text. A batch that broke off leaves no manifest and is written over
when it runs again; a committed one is left alone, so a replay changes nothing. One writer at a time; who reads entries while
a compaction runs has to begin again.

Defined cases: a null text counts as empty (0 tokens, 1 document); null source or language is a group of its own; a
delete or revision of an unknown document takes nothing off; of several changes to one document in a batch the one with
the largest ``seq`` counts if that column is there (of equal ``seq``, one chosen by a hash of the change), else they are
all inserts of repeated rows and each counts; changes with a null doc_id can only be inserted; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, small_batches

PART_ROWS = 1_000_000
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
ENTRY = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, n_bytes bigint"
TOTAL = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def counted(spark: SparkSession, changes: DataFrame, ranks: str, pattern: str, version: str) -> DataFrame:
    """``changes`` with tokenizer, n_tokens and n_bytes in place of the text; ``ranks`` is a tiktoken rank file."""
    small_batches(spark)
    with open(ranks, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keep = [c for c in changes.columns if c != "text"]
    schema = changes.select(*keep).schema
    for name, kind in (("tokenizer", T.StringType()), ("n_tokens", T.LongType()), ("n_bytes", T.LongType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        pairs = (line.split() for line in shared.value.splitlines() if line)
        enc = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            sizes = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array([version] * len(texts), pa.string()), pa.array(sizes, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], [*keep, "tokenizer", "n_tokens", "n_bytes"])

    return changes.select(*keep, "text").mapInArrow(run, schema)


# --- manifests ---


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, store: str) -> list[str]:
    """Names of what stands in a folder, in order; what a broken write left starts with an underscore."""
    fs, where = _folder(spark, store)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(where)) if n[:1] not in "_.") if fs.exists(where) else []


def _digest(batch: str) -> str:
    return hashlib.sha256(batch.encode()).hexdigest()


def _manifest(spark: SparkSession, store: str) -> dict:
    names = _names(spark, f"{store}/manifests")
    if not names:
        return {"n": 0, "batch": None, "segments": [], "gone": [], "totals": None}
    return json.loads(spark.read.text(f"{store}/manifests/{names[-1]}", wholetext=True).first()[0])


def _put(spark: SparkSession, store: str, name: str, manifest: dict) -> None:
    name = f"{manifest['n']:012d}-{name}"
    fs, part = _folder(spark, f"{store}/manifests/_{name}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(part, _folder(spark, f"{store}/manifests/{name}")[1]):
        raise OSError(f"the manifest of batch {manifest['batch']} could not be put in place")


# --- segments ---


def _part(of: int) -> F.Column:
    """Rows without an id can never be deleted: they go by the task that wrote them."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(of)), F.spark_partition_id() % of).cast("int")


def _parts_for(rows: int) -> int:
    return 1 << max(0, (-(-rows // PART_ROWS) - 1).bit_length())


def _write(rows: DataFrame, store: str, name: str, number: int, of: int) -> dict:
    """A segment of ``of`` parts: its record for the manifest."""
    path = f"{store}/live/{name}"
    rows.withColumn("part", _part(of)).repartition(of, "part").write.mode("overwrite").partitionBy("part").parquet(path)
    return {"name": name, "n": number, "of": of, "parts": [int(p[5:]) for p in _names(rows.sparkSession, path) if p.startswith("part=")]}


def _entries(spark: SparkSession, store: str, manifest: dict, wanted: dict[int, set[int]] | None = None) -> DataFrame:
    """Entries in force of all segments, or of the ``wanted`` parts: {parts of a segment: those to read}."""
    rows = spark.createDataFrame([], f"{ENTRY}, n int")
    for s in manifest["segments"]:
        paths = [f"{store}/live/{s['name']}/part={p}" for p in s["parts"] if wanted is None or p in wanted[s["of"]]]
        if paths:
            rows = rows.unionByName(spark.read.schema(ENTRY).parquet(*paths).withColumn("n", F.lit(s["n"])))
    for g in manifest["gone"]:
        ids = spark.read.schema("gone_id bigint").parquet(f"{store}/gone/{g['name']}")
        rows = rows.join(ids, (F.col("doc_id") == F.col("gone_id")) & (F.col("n") < g["n"]), "left_anti")
    return rows.drop("n")


# --- commits ---


def _rolled(rows: DataFrame, sign: int) -> DataFrame:
    return rows.groupBy(*KEYS).agg((F.count("*") * sign).alias("n_docs"), *[(F.sum(c) * sign).alias(c) for c in SUMS[1:]])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame, ranks: str, pattern: str, version: str) -> bool:
    """Add one batch of changes; False, and nothing done, if it was committed before."""
    name = _digest(batch)
    if any(n.endswith(name) for n in _names(spark, f"{store}/manifests")):
        return False
    before = _manifest(spark, store)
    number = before["n"] + 1
    picked = changes.select(F.lit("insert").alias("op") if "op" not in changes.columns else "op", "doc_id", "source", "lang", "text", *(["seq"] if "seq" in changes.columns else []))
    if "seq" in changes.columns:  # the last change of each document, found without its text
        named = picked.withColumn("h", F.xxhash64("op", "source", "lang", "text"))
        last = named.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("seq", "h")).alias("x")).select("doc_id", "x.*")
        same = [named[c].eqNullSafe(last[c]) for c in ("doc_id", "seq", "h")]
        one = named.join(last, same[0] & same[1] & same[2], "left_semi").dropDuplicates(["doc_id"])
        picked = one.unionByName(named.where("doc_id is null")).drop("seq", "h")
    put = picked.where("op <> 'delete'")
    taken = picked.where("op <> 'insert' and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    # the new entries are written once, as tokenizing is the work; the rest are sums
    segment = _write(counted(spark, put, ranks, pattern, version).drop("op"), store, name, number, _parts_for(put.count()))
    taken.write.mode("overwrite").parquet(f"{store}/gone/{name}")
    gone = spark.read.schema("gone_id bigint").parquet(f"{store}/gone/{name}")
    sizes = sorted({s["of"] for s in before["segments"]})
    parts = [F.pmod(F.xxhash64("gone_id"), F.lit(of)).cast("int") for of in sizes]
    wanted = {of: {r[0] for r in gone.select(p).distinct().collect()} for of, p in zip(sizes, parts)}  # numbers of parts
    off = _entries(spark, store, before, wanted).join(gone, F.col("doc_id") == F.col("gone_id"), "left_semi")
    new = _entries(spark, store, {"segments": [segment], "gone": []})
    _rolled(new, 1).unionByName(_rolled(off, -1)).write.mode("overwrite").parquet(f"{store}/deltas/{name}")
    delta = spark.read.schema(TOTAL).parquet(f"{store}/deltas/{name}")
    base = spark.read.schema(TOTAL).parquet(f"{store}/totals/{before['totals']}") if before["totals"] else spark.createDataFrame([], TOTAL)
    _summed(base.unionByName(delta)).coalesce(1).write.mode("overwrite").parquet(f"{store}/totals/{name}")
    hides = [{"name": name, "n": number}] if any(wanted.values()) else []
    _put(spark, store, name, {"n": number, "batch": batch, "segments": before["segments"] + ([segment] if segment["parts"] else []), "gone": before["gone"] + hides, "totals": name})
    return True


def compact(spark: SparkSession, store: str) -> None:
    """Write the entries in force as one segment, parts sized anew, and remove segments and deleted ids that it replaces."""
    before = _manifest(spark, store)
    rows, number = _entries(spark, store, before), before["n"] + 1
    name = f"compact-{number}"
    segment = _write(rows, store, name, number, _parts_for(rows.count()))
    _put(spark, store, name, before | {"n": number, "batch": None, "segments": [segment] if segment["parts"] else [], "gone": []})
    for folder, keep in (("live", {name}), ("gone", set())):
        for old in set(_names(spark, f"{store}/{folder}")) - keep:
            remove(spark, f"{store}/{folder}/{old}")


def live(spark: SparkSession, store: str) -> DataFrame:
    """The entries in force."""
    return _entries(spark, store, _manifest(spark, store))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """n_docs, n_tokens and n_bytes by source, lang and tokenizer over all committed batches; empty groups go."""
    at = _manifest(spark, store)["totals"]
    rows = spark.read.schema(TOTAL).parquet(f"{store}/totals/{at}") if at else spark.createDataFrame([], TOTAL)
    return rows.where("n_docs <> 0 or n_tokens <> 0")
