"""The BM25 index of a changing corpus: segments with tombstones, tiered merges, statistics kept by signed deltas.

A batch of rules adds one segment at most: the postings of rules that are new or whose text or status changed, a row for each of
these rules (a retired one has no postings: its row hides those of older segments), and the signed changes of document
frequencies. The number of live rules and the sum of their lengths are in the manifest and change by what the batch adds and
takes. When a level holds ``FAN`` segments they are merged into one of the next level, hidden postings left out, so the number
of segments grows with the logarithm of the batches. A manifest, put in place by a rename, is what commits a batch; a batch
committed before changes nothing. Merged segments are removed one commit later, so a reader has that long.

Defined cases: rules without text and inactive rules are not in the index; an unchanged rule is passed over; a batch holds a
rule once; rules with a null id are left out.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index as ix
from ..operators import retrieval as rt
from ..operators import rules as rl

#: Segments of a level that are merged into one.
FAN = 4
EMPTY = {"batch": -1, "segments": [], "docs": 0, "length": 0, "old": []}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, out: str) -> dict:
    """The last committed state."""
    fs, where = _fs(spark, f"{out}/manifests")
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(where)) if n[:1].isdigit()) if fs.exists(where) else []
    return json.loads(spark.read.text(f"{out}/manifests/{names[-1]}", wholetext=True).first()[0]) if names else dict(EMPTY)


def _commit(spark: SparkSession, out: str, state: dict) -> None:
    name = f"{state['batch']:012d}"
    fs, part = _fs(spark, f"{out}/manifests/_{name}")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if not fs.rename(part, _fs(spark, f"{out}/manifests/{name}")[1]):
        raise OSError(f"the manifest of batch {state['batch']} could not be put in place")


def _table(spark: SparkSession, out: str, segments: list[dict], name: str, kind: str) -> DataFrame:
    paths = [f"{out}/{s['name']}/{name}" for s in segments]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def _kinds(id_type: str) -> dict[str, str]:
    return {"postings": f"term string, rule_id {id_type}, dl int, tf long, batch long", "rules": f"rule_id {id_type}, said long, dl int, live boolean, batch long", "terms": "term string, df long"}


def _newest(rows: DataFrame) -> DataFrame:
    """The last row of every rule."""
    last = F.max_by(F.struct("said", "dl", "live", "batch"), "batch")
    return rows.groupBy("rule_id").agg(last.alias("x")).select("rule_id", "x.*")


def _write(spark: SparkSession, out: str, name: str, tables: dict[str, DataFrame]) -> None:
    for k, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/{k}")


def _merged(spark: SparkSession, out: str, segments: list[dict], batch: int, kinds: dict[str, str]) -> tuple[list[dict], list[str]]:
    """Segments after all merges that are due, and the names of those that merges replaced."""
    gone = []
    while True:
        levels = {}
        for s in segments:
            levels.setdefault(s["level"], []).append(s)
        full = next((k for k in sorted(levels) if len(levels[k]) >= FAN), None)
        if full is None:
            return segments, gone
        some = levels[full]
        name = f"segment-{batch}-level-{full + 1}"
        read = lambda t, of: _table(spark, out, of, t, kinds[t])
        now = _newest(read("rules", segments)).select("rule_id", "batch")
        postings = read("postings", some).join(now, ["rule_id", "batch"], "left_semi").select("term", "rule_id", "dl", "tf", "batch")
        terms = read("terms", some).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        _write(spark, out, name, {"postings": postings, "rules": _newest(read("rules", some)), "terms": terms})
        gone += [s["name"] for s in some]
        segments = [s for s in segments if s["level"] != full] + [{"name": name, "level": full + 1}]


def refresh(rules: DataFrame, out: str, n: int) -> None:
    """Batch ``n`` (numbers go up) of new and changed rules."""
    spark, state = rules.sparkSession, manifest(rules.sparkSession, out)
    if state["batch"] >= n:
        return
    kinds = _kinds(dict(rules.dtypes)["rule_id"])
    held = lambda t: _table(spark, out, state["segments"], t, kinds[t])
    rules, name = rules.where("rule_id is not null"), f"segment-{n}"
    seen = rules.select("rule_id", F.xxhash64(tx.blank(rl.display_text()), "status").alias("said"))
    if state["segments"]:
        before = _newest(held("rules")).select(F.col("rule_id").alias("id"), F.col("said").alias("old"), F.col("dl").alias("old_dl"), F.col("live").alias("was"), F.col("batch").alias("old_batch"))
        seen = seen.join(before, F.col("rule_id") == F.col("id"), "left").where(F.col("old").isNull() | (F.col("old") != F.col("said")))
    else:  # nothing to compare with: no rule moves
        seen = seen.select("*", F.lit(None).cast("int").alias("old_dl"), F.lit(None).cast("boolean").alias("was"), F.lit(None).cast("long").alias("old_batch"))
    _write(spark, out, name, {"seen": seen.select("rule_id", "said", "old_dl", "was", "old_batch")})  # texts are compared once
    changed = spark.read.parquet(f"{out}/{name}/seen")
    texts = rules.join(changed.select("rule_id"), "rule_id", "left_semi") if state["segments"] else rules
    rows = rt.active_texts(texts).withColumn("t", tx.tokens(F.col("text")))
    flat = ix.counted(rows, "rule_id", "t", outer=True).withColumn("batch", F.lit(n).cast("long"))
    _write(spark, out, name, {"postings": flat})  # a live rule without words has one row without a term
    new = _table(spark, out, [{"name": name}], "postings", kinds["postings"])
    sizes = new.groupBy(F.col("rule_id").alias("r")).agg(F.max("dl").alias("dl"))
    told = changed.join(sizes, F.col("rule_id") == F.col("r"), "left")
    _write(spark, out, name, {"changes": told.select("rule_id", "said", F.coalesce("dl", F.lit(0)).alias("dl"), F.col("dl").isNotNull().alias("live"), F.lit(n).cast("long").alias("batch"), "old_dl", "was", "old_batch")})
    changes = spark.read.parquet(f"{out}/{name}/changes")
    taken = held("postings").join(changes.where("was").select("rule_id", F.col("old_batch").alias("batch")), ["rule_id", "batch"], "left_semi")
    terms = new.select("term", F.lit(1).alias("d")).unionByName(taken.select("term", F.lit(-1).alias("d"))).where("term is not null")
    _write(spark, out, name, {"rules": changes.select("rule_id", "said", "dl", "live", "batch"), "terms": terms.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0")})
    one = changes.agg(F.count("*"), F.sum(F.col("live").cast("int") - F.coalesce(F.col("was"), F.lit(False)).cast("int")), F.sum(F.col("dl") - F.when(F.col("was"), F.col("old_dl")).otherwise(0))).first()
    segments = state["segments"] + ([{"name": name, "level": 0}] if one[0] else [])
    segments, gone = _merged(spark, out, segments, n, kinds)
    _commit(spark, out, {"batch": n, "segments": segments, "docs": state["docs"] + (one[1] or 0), "length": state["length"] + (one[2] or 0), "old": gone + ([] if one[0] else [name])})
    for old in state["old"]:
        fs, where = _fs(spark, f"{out}/{old}")
        fs.delete(where, True)


def postings_now(spark: SparkSession, out: str, id_type: str = "long") -> DataFrame:
    """(term, rule_id, dl, tf) in force."""
    state, kinds = manifest(spark, out), _kinds(id_type)
    now = _newest(_table(spark, out, state["segments"], "rules", kinds["rules"])).select("rule_id", "batch")
    rows = _table(spark, out, state["segments"], "postings", kinds["postings"]).join(now, ["rule_id", "batch"], "left_semi")
    return rows.where("term is not null").select("term", "rule_id", "dl", "tf")


def statistics(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Document frequencies, (term, df), and the one row (n, avgdl), from the deltas alone: no posting is read."""
    state = manifest(spark, out)
    terms = _table(spark, out, state["segments"], "terms", _kinds("long")["terms"]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return terms, spark.createDataFrame([(state["docs"], state["length"] / max(1, state["docs"]))], "n long, avgdl double")


def searchable(spark: SparkSession, out: str, id_type: str = "long") -> ix.Index:
    """What is in force as an index for ``index.search``: blocks by a hash of the rule."""
    terms, stats = statistics(spark, out)
    blocks = max(1, manifest(spark, out)["docs"] // ix.BLOCK_ROWS)

    def block(t: pa.Table) -> pa.Table:
        keys, terms = (t[c].combine_chunks().dictionary_encode() for c in ("rule_id", "term"))
        at = keys.indices.to_numpy()
        sizes = np.zeros(len(keys.dictionary), np.int32)
        sizes[at] = t["dl"].to_numpy()
        return pa.Table.from_batches([ix.packed(keys.dictionary, pa.nulls(len(sizes), pa.string()), sizes, at, terms.indices.to_numpy(), t["tf"].to_numpy(), terms.dictionary, len(sizes))])

    rows = postings_now(spark, out, id_type).groupBy(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)).alias("block")).applyInArrow(block, ix.block_schema(id_type))
    return ix.Index("rule_id", ix.kept(rows, "blocks", ix.GROUP_BLOCKS), ix.kept(ix.inverse(terms, stats), "idf"), stats)
