"""Secret scans over an incremental blob ledger.

Every version of every file is content-addressed (SHA-256 of its text). A ledger remembers which (blob, rule version)
pairs have been scanned and what was found; a scan reads only the pairs the ledger lacks and joins the findings back to
all versions that hold the blob.

Defined cases: a null text is the empty text; an empty text has no findings; repeated rows each get their row; null ids
are kept; other columns of the input, whatever their names, are ignored. A very long text is scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A match counts if its ``group`` has ``least`` characters; ``hints`` (lower case, any of them
    must occur in the lower-cased text) spare the regex on texts that cannot match."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = 0
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base kinds first, in their listed order, then what this scanner adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.I | re.A, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----END ))*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 20, hints=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, hints=("eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, hints=("gh",)),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob string, rules array<string>, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(text: str, rules: Sequence[Rule]) -> list[dict]:
    """Spans of every rule in one text: leftmost non-overlapping per kind, code points, end exclusive; by start, then
    rule order."""
    low, out = text.lower(), []
    for order, r in enumerate(rules):
        if r.hints and not any(h in low for h in r.hints):
            continue
        for m in re.compile(r.pattern, r.flags).finditer(text):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), order, r.kind, m.end()))
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(out)]


def scan(spark: SparkSession, versions: DataFrame, keys: Sequence[str], text: str = "text", ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of every row of ``versions``: ``keys`` plus ``blob`` and ``spans`` (array of kind, start, end).

    ``ledger`` is a Parquet folder that earlier scans filled (None: a new one). New blobs, and known blobs under rules
    with a new version, are scanned and appended; pairs it holds are not read again. Texts shuffle once, one copy per
    task and blob, and only where unseen; ids and digests shuffle alone. A hot blob is one row per task before the
    shuffle and one ledger row after it, so its versions can be split by the skew join.
    """
    small_batches(spark)
    rules, known = tuple(rules), None
    keyed = versions.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("blob", F.sha2("__text", 256))
    if ledger is not None:
        found = spark.read.schema(LEDGER).parquet(ledger) if _exists(spark, ledger) else None
        known = found.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done")) if found is not None else None
    else:
        ledger = fresh_path(spark, "ledger")
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if known is None:
        texts = keyed.select("blob", "__text").dropDuplicates(["blob"]).withColumn("todo", wanted)
    else:
        unseen = keyed.select("blob").distinct().join(known, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))).where("size(todo) > 0").select("blob", "todo")
        texts = keyed.select("blob", "__text").join(unseen, "blob").dropDuplicates(["blob"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = {r.key: r for r in rules}
        for b in batches:
            spans = [find(t, [by_key[k] for k in todo]) for t, todo in zip(b["__text"].to_pylist(), b["todo"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["blob"], b["todo"].cast(pa.list_(pa.string())), pa.array(spans, _SPANS)], ["blob", "rules", "spans"])

    texts.mapInArrow(scanned, LEDGER).write.mode("append").parquet(ledger)
    live = spark.read.schema(LEDGER).parquet(ledger)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    if known is None:
        current = live.select("blob", "spans")
    else:  # spans of the current version of each rule only
        part = live.select("blob", F.explode(F.arrays_zip("rules")).alias("r"), "spans").select("blob", F.col("r.rules").alias("rule"), "spans")
        part = part.where(F.col("rule").isin([r.key for r in rules])).withColumn("spans", F.expr("filter(spans, s -> s.kind = substring_index(rule, '@', 1))"))
        current = part.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        current = current.select("blob", F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return keyed.select(*keys, "blob").join(current, "blob", "left").select(*keys, "blob", "spans")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def joined(spans, kinds: Sequence[str] | None = None):
    """``kind:start:end`` of an array of spans, comma-joined; of ``kinds`` only if given."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); expects a ``spans`` column, which goes.
    A null text stays null."""
    at = [f.name for f in docs.schema.fields if f.name != "spans"]
    schema = docs.select(*at).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b[text].to_pylist(), b["spans"].to_pylist(), strict=True):
                if t is not None and spans:
                    parts, pos = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= pos:
                            parts += [t[pos : s["start"]], mask]
                        pos = max(pos, s["end"])
                    t = "".join([*parts, t[pos:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b[n] for n in at], at)

    return docs.mapInArrow(cut, schema)
