"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so no merge crosses the start of a run of
spaces. A text is therefore cut into marked chunks (a run of spaces and the characters up to the next space); each
distinct chunk is segmented once and its ids are joined back at every position of the chunk.

The table of frequent chunks is counted over all documents, ordered by count and cut at ``TABLE_ROWS`` entries, so what
is broadcast has a fixed bound. The rare rest would cost a shuffle of every position of every text to look up (more
than the input itself); a task segments each of those once and remembers it, in a memo of bounded size.

Defined cases: a null text is the empty text (begin and end id alone); texts may hold the marker U+2581 itself, which
the model reads as a space; repeated rows each get their row; other columns are ignored. A text without spaces is one
chunk. Raises ValueError for a model whose pieces cross markers or that rewrites spaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

TABLE_ROWS = 1 << 17
MEMO_ROWS = 1 << 16
_RUN = re.compile(" +[^ ]*")


def _model(blob: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=blob)


def check_model(sp: sentencepiece.SentencePieceProcessor) -> None:
    crosses = any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    if crosses or sp.encode("a  b") != sp.encode("a") + sp.encode(" b") or sp.encode("a") != sp.encode("a ")[:-1]:
        raise ValueError("the model's pieces cross whitespace markers, or it rewrites spaces: chunks can't be cut")


def chunks(text: str) -> list[str]:
    """The marked chunks of a text; each starts with at least one space, the first with the model's own."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _RUN.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def segment(sp: sentencepiece.SentencePieceProcessor, chunk: str) -> bytes:
    """Ids of one chunk, packed as little-endian unsigned 32-bit integers."""
    ids = [sp.piece_to_id("▁")] if chunk == " " else sp.encode(chunk[1:])
    return np.asarray(ids, "<u4").tobytes()


class _Memo(dict):
    def __init__(self, table: dict, sp) -> None:
        super().__init__()
        self.table, self.sp = table, sp

    def __missing__(self, chunk: str) -> bytes:
        ids = self.table.get(chunk)
        if ids is None:
            ids = segment(self.sp, chunk)
        if len(self) >= MEMO_ROWS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


def chunk_table(spark: SparkSession, docs: DataFrame, blob: bytes, text: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """``(chunk, n, ids)`` of the most frequent distinct chunks of all texts, ties to the smaller chunk."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:  # what is seen once in a whole partition saves nothing
            kept = [(c, n) for c, n in seen.items() if n > 1 and len(c) <= 64]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["chunk", "n"])

        for b in batches:
            for t in b[text].to_pylist():
                seen.update(chunks(t or ""))
                if len(seen) > MEMO_ROWS * 4:
                    yield out()
                    seen.clear()
        yield out()

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(blob)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["chunk"], b["n"], pa.array([segment(sp, c) for c in b["chunk"].to_pylist()], pa.binary())], ["chunk", "n", "ids"])

    counts = docs.select(text).mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "chunk").limit(rows).mapInArrow(segmented, "chunk string, n long, ids binary")


def encode(spark: SparkSession, docs: DataFrame, model: str, keys: Sequence[str], text: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """``keys`` plus ``ids`` (binary, little-endian unsigned 32-bit) of every text; see ``as_array`` for an array."""
    small_batches(spark)
    with open(model, "rb") as f:  # on the driver; tasks get the bytes
        blob = f.read()
    check_model(sp := _model(blob))
    first, last = (np.asarray([i] * on, "<u4").tobytes() for i, on in ((sp.bos_id(), begin), (sp.eos_id(), end)))
    table = {r["chunk"]: bytes(r["ids"]) for r in chunk_table(spark, docs, blob, text).toLocalIterator()}
    shared, keys = spark.sparkContext.broadcast((blob, table)), list(keys)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, frequent = shared.value
        memo = _Memo(frequent, _model(proto))
        for b in batches:
            ids = [first + b"".join(map(memo.__getitem__, chunks(t or ""))) + last for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(ids, pa.binary())], [*keys, "ids"])

    picked = docs.select(*keys, text) if text not in keys else docs.select(*keys)
    return picked.mapInArrow(encoded, docs.select(*keys).schema.add("ids", "binary"))


def decode(spark: SparkSession, encoded: DataFrame, model: str, keys: Sequence[str], ids: str = "ids") -> DataFrame:
    """``keys`` plus ``decoded``, the text that the library gives for packed ids (null ids: the empty text)."""
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    keys = list(keys)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(shared.value)
        for b in batches:
            texts = [sp.decode(np.frombuffer(x or b"", "<u4").tolist()) if x else "" for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(texts, pa.string())], [*keys, "decoded"])

    return encoded.select(*dict.fromkeys([*keys, ids])).mapInArrow(decoded, encoded.select(*keys).schema.add("decoded", "string"))


def as_array(ids):
    """Packed ids as array<bigint>, by SQL functions alone."""
    h = F.hex(ids)
    n = (F.length(h) / 8).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.concat(*[F.substring(h, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long"))
