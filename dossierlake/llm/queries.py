"""The registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, jaccard, licenses, mixing, secrets, sentencepieces, suffixes, token_counts, topk, toxicity, urls, variants
from .common import fresh_path

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs, model = table(spark, sf_dir, "documents"), piece_model()
    coded = sentencepieces.encode(spark, docs, model, ["doc_id"])
    return piece_digests(sentencepieces.decode(spark, coded, model, ["doc_id", "ids"]))


def piece_digests(both: DataFrame) -> DataFrame:
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct text through a new ledger."""
    found = secrets.scan(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.joined(F.col("spans"), secrets.BASE), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version: the documents committed as one batch, then replayed."""
    import public_tokenizers

    store, docs = fresh_path(spark, "token-store"), table(spark, sf_dir, "documents")
    for _ in range(2):  # the replay finds the batch committed and changes nothing
        token_counts.commit(spark, store, "documents", docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k@1")
    return token_counts.totals(spark, store)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the share of each item's words under tiles."""
    found = decontamination.mark(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    leak = found.select("doc_id", F.explode("leaks").alias("x"))
    return leak.select("doc_id", F.col("x.item_id").alias("item_id"), F.col("x.share").alias("share"), F.size("x.tiles").cast("long").alias("n_tiles"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by sentence rules."""
    found = licenses.recognise(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "license", F.array_join("licenses", ",").alias("licenses"), F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"))


ORACLES["op7_license_scan"] = licenses.ORACLE


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by inner product for every hundredth row."""
    return topk.search(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


ORACLES["op8_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(spark, docs, weights, ["doc_id"])
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: its rule's, else its aliases'."""
    return urls.judge(spark, table(spark, sf_dir, "pages"), ["page_id"])


ORACLES["op10_url_filter"] = urls.ORACLE


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard.join(spark, table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a 400-byte string repeated anywhere covers; has_passage is 1 where it shares a
    passage of more than 50 words with another document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("d"))
    shared = suffixes.passages(spark, docs).withColumn("has_passage", F.lit(1))
    counts = [(F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("runs").cast("long").alias("n_spans")]
    found = suffixes.dedup(spark, docs, ["doc_id", "d"]).select("d", "doc_id", "n_bytes", *counts, F.sha2("kept", 256).alias("kept_sha256"))
    return found.join(shared, "d", "left").drop("d").withColumn("has_passage", F.coalesce("has_passage", F.lit(0)))


@query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document gives to a mix of 150 % of all words, its source weighing 3, 1 or 2 in turn, two epochs at most."""
    return mixing.mix(spark, table(spark, sf_dir, "documents"), ["doc_id"])


ORACLES["op11_source_mixing"] = mixing.ORACLE


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds."""
    return centroids.cluster(spark, table(spark, sf_dir, "embeddings"))


ORACLES["op12_centroids"] = centroids.ORACLE


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words counted, their form and the root of its chain."""
    return variants.group(spark, table(spark, sf_dir, "documents"))
