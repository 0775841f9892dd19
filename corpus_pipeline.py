"""The corpus pipeline: STAGES applied one after another to the documents table.

Every stage takes what its predecessor kept and returns the columns of documents; the last returns the token ids as
digests. Null and repeated rows follow the operators' own rules; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import common, decontamination, jaccard, queries, secrets, sentencepieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The score rides along with the row, so nothing is joined."""
    weights = toxicity.fit(spark, docs, queries.table(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs, weights, docs.columns, out="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return jaccard.keep_one(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    marked = decontamination.mark(spark, docs, queries.table(spark, sf_dir, "benchmark"), docs.columns, out="__leaks")
    return marked.where(F.size("__leaks") == 0).drop("__leaks")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    spans = secrets.scan(spark, docs, []).where("size(spans) > 0").dropDuplicates(["blob"])
    whole = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    hit = whole.join(spans, "blob", "left").select(*docs.columns, "spans")
    masked = secrets.redact(hit)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and their decoding, as digests."""
    model = queries.piece_model()
    coded = sentencepieces.encode(spark, docs, model, ["doc_id"])
    both = sentencepieces.decode(spark, coded, model, ["doc_id", "ids"])
    return queries.piece_digests(both)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the learnt scores nor the greedy tiles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
