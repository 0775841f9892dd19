"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Every source is to give words in proportion to its weight. A source stops at ``epochs`` times its own size; what it cannot
give is shared anew by weight among the others, until no target is above its cap. A source is then taken as many whole times
as its target holds its size, and the fraction left over is drawn by a seeded hash: documents in hash order give one more
repetition until the fraction is full, and the one at the border gives the part of its words that is still wanted.

The border of every source is found without sorting the source: sums over ever longer prefixes of the hash, each cut to
16^3 buckets a source and combined before the shuffle. Rounds of water-filling send two sums to the driver.

Defined cases: a null text has no words, a null source is a source of its own; a source without words has target 0; null and
negative weights count as 0, and if all sources with weight are at their caps, the rest of the share is not given out; rows of
equal hash (repeated rows: the hash is over key and text) share alike, each rounded down; null keys count as empty in the hash;
an empty table gives no rows; other columns are ignored, keys are carried by place and may not be named as a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import output_names, written

WORD = r"[^\x20\x09-\x0D]+"
SHARE, EPOCHS, SEED = 1.5, 2, "mix"
#: Hexadecimal digits of the hash that each search for the borders has settled at its end.
DIGITS = (3, 6, 9, 32)
RESULTS = ("size", "source_size", "target", "taken")


def numbered(spark: SparkSession, rows: DataFrame, by: Column, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``by``: by ranges, none of which holds all rows."""
    cut = rows.orderBy(by).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.col("__p").cast("long") * (1 << 33))
    cut = written(spark, cut, "places")
    before = cut.groupBy("__p").agg(F.count("*").alias("n")).select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__b"))
    return cut.join(before, "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def cycled(weights: Sequence[float] = (3, 1, 2)) -> Callable[[SparkSession, DataFrame], DataFrame]:
    """A rule for weights: sources in code-point order, null last, weigh ``weights`` in turn."""

    def weigh(spark: SparkSession, sources: DataFrame) -> DataFrame:
        turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int"))
        return numbered(spark, sources, F.col("source").asc_nulls_last(), "__n").withColumn("weight", turn).drop("__n")

    return weigh


def targets(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (source, size, weight) with their target. Caps only ever tighten, so each round keeps two sums."""
    weight, cap = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)), F.col("size").cast("double") * epochs
    wanted = share * (sources.agg(F.sum("size")).first()[0] or 0)
    capped, seen = F.lit(False), None
    while True:
        full, left = sources.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(weight))).first()
        free, left = wanted - (full or 0.0), left or 0.0
        if (free, left) == seen:
            break
        seen = free, left
        capped = (weight * free > cap * left) & (weight > 0)
    return sources.withColumn("target", F.when(capped, cap).otherwise(weight * free / left if left > 0 else F.lit(0.0)))


def measured(docs: DataFrame, keys: Sequence[str], text: str, source: str, seed: str) -> DataFrame:
    """k0, k1, ..., source, size and hash of every row; the keys by place."""
    whole = F.concat(F.lit(seed), *[F.concat(F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (*keys, text)])
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(source).alias("source"), size.alias("size"), F.md5(whole).alias("h"))


def borders(spark: SparkSession, sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, at, part): hashes below ``at`` give one more repetition, those at it ``part`` of one. ``wanted``: (source,
    extra), the words that the fraction of a repetition is to give."""
    found = None
    for i, n in enumerate(DIGITS):
        rows = sized
        if found is not None:  # only the bucket that holds the border is looked into
            at = found.select(F.col("source").alias("__s"), F.col("at").alias("__a"))
            rows = sized.join(at, sized["source"].eqNullSafe(at["__s"]) & (F.left("h", F.lit(DIGITS[i - 1])) == at["__a"]), "left_semi")
        sums = rows.groupBy("source", F.left("h", F.lit(n)).alias("p")).agg(F.sum("size").alias("s"))
        base = wanted.withColumn("base", F.lit(0).cast("long")) if found is None else found.select("source", "extra", F.col("before").alias("base"))
        base = base.withColumnRenamed("source", "__s")
        sums = sums.join(base, sums["source"].eqNullSafe(base["__s"]))
        before = F.col("base") + F.sum("s").over(Window.partitionBy("source").orderBy("p")) - F.col("s")
        last = sums.withColumn("before", before).where("before <= extra").groupBy("source").agg(F.max(F.struct("p", "before", "s", "extra")).alias("x"))
        found = written(spark, last.select("source", F.col("x.p").alias("at"), "x.before", "x.s", "x.extra"), "borders")
    return found.select("source", "at", F.when(F.col("s") > 0, (F.col("extra") - F.col("before")) / F.col("s")).otherwise(0.0).alias("part"))


def mix(spark: SparkSession, docs: DataFrame, keys: Sequence[str], weigh: Callable[[SparkSession, DataFrame], DataFrame] = cycled(), share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, text: str = "text", source: str = "source") -> DataFrame:
    """``keys`` plus size, source_size, target (its source's) and taken (words, repeats counted). ``weigh`` adds ``weight``
    to the table of sources (source, size)."""
    output_names(keys, RESULTS)
    sized = written(spark, measured(docs, keys, text, source, seed), "sized")
    sources = written(spark, sized.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    goal = written(spark, targets(weigh(spark, sources), share, epochs), "targets")
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    goal = goal.select("source", F.col("size").alias("source_size"), "target", whole.alias("whole")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = borders(spark, sized, goal.select("source", "extra"))
    goal, edge = goal.withColumnRenamed("source", "__s"), edge.withColumnRenamed("source", "__e")
    plan = goal.join(edge, goal["__s"].eqNullSafe(edge["__e"]), "left")
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["__s"]))
    more = F.when(F.col("h") < F.col("at"), F.col("size")).when(F.col("h") == F.col("at"), F.floor(F.col("size") * F.col("part"))).otherwise(0)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "size", "source_size", "target", (F.col("size") * F.col("whole") + more).cast("long").alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(2 * size AS DOUBLE) AS cap,
  coalesce(sum(CAST(2 * size AS DOUBLE)) OVER (ORDER BY 2.0 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(w) OVER (ORDER BY 2.0 * size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, CAST(1.5 AS DOUBLE) * (SELECT sum(size) FROM src) AS wanted FROM src),
c AS (SELECT *, w * (wanted - full_before) > cap * w_left AS capped FROM o),
t AS (SELECT source, size, CASE WHEN capped THEN cap ELSE w * (wanted - (SELECT coalesce(sum(cap), 0) FROM c WHERE capped)) / (SELECT sum(w) FROM c WHERE NOT capped) END AS target FROM c),
r AS (SELECT source, size AS source_size, target, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM t),
b AS (SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM d GROUP BY source, h),
e AS (SELECT b.source, h, CAST(s AS DOUBLE) AS s, CAST(before AS DOUBLE) AS before, target - whole * source_size AS extra FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * whole + CASE WHEN before + s <= extra THEN size WHEN before < extra THEN floor(size * ((extra - before) / s)) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
