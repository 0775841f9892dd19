"""Classifiers over lexicons. A lexicon is a parameter: a list of rows, small enough to stand in the plan as literals,
so text rows stay where they are and cost is rows times lexicon, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conditions import compiled
from .text import blank, bound, contains_any, strings

#: Above so many rows a lexicon should be a table that is joined, not a literal.
MOST_ROWS = 5000


@dataclass(frozen=True)
class Entry:
    """One row: a code with a weight and keywords; ``pattern`` for classifiers that count a regular expression."""

    code: str
    weight: int = 1
    keywords: tuple[str, ...] = ()
    pattern: str = ""
    extra: tuple[str, ...] = field(default=())


def load(spark: SparkSession, path: str) -> list[Entry]:
    """A lexicon from JSON lines: code, weight, keywords, pattern, extra; in stored order."""
    schema = "ordinal int, code string, weight int, keywords array<string>, pattern string, extra array<string>"
    rows = spark.read.schema(schema).json(path).orderBy("ordinal").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a lexicon of more than {MOST_ROWS} rows must be joined")
    return [Entry(r.code, r.weight or 1, tuple(r.keywords or ()), r.pattern or "", tuple(r.extra or ())) for r in rows]


def _table(lexicon: Sequence[Entry]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("o"), F.lit(e.code).alias("code"), F.lit(e.weight).alias("weight"), strings([k.lower() for k in e.keywords]).alias("kw"), strings(list(e.keywords)).alias("names")) for i, e in enumerate(lexicon)])


def matches(text: Column, lexicon: Sequence[Entry]) -> Column:
    """Rows with a hit in lower-cased ``text``: array of (o, code, weight, n, words), in lexicon order."""
    rows = lambda low: F.transform(
        _table(lexicon),
        lambda r: F.struct(r["o"].alias("o"), r["code"].alias("code"), r["weight"].alias("weight"), F.size(F.filter(r["kw"], lambda k: F.contains(low, k))).alias("n"), F.filter(r["names"], lambda k: F.contains(low, F.lower(k))).alias("words")),
    )
    return bound(F.lower(blank(text)), lambda low: F.filter(rows(low), lambda r: r["n"] > 0))


def weighted(text: Column, lexicon: Sequence[Entry], least: int = 3, generic: str = "GEN", names: int = 4) -> Column:
    """Confidence ``min(5, weight + hits - 1)``; the first best row wins; below ``least`` the code is generic, with the
    weak confidence kept. Struct (code, confidence, reason)."""
    scored = F.transform(matches(text, lexicon), lambda r: F.struct(F.least(F.lit(5), r["weight"] + r["n"] - 1).alias("c"), (-r["o"]).alias("o"), r["code"].alias("code"), F.array_join(F.slice(r["words"], 1, names), "、").alias("why")))

    def told(best: Column) -> Column:
        conf = F.coalesce(best["c"], F.lit(0))
        return F.struct(F.when(conf >= least, best["code"]).otherwise(generic).alias("code"), conf.alias("confidence"), F.coalesce(best["why"], F.lit("")).alias("reason"))

    return bound(F.array_max(scored), told)


def most_hits(text: Column, lexicon: Sequence[Entry], default: str) -> Column:
    """The code with most keyword hits, ties to the name that sorts last."""
    return F.coalesce(F.array_max(F.transform(matches(text, lexicon), lambda r: F.struct(r["n"].alias("n"), r["code"].alias("code"))))["code"], F.lit(default))


def first_hit(text: Column, lexicon: Sequence[Entry], default: str | None = None) -> Column:
    """The code of the first row with a hit."""
    return F.coalesce(F.get(matches(text, lexicon), F.lit(0))["code"], F.lit(default))


def counted(text: Column, lexicon: Sequence[Entry]) -> Column:
    """Codes by their pattern's number of matches, most first, ties in lexicon order: array of (n, o, code)."""
    rows = F.array(*[F.struct((-F.regexp_count(blank(text), F.lit(e.pattern))).alias("n"), F.lit(i).alias("o"), F.lit(e.code).alias("code")) for i, e in enumerate(lexicon)])
    return F.transform(F.array_sort(F.filter(rows, lambda r: r["n"] < 0)), lambda r: F.struct((-r["n"]).alias("n"), r["o"].alias("o"), r["code"].alias("code")))


def labels(text: Column, lexicon: Sequence[Entry], default: str) -> Column:
    """All labels with a match, ranked; the default alone if there are none."""
    found = F.transform(counted(text, lexicon), lambda r: r["code"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def top_label(text: Column, lexicon: Sequence[Entry], default: str) -> Column:
    return F.get(labels(text, lexicon, default), F.lit(0))


def implied(codes: Column, lists: dict[str, Sequence[str]], default: Column) -> Column:
    """Ordered distinct union of the lists of ``codes``; the default alone if that is empty."""
    table = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), strings(list(v)))])
    found = F.array_distinct(F.flatten(F.transform(codes, lambda c: F.coalesce(table[c], F.array().cast("array<string>")))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


@dataclass(frozen=True)
class FindingRule:
    """A declarative rule: every group of ``all_of`` has a hit, no word of ``none_of`` has; ``needs`` are items that the
    text should name, and with ``needs`` the rule fires only where one is missing. ``when``: a condition (see
    ``functions.conditions``) that must hold too; ``points``: further items as (name, condition), missing where theirs fails."""

    rule_id: str
    all_of: tuple[tuple[str, ...], ...] = ()
    none_of: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    message: str = ""
    when: str = ""
    points: tuple[tuple[str, str], ...] = ()


def finding_rules(table) -> list[FindingRule]:
    """Rules of a table (rule_id, priority, when, message, points), in order of priority and id: ``when`` is JSON, ``points``
    an array of (name, condition). A table of rules is small by nature and read on the driver."""
    rows = table.orderBy("priority", "rule_id").collect()
    return [FindingRule(r.rule_id, message=r.message or "", when=r.when or "", points=tuple((p.name, p.condition) for p in r.points or ())) for r in rows]


def fire(docs: DataFrame, text: str, rules: Sequence[FindingRule]) -> DataFrame:
    """One row for each document and fired rule: the columns of ``docs``, rule_id, missing items and message."""
    low = F.lower(blank(F.col(text)))
    out = []
    for i, r in enumerate(rules):
        ok = F.lit(True)
        for group in r.all_of:
            ok = ok & contains_any(F.col(text), group)
        if r.none_of:
            ok = ok & ~contains_any(F.col(text), r.none_of)
        if r.when:
            ok = ok & compiled(r.when, F.col(text))
        gaps = F.filter(strings(r.needs), lambda w: ~F.contains(low, F.lower(w)))
        if r.points:
            told = F.array(*[F.when(~compiled(spec, F.col(text)), F.lit(name)) for name, spec in r.points])
            gaps = F.concat(gaps, F.filter(told, lambda w: w.isNotNull()))
        if r.needs or r.points:
            ok = ok & (F.size(gaps) > 0)
        out.append(F.when(ok, F.struct(F.lit(i).alias("ordinal"), F.lit(r.rule_id).alias("rule_id"), gaps.alias("missing"), F.lit(r.message).alias("message"))))
    fired = F.filter(F.array(*out), lambda x: x.isNotNull())
    return docs.withColumn("__f", F.explode(fired)).select(*docs.columns, "__f.ordinal", "__f.rule_id", "__f.missing", "__f.message")
