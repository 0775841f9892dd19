"""Opinion mining: split free text into items, classify them, match them to sources, judge their alignment with evidence.

Everything but the fuzzy ratio is a column expression or a join; lexicons, checkpoints and guides are parameters.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import conditions as cn
from ..functions import lexicon as lx
from ..functions import text as tx
from . import scan as sc

#: An item mark, what counts as no opinion, what stands around an item, a number or a threshold.
ITEM_MARK = r"(?:^|[；;/]\s*)\d+[、.．]\s*"
NO_OPINION = ("", "/", "无", "无意见")
ITEM_EDGE = " ；;/"
NUMBER = r"\d+\s*(?:[:：]\s*\d+|小时|h|H|天|日|d|D|mm|cm|m|%|遍|级)|[≥≤]|不超过|不小于|不少于"
AGREED = "同意"
PRAISE = "亮点"


def items(c: Column) -> Column:
    """The numbered items of an opinion; the whole opinion where it has none; nothing for a blank or an empty remark."""
    text = tx.u_trim(tx.blank(c))
    flat = F.replace(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit(" / "))
    parts = F.filter(F.transform(F.split(flat, ITEM_MARK), lambda p: F.trim(p, F.lit(ITEM_EDGE))), lambda p: p != "")
    return F.when(text.isin(*NO_OPINION), F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(flat))


def load(opinions: DataFrame, text: str = "opinion") -> DataFrame:
    """One row for each item: the columns of ``opinions`` with item_index from 1 and the item's text."""
    keep = [c for c in opinions.columns if c not in (text, "item_index")]
    return opinions.select(*keep, F.posexplode(items(F.col(text))).alias("__i", text)).withColumn("item_index", F.col("__i") + 1).drop("__i")


def non_actionable(c: Column) -> Column:
    text = tx.clean(c)
    return text.isin("无", "/", "") | F.startswith(text, F.lit(AGREED)) | F.startswith(text, F.lit(PRAISE))


def promotes(c: Column, dimension: Column, scheme_related: Column, dimensions: Sequence[str], scope: str = "scheme-priority") -> Column:
    """Whether an opinion becomes experience: ``all``, ``scheme-only`` or ``scheme-priority``."""
    text = tx.clean(c)
    usable = ~non_actionable(c) & ~((F.length(text) <= 8) & text.rlike("[:：]$"))
    if scope == "all":
        return usable
    if scope == "scheme-only":
        return usable & scheme_related
    return usable & (scheme_related | dimension.isin(*dimensions))


def document_type(name: Column, scheme: Sequence[str], cost: Sequence[str], names=("both", "scheme", "cost", "other")) -> Column:
    s, c = tx.contains_any(name, scheme), tx.contains_any(name, cost)
    return F.when(s & c, names[0]).when(s, names[1]).when(c, names[2]).otherwise(names[3])


def evidence_type(c: Column, hints: Sequence[lx.Entry], dimension: Column, logic: str, default: str = "experience") -> Column:
    """The first hint whose pattern matches; for the logic dimension its own type, else the default."""
    out = None
    for h in hints:
        cond = tx.blank(c).rlike(h.pattern)
        out = F.when(cond, h.code) if out is None else out.when(cond, h.code)
    own = F.when(dimension == logic, logic).otherwise(default)
    return own if out is None else out.otherwise(own)


def extensions(c: Column, rules: Sequence[lx.Entry], default: Column) -> Column:
    """Codes of all extension rules that the text triggers; the default alone if none."""
    found = F.transform(lx.matches(c, rules), lambda r: r["code"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def triggers(c: Column, lexicon: Sequence[lx.Entry], stop: Sequence[str], limit: int = 10, pattern: str = tx.QUERY_WORD) -> Column:
    """Lexicon words in the text first, then its other words, up to ``limit`` distinct ones."""
    known = F.flatten(F.transform(lx.matches(c, lexicon), lambda r: r["words"]))
    words = F.array_except(F.regexp_extract_all(tx.blank(c), F.lit(pattern), 0), tx.strings(stop))
    return F.slice(F.array_distinct(F.concat(known, words)), 1, limit)


def template(choice: Column, templates: dict[str, str], default: str, **fields: Column) -> Column:
    """The template of a choice with its ``{placeholders}`` filled."""
    table = F.create_map(*[x for k, v in templates.items() for x in (F.lit(k), F.lit(v))]) if templates else None
    out = F.coalesce(table[choice], F.lit(default)) if table is not None else F.lit(default)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def classify(rows: DataFrame, categories: Sequence[lx.Entry], dimensions: Sequence[lx.Entry], patterns: Sequence[lx.Entry], intents: dict[str, Sequence[str]], text: str = "opinion", default_category: str = "OTHER", default_label: str = "judgement") -> DataFrame:
    """Opinion rows with category, dimension, primary and secondary patterns and review intents."""
    c = F.col(text)
    named = rows.withColumn("work_category", lx.most_hits(c, categories, default_category)).withColumn("dimension", lx.top_label(c, dimensions, dimensions[0].code)).withColumn("labels", lx.labels(c, patterns, default_label))
    return named.select(*rows.columns, "work_category", "dimension", F.get("labels", F.lit(0)).alias("pattern"), F.slice("labels", 2, 3).alias("secondary"), lx.implied(F.col("labels"), intents, F.col("dimension")).alias("intents"))


# --- checkpoints and alignment ---


@dataclass(frozen=True)
class Checkpoint:
    """What an opinion asks to verify. Policies: ``presence`` (a mention covers it), ``exact`` (the pattern covers it, a
    mention is vague), ``number`` (a mention with a number or threshold covers it, without one is vague), ``cases`` (the
    first of ``cases``, (status, condition), that holds decides, else it is missing: order of mention, distances, values)."""

    name: str
    triggers: tuple[str, ...]
    aliases: tuple[str, ...]
    policy: str = "number"
    exact: str = ""
    cases: tuple[tuple[str, str], ...] = ()


COVERED, VAGUE, ABSENT = "covered", "vague", "missing"


def status(point: Checkpoint, evidence: Column) -> Column:
    if point.policy == "cases":
        return cn.decided(point.cases, evidence, ABSENT)
    mention = tx.contains_any(evidence, point.aliases)
    if point.policy == "presence":
        return F.when(mention, COVERED).otherwise(ABSENT)
    full = tx.blank(evidence).rlike(point.exact if point.policy == "exact" else NUMBER)
    return F.when(~mention, ABSENT).when(full, COVERED).otherwise(VAGUE)


def expected(opinion: Column, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] | Column = ()) -> Column:
    """Names of the checkpoints an opinion triggers, each once; else the first four of the fallback: a list for all, or a
    column of arrays, such as the artifacts that the opinion's attribution requires."""
    hit = F.filter(F.array(*[F.when(tx.contains_any(opinion, p.triggers), F.lit(p.name)) for p in points]), lambda n: n.isNotNull())
    rest = F.slice(F.coalesce(fallback, F.array().cast("array<string>")), 1, 4) if isinstance(fallback, Column) else tx.strings([p.name for p in fallback[:4]])
    return F.when(F.size(hit) > 0, F.array_distinct(hit)).otherwise(rest)


def statuses(evidence: Column, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] = ()) -> Column:
    """The status of every checkpoint in a text, by name; one of ``points`` comes before one of the fallback."""
    return F.create_map(*[x for p in {q.name: q for q in [*fallback, *points]}.values() for x in (F.lit(p.name), status(p, evidence))])


def read(texts: DataFrame, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] = (), evidence: str = "evidence") -> DataFrame:
    """Texts with ``statuses``, so that ``assess`` reads a text once for all opinions that meet it, and with as much of the text as
    tells whether there is any: the whole does not travel with the opinions."""
    return texts.withColumn("statuses", statuses(F.col(evidence), points, fallback)).withColumn(evidence, F.left(evidence, F.lit(1)))


def asked(cards_: DataFrame, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] = (), opinion: str = "opinion") -> DataFrame:
    """Cards with what ``assess`` takes from their opinion alone, ``wanted`` and ``idle``, so that it is read once for all texts that
    the card meets."""
    return cards_.withColumn("wanted", expected(F.col(opinion), points, fallback)).withColumn("idle", non_actionable(F.col(opinion)))


def assess(rows: DataFrame, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] | Column = (), opinion: str = "opinion", evidence: str = "evidence") -> DataFrame:
    """Rows with assessments (name, status), covered, partial and missing names, and the verdict. A name of a ``fallback``
    column that is no checkpoint is covered where it stands in the evidence. Rows of texts that ``read`` has seen need no text,
    and opinions that ``asked`` has seen are not read again.

    Order of precedence: no action needed; undecided without evidence or checkpoints; all covered; some covered or vague;
    missing.
    """
    listed = [] if isinstance(fallback, Column) else fallback
    known = statuses(F.col(evidence), points, listed)
    if "statuses" in rows.columns:
        if isinstance(fallback, Column):
            raise ValueError("a fallback column is looked up in the whole text, which rows of read texts do not hold")
        known = F.coalesce("statuses", statuses(F.lit(""), points, listed))
    seen = {"wanted", "idle"} <= set(rows.columns)
    wanted = F.col("wanted") if seen else expected(F.col(opinion), points, fallback)
    whole = F.lower(tx.blank(F.col(evidence))) if isinstance(fallback, Column) else F.lit("")  # listed names are all known
    plain = lambda t, n: F.when(F.contains(t, F.lower(n)), COVERED).otherwise(ABSENT)
    judged = lambda s: F.transform(s["w"], lambda n: F.struct(n.alias("name"), F.coalesce(F.try_element_at(s["k"], n), plain(s["t"], n)).alias("status")))
    out = rows.withColumn("assessments", tx.bound(F.struct(wanted.alias("w"), known.alias("k"), whole.alias("t")), judged))
    names = lambda s: F.transform(F.filter("assessments", lambda a: a["status"] == s), lambda a: a["name"])
    out = out.withColumn("covered", names(COVERED)).withColumn("partial", names(VAGUE)).withColumn("absent", names(ABSENT))
    none = tx.blank(F.col(evidence)) == ""
    verdict = (
        F.when(F.col("idle") if seen else non_actionable(F.col(opinion)), "no_action")
        .when(none | (F.size("assessments") == 0), "undecided")
        .when((F.size("covered") > 0) & (F.size("partial") == 0) & (F.size("absent") == 0), "resolved")
        .when((F.size("covered") > 0) | (F.size("partial") > 0), "partly_resolved")
        .otherwise("unresolved")
    )
    return out.withColumn("alignment", verdict)


# --- matching to sources and evidence ---


def is_noise(line: Column, opinion: Column, noise: Sequence[tuple[str, str | Sequence[str]]]) -> Column:
    """Whether a line holds the first term of a pair, and the opinion none of its second ones."""
    out = F.lit(False)
    for term, needed in noise:
        wanted = F.lit(False)
        for n in [needed] if isinstance(needed, str) else needed:
            wanted = wanted | F.contains(opinion, F.lit(n))
        out = out | (F.contains(line, F.lit(term)) & ~wanted)
    return out


def evidence(opinions: DataFrame, lines: DataFrame, key: str, words: str = "keywords", k: int = 3, noise: Sequence[tuple[str, str]] = (), opinion: str = "opinion") -> DataFrame:
    """The best ``k`` lines of each opinion's source: most keyword hits, then shorter, then earlier. ``noise``: (term in the
    line, terms of which the opinion must then hold one). Columns: those of ``opinions``, line_no, line, hits, place."""
    own = [c for c in opinions.columns if c != words]
    rows = opinions.withColumn("__id", F.struct(F.xxhash64(*own), F.hash(*own))).join(lines, key)
    if noise:
        rows = rows.where(~is_noise(F.col("line"), F.col(opinion), noise))
    rows = rows.withColumn("hits", F.size(tx.hits(F.col("line"), F.col(words)))).where("hits > 0")
    order = Window.partitionBy("__id").orderBy(F.desc("hits"), F.length("line"), F.asc("line_no"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("__id")


def with_evidence(opinions: DataFrame, lines: DataFrame, texts: DataFrame, key: str, ids: Sequence[str], good: Column, words: str = "keywords", k: int = 3) -> DataFrame:
    """Opinions with snippets (array of line) and evidence: the snippets joined, or the whole source text where there is no
    snippet and the source match is ``good``."""
    found = evidence(opinions, lines, key, words, k).groupBy(*ids).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]).alias("snippets"))
    rows = opinions.join(found, list(ids), "left").withColumn("snippets", F.coalesce("snippets", F.array().cast("array<string>")))
    bare = rows.where((F.size("snippets") == 0) & good).select(*ids, key)
    whole = bare.join(texts, key).select(*ids, F.col("text").alias("__whole"))
    rows = rows.join(whole, list(ids), "left")
    return rows.withColumn("evidence", F.when(F.size("snippets") > 0, F.array_join("snippets", " ")).otherwise(tx.blank(F.col("__whole")))).drop("__whole")


def snippets(found: DataFrame, source: str, words: str = "keywords", size: int = 600, names: int = 6) -> DataFrame:
    """What ``evidence`` found with source_file, location, the first keywords that matched, the text around them and the score."""
    matched = F.slice(tx.hits(F.col("line"), F.col(words)), 1, names)
    text = tx.snippet(F.col("line"), F.col(words), size)
    return found.select("*", F.col(source).cast("string").alias("source_file"), F.concat(F.lit("line "), F.col("line_no") + 1).alias("location"), matched.alias("matched_keywords"), text.alias("text"), F.col("hits").alias("match_score"))


def candidates(left: DataFrame, right: DataFrame, share: float = 0.45) -> DataFrame:
    """Pairs of distinct names (a, b) with ``shared``, the number of characters they have in common as multisets, where that is
    at least ``share`` of the longer name. No such pair is lost.

    Each occurrence of a character is a token of its own. Names with ``t`` tokens in common meet in their rarest ``n - t + 1``,
    so only those are joined.
    """

    def tokens(df: DataFrame, name: str) -> DataFrame:
        chars = F.filter(F.split(F.col(name), ""), lambda x: x != "")
        numbered = F.transform(chars, lambda x, k: F.concat(x, F.size(F.filter(F.slice(chars, 1, k + 1), lambda y: y == x)).cast("string")))
        return df.select(name).where(F.length(name) > 0).distinct().select(name, numbered.alias(f"t{name}"))

    a, b = tokens(left, "a"), tokens(right, "b")
    every = a.select(F.explode("ta").alias("g")).unionByName(b.select(F.explode("tb").alias("g")))
    rare = every.groupBy("g").agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        size = F.size(f"t{name}")
        rows = df.select(name, (size - F.ceil(share * size) + 1).alias("p"), F.explode(f"t{name}").alias("g")).join(rare, "g")
        place = F.row_number().over(Window.partitionBy(name).orderBy("f", "g"))
        return rows.withColumn("k", place).where("k <= p").select(name, "g")

    met = rarest(a, "a").join(rarest(b, "b"), "g").select("a", "b").distinct()
    rows = met.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return rows.where(F.col("shared") >= share * F.greatest(F.size("ta"), F.size("tb"))).select("a", "b", "shared")


def fuzzy(left: DataFrame, right: DataFrame, cutoff: float = 0.45) -> DataFrame:
    """The best name b of each a by Ratcliff-Obershelp ratio (ties to the smaller name), with its quality label. Only pairs
    whose common characters allow the cutoff are compared."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    pairs = candidates(left, right, cutoff / 2).where(2 * F.col("shared") >= cutoff * (F.length("a") + F.length("b")))
    return _best(pairs.drop("shared").withColumn("score", ratio("a", "b")), cutoff)


def fuzzy_edit(left: DataFrame, right: DataFrame, cutoff: float = 0.45) -> DataFrame:
    """As ``fuzzy``, by edit distance: one minus the distance over the longer length."""
    pairs = candidates(left, right, cutoff).drop("shared")
    return _best(pairs.withColumn("score", 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))), cutoff)


def _best(scored: DataFrame, cutoff: float, middle: float = 0.68) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.round("score", 9).desc(), F.asc("b"))
    best = scored.where(F.col("score") >= cutoff).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    label = F.when(F.contains("a", F.col("b")) | F.contains("b", F.col("a")), "high").when(F.col("score") >= middle, "medium").otherwise("low")
    return best.withColumn("quality", label)


def match_sources(names: DataFrame, files: DataFrame, mapping: DataFrame, cutoff: float = 0.45) -> DataFrame:
    """(project_name, matched_file, match_type, quality, score, file_type) of distinct names: the file that ``mapping``
    (project_name, path) names, else the closest of ``files`` (name) by its stem."""
    every = names.select("project_name").where(tx.blank(F.col("project_name")) != "").distinct()
    known = every.join(mapping.select("project_name", F.col("path").alias("matched_file")), "project_name")
    stems = files.select("name", F.regexp_replace("name", r"\.[^.]*$", "").alias("b"))
    lost = every.join(known, "project_name", "left_anti").select(F.col("project_name").alias("a"))
    near = fuzzy_edit(lost, stems.select("b"), cutoff).join(stems.groupBy("b").agg(F.min("name").alias("matched_file")), "b")
    rows = known.select("*", F.lit("mapping").alias("match_type"), F.lit("mapped").alias("quality"), F.lit(1.0).alias("score"))
    rows = rows.unionByName(near.select(F.col("a").alias("project_name"), "matched_file", F.lit("fuzzy").alias("match_type"), "quality", "score"))
    return rows.withColumn("file_type", F.lower(F.regexp_extract("matched_file", r"\.([^.]*)$", 1)))


# --- attribution ---


@dataclass(frozen=True)
class Profile:
    """What an attribution stands for: the question behind it, why it matters, how it carries over, what to ask for."""

    label: str
    question: str = ""
    cause: str = ""
    principle: str = ""
    checks: tuple[str, ...] = ()
    artifacts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Case:
    """A text for opinions with one of ``words``, of a pattern, or of a dimension, where they are given."""

    text: str
    words: tuple[str, ...] = ()
    pattern: str = ""
    dimension: str = ""


@dataclass(frozen=True)
class Guide:
    """The tables by which opinions are attributed and cards are written. ``fixes``, ``backgrounds`` and ``reasons`` hold
    templates with {category} and {opinion}; the last template of each pair is the default."""

    patterns: Sequence[lx.Entry]
    attributions: Sequence[lx.Entry]
    labels: dict[str, str]
    profiles: dict[str, Profile]
    intents: dict[str, Sequence[str]]
    usual: tuple[dict[str, str], str]
    risks: tuple[Sequence[Case], str]
    fixes: tuple[dict[str, str], str]
    asks: tuple[dict[str, Sequence[str]], Sequence[str]]
    backgrounds: tuple[dict[str, str], str]
    reasons: tuple[dict[str, str], str]
    extensions: Sequence[lx.Entry] = ()
    no_label: str = "judgement"
    no_category: str = "OTHER"


def by_case(cases: Sequence[Case], default: str, text: Column, pattern: Column, dimension: Column) -> Column:
    """The text of the first case that holds."""
    out = F.lit(default)
    for c in reversed(cases):
        holds = F.exists(tx.strings(c.words), lambda w: F.contains(text, w)) if c.words else F.lit(True)
        if c.pattern:
            holds = holds & (pattern == c.pattern)
        if c.dimension:
            holds = holds & (dimension == c.dimension)
        out = F.when(holds, c.text).otherwise(out)
    return out


def search_query(words: Column, category: Column, dimension: Column, guide: Guide, limit: int = 5) -> Column:
    """Words of a search of the standards: the first triggers, the category unless it is the default, the dimension's words."""
    table, rest = guide.asks
    extra = tx.strings(rest)
    for name, more in table.items():
        extra = F.when(dimension == name, tx.strings(more)).otherwise(extra)
    own = F.when(category != guide.no_category, F.array(category)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.concat(F.slice(words, 1, limit), own, extra)), " ")


def evidence_reference(c: Column, category: Column, kind: Column, refs: Sequence[lx.Entry], rule: str, logic: str, own: str, default: str) -> Column:
    """For rules the first reference with a keyword in opinion or category; the text itself for logic; else the default."""
    return F.when(kind == logic, own).when(kind == rule, lx.first_hit(F.concat_ws(" ", c, category), refs, default)).otherwise(default)


def attribute(rows: DataFrame, guide: Guide) -> DataFrame:
    """Opinions (opinion, work_category, dimension, keywords) with their fifteen attribution columns."""
    c, category, dimension = F.col("opinion"), F.col("work_category"), F.col("dimension")
    struct = lambda p: F.struct(*[F.lit(v).alias(n) for n, v in (("label", p.label), ("question", p.question), ("cause", p.cause), ("principle", p.principle))], tx.strings(p.checks).alias("checks"), tx.strings(p.artifacts).alias("artifacts"))
    profile = F.create_map(*[x for k, p in guide.profiles.items() for x in (F.lit(k), struct(p))])
    out = rows.withColumn("__p", lx.labels(c, guide.patterns, guide.no_label)).withColumn("__a", lx.labels(c, guide.attributions, guide.no_label))
    first, more = lambda n: F.get(n, F.lit(0)), lambda n: F.slice(n, 2, 3)
    out = out.withColumn("__f", F.coalesce(profile[first("__a")], struct(Profile(guide.no_label))))
    pattern = first("__p")
    return out.select(
        *rows.columns,
        pattern.alias("problem_pattern"),
        template(pattern, guide.labels, guide.no_label).alias("problem_pattern_label"),
        more("__p").alias("secondary_patterns"),
        first("__a").alias("professional_attribution"),
        F.col("__f.label").alias("professional_attribution_label"),
        more("__a").alias("secondary_professional_attributions"),
        F.col("__f.question").alias("engineer_question"),
        lx.implied(F.col("__p"), guide.intents, template(dimension, *guide.usual)).alias("review_intents"),
        F.col("__f.cause").alias("root_cause"),
        by_case(*guide.risks, F.concat_ws(" ", c, category), pattern, dimension).alias("risk_if_ignored"),
        F.col("__f.principle").alias("generalization_rule"),
        F.col("__f.checks").alias("review_questions"),
        F.col("__f.artifacts").alias("required_artifacts"),
        template(pattern, *guide.fixes, category=category).alias("fix_template"),
        search_query(F.col("keywords"), category, dimension, guide).alias("standard_query"),
    )


def gap(alignment: Column, evidence: Column, covered: Column, partial: Column, absent: Column) -> Column:
    """What the source lacks, in words, for rows that ``assess`` judged."""
    part = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, ", ")))
    return (
        F.when(alignment == "no_action", "agreed or praised: no finding")
        .when((alignment == "undecided") & (tx.blank(evidence) == ""), "no passage of the source to compare with")
        .when(alignment == "undecided", "no point to compare")
        .when(alignment == "resolved", "the source covers every point")
        .otherwise(F.concat_ws("; ", part("covered: ", covered), part("vague: ", partial), part("missing: ", absent)))
    )


# --- experience cards ---


def full_cards(rows: DataFrame, guide: Guide) -> DataFrame:
    """The 43 fields of a card. ``rows``: opinions that ``classify``, ``attribute`` and ``assess`` have seen, with engineer,
    project_type, file_type, matched_file, scheme_related, scheme_evidence, evidence_type and evidence_ref."""
    c, category, dimension = F.col("opinion"), F.col("work_category"), F.col("dimension")
    text = gap(F.col("alignment"), F.col("evidence"), F.col("covered"), F.col("partial"), F.col("absent"))
    asked = F.when(F.col("alignment") == "no_action", "no finding: nothing to check").otherwise(F.concat(F.lit("the expert asks: "), F.col("engineer_question")))
    points = [F.col(a).alias(b) for a, b in (("covered", "covered_points"), ("partial", "partial_points"), ("absent", "missing_points"), ("assessments", "checkpoint_assessments"))]
    chain = F.struct(c.alias("source_opinion"), F.slice("scheme_evidence", 1, 3).alias("scheme_evidence"), *points, F.col("alignment").alias("alignment_status"), text.alias("scheme_gap"), asked.alias("expert_intent"), F.col("generalization_rule").alias("transfer_principle"))
    same = lambda *names: [F.col(n) for n in names]
    return rows.select(
        tx.hash_id("EXP", F.col("project_name"), F.col("row_index"), F.col("item_index"), c).alias("id"),
        F.col("project_name").alias("source_project"), F.col("engineer").alias("source_engineer"), F.col("row_index").alias("source_row"), F.col("item_index").alias("source_item"), c.alias("source_opinion"),
        *same("project_type", "file_type", "matched_file", "work_category", "dimension"),
        template(dimension, *guide.backgrounds, category=category).alias("background"),
        template(dimension, *guide.reasons, opinion=tx.clean(c)).alias("reason"),
        *same("problem_pattern", "problem_pattern_label", "secondary_patterns", "professional_attribution", "professional_attribution_label", "secondary_professional_attributions"),
        *same("engineer_question", "review_intents", "root_cause", "risk_if_ignored", "generalization_rule", "review_questions", "required_artifacts", "fix_template", "standard_query", "scheme_evidence"),
        F.col("alignment").alias("alignment_status"), *points, text.alias("scheme_gap"), asked.alias("expert_intent"), chain.alias("evidence_chain"),
        *same("evidence_type", "evidence_ref"),
        extensions(F.concat_ws(" ", "project_name", c), guide.extensions, category).alias("extension_rules"),
        F.col("keywords").alias("trigger_keywords"),
        F.when(F.col("scheme_related") & (F.size("keywords") > 0), SURE).otherwise("medium").alias("confidence"),
        F.current_timestamp().alias("created_at"),
    )


#: The fields of a card that its rule's text holds, in this order.
RULE_TEXT = "work_category dimension trigger_keywords source_opinion background reason problem_pattern_label professional_attribution_label engineer_question review_intents root_cause risk_if_ignored generalization_rule alignment_status covered_points partial_points missing_points scheme_gap expert_intent review_questions required_artifacts fix_template extension_rules evidence_type evidence_ref".split()
SHORT_TEXT = "work_category dimension professional_attribution_label alignment_status source_opinion scheme_gap generalization_rule".split()


def full_card_rules(cards_: DataFrame, size: int = 700) -> DataFrame:
    """Corpus rules of full cards: a text of all they say, its condensed form, tags, position and the card as JSON."""
    kinds = dict(cards_.dtypes)
    said = lambda n: F.array_join(n, ", ") if kinds[n].startswith("array") else tx.blank(F.col(n))
    body = F.concat_ws("\n", F.lit("[experience]"), *[F.concat(F.lit(f"{n}: "), said(n)) for n in RULE_TEXT])
    return cards_.select(
        F.col("id").alias("rule_id"), body.alias("content"), F.left(F.concat_ws(" | ", *[said(n) for n in SHORT_TEXT]), F.lit(size)).alias("condensed_content"),
        F.concat("trigger_keywords", F.array("dimension", "work_category")).alias("tags"), (F.col("source_row") * 100 + F.col("source_item")).alias("seq_index"),
        F.lit("review_experience").alias("index_source"), F.lit(True).alias("is_washed"), F.lit("active").alias("status"), F.col("reason").alias("summary"), F.to_json(F.struct(*cards_.columns)).alias("full_text"),
    )


def cards(rows: DataFrame) -> DataFrame:
    """Cards from classified opinions: id, source, trigger words, confidence and the fields that rules are made of."""
    sure = F.when(F.size("secondary") == 0, "medium").otherwise("high")
    return rows.select(tx.hash_id("EXP", F.col("project_name"), F.col("row_index"), F.col("item_index"), F.col("opinion")).alias("card_id"), "project_name", "row_index", "item_index", "opinion", "work_category", "dimension", "pattern", "secondary", "intents", "keywords", sure.alias("confidence"))


def card_rules(cards_: DataFrame, size: int = 700) -> DataFrame:
    """Corpus rules from cards: a text template, its condensed form and a position by source row and item."""
    body = F.concat(F.lit("[experience] "), "work_category", F.lit(" / "), "dimension", F.lit("\nopinion: "), "opinion", F.lit("\nkeywords: "), F.array_join("keywords", ", "))
    return cards_.select(F.col("card_id").alias("rule_id"), F.col("project_name").alias("source_file"), body.alias("content"), F.left(body, F.lit(size)).alias("condensed_content"), (F.col("row_index") * 100 + F.col("item_index")).alias("seq_index"), F.lit("review_experience").alias("index_source"), F.to_json(F.struct(*cards_.columns)).alias("full_text"))


def cards_of(rules: DataFrame, schema: str | StructType) -> DataFrame:
    """Cards read back from experience rules by their stored JSON."""
    return rules.where("index_source = 'review_experience'").select(F.from_json("full_text", schema).alias("c")).where("c is not null").select("c.*")


#: Fixed value: the confidence that ranks first.
SURE = "high"


def card_words(cards_: DataFrame, generic: Sequence[str] = (), strong: Sequence[str] = (), guard: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """One row for each distinct non-generic trigger of a card, in lower case: card_id, confidence, word, strong, project and
    needs, the domains of ``guard`` whose term stands in the card's opinion."""
    project = F.col("project_name") if "project_name" in cards_.columns else F.lit(None).cast("string")
    needs = F.filter(F.array(*[F.when(tx.contains_any(F.col("opinion"), (term,)), F.lit(i)) for i, (term, _) in enumerate(guard)]), lambda i: i.isNotNull()) if guard else F.array().cast("array<int>")
    rows = cards_.select("card_id", "confidence", F.explode(F.array_except("keywords", tx.strings(generic))).alias("w"), project.alias("project"), needs.alias("needs")).where(F.trim("w") != "")
    mark = F.col("w").isin(*strong).cast("int") if strong else F.lit(0)
    return rows.select("card_id", "confidence", F.lower("w").alias("word"), mark.alias("strong"), "project", "needs", "w").distinct().drop("w")


def overlaps(docs: DataFrame, cards_: DataFrame, doc: str = "doc_id", text: str = "text", generic: Sequence[str] = (), strong: Sequence[str] = (), least: int = 1, limit: int | None = None) -> DataFrame:
    """(doc, card_id, confidence, overlap, strong) of cards of which ``least`` non-generic triggers stand in a document, or,
    where ``least`` is at most two, a strong one. Texts are scanned once, where they lie; with ``limit``, only the best of a
    document and dictionary block come back."""
    low = docs.select(doc, F.lower(text).alias("__t"))
    return sc.card_hits(low, card_words(cards_, generic, strong), doc, "__t", least, limit).drop("own")


def _best_first(doc: str):
    return Window.partitionBy(doc).orderBy(F.desc("overlap"), F.desc(F.col("confidence") == SURE), F.asc("card_id"))


def match_cards(docs: DataFrame, cards_: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = 8, least: int = 2, generic: Sequence[str] = (), strong: Sequence[str] = ()) -> DataFrame:
    """(doc, card_id, overlap, place): the ``limit`` cards with most triggers in a document, at least ``least``."""
    found = overlaps(docs, cards_, doc, text, generic, strong, least, limit)
    return found.withColumn("place", F.row_number().over(_best_first(doc))).where(F.col("place") <= limit).select(doc, "card_id", "overlap", "place")


def two_tier(docs: DataFrame, cards_: DataFrame, limit: int = 8, cross: int = 4, least: int = 2, doc: str = "doc_id", text: str = "text", name: str = "project_key", generic: Sequence[str] = (), strong: Sequence[str] = (), guard: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """Same-project matches (one name contains the other) with one shared trigger first; where they are few, others with
    ``least`` shared triggers. (doc, card_id, overlap, place, match_scope). One scan of the texts serves both tiers.

    ``guard``: domains as (term, aliases). Another project's card whose opinion names the term is left out where none of the
    aliases stands in the document, so experience of other trades does not come through."""
    lowered = [(term, [a.lower() for a in own]) for term, own in guard]
    low = docs.select(doc, name, F.lower(text).alias("__t"))
    found = sc.card_hits(low, card_words(cards_, generic, strong, guard), doc, "__t", least, cross, name, 1, limit, lowered)
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy(doc, "own").orderBy(F.desc("overlap"), F.desc(F.col("confidence") == SURE), F.asc("card_id"))))
    kept = ranked.where((F.col("own") & (F.col("place") <= limit)) | (~F.col("own") & (F.col("place") <= cross)))
    mine = F.sum(F.col("own").cast("int")).over(Window.partitionBy(doc))
    few = (F.col("n") < max(2, limit // 2)) & (F.col("place") <= F.lit(limit) - F.col("n"))
    rows = kept.withColumn("n", mine).where(F.col("own") | few)
    return rows.select(doc, "card_id", "overlap", "place", F.when(F.col("own"), "same_project").otherwise("cross_project").alias("match_scope"))


# --- reports ---


def facets(rows: DataFrame, columns: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Counts of every value of several columns in one pass: (facet, value, n)."""
    single = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]

    def many_of(c: str) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(c).alias("facet"), v.cast("string").alias("value")))

    many = [many_of(c) for c in arrays]
    pairs = F.concat(F.array(*single), *many) if single else F.concat(*many)
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


#: Why an opinion is undecided, in order of precedence, and what is then asked for.
NEEDED = {
    "no_file": "give the original scheme or its attachments, or say which file the project's name stands for",
    "mismatch": "the file was matched by a like name only: give the one that the opinion is about",
    "no_evidence": "the file does not hold the passage: give older versions, price lists or attachments",
    "no_checkpoint": "give the context of the opinion, so that points can be drawn from it",
    "review": "read the scheme again at the passage and add page and section",
}


def gap_reason(rows: DataFrame, low: float = 0.55) -> Column:
    """The reason of an undecided row: by matched_file and match_score (where there are such columns), evidence, assessments."""
    none = tx.blank(F.col("evidence")) == ""
    file = tx.blank(F.col("matched_file")) == "" if "matched_file" in rows.columns else F.lit(False)
    poor = F.coalesce(F.col("match_score") < low, F.lit(False)) if "match_score" in rows.columns else F.lit(False)
    return F.when(file, "no_file").when(none & poor, "mismatch").when(none, "no_evidence").when(F.size("assessments") == 0, "no_checkpoint").otherwise("review")


def gap_report(rows: DataFrame, unresolved: str = "undecided") -> DataFrame:
    """Unresolved opinions by project: their number, the total, the ratio, categories, the files matched to them, a count for each
    reason, and what is needed for the first of them; most first."""
    open_ = F.col("alignment") == unresolved
    file = F.col("matched_file") if "matched_file" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("reason", F.when(open_, gap_reason(rows))).withColumn("__file", F.when(open_, F.nullif(tx.clean(file), F.lit(""))))
    order = F.struct(*[c for c in ("row_index", "item_index") if c in rows.columns], "reason")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    counts = [F.count_if(F.col("reason") == r).alias(n) for r, n in zip(NEEDED, ("without_file", "mismatched", "without_evidence", "without_checkpoint", "to_review"))]
    needed = F.create_map(*[F.lit(x) for kv in NEEDED.items() for x in kv])[F.min_by("reason", F.when(open_, order))]
    out = rows.groupBy("project_name").agg(F.count("*").alias("total"), F.count_if(open_).alias("unresolved"), joined(F.when(open_, F.col("work_category"))).alias("categories"), joined("__file").alias("matched_files"), *counts, needed.alias("needed_source"))
    return out.withColumn("ratio", F.col("unresolved") / F.col("total")).where("unresolved > 0").orderBy(F.desc("unresolved"), "project_name")


def first_rows(rows: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def top_values(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group, ties by value."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(value)))).where(F.col("place") <= k)


def with_examples(rows: DataFrame, group: str, order: Sequence[str], k: int, fields: Sequence[str]) -> DataFrame:
    """(group, n, examples): the size of each group and the ``fields`` of its first ``k`` rows."""
    counted = rows.groupBy(group).agg(F.count("*").alias("n"))
    some = first_rows(rows, group, order, k).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("e")))), lambda s: s["e"]).alias("examples"))
    return counted.join(some, group)


def category_methods(rows: DataFrame, order: Sequence[str], patterns: int = 5, dimensions: int = 4) -> DataFrame:
    """(work_category, n, top_patterns, top_dimensions): the most frequent of each category, ties to the one seen first."""

    def best(value: str, k: int, name: str) -> DataFrame:
        counted = rows.groupBy("work_category", value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
        placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("work_category").orderBy(F.desc("n"), "seen"))).where(F.col("place") <= k)
        pairs = F.sort_array(F.collect_list(F.struct("place", F.col(value).alias("code"), "n")))
        return placed.groupBy("work_category").agg(F.transform(pairs, lambda s: F.struct(s["code"].alias("code"), s["n"].alias("n"))).alias(name))

    sizes = rows.groupBy("work_category").agg(F.count("*").alias("n"))
    return sizes.join(best("problem_pattern", patterns, "top_patterns"), "work_category").join(best("dimension", dimensions, "top_dimensions"), "work_category")


def status_distribution(rows: DataFrame) -> DataFrame:
    by = rows.groupBy("project_name", "alignment").agg(F.count("*").alias("n"))
    return by.groupBy("project_name").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alignment", "n"))))).alias("statuses"))


def occurrences(text: Column, word: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def representatives(rows: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], group: str = "project_name", text: str = "opinion") -> list[tuple[str, str]]:
    """For each spec in turn the unused group that holds its hints most often: (spec, group).

    Counts are one aggregation; only the best ``len(specs)`` groups of each spec reach the driver, which is enough for the
    greedy pick.
    """
    sums = rows.where(tx.blank(F.col(group)) != "").groupBy(group).agg(*[sum((F.sum(occurrences(tx.blank(F.col(text)), h)) for h in hints), F.lit(0)).alias(f"s{i}") for i, (_, hints) in enumerate(specs)])
    used, out = set(), []
    for i, (name, _) in enumerate(specs):
        best = sums.where(F.col(f"s{i}") > 0).orderBy(F.desc(f"s{i}"), group).select(group).limit(len(specs)).collect()
        pick = next((r[0] for r in best if r[0] not in used), None)
        if pick is not None:
            used.add(pick)
            out.append((name, pick))
    return out


def benchmark_cases(rows: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], group: str = "project_name") -> DataFrame:
    """(spec, group, hints, opinions, dimensions, work_categories) of the representative group of each spec: its opinions in
    order, and the sorted distinct dimensions and categories of classified rows."""
    hints = dict(specs)
    picks = rows.sparkSession.createDataFrame([(s, g, list(hints[s])) for s, g in representatives(rows, specs, group)], f"spec string, {group} string, hints array<string>")
    said = F.transform(F.sort_array(F.collect_list(F.struct("row_index", "item_index", "opinion"))), lambda s: s["opinion"])
    cases = rows.join(F.broadcast(picks.select(group)), group, "left_semi").groupBy(group).agg(said.alias("opinions"), F.sort_array(F.collect_set("dimension")).alias("dimensions"), F.sort_array(F.collect_set("work_category")).alias("work_categories"))
    return picks.join(cases, group)


# --- from cards to findings and evidence ---


def work_item(c: Column, markers: Sequence[str], default: Column, least: int = 2, most: int = 18) -> Column:
    """The subject of an opinion: its text before the earliest marker, without item numbers, if its length fits."""
    text = tx.compact(c)
    first = F.array_min(F.filter(F.transform(tx.strings(markers), lambda m: F.instr(text, m)), lambda p: p > 1))
    subject = F.trim(F.regexp_replace(F.left(text, first - 1), r"^[0-9一二三四五六七八九十]+[、.)）]\s*", ""), F.lit(" ，。；:："))
    fits = first.isNotNull() & F.length(subject).between(least, most)
    return F.when(fits, subject).otherwise(default)


def recommendation(partial: Column, absent: Column, templates: dict[str, str], base: Column) -> Column:
    """What to write: vague points to make exact, missing points to add, the templates of both, then the base text."""
    table = F.create_map(*[x for k, v in templates.items() for x in (F.lit(k), F.lit(v))]) if templates else F.create_map().cast("map<string,string>")
    lines = F.array_distinct(F.filter(F.transform(F.concat(partial, absent), lambda n: table[n]), lambda v: v.isNotNull()))
    part = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, ", ")))
    wording = F.when(F.size(lines) > 0, F.concat(F.lit("write: "), F.array_join(lines, "; ")))
    return F.concat_ws("\n", part("make exact: ", partial), part("add: ", absent), wording, F.nullif(base, F.lit("")))


def worded(cards_: DataFrame, markers: Sequence[str], cost_hint: str) -> DataFrame:
    """Cards with what ``card_findings`` takes from their opinion alone: ``work_item`` and ``hinted``."""
    return cards_.withColumn("work_item", work_item(F.col("opinion"), markers, F.col("work_category"))).withColumn("hinted", F.col("opinion").rlike(cost_hint))


def card_findings(aligned: DataFrame, markers: Sequence[str], templates: dict[str, str], cost_hint: str, base: str = "") -> DataFrame:
    """Findings of aligned cards (doc_id, card_id, opinion, work_category, match_scope and what ``assess`` adds): resolved
    ones go; another project's also needs a template for an open point, and no cost or measure hint in its opinion. Opinions
    that ``worded`` has seen are not read again."""
    if not {"work_item", "hinted"} <= set(aligned.columns):
        aligned = worded(aligned, markers, cost_hint)
    open_ = F.concat("partial", "absent")
    mapped = F.exists(open_, lambda n: n.isin(*templates)) if templates else F.lit(False)
    kept = aligned.where((F.col("alignment") != "resolved") & ((F.col("match_scope") != "cross_project") | (mapped & ~F.col("hinted"))))
    rows = kept.select("doc_id", "card_id", "work_item", F.col("opinion").alias("finding"), recommendation(F.col("partial"), F.col("absent"), templates, F.lit(base)).alias("recommendation"), "alignment")
    order = Window.partitionBy("doc_id", "work_item", "finding").orderBy("card_id")
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def realigned(matched: DataFrame, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] = ()) -> DataFrame:
    """Cards assessed anew against another document: rows with the card's opinion, its own alignment and scheme_gap, and the
    document's text as evidence. The card's old verdict and gap stay as source_alignment and source_scheme_gap."""
    old = [F.col("alignment").alias("source_alignment"), F.col("scheme_gap").alias("source_scheme_gap")]
    plain = [c for c in matched.columns if c not in ("alignment", "scheme_gap", "assessments", "covered", "partial", "absent")]
    out = assess(matched.select(*plain, *old), points, fallback)
    return out.withColumn("scheme_gap", gap(F.col("alignment"), F.col("evidence"), F.col("covered"), F.col("partial"), F.col("absent"))).withColumn("alignment_basis", F.lit("current_scheme"))


def experience_search(queries: DataFrame, cards_: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, card_id, place): cards whose triggers stand in the query; for queries without any, cards whose opinion holds
    one of the query's words."""
    hit = match_cards(queries, cards_, doc="query_id", text="query", limit=k, least=1).select("query_id", "card_id", "place")
    lost = queries.join(hit.select("query_id").distinct(), "query_id", "left_anti")
    word = lost.select("query_id", F.explode(F.transform(tx.query_tokens(F.col("query")), lambda t: F.lower(t))).alias("word"))
    opinions_ = cards_.select(F.col("card_id").alias("__card"), F.lower("opinion").alias("__t"))
    near = word.join(sc.hits(opinions_, "__card", "__t", word, "word"), "word").select("query_id", F.col("__card").alias("card_id")).distinct()
    order = Window.partitionBy("query_id").orderBy("card_id")
    return hit.unionByName(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))


#: What a summary of a card tells.
SUMMARY = ("project_name", "work_category", "opinion", "alignment", "absent", "partial", "scheme_gap", "generalization_rule")


def experience_summaries(queries: DataFrame, cards_: DataFrame, texts: DataFrame, points: Sequence[Checkpoint], fallback: Sequence[Checkpoint] = (), k: int = 3) -> DataFrame:
    """(query_id, answer): the cards found for each query, aligned to the text that it asks about, as a JSON array in order.
    ``queries``: query_id, query, doc_id; ``texts``: doc_id, text; cards: what ``realigned`` and ``SUMMARY`` name."""
    hit = experience_search(queries, cards_, k).join(queries.select("query_id", "doc_id"), "query_id")
    rows = hit.join(cards_, "card_id").join(texts.select("doc_id", F.col("text").alias("evidence")), "doc_id", "left")
    told = realigned(rows, points, fallback).select("query_id", "place", F.struct(*SUMMARY).alias("s"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", F.to_json("s", {"ignoreNullFields": "false"}).alias("s")))), lambda x: x["s"])
    return told.groupBy("query_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("answer"))


def fetch(actions: DataFrame, found: DataFrame, experience: DataFrame, texts: DataFrame, size: int = 1200) -> DataFrame:
    """Results of planned actions (doc_id, query_id, tool, query): ``standards`` reads retrieved answers (query_id, answer),
    ``experience`` reads card summaries (query_id, answer), ``snippet`` cuts the document's own text around the query."""
    s = actions.where("tool = 'standards'").join(found, "query_id", "left")
    e = actions.where("tool = 'experience'").join(experience, "query_id", "left")
    words = F.split(F.col("query"), " ")
    n = actions.where("tool = 'snippet'").join(texts.select("doc_id", "text"), "doc_id", "left").withColumn("answer", tx.snippet(F.col("text"), words, size)).drop("text")
    return s.unionByName(e).unionByName(n).withColumn("answer", F.left(tx.blank(F.col("answer")), F.lit(size)))
