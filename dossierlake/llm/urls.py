"""URL filters with redirect equivalence, in DataFrame functions alone.

Rules name a host (and all its subdomains) and the start of a path; the longest that fits a url decides. Redirects
(``<meta http-equiv=refresh>``) and canonical links of the pages are edges between urls; the connected components of
these edges are sets of aliases. A block decision on one alias holds for every alias that no rule names; a page's own
rule, an explicit allow above all, stands before anything that is propagated.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is
allowed; null or empty html gives no edges; relative targets are resolved against the page's url; urls of one normal form
(``resource``) are one node; targets in comments are no edges, character references in attributes are resolved; repeated
rows each get their row; of an allow and a block rule of the same length, allow wins; other columns are ignored, keys are
carried by place and may not be named as a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, output_names, written

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

HOST, PATH, SCHEME = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)", r"(?s)^(.*?)://"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: The named character references that a url's attribute needs.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
LINK, META = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
IS_CANONICAL, IS_REFRESH = r"(?i)\brel\s*=\s*[\"']?canonical\b", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF, REFRESH = r"(?i)(?:^|[\s\"'/])href\s*=\s*[\"']?([^\"'\s>]+)", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def decision(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (size, allow, rule); null if none does. One expression, no shuffle."""
    table = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"), r["rule"].alias("rule"))))


def resource(url: Column) -> Column:
    """A url in its normal form, after RFC 3986: scheme and host in lower case, no default port, no dot segments, at least a
    slash for a path, no fragment; null where it has no ``://``."""
    cut = F.regexp_replace(url, r"(?s)#.*\z", "")
    scheme = F.lower(F.regexp_extract(cut, SCHEME, 1))
    port = F.when(scheme == "http", r":(80)?$").when(scheme == "https", r":(443)?$").otherwise(":$")
    query = F.regexp_extract(cut, r"(?s)^[^?]*(\?.*)\z", 1)
    return F.when(F.contains(cut, F.lit("://")), F.concat(scheme, F.lit("://"), F.regexp_replace(host(cut), port, F.lit("")), straight(path(cut)), query))


def straight(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``; it starts with a slash."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, s)))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def decoded(value: Column) -> Column:
    """An attribute's value with its character references resolved: numbers up to 10FFFF, and the names of ``ENTITIES``."""

    def piece(p: Column) -> Column:  # what stands after an ampersand
        tens, hexs = F.regexp_extract(p, r"^#([0-9]{1,7});", 1), F.regexp_extract(p, r"^#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(tens != "", tens.try_cast("int")).when(hexs != "", F.conv(hexs, 16, 10).try_cast("int"))
        letter = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, own in ENTITIES.items():
            letter = F.when(F.startswith(p, F.lit(f"{name};")), own).otherwise(letter)
        return F.coalesce(F.concat(letter, F.regexp_replace(p, r"(?s)^[^;]*;", "")), F.concat(F.lit("&"), p))

    parts = F.split(value, "&")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))


def resolve(base: Column, target: Column) -> Column:
    """A target as it stands, against its page's normal form: a url, or null where it has no host."""
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(origin, path(base), target))
        .otherwise(F.concat(origin, folder, target))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: redirect and canonical-link edges between the resources of ``pages``; comments hold no links."""
    tags = lambda every, kind, at: F.transform(F.filter(F.regexp_extract_all(F.col("h"), F.lit(every), 0), lambda t: F.regexp_like(t, F.lit(kind))), lambda t: decoded(F.regexp_extract(t, at, 1)))
    rows = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(resource(F.col(url)).alias("a"), F.regexp_replace(F.col(html), COMMENT, " ").alias("h"))
    found = rows.select("a", F.explode(F.concat(tags(LINK, IS_CANONICAL, HREF), tags(META, IS_REFRESH, REFRESH))).alias("t"))
    return found.where("a is not null and t <> '' and t not like '#%'").select("a", resource(resolve(F.col("a"), F.col("t"))).alias("b")).where("b is not null and a <> b").distinct()


def judge(spark: SparkSession, pages: DataFrame, keys: Sequence[str], url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """``keys`` plus host, path, rule (null if none) and verdict. ``edges(a, b)``: further aliases, such as a redirect log."""
    output_names(keys, ("host", "path", "rule", "verdict"))
    links = page_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select(resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b")).where("a is not null and b is not null"))
    alias = components(spark, written(spark, links, "links"))
    ruled = alias.withColumn("d", decision(host(F.col("node")), path(F.col("node")), rules))
    blocked = ruled.groupBy("component").agg(F.max(F.coalesce(~F.col("d.allow"), F.lit(False))).alias("hit")).where("hit").select("component")
    through = written(spark, alias.join(blocked, "component", "left_semi").select(F.col("node").alias("__node")), "blocked")
    carried = [f"__k{i}" for i in range(len(keys))]
    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(keys, carried)], resource(F.col(url)).alias("__node"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")).withColumn("__d", decision(F.col("host"), F.col("path"), rules))
    # only pages that no rule decides look up their aliases
    through = through.withColumn("__hit", F.lit(True))
    rows = rows.withColumn("__at", F.when(F.col("__d").isNull(), F.col("__node")))
    found = rows.join(through.withColumnRenamed("__node", "__at"), "__at", "left")
    named = F.when(F.col("__d.allow"), "allow").when(F.col("__d").isNotNull(), "block")
    return found.select(*[F.col(k).alias(c) for c, k in zip(keys, carried)], "host", "path", F.col("__d.rule").alias("rule"), F.coalesce(named, F.when(F.col("__hit"), "block"), F.lit("allow")).alias("verdict"))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HOST = f"translate(coalesce(regexp_extract({{u}}, '://([^/?#]*)', 1), ''), {_LOWER})"
_PATH = "coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
_NODE = rf"""CASE WHEN contains({{u}}, '://') THEN concat(lower(regexp_extract({{u}}, '(?s)^(.*?)://', 1)), '://',
  regexp_replace({_HOST}, CASE lower(regexp_extract({{u}}, '(?s)^(.*?)://', 1)) WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE ':$' END, ''), straight({_PATH}), regexp_extract({{u}}, '(?s)^[^?]*(\?.*)\z', 1)) END"""
_CUT = r"regexp_replace({u}, '(?s)#.*\z', '')"
_NAMED = "CASE " + " ".join(f"WHEN starts_with(p, '{n};') THEN '{c if c != chr(39) else chr(39) * 2}'" for n, c in ENTITIES.items())

_STRAIGHT = """(SELECT concat('/', array_to_string(k, '/'), CASE WHEN s[-1] IN ('.', '..') AND len(k) > 0 THEN '/' ELSE '' END) FROM (SELECT s, list_reduce(list_prepend([''], list_transform(s, lambda x: [x])), lambda acc, x: CASE x[1] WHEN '.' THEN acc WHEN '..' THEN CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END ELSE list_concat(acc, x) END)[2:] AS k FROM (SELECT string_split(regexp_replace({p}, '^/', ''), '/') AS s)))"""
_NODE = _NODE.replace(f"straight({_PATH})", _STRAIGHT.format(p=_PATH))
_TENS, _HEXS = "regexp_extract(p, '^#([0-9]{1,7});', 1)", "regexp_extract(p, '^#[xX]([0-9A-Fa-f]{1,6});', 1)"
_CODE = f"CASE WHEN {_TENS} <> '' THEN CAST({_TENS} AS INTEGER) WHEN {_HEXS} <> '' THEN CAST(concat('0x', {_HEXS}) AS INTEGER) END"
_DECODED = rf"""(SELECT concat(parts[1], array_to_string(list_transform(parts[2:], lambda p: coalesce(({_NAMED}
  WHEN {_CODE} BETWEEN 1 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr({_CODE}) END) || regexp_replace(p, '(?s)^[^;]*;', ''), concat('&', p))), '')) FROM (SELECT string_split(raw, '&') AS parts))"""

ORACLE = rf"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
cut AS (SELECT page_id, url, regexp_replace(html, '{COMMENT}', ' ', 'g') AS html, {_CUT.format(u="url")} AS u FROM pages),
res AS (SELECT page_id, url, html, {_NODE.format(u="u")} AS node FROM cut),
tags AS (
  SELECT node AS a, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?i)(?:^|[\s"''/])href\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS raw
  FROM res WHERE node IS NOT NULL),
plain AS (SELECT a, {_DECODED} AS t FROM tags),
ends AS (
  SELECT DISTINCT a, {_CUT.format(u="x")} AS u FROM (SELECT a, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t
    WHEN starts_with(t, '//') THEN concat(regexp_extract(a, '(?s)^(.*?:)//', 1), t)
    WHEN starts_with(t, '/') THEN concat(regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1), t)
    WHEN starts_with(t, '?') THEN concat(regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1), {_PATH.format(u="a")}, t)
    ELSE concat(regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1), regexp_replace({_PATH.format(u="a")}, '[^/]*$', ''), t) END AS x
  FROM plain WHERE t <> '' AND NOT starts_with(t, '#'))),
edges AS (SELECT DISTINCT a, {_NODE.format(u="u")} AS b FROM ends),
links AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
fits AS (
  SELECT u.url, r.v, concat(r.h, r.p) AS rule, row_number() OVER (PARTITION BY u.url ORDER BY length(concat(r.h, r.p)) DESC, r.v) AS k
  FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM links) u
  JOIN rules r ON ({_HOST.format(u="u.url")} = r.h OR ends_with({_HOST.format(u="u.url")}, concat('.', r.h))) AND starts_with({_PATH.format(u="u.url")}, r.p)),
best AS (SELECT url, v, rule FROM fits WHERE k = 1),
hit AS (SELECT DISTINCT reach.a AS node FROM reach JOIN best ON best.url = reach.b WHERE best.v = 'block')
SELECT page_id, {_HOST.format(u="res.url")} AS host, {_PATH.format(u="res.url")} AS path, best.rule AS rule,
  coalesce(best.v, CASE WHEN hit.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM res LEFT JOIN best ON best.url = res.url LEFT JOIN hit ON hit.node = res.node
"""
