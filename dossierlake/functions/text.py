"""Column functions for text: white space, ids, tokens, snippets, normal forms. All are built from SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Fixed value: a query word is a run of two or more Latin letters or digits, or of two to eight Han characters.
QUERY_WORD = r"[A-Za-z0-9]{2,}|[一-鿿]{2,8}"
#: What names are cleaned of (codes, dates, asides, separators), then titles, contents lines, slugs; where an
#: extract is cut into sentences, and what may not end it.
CODE, DATE, ASIDE, SEPARATORS = r"(?i)F\d{2}", r"\d{6,8}", r"[（(].*?[）)]", r"(?U)[\s_+\-—、，,：:（）()]+"
NO_TITLE = r"(?U)[^\w一-鿿]+"
LEADERS, OUTER = r"[·•…⋯.。:：]+", r"(?U)^[\s,，、一\-—]+|[\s,，、一\-—]+$"
NO_SLUG, SLUG_ENDS = r"(?U)[^\w一-鿿.-]+", r"^[._]+|[._]+$"
SENTENCE_END, LOOSE_END = r"(?<=[。；;.])\s+|\n+", "[，,；; ]+$"
#: Fixed value: the characters of Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the name space of URLs in RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_default(c: Column, default) -> Column:
    """``c``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def u_trim(c: Column) -> Column:
    """Trim of all Unicode white space, not of U+0020 alone."""
    return F.btrim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    return u_trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?U)\s+", "")


def without_markup(c: Column) -> Column:
    return clean(F.regexp_replace(blank(c), r"<[^>]+>", " "))


def safe_int(c: Column, default: int) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("int"), F.lit(default))


def tail(c: Column, n: int) -> Column:
    return F.right(u_trim(blank(c)), F.lit(n))


def head(c: Column, n: int) -> Column:
    return F.left(u_trim(blank(c)), F.lit(n))


def hash_id(prefix: str, *parts: Column) -> Column:
    """Prefix and twelve hexadecimal digits of the SHA-256 of the parts, one a line; falsy parts are empty lines."""
    whole = F.concat_ws("\n", *[F.when(p.cast("string").isin("0", "false"), "").otherwise(blank(p.cast("string"))) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.upper(F.left(F.sha2(whole, 256), F.lit(12))))


def uuid5_prefix(c: Column, n: int = 10) -> Column:
    """The first digits of the version 5 UUID of a URL-name-space name (before the version digit)."""
    return F.upper(F.left(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(c, "utf-8"))), F.lit(n)))


def ancestry(code: Column, generic: str = "GEN") -> Column:
    """A dash-separated code, then its ancestors, most specific first, and the generic code."""
    parts = F.split(code, "-")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    return F.when(blank(code).isin("", generic), F.array(F.lit(generic))).otherwise(F.array_append(F.reverse(chain), F.lit(generic)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row: inside a lambda, a column is computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any word stands in the text, without regard to case; blank words never do."""
    kept = [w.lower() for w in words if w.strip()]
    return bound(F.lower(blank(c)), lambda low: F.exists(strings(kept), lambda w: F.contains(low, w))) if kept else F.lit(False)


def hits(c: Column, words) -> Column:
    """The words (a column of arrays, or a sequence) that stand in the text, without regard to case."""
    listed = words if isinstance(words, Column) else strings(words)
    return bound(F.lower(blank(c)), lambda low: F.filter(listed, lambda w: F.contains(low, F.lower(w))))


def missing(c: Column, words: Sequence[str]) -> Column:
    low = F.lower(blank(c))
    return F.filter(strings(words), lambda w: ~F.contains(low, F.lower(w)))


def tokens(c: Column) -> Column:
    """The default tokenizer: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(WORD), 0)


def query_tokens(c: Column, generic: Sequence[str] = (), limit: int = 8, pattern: str = QUERY_WORD) -> Column:
    found = F.array_except(F.array_distinct(F.regexp_extract_all(blank(c), F.lit(pattern), 0)), strings(generic))
    return F.slice(found, 1, limit)


def snippet(c: Column, words: Column, size: int = 600) -> Column:
    """The cleaned text around the earliest hit: a third of the window before it, dots where it is cut."""
    text = clean(c)
    n = F.length(text)
    low = F.lower(text)
    first = F.array_min(F.filter(F.transform(F.filter(words, lambda w: F.trim(w) != ""), lambda w: F.instr(low, F.lower(w))), lambda p: p > 0))
    start = F.greatest(F.lit(0), first - 1 - size // 3)
    end = F.least(n, start + size)
    begin = F.when(end - start < size, F.greatest(F.lit(0), end - size)).otherwise(start)
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < n, "...").otherwise(""))
    return F.when(n <= size, text).when(first.isNull(), F.left(text, F.lit(size))).otherwise(cut)


def entity_name(c: Column, generic: Sequence[str] = ()) -> Column:
    """A name without codes, dates, parentheses, generic words and separators, for fuzzy matching."""
    x = F.regexp_replace(clean(c), CODE, "")
    x = F.regexp_replace(F.regexp_replace(x, DATE, ""), ASIDE, "")
    for w in generic:
        x = F.replace(x, F.lit(w), F.lit(""))
    return F.regexp_replace(x, SEPARATORS, "")


def title_key(c: Column) -> Column:
    """A title for matching: letters, digits and underscores in lower case."""
    return F.lower(F.regexp_replace(blank(c), NO_TITLE, ""))


def without_leaders(c: Column) -> Column:
    """A contents line without dot leaders and outer separators."""
    x = F.regexp_replace(F.regexp_replace(c, LEADERS, " "), r"(?U)\s+", " ")
    return F.regexp_replace(x, OUTER, "")


def slug(c: Column, size: int = 120) -> Column:
    x = F.regexp_replace(blank(c), NO_SLUG, "_")
    return F.left(F.regexp_replace(x, SLUG_ENDS, ""), F.lit(size))


def fallback_summary(title: Column, path: Column, text: Column, words: Sequence[str], size: int = 360, least: int = 12) -> Column:
    """An extractive summary: the first four sentences with normative words, else the first four of any kind."""
    body = without_markup(text)
    name = F.coalesce(F.nullif(F.array_join(F.filter(path, lambda p: F.trim(p) != ""), " > "), F.lit("")), title)
    parts = F.filter(F.transform(F.split(body, SENTENCE_END), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
    good = F.filter(parts, lambda p: F.exists(strings(words), lambda w: F.contains(p, w)))
    kept = F.slice(F.when(F.size(good) > 0, good).otherwise(parts), 1, 4)
    excerpt = F.coalesce(F.nullif(F.array_join(kept, "; "), F.lit("")), F.left(body, F.lit(size)))
    whole = F.concat(F.lit("path: "), name, F.lit(". key: "), excerpt)
    return F.when(body == "", F.concat(F.lit("node: "), name)).otherwise(F.regexp_replace(F.left(whole, F.lit(size)), LOOSE_END, ""))
