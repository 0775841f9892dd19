"""Conditions on texts, written as data and compiled to one column expression each.

A condition is a small tree, kept in a table as JSON:

* ``{"any": [words]}``, ``{"all": [words]}``: a word stands in the text, all of them do (without regard to case);
* ``{"and": [conditions]}``, ``{"or": [conditions]}``, ``{"not": condition}``;
* ``{"pattern": expression}``: a regular expression matches;
* ``{"number": [units]}``: a number with one of the units; ``{"threshold": true}``: a number with a bound;
* ``{"near": [a, b], "within": n}``: a and b in either order, ``{"before": [a, b], "within": n}``: a, then b, with at most n
  characters between, none of which ends a sentence (``stop``, a set of characters, is another choice). Each side is a
  list of words, ``{"number": [units]}`` or ``{"pattern": ...}``;
* ``{"value": words, "unit": [units], "within": n, "least": x, "most": y}``: some number that stands at most n characters
  after one of the words, with one of the units, is in the range; numbers may be written with a decimal point.

Words are compared in lower case on both sides; a null text is an empty one. What is not known in a tree is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, contains_any

#: What a number is, what may bound it, and the characters that end a sentence.
NUMBER = r"\d+(?:\.\d+)?"
BOUND = r"(?:≥|≤|>=|<=|不超过|不小于|不少于|不大于|不低于|不高于|at least|at most)"
STOP = "。；;"
#: Characters that stand for themselves in a pattern without a mark.
PLAIN = re.compile(r"[\w一-鿿 ]")


def quoted(word: str) -> str:
    """A word as a pattern that Java and RE2 read alike."""
    return "".join(c if PLAIN.match(c) else f"\\{c}" for c in word.lower())


def words(some: Sequence[str]) -> str:
    return "(?:" + "|".join(quoted(w) for w in some) + ")"


def number(units: Sequence[str]) -> str:
    return rf"{NUMBER}\s*{words(units)}" if units else NUMBER


def side(part) -> str:
    """One end of a distance as a pattern."""
    if isinstance(part, Mapping):
        (kind, value), = part.items()
        if kind == "number":
            return number(value)
        if kind == "pattern":
            return f"(?:{value})"
        raise ValueError(f"{kind} is no end of a distance")
    return words([part] if isinstance(part, str) else part)


def pattern(spec: Mapping) -> str | None:
    """The regular expression, over the text in lower case, of a condition that is one; else None."""
    between = f"[^{spec.get('stop', STOP)}]{{0,{int(spec.get('within', 40))}}}"
    if "pattern" in spec:
        return spec["pattern"]
    if "number" in spec:
        return number(spec["number"])
    if "threshold" in spec:
        return rf"{BOUND}\s*{NUMBER}|{NUMBER}\s*{BOUND}"
    if "before" in spec:
        a, b = spec["before"]
        return f"{side(a)}{between}{side(b)}"
    if "near" in spec:
        a, b = spec["near"]
        return f"{side(a)}{between}{side(b)}|{side(b)}{between}{side(a)}"
    return None


KINDS = {"any", "all", "and", "or", "not", "pattern", "number", "threshold", "near", "before", "value"}
MORE = {"within", "stop", "unit", "least", "most"}


def compiled(spec: Mapping | str, text: Column) -> Column:
    """A condition (a tree, or its JSON) as a column over ``text``."""
    tree = json.loads(spec) if isinstance(spec, str) else spec
    kinds = set(tree) & KINDS
    if len(kinds) != 1 or set(tree) - KINDS - MORE:
        raise ValueError(f"no such condition: {tree}")
    low = F.lower(blank(text))
    found = pattern(tree)
    if found is not None:
        return F.regexp_like(low, F.lit(found))
    if "any" in tree:
        return contains_any(text, tree["any"])
    if "not" in tree:
        return ~compiled(tree["not"], text)
    if "value" in tree:
        return _in_range(tree, low)
    parts = [contains_any(text, (w,)) for w in tree["all"]] if "all" in tree else [compiled(t, text) for t in tree.get("and", tree.get("or"))]
    out = F.lit("or" not in tree)
    for p in parts:
        out = out | p if "or" in tree else out & p
    return out


def value_pattern(tree: Mapping) -> str:
    """Its first group is the number."""
    return f"{words(tree['value'])}[^{tree.get('stop', STOP)}\\d]{{0,{int(tree.get('within', 40))}}}({NUMBER})\\s*{words(tree['unit']) if tree.get('unit') else ''}"


def _in_range(tree: Mapping, low: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(low, F.lit(value_pattern(tree)), F.lit(1)), lambda n: n.try_cast("double"))
    fits = lambda n: (n >= F.lit(float(tree.get("least", "-inf")))) & (n <= F.lit(float(tree.get("most", "inf"))))
    return F.coalesce(F.exists(numbers, fits), F.lit(False))


def decided(cases: Sequence[tuple[str, Mapping | str]], text: Column, default: str) -> Column:
    """The name of the first case whose condition holds."""
    out = F.lit(default)
    for name, spec in reversed(cases):
        out = F.when(compiled(spec, text), F.lit(name)).otherwise(out)
    return out


def as_sql(spec: Mapping | str, text: str) -> str:
    """The same condition as a DuckDB expression over a column's name."""
    tree = json.loads(spec) if isinstance(spec, str) else spec
    low = f"lower(coalesce({text}, ''))"
    text_of = lambda s: "'" + s.replace("'", "''") + "'"
    found = pattern(tree)
    if found is not None:
        return f"regexp_matches({low}, {text_of(found)})"
    if "any" in tree:
        return "(" + " OR ".join([f"contains({low}, {text_of(w.lower())})" for w in tree["any"] if w.strip()] or ["false"]) + ")"
    if "all" in tree:
        return "(" + " AND ".join([f"contains({low}, {text_of(w.lower())})" for w in tree["all"]] or ["true"]) + ")"
    if "not" in tree:
        return f"(NOT {as_sql(tree['not'], text)})"
    if "value" in tree:
        return f"(len(list_filter(regexp_extract_all({low}, {text_of(value_pattern(tree))}, 1), lambda n: try_cast(n AS DOUBLE) BETWEEN {tree.get('least', '-1e308')} AND {tree.get('most', '1e308')})) > 0)"
    kind = "and" if "and" in tree else "or"
    return "(" + f" {kind.upper()} ".join([as_sql(t, text) for t in tree[kind]] or [str(kind == "and")]) + ")"
