"""Licence scans by sentence rules, in DataFrame functions alone.

A text is normalised and known licence sentences are looked for in it: they start and end at punctuation, a blank line
or a line's end, and may be wrapped over lines, with comment marks before each; the sequence of identifiers found in a
text is matched against ordered licence rules. A rule fires where its identifiers stand next to
each other in that sequence (other sentences may lie between). Known sentences and rules are parameters, held in the
plan as literals; everything happens in the scan's own rows, without a shuffle.

Defined cases: null and empty texts have no licence (null) and no known sentences; repeated rows each get their row;
when several rules fire, the first in order is the licence and all are listed; where one known sentence begins another,
the longer one is found; other columns are ignored, keys may not be named as a result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, output_names

#: Short licence sentences: identifier, wording. The SQL check knows these alone.
SHORT = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "ccbync4": "Licensed under CC BY-NC 4.0.",
    "ccby4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-short": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.",
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-use": "You may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
#: Ordered rules over the short sentences: licence, identifiers in sequence.
SHORT_RULES = (
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "asis")),
    ("Apache-2.0", ("apache2-short", "apache2-use", "apache2-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-work",)),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-short",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-4.0", ("ccby4",)),
)

_FREE = "{{name}} is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_COPYLEFT = {"GPL-2.0-or-later": ("", "2"), "GPL-3.0-or-later": ("", "3"), "LGPL-2.0-or-later": ("Library", "2"), "LGPL-2.1-or-later": ("Lesser", "2.1"), "LGPL-3.0-or-later": ("Lesser", "3"), "AGPL-3.0-or-later": ("Affero", "3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: The sentences of the standard notices. ``{name}`` stands for words of the sentence (abbreviations do not end it); at a
#: sentence's start, for words of its line.
NOTICES = {
    "mit-grant-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-asis-full": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache2-license": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-obtain": "You may obtain a copy of the License at",
    "bsd-permit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source-full": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary-full": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {name}.",
    "bsd-name-of": "Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-hope-of": "{name} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "cc0-waived": "To the extent possible under law, {name} has waived all copyright and related or neighboring rights to {name}.",
}
NOTICES |= {f"free-{k}": _FREE.format(*v) for k, v in _COPYLEFT.items()}
NOTICES |= {f"cc-{k}-4.0": f"{{name}} is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items()}
NOTICES |= {f"cc-{k}-3.0": f"{{name}} is licensed under a Creative Commons {v.replace('NoDerivatives', 'NoDerivs')} 3.0 Unported License." for k, v in _CC.items()}
NOTICE_RULES = (
    *[("BSD-4-Clause", ("bsd-source-full", "bsd-binary-full", "bsd-advert", n)) for n in ("bsd-name", "bsd-name-of")],
    *[("BSD-3-Clause", ("bsd-source-full", "bsd-binary-full", n)) for n in ("bsd-name", "bsd-name-of")],
    ("BSD-2-Clause", ("bsd-source-full", "bsd-binary-full")),
    ("MIT", ("mit-grant-full", "mit-notice", "mit-asis-full")),
    ("Apache-2.0", ("apache2-license",)),
    *[(k, (f"free-{k}", hope)) for k in _COPYLEFT for hope in ("gpl-hope", "gpl-hope-of")],
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope-of")),
    ("MPL-2.0", ("mpl2-form",)),
    *[("ISC", (grant, "isc-asis")) for grant in ("isc-grant", "isc-grant-old")],
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("CC0-1.0", ("cc0-waived",)),
    *[(f"CC-{k}-{v}", (f"cc-{k}-{v}",)) for k in _CC for v in ("4.0", "3.0")],
)
#: The titles of whole licence texts, and further short forms: licence, sentence.
TITLES = (
    ("GPL-1.0-only", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0-only", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.1-only", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2-only", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3-only", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Artistic-1.0", 'The "Artistic License"'),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    *[(f"{a}GPL-{v}-only", text) for a, kind, v, n in (("", "", "2.0", "2"), ("", "", "3.0", "3"), ("L", "Lesser ", "2.1", "2.1"), ("L", "Lesser ", "3.0", "3")) for text in (
        f"{{name}} is free software; you can redistribute it and/or modify it under the terms of version {n} of the GNU {kind}General Public License as published by the Free Software Foundation.",
        f"{{name}} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {n} as published by the Free Software Foundation.",
        f"{{name}} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; version {n} of the License.",
    )],
    *[(k, f"SPDX-License-Identifier: {k}") for k in "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-1.1 MPL-2.0 Unlicense X11".split()],
)
NOTICES |= {f"title-{i}": text for i, (_, text) in enumerate(TITLES)}
NOTICES["x11-name"] = "Except as contained in this notice, the name of {name} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {name}."
NOTICE_RULES = (
    *[(k, (f"title-{i}",)) for i, (k, _) in enumerate(TITLES)],
    ("X11", ("mit-grant-full", "mit-notice", "mit-asis-full", "x11-name")),
    *NOTICE_RULES,
)
#: Known licence sentences, and ordered rules: licence, identifiers in sequence.
SENTENCES = SHORT | NOTICES
RULES = NOTICE_RULES + SHORT_RULES

NOT_WORD = r"[^\p{L}\p{N}\n\x01]+"
#: Before a line's words: marks of comments that are words themselves, and of lists.
MARK = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:rem|dnl)(?=[ \t])|[0-9a-z]{1,2}\)(?=[ \t]))"


def normal(text: Column) -> Column:
    """Words in lower case with one character between them: a space, a line break, or \\x01 at a sentence's sure end."""
    lower = F.regexp_replace(F.regexp_replace(ascii_lower(F.translate(text, "\x01", " ")), r"\r\n?", "\n"), MARK, "")
    words = F.regexp_replace(F.regexp_replace(lower, r"[.!?;]+(?=[ \t\n]|\z)", "\x01"), NOT_WORD, " ")
    lines = F.regexp_replace(F.regexp_replace(words, r" *\n *", "\n"), r"\n{2,}", "\x01")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \n]*\x01[ \n\x01]*", "\x01"), r"\A[ \n]+|[ \n]+\z", "")


def _normal(sentence: str) -> str:
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


#: Abbreviations in holders' names, whose full stop ends no sentence; single letters are others.
SHORTENED = "inc ltd co corp llc gmbh jr sr st dr mr mrs ms univ dept".split()
_NAME = rf"[^\x01]+?(?:(?<=[ \n](?:[a-z]|{'|'.join(SHORTENED)}))\x01[^\x01]+?)*?[ \n\x01]"
_FIRST = r"[^\n\x01]+? "


def _pattern(sentence: str) -> str:
    """Regular expression of a known sentence in a normalised text; where it has punctuation of its own, a text may be cut."""
    out = ""
    for part in re.split(r"(\{name\})", sentence):
        if part == "{name}":
            out += _NAME if out else _FIRST
            continue
        cuts = [_normal(p).replace(" ", r"[ \n]") for p in re.split(r"[.!?;:]+(?:\s|$)", part)]
        out += r"[ \n\x01]".join(c for c in cuts if c) + (r"[ \n]" if any(cuts) else "")
    return re.sub(r"\[ \\n(?:\\x01)?\]$", "", out)


def _either(patterns: Sequence[str]) -> str:
    """One expression for all: those that begin with a name read the name once."""
    named = [p.removeprefix(_FIRST) for p in patterns if p.startswith(_FIRST)]
    parts = [p for p in patterns if not p.startswith(_FIRST)] + ([f"{_FIRST}(?:{'|'.join(sorted(named, key=len, reverse=True))})"] if named else [])
    return r"(?<=\A|[\n\x01])(?:" + "|".join(sorted(parts, key=len, reverse=True)) + r")(?=[\n\x01]|\z)"


def recognise(docs: DataFrame, keys: Sequence[str], text: str = "text", sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """``keys`` plus license (first rule that fires, or null), licenses (all, array), sentences (identifiers in order)."""
    output_names(keys, ("license", "licenses", "sentences", "__seq", "__flat"))
    ids = list(sentences)
    patterns = [_pattern(sentences[i]) for i in ids]
    known = F.array(*[F.lit(rf"\A(?:{p})\z") for p in patterns])
    rare = sorted({max(_normal(s.replace("{name}", "")).split(), key=len) for s in sentences.values()})
    either = _either(patterns)
    found = F.transform(F.regexp_extract_all(normal(F.col(text)), F.lit(either), F.lit(0)), lambda s: F.array_position(F.transform(known, lambda p: F.regexp(s, p)), F.lit(True)).cast("int"))
    # a known sentence's longest word stands in the raw text too: other texts need not be cut
    hits = F.when(F.col(text).rlike("(?i)" + "|".join(rare)), F.filter(found, lambda p: p > 0))
    seq = F.coalesce(hits, F.array().cast("array<int>"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + "".join(f"{ids.index(i) + 1}," for i in want)).alias("seq")) for name, want in rules])
    flat = F.concat(F.lit(","), F.array_join(F.transform("__seq", lambda p: p.cast("string")), ","), F.lit(","))
    fired = F.array_distinct(F.transform(F.filter(table, lambda r: F.contains(F.col("__flat"), r["seq"])), lambda r: r["name"]))
    rows = docs.select(*keys, seq.alias("__seq")).withColumn("__flat", flat).withColumn("licenses", fired)
    names = F.array(*[F.lit(i) for i in ids])
    return rows.select(*keys, F.get("licenses", F.lit(0)).alias("license"), "licenses", F.transform("__seq", lambda p: F.element_at(names, p)).alias("sentences"))


_KNOWN = "[" + ", ".join("'" + _normal(s) + "'" for s in SHORT.values()) + "]"
_NAMES = "[" + ", ".join(f"'{i}'" for i in SHORT) + "]"
_RULES = "[" + ", ".join("{'name': '%s', 'seq': ',%s,'}" % (n, ",".join(str(list(SHORT).index(i) + 1) for i in want)) for n, want in SHORT_RULES) + "]"
ORACLE = rf"""
WITH seqs AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?;]*[\r\n]+|[.!?;]+[ \t]+'),
    lambda s: coalesce(list_position({_KNOWN}, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), 0)), lambda p: p > 0) AS ids
  FROM documents),
fired AS (
  SELECT doc_id, ids, list_transform(list_filter({_RULES}, lambda r: contains(concat(',', array_to_string(ids, ','), ','), r.seq)), lambda r: r.name) AS names FROM seqs),
firsts AS (SELECT doc_id, ids, list_filter(names, lambda n, i: list_position(names, n) = i) AS names FROM fired)
SELECT doc_id, names[1] AS license, array_to_string(names, ',') AS licenses, CAST(len(ids) AS BIGINT) AS n_sentences,
  array_to_string(list_transform(ids, lambda p: ({_NAMES})[p]), ',') AS sentences FROM firsts
"""
