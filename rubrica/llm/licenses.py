"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences (after ``. ! ? ;`` and at line ends), every sentence is normalised to words of
a-z and 0-9, and known licence sentences become identifiers; any other sentence is a dot.  The text
is then one short string such as ``..<12>.<13>``, and ordered rules are matched against it: a rule is a
sequence of identifiers with at most ``GAP`` unknown sentences between two of them.  A match is taken out before
the next rule is tried, so a full licence text is not reported again as the notices it contains.

Every text is read twice.  The first reading takes each line for a sentence of its own and gives n_sentences and n_known.
The second one takes comment marks and list numbers off the lines and joins those of a paragraph, so wrapped texts are
read as published; it also knows the sentences and rules of ``MORE_SENTENCES`` and ``MORE_RULES``.  Of each licence the reading
with more matches counts.  The SQL has the first reading alone: it gives the same where the second one finds no more.

Everything happens within the row: no join, no shuffle, no Python.  The tables of sentences and rules are fixed.

Results for odd input: null and empty texts have no sentences and no licence; sentences without a letter or digit
do not count; equal matches are counted each; repeated documents give one row each; only the named
columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2

# Sentences of well-known public licences and notices, as published.
SENTENCES: dict[str, str] = {
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "apache-under": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "gpl-free-semicolon": "This program is free software;",
    "gpl-free-comma": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "gpl2-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation;"
    ),
    "gpl2-later": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    ),
    "note-apache": "Licensed under the Apache License, Version 2.0.",
    "note-mit": "Released under the MIT License.",
    "note-mit-licensed": "Licensed under the MIT License.",
    "note-gpl3": "This work is licensed under the GNU General Public License, version 3.",
    "note-by-nc": "Licensed under CC BY-NC 4.0.",
    "note-by": "Licensed under CC BY 4.0.",
    "note-by-sa": "Licensed under CC BY-SA 4.0.",
    "note-cc0": "Released into the public domain under CC0 1.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "rights": "All rights reserved.",
}

# Licence names and the sentences that make them, most specific first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-under", "apache-comply", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-under", "apache-comply")),
    ("GPL-3.0-or-later", ("gpl-free-comma", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-free-semicolon", "gpl2-terms", "gpl2-later")),
    ("GPL-3.0-or-later", ("gpl-free-comma",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-under",)),
    ("Apache-2.0", ("note-apache",)),
    ("MIT", ("note-mit",)),
    ("MIT", ("note-mit-licensed",)),
    ("GPL-3.0-only", ("note-gpl3",)),
    ("CC-BY-NC-4.0", ("note-by-nc",)),
    ("CC-BY-SA-4.0", ("note-by-sa",)),
    ("CC-BY-4.0", ("note-by",)),
    ("CC0-1.0", ("note-cc0",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("all-rights-reserved", ("rights",)),
)

# Further licences, known to the second reading.
MORE_SENTENCES: dict[str, str] = {
    "lgpl-free": "This library is free software;",
    "lgpl-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation;"
    ),
    "lgpl21-later": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "agpl3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
MORE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl21-later")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2",)),
    ("Unlicense", ("unlicense",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT, NOISE = "([.!?;])[ \\t\\r]+", "[^a-z0-9\\n]+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def pattern(sequence: tuple[str, ...]) -> str:
    """The rule as an expression over the identifier string of a text."""
    numbers = {name: i for i, name in enumerate(SENTENCES | MORE_SENTENCES)}
    return f"[.]{{0,{GAP}}}".join(f"<{numbers[name]}>" for name in sequence)


def unwrapped(text: Column) -> Column:
    """The text with a line per paragraph, without comment marks and list numbers."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\r", "")
    for found, instead in (
        ("(?md)^[ \\t/*#;%>!|-]++(?:(?i:rem|dnl)\\b[ \\t]*+)?", ""),
        ("(?mdi)^(?:rem|dnl)\\b[ \\t]*+", ""),
        ("(?md)^[(]?[0-9a-zA-Z][.)][ \\t]++", "\n"),
        ("(?mdi)^((?:portions )?copyright|[(]c[)]|spdx-|all rights reserved)([^\\n]*+)\\n", "$1$2\n\n"),
        ("(?mdi)(conditions|met):[ \\t]*+\\n", "$1:\n\n"),
        ("(?<!\\n)\\n(?!\\n)", " "),
    ):
        plain = F.regexp_replace(plain, found, instead)
    return plain


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifier string: ``<n>`` for a known sentence, a dot for any other."""
    known = F.create_map(*(F.lit(x) for i, s in enumerate(sentences.values()) for x in (normal(s), f"<{i}>")))
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    clean = F.regexp_replace(F.regexp_replace(lowered, CUT, "$1\n"), NOISE, " ")
    sentences = F.filter(F.transform(F.split(clean, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    marks = F.transform(sentences, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(".")))
    return F.array_join(marks, "")


EMPTY = "cast(array() as array<struct<licence:string,n:int>>)"


def _matches(ids: str, ordered: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """(licence, count) by rule, in rule order."""
    rules = F.array(
        *(
            F.struct(F.lit(name).alias("licence"), F.lit(pattern(sequence)).alias("pattern"))
            for name, sequence in ordered
        )
    )

    def step(state: Column, rule: Column) -> Column:
        n = F.regexp_count(state["rest"], rule["pattern"])
        found = F.array(F.struct(rule["licence"].alias("licence"), n.alias("n")))
        return F.struct(
            F.regexp_replace(state["rest"], rule["pattern"], F.lit("#")).alias("rest"),
            F.when(n > 0, F.concat(state["found"], found)).otherwise(state["found"]).alias("found"),
        )

    empty = F.expr(EMPTY)
    start = F.struct(F.col(ids).alias("rest"), empty.alias("found"))
    matched = F.aggregate(rules, start, step, lambda state: state["found"])
    return F.when(F.col(ids).contains("<"), matched).otherwise(empty)


def _count(found: Column, licence: Column) -> Column:
    own = F.filter(found, lambda m: m["licence"] == licence)
    return F.aggregate(own, F.lit(0), lambda a, m: a + m["n"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, n_sentences, n_known, matches (licence, count by rule, in rule order)."""
    n_known = F.length(F.regexp_replace("ids", "[^<]+", ""))
    lines, joined = F.col("by_line"), F.col("by_paragraph")
    better = F.filter(joined, lambda m: _count(joined, m["licence"]) > _count(lines, m["licence"]))
    rest = F.filter(lines, lambda m: _count(lines, m["licence"]) >= _count(joined, m["licence"]))
    return (
        docs.select(
            F.col(key).alias("key"),
            identifiers(F.col(text)).alias("ids"),
            identifiers(unwrapped(F.col(text)), SENTENCES | MORE_SENTENCES).alias("joined"),
        )
        .select(
            F.col("key").alias(key),
            (F.length(F.regexp_replace("ids", "[0-9]+>", ""))).cast("bigint").alias("n_sentences"),
            n_known.cast("bigint").alias("n_known"),
            _matches("ids", RULES).alias("by_line"),
            _matches("joined", MORE_RULES + RULES).alias("by_paragraph"),
        )
        .select(key, "n_sentences", "n_known", F.concat(better, rest).alias("matches"))
    )


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of matches and the licences of a document, in alphabetical order."""
    total = F.aggregate("matches", F.lit(0).cast("bigint"), lambda a, m: a + m["n"])
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select(
        key, "n_sentences", "n_known", total.alias("n_matches"), F.array_join(names, ",").alias("licences")
    )


def oracle_sql() -> str:
    """The same result as one statement: known sentences as a table, one step per rule."""
    known = ", ".join(f"('{normal(s)}', '<{i}>')" for i, s in enumerate(SENTENCES.values()))
    steps, names = "", sorted({name for name, _ in RULES})
    counts: dict[str, list[str]] = {name: [] for name in names}
    for k, (name, sequence) in enumerate(RULES):
        rule = pattern(sequence)
        steps += (
            f", r{k + 1} as (select *, len(regexp_extract_all(s{k}, '{rule}')) as c{k}, "
            f"regexp_replace(s{k}, '{rule}', '#', 'g') as s{k + 1} from r{k})"
        )
        counts[name].append(f"c{k}")
    licences = ", ".join(f"case when {' + '.join(counts[n])} > 0 then '{n}' end" for n in names)
    total = " + ".join(c for group in counts.values() for c in group)
    return (
        f"with known(s, mark) as (values {known}), "
        "pieces as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), "
        f"'{UPPER}', '{LOWER}'), '([.!?;])[ \\t\\r]+', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)))"
        " as piece, generate_subscripts(string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), "
        f"'{UPPER}', '{LOWER}'), '([.!?;])[ \\t\\r]+', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)),"
        " 1) as pos from documents), "
        "marked as (select doc_id, pos, coalesce(mark, '.') as mark from pieces left join known on s = trim(piece) "
        "where trim(piece) <> ''), "
        "joined as (select doc_id, string_agg(mark, '' order by pos) as ids, count(*) as n, "
        "count(*) filter (where mark <> '.') as k from marked group by doc_id), "
        "r0 as (select d.doc_id, coalesce(n, 0) as n_sentences, coalesce(k, 0) as n_known, coalesce(ids, '') as s0 "
        f"from documents d left join joined j on d.doc_id = j.doc_id){steps} "
        f"select doc_id, n_sentences, n_known, {total} as n_matches, concat_ws(',', {licences}) as licences "
        f"from r{len(RULES)}"
    )
