"""License scans by sentence rules (native expressions only).

Indentation and comment marks are taken from the lines, wrapped lines are joined, texts are cut
into sentences, and normalised sentences are mapped to the identifiers of known licence
sentences (0 for any other; a sentence that is unknown as a whole is tried line by line, for
notices that stand beside a heading). The identifier sequence of a document is then matched
against ordered rules: a rule takes the places where its identifiers follow each other, and what
it has taken is not open to later, shorter rules. A text that only reserves all rights is told
where no other rule fits. Everything is row-local: no shuffle, and the two fixed tables travel
inside the plan; a hash test keeps sentences that are not known from the table.

Defined results: null and empty texts have no sentences and no licence; a sentence that
occurs repeatedly counts each time; repeated rows, and rows with a null id, are scanned each; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii

# The clauses of the BSD licences, and how they are numbered.
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
BSD_NUMBERS = [("1. ", "2. ", "3. "), ("* ", "* ", "* "), ("(1) ", "(2) ", "(3) "), ("1) ", "2) ", "3) "), ("a. ", "b. ", "c. "), ("(a) ", "(b) ", "(c) ")]
_BSD = [(f"BSD-{n}-Clause", " ".join([BSD_OPENING, *(m + c for m, c in zip(style[:n], BSD_CLAUSES, strict=False))])) for n in (3, 2) for style in BSD_NUMBERS]

# The titles that licence files begin with.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
]

# Identifiers that tags in source files name.
SPDX = [
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]

# Fixed values: (licence, wording of a licence or notice), in the order in which rules are tried.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *_BSD,
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    *TITLES,
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in SPDX),
]

# What reserves rights without granting any.
RESERVED = ["All rights reserved."]
ALL_RIGHTS = "All-Rights-Reserved"

# Runs of single characters only, so that a match needs neither recursion nor a second look, however long a run is.
_BLANKS = r"[ \t\r]+"
# What may stand before the text of a line: indentation and marks of comments, quotes and list bullets.
_MARKS = r'(^|\n)[ /#*;%><!"-]+'
_BLANK_LINES = r" ?\n ?\n[ \n]*"
_WRAP, _END = "\x1e", "\x1d"
_STOP = r"([.!?;:])[ \x1e]+"


def cut(text: str) -> list[str]:
    """Normalised sentences of a fixed text, as ``sentences`` has them."""
    bare = re.sub(_BLANK_LINES, _END, re.sub(_MARKS, r"\1", re.sub(_BLANKS, " ", text)))
    found = re.sub(_STOP, rf"\1{_END}", bare.replace("\n", _WRAP)).split(_END)
    plain = [" ".join(re.sub("[^a-z0-9]+", " ", s.translate(str.maketrans(UPPER, LOWER))).split()) for s in found]
    return [s for s in plain if s]


def rule_tables(notices: list[tuple[str, str]] = NOTICES, reserved: list[str] = RESERVED) -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Known sentences with their identifiers, from 1, and the ordered rules over these; ALL_RIGHTS rules come last."""
    known: dict[str, int] = {}
    rules = []
    for name, wording in [*notices, *[(ALL_RIGHTS, x) for x in reserved]]:
        rules.append((name, tuple(known.setdefault(s, len(known) + 1) for s in cut(wording))))
    return known, rules


def _plain(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(sentence), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences as they are, with a mark where a line was wrapped."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "), _MARKS, "$1")
    joined = F.replace(F.regexp_replace(bare, _BLANK_LINES, _END), F.lit("\n"), F.lit(_WRAP))
    return F.filter(F.split(F.regexp_replace(joined, _STOP, f"$1{_END}"), _END), lambda s: s.rlike("[A-Za-z0-9]"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] = NOTICES, reserved: list[str] = RESERVED,
) -> DataFrame:
    """Per row of docs: doc_id, n_sentences, n_known, known (identifiers in order), licenses, license (of the first rule)."""
    known, rules = rule_tables(notices, reserved)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    hashes = F.array(*[F.xxhash64(F.lit(s)) for s in known])
    number = lambda s: F.when(F.array_contains(hashes, F.xxhash64(s)), F.coalesce(F.try_element_at(table, s), F.lit(0))).otherwise(0)
    lines = lambda s: F.transform(F.split(s, _WRAP), lambda x: number(_plain(x)))

    def numbers(s: Column) -> Column:
        whole = number(_plain(s))
        return F.when((whole == 0) & F.contains(s, F.lit(_WRAP)), lines(s)).otherwise(F.array(whole))

    d = docs.select(F.col(id_col).alias("doc_id"), sentences(F.col(text_col)).alias("_s"))
    d = d.select("doc_id", F.size("_s").cast("long").alias("n_sentences"), F.flatten(F.transform("_s", numbers)).alias("_i"))
    # each identifier between bars of its own, so that a sequence is a plain substring; bars of taken places become #
    shown = F.concat_ws("", F.transform("_i", lambda i: F.concat(F.lit("|"), i.cast("string"), F.lit("|"))))
    d = d.select("doc_id", "n_sentences", F.filter("_i", lambda i: i > 0).alias("_known"), shown.alias("_q"))
    d = d.withColumn("_q", F.when(F.size("_known") > 0, F.col("_q")).otherwise(""))
    taken = F.struct(F.col("_q").alias("q"), F.array().cast("array<string>").alias("names"))
    table_of_rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("".join(f"|{i}|" for i in ids)).alias("ids")) for n, ids in rules])

    def take(state: Column, rule: Column) -> Column:
        left = F.replace(state["q"], rule["ids"], F.lit("#"))
        names = F.when(left != state["q"], F.array_append(state["names"], rule["name"])).otherwise(state["names"])
        return F.struct(left.alias("q"), names.alias("names"))

    names = F.when(F.size("_known") > 0, F.aggregate(table_of_rules, taken, take)["names"]).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_n", F.array_distinct(names)).withColumn("_g", F.filter("_n", lambda x: x != ALL_RIGHTS))
    found = F.when(F.size("_g") > 0, F.col("_g")).otherwise(F.col("_n"))
    return d.select(
        "doc_id", "n_sentences", F.size("_known").cast("long").alias("n_known"),
        F.array_join(F.transform("_known", lambda i: i.cast("string")), ",").alias("known"),
        F.array_join(found, ",").alias("licenses"), F.get(found, F.lit(0)).alias("license"),
    )


def scan_sql(table: str = "documents", notices: list[tuple[str, str]] = NOTICES, reserved: list[str] = RESERVED) -> str:
    """The same result as SQL."""
    known, rules = rule_tables(notices, reserved)
    pairs = ", ".join(f"('{s}', {k})" for s, k in known.items())
    wrap, end = "chr(30)", "chr(29)"
    marks = _MARKS.replace("'", "''")
    text = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'), '{marks}', '\\\\1', 'g')"
    text = f"replace(regexp_replace({text}, '{_BLANK_LINES}', {end}, 'g'), chr(10), {wrap})"
    text = f"string_split(regexp_replace({text}, '{_STOP}', '\\1' || {end}, 'g'), {end})"
    plain = f"trim(regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    stages, last = [], "shown"
    for k, (_, ids) in enumerate(rules):
        pattern = "".join(f"|{i}|" for i in ids)
        stages.append(f"r{k} AS (SELECT *, replace(q{k}, '{pattern}', '#') AS q{k + 1} FROM {last})")
        last = f"r{k}"
    # the first place of each licence, in rule order
    order = [n for n in dict.fromkeys(name for name, _ in rules) if n != ALL_RIGHTS]
    first = lambda name: "coalesce(" + ", ".join(f"CASE WHEN q{k + 1} <> q{k} THEN {k} END" for k, (n, _) in enumerate(rules) if n == name) + ", NULL)"
    rank = ", ".join(f"CASE WHEN {first(name)} IS NOT NULL THEN {{'place': {first(name)}, 'licence': '{name}'}} END" for name in order)
    return f"""
WITH known(sentence, id) AS (VALUES {pairs}),
whole AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {table}),
cut AS (SELECT rid, unnest({text}) AS x, generate_subscripts({text}, 1) AS pos FROM whole),
full_ AS (SELECT rid, pos, x, coalesce(id, 0) AS i FROM cut LEFT JOIN known ON {plain.format('x')} = sentence WHERE regexp_matches(x, '[A-Za-z0-9]')),
parts AS (SELECT rid, pos, unnest(string_split(x, {wrap})) AS y, generate_subscripts(string_split(x, {wrap}), 1) AS part FROM full_ WHERE i = 0 AND contains(x, {wrap})),
mapped AS (SELECT rid, pos, 0 AS part, i FROM full_ WHERE i > 0 OR NOT contains(x, {wrap})
  UNION ALL SELECT rid, pos, part, coalesce(id, 0) FROM parts LEFT JOIN known ON {plain.format('y')} = sentence),
counted AS (SELECT rid, count(*) AS n FROM full_ GROUP BY rid),
shown AS (
  SELECT r.rid, any_value(r.doc_id) AS doc_id, coalesce(any_value(c.n), 0) AS n_sentences, count(CASE WHEN i > 0 THEN 1 END) AS n_known,
    coalesce(string_agg(CASE WHEN i > 0 THEN CAST(i AS VARCHAR) END, ',' ORDER BY pos, part), '') AS known,
    coalesce(string_agg('|' || i || '|', '' ORDER BY pos, part), '') AS q0
  FROM whole r LEFT JOIN mapped m ON r.rid = m.rid LEFT JOIN counted c ON r.rid = c.rid GROUP BY r.rid),
{", ".join(stages)},
named AS (SELECT *, list_transform(list_sort(list_filter([{rank}], lambda y: y IS NOT NULL)), lambda y: y.licence) AS g,
  CASE WHEN {first(ALL_RIGHTS)} IS NOT NULL THEN ['{ALL_RIGHTS}'] ELSE [] END AS a FROM {last}),
chosen AS (SELECT *, CASE WHEN len(g) > 0 THEN g ELSE a END AS l FROM named)
SELECT doc_id, n_sentences, n_known, known, coalesce(array_to_string(l, ','), '') AS licenses, l[1] AS license FROM chosen
"""
