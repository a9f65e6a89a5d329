"""License scans by sentence rules, in DataFrame functions only.

A text is divided into sentences, each sentence is normalised and looked up in a table of known
license sentences, and the sequence of identifiers found is matched against ordered rules. A
rule that matches takes its sentences out of the sequence, so a later, more general rule can't
claim them again. Other sentences between known ones are passed over.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known sentences. All identifiers have two letters or more.
SENTENCES = {
    "MitBy": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
        "Distributed under the MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "MitGrant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "MitNotice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software",
    ],
    "MitWarranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "MitLiability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE",
    ],
    "ApacheBy": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "Released under the Apache License, Version 2.0",
        "This project is licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "ApacheCompliance": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "ApacheAsIs": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "ApacheSee": [
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "BsdGrant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "BsdSource": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer",
    ],
    "BsdBinary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "BsdEndorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ],
    "BsdBy2": ["Released under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BsdBy3": ["Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "GplBy2": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GplBy3": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GplFree2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version",
    ],
    "GplFree3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
    ],
    "GplHope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "GplDetails": ["See the GNU General Public License for more details"],
    "LgplBy": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AgplBy": [
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MplBy": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "IscGrant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "UnlicenseFree": ["This is free and unencumbered software released into the public domain"],
    "CcZero": ["Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and license"],
    "CcBy": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CcBySa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CcByNc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CcByNcNd": ["Licensed under CC BY-NC-ND 4.0"],
    "Reserved": ["All rights reserved"],
}

# The rules over whole sentences, in the order in which they are tried.
_RULES = [
    ("MIT", ["MitGrant", "MitNotice", "MitWarranty", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitWarranty"]),
    ("MIT", ["MitGrant"]),
    ("Apache-2.0", ["ApacheBy", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheBy", "ApacheCompliance"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["GplFree3", "GplHope", "GplDetails"]),
    ("GPL-3.0-or-later", ["GplFree3"]),
    ("GPL-2.0-or-later", ["GplFree2", "GplHope", "GplDetails"]),
    ("GPL-2.0-or-later", ["GplFree2"]),
    ("ISC", ["IscGrant"]),
    ("MIT", ["MitBy"]),
    ("Apache-2.0", ["ApacheBy"]),
    ("BSD-2-Clause", ["BsdBy2"]),
    ("BSD-3-Clause", ["BsdBy3"]),
    ("GPL-2.0-only", ["GplBy2"]),
    ("GPL-3.0-only", ["GplBy3"]),
    ("LGPL-2.1-only", ["LgplBy"]),
    ("AGPL-3.0-only", ["AgplBy"]),
    ("MPL-2.0", ["MplBy"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("CC0-1.0", ["CcZero"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNd"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("all-rights-reserved", ["Reserved"]),
]

# A sentence ends at marks before white space or the end of the text; a sentence that is unknown
# as a whole is also tried line by line. Every known sentence has one of the keywords.
SENTENCE_END = r"[.!?;:]+[ \t\r\n]+"
NOISE = r"[^a-z0-9.]+"
EDGES = r"^[ .]+|[ .]+$"
KEYWORDS = (
    "licen",
    "permission",
    "redistribut",
    "warrant",
    "copyright",
    "endorse",
    "liable",
    "reserved",
    "public domain",
    "free software",
    "mit",
    "apache",
    "bsd",
    "gpl",
    "2.0",
)


def normal(sentence: str) -> str:
    """The normal form of one sentence: lower-case letters, digits and inner dots between single
    spaces, in the spelling ``license``."""
    sentence = sentence.lower().replace("licence", "license")
    return re.sub(EDGES, "", re.sub(NOISE, " ", sentence))


def _parts(sentence: str) -> list[str]:
    """Normal forms of the parts that the scan divides a known sentence into."""
    return [x for x in map(normal, re.split(SENTENCE_END, sentence + " ")) if x]


def known_sentences() -> dict[str, str]:
    """Normal form and identifier of every part of every known sentence. The only part of a sentence
    has its identifier; others have that of the first sentence with the part, and a number."""
    known = {parts[0]: name for name, all_ in SENTENCES.items() for s in all_ if len(parts := _parts(s)) == 1}
    for name, all_ in SENTENCES.items():
        for i, part in enumerate(x for s in all_ if len(_parts(s)) > 1 for x in _parts(s)):
            known.setdefault(part, f"{name}Part{i + 1}")
    return known


def _expanded() -> list[tuple[str, list[str]]]:
    """The rules over parts: one for each way to write the sentences of a rule."""
    known = known_sentences()
    ways = {}
    for name, all_ in SENTENCES.items():
        written = [tuple(known[x] for x in _parts(s)) for s in all_]
        ways[name] = list(dict.fromkeys(written))
    return [
        (name, [x for way in chosen for x in way]) for name, wanted in _RULES for chosen in product(*map(ways.get, wanted))
    ]


# Parts are sentences of their own, so that each identifier has its entry.
SENTENCES |= {name: [part] for part, name in known_sentences().items() if name not in SENTENCES}
RULES = _expanded()


def sentence_identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    table = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])

    def identifier(sentence: Column) -> Column:
        sentence = F.replace(F.lower(sentence), F.lit("licence"), F.lit("license"))
        return F.try_element_at(table, F.regexp_replace(F.regexp_replace(sentence, NOISE, " "), EDGES, ""))

    def known(sentence: Column) -> Column:
        whole = F.array(identifier(sentence))
        lines = F.transform(F.split(sentence, "\n"), identifier)
        return F.when(F.get(whole, 0).isNotNull() | ~sentence.contains("\n"), whole).otherwise(lines)

    found = F.flatten(F.transform(F.split(F.concat(text, F.lit(" ")), SENTENCE_END), known))
    none = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike("|".join(KEYWORDS)), F.filter(found, lambda x: x.isNotNull())).otherwise(none)


def matched_rules(found: Column) -> Column:
    """The sequence left over and the licenses, after all rules in their order. In the sequence
    every identifier stands between marks of its own, so that each can be taken out by itself."""
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in sequence)).alias("wanted"))
            for name, sequence in RULES
        ]
    )
    sequence = F.array_join(F.transform(found, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        new = state["left"].contains(rule["wanted"]) & ~F.array_contains(state["names"], rule["name"])
        return F.struct(
            F.replace(state["left"], rule["wanted"], F.lit("")).alias("left"),
            F.when(new, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    return F.when(F.size(found) > 0, F.aggregate(rules, start, apply)).otherwise(start)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number and identifiers of its known sentences in order, the licenses found in
    the order of the rules (each once), and the identifiers that no rule took; comma-joined.

    Null and empty texts have no sentences; rows with the same id are scanned each by itself; a
    repeated license sentence counts once for the license. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), sentence_identifiers(text).alias("found"))
    rows = rows.select("doc_id", "found", matched_rules(F.col("found")).alias("matched"))
    left = F.replace("matched.left", F.lit("><"), F.lit(","))
    return rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_sentences"),
        F.array_join("found", ",").alias("sentence_ids"),
        F.array_join("matched.names", ",").alias("licenses"),
        F.translate(left, "<>", "").alias("unmatched"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(table: str = "documents") -> str:
    """The scan as DuckDB SQL."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in known_sentences().items())
    steps = []
    for i, (name, sequence) in enumerate(RULES):
        wanted = _quoted("".join(f"<{x}>" for x in sequence))
        steps.append(
            f"r{i + 1} AS (SELECT * REPLACE (replace(rest, {wanted}, '') AS rest, "
            f"CASE WHEN contains(rest, {wanted}) AND NOT list_contains(names, {_quoted(name)}) "
            f"THEN list_append(names, {_quoted(name)}) ELSE names END AS names) FROM r{i})"
        )
    norm = (
        f"regexp_replace(regexp_replace(replace(lower(part), 'licence', 'license'), '{NOISE}', ' ', 'g'), "
        f"'{EDGES}', '', 'g')"
    )
    return f"""
WITH known(sentence, name) AS (VALUES {values}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM {table}),
sentences AS (
  SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS place
  FROM (SELECT rid, regexp_split_to_array(text || ' ', '{SENTENCE_END}') AS parts FROM docs)
),
whole AS (SELECT s.*, k.name FROM (SELECT *, {norm} AS norm FROM sentences) s LEFT JOIN known k ON k.sentence = s.norm),
lines AS (
  SELECT rid, place, unnest(parts) AS part, generate_subscripts(parts, 1) AS line
  FROM (SELECT rid, place, string_split(part, chr(10)) AS parts FROM whole WHERE name IS NULL AND contains(part, chr(10)))
),
met AS (
  SELECT rid, list(name ORDER BY place, line) AS ids FROM (
    SELECT rid, place, 0 AS line, name FROM whole WHERE name IS NOT NULL
    UNION ALL
    SELECT rid, place, line, k.name FROM (SELECT *, {norm} AS norm FROM lines) l JOIN known k ON k.sentence = l.norm
  ) GROUP BY rid
),
r0 AS (
  SELECT d.doc_id, coalesce(m.ids, []) AS ids,
         coalesce(array_to_string(list_transform(m.ids, lambda x: '<' || x || '>'), ''), '') AS rest,
         []::VARCHAR[] AS names
  FROM docs d LEFT JOIN met m USING (rid)
),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(names, ','), '') AS licenses,
       replace(replace(replace(rest, '><', ','), '<', ''), '>', '') AS unmatched
FROM r{len(RULES)}
"""
