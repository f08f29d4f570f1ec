"""Licence scan by sentence rules.

A text is normalised (lower case, letters and digits, single spaces) and marked where a sentence ends or may end; what stands
between two ends is looked up among known licence sentences; the identifiers found, in order, form a sequence. Ordered rules,
whole notices before their parts, each replace their run of identifiers in the sequence by a licence; what no
rule takes stays visible as known sentences without a licence.

Notices are wrapped, commented and cut by blank lines: line ends, colons, semicolons and the edges of addresses may end a
sentence and may also stand within one; stops before white space always end it. A sentence that follows other words on its
line with no such sign between is not told from them.

The tables are fixed in size, so the lookup travels with the plan; the scan is one narrow pass of SQL functions.

Defined results: null and empty texts have an empty sequence and no licence; repeated rows are scanned
each for itself; sentences repeated in a text count each time; columns of the input with the names of the output are replaced,
others of any name are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GPL = "This {it} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} {version}"
LATER = "either version {} of the License, or (at your option) any later version"
HOPE = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
CC = "This work is licensed under a Creative Commons {} 4.0 International License"
#: Known sentences by identifier, in all their known forms.
SENTENCES: dict[int, tuple[str, ...]] = {
    1: ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    2: ("you may not use this file except in compliance with the License",),
    3: tuple(f"You may obtain a copy of the License at {s}://www.apache.org/licenses/LICENSE-2.0" for s in ("http", "https")),
    4: ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    5: tuple(
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction' + rest
        for rest in (
            "",
            ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        )
    ),
    6: ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    7: tuple(
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED' + rest
        for rest in ("", ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT")
    ),
    8: ("This work is licensed under the GNU General Public License version 3",),
    9: (GPL.format(it="program", sign=":", kind="", comma=",", version=LATER.format(3)),),
    10: (HOPE.format("program"),),
    11: ("See the GNU General Public License for more details",),
    12: ("Licensed under CC BY-NC 4.0",),
    13: ("Licensed under CC BY 4.0",),
    14: ("Licensed under CC BY-SA 4.0",),
    15: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    16: ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    17: ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    18: tuple(f"Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for who in ("the copyright holder", "the University")),
    19: (CC.format("Attribution"),),
    20: ("This is free and unencumbered software released into the public domain",),
    21: ("All rights reserved",),
    22: ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    23: ("See the License for the specific language governing permissions and limitations under the License",),
    24: ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    25: ("You should have received a copy of the GNU General Public License along with this program",),
    26: ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    27: tuple(
        f"IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
        for who in ("HOLDER", "HOLDERS", "OWNER")
    ),
    28: tuple(GPL.format(it="program", sign=";", kind="", comma=c, version=LATER.format(2)) for c in (";", ",")),
    29: (GPL.format(it="program", sign=":", kind="", comma=",", version="version 3 of the License"),),
    30: (GPL.format(it="program", sign=";", kind="", comma=";", version="version 2 of the License"),),
    31: (GPL.format(it="library", sign=";", kind="Lesser ", comma=";", version=LATER.format("2.1")),),
    32: tuple(GPL.format(it=it, sign=":", kind="Lesser ", comma=",", version=LATER.format(3)) for it in ("program", "library")),
    33: (HOPE.format("library"),),
    34: ("See the GNU Lesser General Public License for more details",),
    35: tuple(f"You should have received a copy of the GNU Lesser General Public License along with this {it}" for it in ("library", "program")),
    36: (GPL.format(it="program", sign=":", kind="Affero ", comma=",", version=LATER.format(3)),),
    37: ("See the GNU Affero General Public License for more details",),
    38: ("You should have received a copy of the GNU Affero General Public License along with this program",),
    39: ("This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, v2.0"),
    40: tuple(f"If a copy of the MPL was not distributed with this file, You can obtain one at {s}://mozilla.org/MPL/2.0/" for s in ("http", "https")),
    41: ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',),
    42: tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {s}://www.eclipse.org/legal/epl-2.0{end}" for s in ("http", "https") for end in ("", "/")),
    43: ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",),
    44: tuple(f"Permission to use, copy, modify, and{word} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for word in ("/or", "")),
    45: ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    46: ("This software is provided 'as-is', without any express or implied warranty",),
    47: ("In no event will the authors be held liable for any damages arising from the use of this software",),
    48: ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    49: ("Distributed under the Boost Software License, Version 1.0",),
    50: (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    ),
    51: (CC.format("Attribution-ShareAlike"),),
    52: (CC.format("Attribution-NonCommercial"),),
    53: (CC.format("Attribution-NoDerivatives"),),
    54: (CC.format("Attribution-NonCommercial-ShareAlike"),),
    55: (CC.format("Attribution-NonCommercial-NoDerivatives"),),
    56: ('The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',),
    57: ('Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence")', "Licensed under the EUPL-1.2"),
    58: ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    59: ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",),
    60: ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",),
    61: ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    62: ("This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc",),
    63: ("Licensed under the Elastic License 2.0", "you may not use this file except in compliance with the Elastic License 2.0"),
    64: ("This license governs use of the accompanying software",),
}
#: Identifiers that a line "SPDX-License-Identifier:" may name; their sentences follow on from those above.
SPDX = (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later",
    "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "EUPL-1.2", "0BSD",
)
SENTENCES |= {len(SENTENCES) + 1 + k: (f"SPDX-License-Identifier: {name}",) for k, name in enumerate(SPDX)}
#: Rules in order, as (licence, identifiers of its sentences in their order).
WHOLE = (
    ("GPL-3.0-or-later", (9, 10, 11, 25)),
    ("GPL-2.0-or-later", (28, 10, 11, 25)),
    ("LGPL-2.1-or-later", (31, 33, 34, 35)),
    ("LGPL-3.0-or-later", (32, 10, 34, 35)),
    ("LGPL-3.0-or-later", (32, 33, 34, 35)),
    ("AGPL-3.0-or-later", (36, 10, 37, 38)),
    ("BSD-4-Clause", (15, 16, 17, 61, 18, 26, 27)),
    ("BSD-3-Clause", (15, 16, 17, 18, 26, 27)),
    ("BSD-2-Clause", (15, 16, 17, 26, 27)),
    ("MIT", (5, 6, 7, 24)),
    ("MIT-0", (5, 7, 24)),
    ("Apache-2.0", (1, 2, 3, 22, 23)),
    ("Zlib", (46, 47, 48)),
)
PARTS = (
    ("GPL-3.0-or-later", (9, 10, 11)),
    ("GPL-2.0-or-later", (28, 10, 11)),
    ("GPL-3.0-only", (29, 10, 11)),
    ("GPL-2.0-only", (30, 10, 11)),
    ("LGPL-2.1-or-later", (31, 33, 34)),
    ("LGPL-3.0-or-later", (32, 10, 34)),
    ("AGPL-3.0-or-later", (36, 10, 37)),
    ("BSD-3-Clause", (15, 16, 17, 18)),
    ("BSD-2-Clause", (15, 16, 17)),
    ("MIT", (5, 6, 7)),
    ("Apache-2.0", (1, 2, 3)),
    ("MPL-2.0", (39, 40)),
    ("Apache-2.0", (1, 2)),
    ("GPL-3.0-or-later", (9,)),
    ("GPL-2.0-or-later", (28,)),
    ("GPL-3.0-only", (29,)),
    ("GPL-2.0-only", (30,)),
    ("LGPL-2.1-or-later", (31,)),
    ("LGPL-3.0-or-later", (32,)),
    ("AGPL-3.0-or-later", (36,)),
    ("MIT", (5, 6)),
    ("MIT", (4,)),
    ("Apache-2.0", (1,)),
    ("MPL-2.0", (39,)),
    ("MPL-2.0", (40,)),
    ("MPL-1.1", (41,)),
    ("EPL-2.0", (42,)),
    ("EPL-1.0", (43,)),
    ("ISC", (44,)),
    ("0BSD", (45,)),
    ("Zlib", (48,)),
    ("BSL-1.0", (49,)),
    ("CC0-1.0", (50,)),
    ("GPL-3.0", (8,)),
    ("CC-BY-NC-4.0", (12,)),
    ("CC-BY-SA-4.0", (14,)),
    ("CC-BY-4.0", (13,)),
    ("CC-BY-4.0", (19,)),
    ("CC-BY-SA-4.0", (51,)),
    ("CC-BY-NC-4.0", (52,)),
    ("CC-BY-ND-4.0", (53,)),
    ("CC-BY-NC-SA-4.0", (54,)),
    ("CC-BY-NC-ND-4.0", (55,)),
    ("CDDL-1.0", (56,)),
    ("EUPL-1.2", (57,)),
    ("OFL-1.1", (58,)),
    ("GFDL-1.3-or-later", (59,)),
    ("PostgreSQL", (60,)),
    ("SSPL-1.0", (62,)),
    ("Elastic-2.0", (63, 63)),
    ("Elastic-2.0", (63,)),
    ("MS-PL", (64,)),
    ("Unlicense", (20,)),
)
#: "All rights reserved" before a notice that begins with a grant belongs to it.
GRANTS = {1, 5, 9, 15, 28, 31, 32, 36}
RULES = (
    *((name, ids) for name, own in (*WHOLE, *PARTS) for ids in ([(21, *own)] if own[0] in GRANTS else []) + [own]),
    *((name, (len(SENTENCES) - len(SPDX) + 1 + k,)) for k, name in enumerate(SPDX)),
    ("Proprietary", (21,)),
)


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"https?://[^\t\f\n ]+"
#: What a text's characters become before it is marked; what marks it is no character of its own.
FROM, TO = UPPER + "()<>\r;", LOWER + "    \n:"


def marked(text: Column) -> Column:
    """The text's words with one space, )( or >< between them, and >< at both ends: )( may end a sentence, >< does."""
    t = F.regexp_replace(F.translate(text, FROM, TO), f"({ADDRESS})", ":$1:")
    t = F.translate(F.regexp_replace(t, r"[.!?][\t\f\n ]", ">"), "\n:", "))")
    t = F.regexp_replace(F.concat(F.lit("> "), t, F.lit(" >")), "[^a-z0-9>)]+", " ")
    # each pattern begins with one character at most, so runs of signs take linear time
    t = F.regexp_replace(F.regexp_replace(t, r" ?\)[ )]*", ")"), "[ )]?>[ )>]*", ">")
    return F.replace(F.replace(t, F.lit(">"), F.lit("><")), F.lit(")"), F.lit(")("))


def known() -> dict[str, str]:
    """<identifier> by form."""
    return {plain(form): f"<{k}>" for k, own in SENTENCES.items() for form in own}


def pattern() -> str:
    """All known forms, longest first, within which any space may be a possible end."""
    forms = sorted(known(), key=len, reverse=True)
    return "[<(](" + "|".join(form.replace(" ", r"(?: |\)\()") for form in forms) + ")[>)]"


def find_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with sentence_ids (text of <id>s), n_known, licences (in order of appearance) and n_licences."""
    keep = [c for c in docs.columns if c not in (text, "sentence_ids", "n_known", "licences", "n_licences")]
    # the row is one column, so no name of its own can meet those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), marked(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    hits = F.regexp_extract_all(F.col("body"), F.lit(pattern()), F.lit(1))
    rows = rows.select("row", F.transform(hits, lambda s: F.element_at(table, F.replace(s, F.lit(")("), F.lit(" ")))).alias("ids"))
    rows = rows.select("row", F.array_join("ids", "").alias("sentence_ids"), F.size("ids").cast("long").alias("n_known"))
    found = F.col("sentence_ids")
    for k, (_, sequence) in enumerate(RULES):
        found = F.replace(found, F.lit("".join(f"<{i}>" for i in sequence)), F.lit(f"[{k}]"))
    rules = F.when(F.col("n_known") > 0, F.regexp_extract_all(found, F.lit(r"\[([0-9]+)\]"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    names = F.array(*[F.lit(name) for name, _ in RULES])
    rows = rows.select("row", "sentence_ids", "n_known", rules.alias("rules"))
    told = F.struct(
        "sentence_ids", "n_known", F.array_join(F.transform("rules", lambda k: F.get(names, k.cast("int"))), ",").alias("licences"), F.size("rules").cast("long").alias("n_licences")
    )
    return rows.select("row", told.alias("out")).select("row.*", "out.*")


def oracle() -> str:
    """find_licences in DuckDB's SQL, from the same tables."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    forms = known()
    found = "ids"
    for k, (_, sequence) in enumerate(RULES):
        found = f"replace({found}, '{''.join(f'<{i}>' for i in sequence)}', '[{k}]')"
    licences = "[" + ", ".join(quote(n) for n, _ in RULES) + "]"
    return f"""
WITH addressed AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), {quote(FROM)}, {quote(TO)}), '({ADDRESS})', ':\\1:', 'g') AS t FROM documents
), ends AS (
  SELECT doc_id, '> ' || translate(regexp_replace(t, '[.!?][\\t\\f\\n ]', '>', 'g'), {quote(chr(10) + ':')}, '))') || ' >' AS t FROM addressed
), words AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9>)]+', ' ', 'g'), ' ?\\)[ )]*', ')', 'g'), '[ )]?>[ )>]*', '>', 'g') AS t FROM ends
), hits AS (
  SELECT doc_id, list_transform(regexp_extract_all(replace(replace(t, '>', '><'), ')', ')('), {quote(pattern())}, 1),
    lambda s: [{', '.join(map(quote, forms.values()))}][list_position([{', '.join(map(quote, forms))}], replace(s, ')(', ' '))]) AS hit FROM words
), sequences AS (
  SELECT doc_id, array_to_string(hit, '') AS ids, CAST(len(hit) AS BIGINT) AS n_known FROM hits
), ruled AS (
  SELECT *, regexp_extract_all({found}, '\\[([0-9]+)\\]', 1) AS rules FROM sequences
)
SELECT doc_id, ids AS sentence_ids, n_known,
       array_to_string(list_transform(rules, lambda k: {licences}[CAST(k AS INTEGER) + 1]), ',') AS licences,
       CAST(len(rules) AS BIGINT) AS n_licences
FROM ruled
"""
