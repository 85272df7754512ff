"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences in two readings: with every line break as a
boundary, and with lines joined (license texts are wrapped). Sentences are
normalised (lower case, letters and digits only, single spaces) and looked up
among known license sentences; names of holders and programs are slots of a
sentence (``SLOTS``), so any name gives the same sentence. A text becomes the
sequence of identifiers in each reading. A rule is an ordered list of identifiers;
it matches where they occur one after the other in a reading, other known
sentences may stand between, unless an identifier occurs that stands against it
(a three-clause text holds the two clauses too). Rules of the same license count
once; ``spdx`` tells what the rule says of later versions.

Defined results: null and empty texts have no identifiers and no licenses; a
null doc_id and repeated rows each keep their row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for any name of a holder or a program in a normalised sentence (pattern, what it becomes; {1} is the first group).
SLOTS = [
    ("^neither the names? of .+ nor the names of (?:its|their|any) contributors", "neither the name of holder nor the names of its contributors"),
    ("^neither the names? of .+ may be used to endorse", "neither the name of holder nor the names of its contributors may be used to endorse"),
    ("^the names? of .+ may not be used to endorse", "the name of holder may not be used to endorse"),
    ("^[a-z0-9 ]{1,60} is free software( you can .*)?$", "this program is free software{1}"),
    ("^[a-z0-9 ]{1,60} is distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful"),
]
#: Known sentences of public licenses, normalised by ``normal``.
SENTENCES = {
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": [
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"
    ],
    "apache-2-notice": [
        "Licensed under the Apache License, Version 2.0 (the License)",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    ],
    "apache-2-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"],
    "apache-2-comply": ["you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-2-as-is": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    ],
    "apache-2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "apache-2-grant": [
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"
    ],
    "gpl-2-title": ["GNU General Public License Version 2, June 1991"],
    "gpl-3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "lgpl-2.1-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl-3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "agpl-3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "fsf-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl-3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "agpl-3-preamble": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"
    ],
    "lgpl-3-preamble": [
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"
    ],
    "gpl-hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "gpl-see": ["See the GNU General Public License for more details"],
    "lgpl-see": ["See the GNU Lesser General Public License for more details"],
    "agpl-see": ["See the GNU Affero General Public License for more details"],
    "bsd-redistribution": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement", "All advertising materials mentioning features or use of this software must display the following acknowledgment"],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific, prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": [
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"
    ],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ],
    "mpl-2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-2-title": ["Mozilla Public License Version 2.0"],
    "epl-2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0-notice": ["This work is dedicated to the public domain under CC0 1.0"],
    "bsl-1-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-1-grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ],
    "ofl-1.1-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "postgresql-grant": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"
    ],
    "all-rights": ["All rights reserved"],
}
#: How texts name a license, for the sentences that NOTICES makes of them.
NAMES = {
    "mit-notice": ["the MIT License"],
    "apache-2-notice": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
    "gpl-2-notice": ["the GNU General Public License, version 2", "the GNU GPL version 2", "the GPLv2"],
    "gpl-3-notice": ["the GNU General Public License, version 3", "the GNU GPL version 3", "the GPLv3"],
    "lgpl-2.1-notice": ["the GNU Lesser General Public License, version 2.1"],
    "lgpl-3-notice": ["the GNU Lesser General Public License, version 3", "the LGPLv3"],
    "agpl-3-notice": ["the GNU Affero General Public License, version 3", "the AGPLv3"],
    "bsd-2-notice": ["the BSD 2-Clause License"],
    "bsd-3-notice": ["the BSD 3-Clause License"],
    "isc-notice": ["the ISC License"],
    "mpl-2-notice": ["the Mozilla Public License, Version 2.0"],
    "bsl-1-notice": ["the Boost Software License, Version 1.0"],
    "cc-by-4-notice": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4-notice": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4-notice": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-notice": ["CC0 1.0"],
}
#: The sentences that name a license.
NOTICES = ["Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This program is licensed under", "This software is licensed under"]
#: Identifiers of the SPDX list, whose license is the part before -only or -or-later.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "LGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "MPL-2.0", "EPL-2.0", "Unlicense",
    "BSL-1.0", "OFL-1.1", "PostgreSQL", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0",
)
#: GNU licenses by identifier: name, version as the notice gives it, what stands between the parts of the notice.
GNU = {
    "gpl-2": ("GPL-2.0", "General", "2", ";"),
    "gpl-3": ("GPL-3.0", "General", "3", ","),
    "lgpl-2.1": ("LGPL-2.1", "Lesser General", "2.1", ";"),
    "lgpl-3": ("LGPL-3.0", "Lesser General", "3", ","),
    "agpl-3": ("AGPL-3.0", "Affero General", "3", ","),
}
for _id, (_name, _kind, _version, _mark) in GNU.items():
    _head = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind} Public License as published by the Free Software Foundation"
    SENTENCES[f"{_id}-later"] = [f"{_head}{_mark} either version {_version} of the License, or (at your option) any later version"]
    SENTENCES[f"{_id}-only"] = [
        f"{_head}{_mark} version {_version} of the License",
        f"This program is free software: you can redistribute it and/or modify it under the terms of version {_version} of the GNU {_kind} Public License as published by the Free Software Foundation",
    ]
for _id, _names in NAMES.items():
    SENTENCES.setdefault(_id, []).extend(f"{head} {name}" for name in _names for head in NOTICES)
for _id in SPDX:
    SENTENCES[f"spdx-{_id.lower()}"] = [f"SPDX-License-Identifier: {_id}"]
#: What a rule gives (an SPDX identifier), the ordered identifiers that give it, and identifiers that stand against it.
RULES = [
    ("MIT", ("mit-notice",), ()),
    ("MIT", ("mit-grant", "mit-keep"), ()),
    ("Apache-2.0", ("apache-2-notice",), ()),
    ("Apache-2.0", ("apache-2-title",), ()),
    ("BSD-2-Clause", ("bsd-2-notice",), ()),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary"), ("bsd-endorse", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-3-notice",), ()),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse"), ("bsd-advert",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-advert", "bsd-endorse"), ()),
    ("ISC", ("isc-notice",), ()),
    ("ISC", ("isc-grant", "isc-as-is"), ()),
    ("0BSD", ("0bsd-grant", "isc-as-is"), ("isc-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant"), ()),
    ("MPL-2.0", ("mpl-2-notice",), ()),
    ("MPL-2.0", ("mpl-2-title",), ()),
    ("EPL-2.0", ("epl-2-notice",), ()),
    ("Unlicense", ("unlicense",), ()),
    ("BSL-1.0", ("bsl-1-notice",), ()),
    ("BSL-1.0", ("bsl-1-title",), ()),
    ("BSL-1.0", ("bsl-1-grant", "as-is"), ()),
    ("OFL-1.1", ("ofl-1.1-notice",), ()),
    ("PostgreSQL", ("postgresql-grant",), ()),
    ("CC-BY-4.0", ("cc-by-4-notice",), ()),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",), ()),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",), ()),
    ("CC0-1.0", ("cc0-notice",), ()),
    ("Proprietary", ("all-rights",), ("bsd-redistribution",)),
]
for _id, (_name, *_) in GNU.items():
    RULES += [(f"{_name}-or-later", (f"{_id}-later",), ()), (f"{_name}-only", (f"{_id}-only",), ()), (f"{_name}-only", (f"{_id}-notice",), ()), (_name, (f"{_id}-title",), ())]
RULES += [(_id, (f"spdx-{_id.lower()}",), ()) for _id in SPDX]
#: A known sentence holds at least one of these; texts without any are not cut at all.
ANCHOR = "(?i)licen[sc]e|distributed under|released under|permission|redistribut|warrant|public domain|cc0|rights reserved|software|spdx|source code form|eclipse"
#: A sentence ends at . ! ? ; : before white space or the end.
END = r"[.!?;:](?=\s|$)"

#: The point after an abbreviation or an initial ends no sentence.
ABBREVIATED = r"(^|[^A-Za-z0-9])(Inc|inc|INC|Ltd|ltd|LTD|Corp|corp|CORP|Co|co|CO|LLC|Jr|Dr|[A-Z])\."


def normal(text: str) -> str:
    out = re.sub("[^a-z0-9]+", " ", text.lower()).strip()
    for pattern, becomes in SLOTS:
        out = re.sub(pattern, lambda m, to=becomes: to.replace("{1}", m[1] or "" if m.re.groups else ""), out)
    return out


def license_of(spdx: str) -> str:
    """The license of an SPDX identifier, whatever it says of later versions."""
    return re.sub("-(only|or-later)$", "", spdx)


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier."""
    return {normal(x): k for k, variants in SENTENCES.items() for x in variants}


def _lookup() -> Column:
    return F.create_map(*[x for s, k in known_sentences().items() for x in (F.lit(s), F.lit(k))])


def _normal(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return reduce(lambda s, slot: F.regexp_replace(s, slot[0], slot[1].replace("{1}", "$1")), SLOTS, plain)


def _identifiers(text: Column, lookup: Column) -> Column:
    """Identifiers in order; a sentence that isn't known is tried together with the next one or two, as ; : and . stand in some."""
    pieces = F.transform(F.split(F.regexp_replace(text, ABBREVIATED, "$1$2"), END), _normal)

    def each(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda s, i: F.coalesce(
                F.element_at(lookup, s),
                F.element_at(lookup, F.concat_ws(" ", s, F.get(parts, i + 1))),
                F.element_at(lookup, F.concat_ws(" ", s, F.get(parts, i + 1), F.get(parts, i + 2))),
                F.lit(""),
            ),
        )

    # the one-element array lets the pieces be cut once
    alone = F.element_at(F.transform(F.array(pieces), each), 1)
    return F.filter(alone, lambda x: x != "")


def in_order(ids: tuple[str, ...]) -> str:
    """A pattern for the identifiers, one after the other, in a comma-separated list."""
    return "(^|,)" + "(,|,.*,)".join(re.escape(x) for x in ids) + "(,|$)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order, comma-separated; of the reading with more of them), licenses and spdx (sorted, comma-separated)."""
    lookup = _lookup()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a line break ends a sentence in the first reading; in the second it is a blank
    by_line = F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(ANCHOR)), lambda x: _identifiers(x, lookup)))
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda x: x.rlike(ANCHOR))
    joined = F.flatten(F.transform(paragraphs, lambda x: _identifiers(F.regexp_replace(x, r"[\s*#/]+", " "), lookup)))
    none = F.array().cast("array<string>")
    able = text.rlike(ANCHOR)
    found = docs.select(
        F.col("doc_id").cast("long"),
        F.when(able, F.array_join(by_line, ",")).otherwise("").alias("a"),
        F.when(able, F.array_join(joined, ",")).otherwise("").alias("b"),
    )

    def matches(ids: tuple[str, ...], against: tuple[str, ...]) -> Column:
        return reduce(Column.__and__, [*(~matches((x,), ()) for x in against), F.col("a").rlike(in_order(ids)) | F.col("b").rlike(in_order(ids))])

    hits = F.array_compact(F.array(*(F.when(matches(ids, against), F.lit(name)) for name, ids, against in RULES)))
    hits = F.when((F.col("a") != "") | (F.col("b") != ""), F.array_sort(F.array_distinct(hits))).otherwise(none)
    longer = F.length(F.regexp_replace("b", "[^,]", "")) + (F.col("b") != "").cast("int") > F.length(F.regexp_replace("a", "[^,]", "")) + (F.col("a") != "").cast("int")
    return found.select(
        "doc_id",
        F.when(longer, F.col("b")).otherwise(F.col("a")).alias("sentences"),
        hits.alias("hits"),
    ).select(
        "doc_id",
        "sentences",
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.regexp_replace(x, "-(only|or-later)$", "")))), ",").alias("licenses"),
        F.array_join("hits", ",").alias("spdx"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for s, k in known_sentences().items())
    anchor = f"'{ANCHOR}'"

    def hit(ids: tuple[str, ...], against: tuple[str, ...] = ()) -> str:
        own = " OR ".join(f"regexp_matches({side}, '{in_order(ids)}')" for side in "ab")
        return " AND ".join([f"({own})", *(f"NOT {hit((x,))}" for x in against)])

    names = ", ".join(f"CASE WHEN {hit(ids, against)} THEN '{name}' END" for name, ids, against in RULES)
    plain = "trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, becomes in SLOTS:
        plain = f"regexp_replace({plain}, '{pattern}', '{becomes.replace('{1}', chr(92) + '1')}')"
    return rf"""
WITH known(s, k) AS (VALUES {known}),
able AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, {anchor})),
parts AS (
  SELECT doc_id, 'a' AS reading, unnest(range(0, len(x))) AS li, unnest(x) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM able)
  UNION ALL SELECT doc_id, 'b', unnest(range(0, len(x))), unnest(x) FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS x FROM able)),
pieces AS (
  SELECT doc_id, reading, li, unnest(range(0, len(x))) AS pi, unnest(x) AS piece FROM (
    SELECT doc_id, reading, li, regexp_split_to_array(regexp_replace(CASE reading WHEN 'a' THEN part ELSE regexp_replace(part, '[\s*#/]+', ' ', 'g') END, '{ABBREVIATED}', '\1\2', 'g'), '[.!?;:](\s|$)') AS x
    FROM parts WHERE regexp_matches(part, {anchor}))),
n AS (SELECT *, {plain} AS s FROM pieces),
w AS (SELECT *, lead(s, 1) OVER o AS s1, lead(s, 2) OVER o AS s2 FROM n WINDOW o AS (PARTITION BY doc_id, reading, li ORDER BY pi)),
i AS (SELECT doc_id, reading, li, pi, coalesce(x.k, y.k, z.k) AS id FROM w LEFT JOIN known x ON x.s = w.s LEFT JOIN known y ON y.s = concat_ws(' ', w.s, s1) LEFT JOIN known z ON z.s = concat_ws(' ', w.s, s1, s2)),
q AS (SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY li, pi) FILTER (WHERE reading = 'a'), '') AS a, coalesce(string_agg(id, ',' ORDER BY li, pi) FILTER (WHERE reading = 'b'), '') AS b,
        count(id) FILTER (WHERE reading = 'a') AS na, count(id) FILTER (WHERE reading = 'b') AS nb FROM i GROUP BY doc_id),
h AS (SELECT *, list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))) AS hits FROM q)
SELECT d.doc_id, coalesce(CASE WHEN nb > na THEN b ELSE a END, '') AS sentences,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: regexp_replace(x, '-(only|or-later)$', '')))), ','), '') AS licenses,
  coalesce(array_to_string(hits, ','), '') AS spdx
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id
"""


SQL = _sql()
