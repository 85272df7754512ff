import re
import textwrap

from tessera.llm import license as scan

APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = "The MIT License (MIT)\n\n" + textwrap.fill(scan.SENTENCES["mit-grant"][0], 60) + ":\n\n" + scan.SENTENCES["mit-keep"][0] + ".\n\n" + scan.SENTENCES["as-is"][0] + "."
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details."


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    return {x.doc_id: (x.sentences, x.licenses) for x in scan.scan(docs).collect()}


def test_full_texts_wrapped_and_commented(spark):
    got = run(spark, [APACHE, MIT, GPL])
    assert [got[i][1] for i in range(3)] == ["Apache-2.0", "MIT", "GPL-3.0"]
    assert got[0][0].startswith("apache-2-notice") and got[0][0].endswith("apache-2-as-is,apache-2-see")
    assert got[1][0] == "mit-title,mit-grant,mit-keep,as-is"
    assert got[2][0] == "gpl-3-later,gpl-hope,gpl-see"


def test_notices_and_order(spark):
    keep, grant = scan.SENTENCES["mit-keep"][0], scan.SENTENCES["mit-grant"][0]
    got = run(
        spark,
        [
            "Text before it\nReleased under the MIT License.\nmore. All rights reserved.",
            "we like the MIT License a lot",
            f"{keep}. {grant}.",
            f"{grant}. Other words. {keep}.",
            "Licensed under CC BY-NC 4.0.",
            "LICENSED   under the *Apache* License, version 2.0",
            None,
            "",
            "x" * 200_000 + " license",
            "All rights reserved.\n" * 3000,
        ],
    )
    assert [got[i][1] for i in range(10)] == ["MIT,Proprietary", "", "", "MIT", "CC-BY-NC-4.0", "Apache-2.0", "", "", "", "Proprietary"]
    assert got[2][0] == "mit-keep,mit-grant" and got[9][0].count("all-rights") == 3000


def test_every_known_sentence_has_an_anchor_and_is_found(spark):
    texts = [f"Words before.\n{x}.\nWords after." for v in scan.SENTENCES.values() for x in v]
    assert all(re.search(scan.ANCHOR.replace("(?i)", ""), x, re.I) for x in texts)
    got = run(spark, texts)
    names = [k for k, v in scan.SENTENCES.items() for _ in v]
    assert [got[i][0].split(",")[0] for i in range(len(texts))] == names


def test_ordered_rules_of_further_licenses(spark):
    s = {k: v[0] for k, v in scan.SENTENCES.items()}
    two = f"{s['bsd-redistribution']}:\n\n1. {s['bsd-source']}.\n\n2. {s['bsd-binary']}.\n"
    texts = {
        f"Copyright. All rights reserved.\n\n{two}": "BSD-2-Clause",
        f"Copyright. All rights reserved.\n\n{two}\n3. {s['bsd-endorse']}.\n": "BSD-3-Clause",
        f"{s['lgpl-2.1-later']}.\n{s['gpl-hope']}.": "LGPL-2.1",
        f"{s['agpl-3-later']}.\n\n{s['gpl-hope']}.": "AGPL-3.0",
        f"{s['gpl-2-later']}.\n\n{s['gpl-hope']}.": "GPL-2.0",
        f"{s['isc-grant']}.\n\n{s['isc-as-is']}.": "ISC",
        f"{s['isc-as-is']}.\n\n{s['isc-grant']}.": "",
        f"{s['zlib-as-is']}.\n{s['zlib-grant']}:": "Zlib",
        f"{s['bsl-1-grant']}:\n\n{s['as-is']}.": "BSL-1.0",
        "// " + s["mpl-2-notice"] + ". If a copy of the MPL was not distributed": "MPL-2.0",
        "/* SPDX-License-Identifier: LGPL-3.0-or-later */": "LGPL-3.0",
    }
    got = run(spark, [textwrap.fill(x, 70, replace_whitespace=False) for x in texts])
    assert [got[i][1] for i in range(len(texts))] == list(texts.values())


BSD = """Copyright (c) 2011, {holder}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{advert}   * Neither the name of {holder} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
ADVERT = """   * All advertising materials mentioning features or use of this software
must display the following acknowledgement: This product includes software
developed by the Regents and others.
"""
LGPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Lesser General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    Frobnicator is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU Lesser General Public License for more details."""
APACHE_HEAD = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions."""
GPL_HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""


def test_names_are_slots_and_clauses_are_told_apart(spark):
    texts = [
        BSD.format(holder="Google Inc.", advert=""),
        BSD.format(holder="the Regents", advert=ADVERT),
        LGPL,
        "This program is not licensed under the GNU General Public License, version 3.",
        APACHE_HEAD,
        "Copyright 2020 Acme. All rights reserved.",
        GPL_HEAD,
        "Frobnicator is free software.",
    ]
    got = run(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == ["BSD-3-Clause", "BSD-4-Clause", "LGPL-3.0", "", "Apache-2.0", "Proprietary", "GPL-3.0", ""]


def test_later_versions_are_told_apart(spark):
    head = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    texts = [f"{head}; either version 2 of the License, or (at your option) any later version.", f"{head}; version 2 of the License.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPLv3.", GPL_HEAD, "// SPDX-License-Identifier: MIT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.licenses, x.spdx) for x in scan.scan(docs).collect()}
    want = [("GPL-2.0", "GPL-2.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0"), ("MIT", "MIT")]
    assert [got[i] for i in range(len(texts))] == want


def test_sql_and_scan_agree_on_ordered_rules(spark):
    import duckdb
    import pandas as pd

    docs = pd.DataFrame({"doc_id": range(9), "text": [APACHE, MIT, GPL, BSD.format(holder="A. B. and others", advert=""), BSD.format(holder="X", advert=ADVERT), LGPL, APACHE_HEAD, GPL_HEAD, "none"]})
    con = duckdb.connect()
    con.register("documents", docs)
    want = sorted(map(tuple, con.execute(scan.SQL).fetchall()))
    assert sorted(map(tuple, scan.scan(spark.createDataFrame(docs)).collect())) == want and sum(x[2] != "" for x in want) == 8


def test_empty_table(spark):
    assert scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
