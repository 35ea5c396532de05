import random

from pyspark.sql import functions as F

from loomstat.llm import licenses as op

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."


def check(spark, files, templates=op.TEMPLATES):
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i int, path string, text string").repartition(3)
    got = op.scan(df, templates).orderBy("i").collect()
    want = op.brute_force(files, templates)
    for r, (own, score, licence, up) in zip(got, want, strict=True):
        assert (r.own_licence, r.licence, r.levels_up) == (own, licence, up), (r, own, licence, up)
        assert score is None or abs(r.own_score - score) < 1e-8


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(3))
    fill = lambda: " ".join(word() for _ in range(rnd.randint(1, 30)))
    templates = rnd.sample(op.TEMPLATES, 40) + [t for t in op.TEMPLATES if "GPL" in t[0] and len(t[1]) > 60]
    files = [("r/spdx", "a\n# SPDX-License-Identifier: MIT"), ("copying", "SPDX-License-Identifier: none of it (")]
    for i in range(150):
        path = "/".join([rnd.choice("rs"), *(rnd.choice("xy") for _ in range(rnd.randint(0, 3))), rnd.choice([f"f{i}.txt", f"f{i}.txt", f"LICENSE.{i}", "copying"])])
        lines = [fill() for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.2:
            text = rnd.choice(templates)[1]
            w = text.split()
            lines.insert(rnd.randint(0, len(lines)), rnd.choice([text, text.upper(), "\n\n" + "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4)) + "\n\n", " ".join(w[: len(w) // 2]), text + " " + word()]))
        files.append((path, "\n".join(lines)))
    check(spark, files, templates)


def test_nearest_ancestor(spark):
    files = [
        ("r/LICENSE", MIT), ("r/a/COPYING.txt", APACHE), ("r/a/b/c/x.txt", "text"), ("r/b/x.txt", "text"), ("r/a/x.txt", MIT), ("q/x.txt", "text"), ("x", "text"),
        ("r/licensed.txt", APACHE), (None, MIT), (None, "text"), ("r/b/y", None), ("r/b/z", ""), ("r/a/LICENSE", MIT), ("r/b/z", ""), ("r/b/w", ("no " * 60000) + "\n" + APACHE),
    ]
    check(spark, files)


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([("a/LICENSE", MIT, 1, 2), ("a/f", "x", 3, 4)], "path string, text string, l int, up int").withColumn("levels", F.lit(9))
    out = op.scan(df)
    assert out.columns[:5] == df.columns
    assert [r.licence for r in out.collect()] == ["MIT", "MIT"]
    assert op.scan(df.limit(0)).count() == 0


def names_of(spark, texts):
    """Each text among the documents of a table of other prose."""
    rows = [(k, f"p{k}/f", t) for k, t in enumerate(texts)] + [(1000 + k, f"q{k}/f", f"The words of prose number {k}, which is about this and that, and has no licence to it.") for k in range(200)]
    out = {r.k: r.own_licence for r in op.own_licences(spark.createDataFrame(rows, "k int, path string, text string")).collect()}
    assert all(v is None for k, v in out.items() if k >= 1000)
    return [out[k] for k in range(len(texts))]


def wrap(text, prefix=" * ", width=9):
    w = text.split()
    return "\n".join(prefix + " ".join(w[k : k + width]) for k in range(0, len(w), width))


GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
HEADERS = {
    "GPL-2.0": GPL.format(";", "", ";", "2"), "GPL-3.0": GPL.format(":", "", ",", "3"), "AGPL-3.0": GPL.format(":", "Affero ", ",", "3"), "LGPL-2.1": GPL.format(";", "Lesser ", ";", "2.1").replace("program", "library"),
    "LGPL-3.0": GPL.format(":", "Lesser ", ",", "3"), "LGPL-2.0": GPL.format(";", "Library ", ";", "2").replace("program", "library"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}


def test_headers_of_one_family_are_told_apart(spark):
    plain = names_of(spark, HEADERS.values())
    assert plain == [*HEADERS]
    in_code = [f"/*\n * Copyright (C) 2019 Some One\n *\n{wrap(t)}\n *\n */\nint main(void) {{ return 0; }}" for t in HEADERS.values()]
    assert names_of(spark, in_code) == [*HEADERS]


def test_heads_of_licence_files(spark):
    heads = {
        "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.", "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
        "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright", "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n\nx", "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nx",
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MIT": "MIT License\n\nCopyright (c) 2020 A. N. Other",
        "EPL-2.0": "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM", "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International\n\nx", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nx",
    }
    assert names_of(spark, heads.values()) == [*heads]


def test_clauses_and_notices(spark):
    two = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code\n\n"
    three = two + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    lines = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA-3.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "ISC": "Released under the ISC License.", "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", "EUPL-1.2": "Licensed under the EUPL 1.2."}
    assert names_of(spark, [two, three, *lines.values()]) == ["BSD-2-Clause", "BSD-3-Clause", *lines]
    # Unknown versions and licences are nothing, not their neighbours.
    assert names_of(spark, ["Licensed under the Mozilla Public License, version 9.", "Licensed under the GNU General Public License, version 7.", "Licensed under the Some Company Source Terms, version 2.0."]) == [None] * 3


def test_spdx_expressions(spark):
    want = {
        "// SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: GPL-2.0-only */ int x;": "GPL-2.0-only", "# spdx-license-identifier: (MIT or Apache-2.0) and MPL-2.0": "(MIT OR Apache-2.0) AND MPL-2.0",
        "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 trailing": "GPL-2.0+ WITH Classpath-exception-2.0", "<!-- SPDX-License-Identifier: LicenseRef-Own-1.0 -->": "LicenseRef-Own-1.0", "SPDX-License-Identifier: ": None, "SPDX-License-Identifier: AND": None,
        "SPDX-License-Identifier: %\nSPDX-License-Identifier: Zlib": "Zlib", "SPDX-License-Identifier: (MIT": None, HEADERS["GPL-3.0"] + "\nSPDX-License-Identifier: MIT OR": "MIT",
    }
    assert names_of(spark, want) == [*want.values()]


def test_lines_of_the_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    names = {"CC BY-NC": "CC-BY-NC-4.0", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "MIT License": "MIT"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: {n for k, n in names.items() for line in r.text.split("\n") if k in line and "icense" in line} for r in docs.collect()}
    got = {r.doc_id: r.own_licence for r in op.scan(op.files_of(docs)).collect()}
    assert {d for d, n in want.items() if n} == {d for d, n in got.items() if n}
    assert all(n in want[d] for d, n in got.items() if n)
