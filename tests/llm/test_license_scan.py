from opsloom.llm.license_scan import scan

ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.txt", "some words of text"),
    (3, "a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/c/d/e.txt", "other words"),
    (5, "a/b/c/f.txt", "many words here and more of them\nThis work is licensed under the GNU General Public License, version 3.\nand again more words at the end of it"),
    (6, "z/y.txt", None),
    (7, None, ""),
    (8, "top.txt", "words"),
    (9, "ab/x.txt", "the licence to say so is not a notice of any kind at all"),
    (9, "ab/x.txt", "the licence to say so is not a notice of any kind at all"),
    (None, "a/q.txt", "x"),
]


def test_inheritance_and_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, path string, text string").selectExpr("*", "1 as dir", "2 as own")
    out = sorted([(r.doc_id, r.own, r.licence, r.from_dir) for r in scan(df).collect()], key=str)
    assert out == sorted([
        (1, "MIT", "MIT", None), (2, None, "MIT", "a"), (3, "Apache-2.0", "Apache-2.0", None), (4, None, "Apache-2.0", "a/b/c"), (5, "GPL-3.0", "GPL-3.0", None),
        (6, None, None, None), (7, None, None, None), (8, None, None, None), (9, None, None, None), (9, None, None, None), (None, None, "MIT", "a"),
    ], key=str)
    assert scan(df.where("false")).count() == 0


def test_lines_of_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "concat(source, '/', lang, '/', doc_id) as path", "text")
    want = {r.doc_id: r.x for r in docs.selectExpr("doc_id", "regexp_extract(text, '(Apache License|MIT License|CC BY-NC|GNU General)', 1) as x").collect()}
    names = {"Apache License": "Apache-2.0", "MIT License": "MIT", "CC BY-NC": "CC-BY-NC-4.0", "GNU General": "GPL-3.0", "": None}
    got = {r.doc_id: r.own for r in scan(docs).collect()}
    assert got == {d: names[x] for d, x in want.items()} and any(got.values())


MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main() { return 0; }
"""
GPL = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
TITLE = "                    GNU GENERAL PUBLIC LICENSE\n                       Version {0}\n\n Everyone is permitted to copy and distribute verbatim copies\n of this document, but changing it is not allowed.\n" + "\n some words of the preamble and the terms" * 40


def test_wrapped_headers_and_whole_files(spark):
    rows = [
        (1, "m/main.c", MPL), (2, "g/two.py", GPL.format(";", ";", 2) + "\nprint(1)\n" * 30), (3, "h/three.py", GPL.format(":", ",", 3) + "\nprint(1)\n" * 30),
        (4, "two/COPYING", TITLE.format("2, June 1991")), (5, "two/x.txt", "words"), (6, "three/COPYING", TITLE.format("3, 29 June 2007")), (7, "three/a/x.txt", "words"),
    ]
    got = {r.doc_id: (r.own, r.licence) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MPL-2.0",) * 2, 2: ("GPL-2.0",) * 2, 3: ("GPL-3.0",) * 2, 4: ("GPL-2.0",) * 2, 5: (None, "GPL-2.0"), 6: ("GPL-3.0",) * 2, 7: (None, "GPL-3.0")}


AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT\nLIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
BSD = "Copyright (c) 2020, Someone\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n" + AS_IS
BSD3 = BSD.replace(AS_IS, "3. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n\n" + AS_IS)
ISC = "Copyright (c) 2020 Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
UN = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n"
LESSER = GPL.replace("This program is free software", "This library is free software").replace("GNU General", "GNU Lesser General")


def commented(text, mark="# "):
    return "\n".join((mark + x).rstrip() for x in text.split("\n")) + "\nx = 1\n" * 20


def test_ordinary_licences_are_told_apart(spark):
    rows = [(1, BSD, "BSD-2-Clause"), (2, BSD3, "BSD-3-Clause"), (3, ISC, "ISC"), (4, UN, "Unlicense"), (5, LESSER.format(";", ";", "2.1"), "LGPL-2.1"), (6, LESSER.format(":", ",", 3), "LGPL-3.0")]
    rows += [(7, GPL.replace("GNU General", "GNU Affero General").format(":", ",", 3), "AGPL-3.0"), (8, GPL.format(";", ";", 2), "GPL-2.0"), (9, GPL.format(":", ",", 3), "GPL-3.0")]
    more = [(10 * d, commented(t.replace("# ", "").replace("#", "")), want) for d, t, want in rows] + [(100 * d, commented(t.replace("# ", "").replace("#", ""), " * "), want) for d, t, want in rows]
    df = spark.createDataFrame([(d, f"p{d}/x.py", t) for d, t, _ in rows + more], "doc_id long, path string, text string")
    assert {r.doc_id: r.own for r in scan(df).collect()} == {d: w for d, _, w in rows + more}


def test_published_texts(spark):
    """The licence files of the operating system, where there are any."""
    from pathlib import Path

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    folder = Path("/usr/share/common-licenses")
    rows = [(k, f"{n}/COPYING", (folder / n).read_text()) for k, n in enumerate(names) if (folder / n).exists()]
    if rows:
        got = {r.path.split("/")[0]: r.own for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
        assert got == {n.split("/")[0]: names[n.split("/")[0]] for _, n, _ in rows}


def test_every_published_text_is_named_right_or_not_at_all(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL": "GFDL-1.3", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}
    names |= {"LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    files = sorted(p for p in folder.iterdir() if p.is_file()) if folder.exists() else []
    rows = [(k, f"{p.name}/COPYING", p.read_text()) for k, p in enumerate(files)]
    if rows:
        got = {r.path.split("/")[0]: r.own for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
        assert got == {p.name: names.get(p.name) for p in files}


def test_unknown_licences_and_identifiers(spark):
    said = {
        "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0", "Licensed under the Nobody Public License, version 2.0.": None, "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "/* SPDX-License-Identifier: LGPL-2.1-or-later */": "LGPL-2.1", "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: GPL-2.0-with-something": None,
        "This work is licensed under the GNU General Public License, version 4.": None, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    }
    rows = [(k, f"d{k}/x.c", f"{line}\nint x;\n") for k, line in enumerate(said)] + [(99, "long/x.c", "word " * 400_000 + "\nSPDX-License-Identifier: ISC\n" + "word " * 400_000)]
    got = {r.doc_id: r.own for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == dict(enumerate(said.values())) | {99: "ISC"}


def test_against_brute_force(spark):
    """Plain cosines over dictionaries, and a walk up the directories."""
    import math
    from collections import Counter

    from opsloom.llm import license_scan as L

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "concat(source, '/', lang, '/', doc_id % 7, '/', doc_id)", "text").collect()]
    lines = [x for _, _, t in docs for x in L.licence_lines(t)]
    seen = Counter(w for x in lines for w in set(L.terms(x)))
    vocabulary = {w for t in L.TEMPLATES.values() for w in L.terms(t)}
    idf = lambda w: math.log((1 + len(lines)) / (1 + (seen[w] if w in vocabulary else 0))) + 1

    def cosine(a, b):
        x, y = ({w: n * idf(w) for w, n in L.terms(t).items()} for t in (a, b))
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(x[w] * y.get(w, 0) for w in x) / size if size else 0

    def nearest(x):
        return min(((-round(cosine(x, t), 12), n.split("#")[0]) for n, t in L.TEMPLATES.items()))

    own, speaks = {}, {}
    for d, p, t in docs:
        tried = [y for x in L.licence_lines(t) for y in [x, *L._SENTENCE.split(x)]]
        passages = L.paragraphs(t or "")
        for i, x in enumerate(passages):
            if L._CUE.search(x):
                tried += [x, *(y for y in L._SENTENCE.split(x) if L._CUE.search(y))]
                k = i + 1
                while k < len(passages) and nearest(f"{x} {passages[k]}")[0] < nearest(x)[0]:
                    x, k = f"{x} {passages[k]}", k + 1
                tried.append(x)
        s, n = min(map(nearest, tried), default=(0, ""))
        own[d] = n if -s >= L.LEAST else None
    out = scan(spark.createDataFrame(docs, "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.own for r in out} == own and any(own.values())
    files = {r.doc_id: r for r in L.own_licences(spark.createDataFrame(docs, "doc_id long, path string, text string")).collect()}
    for d, p, _ in docs:
        if files[d].licence_file:
            name = p.rsplit("/", 1)[0]
            speaks[name] = min(speaks.get(name, (0, "")), (-files[d].score, files[d].own)) if name in speaks else (-files[d].score, files[d].own)
    for r in out:
        want, at = r.own, r.path.rsplit("/", 1)[0]
        while want is None and at is not None:
            want, at = speaks.get(at, (0, None))[1], at.rsplit("/", 1)[0] if "/" in at else ("" if at else None)
        assert r.licence == want


def test_ties_go_to_the_least_name(spark):
    rows = [(9, "d/COPYING", "Released under the MIT License."), (1, "d/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "d/x", "words"), (2, None, None), (3, "e/LICENSE", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r.licence for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {9: "MIT", 1: "Apache-2.0", 5: "Apache-2.0", 2: None, 3: "Apache-2.0"}
