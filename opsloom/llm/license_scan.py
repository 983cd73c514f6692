"""License scans: TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Compared with the templates, as sparse TF-IDF vectors, are of every whole text: each line that names a licence or a
copyright; the header or passage that starts with such a paragraph, whole, which takes in the paragraphs behind it as
long as that brings it nearer to a template; the sentences of these that name one; and the whole text of a file with a
licence file's name. Templates are short notices, standard headers, titles and whole licence texts. Document frequencies
of the templates' words are counted over all such lines of the corpus; words of no template weigh as if no line had
them. A file's own licence is its best template at a cosine of ``LEAST`` or more. A file whose licence passages make up
at least ``NOTICE`` of its words, or whose name is a licence file's, speaks for its directory; a file without a licence
of its own takes that of its nearest ancestor directory, found by joining the distinct directories' ancestors with the
licensed directories.

A template counts only where the licence's own name and version stand in what is compared (``MUST``), as the texts of many
licences are each other's neighbours: a licence that no template knows stays unnamed. A line of an SPDX identifier has to
be equal to its template. What a notice says about the licence is not read: "is not licensed under" names it as well.

Defined results: of equal scores the licence whose name is least wins, within a text and within a directory, where the
best score comes first; null and empty texts have no licence of their own; a null path has no directory; repeated rows
are scanned each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Scratch

#: Short notices and headers by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-2.0#short": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT#short": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
    "GPL-3.0#short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, the Creative Commons Attribution-ShareAlike License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0#header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0#title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "GPL-2.0#header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0#title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0#title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0#header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0#header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0#title": "Mozilla Public License Version 2.0",
    "GPL-2.0#only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1#header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "AGPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0#title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.",
    "BSD-2-Clause#text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause#text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC#text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense#text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    "MIT#text": "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-1.0#title": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "LGPL-2.0#title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.0#header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-1.1#title": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-1.1#header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "GFDL-1.2#title": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3#title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "CC0-1.0#title": "Creative Commons Legal Code CC0 1.0 Universal",
    "CC0-1.0#header": "To the extent possible under law, the person who associated CC0 1.0 with this work has waived all copyright and related or neighboring rights to this work.",
    "Artistic-1.0#title": "The \"Artistic License\" Preamble",
    "EPL-1.0#short": "Licensed under the Eclipse Public License, version 1.0.",
    "EPL-1.0#title": "Eclipse Public License - v 1.0",
    "EPL-2.0#short": "Licensed under the Eclipse Public License, version 2.0.",
    "EPL-2.0#title": "Eclipse Public License - v 2.0",
}
_V1, _V2, _V3 = {"1", "1.0", "v1", "v1.0"}, {"2", "2.0", "v2", "v2.0"}, {"3", "3.0", "v3", "v3.0"}
#: Of each set of words one has to stand in what is named by a licence: its own name and its version.
MUST = {
    "Apache-2.0": ({"apache"}, _V2), "MIT": ({"mit", "granted"},), "GPL-1.0": ({"gnu"}, {"general"}, _V1), "GPL-2.0": ({"gnu"}, {"general"}, _V2), "GPL-3.0": ({"gnu"}, {"general"}, _V3),
    "LGPL-2.0": ({"library"}, {"gnu"}, _V2), "LGPL-2.1": ({"lesser"}, {"2.1", "v2.1"}), "LGPL-3.0": ({"lesser"}, _V3), "AGPL-3.0": ({"affero"}, _V3), "BSD-2-Clause": ({"redistribution"},), "BSD-3-Clause": ({"redistribution"}, {"3", "endorse"}),
    "MPL-1.1": ({"mozilla"}, {"1.1", "v1.1"}), "MPL-2.0": ({"mozilla", "mpl"}, _V2), "CC-BY-4.0": ({"cc", "creative"}, {"by", "attribution"}, {"4.0"}), "CC-BY-SA-4.0": ({"sa", "sharealike"}, {"4.0"}), "CC-BY-NC-4.0": ({"nc", "noncommercial"}, {"4.0"}),
    "ISC": ({"permission"}, {"fee"}), "Unlicense": ({"unencumbered", "unlicense"},), "GFDL-1.2": ({"documentation"}, {"1.2", "v1.2"}), "GFDL-1.3": ({"documentation"}, {"1.3", "v1.3"}), "CC0-1.0": ({"cc0"}, {"1.0"}),
    "Artistic-1.0": ({"artistic"},), "EPL-1.0": ({"eclipse"}, _V1), "EPL-2.0": ({"eclipse"}, _V2),
}
# lines that name a licence by its identifier alone have to be such a line to the word
TEMPLATES |= {f"{name}#spdx{end}": f"SPDX-License-Identifier: {name}{end}" for name in MUST for end in (("", "-only", "-or-later") if "GPL" in name or "GFDL" in name else ("",))}
LEAST, NOTICE, EXACT = 0.6, 0.5, 0.999999
SCHEMA = "doc_id long, path string, own string, score double, n_lines long, licence_file boolean"
_CUE = re.compile(r"licen[sc]e|copyright|spdx|creative commons|permission is hereby|permission to use|public domain|redistribution and use", re.I)
_COMMENT = re.compile(r"\s*(#|//|/?\*|--|;|%|dnl\b|<!--)")
_BARE = re.compile(r"[\W_]*")
_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_NAME = re.compile(r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$")


def licence_lines(text: str | None):
    """The lines of a text that name a licence or copyright."""
    out, at = [], 0
    text = text or ""
    while (m := _CUE.search(text, at)) is not None:
        a, z = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        z = len(text) if z < 0 else z
        out.append(text[a:z])
        at = z
    return out


def paragraphs(text: str) -> list[str]:
    """The runs of adjacent lines, all of a comment or all not, without comment marks. Bare lines part them."""
    out, run, last = [], [], None
    for line in [*text.split("\n"), ""]:
        kind = None if _BARE.fullmatch(line) else bool(_COMMENT.match(line))
        if kind != last and run:
            out.append(" ".join(run))
            run = []
        if kind is not None:
            run.append(_COMMENT.sub("", line, count=1).strip() if kind else line.strip())
        last = kind
    return out


def terms(line: str) -> Counter:
    return Counter(_WORD.findall(line.lower()))


class Templates:
    def __init__(self, df: dict[str, int], n_lines: int):
        self.idf = {w: math.log((1 + n_lines) / (1 + df.get(w, 0))) + 1 for t in TEMPLATES.values() for w in terms(t)}
        self.rare = math.log(1 + n_lines) + 1
        self.names, self.exact, self.postings = [n.split("#")[0] for n in TEMPLATES], ["#spdx" in n for n in TEMPLATES], {}
        for k, t in enumerate(TEMPLATES.values()):
            for w, x in self.vector(t).items():
                self.postings.setdefault(w, []).append((k, x))

    def vector(self, line: str) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rare) for w, n in terms(line).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    def nearest(self, line: str) -> tuple[float, str]:
        """Score and name of the template nearest to a whole line; of equals the least name."""
        found, v, scores = (0.0, ""), self.vector(line), [0.0] * len(self.names)
        for w, x in v.items():
            for k, y in self.postings.get(w, ()):
                scores[k] += x * y
        for k, s in enumerate(scores):
            s, name = round(s, 12), self.names[k]
            if s and (-s, name) < (-found[0], found[1]) and (s >= EXACT if self.exact[k] else all(not words.isdisjoint(v) for words in MUST[name])):
                found = (s, name)
        return found

    def best(self, line: str, block: bool = False) -> tuple[float, str, int]:
        """Score and name of the nearest template, and words compared; a sentence in a longer line counts as itself
        too (of a block only one that names a licence)."""
        parts = [line, *(p for p in _SENTENCE.split(line) if p != line and (not block or _CUE.search(p)))]
        return min(((*self.nearest(p), len(p.split())) for p in parts), key=lambda x: (-x[0], x[1], -x[2]))

    def passages(self, text: str | None):
        """``best`` of each passage: a paragraph that names a licence, with those behind it that bring it nearer."""
        if not text or not _CUE.search(text):
            return
        own, i = paragraphs(text), 0
        while i < len(own):
            if not _CUE.search(own[i]):
                i += 1
                continue
            line, found, k = own[i], self.nearest(own[i]), i + 1
            while k < len(own) and (more := self.nearest(f"{line} {own[k]}"))[0] > found[0]:
                line, found, k = f"{line} {own[k]}", more, k + 1
            yield min(self.best(own[i], True), (*found, len(line.split())), key=lambda x: (-x[0], x[1], -x[2]))
            i += 1


def own_licences(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """One row a file: doc_id, path, own (null: none), score, n_lines, licence_file."""
    rows = files.select(F.col(key).cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    vocabulary = sorted({w for t in TEMPLATES.values() for w in terms(t)})

    def count(frames):
        df, n, known = Counter(), 0, set(vocabulary)
        for f in frames:
            for t in f["text"]:
                for line in licence_lines(t):
                    n += 1
                    df.update(known.intersection(terms(line)))
        yield pd.DataFrame({"word": ["", *df], "n": [n, *df.values()]})

    counted = {r.word: r.n for r in rows.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    shared = files.sparkSession.sparkContext.broadcast(Templates(counted, counted.get("", 0)))  # bounded by the templates

    def scan(frames):
        for f in frames:
            out = []
            for d, p, t in zip(f["doc_id"], f["path"], f["text"], strict=True):
                lines = licence_lines(t)
                named = bool(p and _NAME.match(p.rsplit("/", 1)[-1]))
                passages = list(shared.value.passages(t))
                whole = [shared.value.best(" ".join(t.split()), True)] if named and t else []
                score, name, _ = min((*(shared.value.best(x) for x in lines), *passages, *whole), default=(0.0, "", 0), key=lambda x: (-x[0], x[1]))
                own = name if score >= LEAST else None
                notice = max(sum(len(x.split()) for x in lines), max((n for s, _, n in passages if s >= LEAST), default=0))
                share = notice / max(1, len(t.split())) if own else 0
                out.append((d, p, own, score, len(lines), bool(own and (named or share >= NOTICE))))
            frame = pd.DataFrame(out, columns=["doc_id", "path", "own", "score", "n_lines", "licence_file"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(scan, SCHEMA)


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row a file: doc_id, path, own, score, n_lines, licence (own or inherited), from_dir (null if own)."""
    scratch = scratch or Scratch(files.sparkSession)
    own = scratch.write(own_licences(files, key, path, text).withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))), "licences")
    licensed = own.where("licence_file and dir is not null").groupBy("dir").agg(F.min_by("own", F.struct(-F.col("score"), "own")).alias("licence"))
    steps = F.split("dir", "/")
    dirs = own.where("own is null and dir is not null").select("dir").distinct()
    # "a/b/c" has the ancestors "", "a", "a/b" and itself
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("above"))
    near = above.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("above", "licence"), F.length("above")).alias("near"))
    near = scratch.write(near, "near")
    joined = own.join(near, "dir", "left")
    return joined.select("doc_id", "path", "own", "score", "n_lines", F.coalesce("own", "near.licence").alias("licence"), F.when(F.col("own").isNull(), F.col("near.above")).alias("from_dir"))
