"""License scans: MinHash bands over overlapping text windows, verified by exact containment.

Only column expressions: a document's word shingles are hashed once, windows of a template's length
slide over them, and a window whose MinHash agrees with the template's on all rows of one band is
verified by the share of the template's shingles that it holds. Two tests that lose nothing go before:
a text must hold one of the words without which no window can match, and a window must hold a shingle
that is a minimum of the template, as one without cannot agree on any band.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Notices by licence, one sentence or a whole text.
TEMPLATES = {
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
#: Notices that differ in few words: of each group a report names those that a text holds most of.
ALIKE = (
    ("AGPL-3.0-header", "GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header"),
    ("BSD-2-Clause-text", "BSD-3-Clause-text"),
)
SHINGLE = 5
BANDS = 64
ROWS = 2
CONTAINED = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "[^a-z0-9\\x{80}-\\x{10ffff}]+"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)))


def collision_probability(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of this similarity agree on some band."""
    return 1 - (1 - jaccard**rows) ** bands


def stride(words: int) -> int:
    """Words between the starts of neighbouring windows for a template of so many words."""
    return max(1, words // 4)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of a text's word shingles in order; fewer words than ``size`` give none."""
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAK), "")
    slide = lambda h: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(h)), lambda i: i <= F.size(h) - size),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]),
    )
    return _let(F.transform(words, lambda w: F.xxhash64(w)), slide)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _permuted(x: Column, row: Column) -> Column:
    return F.xxhash64(x, row)


def anchors(templates: Iterable[str], size: int, least: float) -> list[str]:
    """Words of which every text that holds ``least`` of a template's shingles holds one.

    A word stands for all words that it is a part of. For each template, the shortest first, words are
    taken, the longest first, until the shingles that hold any of them are too many to be done without.
    """
    taken: list[str] = []
    for text in sorted(templates, key=len):
        w = template_words(text)
        shingles = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        rest = sorted(set(w), key=lambda x: (-len(x), x))
        while sum(any(a in x for x in s for a in taken) for s in shingles) <= (1 - least) * len(shingles) + 1e-9:
            taken.append(rest.pop(0))
    return sorted(a for a in set(taken) if not any(b != a and b in a for b in taken))


def index(spark: SparkSession, templates: dict[str, str], bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row a template: license, step and width of its windows, its shingles h, their minima xs, and the
    bands, each the permutations i0, i1, ... with the smallest value p0, p1, ... of each."""
    if any(len(template_words(t)) < size for t in templates.values()):
        raise ValueError(f"a template needs {size} words at least")
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text"), F.lit(len(template_words(t))).alias("words")) for n, t in templates.items()])
    hashed = spark.range(1).select(F.inline(listed)).withColumn("h", F.array_distinct(shingle_hashes(F.col("text"), size)))
    lowest = lambda r: F.array_min(F.transform("h", lambda x: F.struct(_permuted(x, r).alias("p"), x.alias("x"))))
    minima = hashed.withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lowest))
    band = lambda b: F.struct(*[c for r in range(rows) for c in ((b * rows + r).alias(f"i{r}"), F.get("m", b * rows + r)["p"].alias(f"p{r}"))])
    step = F.greatest(F.lit(1), F.floor(F.col("words") / 4)).cast("int")
    return minima.select("license", step.alias("step"), (F.col("words") - size + 1 + step).alias("width"), "h", F.array_distinct(F.transform("m", lambda m: m["x"])).alias("xs"), F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band).alias("bands"))


def _matches(h: Column, t: Column, rows: int, least: float) -> Column:
    """Best window of a text for one row of the index: struct (license, containment, start_word, windows), or null."""
    hits = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(t["xs"], x), i)), lambda i: i.isNotNull())
    windows = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(F.lit(0), F.ceil((i - t["width"] + 1) / t["step"]).cast("int")), F.floor(i / t["step"]).cast("int")))))

    def agrees(inside: Column) -> Column:
        least_of = lambda r, b: F.array_min(F.transform(inside, lambda x: _permuted(x, b[f"i{r}"]))) == b[f"p{r}"]
        return F.exists(t["bands"], lambda b: _all([least_of(r, b) for r in range(rows)]))

    at = lambda w: F.slice(h, w * t["step"] + 1, t["width"])
    found = F.transform(F.filter(windows, lambda w: _let(at(w), agrees)), lambda w: F.struct((F.size(F.array_intersect(at(w), t["h"])) / F.size(t["h"])).alias("containment"), (-w * t["step"]).alias("back")))
    kept = F.filter(found, lambda x: x["containment"] >= least)
    most = lambda k: _let(F.array_max(k), lambda best: F.struct(t["license"].alias("license"), best["containment"].alias("containment"), (-best["back"]).alias("start_word"), F.size(k).alias("windows")))
    return _let(kept, lambda k: F.when(F.size(k) > 0, most(k)))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, least: float = CONTAINED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, matches) of every row; matches lists license, containment, start_word and windows.

    A template of L words is compared with windows of L words and a quarter more, a quarter apart, so
    any place where it stands lies in a window. A window matches if it holds at least ``least`` of the
    template's distinct shingles of ``size`` words; words are lower-cased A-Z and split at ASCII
    characters that are neither letters nor digits. Null, empty and short texts match nothing; repeated
    rows stay; null ids pass through; an empty table gives an empty one; other columns are not read.
    One projection: no shuffle, no join; the templates are one literal array, a few hundred notices at most. A text is looked at more closely only if it holds an anchor word, a minimum of some template,
    and for each template one of its minima.
    """
    templates = TEMPLATES if templates is None else templates
    listed = index(docs.sparkSession, templates, bands, rows, size)
    lowered, likely = F.lower(F.col(text)), F.lit(False)
    for word in anchors(templates.values(), size, least):
        likely = likely | F.contains(lowered, F.lit(word))
    # One JSON literal, which the optimiser parses once: a call for each number would take longer than a scan.
    lines = [r[0] for r in listed.orderBy("license").select(F.to_json(F.struct(*[F.col(c) for c in listed.columns]))).collect()]
    known = F.from_json(F.lit(f"[{','.join(lines)}]"), T.ArrayType(listed.schema))
    minima = F.from_json(F.lit(json.dumps(sorted({x for line in lines for x in json.loads(line)["xs"]}))), "array<bigint>")
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.when(likely, F.col(text)).alias("__text"))
    # Generated rows are a barrier: the optimiser would else hash a text anew for each use.
    hashed = hashed.select("doc_id", F.explode(F.array(F.when(F.col("__text").isNotNull(), shingle_hashes(F.col("__text"), size)))).alias("__h"))
    h = F.col("__h")
    found = F.array_compact(F.transform(known, lambda t: F.when(F.arrays_overlap(h, t["xs"]), _matches(h, t, rows, least))))
    none = F.array().cast("array<struct<license:string,containment:double,start_word:int,windows:int>>")
    return hashed.select("doc_id", F.coalesce(F.when(h.isNotNull() & F.arrays_overlap(h, minima), found), none).alias("matches"))


def report(found: DataFrame, alike: Sequence[Sequence[str]] = ALIKE) -> DataFrame:
    """(doc_id, n_licenses, licenses, best_containment) of each row.

    Of a group of notices that are alike only those with the highest containment count.
    """
    group = lambda m: _group(m["license"], alike)
    beaten = lambda m: F.exists("matches", lambda o: (group(o) == group(m)) & (o["containment"] > m["containment"]))
    best = found.select("doc_id", F.filter("matches", lambda m: ~beaten(m)).alias("matches"))
    names = F.array_sort(F.transform("matches", lambda m: m["license"]))
    return best.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("best_containment"))


def _group(name: Column, alike: Sequence[Sequence[str]]) -> Column:
    """The first notice of the group that a notice belongs to, or itself."""
    out = name
    for names in alike:
        out = F.when(name.isin(*names), F.lit(names[0])).otherwise(out)
    return out


def oracle(templates: dict[str, str] | None = None, size: int = SHINGLE, least: float = CONTAINED, alike: Sequence[Sequence[str]] = ALIKE) -> str:
    """DuckDB SQL for ``report(scan(documents))``: containment in all windows, without MinHash."""
    templates = TEMPLATES if templates is None else templates
    lines = []
    for name, text in templates.items():
        w = template_words(text)
        shingles = list(dict.fromkeys(" ".join(w[i : i + size]) for i in range(len(w) - size + 1)))
        group = next((names[0] for names in alike if name in names), name)
        lines += [f"('{name}', '{group}', {len(shingles)}, {stride(len(w))}, {len(w) - size + 1 + stride(len(w))}, '{s}')" for s in shingles]
    glue = " || ' ' || ".join(f"w[i + {j}]" for j in range(size))
    return f"""
WITH t(license, alike, n, step, width, shingle) AS (VALUES {", ".join(lines)}),
d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM d WHERE len(w) >= {size}),
s AS (SELECT doc_id, i - 1 AS pos, {glue} AS shingle FROM p),
m AS (SELECT doc_id, pos, s.shingle, license, alike, n, step, width FROM s JOIN t ON s.shingle = t.shingle),
x AS (SELECT doc_id, license, alike, n, shingle, unnest(range(greatest(0, CAST(ceil((pos - width + 1) / CAST(step AS DOUBLE)) AS BIGINT)), CAST(floor(pos / CAST(step AS DOUBLE)) AS BIGINT) + 1)) AS win FROM m),
c AS (SELECT doc_id, license, alike, win, count(DISTINCT shingle) / CAST(any_value(n) AS DOUBLE) AS containment FROM x GROUP BY doc_id, license, alike, win),
a AS (SELECT doc_id, license, alike, max(containment) AS containment FROM c WHERE containment >= {least} GROUP BY doc_id, license, alike),
b AS (SELECT doc_id, license, containment FROM (SELECT *, max(containment) OVER (PARTITION BY doc_id, alike) AS top FROM a) WHERE containment = top),
g AS (SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, max(containment) AS best_containment FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(best_containment, 0.0) AS best_containment
FROM documents d LEFT JOIN g USING (doc_id)"""
