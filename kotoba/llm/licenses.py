"""Operator 10: licence scans, in DataFrame functions alone.

Every line of a text is normalised (lower case, runs of anything but letters and digits as one space) and compared to
licence templates by the Dice coefficient of their sets of word bigrams, 2 |A n B| / (|A| + |B|). As |A n B| is at most
the smaller set, a template whose set is too small or too large for the line can't reach the threshold and is left
out by the sizes alone. All happens inside the row, so nothing is shuffled; the templates are a fixed list.

scan_notices also compares every window of as many words as a template has, over all words of the text, so a notice may be
wrapped over lines, stand within a sentence or in a longer line. A window as similar as asked for shares more than a
share of the template's bigrams, so it holds one of any few of them (the template's anchors); texts without the words of
anchors, and windows without an anchor, are left out by that alone. Of windows that overlap the one that shares the most
bigrams counts. A window takes the place of a line's match only with another licence and more in common.

Defined results: null and empty texts, and lines of one word, match nothing; a line's licence is the one with the
highest coefficient, ties to the smaller name; a document's is that of its best line, ties to the smaller name, then
the earlier line; repeated rows give repeated results; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table, text_or_empty

#: Notices by which works name their licence, and opening paragraphs of licence texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)
#: Templates of windows alone: licence texts, families and tags beyond what lines are compared to.
WINDOW_TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in "Apache-2.0 MIT GPL-3.0 GPL-2.0 LGPL-3.0 LGPL-2.1 AGPL-3.0 MPL-2.0 BSD-3-Clause BSD-2-Clause CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 Unlicense".split()),
)
#: The least Dice coefficient of a match.
THRESHOLD = 0.8
STRINGS = "array<string>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """The set of word bigrams of a normalised text."""
    one = F.split(text, " ")
    pairs = F.zip_with(F.slice(one, 1, F.size(one) - 1), F.slice(one, 2, F.size(one) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(one) > 1, F.array_distinct(pairs)).otherwise(F.array().cast(STRINGS))


def normalised_words(text: str) -> list[str]:
    """The words of normalised() of a template, which is ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """bigrams(normalised()) of a template."""
    words = normalised_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and matches array<struct<line_no, license, dice>> in order of lines, counted from 0."""
    return scan_licenses_of(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)), text, threshold, templates).select("doc_id", "matches")


def scan_licenses_of(docs: DataFrame, text: str, threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """docs with matches."""
    sets = [(name, template_bigrams(body)) for name, body in templates]
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, s)).alias("b"), F.lit(len(s)).alias("n")) for name, s in sets])
    least = int(min(len(s) for _, s in sets) * threshold / (2 - threshold))
    most = int(max(len(s) for _, s in sets) * (2 - threshold) / threshold) + 1

    def judged(line: Column) -> Column:
        # the coefficient if the smaller set lay within the larger one
        near = F.filter(known, lambda t: F.lit(2.0) * F.least(t["n"], line["n"]) / (t["n"] + line["n"]) >= F.lit(threshold))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(t["b"], line["b"])) / (t["n"] + line["n"])).alias("dice"), t["license"].alias("license")))
        # the highest coefficient first, ties to the smaller name
        best = F.array_min(F.transform(scored, lambda s: F.struct((-s["dice"]).alias("less"), s["license"].alias("license"))))
        return F.struct(line["i"].alias("line_no"), best["license"].alias("license"), (-best["less"]).alias("dice"))

    lines = F.transform(F.split(text_or_empty(text), "\n"), lambda x, i: F.struct(i.alias("i"), normalised(x).alias("s")))
    sized = F.transform(F.filter("lines", lambda x: F.instr(x["s"], " ") > 0), lambda x: F.struct(x["i"].alias("i"), bigrams(x["s"]).alias("b")))
    counted = F.filter(F.transform("sized", lambda x: F.struct(x["i"].alias("i"), x["b"].alias("b"), F.size(x["b"]).alias("n"))), lambda x: (x["n"] >= F.lit(least)) & (x["n"] <= F.lit(most)))
    rows = docs.select(*docs.columns, lines.alias("lines"))
    rows = rows.select(*docs.columns, sized.alias("sized")).select(*docs.columns, counted.alias("counted"))
    return rows.select(*docs.columns, F.filter(F.transform("counted", judged), lambda m: m["dice"] >= F.lit(threshold)).alias("matches"))


def anchors(body: str, threshold: float) -> list[str]:
    """So many of a template's bigrams (those of the longest words) that a similar window of its size holds one."""
    found = template_bigrams(body)
    shared = len(found) * threshold / (2 - threshold)  # at least, whatever the size of the window's set
    return sorted(found, key=lambda x: (-max(map(len, x.split())), x))[: int(len(found) - shared + 1e-9) + 1]


def scan_notices(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + WINDOW_TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As scan_licenses, whose matches come first on their lines, and the matches of windows, by the lines they begin in."""
    known = [(name, template_bigrams(body), len(normalised_words(body)), anchors(body, threshold)) for name, body in templates]
    texts = lambda some: F.array(*map(F.lit, some))
    listed = F.array(*[F.struct(F.lit(name).alias("license"), texts(b).alias("b"), F.lit(size).alias("size"), texts(a).alias("anchors")) for name, b, size, a in known])
    hints = texts(sorted({max(x.split(), key=len) for *_, a in known for x in a}))
    every = texts(sorted({x for *_, a in known for x in a}))

    body = text_or_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.split(normalised(body), " ").alias("words"))
    rows = rows.withColumn("words", F.when(F.arrays_overlap("words", hints), F.col("words")).otherwise(F.array().cast(STRINGS)))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.withColumn("pairs", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast(STRINGS)))
    rows = rows.withColumn("held", F.array_intersect("pairs", every))

    def windows(t: Column) -> Column:
        """Those of a template's size that hold an anchor and are similar."""
        last = F.greatest(F.lit(0), F.size("words") - t["size"])
        at = F.filter(F.transform("pairs", lambda x, i: F.when(F.array_contains(t["anchors"], x), i)), lambda i: i.isNotNull())
        first = lambda i: F.greatest(F.lit(0), F.least(last, i - t["size"] + 2))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(first(i), F.greatest(first(i), F.least(last, i))))))

        def measured(i: Column) -> Column:
            mine = F.array_distinct(F.slice("pairs", i + 1, t["size"] - 1))
            return F.transform(F.array(F.size(F.array_intersect(t["b"], mine))), lambda n: F.struct(i.alias("start"), (i + t["size"]).alias("end"), n.alias("shared"), (F.lit(2.0) * n / (F.size(t["b"]) + F.size(mine))).alias("dice"), t["license"].alias("license")))

        return F.filter(F.flatten(F.transform(starts, measured)), lambda w: w["dice"] >= F.lit(threshold))

    kind = "array<struct<start:int,end:int,shared:int,dice:double,license:string>>"
    near = F.filter(listed, lambda t: F.arrays_overlap(t["anchors"], F.col("held")))
    rows = rows.withColumn("windows", F.when(F.size("held") > 0, F.array_sort(F.flatten(F.transform(near, windows)))).otherwise(F.array().cast(kind)).cast(kind))

    def settle(kept: Column, w: Column) -> Column:
        """The better one of overlapping windows: more in common, then more similar, then the smaller name."""
        last = F.element_at(kept, -1)
        better = (w["shared"] > last["shared"]) | (w["shared"] == last["shared"]) & ((w["dice"] > last["dice"]) | (w["dice"] == last["dice"]) & (w["license"] < last["license"]))
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(w))
        return F.when(F.size(kept) == 0, F.array(w)).when(w["start"] >= last["end"], F.concat(kept, F.array(w))).when(better, replaced).otherwise(kept)

    rows = rows.withColumn("kept", F.aggregate("windows", F.array().cast(kind), settle))
    # the lines of words, where there is a match at all
    counts = F.transform(F.split("text", "\n"), lambda x: F.when(normalised(x) == "", 0).otherwise(F.size(F.split(normalised(x), " "))))
    line_of = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i, n)))
    rows = rows.withColumn("line_of", F.when(F.size("kept") > 0, line_of).otherwise(F.array().cast("array<int>")))
    placed = F.transform("kept", lambda w: F.struct(F.element_at("line_of", w["start"] + 1).alias("line_no"), F.element_at("line_of", F.least(w["end"], F.size("line_of"))).alias("to"), w["shared"].alias("shared"), w["dice"].alias("dice"), w["license"].alias("license")))
    found = rows.select("doc_id", "text", placed.alias("placed"))
    lined = scan_licenses_of(found, "text", threshold)
    size_of = lambda m: F.size(F.split(normalised(F.element_at(F.split("text", "\n"), m["line_no"] + 1)), " "))
    touches = lambda w, m: (w["line_no"] <= m["line_no"]) & (m["line_no"] <= w["to"])
    beaten = lambda m: F.exists("placed", lambda w: touches(w, m) & (w["license"] != m["license"]) & ((w["dice"] > m["dice"]) & (w["shared"] >= (size_of(m) - 1) * F.lit(threshold)) | (w["shared"] > size_of(m))))
    lines = lined.withColumn("lines", F.when(F.size("placed") > 0, F.filter("matches", lambda m: ~beaten(m))).otherwise(F.col("matches")))
    told = lambda w: F.exists("lines", lambda m: touches(w, m) & ((w["license"] == m["license"]) | (w["line_no"] == w["to"])))
    more = F.transform(F.filter("placed", lambda w: ~told(w)), lambda w: F.struct(w["line_no"].alias("line_no"), w["license"].alias("license"), w["dice"].alias("dice")))
    return lines.select("doc_id", F.when(F.size("placed") > 0, F.array_sort(F.concat("lines", more))).otherwise(F.col("lines")).alias("matches"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document names."""
    found = scan_notices(table(spark, sf_dir, "documents"))
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("less"), m["license"].alias("license"), m["line_no"].alias("line_no"))))
    return found.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("matches", lambda m: m["line_no"]))).cast("long").alias("n_license_lines"),
        best["license"].alias("license"),
        F.round(-best["less"], 9).alias("dice"),
        best["line_no"].cast("long").alias("line_no"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
    )


def _sql() -> str:
    rows = ", ".join(f"('{name}', {template_bigrams(body)!r})" for name, body in TEMPLATES)
    return rf"""
WITH templates(license, b) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), words AS (
  SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM lines
), sets AS (
  SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1
), scored AS (
  SELECT doc_id, line_no, license, 2.0::DOUBLE * len(list_intersect(t.b, s.b)) / (len(t.b) + len(s.b)) AS dice
  FROM sets s JOIN templates t ON 2.0::DOUBLE * least(len(s.b), len(t.b)) / (len(s.b) + len(t.b)) >= {THRESHOLD}
), best AS (
  SELECT doc_id, line_no, license, dice FROM scored WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) = 1
), documented AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM best GROUP BY doc_id
), top AS (
  SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, line_no) = 1
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_license_lines, t.license, round(t.dice, 9) AS dice, t.line_no::BIGINT AS line_no, coalesce(x.licenses, '') AS licenses
FROM documents d LEFT JOIN documented x ON x.doc_id = d.doc_id LEFT JOIN top t ON t.doc_id = d.doc_id
"""


OP10_SQL = _sql()
