"""License scans: normalised text against licence templates, by the Dice coefficient over distinct word bigrams.

Units of a text are every line, the text as a whole, and spans of words.  A span is a run of words whose bigrams occur in
templates, with at most ``GAPS`` other bigrams in a row: one set of spans for each of the gaps, so a text has a few spans
for each of its words, whatever its lines are.  A licence that is wrapped over lines is found inside a longer text, a
notice inside a longer line, both also with a few foreign words or lines in them.

A unit is normalised to lower-case runs of letters and digits; a template can only reach ``threshold`` if the unit's
bigram count lies within ``threshold / (2 - threshold)`` and its inverse times the template's, so units meet templates
in an equi-join on the size.  Before that, a lossless word test: anchor words are chosen such that a unit without any of
them stays below the threshold for every template.  DataFrame functions only.

Defined results: null and empty texts and texts under two words match nothing; texts are read whole; repeated rows with
one doc_id count as one document; rows without doc_id form one; ties go to the smaller template name, then the earlier
line; only documents with a match are returned; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

THRESHOLD = 0.8
#: Bigrams of no template in a row that a span passes over.
GAPS = (0, 4, 16, 64)

#: Texts of short licences and the notices by which long ones ask to be applied, as published by their stewards.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: The third clause, which stands before the disclaimer.
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", _THIRD + "THIS SOFTWARE IS PROVIDED", 1)
TEXTS["GPL-2.0"] = TEXTS["GPL-3.0"].replace("either version 3 of", "either version 2 of").replace("If not, see <https://www.gnu.org/licenses/>.", "if not, see <https://www.gnu.org/licenses/>.")
TEXTS["LGPL-3.0"] = TEXTS["GPL-3.0"].replace("GNU General", "GNU Lesser General")
_FREE = TEXTS["GPL-3.0"].replace("GNU General", "GNU Lesser General").replace("either version 3 of", "either version 2.1 of").replace("program", "library")
TEXTS["LGPL-2.1"] = _FREE[: _FREE.index("If not, see")] + "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
TEXTS["AGPL-3.0"] = TEXTS["GPL-3.0"].replace("GNU General", "GNU Affero General")
TEXTS["Unlicense"] = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""

#: One-line notices: every form with every name of a licence.
FORMS = ("Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}")
NAMES = {
    "MIT": ("the MIT License",),
    "ISC": ("the ISC License",),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2",),
    "GPL-3.0": ("the GNU General Public License, version 3",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
}


COMMON = {"a", "an", "and", "any", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"}


def templates(full: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(template, licence, text); the notices follow from the forms and names.  ``full``: long texts by licence, which a
    user who has them may add."""
    out = [(f"{k}/text", k, t) for k, t in TEXTS.items()] + [(f"{k}/full", k, t) for k, t in (full or {}).items()]
    return out + [(f"{k}/notice{i}.{j}", k, form.format(name)) for k, names in NAMES.items() for j, name in enumerate(names) for i, form in enumerate(FORMS)]


def normalise(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def anchors(texts: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Words such that a unit with none of them cannot reach the threshold for any text: it shares only the r bigrams
    without an anchor, has r bigrams at least, and so a coefficient of 2 r / (r + size) at most."""
    chosen: list[str] = []
    for grams in map(bigrams, map(normalise, texts)):
        rest = {g for g in grams if not set(g) & set(chosen)}
        while 2 * len(rest) >= threshold * (len(rest) + len(grams)) and rest:
            count = Counter(w for g in rest for w in set(g))
            chosen.append(min(count, key=lambda w: (len(w) < 5, w in COMMON or not w.isalpha(), -count[w], w)))  # rarer in other texts first
            rest = {g for g in rest if chosen[-1] not in g}
    return chosen


def _grams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _holds(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text, made once, holds any of the words as a substring."""
    return F.transform(F.array(F.lower(text)), lambda low: reduce(operator.or_, (F.contains(low, F.lit(w)) for w in words)))[0]


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def bounds(known: list[tuple[str, str, str]], threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bigrams of a unit that reaches the threshold for a template, at least and at most."""
    sizes = [n for _, _, t in known if (n := len(bigrams(normalise(t))))]
    low = threshold / (2 - threshold)
    return max(1, int(min(sizes, default=1) * low)), int(max(sizes, default=0) / low) + 1


def spans(words: Column, known: list[str], least: int, most: int) -> Column:
    """Spans of words: array of (first, last), places of their first and last bigrams from 0."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    kept = lambda places: F.filter(places, lambda k: k.isNotNull())

    def runs(hits: Column) -> Column:
        def of(gap: int) -> Column:
            begins = kept(F.transform(hits, lambda k, j: F.when((j == 0) | (k - F.get(hits, j - 1) > gap + 1), k)))
            ends = kept(F.transform(hits, lambda k, j: F.when((j == F.size(hits) - 1) | (F.get(hits, j + 1) - k > gap + 1), k)))
            return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

        return F.array_distinct(F.filter(F.concat(*map(of, GAPS)), lambda x: (x["last"] - x["first"] + 1).between(least, most)))

    return F.when(F.size(words) > 1, _bound(kept(F.transform(pairs, lambda g, i: F.when(g.isin(known), i))), runs)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def units(text: Column, known: list[str], least: int, most: int) -> Column:
    """Units of a text: array of (line, words)."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), _words(x).alias("words")))

    def of(lines: Column) -> Column:
        at = F.flatten(F.transform(lines, lambda x: F.array_repeat(x["line"], F.size(x["words"]))))

        def with_words(words: Column) -> Column:
            whole = F.array(F.struct(F.lit(0).alias("line"), words.alias("words")))
            some = _bound(at, lambda at: F.transform(spans(words, known, least, most), lambda x: F.struct(F.get(at, x["first"]).alias("line"), F.slice(words, x["first"] + 1, x["last"] - x["first"] + 2).alias("words"))))
            return F.concat(lines, whole, some)

        return _bound(F.flatten(F.transform(lines, lambda x: x["words"])), with_words)

    return _bound(F.filter(numbered, lambda x: x["words"][0] != ""), of)


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Per document with a match: best licence, template, coefficient, first line of the best unit (0 for the whole
    text), number of lines at which matching units begin, and the first of them.

    The template side is a constant (some thousand rows of name and size, and the bigrams of each template), so its
    broadcast does not grow.
    """
    spark = docs.sparkSession
    known = templates() if known is None else known
    low = threshold / (2 - threshold)
    rows, every = [], set()
    for name, licence, text in known:
        grams = sorted(" ".join(g) for g in bigrams(normalise(text)))
        every.update(grams)
        if grams:
            rows.append(F.struct(F.lit(name).alias("template"), F.lit(licence).alias("licence"), F.array(*map(F.lit, grams)).alias("t_grams")))
    side = spark.range(1).select(F.inline(F.array(*rows))).withColumn("t_size", F.size("t_grams"))
    sizes = side.select("template", F.explode(F.sequence(F.ceil(F.lit(low - 1e-9) * F.col("t_size")).cast("int"), F.floor(F.col("t_size") / F.lit(low - 1e-9)).cast("int"))).alias("size"))
    words = anchors([t for _, _, t in known], threshold)
    src = docs.select("doc_id", "text").where(_holds(F.col("text"), words))
    anchor = F.array(*map(F.lit, words))
    # All units of a text at once, so that it is read only once.
    likely = F.filter(units(F.col("text"), sorted(every), *bounds(known, threshold)), lambda x: (F.size(x["words"]) > 1) & F.arrays_overlap(x["words"], anchor))
    found = src.select("doc_id", F.inline(likely)).select("doc_id", "line", _grams(F.col("words")).alias("grams")).withColumn("size", F.size("grams"))
    hits = found.join(F.broadcast(sizes), "size").join(F.broadcast(side), "template")
    hits = hits.withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "t_grams")) / (F.col("size") + F.col("t_size"))).where(F.col("dice") >= threshold)
    best = F.struct((-F.col("dice")).alias("d"), "template", "licence", "line")
    out = hits.groupBy("doc_id").agg(F.min(best).alias("b"), F.countDistinct("line").alias("n_lines"), F.min("line").alias("first_line"))
    return out.select("doc_id", F.col("b.licence").alias("licence"), F.col("b.template").alias("template"), (-F.col("b.d")).alias("dice"), F.col("b.line").alias("line"), "n_lines", "first_line")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle(threshold: float = THRESHOLD) -> str:
    least, most = bounds(templates(), threshold)
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates())
    norm = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT template, licence, {grams} AS tg FROM (SELECT template, licence, {norm.format('txt')} AS w FROM (VALUES {rows}) AS v(template, licence, txt))),
known AS (SELECT DISTINCT unnest(tg) AS gram FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l0 AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS unit, unnest(range(len(string_split(text, chr(10))))) AS line FROM d),
l1 AS (SELECT rid, doc_id, line, {norm.format('unit')} AS w FROM l0),
wd AS (SELECT rid, doc_id, flatten(list(w ORDER BY line)) AS w, flatten(list(list_transform(w, lambda x: line) ORDER BY line)) AS places FROM l1 WHERE w[1] <> '' GROUP BY rid, doc_id),
b0 AS (SELECT rid, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM wd),
b1 AS (SELECT rid, i, unnest({list(GAPS)}) AS gap FROM b0 SEMI JOIN known USING (gram)),
b2 AS (SELECT *, lag(i) OVER (PARTITION BY rid, gap ORDER BY i) AS prev FROM b1),
b3 AS (SELECT *, sum(CASE WHEN i - prev <= gap + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY rid, gap ORDER BY i) AS run FROM b2),
b4 AS (SELECT DISTINCT rid, s, e FROM (SELECT rid, min(i) AS s, max(i) AS e FROM b3 GROUP BY rid, gap, run) WHERE e - s + 1 BETWEEN {least} AND {most}),
u0 AS (SELECT doc_id, line, w FROM l1 UNION ALL SELECT doc_id, 0, w FROM wd UNION ALL SELECT wd.doc_id, wd.places[s], wd.w[s:e + 1] FROM b4 JOIN wd USING (rid)),
u AS (SELECT doc_id, line, {grams} AS g FROM u0 WHERE len(w) > 1),
h AS (SELECT doc_id, line, template, licence, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM u JOIN t
  ON len(g) BETWEEN floor(len(tg) * {threshold / (2 - threshold)}) AND ceil(len(tg) / {threshold / (2 - threshold)})),
m AS (SELECT * FROM h WHERE dice >= {threshold}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template, line) AS k FROM m)
SELECT m.doc_id, b.licence, b.template, b.dice, b.line::INT AS line, count(DISTINCT m.line) AS n_lines, min(m.line)::INT AS first_line
FROM m JOIN b ON b.k = 1 AND b.doc_id IS NOT DISTINCT FROM m.doc_id GROUP BY ALL"""
