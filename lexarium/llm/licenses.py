"""License scans with DataFrame functions only.

A text is normalised (lower case, what is no letter or digit becomes one space)
and its units are compared with license templates by the Dice coefficient of
the sets of word bigrams. Units are

* each line,
* the whole text, if it has several lines,
* passages: lines of which half the bigrams are a template's touch it, and
  touching lines with at most ``GAP`` others between them are one passage, from
  the first to the last; so a notice wrapped over lines, in a comment block or
  with a name put in, is compared as a whole wherever it stands.

Pruning loses nothing: a match shares so many of a template's bigrams that it
holds one of a few words (``needed_words``); most texts have none of them and
end there. Size bounds come next: a unit of n
bigrams can reach the threshold t only with templates of between n*t/(2-t) and
n*(2-t)/t bigrams, so a unit meets only the templates of its bounds. What is
left is joined to the templates by bigram.

Null and empty texts, and units of fewer than two words, match nothing. Ties
between templates go to the first by name. Very long texts are read whole.
Equal rows get equal results, with one row out for each row in; rows are told
apart by doc_id and the hash of the text, a null doc_id included. An empty table
gives an empty result; further columns do not enter. The templates are a
parameter, part of the program or a list of that order: they are the only thing
that is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexarium.llm._shared import durable, table

THRESHOLD = 0.8
#: Lines between two that touch a template which still belong to their passage.
GAP = 2
#: Words that stand in many texts, which tell little about licenses.
COMMON = frozenset("a all and any be by for from has have in is it not of on or other that the this to under use with without you your".split())

#: License notices as projects publish them.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def normal(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def bigrams(text: str) -> list[str]:
    words = normal(text).split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed_words(own: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every unit with a match has one.

    A match shares at least m*t/(2-t) of a template's m bigrams, so it holds one
    of any m - that + 1 of them, and the word of that bigram which tells more.
    """
    needed: set[str] = set()
    for grams in own.values():
        must = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        telling = [max(g.split(" "), key=lambda w: (w not in COMMON, len(w), w)) for g in grams]
        needed.update(sorted(telling, key=lambda w: (w in needed, w not in COMMON, len(w), w), reverse=True)[: len(grams) - must + 1])
    return sorted(needed)


def _grams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def _in_bounds(n: Column, m: Column, t: float) -> Column:
    return (n * (2 - t) + 1e-9 >= m * t) & (n * t <= m * (2 - t) + 1e-9)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_matches, licenses, best_license, best_dice) of each row of ``docs``; n_matches: templates that some unit matches."""
    spark = docs.sparkSession
    own = {name: bigrams(text) for name, text in sorted((templates or TEMPLATES).items())}
    widest = int(max(map(len, own.values())) * (2 - threshold) / threshold) + 1
    known = F.broadcast(spark.createDataFrame([(name, len(grams), g) for name, grams in own.items() for g in grams], "license string, m int, gram string"))

    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("mark"), (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lower("text").alias("text"))
    telling = keyed.where(F.arrays_overlap(F.split("text", "[^a-z0-9]+"), F.array(*[F.lit(w) for w in needed_words(own, threshold)])))
    lines = F.transform(F.split("text", "\n", -1), _words)
    read = durable(telling.dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", lines.alias("lines")))

    each = read.select("doc_id", "mark", F.posexplode("lines").alias("i", "words"))
    whole = read.where(F.size("lines") > 1).select("doc_id", "mark", F.lit(-1).alias("i"), F.flatten("lines").alias("words")).where(F.size(F.array_distinct("words")) <= widest + 1)
    units = each.union(whole).where(F.size("words") > 1).select("doc_id", "mark", "i", _grams(F.col("words")).alias("grams"))
    met = (
        units.select("doc_id", "mark", "i", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(known, "gram")
        .groupBy("doc_id", "mark", "i", "n", "license", "m").agg(F.count("*").alias("shared"))
    )
    met = durable(met.where(_in_bounds(F.col("n"), F.col("m"), threshold) | (F.col("i") >= 0) & (2 * F.col("shared") >= F.col("n"))))
    dice = (2.0 * F.col("shared") / (F.col("n") + F.col("m"))).alias("dice")

    line = Window.partitionBy("doc_id", "mark", "license").orderBy("i")
    touching = met.where((F.col("i") >= 0) & (2 * F.col("shared") >= F.col("n"))).select("doc_id", "mark", "license", "m", "i", F.when(F.col("i") - F.lag("i").over(line) <= GAP + 1, 0).otherwise(1).alias("new"))
    passages = (
        touching.withColumn("passage", F.sum("new").over(line)).groupBy("doc_id", "mark", "license", "m", "passage").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
        .where("hi > lo").withColumnRenamed("doc_id", "doc").withColumnRenamed("mark", "its")
    )
    cut = (
        passages.join(read, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("its") == F.col("mark")))
        .select("doc_id", "mark", "license", "m", "passage", _grams(F.flatten(F.slice("lines", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))).alias("grams"))
        .where(_in_bounds(F.size("grams"), F.col("m"), threshold))
    )
    long = (
        cut.select("doc_id", "mark", "license", "m", "passage", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(known.drop("m"), ["gram", "license"])
        .groupBy("doc_id", "mark", "license", "m", "passage", "n").agg(F.count("*").alias("shared"))
    )
    matches = met.select("doc_id", "mark", "license", dice).union(long.select("doc_id", "mark", "license", dice)).where(F.col("dice") >= threshold)
    found = (
        matches.groupBy("doc_id", "mark", "license").agg(F.max("dice").alias("dice"))
        .groupBy(F.col("doc_id").alias("doc"), F.col("mark").alias("its"))
        .agg(F.array_sort(F.collect_list("license")).alias("names"), F.min(F.struct((-F.col("dice")).alias("less"), F.col("license").alias("name"))).alias("best"))
    )
    return keyed.select("doc_id", "mark", "n_lines").join(found, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("its") == F.col("mark")), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.col("best.name").alias("best_license"), F.coalesce(F.round(-F.col("best.less"), 6), F.lit(0.0)).alias("best_dice"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(threshold: float = THRESHOLD, gap: int = GAP) -> str:
    """DuckDB: every line, whole text and passage against every template, without pruning."""
    listed = ", ".join("('%s', '%s')" % (name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {words.format('text')} AS w FROM (VALUES {listed}) v(name, text))),
    tg AS (SELECT name, len(g) AS m, unnest(g) AS gram FROM t),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT r, i, {words.format('ls[i]')} AS w FROM (SELECT r, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d))),
    u AS (SELECT r, i, w FROM l WHERE len(w) > 1 UNION ALL SELECT r, 0, {words.format('text')} FROM d WHERE contains(text, chr(10))),
    ug AS (SELECT r, i, len(g) AS n, unnest(g) AS gram FROM (SELECT r, i, {grams} AS g FROM u)),
    x AS (SELECT r, i, n, name, m, count(*) AS shared FROM ug JOIN tg USING (gram) GROUP BY ALL),
    h AS (SELECT *, i - lag(i) OVER (PARTITION BY r, name ORDER BY i) AS step FROM x WHERE i > 0 AND 2 * shared >= n),
    p AS (SELECT *, sum(CASE WHEN step <= {gap + 1} THEN 0 ELSE 1 END) OVER (PARTITION BY r, name ORDER BY i) AS passage FROM h),
    q AS (SELECT r, name, m, passage, min(i) AS lo, max(i) AS hi FROM p GROUP BY ALL HAVING max(i) > min(i)),
    qw AS (SELECT r, name, m, passage, flatten(list(l.w ORDER BY l.i)) AS w FROM q JOIN l USING (r) WHERE l.i BETWEEN lo AND hi GROUP BY ALL),
    qg AS (SELECT r, name, m, passage, len(g) AS n, unnest(g) AS gram FROM (SELECT r, name, m, passage, {grams} AS g FROM qw)),
    y AS (SELECT r, passage, n, name, qg.m, count(*) AS shared FROM qg JOIN tg USING (gram, name) GROUP BY ALL),
    z AS (SELECT r, name, max(2.0 * shared / (n + m)) AS dice FROM (SELECT r, n, name, m, shared FROM x UNION ALL SELECT r, n, name, m, shared FROM y) GROUP BY ALL HAVING max(2.0 * shared / (n + m)) >= {threshold}),
    b AS (SELECT r, count(*) AS n_matches, string_agg(name, ',' ORDER BY name) AS licenses, max(dice) AS best_dice, arg_min(name, (-dice, name)) AS best_license FROM z GROUP BY r)
    SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, best_license,
           CAST(coalesce(round(best_dice, 6), 0) AS DOUBLE) AS best_dice FROM d LEFT JOIN b USING (r)
    """
