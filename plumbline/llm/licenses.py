"""License scans by MinHash bands over overlapping windows (operator 6), native DataFrame operations only.

Texts and templates are lower-cased and cut into words of letters and digits, and every five words in a row are hashed to
a shingle. Each template belongs to the size class of its number of shingles, and a text is seen at each class through
windows of twice that size that overlap by half, so every passage as long as the template lies whole in some window. A
window's sketch has PERMUTATIONS minima, one a band: with the template's shingles at a share of at least SIMILARITY in
the window, their Jaccard coefficient is at least SIMILARITY / 5, and the probability that no band collides is below
(1 - SIMILARITY / 5) ** PERMUTATIONS, about 1e-7 for 96. Equal bands retrieve (window, template) pairs, and the share
of the template's distinct shingles that the window contains is then counted exactly.

Only windows that share a shingle with a template of their class are sketched: in others the containment is zero, and no
band could bring them back. A very long text gives as many windows as its length asks for. A text or template of fewer than five words has one shingle, all of its words; one without words has none and is never reported. A null text counts
as empty. Repeated rows are reported each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise, table

SHINGLE = 5
SIMILARITY = 0.8
PERMUTATIONS = 96

#: Public license notices, as they stand in source files and pages.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl-2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0-permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of every `size` words in a row; of all words where there are fewer; none without words."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= size, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))


def offsets(n: int = PERMUTATIONS) -> list[int]:
    """One constant a permutation: hashes are ordered by their exclusive or with it."""
    draw = random.Random(97)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(n)]


def sketch(shingles: Column) -> Column:
    """The minimum of each permutation, in order: one band each."""
    return F.transform(F.array(*map(F.lit, offsets())), lambda c: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(c))))


def template_table(spark, templates: dict[str, str] | None = None) -> DataFrame:
    """(template, shingles, size_class, n): size_class is the power of two from n up."""
    rows = spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "template string, text string")
    rows = rows.select("template", words_of(F.col("text")).alias("words"))
    rows = rows.select("template", F.array_distinct(shingles_of(F.col("words"))).alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles")).where("n > 0")
    return rows.withColumn("size_class", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int"))


def windows(texts: DataFrame, size: int, wanted: list[int]) -> DataFrame:
    """(row, size_class, at, window): windows of 2 * size shingles that start at every size-th shingle (the last one may
    be shorter) and hold at least one wanted shingle."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - size - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.array_distinct(F.slice("shingles", at + 1, F.lit(2 * size))).alias("window")))
    rows = texts.select("row", F.explode(F.filter(cut, lambda w: F.exists(w["window"], lambda x: x.isin(wanted)))).alias("w"))
    return rows.select("row", F.lit(size).alias("size_class"), "w.at", "w.window")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template, containment, at_shingle): the best window of each template that a text holds at `threshold` or
    more; at_shingle is where the first such window starts."""
    spark = docs.sparkSession
    known = materialise(template_table(spark, templates), "templates")
    # the templates are a list in this program: their shingles are a constant of the query
    wanted: dict[int, list[int]] = {}
    for r in known.select("size_class", "shingles").collect():
        wanted.setdefault(r.size_class, []).extend(r.shingles)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text).cast("string")).alias("words"))
    rows = rows.select("row", "key", shingles_of(F.col("words")).alias("shingles"))  # words are used often: a column of their own
    every = sorted({x for own in wanted.values() for x in own})
    rows = materialise(rows.where(F.exists("shingles", lambda x: x.isin(every))) if every else rows.where("false"), "screened")
    seen = reduce(DataFrame.unionByName, [windows(rows, size, own) for size, own in sorted(wanted.items())] or [windows(rows, 1, [0])])
    seen = materialise(seen, "windows")
    bands = seen.select("row", "at", "size_class", "window", F.posexplode(sketch(F.col("window"))).alias("band", "low"))
    probes = known.select("template", "size_class", F.col("shingles").alias("wanted"), F.posexplode(sketch(F.col("shingles"))).alias("band", "low"))
    # the templates are given by the caller, not by the data; Spark measures their table before it broadcasts it
    met = bands.join(probes, ["size_class", "band", "low"])
    met = met.groupBy("row", "at", "template").agg(F.first("window").alias("window"), F.first("wanted").alias("wanted"))
    share = F.size(F.array_intersect("window", "wanted")) / F.size("wanted")
    scored = met.select("row", "template", "at", share.alias("containment")).where(F.col("containment") >= threshold)
    best = scored.groupBy("row", "template").agg(F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("m"))
    return best.join(rows.select("row", "key"), "row").select(F.col("key").alias(key), "template", F.col("m.containment").alias("containment"), (-F.col("m.back")).cast("long").alias("at_shingle"))


def op6_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    """The exact windows and containments, without sketches."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))

    def sh(source: str, key: str) -> str:
        return f"""SELECT {key}, CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {source})"""

    return f"""
WITH t AS (SELECT template, list_distinct(s) AS wanted, len(list_distinct(s)) AS n, power(2, ceil(log2(len(list_distinct(s)))))::INT AS c
           FROM ({sh(f"(SELECT * FROM (VALUES {values}) v(template, text))", "template")}) WHERE len(s) > 0),
any_of AS (SELECT list_distinct(flatten(list(wanted))) AS a FROM t),
d AS (SELECT doc_id, s FROM ({sh("documents", "doc_id")}), any_of WHERE list_has_any(s, a)),
w AS (SELECT doc_id, t.template, t.wanted, t.n, pos, list_slice(s, pos + 1, pos + 2 * t.c) AS win
      FROM d, t, unnest(range(0, greatest(len(s) - t.c - 1, 0) + 1, t.c)) AS u(pos)),
m AS (SELECT doc_id, template, pos, len(list_intersect(list_distinct(win), wanted)) * 1.0 / n AS containment FROM w)
SELECT doc_id, template, max(containment) AS containment, arg_min(pos, (-containment, pos))::BIGINT AS at_shingle
FROM m WHERE containment >= {SIMILARITY} GROUP BY 1, 2
"""
