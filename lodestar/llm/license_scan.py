"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. The units of a file are its lines, blocks of neighbouring lines (of each size in BLOCKS, a new
one at every half of it) and its whole text; every unit is compared with the templates' vectors, which are short forms,
file headers and licence texts. Terms are runs of ASCII letters and digits (dotted numbers together) but STOP; weights are
counts times the inverse document frequency over the templates, unknown terms having the greatest.

Two bounds leave units out that can't reach THRESHOLD: one without a cue term (a template's cue terms are its heaviest
ones, so many that the others' norm stays under THRESHOLD), and one whose unknown terms alone outweigh what its known ones
can be. Of the others only the known terms are dealt out; the unknown ones' norm is summed within the row.

A file's own licence is that of its best unit at THRESHOLD or above (ties: the smaller kind of unit, the first, then the
first licence by name). A file declares its licence for its directory if it is a licence file: by its base name, or if its
whole text reaches THRESHOLD. Of several in one directory the one with the smallest id counts. A file without own licence
inherits from the nearest ancestor directory that declares one, its own directory included.

Edge cases: null and empty texts have no own licence; a null path has no ancestors and declares nothing; rows that share
id and path (null or not) are one file, with the best licence of any, and each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import as_text, read, stage_table

THRESHOLD = 0.6
#: Lines of a block; a line is a unit of size 1, the whole text one of size WHOLE.
BLOCKS, WHOLE = (4, 16), 1 << 30
#: Function words of English, which are no terms.
STOP = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "do", "even", "for", "from", "have", "if", "in", "into", "is", "it", "no", "not", "of", "on", "one", "or", "other", "see", "shall", "should", "so", "such", "that", "the", "these", "this", "to", "under", "was", "we", "whether", "which", "whom", "will", "with", "you", "your")
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)^(un)?licen[cs]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"
#: Short forms, headers and texts as they stand in files; a licence may have several.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License. Permission to use, copy, modify, and distribute this software."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _vectors(templates: list[tuple[str, str]], threshold: float) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float, list[str]]:
    """(template, licence, term, unit weight), the terms' idf, that of unknown terms, and the cue terms."""
    counts = []
    for _, text in templates:
        found: dict[str, int] = {}
        for t in re.findall(TERM, text.lower()):
            if t not in STOP:
                found[t] = found.get(t, 0) + 1
        counts.append(found)
    n = len(templates)
    terms = sorted({t for c in counts for t in c})
    idf = {t: math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1 for t in terms}
    rows, cues = [], set()
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        norm = math.sqrt(sum((v * idf[t]) ** 2 for t, v in c.items()))
        weights = {t: v * idf[t] / norm for t, v in c.items()}
        rows += [(k, name, t, w) for t, w in sorted(weights.items())]
        left = 0.0
        for t, w in sorted(weights.items(), key=lambda x: (x[1], x[0])):
            left += w * w
            if left >= 0.999 * threshold * threshold:
                cues.add(t)
    return rows, idf, math.log(1 + n) + 1, sorted(cues)


def _any_of(words: list[str]) -> str:
    """A pattern that matches any of the words, common beginnings taken together."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [re.escape(c) + pattern(rest) for c, rest in sorted(node.items()) if c]
        inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
        return f"(?:{inner})?" if "" in node and inner else inner

    return pattern(tree)


def _units(files: DataFrame, threshold: float) -> DataFrame:
    """row, id, path, size, line, other (sum of squared counts of unknown terms), known (terms) of the units that may reach the threshold."""
    _, idf, _, cues = _vectors(TEMPLATES, threshold)
    cue = rf"(?:^|[^a-z0-9])(?:{_any_of(cues)})(?:[^a-z0-9]|$)"
    files = files.withColumn("text", _lower(as_text())).filter(F.col("text").rlike(cue))
    terms = F.transform(F.split("text", "\n"), lambda x: F.filter(F.regexp_extract_all(x, F.lit(f"({TERM})"), 1), lambda t: ~t.isin(*STOP)))
    files = files.select(F.monotonically_increasing_id().alias("row"), "id", "path", terms.alias("lines")).withColumn("n", F.size("lines"))
    unit = lambda size, line, found: F.struct(F.lit(size).alias("size"), line.cast("int").alias("line"), found.alias("terms"))
    kinds = [F.transform("lines", lambda x, i: unit(1, i, x)), F.array(unit(WHOLE, F.lit(0), F.flatten("lines")))]
    for size in BLOCKS:
        starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size // 2)), lambda i: F.col("n") > 1)
        kinds.append(F.transform(starts, lambda i, size=F.lit(size): unit(size, i, F.flatten(F.slice("lines", i + 1, size)))))  # noqa: B008
    units = files.select("row", "id", "path", F.explode(F.concat(*kinds)).alias("u")).select("row", "id", "path", "u.*")
    units = units.filter(F.exists("terms", lambda t: t.isin(*cues)))
    known = F.filter("terms", lambda t: t.isin(*idf))
    units = units.select("row", "id", "path", "size", "line", known.alias("known"), F.filter("terms", lambda t: ~t.isin(*idf)).alias("unknown"))
    # with a share s of the norm in known terms the cosine is s at most; n known ones weigh n times the greatest weight at most
    units = units.filter(F.size("unknown") <= (1 / threshold**2 - 1) * F.size("known") * F.size("known") + 1e-6)
    # within the sorted terms, a run of n adds 1 + 3 + ... + (2 n - 1) = n * n
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(acc["last"] == t, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(t.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    return units.withColumn("other", F.aggregate(F.array_sort("unknown"), start, step, lambda acc: acc["sum"])).drop("unknown")


def _cosines(units: DataFrame, threshold: float) -> DataFrame:
    """The best template of each unit that reaches the threshold: row, size, line, best (license, score)."""
    spark, keys = units.sparkSession, ["row", "size", "line"]
    rows, idf, most, _ = _vectors(TEMPLATES, threshold)
    terms = spark.createDataFrame([(t, v) for t, v in idf.items()], "term string, idf double")
    weights = spark.createDataFrame(rows, "template int, license string, term string, weight double")
    found = units.select(*keys, "other", F.explode("known").alias("term")).groupBy(*keys, "other", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = stage_table(found.join(F.broadcast(terms), "term").withColumn("w", F.col("tf") * F.col("idf")).drop("idf", "tf"), "license-terms")  # the templates' terms: a fixed few hundred rows
    norms = found.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.first("other") * F.lit(most * most)).alias("norm"))
    dots = found.join(F.broadcast(weights), "term").groupBy(*keys, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    return scored.groupBy(*keys).agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license")).alias("best"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files: id, path, text. Returns id, path, license, score, origin (own, inherited, none), from_dir."""
    files = files.select("id", "path", "text")
    units = stage_table(_units(files, threshold), "license-units", whole=True)
    best = _cosines(units, threshold).groupBy("row").agg(F.min_by("best", F.struct(-F.col("best.score"), "size", "line")).alias("own"), F.max(F.col("size") == WHOLE).alias("file"))
    own = units.select("row", "id", "path").distinct().join(best, "row")
    own = stage_table(own.select("id", "path", "own", "file"), "license-own")
    declared = own.filter(F.col("path").isNotNull() & (F.col("file") | F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME)))
    declared = stage_table(declared.groupBy(_parent(F.col("path")).alias("dir")).agg(F.min_by("own", F.struct("id", "path")).alias("given")), "license-dirs")
    dirs = files.select(_parent(F.col("path")).alias("of")).filter("of is not null").distinct()
    parts = F.split("of", "/")
    chain = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")).distinct()
    near = chain.join(declared, "dir").groupBy("of").agg(F.max_by(F.struct("dir", "given"), F.length("dir")).alias("near"))
    near = stage_table(near, "license-inherited")
    named = own.groupBy("id", "path").agg(F.max_by("own", F.struct("own.score", "own.license")).alias("own"))
    named = stage_table(named.select(F.col("id").alias("__id"), F.col("path").alias("__path"), "own"), "license-named")
    out = files.select("id", "path", _parent(F.col("path")).alias("of"))
    out = out.join(named, out["id"].eqNullSafe(named["__id"]) & out["path"].eqNullSafe(named["__path"]), "left").join(near, "of", "left")
    has = F.col("own").isNotNull()
    return out.select("id", "path", F.coalesce("own.license", "near.given.license").alias("license"), F.coalesce("own.score", "near.given.score").alias("score"), F.when(has, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~has, F.col("near.dir")).alias("from_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as a file tree, for want of paths: source / thousand / fifty / name, every 20th a level higher; a document that opens with a short line is named LICENSE."""
    short = F.length(F.substring_index(as_text(), "\n", 1)).between(1, 80) & F.lower(F.substring_index(as_text(), "\n", 1)).contains("licen")
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    deep = F.when(F.col("doc_id") % 20 != 0, F.concat((F.col("doc_id") % 1000 / 50).cast("int").cast("string"), F.lit("/"))).otherwise("")
    return docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), (F.col("doc_id") / 1000).cast("int").cast("string"), F.lit("/"), deep, name).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(document_files(read(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "path", "license", "score", "origin", "from_dir")


def _oracle() -> str:
    rows, idf, most, _ = _vectors(TEMPLATES, THRESHOLD)
    terms = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in idf.items())
    weights = ", ".join(f"({k}, '{n}', '{t}', {w!r}::DOUBLE)" for k, n, t, w in rows)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    blocks = " UNION ALL ".join(f"SELECT doc_id, {n} AS size, i AS line, array_to_string(parts[i + 1:i + {n}], chr(10)) AS unit FROM parts, unnest(range(0, len(parts), {n // 2})) AS r(i) WHERE len(parts) > 1" for n in BLOCKS)
    return f"""
WITH terms(term, idf) AS (VALUES {terms}), weights(template, license, term, weight) AS (VALUES {weights}),
files AS (SELECT doc_id, {low} AS low, source || '/' || (doc_id // 1000) || '/' ||
  CASE WHEN doc_id % 20 <> 0 THEN (doc_id % 1000 // 50) || '/' ELSE '' END ||
  CASE WHEN length(split_part(coalesce(text, ''), chr(10), 1)) BETWEEN 1 AND 80 AND contains(lower(split_part(coalesce(text, ''), chr(10), 1)), 'licen')
    THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path FROM documents),
parts AS (SELECT doc_id, string_split(low, chr(10)) AS parts FROM files),
units AS (SELECT doc_id, 1 AS size, unnest(range(0, len(parts))) AS line, unnest(parts) AS unit FROM parts
  UNION ALL SELECT doc_id, {WHOLE}, 0, low FROM files UNION ALL {blocks}),
tokens AS (SELECT doc_id, size, line, term, count(*) AS tf FROM (SELECT doc_id, size, line, unnest(regexp_extract_all(unit, '{TERM}')) AS term FROM units) WHERE term NOT IN {STOP} GROUP BY ALL),
w AS (SELECT t.*, tf * coalesce(idf, {most!r}) AS w FROM tokens t LEFT JOIN terms USING (term)),
norms AS (SELECT doc_id, size, line, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT doc_id, size, line, template, license, sum(w * weight) AS dot FROM w JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, size, line, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, size, line) WHERE round(dot / norm, 6) >= {THRESHOLD}),
best AS (SELECT doc_id, license, score, max(size) OVER (PARTITION BY doc_id) = {WHOLE} AS entire FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, size, line, license) = 1),
own AS (SELECT doc_id, license, score, entire OR regexp_matches(path, '/LICENSE[.-]') AS file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM best JOIN files USING (doc_id)),
declared AS (SELECT dir, license, score FROM own WHERE file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY doc_id) = 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS of FROM files),
near AS (SELECT of, d.* FROM dirs JOIN declared d ON of = d.dir OR starts_with(of, d.dir || '/') QUALIFY row_number() OVER (PARTITION BY of ORDER BY length(d.dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score,
  CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN n.of IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.doc_id IS NULL THEN n.dir END AS from_dir
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near n ON n.of = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
"""


ORACLE = _oracle()
