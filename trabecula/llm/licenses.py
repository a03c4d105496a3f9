"""License scans, in DataFrame operations only: sparse TF-IDF cosine to templates, and inheritance from directories.

Every line of every file is compared with the statements in TEMPLATES. Lines, two and three adjoining lines, header blocks and
whole texts are also compared with the statements, the licences' notices and their full texts; titles and SPDX tags must
match term for term, as they differ from other licences' in a word. The best of all counts. A line's vector holds its terms' counts times the inverse frequencies
of the template terms over all files; a term that no template has weighs OTHER. A line whose cosine with a template is below
THRESHOLD for want of the template's heavy terms is left out beforehand: the heaviest terms are chosen so that the rest of a
template can't reach the threshold. A file without a license of its own has that of the nearest directory above it with a
licence file: one that is named so, or that is mostly the license line itself.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

THRESHOLD, OTHER, MOSTLY = 0.7, 1.0, 0.5
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
#: License, and a statement of it.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the two clause BSD License."),
    ("BSD-3-Clause", "Released under the three clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Proprietary", "All rights reserved."),
)

#: Licenses by the names in their titles and tags; a title or tag counts only if it has the same terms.
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("Apache-2.0", "Apache License Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "ISC License"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("MPL-1.1", "Mozilla Public License Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
_TAGGED = tuple((n, f"SPDX-License-Identifier: {n}") for n in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-1.1", "MPL-2.0"))
_TAGGED += tuple((n, f"SPDX-License-Identifier: {n}{end}") for n in ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0") for end in ("", "-only", "-or-later"))
_FREE = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_NO_WARRANTY = " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
#: Notices that the licences ask for at the head of a file, and the licences' own texts.
NOTICES = tuple(
    (name, text.format("This program", kind, version))
    for name, kind, version in (("AGPL-3.0", "Affero ", "3"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3")) for text in (_FREE, _FREE + _NO_WARRANTY)
) + (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
EXACT = 0.99999
#: The name of a bare reservation of rights. It heads licences too, and so gives way to any of their notices and texts in its file.
RESERVED = "Proprietary"
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\.\.|REM\b|dnl\b)"


def license_texts() -> tuple[tuple[str, str], ...]:
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def template_counts(templates=TEMPLATES) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for name, text in templates:
        counts = out.setdefault(name, {})
        for t in re.findall("[a-z0-9]+", text.lower()):
            counts[t] = counts.get(t, 0) + 1
    return out


def weighted(counts: dict[str, dict[str, int]], idf: dict[str, float]) -> dict[str, dict[str, float]]:
    """Template vectors of length 1."""
    out = {}
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out[name] = {t: n * idf[t] / norm for t, n in c.items()}
    return out


def heavy_terms(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms without any of which a line's cosine with every template is below the threshold."""
    out: set[str] = set()
    for v in vectors.values():
        rest = sum(w * w for w in v.values())
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if rest < (threshold - 1e-9) ** 2:
                break
            out.add(t)
            rest -= w * w
    return sorted(out)


def rare_terms(vectors: dict[str, dict[str, float]], idf: dict[str, float], least: dict[str, float]) -> dict[str, float]:
    """Terms and shares: a text whose distinct ones have shares under 1 in all is below every template's least cosine.

    By Cauchy and Schwarz the squares of a template's weights in the text must come to the square of the least cosine. Its most
    frequent terms, of under half of that, are granted; the others have to make up the rest.
    """
    out: dict[str, float] = {}
    for name, v in vectors.items():
        need, rest, rare = (least[name] - 1e-6) ** 2, sum(w * w for w in v.values()), []
        for t in sorted(v, key=lambda t: (-idf[t], -v[t], t)):
            if rest < need / 2:
                break
            rare.append(t)
            rest -= v[t] * v[t]
        for t in rare:
            out[t] = max(out.get(t, 0.0), v[t] * v[t] / (need - max(rest, 0.0)))
    return out


def listed(names: list[str]) -> Column:
    """A constant array of terms."""
    return F.split(F.lit(" ".join(names)), " ")


def runs(lines: Column, border) -> Column:
    """Runs of adjoining lines without a border -> array of (line, body). A run that starts at a border's line has none before it."""
    marked = F.transform(lines, lambda x, i: F.when(border(x), F.lit("\x00")).otherwise(F.concat(i.cast("string"), F.lit("\x01"), x)))
    pieces = F.filter(F.split(F.array_join(marked, "\n"), "\x00"), lambda x: F.contains(x, F.lit("\x01")))
    return F.transform(pieces, lambda x: F.struct(F.regexp_extract(x, "([0-9]+)\x01", 1).cast("int").alias("line"), F.regexp_replace(x, "[0-9]+\x01", "").alias("body")))


def units(lines: Column) -> Column:
    """One, two and three lines, blocks of lines and the whole text -> array of (line, body)."""
    wide = lambda n: F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.array_join(F.slice(lines, i + 1, F.lit(n)), "\n").alias("body")))
    return F.concat(
        wide(1), wide(2), wide(3), runs(lines, lambda x: ~x.rlike("[A-Za-z0-9]")), runs(lines, lambda x: ~x.rlike(r"\S")), runs(lines, lambda x: ~x.rlike(COMMENT)),
        F.array(F.struct(F.lit(0).alias("line"), F.array_join(lines, "\n").alias("body"))),
    )


def unit_scores(src: DataFrame, named: list[tuple[str, str, float, int]], df: dict[str, int], n: int) -> DataFrame:
    """Units of src(file_id, path, text) -> file_id, path, kind, line, own, share, score of those that reach a template's least cosine."""
    counts = {str(i): c for i, (_, text, *_) in enumerate(named) for c in template_counts([("", text)]).values()}
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for c in counts.values() for t in c}
    vectors = weighted(counts, idf)
    rare = rare_terms(vectors, idf, {str(i): x[2] for i, x in enumerate(named)})
    share = F.str_to_map(F.lit(",".join(f"{t}:{w * 1.000001!r}" for t, w in rare.items())))
    shares = lambda hits: F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["share"])
    spark = src.sparkSession
    weights = spark.createDataFrame([(t, i, named[int(i)][0], named[int(i)][2], named[int(i)][3], w) for i, v in vectors.items() for t, w in v.items()], "term string, template string, own string, least double, kind int, weight double")
    idfs = spark.createDataFrame(list(idf.items()), "term string, idf double")
    met = F.array_intersect(F.array_distinct(terms(F.col("text"))), listed(sorted(rare)))
    some = src.filter("text is not null").withColumn("hits", F.transform(met, lambda t: F.struct(t.alias("term"), F.element_at(share, t).cast("double").alias("share")))).filter(shares(F.col("hits")) >= 1)
    lines = some.select("file_id", "path", "hits", F.length("text").alias("size"), F.split(F.translate("text", "\x00\x01", "  "), "\n").alias("lines"))
    unit = lines.select("file_id", "path", "hits", "size", F.explode(units(F.col("lines"))).alias("u")).select("file_id", "path", "hits", "u.line", (F.length("u.body") / F.col("size")).alias("share"), F.col("u.body").alias("body"))
    unit = unit.withColumn("terms", terms(F.col("body"))).filter(shares(F.filter("hits", lambda x: F.array_contains(F.col("terms"), x["term"]))) >= 1).withColumn("key", F.xxhash64("body")).drop("body", "hits").dropDuplicates(["file_id", "path", "line", "key"])
    keys = ["file_id", "path", "line", "share", "key"]
    tf = unit.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").count().join(F.broadcast(idfs), "term", "left")
    held = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("count") * F.coalesce("idf", F.lit(OTHER)), F.lit(2.0)))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", (F.col("count") * F.col("idf")).alias("x")))).alias("xs"))
    met = held.select(*keys, "norm", F.explode("xs").alias("x")).select(*keys, "norm", "x.term", "x.x").join(F.broadcast(weights), "term")
    return met.groupBy(*keys, "template").agg(F.first("own").alias("own"), F.first("least").alias("least"), F.first("kind").alias("kind"), F.round(F.sum(F.col("x") * F.col("weight")) / F.max("norm"), 6).alias("score")).filter("score >= least").select("file_id", "path", "kind", "line", "own", "share", "score")


def license_scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(file_id, path, text, ...) -> file_id, path, own, score, line, license, basis, from_dir: one row for each file_id and path.

    own is the license of the file's best line or other unit (the highest cosine, then single lines' statements, then the earliest
    line, then the name), score its cosine to 6 places, line its first line's number from 0; all null if none reaches the
    threshold. A bare reservation of rights gives way to a notice, title, tag or text. license is own with basis "own", or else that
    of the nearest licensed directory above with basis "inherited" and from_dir, or null. Null and empty texts have no lines to
    compare, but inherit; null paths don't. A null file_id is an id. Repeated rows give one row. An empty table gives an empty
    result. Other columns aren't read. What the driver gathers is a count for each template term.
    """
    spark = files.sparkSession
    counts = template_counts(templates)
    known = sorted({t for c in counts.values() for t in c})
    named = [(n, t, threshold, 1) for n, t in templates] + [(n, t, threshold, 2) for n, t in (*NOTICES, *license_texts())] + [(n, t, max(threshold, EXACT), 2) for n, t in (*TITLES, *_TAGGED)]
    src = files.select("file_id", "path", "text")
    met = F.array_intersect(F.array_distinct(terms(F.coalesce("text", F.lit("")))), listed(sorted({t for _, text, *_ in named for t in re.findall("[a-z0-9]+", text.lower())})))
    df_rows = src.select(F.explode(F.concat(met, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    df = {r[0]: r[1] for r in df_rows}
    n = df.get("", 0)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in known}
    vectors = weighted(counts, idf)
    heavy = heavy_terms(vectors, threshold)
    weights = spark.createDataFrame([(t, idf[t], name, v[t]) for name, v in vectors.items() for t in v], "term string, idf double, own string, weight double")
    lines = src.filter("text is not null").select("file_id", "path", F.length("text").alias("size"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    kept = lines.filter(F.lower("body").rlike(rf"(?<![a-z0-9])({'|'.join(heavy)})(?![a-z0-9])")).withColumn("terms", terms(F.col("body"))).withColumn("share", F.length("body") / F.col("size"))
    kept = kept.dropDuplicates(["file_id", "path", "line", "body"]).withColumn("own_line", F.xxhash64("body"))  # repeated rows, and ids with several texts
    idf_of = F.array(*(F.lit(idf[t]) for t in known))
    distinct = F.array_distinct("terms")
    tf = lambda t: F.size(F.filter("terms", lambda x: x == t))
    place = lambda t: F.array_position(F.array(*map(F.lit, known)), t)
    square = F.aggregate(distinct, F.lit(0.0), lambda a, t: a + F.pow(tf(t) * F.when(place(t) > 0, F.element_at(idf_of, F.greatest(place(t), F.lit(1)).cast("int"))).otherwise(OTHER), F.lit(2.0)))
    long = kept.withColumn("norm", F.sqrt(square)).select("file_id", "path", "line", "own_line", "share", "norm", F.explode(F.transform(distinct, lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))).alias("x"))
    met = long.select("file_id", "path", "line", "own_line", "share", "norm", F.col("x.term").alias("term"), F.col("x.tf").alias("tf")).join(F.broadcast(weights), "term")
    cosine = met.groupBy("file_id", "path", "line", "own_line", "own").agg(F.max("share").alias("share"), F.round(F.sum(F.col("tf") * F.col("idf") * F.col("weight")) / F.max("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    cosine = cosine.select("file_id", "path", F.lit(0).alias("kind"), "line", "own", "share", "score").unionByName(unit_scores(src, named, df, n))
    better = F.struct((-F.col("score")).alias("far"), "kind", "line", "own", "share")
    best = cosine.groupBy("file_id", "path").agg(F.min(better).alias("b"), F.min(F.when(F.col("kind") == 2, better)).alias("t"))
    best = best.withColumn("b", F.when((F.col("b.own") == RESERVED) & F.col("t").isNotNull(), F.col("t")).otherwise(F.col("b")))
    own = staged(best.select("file_id", "path", F.col("b.own").alias("own"), (-F.col("b.far")).alias("score"), F.col("b.line").alias("line"), F.col("b.share").alias("share")), "license-own")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    licensed = own.filter(F.col("path").isNotNull() & (F.col("path").rlike(NAMED) | (F.col("share") >= MOSTLY))).groupBy(folder.alias("above")).agg(F.min(F.struct((-F.col("score")).alias("far"), "path", "own")).alias("b")).select("above", F.col("b.own").alias("given"))
    names = src.select("file_id", "path").distinct().withColumn("dir", folder)
    parts = F.split("dir", "/")
    chain = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i))))
    dirs = names.select("dir").filter("dir is not null").distinct().select("dir", F.explode(chain).alias("above"))
    nearest = dirs.join(licensed, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("b")).select("dir", F.col("b.above").alias("from_dir"), F.col("b.given").alias("given"))
    same = names["file_id"].eqNullSafe(own["file_id"]) & names["path"].eqNullSafe(own["path"])
    out = names.join(own, same, "left").select(names["file_id"], names["path"], "dir", "own", "score", "line").join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "file_id", "path", "own", "score", "line", F.coalesce("own", "given").alias("license"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").alias("basis"), F.when(~mine, F.col("from_dir")).alias("from_dir"),
    )
