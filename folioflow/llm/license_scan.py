"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only.  Units are the lines of a file (notices), header blocks and the file as a whole.  A
block starts at every telling pair of adjacent terms of a template (one without a little word) from which on the
template could still reach the threshold, and holds as many terms as the template has from there on, over line
breaks and comment marks.  Terms are weighted ``(1 + ln tf) * idf``,
with document frequencies counted over the templates; terms that no template has weigh most.  ``BLOCKS`` adds
texts, titles and tags; they leave those frequencies alone.  The best template at or above the threshold names
a file's own license; one whose text is part of another's (``CONTAINED``) gives way to that if both match.  Files without one take that of the nearest ancestor directory (their own first) that
holds a license file with a match; directories are joined by path.

Only units that may reach the threshold are scored: lines must hold an anchor term, and the terms of a block or a
whole file that templates know must weigh enough against the others.  Both tests follow from the Cauchy-Schwarz
inequality and skip no match.

Cases: a null text matches nothing; a null path has no directory and inherits nothing.  Equal texts and equal
lines are scored once.  Ties go to the higher score, then to the license's name; several license files of a
directory likewise.  Repeated rows get equal results.  Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stage, value_of

TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:[._-][^/]*)?$"
THRESHOLD = 0.75
#: Little words, and words of everyday prose (mit is German for with), that make poor anchors.
LITTLE = {"a", "and", "any", "are", "as", "at", "be", "by", "for", "in", "is", "it", "no", "of", "on", "or", "the", "this", "to", "with", "you"}
COMMON = LITTLE | {"mit", "without", "under", "either", "that", "from", "work", "file", "later", "http", "following", "source", "code", "only", "identifier", "its", "may", "other", "your", "all", "not", "shall", "if"}

#: Notices and grants of common licenses, public texts.  The operator takes any other list.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_END = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE_END = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."
#: Identifiers of SPDX tags; a version that ``TEMPLATES`` lacks is listed, as it would pass for its neighbour.
SPDX = ["Apache-1.1", "Apache-2.0", "MIT", "MIT-0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "AGPL-1.0", "AGPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "MPL-1.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"]

#: Full texts of short licenses, version titles and openings of long ones, headers by version, SPDX tags.
BLOCKS = [
    ("MIT", dict(TEMPLATES)["MIT"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: " + _MIT_END),
    ("ISC", dict(TEMPLATES)["ISC"] + " " + _ISC_END),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD_HEAD}: {_BSD} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_3),
    ("Unlicense", dict(TEMPLATES)["Unlicense"] + " " + _UNLICENSE_END),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    *[(f"{n}-{v if '.' in v else v + '.0'}", _GNU.format(w, c, k, v))
      for n, k, versions in (("GPL", "", ("1", "2", "3")), ("LGPL", "Library ", ("2",)), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",)))
      for v in versions for w, c in (("program", ":"), ("library", ";"))],
    *[(n, f"SPDX-License-Identifier: {n}{end}") for n in SPDX for end in (("", "-only", "-or-later") if "GPL" in n else ("",))],
]
#: The first license's text is part of the second's: the third clause alone tells BSD-3 from BSD-2.
CONTAINED = [("BSD-2-Clause", "BSD-3-Clause")]
#: Shorter templates are those of single lines.
BLOCK_TERMS = 5
#: Templates with this term are tags, which stand in one line.
TAG = "spdx"


def template_weights(
    templates: list[tuple[str, str]], blocks: list[tuple[str, str]] = ()
) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(number, license, term, unit weight) rows, idf by term, and the idf of a term that no template has.

    ``blocks`` are numbered after the templates; frequencies are those of the templates.
    """
    listed = [*templates, *blocks]
    counted = [Counter(re.findall(TERM, text.lower())) for _, text in listed]
    frequency = Counter(t for c in counted[: len(templates)] for t in c)
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in frequency.items()}
    rare = math.log(1 + n) + 1
    rows = []
    for i, ((name, _), c) in enumerate(zip(listed, counted, strict=True)):
        raw = {t: (1 + math.log(k)) * idf.get(t, rare) for t, k in c.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        rows += [(i, name, t, w / norm) for t, w in sorted(raw.items())]
    return rows, idf, rare


def anchors(rows: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Terms without any of which no unit reaches the threshold; long terms are preferred, as texts hold them seldom."""
    out: set[str] = set()
    for i in sorted({r[0] for r in rows}):
        weights = {t: w for k, _, t, w in rows if k == i}
        left = 1.0
        for t in sorted(weights, key=lambda t: (t not in out, t in COMMON, len(t) < 4, -weights[t] * min(len(t), 10), t)):
            if left < (threshold - 1e-6) ** 2:
                break
            out.add(t)
            left -= weights[t] ** 2
    return sorted(out)


def any_term(terms: list[str]) -> str:
    """A pattern for texts with one of the terms; terms are gathered by first letter, which is quicker."""
    heads: dict[str, list[str]] = {}
    for t in sorted(terms):
        heads.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items()) + ")(?![a-z0-9])"


def openings(listed: list[tuple[str, str]], rows: list[tuple[int, str, str, float]], threshold: float) -> list[tuple[str, int]]:
    """(pair of terms, terms of the block that starts there) of the templates that may stand over several lines.

    All pairs without a little word from which on the template keeps weight enough: what follows a later one cannot reach
    the threshold with this template (Cauchy-Schwarz).  A template without such a pair has its first.
    """
    weights: dict[int, dict[str, float]] = {}
    for i, _, t, w in rows:
        weights.setdefault(i, {})[t] = w
    out = set()
    for i, (_, text) in enumerate(listed):
        terms = re.findall(TERM, text.lower())
        if len(terms) < BLOCK_TERMS or TAG in terms:
            continue
        able = [j for j in range(len(terms) - 1) if sum(weights[i][t] ** 2 for t in set(terms[j:])) >= (threshold - 1e-6) ** 2]
        starts = [j for j in able if not LITTLE & set(terms[j : j + 2])] or [0]
        out |= {(" ".join(terms[j : j + 2]), len(terms) - j) for j in starts}
    return sorted(out)


def header_terms(text: Column) -> Column:
    """The terms of a text, over lines and comment marks."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(?m)^\s*(?:rem|dnl)\b", ""), F.lit(TERM), F.lit(0))


def header_blocks(terms: Column, pairs: list[tuple[str, int]], able: Callable[[Column], Column]) -> Column:
    """The blocks of a text's ``terms`` that are ``able`` to match: from each opening on, joined by spaces."""
    lengths: dict[str, list[int]] = {}
    for pair, n in pairs:
        lengths.setdefault(pair, []).append(n)
    listed = F.create_map(*[x for pair, ns in lengths.items() for x in (F.lit(pair), F.array(*map(F.lit, ns)))])
    pair_at = lambda i: F.concat_ws(" ", F.element_at(terms, i), F.element_at(terms, i + 1))
    starts = F.filter(F.sequence(F.lit(1), F.size(terms) - 1), lambda i: pair_at(i).isin(*lengths))
    windows = F.flatten(F.transform(starts, lambda i: F.transform(F.element_at(listed, pair_at(i)), lambda n: F.slice(terms, i, n))))
    blocks = F.transform(F.filter(F.array_distinct(windows), able), lambda w: F.array_join(w, " "))
    return F.when(F.size(terms) > 1, blocks).otherwise(F.array().cast("array<string>"))


def may_match(terms: Column, idf: dict[str, float], rare: float, threshold: float) -> Column:
    """Whether a unit's ``terms`` may reach the threshold: the share of their squared weight in terms that ``idf`` names."""
    known = F.array(*[F.lit(t) for t in sorted(idf)])
    weight = F.create_map(*[x for t, w in sorted(idf.items()) for x in (F.lit(t), F.lit(w))])
    distinct = F.array_distinct(terms)
    inner = F.array_intersect(distinct, known)
    square = lambda t: F.pow((1 + F.log(F.size(terms) - F.size(F.array_remove(terms, t)))) * F.element_at(weight, t), F.lit(2.0))
    mass = F.aggregate(inner, F.lit(0.0), lambda s, t: s + square(t))
    other = (F.size(distinct) - F.size(inner)) * rare**2
    return value_of(mass, lambda m: m >= (threshold - 1e-6) ** 2 * (m + other))


def units_of(text: Column, templates: list[tuple[str, str]], blocks: list[tuple[str, str]], threshold: float) -> Column:
    """The units of a text that may reach the threshold; null for a text without any."""
    rows, idf, rare = template_weights(templates, blocks)
    pattern = any_term(anchors(rows, threshold))
    weights = {t: idf.get(t, rare) for _, _, t, _ in rows}
    able = lambda terms: may_match(terms, weights, rare, threshold)
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    heads = value_of(header_terms(text), lambda terms: header_blocks(terms, openings([*templates, *blocks], rows, threshold), able))
    whole = value_of(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda terms: F.when(able(terms), F.array(text)).otherwise(none))
    every = F.array_distinct(F.concat(lines, heads, whole))
    return F.when(text.rlike(pattern), value_of(every, lambda u: F.when(F.size(u) > 0, u)))


def score_units(units: DataFrame, templates: list[tuple[str, str]], threshold: float, blocks: list[tuple[str, str]] = ()) -> DataFrame:
    """``units`` (key, unit; distinct keys) to (key, license, score) of those at or above the threshold."""
    spark = units.sparkSession
    rows, idf, rare = template_weights(templates, blocks)
    weights = spark.createDataFrame([(i, n, t, w, idf.get(t, rare)) for i, n, t, w in rows], "template int, license string, term string, weight double, idf double")
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    terms = units.select("key", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term"))
    tf = terms.groupBy("key", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    tf = stage(tf, "unit-terms")
    norms = tf.join(F.broadcast(idfs), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norms = norms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "term").groupBy("key", "template", "license")
    dots = dots.agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scored.where(F.col("score") >= threshold).groupBy("key", "license").agg(F.max("score").alias("score"))


def named(scored: DataFrame, key: str) -> DataFrame:
    """The license of each key's text: the best of those that reached the threshold and are not part of another that did."""
    listed = scored.groupBy(key, "license").agg(F.max("score").alias("score"))
    texts = listed.groupBy(key).agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "license")).alias("all"))
    names = F.transform("all", lambda x: x["license"])
    part = lambda x: F.array_contains(F.array(*[F.lit(a) for a, _ in CONTAINED]), x["license"])
    whole = lambda x: F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONTAINED]), lambda c: (c["a"] == x["license"]) & F.array_contains(names, c["b"]))
    top = texts.select(key, F.array_min(F.filter("all", lambda x: ~(part(x) & whole(x)))).alias("b"))
    return top.select(key, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def best(scored: DataFrame, key: str) -> DataFrame:
    """The row of each key with the highest score, then the first license name."""
    top = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"))
    return top.select(key, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(
    files: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, blocks: list[tuple[str, str]] = BLOCKS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, license, score, method, origin.

    ``method`` is own (a unit of the file matched) or inherited; ``origin`` is the directory inherited from.
    The templates are a list of the driver's, so their broadcast is as small as that list.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = files.select("doc_id", "path", F.unhex(F.md5(text)).alias("text_key"), units_of(text, templates, blocks, threshold).alias("units"))
    marked = stage(
        marked.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)),
        "files",
    )
    units = marked.where("units is not null").select("text_key", F.explode("units").alias("unit")).withColumn("key", F.unhex(F.md5("unit")))
    distinct = stage(units.groupBy("key").agg(F.any_value("unit").alias("unit")), "units")
    per_text = units.select("text_key", "key").distinct().join(score_units(distinct, templates, threshold, blocks), "key")
    own = bounded(stage(named(per_text, "text_key"), "own"))
    columns = ["doc_id", "path", "dir", "name", "license", "score"]
    told = marked.where("units is not null").join(own, "text_key", "left").select(*columns)
    none = marked.where("units is null").withColumn("license", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    told = stage(told.unionByName(none.select(*columns)), "told")

    holders = told.where(F.col("license").isNotNull() & F.col("name").rlike(LICENSE_FILE) & F.col("dir").isNotNull())
    holders = best(holders.select("dir", "license", "score"), "dir").select(F.col("dir").alias("origin"), F.col("license").alias("l"), F.col("score").alias("s"))
    dirs = told.where(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    steps = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("origin")).join(bounded(stage(holders, "holders")), "origin")
    nearest = steps.groupBy("dir").agg(F.max_by(F.struct("origin", "l", "s"), F.length("origin")).alias("n"))
    out = told.join(bounded(stage(nearest, "nearest")), "dir", "left")
    own_license = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.when(own_license, F.col("license")).otherwise(F.col("n.l")).alias("license"),
        F.when(own_license, F.col("score")).otherwise(F.col("n.s")).alias("score"),
        F.when(own_license, F.lit("own")).when(F.col("n").isNotNull(), F.lit("inherited")).alias("method"),
        F.when(~own_license, F.col("n.origin")).alias("origin"),
    )


def ancestors(folder: Column) -> Column:
    """A directory and all directories above it, the root "" last."""
    parts = F.split(folder, "/")
    return F.array_distinct(
        F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """A path for tables that have none: source / thousands / hundreds / id; each tenth file is a license file,
    every other one of them a directory higher."""
    block = lambda n: F.floor(doc_id / n).cast("string")
    name = F.concat(F.when(doc_id % 10 == 0, F.lit("LICENSE-")).otherwise(F.lit("text-")), doc_id.cast("string"))
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), block(1000), F.when(doc_id % 20 != 0, block(100)), name)


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", document_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, blocks: list[tuple[str, str]] = BLOCKS, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` in DuckDB's SQL, scoring every line, block and text, without anchors or bounds."""
    listed = [*templates, *blocks]
    quoted = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(listed))
    opened = ", ".join(f"('{pair}', {k})" for pair, k in openings(listed, template_weights(templates, blocks)[0], threshold))
    parts = ", ".join(f"('{a}', '{b}')" for a, b in CONTAINED)
    n = len(templates)
    return rf"""
WITH tpl(template, license, body) AS (VALUES {quoted}), op(pair, k) AS (VALUES {opened}), part(a, b) AS (VALUES {parts}),
tt AS (SELECT template, license, term, 1 + ln(count(*)) AS tf FROM
  (SELECT template, license, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln({n + 1}.0 / (1 + count(*) FILTER (template < {n}))) + 1 AS idf FROM tt GROUP BY term),
tn AS (SELECT template, sqrt(sum((tf * idf) ** 2)) AS norm FROM tt JOIN idf USING (term) GROUP BY template),
tw AS (SELECT template, license, term, idf, tf * idf / norm AS weight FROM tt JOIN idf USING (term) JOIN tn USING (template)),
d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'), (doc_id // 1000)::VARCHAR, CASE WHEN doc_id % 20 <> 0 THEN (doc_id // 100)::VARCHAR END) AS dir,
  CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' ELSE 'text-' END || doc_id AS name FROM documents),
dt AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(?m)^\s*(?:rem|dnl)\b', '', 'g'), '{TERM}') AS terms FROM d),
dp AS (SELECT doc_id, terms, unnest(range(1, len(terms))) AS i FROM dt),
hb AS (SELECT doc_id, array_to_string(terms[i:i + k - 1], ' ') AS unit FROM dp JOIN op ON op.pair = terms[i] || ' ' || terms[i + 1]),
du AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM d UNION ALL SELECT doc_id, text FROM d UNION ALL SELECT doc_id, unit FROM hb)),
u AS (SELECT DISTINCT unit FROM du),
ut AS (SELECT unit, term, 1 + ln(count(*)) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM u) GROUP BY ALL),
un AS (SELECT unit, sqrt(sum((tf * coalesce(idf, ln({n + 1}.0) + 1)) ** 2)) AS norm FROM ut LEFT JOIN idf USING (term) GROUP BY unit),
s AS (SELECT unit, license, round(sum(tf * idf * weight) / any_value(norm), 6) AS score FROM ut JOIN tw USING (term) JOIN un USING (unit) GROUP BY unit, template, license),
al AS (SELECT doc_id, license, max(score) AS score FROM du JOIN s USING (unit) WHERE score >= {threshold} GROUP BY ALL),
own AS (SELECT doc_id, license, score FROM al x WHERE NOT EXISTS (SELECT 1 FROM part JOIN al y ON y.license = part.b WHERE part.a = x.license AND y.doc_id = x.doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
t AS (SELECT d.doc_id, dir, name, license, score FROM d LEFT JOIN own USING (doc_id)),
h AS (SELECT dir AS origin, license AS l, score AS sc FROM t WHERE license IS NOT NULL AND starts_with(name, 'LICENSE-')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
n AS (SELECT t.doc_id, origin, l, sc FROM t JOIN h ON t.dir = origin OR starts_with(t.dir, origin || '/') WHERE t.license IS NULL
  QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY length(origin) DESC) = 1)
SELECT t.doc_id, dir || '/' || name AS path, coalesce(license, l) AS license, coalesce(score, sc) AS score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' END AS method, origin
FROM t LEFT JOIN n USING (doc_id)
"""
