"""License scans: sparse TF-IDF cosine of headers and files to templates, then inheritance from directories.

Texts are sequences of terms (runs of ASCII letters and digits, lower case), so
a notice is the same whether it is wrapped, commented or within a long line. A
term weighs 1 + ln(count), times 1 - ln(share of all documents that hold it);
terms in fewer than one of 10,000 documents count as in so many. Shares are of
all terms of all documents, and weights are the same at every size.

Templates are notices, and whole licence texts. A text is scored against a
template only if the cosine can reach the threshold: the squares of the
template's unit vector over the terms that both have must sum up to its square,
which no closer text fails. Notices are looked for in stretches of as many
terms, laid where one of the template's heaviest terms stands; those terms are
so many that a stretch without any can't reach the threshold. A text's own
licence is that of its closest stretch. A text that as a whole is close to a
licence text, or that is named like a licence file and holds a notice, is a
licence file, and licenses its directory and those below, the nearest first.
DataFrame functions only.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

# Notices by which works name their licence, and short texts of licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
        "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
)
# Whole texts of licences, by their names in a folder of common licences.
TEXT_FILES = (
    ("Apache-2.0", "Apache-2.0"), ("Artistic-1.0", "Artistic"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"), ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"),
    ("GPL-3.0", "GPL-3"), ("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"),
)
TEXT_FOLDER = "/usr/share/common-licenses"
LICENSE_NAME = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:[-_.][a-z0-9._-]*)?$"
SPLIT = "[^a-z0-9]+"
#: Shares of documents under this one count as this one; candidates up to which their ids are broadcast.
RARE, BROADCAST_ROWS = 1e-4, 1 << 20


def license_texts(folder: str = TEXT_FOLDER, notices=TEMPLATES, least: int = 60) -> tuple[tuple[str, str], ...]:
    """(license, text) of whole licences: those of the folder that are there, and notices of at least so many terms that are whole texts."""
    found = []
    for name, file in TEXT_FILES:
        path = os.path.join(folder, file)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                found.append((name, f.read()))
    whole = {"MIT", "ISC", "BSD-3-Clause"}
    return (*found, *((n, t) for n, t in notices if n in whole and len(template_terms(t)) >= least))


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def template_terms(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def term_weight(share: float) -> float:
    return 1.0 - log(max(share, RARE))


@dataclass
class Template:
    """A notice or a whole licence text: its terms and its unit vector."""

    license: str
    terms: list[str]
    unit: dict[str, float]
    whole: bool

    @classmethod
    def of(cls, license: str, text: str, weights: dict[str, float], whole: bool) -> Template:
        terms = template_terms(text)
        raw = {t: (1 + log(n)) * weights.get(t, term_weight(0.0)) for t, n in Counter(terms).items()}
        norm = sum(x * x for x in raw.values()) ** 0.5
        return cls(license, terms, {t: x / norm for t, x in raw.items()}, whole)

    def heaviest(self, threshold: float) -> dict[str, int]:
        """Terms without one of which no stretch can reach the threshold, and where the template first has them."""
        left, out = 1.0, {}
        for t in sorted(self.unit, key=lambda t: (-round(self.unit[t], 12), t)):
            if left < threshold**2 - 1e-9:
                break
            out[t] = self.terms.index(t)
            left -= self.unit[t] ** 2
        return out


def term_weights(docs: DataFrame) -> DataFrame:
    """term, w of all terms that at least RARE of the documents hold; others weigh as one that just doesn't. A text's share is 1 over all rows."""
    n = docs.count()
    held = docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return materialize(held.where(F.col("n") > RARE * n).select("term", (1 - F.log(F.col("n") / F.lit(float(max(n, 1))))).alias("w")), "license-terms")


def weigh(docs: DataFrame, notices=TEMPLATES, texts=None) -> tuple[DataFrame, list[Template]]:
    """Weights of terms, and all templates with theirs; only terms of templates come to the driver."""
    texts = license_texts() if texts is None else texts
    weights = term_weights(docs)
    vocabulary = sorted({t for _, text in (*notices, *texts) for t in template_terms(text)})
    own = docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    known = {r["term"]: r["w"] for r in weights.join(F.broadcast(own), "term", "left_semi").collect()}
    return weights, [Template.of(n, t, known, False) for n, t in notices] + [Template.of(n, t, known, True) for n, t in texts]


def candidates(docs: DataFrame, templates: list[Template], threshold: float) -> DataFrame:
    """doc_id and ks, the numbers of the templates to which the text's cosine, or a stretch's, may reach the threshold."""
    spark = docs.sparkSession
    terms = sorted({t for x in templates for t in x.unit})
    rows = [(t, [x.unit.get(t, 0.0) ** 2 for x in templates]) for t in terms]  # as large as the templates
    squares = spark.createDataFrame(rows, "term string, squares array<double>")
    held = docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    sums = held.join(F.broadcast(squares), "term").groupBy("doc_id").agg(*[F.sum(F.col("squares")[k]).alias(f"s{k}") for k in range(len(templates))])
    reach = F.array_compact(F.array(*[F.when(F.col(f"s{k}") >= threshold**2 - 1e-9, k) for k in range(len(templates))]))
    return materialize(sums.select("doc_id", reach.alias("ks")).where(F.size("ks") > 0), "license-candidates")


def closest(docs: DataFrame, notices=TEMPLATES, threshold: float = 0.6, texts=None) -> DataFrame:
    """doc_id, path, header and whole: struct(c: minus the cosine, license, at: the first term's place) of the closest stretch and of the whole text.

    Only texts at least threshold close to a notice or, as a whole, to a
    licence text; the other of the two is null. Ties go to the licence first by
    code point, then to the first place.
    """
    weights, templates = weigh(docs, notices, texts)
    spark = docs.sparkSession
    ids = candidates(docs, templates, threshold)
    few = ids.count() <= BROADCAST_ROWS
    told = ids.withColumnRenamed("doc_id", "_id")
    rows = docs.join(F.broadcast(told) if few else told, F.col("doc_id") == F.col("_id"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "ks", terms_of(F.col("text")).alias("terms")), "license-texts")
    dealt = rows.repartition("row")  # what is made of a row stays with it

    lays: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        if not t.whole:
            for term, at in t.heaviest(threshold).items():
                lays.setdefault(term, []).append((k, at))
    lay_of = F.create_map(*[x for t in sorted(lays) for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in lays[t]]))])
    names, sizes = (F.array(*[F.lit(x) for x in column]) for column in ([t.license for t in templates], [len(t.terms) for t in templates]))
    hits = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda h: h["t"].isin(*sorted(lays)))
    starts = F.flatten(F.transform(hits, lambda h: F.transform(lay_of[h["t"]], lambda c: F.struct(c["k"].alias("k"), F.greatest(h["i"] - c["o"], F.lit(0)).alias("at")))))
    starts = F.array_distinct(F.filter(starts, lambda s: F.array_contains("ks", s["k"])))
    stretches = dealt.select("row", "terms", F.inline(starts)).select("row", "k", "at", F.explode(F.slice("terms", F.col("at") + 1, sizes[F.col("k")])).alias("term"))
    stretches = stretches.groupBy("row", "k", "at", "term").agg(F.count("*").alias("n"))
    first_text = sum(not t.whole for t in templates)
    wholes = dealt.where(F.exists("ks", lambda k: k >= first_text)).select("row", "ks", F.explode("terms").alias("term")).groupBy("row", "ks", "term").agg(F.count("*").alias("n"))
    wholes = wholes.select("row", F.explode(F.filter("ks", lambda k: k >= first_text)).alias("k"), F.lit(0).alias("at"), "term", "n")
    unit = spark.createDataFrame([(k, t, u) for k, x in enumerate(templates) for t, u in x.unit.items()], "k int, term string, u double")

    weighed = stretches.union(wholes).join(weights, "term", "left").join(F.broadcast(unit), ["k", "term"], "left")
    x = (1 + F.log(F.col("n"))) * F.coalesce("w", F.lit(term_weight(0.0)))
    scored = weighed.groupBy("row", "k", "at").agg(F.sum(x * F.coalesce("u", F.lit(0.0))).alias("dot"), F.sum(x * x).alias("square"))
    scored = scored.withColumn("c", -F.round(F.col("dot") / F.sqrt("square"), 9)).where(F.col("c") <= -threshold)
    found = F.struct("c", names[F.col("k")].alias("license"), "at")
    best = scored.groupBy("row").agg(F.min(F.when(F.col("k") < first_text, found)).alias("header"), F.min(F.when(F.col("k") >= first_text, found)).alias("whole"))
    return rows.select("row", "doc_id", "path").join(best, "row").drop("row")


def parent(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def scan(docs: DataFrame, **scanning) -> DataFrame:
    """doc_id, license, basis, cosine, license_at from docs(doc_id, path, text).

    basis: 'file' for licence files (close to a licence text, or named like
    one, as LICENSE.txt or COPYING, with a notice), 'header' for other documents with a
    licence notice, 'inherited' from the nearest directory above that has a
    licence file, null with a null license for the rest. license_at is the
    place of the notice's first term, 0 for a file. A directory with several
    files takes the closest, then the smallest doc_id. Null or empty texts can
    only inherit; a null path lies in no directory. Rows that repeat a doc_id
    share the best notice found in any of them, and a file makes them files; a
    null doc_id can only inherit. No rows give no rows; other columns are ignored.
    """
    own = closest(docs.select("doc_id", "path", F.coalesce(F.col("text"), F.lit("")).alias("text")), **scanning)
    named = F.rlike(F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1), F.lit(LICENSE_NAME))
    own = materialize(own.withColumn("whole", F.coalesce("whole", F.when(named, F.col("header")))), "license-notices")
    files = own.where("whole is not null and path is not null").select(parent(F.col("path")).alias("up"), "whole", "doc_id").where("up <> ''")
    licensed = files.groupBy("up").agg(F.min(F.struct("whole.c", "doc_id", "whole.license")).alias("f")).select("up", F.col("f.license").alias("dir_license"))
    dirs = docs.select(parent(F.col("path")).alias("dir")).where("dir <> ''").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")).select(
        "dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up")
    )
    nearest = above.join(licensed, "up").groupBy("dir").agg(F.max_by("dir_license", "depth").alias("dir_license"))
    best = own.groupBy(F.col("doc_id").alias("_d")).agg(F.min("whole").alias("whole"), F.min("header").alias("header"))
    whole = (
        docs.select("doc_id", parent(F.col("path")).alias("dir"))
        .join(best, F.col("doc_id") == F.col("_d"), "left")
        .join(nearest.withColumnRenamed("dir", "_dir"), F.col("dir") == F.col("_dir"), "left")
    )
    basis = F.when(F.col("whole").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited")
    said = F.coalesce("whole", "header")
    return whole.select(
        "doc_id", F.coalesce(said["license"], F.col("dir_license")).alias("license"), basis.alias("basis"),
        (-said["c"]).alias("cosine"), said["at"].cast("long").alias("license_at"),
    )


def oracle(notices=TEMPLATES, texts=None, threshold: float = 0.6) -> str:
    """SQL of scan() over documents laid out as source/thousand/hundred/id; every text is scored against every template."""
    texts = license_texts() if texts is None else texts
    rows = ", ".join(f"({k}, '{name}', {i}, '{t}')" for k, (name, text) in enumerate(notices) for i, t in enumerate(template_terms(text)))
    whole = ", ".join(f"({len(notices) + k}, '{name}', '{t}', {n})" for k, (name, text) in enumerate(texts) for t, n in Counter(template_terms(text)).items())
    least = 1 - log(RARE)
    return rf"""
WITH t(k, license, i, term) AS (VALUES {rows}), b(k, license, term, c) AS (VALUES {whole}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda v: v <> '') AS w, source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS dir FROM documents),
df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM d) GROUP BY 1),
wt AS (SELECT term, 1 - ln(n / (SELECT count(*) FROM d)::DOUBLE) AS x FROM df WHERE n > {RARE} * (SELECT count(*) FROM d)),
tf AS (SELECT k, license, term, min(i) AS i, count(*) AS c FROM t GROUP BY 1, 2, 3 UNION ALL SELECT k, license, term, NULL, c FROM b),
rw AS (SELECT tf.*, (1 + ln(c)) * coalesce(x, {least!r}) AS r FROM tf LEFT JOIN wt USING (term)),
un AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY k)) AS u FROM rw),
u AS (SELECT *, i IS NOT NULL AND 1 - coalesce(sum(u * u) OVER (PARTITION BY k ORDER BY round(u, 12) DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {threshold**2 - 1e-9!r} AS anchor FROM un),
size AS (SELECT k, license, count(*) AS n FROM t GROUP BY 1, 2),
hit AS (SELECT DISTINCT doc_id, u.k, greatest(p.i - u.i, 0) AS pos FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM d) p JOIN u ON u.anchor AND u.term = p.term),
st AS (SELECT hit.doc_id, hit.k, size.license, hit.pos, d.w[hit.pos + 1 : hit.pos + size.n] AS w FROM hit JOIN size USING (k) JOIN d USING (doc_id)),
vc AS (SELECT doc_id, k, license, pos, term, count(*) AS c FROM (SELECT * EXCLUDE w, unnest(w) AS term FROM st) GROUP BY ALL),
wc AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
vx AS (SELECT vc.*, (1 + ln(c)) * coalesce(x, {least!r}) AS r FROM vc LEFT JOIN wt USING (term)), wx AS (SELECT wc.*, (1 + ln(c)) * coalesce(x, {least!r}) AS r FROM wc LEFT JOIN wt USING (term)),
sc AS (SELECT doc_id, vx.license, pos, round(coalesce(sum(vx.r * u.u), 0) / sqrt(sum(vx.r * vx.r)), 9) AS cosine FROM vx LEFT JOIN u ON u.k = vx.k AND u.term = vx.term GROUP BY doc_id, vx.k, vx.license, pos),
nm AS (SELECT doc_id, sqrt(sum(r * r)) AS norm FROM wx GROUP BY 1),
ws AS (SELECT doc_id, u.license, round(sum(wx.r * u.u) / any_value(norm), 9) AS cosine FROM wx JOIN nm USING (doc_id) JOIN u ON u.i IS NULL AND u.term = wx.term GROUP BY doc_id, u.k, u.license),
he AS (SELECT * FROM sc WHERE cosine >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license, pos) = 1),
wh AS (SELECT * FROM ws WHERE cosine >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
own AS (SELECT d.doc_id, d.dir, coalesce(wh.license, he.license) AS license, coalesce(wh.cosine, he.cosine) AS cosine, CASE WHEN wh.doc_id IS NULL THEN he.pos ELSE 0 END AS pos, wh.doc_id IS NOT NULL AS file
        FROM d LEFT JOIN he USING (doc_id) LEFT JOIN wh USING (doc_id) WHERE he.doc_id IS NOT NULL OR wh.doc_id IS NOT NULL),
up AS (SELECT dir AS up, license AS dir_license FROM own WHERE file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id) = 1),
ne AS (SELECT dir, dir_license FROM (SELECT DISTINCT dir FROM d) JOIN up ON dir = up OR starts_with(dir, up || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT d.doc_id, coalesce(own.license, dir_license) AS license, CASE WHEN own.file THEN 'file' WHEN own.doc_id IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' END AS basis,
       own.cosine, own.pos::BIGINT AS license_at FROM d LEFT JOIN own USING (doc_id) LEFT JOIN ne ON ne.dir = d.dir
"""
