"""Licence scans: Dice coefficient of word bigrams against licence templates.

Only DataFrame functions.  A unit (a line, or a paragraph of more lines) is
normalised to lower-case words.  A unit that reaches ``least`` with a template lacks
at most m of its bigrams, so of any words that occur in more than m of them it has one: documents with none
of the templates' such words (long words first, as they are rare) go before they are split.  A unit's number of distinct bigrams bounds what
its coefficient with a template can reach, ``2 min(a, b) / (a + b)``; units
outside every template's bounds go before any comparison.  The rest meet the
templates by an equi-join on the bigram; the template side is a parameter of
this module, so its size is fixed and it is broadcast.  Counts of shared
bigrams combine map-side.

Defined results: null and empty texts have no units; a unit of one word has
no bigram and matches nothing; ties between templates go to the first by name;
repeated rows give repeated results; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolens.llm.common import documents, query

#: Licence notices, as their licences word them.  Fixed values.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def template_bigrams(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """Sorted distinct bigrams of each template."""
    out = {}
    for name, text in sorted(templates.items()):
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return out


def anchors(known: Mapping[str, list[str]], least: float) -> list[str]:
    """Words of which every unit that reaches ``least`` with some template holds at least one."""
    chosen: set[str] = set()
    for grams in known.values():
        a = len(grams)
        missing = a - math.ceil(least * (a + a * least / (2 - least)) / 2 - 1e-9)
        words = sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w not in chosen, -len(w), w))
        taken: set[str] = set()
        for w in words:
            if sum(any(x in taken for x in g.split(" ")) for g in grams) > missing:
                break
            taken.add(w)
        chosen |= taken
    return sorted(chosen)


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs of an array of words, joined by a blank."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row a matching unit: doc_id, kind, unit (its number, from 0), template, shared bigrams, dice."""
    known = template_bigrams(templates)
    low, high = least / (2 - least), (2 - least) / least
    spark = docs.sparkSession
    rows = [(b, n, len(bs)) for n, bs in known.items() for b in bs]
    side = F.broadcast(spark.createDataFrame(rows, "bigram string, template string, n_template int"))
    docs = docs.where(F.lower("text").rlike("(?<![a-z0-9])(?:" + "|".join(anchors(known, least)) + ")(?![a-z0-9])")) if known else docs
    units = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array(
        F.struct(F.lit("line").alias("kind"), F.split("text", "\n").alias("parts")),
        F.struct(F.lit("paragraph").alias("kind"), F.split("text", "\n[ \t-\r]*\n").alias("parts")),
    )).alias("u")).where("u.parts IS NOT NULL")
    units = units.select("doc_id", "row", "u.kind", F.posexplode("u.parts").alias("unit", "raw")).where("kind = 'line' OR contains(raw, '\n')")
    words = F.split(F.trim(F.regexp_replace(F.lower("raw"), "[^a-z0-9]+", " ")), " ")
    units = units.select("doc_id", "row", "kind", "unit", words.alias("words")).where(F.size("words") > 1)
    # A unit has at least as many words as distinct bigrams, so this bound comes first; repeats could still shrink a long unit.
    sizes = sorted({len(bs) for bs in known.values()})
    units = units.where(F.size("words") > min(sizes) * low).select("doc_id", "row", "kind", "unit", bigrams(F.col("words")).alias("bigrams"))
    n = F.size("bigrams")
    fits = F.lit(False)
    for s in sizes:
        fits = fits | n.between(F.lit(s * low - 1e-9), F.lit(s * high + 1e-9))
    each = units.where(fits).select("doc_id", "row", "kind", "unit", n.alias("n_unit"), F.explode("bigrams").alias("bigram"))
    met = each.join(side, "bigram").where(F.col("n_unit").between(F.col("n_template") * low - 1e-9, F.col("n_template") * high + 1e-9))
    shared = met.groupBy("row", "kind", "unit", "template", "n_unit", "n_template", "doc_id").agg(F.count("*").alias("shared"))
    dice = 2 * F.col("shared") / (F.col("n_unit") + F.col("n_template"))
    best = shared.withColumn("dice", dice).where(F.col("dice") >= least)
    best = best.groupBy("row", "kind", "unit", "doc_id").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "template", "shared")).alias("b"))
    return best.select("doc_id", "kind", F.col("unit").cast("long").alias("unit"), "b.template", "b.shared", F.round(-F.col("b.minus"), 6).alias("dice"))


def _sql(least: float = 0.8) -> str:
    values = ", ".join("('{}', [{}])".format(n, ", ".join("'" + b + "'" for b in bs)) for n, bs in template_bigrams(TEMPLATES).items())
    return f"""
WITH t(template, tb) AS (VALUES {values}),
parts AS (
  SELECT doc_id, 'line' AS kind, string_split(text, chr(10)) AS p FROM documents
  UNION ALL SELECT doc_id, 'paragraph', string_split_regex(text, '\\n[ \\t-\\r]*\\n') FROM documents
), units AS (
  SELECT doc_id, kind, i - 1 AS unit, p[i] AS raw FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM parts)
  WHERE kind = 'line' OR contains(p[i], chr(10))
), words AS (
  SELECT doc_id, kind, unit, string_split(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
), grams AS (
  SELECT doc_id, kind, unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1
), pairs AS (
  SELECT doc_id, kind, unit, template, len(list_intersect(b, tb)) AS shared, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
  FROM grams, t WHERE len(b) <= 2 * len(tb)
)
SELECT doc_id, kind, unit::BIGINT AS unit, template, shared::BIGINT AS shared, round(dice, 6)::DOUBLE AS dice FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, template) AS r FROM pairs WHERE dice >= {least}
) WHERE r = 1
"""


@query("op9_license_scan", _sql())
def op9_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))
