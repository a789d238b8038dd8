"""License scans with DataFrame expressions only.

A text's words (lower case, letters and digits) give its shingles of SHINGLE words. Overlapping windows of 2 * HALF shingles, HALF apart, have a
minimum under each of SEEDS hash functions (bands of one row: xxhash64 of the shingle and the band's number). Templates have theirs for windows at
every shingle, and a minimum that a text and a template share retrieves the template. Then the share of the template's shingles that the text
holds is counted exactly; from `percent` on it matches.

A band retrieves a template when the smallest shingle of the text's window is the template's, so with n of the window's 2 * HALF shingles from the
template all bands miss with a probability of (1 - n / (2 * HALF)) ^ SEEDS: 2e-4 for one shingle among eight others, 1e-8 for two, less for more,
and each shingle lies in two windows. A window without any template's shingle cannot share a minimum with one, so minima are worked out only
for the windows that hold one: this leaves nothing out.

Everything about a document is in its own row: nothing is shuffled. Templates are the rows of a table (name, text), or a dict: they are a
parameter and become constants of the plan, whose size follows theirs (about 70 KB a template of 200 words), so hundreds of them are too many. Null and empty texts match nothing.
Templates with fewer words than a shingle are refused. Other columns are not read; repeated rows are scanned each.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.session import table

SHINGLE, HALF, SEEDS, PERCENT = 2, 4, 64, 80
#: Notices as they are printed in files and pages, and the bodies of short licenses.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def _words(text: Column) -> Column:
    """Runs of ASCII letters, digits and anything beyond ASCII, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-/:-@\\[-`{-\\x7f]+"), "")


def _shingles(words: Column) -> Column:
    n = F.size(words)
    at = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE))))


def _minima(shingles: Column, starts: Column) -> Column:
    """The distinct minima of the windows that begin at starts, of all bands."""

    def of(at: Column) -> Column:
        window = F.slice(shingles, at + 1, 2 * HALF)
        return F.transform(F.sequence(F.lit(1), F.lit(SEEDS)), lambda band: F.array_min(F.transform(window, lambda x: F.xxhash64(x, band))))

    return F.array_distinct(F.flatten(F.transform(starts, of)))


def compiled(spark: SparkSession, notices: dict[str, str] | DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """Each template's name, distinct shingles and minima, worked out by the same expressions as the documents'."""
    given = spark.createDataFrame(sorted(notices.items()), "name string, text string") if isinstance(notices, dict) else notices.select("name", "text")
    rows = given.select("name", _words(F.col("text")).alias("w")).select("name", _shingles(F.col("w")).alias("s"))
    last = F.greatest(F.size("s") - 2 * HALF, F.lit(0))
    out = rows.select("name", "s", F.when(F.size("s") > 0, _minima(F.col("s"), F.sequence(F.lit(0), last))).alias("m")).select("name", F.array_distinct("s").alias("kinds"), "m").collect()
    if small := sorted(r.name for r in out if not r.kinds):
        raise ValueError(f"templates need {SHINGLE} words or more: {small}")
    return [(r.name, list(r.kinds), list(r.m)) for r in sorted(out, key=lambda r: r.name)]


def _longs(x: Iterable[int]) -> Column:
    """A constant array; written as one string, so that the plan holds one constant however long it is."""
    return F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")


def scan_licenses(docs: DataFrame, notices: dict[str, str] | DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_candidates, and matches array<struct<license, n_shared, n_template>> in order of the names."""
    known = compiled(docs.sparkSession, NOTICES if notices is None else notices)
    templates = F.array(*(F.struct(F.lit(name).alias("license"), _longs(s).alias("s"), _longs(m).alias("m")) for name, s, m in known))
    held = sorted({v for _, s, _ in known for v in s})
    # words, shingles and places are columns of their own: inside a lambda an expression would be worked out anew for every element
    cut = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("w")).select("doc_id", _shingles(F.col("w")).alias("s"))
    places = F.filter(F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get("s", i).isin(held))
    first = lambda p: p - p % HALF
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(first(p), F.greatest(first(p) - HALF, F.lit(0))))))
    minima = cut.select("doc_id", "s", places.alias("at")).select("doc_id", "s", F.when(F.size("at") > 0, _minima(F.col("s"), starts)).alias("m"))
    near = F.transform(F.filter(templates, lambda t: F.arrays_overlap(t["m"], F.col("m"))), lambda t: F.struct(t["license"].alias("license"), F.size(F.array_intersect(t["s"], F.col("s"))).cast("long").alias("n_shared"), F.size(t["s"]).cast("long").alias("n_template")))
    none = F.array().cast("array<struct<license:string,n_shared:bigint,n_template:bigint>>")
    found = minima.select("doc_id", F.when(F.size("m") > 0, near).otherwise(none).alias("near"))
    return found.select("doc_id", F.size("near").cast("long").alias("n_candidates"), F.filter("near", lambda x: 100 * x["n_shared"] >= percent * x["n_template"]).alias("matches"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.transform("matches", lambda m: m["license"]), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"))


def _oracle() -> str:
    rows = ",\n  ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())
    cut = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda w: w <> '')"
    return f"""
WITH notices(name, text) AS (VALUES
  {rows}),
t AS (SELECT name, {cut} AS w FROM notices),
ts AS (SELECT DISTINCT name, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM t),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT doc_id, {cut} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM d),
hit AS (SELECT doc_id, name FROM ds JOIN ts USING (s) JOIN tn USING (name) GROUP BY doc_id, name, n HAVING 100 * count(*) >= {PERCENT} * n)
SELECT documents.doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses
FROM documents LEFT JOIN hit USING (doc_id) GROUP BY documents.doc_id
"""


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {"op6_license_scan": _oracle()}
