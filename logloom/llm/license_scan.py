"""License scans: which documents hold which license notice.

Texts become words (A-Z in lower case, .,;:()"' as blanks) and 5-word shingles (fewer for templates of under 5 words:
such a template is one shingle of its own length). Windows of shingles, one from every shingle on, are signed by MINIMA
least hashes; each pair of these is a band, and a document's window that shares a band key with a template's window makes that
template a candidate. Windows of similarity s share a band with probability 3 s^2 - 2 s^3 (0.90 at 0.8), equal windows always.

The window's size guarantees equal windows: an edit within a template costs at least 4 shingles, so a copy that keeps 80 % of n
shingles has at most n / 20 edits and a run of 0.8 n / (n / 20 + 1) shingles without one. That is at least 8 from n = 20 on and at least
4 from n = 7 on; smaller templates lose one shingle at most, at an end. So templates of 20 shingles and more have windows of
8 (12 words), of 4 and more windows of 4 and the others windows of 1: every copy that is to be found, of one piece, is found.
Then the document's whole shingle set is compared: a match holds at least 80 % of the template's shingles.

Where the templates have at most LISTED band keys and shingles, documents keep the band keys that are among them without
a shuffle; with more, keys are joined and candidates' texts read again. Both give the same rows.

Defined cases: null or short texts match nothing; repeated rows of a doc_id give one row per text that matches; a null
doc_id is matched like any other; no templates, templates without words or an empty table give no rows; other columns
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, written

WIDTH, LEAST = 5, 0.8
#: Least hashes of a window; sizes of windows, and from how many shingles on a template has them.
MINIMA, WINDOWS = 3, {8: 20, 4: 4, 1: 1}
#: Bound on the templates' band keys, and on their shingles, up to which they are lists in the plan; beyond it they are joined.
LISTED = 20_000

#: Sentences and whole texts of widely used public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
]


def _words(text: Column) -> Column:
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:()\"'\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz             ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _from(values: Column, by: int) -> Column:
    """The values from place `by` on, so that they lie beside those `by` places before them."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _whole(values: Column, run: Column, width: int) -> Column:
    """run without its last places, where a run of `width` values has run out of them."""
    return F.slice(run, F.lit(1), F.greatest(F.size(values) - (width - 1), F.lit(0)))


def _shingles(hashes: Column, width: int) -> Column:
    """Hashes of all runs of `width` words, from the words' hashes."""
    run = hashes
    for k in range(1, width):
        run = F.zip_with(run, _from(hashes, k), lambda a, b: F.shiftleft(a, 7).bitwiseOR(F.shiftrightunsigned(a, 57)).bitwiseXOR(b))
    return _whole(hashes, run, width)


def _hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _banded(rows: DataFrame, widths: list[int], sizes: list[int]) -> DataFrame:
    """rows with an array of band keys for each width of shingles (column sh<width>) and size of window: k<width>_<size>.

    Step by step, since what a later column uses twice would be computed twice: minima of 2, 4 and 8 places from those of half as many.
    """
    kept = rows.columns
    for w in widths:
        own = [f"m{w}_{i}" for i in range(MINIMA)] if max(sizes) > 1 else []
        rows = rows.select("*", *[F.transform(f"sh{w}", lambda x: F.xxhash64(F.lit(i), x)).alias(m) for i, m in enumerate(own)])  # noqa: B023
        for size in (1, 2, 4, 8):
            if size > max(sizes):
                break
            if size > 1:
                half = size // 2
                rows = rows.select(*[c for c in rows.columns if c not in own], *[F.zip_with(m, _from(F.col(m), half), lambda a, b: F.least(a, b)).alias(m) for m in own])
            if size in sizes:
                tag = F.lit(100 * w + size)
                pairs = [(a, b) for k, a in enumerate(own) for b in own[k + 1 :]]
                keys = [F.transform(f"sh{w}", lambda x: F.xxhash64(tag, x))] if size == 1 else [_whole(F.col(f"sh{w}"), F.zip_with(a, b, lambda x, y: F.xxhash64(tag, F.lit(k), x, y)), size) for k, (a, b) in enumerate(pairs)]  # noqa: B023
                rows = rows.select("*", F.concat(*keys).alias(f"k{w}_{size}"))
        kept = [*kept, *[c for c in rows.columns if c.startswith(f"k{w}_")]]
        rows = rows.select(*kept)
    return rows


def _of_templates(templates: DataFrame) -> DataFrame:
    """name, width, size (of windows), want (shingles, each once), keys (of all bands); a small table of its own."""
    # Written at each step: filters on made columns would be pushed down and make them over and over.
    read = written(templates.where("text is not null").select("name", _hashes(F.col("text")).alias("hashes")))
    rows = read.where("size(hashes) > 0").withColumn("width", F.least(F.size("hashes"), F.lit(WIDTH)))
    parts = None
    for w in range(1, WIDTH + 1):
        own = rows.where(F.col("width") == w).select("name", "width", _shingles(F.col("hashes"), w).alias(f"sh{w}"))
        size = F.coalesce(*[F.when(F.size(f"sh{w}") >= least, n) for n, least in WINDOWS.items()])
        keys = F.coalesce(*[F.when(F.col("size") == n, F.col(f"k{w}_{n}")) for n in WINDOWS])
        own = _banded(own.withColumn("size", size), [w], list(WINDOWS)).select("name", "width", "size", F.array_distinct(f"sh{w}").alias("want"), F.array_distinct(keys).alias("keys"))
        parts = own if parts is None else parts.unionByName(own)
    known = written(parts)
    forget(read)
    return known


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, template, n_shingles of the template, n_found, containment. templates: name, text."""
    known = _of_templates(templates)
    # At most WIDTH * len(WINDOWS) kinds of windows.
    kinds = sorted((r.width, r.size) for r in known.select("width", "size").distinct().collect())
    if not kinds:
        forget(known)
        return docs.limit(0).select("doc_id", F.lit("").alias("template"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found"), F.lit(0.0).alias("containment"))
    total = known.agg(F.sum(F.size("keys")).alias("k"), F.sum(F.size("want")).alias("s")).first()
    few = max(total.k, total.s) <= LISTED
    widths = sorted({w for w, _ in kinds})
    signed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("of"), _hashes(F.col("text")).alias("hashes"))
    signed = signed.select("doc_id", "of", *[_shingles(F.col("hashes"), w).alias(f"sh{w}") for w in widths])
    whole = F.concat(*[F.col(f"sh{w}") for w in widths])
    keyed = _banded(signed, widths, sorted({n for _, n in kinds})).withColumn("keys", F.concat(*[F.col(f"k{w}_{n}") for w, n in kinds]))
    if few:
        rows = known.select("name", "want", "keys").collect()
        forget(known)
        names: dict[int, set[str]] = {}
        for r in rows:
            for k in r["keys"]:
                names.setdefault(k, set()).add(r["name"])
        listed = F.array(*map(F.lit, names)).cast("array<long>")
        by_key = F.map_from_arrays(listed, F.array(*[F.array(*map(F.lit, sorted(n))) for n in names.values()]))
        met = keyed.select("doc_id", "of", whole.alias("found"), F.array_intersect("keys", listed).alias("met"))
        named = F.when(F.size("met") > 0, F.array_distinct(F.flatten(F.transform("met", lambda k: F.element_at(by_key, k)))))
        # An outer generator and no filter on `met`: the optimizer would push such a filter, and with it all hashing, below itself.
        candidates = met.select("doc_id", "of", "found", F.explode_outer(named).alias("name"))
        wanted = docs.sparkSession.createDataFrame([(r["name"], r["want"]) for r in rows], "name string, want array<bigint>")
        full = candidates.join(F.broadcast(wanted), "name")
    else:
        asked = keyed.select(F.col("doc_id").alias("own_id"), F.col("of").alias("own_of"), F.explode_outer(F.array_distinct("keys")).alias("key"))
        met = asked.join(known.select("name", F.explode("keys").alias("key")), "key").select("own_id", "own_of", "name").distinct()
        texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("of"), "text").join(met, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("of") == F.col("own_of")))
        texts = texts.select("doc_id", "of", "name", _hashes(F.col("text")).alias("hashes"))
        full = texts.select("doc_id", "of", "name", F.concat(*[_shingles(F.col("hashes"), w) for w in widths]).alias("found")).join(known.select("name", "want"), "name")
    counted = full.select("doc_id", "of", "name", F.size("want").cast("long").alias("n_shingles"), F.size(F.array_intersect("want", "found")).cast("long").alias("n_found"))
    match = F.col("n_found") / F.col("n_shingles")
    found = counted.where(match >= least).select("doc_id", "of", F.col("name").alias("template"), "n_shingles", "n_found", F.round(match, 6).alias("containment"))
    return found.distinct().drop("of")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), spark.createDataFrame(TEMPLATES, "name string, text string"))


_VALUES = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES)
OP3_SQL = rf"""
WITH t(name, text) AS (VALUES {_VALUES}),
x AS (SELECT 'd' AS kind, doc_id, NULL AS name, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 't', NULL, name, text FROM t),
w AS (SELECT kind, doc_id, name, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:()"''' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz             '), ' '), lambda v: v <> '') AS a FROM x),
s AS (SELECT DISTINCT kind, doc_id, name, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3] || ' ' || a[i + 4] AS sh
      FROM (SELECT *, unnest(range(1, len(a) - 3)) AS i FROM w)),
n AS (SELECT name, count(*) AS n_shingles FROM s WHERE kind = 't' GROUP BY name),
f AS (SELECT d.doc_id, t.name, count(*) AS n_found FROM s d JOIN s t ON d.kind = 'd' AND t.kind = 't' AND d.sh = t.sh GROUP BY ALL)
SELECT f.doc_id, f.name AS template, n.n_shingles, f.n_found, round(f.n_found / n.n_shingles, 6) AS containment
FROM f JOIN n ON f.name = n.name WHERE f.n_found / n.n_shingles >= 0.8
"""
