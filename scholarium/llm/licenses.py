"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Built-in expressions only. A window is WINDOW shingles of K words, a new one begins every STRIDE shingles, and the first
STRIDE shingles of a text are a window of their own, so every shingle is in two windows. A band is one minimum: a template whose single shingle is one of a window's four shares a
band of it with probability 1/4 at least, so of the 24 bands of its two windows all miss once in a million; a window that is
wholly the template's always hits. Templates are a list of their own, whose size is checked before it is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise, small

K, WINDOW, STRIDE, BANDS, CONTAINMENT = 5, 4, 2, 24, 0.8
#: Bands of templates that are written into the filter as a list; more of them are joined without it.
LISTED = 60_000
# Notices in common use.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT-header", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _spread(words_: Column, step: int) -> Column:
    """Slices with the words of WINDOW shingles, every `step` shingles."""
    last = F.size(words_) - K
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(words_, i + 1, F.lit(WINDOW + K - 1))))


def _text_windows(words_: Column) -> Column:
    """The windows of a text: one every STRIDE shingles, before them one as if begun at -STRIDE, which its start cuts short."""
    return F.concat(F.array(F.slice(words_, 1, STRIDE + K - 1)), _spread(words_, STRIDE))


def _bands(windows: DataFrame, key: str, words_: str, wanted: dict[int, list[int]] | None = None) -> DataFrame:
    """(key, band, least): for each hash function the least hash of the window's shingles, of windows with a wanted one.

    Two things keep the many expressions fast: a projection with a higher-order function is compiled in small methods,
    which the JVM optimises, and no filter is pushed below an outer generator, where it would evaluate them anew.
    """
    w = F.col(words_)
    hashed = windows.select(key, *[F.when(F.size(w) >= i + K, F.xxhash64(*[F.get(w, F.lit(i + j)) for j in range(K)])).alias(f"s{i}") for i in range(WINDOW)])
    rest = [F.col(f"s{i}") for i in range(WINDOW)]
    least = hashed.select(key, F.filter(F.array(*rest), lambda s: s.isNotNull()).alias("_shingles"), *[F.least(*[F.when(s.isNotNull(), F.xxhash64(s, F.lit(b))) for s in rest]).alias(f"b{b}") for b in range(BANDS)])
    listed = lambda b, v: F.expr(f"b{b} IN ({', '.join(f'{x}L' if x > -(1 << 63) else 'long(-9223372036854775808)' for x in v)})")
    known = F.lit(True) if wanted is None else reduce(lambda x, y: x | y, [listed(b, v) for b, v in sorted(wanted.items())], F.lit(False))
    bands = F.when((F.size("_shingles") > 0) & known, F.transform(F.array(*[F.col(f"b{b}") for b in range(BANDS)]), lambda m, b: F.struct(b.alias("band"), m.alias("least"))))
    return least.select(key, bands.alias("_bands")).select(key, F.explode_outer("_bands").alias("_b")).where("_b is not null").select(key, "_b.band", "_b.least")


def shingles(words_: Column) -> Column:
    """Distinct K-word shingles, as text."""
    last = F.size(words_) - K
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words_, i + 1, F.lit(K)), " ")))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, licenses: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license_id, n_shingles, n_found, containment) for every document that holds at least `containment` of a
    template's distinct shingles anywhere in its text.

    Null and empty texts, and texts or templates of fewer than K words, match nothing. Rows without doc_id are left out;
    rows that repeat a doc_id are judged one by one and the best is given. Templates that share an id are judged one by
    one too. Long texts cost in proportion. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    known = licenses.select("license_id", words(F.col("text")).alias("_words")).where("license_id is not null")
    wanted = materialise(_bands(known.select("license_id", F.explode(_spread(F.col("_words"), 1)).alias("_window")), "license_id", "_window").distinct())
    values: dict[int, list[int]] = {}
    n = wanted.count()
    for row in wanted.select("band", "least").distinct().collect() if n <= LISTED else []:
        values.setdefault(row.band, []).append(row.least)
    windows = docs.select("doc_id", words(F.col("text")).alias("_words")).select("doc_id", F.explode(_text_windows(F.col("_words"))).alias("_window"))
    hits = _bands(windows, "doc_id", "_window", values if n <= LISTED else None)
    candidates = materialise(hits.join(small(wanted, n), ["band", "least"]).select("doc_id", "license_id").distinct())
    per_doc = candidates.groupBy("doc_id").agg(F.collect_set("license_id").alias("_ids"))
    near = docs.join(small(per_doc, candidates.count()), "doc_id").select("doc_id", words(F.col("text")).alias("_words"), "_ids").select("doc_id", shingles(F.col("_words")).alias("_has"), F.explode("_ids").alias("license_id"))
    of = known.select("license_id", shingles(F.col("_words")).alias("_of"))
    found = near.join(small(of, n), "license_id").select("doc_id", "license_id", F.size("_of").cast("long").alias("n_shingles"), F.size(F.array_intersect("_has", "_of")).cast("long").alias("n_found"))
    scored = found.where("n_shingles > 0").withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= containment)
    return scored.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", "n_found", "n_shingles")).alias("_best")).select("doc_id", "license_id", "_best.n_shingles", "_best.n_found", "_best.containment")
