"""License scan by MinHash bands over overlapping text windows (DataFrame functions only).

A text is a sequence of words (letters and digits, lower case) and of their five-word shingles, hashed.  A catalogue of
license notices is shingled alike.  Windows of WIDE shingles, each half over the next, are sketched by BANDS MinHashes
of one row: windows of Jaccard similarity s share a band with probability 1 - (1 - s) ** BANDS, which is 0.996 at 0.5
and over 0.9999 at 0.67 (containment 0.8 of either in the other).  Templates are sketched at every offset, so a window
inside a copy meets its twin exactly.  Templates of fewer than WIDE shingles would be diluted in a wide window and are
met by windows of one shingle, whose MinHash is that shingle: nothing of theirs is missed.  A notice of fewer than five
words is one shingle of its own length, looked for at every word of the text.

Windows whose bands are in the catalogue retrieve templates; a match needs at least `threshold` of the template's
shingles among those around the window, by exact intersection.  Keys of a catalogue of up to LISTED keys are looked up
within the row of a text, so that only the few windows that hit are joined with the catalogue; those of a larger one
are joined as they are.  What is shuffled are matches, and keys if the catalogue is too large to be broadcast.

Defined results: null or empty text matches nothing; repeated rows (doc_id and text) give one result; a template that
occurs several times in a text is reported once, at its first place, with its best containment; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, text_of

SHINGLE, WIDE, BANDS = 5, 16, 8
#: Keys of the catalogue up to which they are part of the plan; up to which the catalogue is broadcast (20 bytes each).
LISTED, BROADCAST = 20_000, 1_000_000
WORDS = r"[\p{L}\p{N}]+"

# Public license notices.
CATALOGUE: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-3-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
]


def shingled(df: DataFrame, text: str) -> DataFrame:
    """df with words array<string> and h: hashes of all shingles in order."""
    low = F.lower(F.col(text))
    out = df.withColumn("words", once(F.regexp_extract_all(low, F.lit(WORDS), 0)))
    last = F.size("words") - SHINGLE
    none = F.array().cast("array<bigint>")
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(SHINGLE)]))
    return out.withColumn("h", once(F.when(last >= 0, hashes).otherwise(none)))


def wide_keys(start: Column, window: Column) -> Column:
    """struct(key, at) of each band of a window: the smallest of its shingle hashes in one of BANDS orders."""
    orders = [((k << 61) | (0x1B873593CC9E2D51 * (k + 1) & ((1 << 61) - 1))) for k in range(BANDS)]
    signed = [s - (1 << 64) if s >> 63 else s for s in orders]
    keys = [F.xxhash64(F.lit(k), F.array_min(F.transform(window, lambda x, s=s: x.bitwiseXOR(F.lit(s))))) for k, s in enumerate(signed)]
    return F.array(*[F.struct(k.alias("key"), start.alias("at")) for k in keys])


def templates(spark: SparkSession, catalogue: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[int, str]], dict[int, set[str]]]:
    """(license, t: its distinct shingles), the catalogue's keys as (key, license), and the first words of notices of fewer
    than SHINGLE words by their length; all as large as the catalogue."""
    rows = shingled(spark.createDataFrame(catalogue, "license string, text string"), "text")
    brief = F.filter(F.array(F.when(F.size("words") > 0, F.xxhash64(F.lit("brief"), F.array_join("words", " ")))), lambda x: x.isNotNull())
    rows = rows.withColumn("t", F.array_distinct(F.when(F.size("h") > 0, F.col("h")).otherwise(brief)))
    offsets = F.sequence(F.lit(0), F.size("h") - WIDE)
    wide = F.flatten(F.transform(offsets, lambda i: wide_keys(i, F.slice(F.col("h"), i + 1, F.lit(WIDE)))))
    single = F.transform("t", lambda x: F.struct(x.alias("key"), F.lit(0).alias("at")))
    keys = rows.select("license", F.explode(F.when(F.size("h") >= WIDE, wide).otherwise(single)).alias("k"))
    found = sorted({(r["key"], r["license"]) for r in keys.select("k.key", "license").collect()})
    first: dict[int, set[str]] = {}
    for r in rows.where((F.size("h") == 0) & (F.size("words") > 0)).select("words").collect():
        first.setdefault(len(r["words"]), set()).add(r["words"][0])
    return rows.select("license", "t"), found, first


def _brief(n: int, first: set[str]) -> str:
    """SQL of struct(key, at: -1 less the word's number) of each window of n words that begins as a notice does."""
    words = ", ".join(f"'{w}'" for w in sorted(first))  # letters and digits only
    starts = f"filter(if(size(words) >= {n}, sequence(0, size(words) - {n}), array()), i -> words[i] in ({words}))"
    return f"transform({starts}, i -> named_struct('key', xxhash64('brief', array_join(slice(words, i + 1, {n}), ' ')), 'at', -1 - i))"


def scan(documents: DataFrame, catalogue: list[tuple[str, str]] = CATALOGUE, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, containment, n_shared, n_template, first_word of every match."""
    spark = documents.sparkSession
    notices, keys, first = templates(spark, catalogue)
    text = text_of()
    rows = documents.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text")).where(F.col("text") != "")
    rows = shingled(rows, "text").select("doc_id", "version", "words", "h")
    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(WIDE // 2))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(F.col("h"), i + 1, F.lit(WIDE)).alias("w")))
    rows = rows.withColumn("wide", F.flatten(F.transform(windows, lambda x: wide_keys(x["at"], x["w"]))))
    distinct = sorted({k for k, _ in keys})
    few = len(distinct) <= LISTED
    # a list of the catalogue's keys keeps the few windows to look at before anything is exploded
    listed = f"x -> x.key in ({', '.join(map(str, distinct))})" if few and distinct else "x -> true"
    parts = ["wide", "transform(h, (x, i) -> named_struct('key', x, 'at', i))", *[_brief(n, words) for n, words in sorted(first.items())]]
    rows = rows.withColumn("hits", once(F.expr(f"concat({', '.join(f'filter({p}, {listed})' for p in parts)})")))
    bands = spark.createDataFrame(keys, "key long, license string")
    bands = F.broadcast(bands) if len(keys) <= BROADCAST else bands
    if few:
        hit = rows.select("doc_id", "version", "h", F.explode("hits").alias("x")).join(bands, F.col("x.key") == F.col("key"))
    else:  # keys travel without their text's hashes, which the hits meet afterwards
        found = rows.select("doc_id", "version", F.explode("hits").alias("x")).join(bands, F.col("x.key") == F.col("key"))
        found = found.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "x", "license").distinct()
        hit = rows.select("doc_id", "version", "h").join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version")))
    # notices have fewer shingles than characters; hits of a frequent one aren't gathered in a task while these are few
    small = sum(len(notice or "") for _, notice in catalogue) <= 8 * BROADCAST
    hit = hit.join(F.broadcast(notices) if small else notices, "license")
    n = F.size("t")
    start = F.greatest(F.lit(0), F.col("x.at") - n)
    near = F.when(F.col("x.at") < 0, F.array("x.key")).otherwise(F.slice("h", start + 1, F.col("x.at") - start + WIDE + n))
    found = hit.select("doc_id", "version", "license", n.alias("n_template"), F.when(F.col("x.at") < 0, -1 - F.col("x.at")).otherwise(F.col("x.at")).alias("at"), F.size(F.array_intersect("t", near)).alias("n_shared"))
    found = found.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_template"))
    best = found.groupBy("doc_id", "version", "license").agg(F.max("n_shared").alias("n_shared"), F.max("n_template").alias("n_template"), F.min("at").alias("first_word"))
    return best.select("doc_id", "license", (F.col("n_shared") / F.col("n_template")).alias("containment"), F.col("n_shared").cast("long").alias("n_shared"), F.col("n_template").cast("long").alias("n_template"), F.col("first_word").cast("long").alias("first_word"))
