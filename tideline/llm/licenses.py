"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Everything on the main path is built-in column functions within a row: no join, no shuffle, so no key can be hot.

Words are runs of letters and digits in lower case; a shingle is the hash of five words (a template of fewer words is one
shingle of all its words and needs them as a whole run). Templates are put in length classes: class c holds templates of
n shingles with W/4 < n <= W/2 for W = 2**c, and is looked for in windows of W shingles that start every W/2, so that any
n shingles in a row lie whole in one window. A text that holds 80 % of the template's shingles there has a Jaccard
similarity with that window of at least 0.8 n / (W + 0.2 n) >= 0.19. With ``BANDS`` = 64 bands of one row, a miss has
probability (1 - 0.19)**64 < 2e-6.

A row of a band is the least shingle under ``hash xor seed``. A window can agree with a template in a band only if it
holds the very shingle that is the template's least one, so only windows with such a shingle are signed; this changes no
result.

Verification: share of the template's distinct shingles that the document holds, at least ``CONTAINMENT``.

Templates are a parameter: at most ``MAX_TEMPLATES`` of at most ``MAX_TEMPLATE_WORDS`` words, which bounds the literals
of the plan; more raise ValueError.

Defined results: null and empty texts match nothing; two templates that match the same text both give a row; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.columns import let, text_or_empty

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
MAX_TEMPLATES = 200
MAX_TEMPLATE_WORDS = 2_000

#: Opening or notice texts of public licenses.
TEMPLATES: list[tuple[str, str]] = [
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    (
        "cc-by-4.0",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
]


def seeds(bands: int = BANDS) -> list[int]:
    draw = random.Random(17)
    return [draw.getrandbits(64) - 2**63 for _ in range(bands)]


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in lower case."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of ``width`` words in a row; empty if there are fewer. ``hashes`` must be cheap to read again."""
    last = F.size(hashes) - width
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.xxhash64(*[hashes[k + d] for d in range(width)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def _bands(window: Column, size: Column) -> Column:
    """Hashes of (window size, band, least shingle) of one window."""
    return F.transform(
        F.array(*[F.struct(F.lit(i).alias("band"), F.lit(s).alias("seed")) for i, s in enumerate(seeds())]),
        lambda p: F.xxhash64(size, p["band"], F.array_min(F.transform(window, lambda h: h.bitwiseXOR(p["seed"])))),
    )


def _window_bands(found: Column, size: int, hits: Column) -> Column:
    """Band hashes of those windows of ``size`` shingles, starting every half of it, that hold one of the positions ``hits``."""
    step = size // 2
    holding = F.flatten(F.transform(hits, lambda p: F.array(p - p % step, p - p % step - step)))
    starts = F.filter(F.array_distinct(holding), lambda at: at >= 0)
    return F.flatten(F.transform(starts, lambda at: let(F.slice(found, at + 1, size), lambda w: _bands(w, F.lit(size)))))


class Template:
    """Shingles, window size and band hashes of one template, as read back from Spark."""

    def __init__(self, name: str, width: int, found: list[int], size: int, bands: list[int]):
        self.name, self.width, self.shingles, self.size, self.bands = name, width, found, size, bands
        self.least = sorted({min(found, key=lambda h, s=s: h ^ s) for s in seeds()})


def sign_templates(spark: SparkSession, templates: list[tuple[str, str]]) -> list[Template]:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES}")
    frame = spark.createDataFrame([(n, t) for n, t in templates], "name string, text string")
    rows = frame.select("name", word_hashes(F.col("text")).alias("w")).withColumn("n", F.size("w")).collect()
    shaped = []
    for row in rows:
        if not row["n"] or row["n"] > MAX_TEMPLATE_WORDS:
            raise ValueError(f"template {row['name']} has {row['n']} words; from 1 to {MAX_TEMPLATE_WORDS} are allowed")
        width, size = min(SHINGLE, row["n"]), 2
        while size // 2 < row["n"] - width + 1:
            size *= 2
        shaped.append((row["name"], list(row["w"]), width, size))
    frame = spark.createDataFrame(shaped, "name string, w array<bigint>, width int, size int")
    by_width = F.coalesce(*[F.when(F.col("width") == k, F.array_distinct(shingles(F.col("w"), k))) for k in range(1, SHINGLE + 1)])
    got = frame.select("name", "width", "size", by_width.alias("s")).withColumn("b", let(F.col("s"), lambda s: _bands(s, F.col("size"))))
    return [Template(r["name"], r["width"], list(r["s"]), r["size"], list(r["b"])) for r in got.collect()]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and template that it holds: doc_id, license_id, n_shingles, n_matched, containment."""
    signed = sign_templates(docs.sparkSession, templates)

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<bigint>")

    def of_width(width: int, hashes: Column) -> Column:
        """Structs of the templates of one shingle width that a text holds a candidate for, or null."""
        own = [t for t in signed if t.width == width]

        least = sorted({h for t in own for h in t.least})

        def retrieved(found: Column) -> Column:
            at = F.filter(F.transform(found, lambda h, i: F.when(h.isin(least), i)), lambda p: p.isNotNull())
            return let(at, lambda hits: F.when(F.size(hits) > 0, signed_windows(found, hits)))

        def signed_windows(found: Column, hits: Column) -> Column:
            bands = [_window_bands(found, size, hits) for size in sorted({t.size for t in own})]
            return let(F.array_intersect(F.flatten(F.array(*bands)), longs(sorted({b for t in own for b in t.bands}))), lambda h: verified(found, h))

        def verified(found: Column, hits: Column) -> Column:
            checks = [
                F.when(
                    F.arrays_overlap(hits, longs(t.bands)),
                    F.struct(
                        F.lit(t.name).alias("license_id"),
                        F.lit(len(t.shingles)).cast("long").alias("n_shingles"),
                        F.size(F.array_intersect(found, longs(t.shingles))).cast("long").alias("n_matched"),
                    ),
                )
                for t in own
            ]
            return F.filter(F.array(*checks), lambda c: c.isNotNull())

        return let(shingles(hashes, width), retrieved)

    def candidates(hashes: Column) -> Column:
        nothing = F.array().cast("array<struct<license_id:string,n_shingles:bigint,n_matched:bigint>>")
        return F.flatten(F.array(*[F.coalesce(of_width(w, hashes), nothing) for w in sorted({t.width for t in signed})]))

    # an outer explode: from an inner one Spark infers a filter that computes the whole array a second time
    out = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(let(word_hashes(text_or_empty(text_col)), candidates)).alias("c")).select("doc_id", "c.*")
    share = F.col("n_matched") / F.col("n_shingles")
    return out.withColumn("containment", F.round(share, 6)).filter(share >= F.lit(CONTAINMENT))
