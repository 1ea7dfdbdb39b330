"""License scans: MinHash bands of overlapping text windows retrieve notices, exact shingle containment verifies them.

For every size class of notices the text is cut into windows a little longer than the class, at a stride that leaves each
notice whole in some window. A window and a notice that share a band's minimum collide; the number of bands is set so
that a notice of which CONTAINED percent lies in a window is missed with odds of MISS at most. Only windows near an anchor
word are cut, since no other can hold CONTAINED percent of a notice. Only DataFrame functions.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, CONTAINED, MISS = 5, 80, 1e-4

#: Bytes up to which the notices' band keys, and their shingles, are broadcast; more are joined by a shuffle.
KEY_BYTES = 16_000_000
#: Anchor words up to which one pattern looks for any of them in the text before it is cut into words.
PATTERN_ANCHORS = 100

# Wording of public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@lru_cache(4096)
def normal(text: str) -> tuple[str, ...]:
    return tuple(re.sub("[^a-z0-9]+", " ", text.lower()).split())


@lru_cache(4096)
def _shingles(words: tuple[str, ...]) -> list[str]:
    k = min(WORDS, len(words))
    return sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}) if words else []


def size_class(n: int) -> int:
    """The least class of at least n words: n below WORDS, then WORDS and half as much again each time."""
    c = min(n, WORDS)
    while c < n:
        c = -(-3 * c // 2)
    return c


def stride(c: int) -> int:
    return max(1, c // 4)


def shingle_words(c: int) -> int:
    """Words of a shingle in a size class: a notice of under WORDS words is one shingle of all of them."""
    return min(WORDS, c)


def bands(notices: dict[str, str]) -> int:
    """Bands of one minimum each that keep the odds of a miss at MISS for the least similar window of any notice."""
    most = 1
    for text in notices.values():
        words = normal(text)
        if not words:
            continue
        own = len(_shingles(words))
        shared = -(-CONTAINED * own // 100)
        c = size_class(len(words))
        j = shared / (c + stride(c) - shingle_words(c) + own - shared)
        most = max(most, 1 if j >= 1 else math.ceil(math.log(MISS) / math.log(1 - j)))
    return most


def anchors(notices: dict[str, str]) -> list[str]:
    """Words such that a text with CONTAINED percent of a notice's shingles has one of the notice's words among them.

    Each notice's longest words are taken until the shingles without any are fewer than must be shared.
    """
    found: set[str] = set()
    for text in notices.values():
        having: dict[str, set[int]] = {}
        shingles = _shingles(normal(text))
        for i, s in enumerate(shingles):
            for w in s.split():
                having.setdefault(w, set()).add(i)
        left, words = set(range(len(shingles))), sorted(having, key=lambda w: (-len(w), w))
        need = -(-CONTAINED * len(left) // 100)
        while len(left) >= need and words:
            w = words.pop(0)
            found.add(w)
            left -= having[w]
    return sorted(found)


def _minima(hashes: Column, n: int) -> Column:
    """Array of (band, minimum) over an array of shingle hashes."""

    def band(b: int) -> Column:
        return F.struct(F.lit(b).alias("band"), F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(b)))).alias("low"))

    return F.array(*map(band, range(n)))


def _hashes(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, in order; none where there are fewer words."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))


def _by_class(column: Column, arrays: dict[int, Column]) -> Column:
    """The array of shingles of a class's length."""
    out = arrays[WORDS]
    for k, x in arrays.items():
        if k < WORDS:
            out = F.when(column == k, x).otherwise(out)
    return out


def templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license, class and distinct shingle hashes of each notice: as many rows as there are notices with a word."""
    rows = [(name, size_class(len(w)), w) for name, w in ((name, normal(text)) for name, text in notices.items()) if w]
    given = spark.createDataFrame(rows, "license string, class int, w array<string>")
    short = sorted({c for _, c, _ in rows if c < WORDS})
    return given.select("license", "class", F.array_distinct(_by_class(F.col("class"), {k: _hashes(F.col("w"), k) for k in [WORDS, *short]})).alias("t"))


def given(notices: DataFrame) -> dict[str, str]:
    """The notices of a table (license, text) for scan(): they are brought to the driver, so a list of licenses, not of documents."""
    return {r["license"]: r["text"] or "" for r in notices.select("license", "text").where("license is not null").collect()}


def scan(spark: SparkSession, docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Rows (doc_id, license, containment percent, first and last word) for the best window of each notice found in a text.

    Words are lower-cased runs of a-z and 0-9. Of equally good windows the first counts. Null and empty texts find nothing;
    repeated rows give one row; other columns are ignored. A notice of under WORDS words is one shingle, and is found in every
    text that has its words in a row. Notices without words are never found.
    """
    known = templates(spark, notices)
    n, anchor = bands(notices), anchors(notices)
    low = F.lower(F.col("text").cast("string"))
    text = docs.select(F.col("doc_id").cast("long"), low.alias("text"))
    text = text.where(F.col("text").rlike("|".join(anchor)) if 0 < len(anchor) <= PATTERN_ANCHORS else F.lit(len(anchor) > 0))
    words = F.filter(F.split(F.regexp_replace("text", "[^a-z0-9]+", " "), " "), lambda w: w != "")
    # as text, since there may be very many
    among = "x IN ('" + "', '".join(anchor) + "')" if anchor else "false"
    marked = F.expr(f"filter(transform(w, (x, i) -> IF({among}, i, NULL)), i -> i IS NOT NULL)")
    has = text.select("doc_id", words.alias("w")).select("doc_id", "w", marked.alias("a")).where(F.size("a") > 0)
    classes = sorted({size_class(len(normal(t))) for t in notices.values() if normal(t)})
    lengths = sorted({WORDS, *map(shingle_words, classes)})
    hashed = has.select("doc_id", F.size("w").alias("n"), "a", *[_hashes(F.col("w"), k).alias(f"h{k}") for k in lengths])

    def cut(c: int) -> Column:
        """Windows of a class at multiples of its stride, for each anchor all that reach it."""
        s, k = stride(c), shingle_words(c)
        near = F.array_distinct(F.transform("a", lambda i: i - i % s))
        at = F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(*(i - s * j for j in range((c + s - 2) // s + 1))))))
        inside = F.filter(at, lambda i: (i >= 0) & (i < F.size(f"h{k}")))
        return F.transform(inside, lambda i: F.struct(F.lit(c).alias("class"), F.lit(k).alias("k"), i.alias("at"), F.lit(c + s - k).alias("size")))

    windows = hashed.select("*", F.explode(F.concat(*map(cut, classes)) if classes else F.array().cast("array<struct<class:int,k:int,at:int,size:int>>")).alias("x"))
    shingles = _by_class(F.col("x.k"), {k: F.col(f"h{k}") for k in lengths})
    windows = windows.select("doc_id", "n", "x.class", "x.k", "x.at", F.slice(shingles, F.col("x.at") + 1, F.col("x.size")).alias("h"))
    probes = windows.select("*", F.explode(_minima(F.col("h"), n)).alias("m")).select("doc_id", "n", "class", "k", "at", "h", "m.band", "m.low")
    keys = known.select("license", "class", F.explode(_minima(F.col("t"), n)).alias("m")).select("license", "class", "m.band", "m.low")
    few = lambda bytes_, d: F.broadcast(d) if bytes_ <= KEY_BYTES else d
    met = probes.join(few(64 * n * len(notices), keys), ["class", "band", "low"])
    met = met.join(few(8 * sum(len(_shingles(normal(t))) for t in notices.values()), known.select("license", "t")), "license")
    share = (100 * F.size(F.array_intersect("h", "t")) / F.size("t")).alias("containment")
    good = met.select("doc_id", "license", "at", F.least(F.col("at") + F.size("h") + F.col("k") - 2, F.col("n") - 1).alias("end"), share).where(F.col("containment") >= CONTAINED)
    best = good.groupBy("doc_id", "license").agg(F.max_by(F.struct("containment", "at", "end"), F.struct("containment", -F.col("at"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), F.col("b.at").cast("long").alias("first_word"), F.col("b.end").cast("long").alias("last_word"))


def op5_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, common.table(spark, sf_dir, "documents"))


def _row(name: str, text: str) -> str:
    shingles, c = _shingles(normal(text)), size_class(len(normal(text)))
    return f"('{name}', {c}, {stride(c)}, {len(shingles)}, {shingle_words(c)}, [" + ", ".join(f"'{s}'" for s in shingles) + "])"


_LENGTHS = sorted({shingle_words(size_class(len(normal(t)))) for t in NOTICES.values()})
ORACLE = f"""
WITH t(license, class, stride, k, sw, s) AS (VALUES {", ".join(_row(name, text) for name, text in NOTICES.items())}),
ts AS (SELECT license, class, stride, k, sw, unnest(s) AS sh FROM t),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, sw, unnest(range(len(w) - sw + 1)) AS pos FROM d, (SELECT unnest({_LENGTHS}) AS sw) WHERE len(w) >= sw),
m AS (SELECT doc_id, n, sw, pos, array_to_string(w[pos + 1 : pos + sw], ' ') AS sh FROM g),
hit AS (SELECT doc_id, n, pos, license, class, stride, k, sw, sh FROM m JOIN ts USING (sw, sh)),
win AS (SELECT doc_id, n, license, class, stride, k, sw, sh, unnest(range((greatest(pos - (class + stride - sw) + 1, 0) + stride - 1) // stride * stride, pos + 1, stride)) AS win_at FROM hit),
c AS (SELECT doc_id, license, win_at, any_value(n) AS n, any_value(sw) AS sw, any_value(class + stride) AS cs, 100 * count(DISTINCT sh) / any_value(k) AS containment FROM win GROUP BY doc_id, license, win_at),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, win_at) AS rn FROM c WHERE containment >= {CONTAINED})
SELECT doc_id, license, containment, CAST(win_at AS BIGINT) AS first_word, CAST(least(win_at + least(cs - sw, n - sw + 1 - win_at) + sw - 2, n - 1) AS BIGINT) AS last_word FROM r WHERE rn = 1
"""
