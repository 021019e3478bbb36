"""Licence scans by a trained paragraph classifier, in DataFrame operations.

Each line of a text is a bag of hashed word and word-pair features. A binary
logistic regression finds the lines that speak of a licence; neighbouring ones
are one paragraph, so a wrapped notice is judged whole; where sentences end within
it, each run of lines up to such an end is judged too, so that two notices side
by side are both found. A softmax over the
families and an unknown class names a paragraph's family; its temperature and
the least probability that counts come from whole templates held back. A family
is confirmed when the paragraph holds half of the word pairs of one of its
templates, all words by which that template names its licence (and its version,
where the family has one), and no word that makes it another licence. An unsure
or unconfirmed paragraph is of the family "unknown".

The models are fitted on the driver from the templates below and a bounded
sample of the corpus' own distinct lines as the negative class. Scoring is
column expressions over whole texts, one row a document, without a shuffle.

Defined results
- Null or empty text: no lines, family null. Repeated rows are scanned row by row. Empty table: no rows.
- Several licence paragraphs: the confirmed one with the highest probability names the document, then the first;
  ``families`` lists every confirmed one (empty where none is).
- A carriage return or a zero character within a line is a blank.
- Columns named in ``keep`` pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import let

#: Distinct lines of the corpus that serve as the negative class at most (of each remainder of the lines' hashes the least).
SAMPLE_LINES = 2_000
BUCKETS = 4096
MIN_LICENCE, MIN_OVERLAP = 0.5, 0.5

# Notices as their licences word them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
    ],
}
UNKNOWN = [
    "All rights reserved.",
    "Copyright the authors. All rights reserved.",
    "Use of this file is subject to the terms of the license agreement.",
    "No part of this work may be reproduced without prior written permission of the publisher.",
    "Distributed under license from the owner.",
    "This software is proprietary and confidential.",
    "Licensed to the customer under the terms of the agreement.",
    "Permission to copy is granted for personal use only.",
    "Licensed under the GNU General Public License, version 2.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
    "You should have received a copy of the GNU General Public License along with this program.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Common Development and Distribution License.",
]
#: Sentences that borrow a notice's words and are none.
ORDINARY = [
    "The following conditions are met.",
    "You may win only provided that the following conditions are met.",
    "A driving license is renewed at the town hall every ten years.",
    "The museum has a license to serve drinks in the garden.",
    "The library lends books free of charge to any person in the district.",
    "The copyright of a song is a matter for lawyers.",
]

# Words by which a notice names its licence, words that make it another one, words that a version follows.
NAMING = ("apache", "mit", "gnu", "lesser", "gpl", "lgpl", "bsd", "mozilla", "mpl", "cc", "by", "nc", "commons", "attribution", "noncommercial", "cc0", "waived")
CHANGING = ("affero", "agpl", "lesser", "lgpl", "library", "nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs", "eclipse", "epl", "boost", "cddl", "cecill", "artistic", "european", "eupl")
BEFORE_VERSION = ("version", "v", "apache", "gpl", "mpl", "license")


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]++"), F.lit(0))


def _pairs(tokens: Column) -> Column:
    """Hashes of neighbouring words; of the word itself in a line of one."""
    two = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1)))
    return F.when(F.size(tokens) >= 2, two).otherwise(F.transform(tokens, lambda t: F.xxhash64(t, F.lit(""))))


def _marks(tokens: Column) -> Column:
    """The naming and changing words among the tokens, and "v2" for a version 2 that is spoken of."""
    words = F.filter(tokens, lambda t: t.isin(*{*NAMING, *CHANGING}))
    version = lambda t, i: F.when(t.rlike("^[0-9]$") & F.get(tokens, i - 1).isin(*BEFORE_VERSION), F.concat(F.lit("v"), t))
    return F.array_distinct(F.concat(words, F.array_compact(F.transform(tokens, version))))


def _buckets(tokens: Column) -> Column:
    words = F.transform(tokens, lambda t: F.xxhash64(t))
    return F.array_distinct(F.transform(F.concat(words, _pairs(tokens)), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))


def _vector(values: np.ndarray) -> Column:
    """An array constant: one literal, however long."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _logit(buckets: Column, weights: Column, bias: float | Column) -> Column:
    total = F.aggregate(buckets, F.lit(0.0), lambda a, i: a + F.get(weights, i))
    return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")) + bias


def _variants(text: str) -> list[str]:
    """The notice, its halves, and the notice with words left out here and there."""
    w = text.split()
    out = [text]
    if len(w) >= 8:
        out += [" ".join(w[: len(w) * 2 // 3]), " ".join(w[len(w) // 3 :])]
    out += [" ".join(x for i, x in enumerate(w) if i % 5 != k) for k in range(3) if len(w) >= 5]
    return out


class LicenceModel:
    """Weights of the two regressions, the softmax temperature, and the least probability of a family that counts."""

    def __init__(self, families: Sequence[str], found: np.ndarray, found_bias: float, named: np.ndarray, named_bias: np.ndarray, temperature: float, least: float):
        self.families, self.found, self.found_bias = list(families), found, found_bias
        self.named, self.named_bias, self.temperature, self.least = named, named_bias, temperature, least


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 4.0, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch logistic regression with momentum; classes weigh alike."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    weight = 1 / np.maximum(np.bincount(y, minlength=classes), 1)[y]
    weight = (weight / weight.sum())[:, None]
    mw, mb, one = np.zeros_like(w), np.zeros_like(b), np.eye(classes)[y]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - one) * weight
        mw, mb = 0.9 * mw + x.T @ g + decay * w, 0.9 * mb + g.sum(0)
        w, b = w - rate * mw, b - rate * mb
    return w, b


def _template_pairs(spark: SparkSession) -> list[tuple[str, list[int], list[str]]]:
    """(family, word pair hashes, marks that a confirmed paragraph has too) of each template."""
    made = spark.createDataFrame([(n, t) for n, texts in TEMPLATES.items() for t in texts], "name string, line string")
    rows = made.select("name", let(_tokens(F.col("line")), lambda t: F.array_distinct(_pairs(t))), let(_tokens(F.col("line")), _marks)).collect()
    versioned = {n for n in TEMPLATES if n[-1].isdigit() and "-" in n}
    return [(n, p, [m for m in marks if n in versioned or m[0] != "v"]) for n, p, marks in rows]


def _array(hashes: Sequence[int]) -> Column:
    return F.array(*[F.lit(h) for h in hashes]) if hashes else F.array().cast("array<bigint>")


def _like_a_template(line: Column, templates: Sequence[tuple[str, list[int], list[str]]]) -> Column:
    known = F.array(*[_array(p) for _, p, _ in templates])
    return let(F.array_distinct(_pairs(_tokens(line))), lambda p: F.exists(known, lambda t: F.size(F.array_intersect(p, t)) >= MIN_OVERLAP * F.size(t)))


def train(docs: DataFrame, text_col: str = "text", sample_lines: int = SAMPLE_LINES) -> LicenceModel:
    """Fits both regressions on the templates' variants and at most sample_lines lines of docs."""
    spark = docs.sparkSession
    rows = [(name, v, i) for name, texts in [*TEMPLATES.items(), ("unknown", UNKNOWN)] for i, t in enumerate(texts) for v in _variants(t)]
    made = spark.createDataFrame([(n, v, i) for n, v, i in rows], "name string, line string, nr int").select("name", "nr", let(_tokens(F.col("line")), _buckets).alias("x"))
    positive = made.collect()  # a few hundred rows
    lines = docs.select(F.explode(F.split(docs[text_col], "\n")).alias("line")).where("length(line) between 20 and 2000")
    lines = lines.where(~F.lower("line").rlike("licen[sc]e|copyright|all rights")).withColumn("h", F.xxhash64("line"))
    chosen = lines.groupBy(F.pmod("h", F.lit(sample_lines)).alias("of")).agg(F.min("h").alias("h")).select("h")
    chosen = spark.createDataFrame(chosen.collect(), "h bigint")  # sample_lines numbers at most
    lines = lines.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("line").alias("line"))
    ordinary = spark.createDataFrame([(x,) for x in ORDINARY], "line string")
    lines = lines.where(~_like_a_template(F.col("line"), _template_pairs(spark))).orderBy("h").select("line")
    bags = lambda t: [r["x"] for r in t.select(let(_tokens(F.col("line")), _buckets).alias("x")).collect()]
    negative = bags(ordinary) + bags(lines)

    families = [*TEMPLATES, "unknown"]

    def matrix(bags: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(bags), BUCKETS))
        for i, bag in enumerate(bags):
            out[i, bag] = 1 / np.sqrt(max(1, len(bag)))
        return out

    xp, xn = matrix([r["x"] for r in positive]), matrix(negative)
    y = np.array([families.index(r["name"]) for r in positive])
    w, b = _softmax_fit(np.concatenate([xp, xn]), np.concatenate([np.ones(len(xp), int), np.zeros(len(xn), int)]), 2)
    held = np.array([r["nr"] % 3 == 1 for r in positive])  # whole templates
    wc, bc = _softmax_fit(xp[~held], y[~held], len(families))
    z = xp[held] @ wc + bc

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(1))).mean())

    temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    e = np.exp((z - z.max(1, keepdims=True)) / temperature)
    top, right = (e / e.sum(1, keepdims=True)).max(1), z.argmax(1) == y[held]
    least = max(np.linspace(0.5, 0.1, 9), key=lambda at: (right & (top >= at)).sum() - (~right & (top >= at)).sum())
    wf, bf = _softmax_fit(xp, y, len(families))
    return LicenceModel(families, w[:, 1] - w[:, 0], float(b[1] - b[0]), wf, bf, float(temperature), float(least))


def scan(docs: DataFrame, model: LicenceModel, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep's columns with family, families, confirmed, probability, overlap and n_licence_lines (family null where no line speaks of one)."""
    chance = lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    found = _vector(model.found)
    named = F.array(*[_vector(model.named[:, k]) for k in range(len(model.families))])
    biases, names = F.array(*[F.lit(float(b)) for b in model.named_bias]), F.array(*[F.lit(n) for n in model.families])
    pairs = _template_pairs(docs.sparkSession)
    words = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")
    template = lambda p, m: F.struct(_array(p).alias("pairs"), words(m).alias("marks"))
    templates = F.array(*[F.array(*[template(p, m) for n, p, m in pairs if n == name] or [template((), ())]) for name in model.families])
    changing = words(CHANGING)

    def judge(line: Column) -> Column:
        def named_by(tokens: Column) -> Column:
            def best(z: Column) -> Column:
                top = F.array_max(z)
                k = (F.array_position(z, top) - 1).cast("int")
                total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - top) / model.temperature))

                def likeness(p: Column, marks: Column) -> Column:
                    def of(t: Column) -> Column:
                        same = (F.size(F.array_except(t["marks"], marks)) == 0) & (F.size(F.array_except(F.array_intersect(marks, changing), t["marks"])) == 0)
                        return F.when(same, F.size(F.array_intersect(p, t["pairs"])) / F.greatest(F.size(t["pairs"]), F.lit(1))).otherwise(0.0)

                    return F.array_max(F.transform(F.get(templates, k), of))

                mine = let(F.array_distinct(_pairs(tokens)), lambda p: let(_marks(tokens), lambda m: likeness(p, m)))
                return F.struct((F.lit(1.0) / total).alias("probability"), F.coalesce(mine, F.lit(0.0)).alias("overlap"), F.get(names, k).alias("name"))

            scores = let(_buckets(tokens), lambda x: F.zip_with(named, biases, lambda w, b: _logit(x, w, b)))
            return let(scores, best)

        return let(_tokens(line), named_by)

    def is_licence(line: Column) -> Column:
        return let(let(_tokens(line), _buckets), lambda x: (F.size(x) > 0) & (chance(_logit(x, found, model.found_bias)) >= MIN_LICENCE))

    def stretches(paragraph: Column) -> Column:
        """The paragraph, and where sentences end at line ends within it or a tag line begins, what lies between."""
        cut = F.regexp_replace(paragraph, "([.:!?][\"')]*[ \t]*)\r", "$1\u0000")
        cut = F.regexp_replace(cut, "(?i)\r(?=[^\r\u0000]{0,8}spdx-license-identifier:)", "\u0000")
        cut = F.regexp_replace(cut, "(?i)(spdx-license-identifier:[^\r\u0000]*)\r", "$1\u0000")
        parts = F.filter(F.split(cut, "\u0000"), lambda x: x != "")
        return let(parts, lambda a: F.when(F.size(a) > 1, F.concat(F.array(paragraph), a)).otherwise(F.array(paragraph)))

    plain = F.translate(F.coalesce(docs[text_col], F.lit("")), "\r\u0000", "  ")
    found_lines = F.transform(F.split(plain, "\n"), lambda x: F.when(is_licence(x), F.concat(x, F.lit("\r"))).otherwise("\n"))
    t = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], F.array_join(found_lines, "").alias("found"))
    t = t.withColumn("judged", F.transform(F.flatten(F.transform(F.filter(F.split("found", "\n+"), lambda x: x != ""), stretches)), judge))
    sure = lambda j: (j["overlap"] >= MIN_OVERLAP) & (j["probability"] >= model.least) & (j["name"] != "unknown")
    ranked = F.transform("judged", lambda j, i: F.struct(sure(j).alias("confirmed"), j["probability"].alias("probability"), (-i).alias("at"), j["overlap"].alias("overlap"), F.when(sure(j), j["name"]).otherwise("unknown").alias("family")))
    t = t.withColumn("best", F.array_max(ranked))
    confirmed = F.transform(F.filter("judged", sure), lambda j: j["name"])
    return t.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("best.family").alias("family"),
        F.sort_array(F.array_distinct(confirmed)).alias("families"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
        F.round("best.probability", 6).alias("probability"),
        F.round("best.overlap", 6).alias("overlap"),
        F.size(F.filter(F.split("found", "[\r\n]+"), lambda x: x != "")).alias("n_licence_lines"),
    )


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
