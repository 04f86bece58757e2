"""License scans: which paragraphs of a document state a licence, and of which family.

A paragraph is a run of lines that ends at a blank line or at a line that ends a sentence; wrapped
lines are joined. All paragraphs of all documents are classified by a multinomial logistic
regression on word n-grams (one to three words, present or not), whose weights are sparse and whole
numbers (millionths), so sums are exact. N-grams of function words and numbers alone are no
features. One class is `unknown`, trained on prose that uses the same words; a temperature fitted on
wordings that the model hasn't seen calibrates the probabilities, and a best class below
MIN_PROBABILITY is unknown as well. A prediction is confirmed by comparison with the family's
templates: the share of a template's words that the paragraph has must reach MIN_TEMPLATE.

Training uses the templates below, on the driver; their number is fixed. Scanning probes the hashes
of all n-grams against the model's, whose number the templates fix, in one stage; a paragraph
without any weighted n-gram has the score of an empty one, which is unknown, and goes no further.
"""
from __future__ import annotations

import itertools
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, table
from .decontaminate import words

UNIT = 1_000_000
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.6
_SENTENCE_END = "([.!?:;][ \\t\\r]*)\\n"
_BLANK_LINE = "\\n[ \\t\\r]*\\n"
_FUNCTION_WORDS = set("a an and any are as at be but by for from has have he her his i if in is it its may no not of on or our she that the their they this to under was we were will with you your der die das und mit von zu de la le les et un une du des el los las y en para por una con o".split())

# Wordings of licence statements by family (public texts, shortened).
TEMPLATES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license", "License: MIT", "Lizenz: MIT", "Distributed under the MIT licence."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "Available under Apache 2.0", "Apache License 2.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "Available under GPLv3", "GNU GPL version 3"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "Available under GPLv2", "GNU GPL version 2"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later", "Available under the LGPL"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "Available under AGPLv3"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license", "BSD 3-Clause", "BSD 2-Clause License"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Text under CC BY 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text under CC BY-SA 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Text under CC BY-NC 4.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "License: ISC"],
    "proprietary": ["Copyright 2020 The Company. All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited", "This software is proprietary and confidential; no license is granted"],
}
# Prose with the same words that states no licence.
OTHER = [
    "her driving licence expired in the spring of that year", "the city gave the shop a license to sell wine", "the permission of the owner was asked before the tour", "he asked for permission to leave the room early", "the phone comes with a two year warranty on parts",
    "warranty claims must be sent to the store that sold the device", "the redistribution of land was the main question of the vote", "copyright law has changed a good deal since then", "a debate on copyright and the press was held in the parliament", "the song is long in the public domain, they said in court",
    "all rights of way across the field were lost", "the license plate of the car was stolen last night", "students need a license for this program before the course", "the board will license two new clinics this year", "poetic licence explains the odd dates in the novel", "without permission nobody may enter the old tower",
    "the version of the story in the second book is longer", "the general public was free to enter the terms of the hall", "this work is a copy of a painting by a student", "you may use the path except in winter",
]
_LEADS = ["", "Note: this file is part of the project. ", "Copyright (c) 2019 the authors. "]
_TAILS = ["", " See the file for details.", " More text follows here about other things."]
_TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
FOLDS = 4


def grams(text: str) -> list[str]:
    """Distinct features of a text."""
    w = _TOKEN.findall(text.lower())
    every = (w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    return list(dict.fromkeys(" ".join(g) for g in every if not all(x in _FUNCTION_WORDS or x.isdigit() for x in g)))


def _fit(texts: list[str], y: np.ndarray, n_classes: int, steps: int = 1200, rate: float = 0.6, sparse: float = 2e-4) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    index = {g: i for i, g in enumerate(sorted({g for t in texts for g in grams(t)}))}
    x = _present(texts, index)
    want, weight = np.eye(n_classes)[y], (1 / np.bincount(y, minlength=n_classes)[y])[:, None] * len(y) / n_classes
    w, b = np.zeros((len(index), n_classes)), np.zeros(n_classes)
    b[-1] = 2.0  # not learned: a text of which nothing is known is unknown
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = weight * (p / p.sum(1, keepdims=True) - want) / len(y)
        w -= 16 * rate * x.T @ g
        w = np.sign(w) * np.maximum(0, np.abs(w) - 16 * rate * sparse / 4)  # keeps weights sparse
    return index, w / 4, b  # weights of n-grams that are present


def _present(texts: list[str], index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(index)))
    for r, text in enumerate(texts):
        x[r, [index[g] for g in grams(text) if g in index]] = 0.25
    return x


def _wordings() -> list[tuple[str, int, int]]:
    """(text, class, fold): each wording alone and in two contexts; a wording's rows are of one fold."""
    out = []
    for k, ts in enumerate([*TEMPLATES.values(), OTHER]):
        for i, t in enumerate(ts):
            out += [(lead + t + tail, k, i % FOLDS) for lead, tail in zip(_LEADS, _TAILS)]
    return out


@lru_cache(maxsize=1)
def held_out() -> tuple[np.ndarray, np.ndarray]:
    """Scores and classes of all rows, each scored by a model that hasn't seen its wording."""
    rows, n = _wordings(), len(TEMPLATES) + 1
    scores, y = np.zeros((len(rows), n)), np.array([k for _, k, _ in rows])
    fold = np.array([f for _, _, f in rows])
    for f in range(FOLDS):
        index, w, b = _fit([t for t, _, g in rows if g != f], y[fold != f], n)
        scores[fold == f] = 4 * _present([t for t, _, g in rows if g == f], index) @ w + b
    return scores, y


@lru_cache(maxsize=1)
def train() -> tuple[tuple[str, ...], tuple[int, ...], tuple[tuple[str, tuple[int, ...]], ...], float]:
    """(classes, biases, (n-gram, weights)..., temperature); the last class is unknown."""
    classes = (*TEMPLATES, "unknown")
    rows = _wordings()
    index, w, b = _fit([t for t, _, _ in rows], np.array([k for _, k, _ in rows]), len(classes))
    z, y = held_out()

    def loss(t: float) -> float:
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        return float(-np.log(np.maximum(1e-12, (p / p.sum(1, keepdims=True))[np.arange(len(z)), y])).mean())

    temperature = min(np.linspace(0.3, 3, 28), key=loss)
    whole = np.round(w * UNIT).astype(int)
    kept = tuple((g, tuple(map(int, whole[i]))) for g, i in index.items() if whole[i].any())
    return classes, tuple(int(v) for v in np.round(b * UNIT)), kept, float(round(temperature, 2))


def _constant(spark: SparkSession, value: list, schema: str, name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(value)), f"array<struct<{schema}>>")).alias(name)).select(f"{name}.*")


def _templates() -> list[dict]:
    return [{"family": f, "words": sorted(set(_TOKEN.findall(t.lower())))} for f, ts in TEMPLATES.items() for t in ts]


def paragraphs(text):
    """Runs of lines up to a blank line or the end of a sentence at the end of a line."""
    return F.split(F.regexp_replace(text, _SENTENCE_END, "$1\n\n"), _BLANK_LINE)


def _hash(words_, n: int, first=None):
    """Hash of n words from place `first`, counted from 0."""
    return F.xxhash64(*(F.get(words_, F.lit(j) if first is None else first + j) for j in range(n)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, pos, family, probability, template_share, license: a row for each paragraph that the classifier gives a family.

    pos counts paragraphs from 0. family is the best class, probability its calibrated probability,
    template_share how much of the family's closest template the paragraph has, and license the
    family if both are high enough, else `unknown`. Paragraphs whose best class is unknown aren't
    reported; null and empty texts have none. Rows that repeat a doc_id with the same paragraph in
    the same place give one row. Null doc_ids are carried along. Very long texts are scanned whole.
    """
    spark = docs.sparkSession
    classes, biases, weights, temperature = train()
    n = len(classes)
    split = documents(docs).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text"))
    split = split.select("doc_id", "pos", F.xxhash64("text").alias("line"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = split.select("doc_id", "pos", "line", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    each = each.select("doc_id", "pos", "line", "w", F.explode(F.array(*(_hash(F.col("w"), k, F.col("i")) for k in (1, 2, 3)))).alias("h"))
    model = _constant(spark, [{"g": g, "id": i} for i, (g, _) in enumerate(weights)], "g:string,id:int", "x").withColumn("g", F.split("g", " "))
    model = model.select(F.when(F.size("g") == 1, _hash(F.col("g"), 1)).when(F.size("g") == 2, _hash(F.col("g"), 2)).otherwise(_hash(F.col("g"), 3)).alias("h"), "id")
    known = F.array(*(F.lit(x) for x in sorted({x for t in _templates() for x in t["words"]})))
    hit = each.join(F.broadcast(model), "h")  # as many rows as the templates have n-grams
    hit = hit.select("doc_id", "pos", "line", "id", F.array_intersect("w", known).alias("w"))
    held = hit.groupBy("doc_id", "pos", "line").agg(F.collect_set("id").alias("ids"), F.first("w").alias("w"))
    flat = F.split(F.lit(",".join(str(v) for _, row in weights for v in row)), ",").cast("array<bigint>")
    total = lambda k: F.aggregate("ids", F.lit(0).cast("long"), lambda acc, i: acc + F.element_at(flat, i * n + (k + 1)))
    z = F.array(*((total(k) + biases[k]) / F.lit(UNIT * temperature) for k in range(n)))
    scored = held.select("doc_id", "pos", "line", "w", z.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("p", F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top"))))
    scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", F.col("top")).cast("int"))).where("family <> 'unknown'")
    templates = F.broadcast(_constant(spark, _templates(), "family:string,words:array<string>", "x"))
    share = F.size(F.array_intersect("w", "words")) / F.size("words")
    best = scored.join(templates, "family").groupBy("doc_id", "pos", "line").agg(F.first("family").alias("family"), F.first("p").alias("p"), F.max(share).alias("share"))
    sure = (F.col("p") >= MIN_PROBABILITY) & (F.col("share") >= MIN_TEMPLATE)
    return best.select("doc_id", "pos", "family", F.round("p", 4).alias("probability"), F.round("share", 4).alias("template_share"), F.when(sure, F.col("family")).otherwise("unknown").alias("license"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    classes, biases, weights, temperature = train()
    values = ", ".join(f"('{g}', {list(v)})" for g, v in weights)
    templates = ", ".join(f"('{t['family']}', {t['words']})" for t in _templates())
    pars = f"regexp_split_to_array(regexp_replace(text, '{_SENTENCE_END}', '\\1' || chr(10) || chr(10), 'g'), '{_BLANK_LINE}')"
    return f"""
    WITH l AS (SELECT DISTINCT doc_id, pos, text FROM (SELECT doc_id, unnest({pars}) AS text, generate_subscripts({pars}, 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)),
    w AS (SELECT doc_id, pos, text, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM l),
    g AS (SELECT DISTINCT doc_id, pos, text, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, pos, text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(n) WHERE len(w) >= n)),
    v(g, v) AS (VALUES {values}),
    s AS (SELECT doc_id, pos, text, [{', '.join(f'(sum(v[{k + 1}]) + {biases[k]}) / {UNIT * temperature}' for k in range(len(classes)))}] AS z FROM g JOIN v USING (g) GROUP BY 1, 2, 3),
    p AS (SELECT doc_id, pos, text, {list(classes)}[list_position(z, list_max(z))] AS family, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p FROM s),
    t(family, words) AS (VALUES {templates}),
    b AS (SELECT doc_id, pos, text, family, any_value(p) AS p, max(len(list_intersect(list_distinct(w), words)) / len(words)) AS share FROM p JOIN w USING (doc_id, pos, text) JOIN t USING (family) GROUP BY 1, 2, 3, 4)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, family, round(p, 4) AS probability, round(share, 4) AS template_share, CASE WHEN p >= {MIN_PROBABILITY} AND share >= {MIN_TEMPLATE} THEN family ELSE 'unknown' END AS license FROM b
    """
