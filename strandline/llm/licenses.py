"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

Every paragraph (line of a text) is turned into sparse binary word 1- and 2-grams and scored by a multinomial logistic regression over
licence families and an `unknown` class. The regression is trained on paragraphs made by rule from the templates below, on ordinary
sentences that use licence words, and on PARAGRAPHS paragraphs of the corpus (those of least hash among the ones that share three words
in a row with a template, which are the hard ones), which count as unknown where no template sentence occurs in them. The probability a
family must reach is calibrated on held-out paragraphs. A prediction counts only if the paragraph's word triples confirm it
against a template of that family: most of the template occurs in it, or most of it occurs in the template.

The model (a weight row a gram of the training set) is bounded by the sample and is broadcast.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import cut, least_hash_sample, row_key

#: Distinct paragraphs of the corpus in the training sample, the code points that each of these has at most, and variants made of a template.
PARAGRAPHS, LONGEST, VARIANTS = 400, 4000, 8
STEPS, RIDGE = 300, 1e-4
#: Share of held-out unknown paragraphs that may pass, least probability, and least share of triples in common.
FALSE_RATE, LEAST_PROBABILITY, CONFIRM = 0.01, 0.35, 0.7
UNKNOWN = "unknown"

#: Well-known notice sentences a family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Licensed under the BSD 3-Clause License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, dedicated to the public domain."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "licensed under the GNU General Public License, version 3.", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the MIT License.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "reserved": ["All rights reserved.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."],
}
#: Short notices put together by rule: a lead and a licence's name.
LEADS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under")
NAMES = {"agpl": "the GNU Affero General Public License, version 3.", "apache": "the Apache License, Version 2.0.", "bsd": "the BSD 3-Clause License.", "cc0": "CC0 1.0 Universal.", "cc-by": "CC BY 4.0.", "cc-by-nc": "CC BY-NC 4.0.", "cc-by-sa": "CC BY-SA 4.0.", "gpl": "the GNU General Public License, version 3.", "lgpl": "the GNU Lesser General Public License, version 3.", "mit": "the MIT License.", "mpl": "the Mozilla Public License 2.0."}
for _family, _name in NAMES.items():
    TEMPLATES[_family] += [f"{lead} {_name}" for lead in LEADS]
#: Ordinary sentences that use the words of licences.
ORDINARY = [
    "She renewed her driving license at the office last week.", "The license fee for the stadium was paid in full.", "Permission to enter the garden was granted by the mayor.",
    "The warranty covers parts and labour for two years.", "A license plate was found near the public road.", "The library opened to the general public in spring.",
    "Redistribution of income was the subject of the debate.", "The software was free of charge for students.", "Copyright law was discussed in the third chapter.",
    "The apache helicopter landed on the field.", "Version 2.0 of the plan was published in March.", "No rights were reserved for the winner of the contest.",
    "The above notice was pinned to the door of the public house.", "The author and the publisher met in writing.", "Any person may obtain a copy of the map at the desk.",
]
_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*+"
_FAMILIES = sorted(TEMPLATES)
_CLASSES = [*_FAMILIES, UNKNOWN]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _runs(w: Column, n: int) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: i + (n - 1) <= F.size(w)), lambda i: F.array_join(F.slice(w, i, n), " "))


def _py_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", text.lower())


def _py_grams(w: list[str]) -> set[str]:
    return {*w, *(" ".join(x) for x in zip(w, w[1:], strict=False))}


def _triples(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]


def _necessary() -> str:
    """A pattern that every text holds which shares a triple with a template: the longest word of each triple, the rarest of
    these in the templates; a triple of short words stands whole. Words are grouped by their first letters, so that a
    place of the text is compared with few of them."""
    texts = [_py_words(t) for texts in TEMPLATES.values() for t in texts]
    often: dict[str, int] = {}
    for w in texts:
        for x in w:
            often[x] = often.get(x, 0) + 1
    parts = set()
    for w in texts:
        for triple in map(str.split, _triples(w)):
            word = max(triple, key=lambda x: (len(x), -often[x], x))
            parts.add((word,) if len(word) > 3 else tuple(triple))
    groups: dict[str, list[str]] = {}
    for part in sorted(parts):
        whole, n = r"[^a-z0-9]+".join(map(re.escape, part)), 2 if part[0][:2].isalnum() and len(part[0]) > 1 else 1
        groups.setdefault(part[0][:n], []).append(whole[n:])
    heads: dict[str, list[str]] = {}
    for head, rests in sorted(groups.items()):
        heads.setdefault(head[0], []).append(head[1:] + (f"(?:{'|'.join(rests)})" if len(rests) > 1 else rests[0]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in sorted(heads.items())) + ")(?![a-z0-9])"


def _paragraphs(docs: DataFrame) -> DataFrame:
    """All of docs' lines with their number; a repeated row's lines come once a row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "para"))


def _alike(docs: DataFrame) -> DataFrame:
    """docs' lines that share a triple of words with a template: those to learn from, and the only ones that can be confirmed."""
    needed = _necessary()
    lines = _paragraphs(docs.filter(F.lower(F.col("text").cast("string")).rlike(needed))).filter(F.lower("para").rlike(needed))
    known = F.array(*[F.lit(t) for t in sorted({t for texts in TEMPLATES.values() for x in texts for t in _triples(_py_words(x))})])
    # An array of one element binds the words, so that they are found once a paragraph and not once a triple.
    return lines.filter(F.get(F.transform(F.array(words(F.col("para"))), lambda w: F.arrays_overlap(_runs(w, 3), known)), F.lit(0)))


def _samples(paragraphs: DataFrame) -> list[tuple[list[str], int]]:
    """(words, class): made paragraphs of every family, ordinary sentences, and a bounded sample of the corpus."""
    rng = random.Random(20)
    short = paragraphs.select("para").filter(F.length("para") <= LONGEST)
    some = least_hash_sample(short, "para", PARAGRAPHS).select(F.xxhash64("para").alias("h"), words(F.col("para")).alias("w")).orderBy("h").collect()
    corpus = [r["w"] for r in some]
    notices = [" ".join(_py_words(t)) for texts in TEMPLATES.values() for t in texts]
    unknown = [w for w in corpus if not any(n in " ".join(w) for n in notices)] + [_py_words(t) for t in ORDINARY]
    filler = [x for w in corpus for x in w] + [x for t in ORDINARY for x in _py_words(t)]
    out = []
    for c, family in enumerate(_FAMILIES):
        for text in TEMPLATES[family]:
            w = _py_words(text)
            for v in range(VARIANTS):
                kept = [x for x in w if v == 0 or rng.random() > 0.08]
                around = rng.choices(filler, k=rng.randrange(0, 25)) if v % 2 else []
                at = rng.randrange(len(around) + 1)
                out.append((around[:at] + kept + around[at:], c))
    for w in unknown:
        out.append((w, len(_FAMILIES)))
        out.append((rng.sample(w, len(w)), len(_FAMILIES)))
    for _ in range(300):  # ordinary sentences around each other, and single licence words in prose
        a, b = rng.choice(ORDINARY), rng.choice(ORDINARY)
        out.append((_py_words(a)[: rng.randrange(3, 12)] + rng.choices(filler, k=12) + _py_words(b), len(_FAMILIES)))
    rng.shuffle(out)
    return out


def train(paragraphs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(grams, weights a gram and class, intercepts, threshold), by gradient steps on the bounded sample."""
    samples = _samples(paragraphs)
    held, used = samples[::4], [s for i, s in enumerate(samples) if i % 4]
    seen: dict[str, int] = {}
    for w, c in used:
        if c < len(_FAMILIES):
            for g in _py_grams(w):
                seen[g] = seen.get(g, 0) + 1
    for t in ORDINARY:
        for g in _py_grams(_py_words(t)):
            seen[g] = seen.get(g, 0) + 2
    grams = sorted(g for g, n in seen.items() if n >= 3)
    index = {g: i for i, g in enumerate(grams)}

    def matrix(rows):
        x = np.zeros((len(rows), len(grams) + 1), np.float32)
        for r, (w, _) in enumerate(rows):
            for g in _py_grams(w):
                if g in index:
                    x[r, index[g]] = 1
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        x /= norm
        x[:, -1] = 1
        return x, np.array([c for _, c in rows])

    x, y = matrix(used)
    weights = np.zeros((x.shape[1], len(_CLASSES)), np.float32)
    target = np.eye(len(_CLASSES), dtype=np.float32)[y]
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + x.T @ (target - p) / len(x) - RIDGE * weights
        weights += 3.0 * speed
    hx, hy = matrix(held)
    z = hx @ weights
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top = p[:, :-1].max(axis=1)
    other = np.sort(top[hy == len(_FAMILIES)])[::-1]
    allowed = int(FALSE_RATE * len(other))
    threshold = max(LEAST_PROBABILITY, float(other[allowed]) + 1e-6 if len(other) > allowed else 0.0)
    return grams, weights[:-1].astype(float), weights[-1].astype(float), threshold


def _templates(spark) -> DataFrame:
    rows = [(f, _triples(w)) for f, texts in TEMPLATES.items() for w in map(_py_words, texts)]
    return spark.createDataFrame(rows, "family string, triples array<string>")


def _met(para: Column, grams: list[str], weights: np.ndarray, intercepts: np.ndarray, threshold: float) -> Column:
    """A paragraph's grams that the model has, each once; null if none of them speaks for a family more than for `unknown`.

    A family's logit without such a gram exceeds that of `unknown` by no more than the intercepts do. Only where these alone
    reach the threshold are all paragraphs kept.
    """
    over = (weights[:, :-1] - weights[:, -1:]).max(axis=1)
    least = float((np.log(threshold / (1 - threshold)) - (intercepts[:-1] - intercepts[-1])).min()) if threshold < 1 else 1.0
    # With no more than `eps` a gram, and at most len(grams) of them, the sum over the root of their number stays below what lacks.
    eps = 0.5 * least / len(grams) ** 0.5 if least > 0 and grams else -np.inf
    speaking = [g for g, x in zip(grams, over, strict=True) if x > eps]
    pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    held = lambda w: F.array_distinct(F.filter(F.concat(w, pairs(w)), lambda g: g.isin(grams)))
    bind = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    return bind(words(para), lambda w: bind(held(w), lambda k: F.when(F.exists(k, lambda g: g.isin(speaking)), k)))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, family, probability, likeness, confirmed) of every paragraph that a family is predicted for.

    Every line is scored. The model learns from the lines that share a triple with a template, and only these are compared
    with the templates: the others have no triple in common with any.
    """
    spark = docs.sparkSession
    alike = cut(_alike(docs))  # few; training and confirmation read them
    grams, weights, intercepts, threshold = train(alike)
    model = spark.createDataFrame([(g, w) for g, w in zip(grams, weights.tolist(), strict=True)], "gram string, w array<double>")
    # Rows of one key are one text; each is summed on its own, so that no sum is doubled.
    each = _paragraphs(docs).withColumn("copy", F.monotonically_increasing_id())
    met = each.select("copy", "doc_id", "row", "line", F.explode(_met(F.col("para"), grams, weights, intercepts, threshold)).alias("gram")).join(F.broadcast(model), "gram")
    sums = met.groupBy("copy", "doc_id", "row", "line").agg(F.count("*").alias("n"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(_CLASSES))])
    logits = [F.col(f"s{i}") / F.sqrt("n") + float(b) for i, b in enumerate(intercepts)]
    top = F.greatest(*logits)
    total = sum((F.exp(z - top) for z in logits), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(z.alias("z"), F.lit(c).alias("family")) for z, c in zip(logits[:-1], _FAMILIES, strict=True)]))
    scored = sums.select("doc_id", "row", "line", best.alias("b"), total.alias("total"), top.alias("top")).select("doc_id", "row", "line", F.col("b.family").alias("family"), (F.exp(F.col("b.z") - F.col("top")) / F.col("total")).alias("probability"))
    predicted = scored.filter(F.col("probability") >= threshold).dropDuplicates(["row", "line"])
    own = F.get(F.transform(F.array(words(F.col("para"))), lambda w: _runs(w, 3)), F.lit(0))
    shown = predicted.join(alike.select("row", "line", own.alias("own")).dropDuplicates(["row", "line"]), ["row", "line"], "left").join(F.broadcast(_templates(spark)), "family")
    common = F.size(F.array_intersect("own", "triples"))
    likeness = F.when(F.col("own").isNull(), 0.0).otherwise(common / F.greatest(F.least(F.size(F.array_distinct("own")), F.size(F.array_distinct("triples"))), F.lit(1)))
    found = shown.groupBy("doc_id", "row", "line", "family", "probability").agg(F.max(likeness).alias("likeness"))
    return found.withColumn("confirmed", F.col("likeness") >= CONFIRM)


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, para, family, probability, likeness, confirmed): predictions with their paragraphs."""
    paras = _paragraphs(docs).select("row", "line", "para")
    found = predictions(docs)
    return paras.join(found, ["row", "line"]).dropDuplicates(["row", "line"]).select("doc_id", "row", "line", "para", "family", "probability", "likeness", "confirmed")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_predicted, n_confirmed, families, least_probability) a row of docs; families are the confirmed ones, sorted.

    Null and empty texts have none; repeated rows each get a row; an empty table gives no rows (the model then rests on
    the templates alone). Only doc_id and text are read.
    """
    found = predictions(docs)
    per_row = found.groupBy("row").agg(F.count("*").alias("n_predicted"), F.count_if("confirmed").alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"), F.round(F.min("probability"), 3).alias("least_probability"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row"))
    out = rows.join(per_row, "row", "left")
    return out.select("doc_id", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), "least_probability")
