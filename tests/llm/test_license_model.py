"""The licence classifier's score by hand, the necessary pattern, ties, long paragraphs, and paraphrased notices it was not made from."""

import math
import random
import re

import pytest

from strandline.llm import licenses

#: Written apart from the templates: whole notices as projects state them, some shortened, wrapped in prose or re-cased.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "// Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License."),
    ("bsd", "* Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one."),
    ("cc-by-sa", "Text and pictures: this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("reserved", "Copyright 2019 Harbor Works. All rights reserved."),
]
PLAIN = [
    "The fishing license of the harbour was renewed by the mayor in the spring of that year.", "He asked for permission to use the boat and a copy of the map.", "In all copies of the book the third page is missing.",
    "The terms of the contract were read to the public by the clerk.", "All rights of way were closed during the storm.", "A version of the song was published by the sailors.",
    "The software of the lighthouse is old, and so are the conditions of the stairs.", "The law of the sea was the subject of the general meeting.", "Free of charge, the children rode the ferry.", "This work is done by hand.",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_precision_and_recall_on_other_notices(spark):
    rng = random.Random(3)
    wrapped = [(f, t) for f, t in NOTICES] + [(f, t.upper()) for f, t in NOTICES[:6]] + [(f, f"{rng.choice(PLAIN)}\n{t}\n{rng.choice(PLAIN)}") for f, t in NOTICES]
    texts = [t for _, t in wrapped] + PLAIN
    got = {r.doc_id: r.families for r in licenses.scan(rows(spark, texts)).collect()}
    right = sum(f in got[i].split(",") for i, (f, _) in enumerate(wrapped))
    wrong = sum(bool(got[i]) for i in range(len(wrapped), len(texts)))
    assert right / len(wrapped) >= 0.9, [(f, got[i]) for i, (f, _) in enumerate(wrapped) if f not in got[i].split(",")]
    assert wrong == 0, [texts[i] for i in range(len(wrapped), len(texts)) if got[i]]


def test_score_is_the_regression_of_the_paragraph(spark, monkeypatch):
    texts = [NOTICES[0][1], NOTICES[9][1], "Licensed under the MIT License.", "All rights reserved. " * 3]
    docs = rows(spark, texts)
    model = licenses.train(licenses._paragraphs(docs))
    monkeypatch.setattr(licenses, "train", lambda paragraphs: model)
    names, weights, intercepts, threshold = model
    at = {g: i for i, g in enumerate(names)}
    found = {r.doc_id: r for r in licenses.licence_paragraphs(docs).collect()}
    for d, text in enumerate(texts):
        held = [at[g] for g in licenses._py_grams(licenses._py_words(text)) if g in at]
        z = weights[held].sum(axis=0) / math.sqrt(len(held)) + intercepts
        p = [math.exp(v - max(z)) for v in z]
        p = [v / sum(p) for v in p]
        best = max(range(len(p) - 1), key=p.__getitem__)
        assert (p[best] >= threshold) == (d in found)
        if d in found:
            assert found[d].family == licenses._CLASSES[best] and abs(found[d].probability - p[best]) < 1e-6


def test_every_triple_of_a_template_passes_the_pattern():
    pattern = re.compile(licenses._necessary())
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            for triple in licenses._triples(licenses._py_words(text)):
                assert pattern.search(triple) and pattern.search("_" + triple.replace(" ", ",\t") + "é")


@pytest.mark.parametrize("size", [200_000])
def test_a_very_long_paragraph_and_repeated_lines(spark, size):
    filler = "word " * size
    texts = [filler + "\n" + NOTICES[2][1], NOTICES[2][1] + "\n" + NOTICES[2][1], filler + NOTICES[2][1]]
    got = {r.doc_id: (r.n_confirmed, r.families) for r in licenses.scan(rows(spark, texts)).collect()}
    assert got[0] == (1, "apache") and got[1] == (2, "apache") and got[2][1] in ("", "apache")


def test_paragraphs_without_a_triple_of_a_template_are_scored(spark, monkeypatch):
    """Every line has the plain score's prediction, whether or not three of its words stand in a template; repeated rows count once a row."""
    rng = random.Random(5)
    texts = []
    for family, notice in NOTICES:
        w = licenses._py_words(notice)
        texts += [" ".join(rng.sample(w, len(w))), " ".join(x for x in w[::2]), "\n".join(" ".join(w[i : i + 2]) for i in range(0, len(w), 2))]
    texts += PLAIN + ["", " \n\n", "zzz qqq"]
    docs = rows(spark, [*texts, NOTICES[0][1]])
    model = licenses.train(licenses._alike(docs))
    monkeypatch.setattr(licenses, "train", lambda paragraphs: model)
    names, weights, intercepts, threshold = model
    at = {g: i for i, g in enumerate(names)}

    def predicted(line):
        held = [at[g] for g in licenses._py_grams(licenses._py_words(line)) if g in at]
        if not held:
            return False
        z = weights[held].sum(axis=0) / math.sqrt(len(held)) + intercepts
        p = [math.exp(v - max(z)) for v in z]
        return max(p[:-1]) / sum(p) >= threshold

    got = {r.doc_id: r for r in licenses.scan(docs.unionByName(docs.filter("doc_id < 3"))).collect()}
    assert {d: got[d].n_predicted for d in range(len(texts))} == {d: sum(map(predicted, t.split("\n"))) for d, t in enumerate(texts)}
    known = {t for ts in licenses.TEMPLATES.values() for t in ts for t in licenses._triples(licenses._py_words(t))}
    bare = [d for d, t in enumerate(texts) if not any(known & set(licenses._triples(licenses._py_words(x))) for x in t.split("\n"))]
    assert sum(got[d].n_predicted for d in bare) > 0 and all(got[d].n_confirmed == 0 for d in bare)
