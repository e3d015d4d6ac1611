"""Licence scans: which paragraphs state a licence, and of which families.

A paragraph is what blank lines set apart; its lines are read as one, so a wrapped notice is whole.
One logistic regression for each family over the sparse set of a paragraph's word bigrams and
trigrams gives the probability that it states that licence, so a paragraph can state several. They
are trained on ways to state a licence (verbs by names, notices with words lost and changed), and on
what only looks like it: names that are denied, compared or told about, other terms, loose words.
Which statements are trained on and which are held out is dealt by whole verb and name, so the
held-out ones are worded as no training row is; a temperature calibrates the probabilities on them.

A family is named if its probability is at least `sure` and the paragraph holds a template of the
family: a name of the licence in full, or half of a notice. A paragraph that some family's
probability puts at even chances or more, but that names none for sure, is `unknown`.

Training runs on the driver over a fixed number of generated rows. Scoring is DataFrame functions
within each row, without a join or a shuffle. Only paragraphs with an anchor word are scored: the
anchors are chosen so that no paragraph without one can hold a template.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of public licences, first the SPDX identifier.
NAMES = {
    "AGPL-3.0": ["AGPL-3.0", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "AGPL version 3", "AGPLv3"],
    "Apache-2.0": ["Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache License v2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-clause BSD license", "New BSD License"],
    "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License 4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution Non-Commercial 4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution Share-Alike 4.0"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero 1.0"],
    "GPL-2.0": ["GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2", "GPL version 2", "GPLv2", "GNU GPL version 2"],
    "GPL-3.0": ["GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3", "GPL version 3", "GPLv3", "GNU GPL version 3"],
    "ISC": ["ISC", "ISC License", "ISC license terms"],
    "LGPL-2.1": ["LGPL-2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL version 2.1"],
    "LGPL-3.0": ["LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "LGPL version 3"],
    "MIT": ["MIT", "MIT License", "MIT-style license", "MIT software license"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
}

#: Notices by which public licences are commonly stated in full.
NOTICES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met: redistributions of source code must retain the above copyright notice."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}

#: Ways to state a licence, and ways to name one without stating it.
STATED = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the terms of the {}.",
    "Made available under the {}.", "This software is available under the {}.", "The code is published under {}.", "Published under the {}.", "Use of this source code is governed by the {}.", "This file is subject to the terms of the {}.",
    "You may use this software under the {}.", "Dedicated to the public under {}.", "This work is licensed under a {} International License.", "SPDX-License-Identifier: {}", "License: {}", "Copyright the authors, {}.",
]
NAMED = [
    "This is not licensed under the {}.", "It was never released under the {}.", "This file is not covered by the {}.", "Not available under {}.", "It is no longer distributed under the terms of the {}.", "This work is not licensed under the {}.",
    "The project cannot be licensed under {}.", "Neither this nor that is licensed under the {}.", "A history of the {} and its authors.", "Compare the {} with other licenses.", "Unlike the {} ours asks for a fee.", "What does the {} say about patents?",
    "Made not available under the {}.", "It is not published under {}.", "Use is not governed by the {}.",
]
OTHERS = [
    "All rights reserved.", "Copyright by the authors.", "See the terms of use of this site.", "The license of the driver was released in the version of the year.", "The public library is open to any person free of charge.",
    "This work was subject to the following conditions.", "The general public may use this file in the source of the project.", "A new version of the program was released under the direction of the foundation.", "Licensed under our own terms, ask for a copy.",
    "Permission is granted to enter the park with or without a fee.", "The software license expires next year.", "This license covers fishing in the lake and its rivers.",
]


#: Words of notices that prose is full of, and that say nothing of a licence.
COMMON = set("a above all and any are as at be by can copy fee file following for from have if in is it may met must no not of on one or other person source terms that the this to under use v with without you".split())


@dataclass(frozen=True)
class Licences:
    sure: float = 0.8  # calibrated probability from which a family is named
    notice: float = 0.5  # share of a notice's n-grams that confirms it
    variants: int = 3  # generated rows for each wording, and for each notice ten times as many
    steps: int = 400
    seed: int = 3


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower().replace("licence", "license"))


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class Trained:
    families: list[str]
    features: list[str]
    weights: np.ndarray  # [feature, family]
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, list[str], int]]  # family, n-grams, how many of them confirm
    anchors: list[str]
    held_out: float  # share of held-out paragraphs of which every family is told right


def wordings(rng: np.random.Generator) -> tuple[list[tuple[str, str | None]], list[tuple[str, str | None]]]:
    """(text, family) of all wordings, to train on and held out: a third of the verbs meets a third of the names only there."""
    train, held = [], []
    for verbs, stated in ((STATED, True), (NAMED, False)):
        for i, verb in enumerate(verbs):
            for family, names in NAMES.items():
                for j, name in enumerate(names):
                    if len(words_of(name)) > 1 or "SPDX" in verb or verb.startswith("License:"):
                        (held if (i + j) % 3 == 2 else train).append((verb.format(name), family if stated else None))
    return train, held


@lru_cache(maxsize=4)
def train(rules: Licences = Licences()) -> Trained:
    rng = np.random.default_rng(rules.seed)
    families = list(NAMES)
    taught, kept_back = wordings(rng)
    notices = [(t, f) for f, some in NOTICES.items() for t in some]
    # What a statement says in grams of its own; names are templates by themselves.
    features = sorted(set().union(*(grams(words_of(t)) for t, _ in [*taught, *notices, *((x, None) for x in OTHERS)])))
    index = {f: i for i, f in enumerate(features)}
    common = sorted({w for t, _ in [*taught, *notices] for w in words_of(t)} | {w for t in OTHERS for w in words_of(t)})
    filler = lambda: [f"x{rng.integers(1000)}" for _ in range(rng.integers(0, 6))]

    def rows(some, repeats) -> tuple[list[list[int]], np.ndarray]:
        x, y = [], []

        def add(words, *stated):
            x.append([index[g] for g in grams(words) if g in index])
            y.append([f in stated for f in families])

        for text, family in some:
            for _ in range(repeats):
                add(filler() + words_of(text) + filler(), family)
            other, second = some[rng.integers(len(some))]
            if family and second:
                add(words_of(text) + filler() + words_of(other) + filler(), family, second)
        for text, family in notices:  # words lost and changed
            for _ in range(10 * repeats):
                add(filler() + [common[rng.integers(len(common))] if rng.random() < 0.03 else w for w in words_of(text) if rng.random() > 0.03] + filler(), family)
        for text in OTHERS:
            for _ in range(4 * repeats):
                add(filler() + words_of(text) + filler(), None)
        for _ in range(100 * repeats):  # the notices' own words, in no order
            add([common[i] for i in rng.integers(len(common), size=rng.integers(1, 30))], None)
        return x, np.array(y, float)

    def scores(x, w, bias):
        return np.stack([w[i].sum(axis=0) for i in x]) + bias

    (x, y), (hx, hy) = rows(taught, rules.variants), rows(kept_back, 1)
    sizes = np.array([len(i) for i in x])
    flat, row = np.concatenate([np.array(i, np.int64) for i in x]), np.repeat(np.arange(len(x)), sizes)
    dense = np.zeros((len(x), len(features)), np.float32)
    dense[row, flat] = 1
    w, bias = np.zeros((len(features), len(families)), np.float32), np.full(len(families), -2.0, np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(rules.steps):
        p = 1 / (1 + np.exp(-np.clip(dense @ w + bias, -30, 30)))
        error = ((p - y) / len(x)).astype(np.float32)
        speed_w = 0.9 * speed_w - 12.0 * (dense.T @ error + np.float32(1e-5) * w)
        speed_b = 0.9 * speed_b - 12.0 * error.sum(axis=0)
        w, bias = w + speed_w, bias + speed_b
    held = np.clip(scores(hx, w, bias), -60, 60)

    def surprise(t):
        p = np.clip(1 / (1 + np.exp(-held / t)), 1e-9, 1 - 1e-9)
        return -(hy * np.log(p) + (1 - hy) * np.log(1 - p)).mean()

    temperature = float(min(np.geomspace(0.25, 4, 41), key=surprise))
    right = ((held > 0) == (hy > 0)).all(axis=1)
    templates = []
    for family, names in NAMES.items():
        for name in names:
            own = words_of(name) if len(words_of(name)) > 1 else ["license", "identifier", *words_of(name)]
            templates.append((family, sorted(grams(own)), len(grams(own))))
            if len(words_of(name)) == 1:
                templates.append((family, [f"license {words_of(name)[0]}"], 1))
    templates += [(f, sorted(grams(words_of(t))), int(np.ceil(rules.notice * len(grams(words_of(t)))))) for t, f in notices]
    # Words that, taken away, leave no template enough grams: the most needed first.
    anchors: list[str] = []
    left = [(set(g), need) for _, g, need in templates]
    while left:
        counts: dict[str, int] = {}
        for g, _ in left:
            for word in {x for y in g for x in y.split()}:
                counts[word] = counts.get(word, 0) + (word not in COMMON and not word.isdigit())
        anchors.append(max(sorted(counts), key=lambda k: counts[k]))
        left = [(rest, need) for g, need in left for rest in [{y for y in g if anchors[-1] not in y.split()}] if len(rest) >= need]
    return Trained(families, features, np.round(w.astype(float), 3), np.round(bias.astype(float), 3), temperature, templates, anchors, float(right.mean()))


def scored_paragraphs(text: Column, rules: Licences = Licences()) -> dict[str, Column | object]:
    """Columns to add in turn: the paragraphs with an anchor, their n-grams, each family's logit, the families named."""
    model = train(rules)
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    features = constant(model.features, "array<string>")
    weights = constant(dict(zip(model.features, model.weights.tolist(), strict=True)), "map<string,array<double>>")
    start = constant(model.bias.tolist(), "array<double>")
    near = constant(sorted({g for _, some, _ in model.templates for g in some} - set(model.features)), "array<string>")
    templates = constant([{"family": f, "grams": g, "need": k} for f, g, k in model.templates], "array<struct<family:string,grams:array<string>,need:int>>")
    anchor = r"\b(" + "|".join(sorted(model.anchors + [a.replace("license", "licence") for a in model.anchors if "license" in a])) + r")\b"

    def gram_set(block: Column) -> Column:
        w = F.filter(F.split(F.regexp_replace(block, "licence", "license"), "[^a-z0-9]+"), lambda x: x != "")
        return F.transform(F.array(w), lambda v: F.array_union(F.zip_with(v, F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), F.zip_with(F.zip_with(v, F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), F.slice(v, 3, F.greatest(F.size(v), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))))[0]

    probability = lambda z: 1 / (1 + F.exp(-z / F.lit(model.temperature)))
    named = lambda p: F.array_sort(F.array_distinct(F.transform(F.filter(templates, lambda t: (F.size(F.array_intersect(t["grams"], p["seen"])) >= t["need"]) & (probability(F.element_at(p["z"], F.array_position(constant(model.families, "array<string>"), t["family"]).cast("int"))) >= rules.sure)), lambda t: t["family"])))
    return {
        "blocks": F.filter(F.split(F.lower(text), r"\n[ \t\r]*\n"), lambda b: b.rlike(anchor)),
        "grams": F.transform("blocks", lambda b: F.array_intersect(gram_set(b), F.array_union(features, near))),
        "scored": F.transform("grams", lambda g: F.struct(g.alias("seen"), F.aggregate(F.array_intersect(g, features), start, lambda acc, x: F.zip_with(acc, F.element_at(weights, x), lambda a, b: a + b)).alias("z"))),
        "named": F.transform("scored", lambda p: F.struct(named(p).alias("families"), probability(F.array_max(p["z"])).alias("probability"))),
    }


def scan_licenses(docs: DataFrame, rules: Licences = Licences()) -> DataFrame:
    """doc_id, n_paragraphs, licenses (families found, sorted), n_licensed, n_unknown, probability for each row of docs.

    n_paragraphs counts the paragraphs with anything but white space (null text: 0); n_licensed those
    that name a family, n_unknown those like a statement but of no family for sure; probability is the
    highest of a paragraph that names one, null without. Families that tie are all named if each is
    sure. Rows stand for themselves, repeated or not; other columns of docs are not looked at.
    """
    out = docs.select("doc_id", "text")
    for name, column in scored_paragraphs(F.col("text"), rules).items():
        out = out.withColumn(name, column)
    sure = F.filter("named", lambda p: F.size(p["families"]) > 0)
    return out.select(
        "doc_id",
        F.coalesce(F.size(F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda b: b.rlike(r"\S"))), F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("named", lambda p: p["families"])))), F.array().cast("array<string>")).alias("licenses"),
        F.coalesce(F.size(sure), F.lit(0)).cast("long").alias("n_licensed"),
        F.coalesce(F.size(F.filter("named", lambda p: (F.size(p["families"]) == 0) & (p["probability"] >= 0.5))), F.lit(0)).cast("long").alias("n_unknown"),
        F.round(F.array_max(F.transform(sure, lambda p: p["probability"])), 6).alias("probability"),
    )
