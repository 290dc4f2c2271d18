"""Licence scans: a trained paragraph classifier whose findings a template comparison confirms.

A paragraph is a run of lines up to a blank one, and each of its lines by itself, so that a notice of one line is found amid prose
and a notice wrapped over lines is found whole. Words leave comment marks behind; a line of marks alone is blank. Where
the word 3-grams of a template that a paragraph of several lines has reach ``COVER``, the shortest run of lines that holds them is classified, so a long
paragraph may hold several notices; a paragraph without any finding is classified as a whole. Features are the word 1- to 3-grams that the training set's licence paragraphs have; a
multinomial logistic regression, kept sparse by a soft threshold after each step, gives each family's probability and that
of the class ``unknown``. Probabilities are calibrated by a temperature fitted on paragraphs held out of training. A
paragraph is a finding if a family, or a set of families that are ``ALIKE``, is likelier than ``THRESHOLD``; of alike families
it is the one whose template covers it best, so that versions are told apart. It is confirmed if at least ``COVER`` of the word
3-grams of one template occur in it, one of those with the version number among them.

Training paragraphs are the families' templates under random edits (dropped words, cut ends, words around them), against
lines of a bounded sample of documents and against statements about rights that name no family. A paragraph without
any learned n-gram is unknown at once, as all its features are zero.

Cases: null and empty texts have no findings; of a text that repeats a paragraph each one is a finding; repeated rows get
the same answer; without documents the classifier learns from the templates alone; other columns play no part,
whatever their names.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_per_class, small_batches, table

# Short notices of public licences, as their publishers recommend or as they are commonly worded.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-SA": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ),
}
#: Statements of the class unknown that share words with the templates.
OTHERS = (
    "All rights reserved.", "Copyright 2020 the authors.", "A driving license is required for this work.", "The public library is free and open to any person.",
    "See the terms and conditions of use.", "Version 3 of the software was released.", "The source code of this program is private.", "You may not copy this file.",
    "Permission is hereby refused to any person who asks for a copy of the notice.", "The general public was free to attend, and the foundation published a version of the terms.",
    "This work is shown under the terms of the lender and is not licensed to others.", "The program is made available in the public library and at the university.",
)
#: Families that share most of their words. Together they must be likely; which of them it is the templates say.
ALIKE = (("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"), ("BSD", "BSD-2-Clause"), ("CC-BY", "CC-BY-NC", "CC-BY-SA", "CC-BY-NC-SA", "CC-BY-ND"))
GROUP = {f: next((g for g in ALIKE if f in g), (f,)) for f in TEMPLATES}
UNKNOWN = "unknown"
#: At most DOCUMENTS documents of at most LONGEST characters give lines of the class unknown, LINES in all.
DOCUMENTS, LONGEST, LINES, COPIES = 200, 20_000, 1500, 30
THRESHOLD, COVER = 0.7, 0.6
WORD = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")
LETTER = re.compile(r"[^\W_]")


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(words: list[str], low: int = 1, high: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)}


def _edits(text: str, rng: random.Random, around: list[str], n: int) -> list[list[str]]:
    out, words = [words_of(text)], words_of(text)
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.06] or words
        kept = kept[: max(3, len(kept) - rng.choice([0, 0, 0, 1, 2]))]
        extra = [rng.choice(around) for _ in range(rng.choice([0, 0, 2, 6]))] if around else []
        out.append(extra + kept if rng.random() < 0.5 else kept + extra)
    return out


def _grams_of(template: str) -> tuple[set[str], set[str]]:
    """(the template's word 3-grams, or its words if it has fewer, those of them that hold a number: a version)."""
    own = words_of(template)
    need = grams(own, min(3, len(own)), min(3, len(own)))
    return need, {g for g in need if any(c.isdigit() for c in g)}


NEED = {f: [_grams_of(t) for t in texts] for f, texts in TEMPLATES.items()}


def cover(words: list[str], family: str) -> float:
    """The largest share of a template's word 3-grams that the paragraph has; a template whose version it lacks gives none."""
    have, best = grams(words), 0.0
    for need, versions in NEED.get(family, ()):
        if not versions or not versions.isdisjoint(have):
            best = max(best, len(need & have) / len(need))
    return best


def _needed() -> tuple[list[tuple[str, int]], dict[tuple[str, ...], list[int]]]:
    """(family, number of distinct grams) of each template, and the templates that have each gram."""
    sizes, of = [], {}
    for family, texts in TEMPLATES.items():
        for own in map(words_of, texts):
            n = min(3, len(own))
            need = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for gram in need:
                of.setdefault(gram, []).append(len(sizes))
            sizes.append((family, len(need)))
    return sizes, of


NEEDED, OF_GRAM = _needed()


def runs(lines: list[tuple[int, list[str]]]) -> list[tuple[str, int, int]]:
    """(family, first, last) of runs of two or more of ``lines`` in which a template reaches COVER, the longest runs first.

    A run is cut as short as COVER allows at its beginning, and takes in the template's further grams at its end.
    """
    words = [w for _, own in lines for w in own]
    at = [k for k, (_, own) in enumerate(lines) for _ in own]
    hits: dict[int, list[tuple[int, int, tuple]]] = {}
    for n in (2, 3):
        own = list(zip(*[words[i:] for i in range(n)], strict=False))
        if not OF_GRAM.keys().isdisjoint(own):
            for k, gram in enumerate(own):
                for t in OF_GRAM.get(gram, ()):
                    hits.setdefault(t, []).append((at[k], at[k + n - 1], gram))
    out = set()
    for t, found in hits.items():
        family, size = NEEDED[t]
        count: Counter = Counter()
        low = high = 0
        while high < len(found):
            count[found[high][2]] += 1
            high += 1
            if len(count) / size < COVER:
                continue
            while count[found[low][2]] > 1:
                count[found[low][2]] -= 1
                low += 1
            while high < len(found) and found[high][2] not in count:
                count[found[high][2]] += 1
                high += 1
            first, last = found[low][0], max(x[1] for x in found[low:high])
            if first < last:
                out.add((family, first, last))
            count.clear()
            low = high
    return sorted(out, key=lambda x: (x[1] - x[2], x))


@dataclass
class Model:
    classes: list[str]
    row: dict[str, int]  # of each n-gram
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def __post_init__(self):
        self.first = {g for g in self.row if " " not in g}
        self.place = {f: i for i, f in enumerate(self.classes)}

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.row[g] for g in grams(words) if g in self.row]
        z = (self.bias + self.weight[at].sum(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judged(self, line: int, words: list[str]) -> tuple[int, str, float, float, bool] | None:
        """(line, family, probability, cover, confirmed) where ``words`` are a finding."""
        if self.first.isdisjoint(words):
            return None
        p = self.probabilities(words)
        k = int(p.argmax())
        if self.classes[k] == UNKNOWN:
            return None
        group = GROUP[self.classes[k]]
        likely = float(sum(p[self.place[f]] for f in group))
        if likely < THRESHOLD:
            return None
        c, _, family = max((cover(words, f), p[self.place[f]], f) for f in group)
        return line, family, likely, c, c >= COVER

    def paragraph(self, lines: list[tuple[int, list[str]]]) -> list[tuple[int, str, float, float, bool]]:
        """The findings of consecutive lines (number, words), in order. A wrapped notice takes the place of what its lines are by themselves."""
        out = [x for i, words in lines if (x := self.judged(i, words))]
        if len(lines) < 2:
            return out
        wrapped: list[tuple[int, int, tuple]] = []
        for family, low, high in runs(lines):
            x = self.judged(lines[low][0], [w for _, words in lines[low : high + 1] for w in words])
            if x and x[1] == family and x[4] and not any(f[1] == family and a <= high and low <= b for a, b, f in wrapped):
                wrapped.append((low, high, x))
        for low, high, x in wrapped:
            inside = {i for i, _ in lines[low : high + 1]}
            out = [y for y in out if y[0] not in inside or (y[4] and y[1] != x[1])]
        out += [x for _, _, x in wrapped]
        if not out and (x := self.judged(lines[0][0], [w for _, words in lines for w in words])):
            out.append(x)
        return sorted(out)

    def findings(self, text: str | None) -> list[tuple[int, str, float, float, bool]]:
        """(line, family, probability, cover, confirmed) of each finding; a wrapped notice has the line it begins on."""
        out, lines, broken = [], [], False
        for i, line in enumerate((text or "").split("\n")):
            if LETTER.search(line):
                words = words_of(line)
                if broken and lines and lines[-1][1] and words:  # a word that a hyphen breaks goes to the line it begins on
                    lines[-1][1][-1] += f"-{words[0]}"
                    words = words[1:]
                lines.append((i, words))
                broken = line.rstrip().endswith("-")
            elif lines:
                out += self.paragraph(lines)
                lines = []
        return out + self.paragraph(lines)


def train(lines: list[str], steps: int = 150, rate: float = 0.5, sparse: float = 2e-4, seed: int = 11) -> Model:
    """``lines`` are paragraphs of documents; those that a template covers are left out."""
    rng = random.Random(seed)
    clean = [w for x in lines if (w := words_of(x)) and max(cover(w, f) for f in TEMPLATES) < 0.3]
    around = [w for x in clean[:200] for w in x[:20]]
    data = [(w, f) for f, texts in TEMPLATES.items() for t in texts for w in _edits(t, rng, around, COPIES)]
    data += [(w, UNKNOWN) for t in OTHERS for w in _edits(t, rng, around, 10)] + [(x, UNKNOWN) for x in clean]
    rng.shuffle(data)
    fit, held = data[len(data) // 5 :], data[: len(data) // 5]
    seen = Counter(g for w, f in fit if f != UNKNOWN for g in grams(w))
    row = {g: i for i, g in enumerate(sorted(g for g, c in seen.items() if c >= 3))}
    classes = [UNKNOWN, *TEMPLATES]

    def matrix(rows):
        x = np.zeros((len(rows), len(row)), np.float32)
        for i, (w, _) in enumerate(rows):
            x[i, [row[g] for g in grams(w) if g in row]] = 1
        return x, np.array([classes.index(f) for _, f in rows])

    x, y = matrix(fit)
    truth = np.eye(len(classes), dtype=np.float32)[y]
    share = 1 / np.bincount(y, minlength=len(classes))[y][:, None] / len(classes)  # each class counts alike
    scale = 1 / np.maximum(x.sum(0), 1)[:, None] ** 0.5
    weight, bias = np.zeros((len(row), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    for _ in range(steps):
        z = x @ weight + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (truth - p) * share
        weight += rate * 20 * scale * (x.T @ wrong)
        weight = np.sign(weight) * np.maximum(np.abs(weight) - sparse, 0)
        bias += rate * wrong.sum(0)
    held_x, held_y = matrix(held)
    z = held_x @ weight + bias

    def loss(t: float) -> float:
        s = z / t - (z / t).max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), held_y] - np.log(np.exp(s).sum(1))).mean()) if len(s) else 0.0

    return Model(classes, row, weight, bias, min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss))


def fit(spark: SparkSession, sf_dir: str) -> Model:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("one"))
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= LONGEST))
    chosen = bounded_per_class(docs.select("doc_id", "one"), "one", "doc_id", DOCUMENTS)
    # At most DOCUMENTS rows of an id.
    rows = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("text").orderBy("doc_id", "text").limit(DOCUMENTS).collect()
    lines = [x for r in rows for x in r["text"].split("\n")]
    return train(random.Random(5).sample(lines, min(LINES, len(lines))))


FOUND = "array<struct<line:int,family:string,probability:double,cover:double,confirmed:boolean>>"


def found(text: Column, model: Model) -> Column:
    """All findings of ``text`` in order, as an array of structs."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("line", "family", "probability", "cover", "confirmed")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in shared.value.findings(t)] for t in texts], dtype=object)

    return scan(text)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, the confirmed families by name, the number of findings, and the first's line."""
    out = table(spark, sf_dir, "documents").select("doc_id", found(F.col("text"), fit(spark, sf_dir)).alias("f"))
    sure = F.filter("f", lambda x: x["confirmed"])
    return out.select(
        "doc_id", F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))).alias("families"),
        F.size("f").cast("long").alias("findings"), F.size(sure).cast("long").alias("confirmed"),
        F.try_element_at(F.transform(sure, lambda x: x["line"]), F.lit(1)).cast("long").alias("first_line"),
    )
