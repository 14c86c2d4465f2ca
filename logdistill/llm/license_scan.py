"""Licence scans by a trained paragraph classifier, with DataFrame functions.

A softmax regression over sparse word n-grams (one and two words) is fitted on
the driver from the notices below, a bounded labelled sample, and from sentences
that aren't notices. It has a class ``unknown``. A temperature fitted on ``HELD``,
sentences that aren't fitted on, calibrates its probabilities.

A paragraph is a run of lines without a blank one between them; its lines are
joined, so wraps don't matter. A notice may be a small part of a paragraph, so
for each family the paragraph is cut where over ``GAP`` words in a row start no
word pair of the family's templates, and each part gives the span in which such
pairs outnumber the others by most. Only such spans can be confirmed, whatever
their words: no word list stands before the classifier. A span is a notice if the
classifier names that family with enough probability and enough of the span's
n-grams stand in the family's templates. Of overlapping notices, taken in text
order, the one with more template n-grams over others stays, of equal ones the
earlier.

All of it is row-local: vocabulary and weights are constants of the plan, bounded
by the sample, so there is no join, no shuffle and no skew.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.secret_entropy import let

#: Labelled notices by family, fitted on and compared with.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
    ],
    "mit": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This software is licensed under the MIT license.",
        "Distributed under the terms of the MIT License.",
        "The code is licensed under MIT.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2.",
        "This code is under GPLv3.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Licensed under LGPLv2.1 or LGPLv3.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under MPLv2.",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Content is available under Creative Commons Attribution-ShareAlike.",
        "Text is available under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 license.",
        "Content is available under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 1.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission.",
        "This document is confidential and proprietary.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Sentences that use such words without being notices.
OTHERS = [
    "He renewed his driving license at the office in town.",
    "The copyright page of the book was torn.",
    "She gave them permission to leave early.",
    "The software was slow and the version was old.",
    "A license fee is due each year in the city.",
    "The public can use the source of the river freely.",
    "Work on the general plan will start under the new mayor.",
    "The terms of the sale were read to the person in charge.",
    "They met the conditions of the contest without notice.",
    "Free software is discussed in this chapter of the report.",
    "The library is open to the public on Sunday.",
    "All students reserved their seats for the show.",
    "Their rights were restored by the court.",
    "The MIT campus is near the river.",
    "The Apache helicopter landed in the field.",
    "Creative work is common in schools.",
    "The international version of the song came later.",
    "A copy of the file was lost with the documentation.",
    "The warranty of the car has expired.",
    "Mozilla and other firms sent people to the talk.",
    "You can see the end of the street.",
    "You may use the door of the house or the gate.",
    "This is the name of the holder and the name of the file.",
    "It is in the source and in the code of the program.",
    "The copy of the license is in the hall with the other papers.",
    "Of the license and a copy of the license nothing is known.",
    "The work is done by the people of the town and by any means they have.",
    "At any time and for any purpose it is free to the public.",
    "This document is about the following and the above.",
    "Available at the end of the year or in writing.",
    "It was agreed to in writing by the two sides.",
    "No part of this was known to the public.",
    "As published by the paper in the later version.",
    "Under the terms of the treaty the land was sold.",
    "The terms of the license are not known to him.",
    "The eclipse was seen by the public of the town.",
    "Subject to the terms of the lease, you may leave.",
    "She holds the rights to the film and to the book.",
    "Either of the two or any of the other.",
    "All copies of the book were sold with or without a cover.",
    "The car is licensed under his name.",
    "He was licensed under the old law of the land.",
    "It was released under the old name and is licensed under a new one.",
    "The film was released under the name of the star.",
    "The doctor is licensed in the state.",
    "This document is old.",
    "This document is a report on the work of the town.",
    "This document is long, and no part of this is new.",
    "No part of this city was spared.",
    "With or without you.",
    "They came with or without their friends.",
    "It is open to all with or without a ticket.",
]
#: Held out for calibration and accuracy: (family or unknown, sentence). None is fitted on.
HELD = [
    ("apache", "The source is available under the Apache License, Version 2.0, see the file LICENSE."),
    ("apache", "This library is distributed under the Apache 2.0 license."),
    ("mit", "This project is released under the terms of the MIT license."),
    ("mit", "Licensed under the MIT License, see LICENSE for details."),
    ("gpl", "This tool is licensed under the GNU General Public License version 2 or any later version."),
    ("gpl", "Released under the GPL, version 3 or later."),
    ("lgpl", "Distributed under the terms of the GNU Lesser General Public License."),
    ("bsd", "Licensed under the BSD 3-Clause license."),
    ("bsd", "Use of this file is governed by a BSD-style license that can be found in the source."),
    ("mpl", "This file is subject to the Mozilla Public License version 2.0."),
    ("cc", "The pictures are licensed under a Creative Commons Attribution license."),
    ("cc", "The text is available under CC BY-SA."),
    ("isc", "This module is released under the ISC license."),
    ("epl", "The plugin is made available under the terms of the Eclipse Public License."),
    ("unlicense", "The script is free and unencumbered software in the public domain."),
    ("proprietary", "Copyright 2019 by the publisher, all rights reserved."),
    ("proprietary", "No part of this book may be reproduced without written permission."),
    ("unknown", "The license of the driver was taken away by the court."),
    ("unknown", "A copy of the book is in the public library."),
    ("unknown", "The version of the report that was published is free of errors."),
    ("unknown", "He was granted permission to use the hall without a fee."),
    ("unknown", "The terms of the agreement were not met by either side."),
    ("unknown", "They modified the program of the concert at a later date."),
    ("unknown", "The public domain of the town includes the park."),
    ("unknown", "The students of the institute reserved all rooms."),
    ("unknown", "You may obtain tickets at the office or in writing."),
    ("unknown", "Subject to approval by the board, the work may begin."),
]
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
#: Bounds on the labelled sample: variants of each sentence, and steps of the fit.
VARIANTS, STEPS, RATE, DECAY = 12, 400, 4.0, 1e-4
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
MIN_PROBABILITY = 0.5
MIN_SHARED = 0.5
#: Three words at least: "mit" is also a German word. Shorter notices are these.
MIN_GRAMS = 5
SHORT = [f"{name} {word}" for name in ("mit", "apache", "bsd", "gpl", "lgpl", "mpl", "isc") for word in ("license", "licence")]
#: Words in a row that start no word pair of the family, beyond which a paragraph is cut.
GAP = 6
WORD = r"[a-z0-9]+"
#: A version written into a name ("GPLv3") is a word of its own.
VERSIONED = r"\b(l?gpl|mpl)v?([0-9])"
PARAGRAPH = r"\n[ \t\x0B\f\r]*\n"
#: Weights and biases are whole numbers of this part, so that sums don't depend on their order.
UNIT = 1e6


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub(VERSIONED, r"\1 \2", text.lower(), flags=re.ASCII), re.ASCII)


def ngrams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


class Classifier:
    """weights: n-gram -> a whole number per family; a text's score is (bias + sum of weights / sqrt(its number of n-grams)) / UNIT."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        rows = []
        for k, family in enumerate(FAMILIES):
            for sentence in TEMPLATES.get(family, OTHERS):
                words = words_of(sentence)
                for v in range(VARIANTS):
                    least = max(1, (len(words) + 1) // 2) if family == UNKNOWN else min(len(words), max(6, len(words) // 3))
                    n = len(words) if v == 0 else int(rng.integers(least, len(words) + 1))
                    at = int(rng.integers(0, len(words) - n + 1))
                    rows.append((ngrams(words[at : at + n]), k))
        held = [(ngrams(words_of(s)), FAMILIES.index(f)) for f, s in HELD]
        self.vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(g for g, _ in rows))))}
        x, y = self._matrix(rows)
        w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
        b[-1] = 1.0
        target = np.eye(len(FAMILIES))[y]
        for _ in range(STEPS):
            g = (self._softmax(x @ w + b) - target) / len(y)
            w -= RATE * (x.T @ g + DECAY * w)
            b -= 0.1 * RATE * g.sum(axis=0)
        hx, hy = self._matrix(held)
        z = hx @ w + b
        losses = {t: -np.log(self._softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in TEMPERATURES}
        t = min(losses, key=losses.get)
        self.temperature, self.held_loss = t, losses
        self.weights, self.bias = (np.rint(v / t * UNIT).astype(np.int64) for v in (w, b))
        self.templates = {f: set().union(*(ngrams(words_of(s)) for s in TEMPLATES[f])) for f in TEMPLATES}
        self.pairs = {f: sorted(g for g in grams if " " in g) for f, grams in self.templates.items()}
        self.accuracy = float((z.argmax(axis=1) == hy).mean())

    def _matrix(self, rows):
        x = np.zeros((len(rows), len(self.vocabulary)))
        for i, (grams, _) in enumerate(rows):
            for g in grams:
                if g in self.vocabulary:
                    x[i, self.vocabulary[g]] = 1 / np.sqrt(len(grams))
        return x, np.array([k for _, k in rows])

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def classify(self, words: list[str]) -> tuple[str, float, float]:
        """Family, probability and share of n-grams in its templates: what the DataFrame path computes."""
        grams = ngrams(words)
        if not grams:
            return UNKNOWN, 1.0, 0.0
        total = np.sum([self.weights[self.vocabulary[g]] for g in grams if g in self.vocabulary] or [np.zeros_like(self.bias)], axis=0)
        p = self._softmax(((self.bias + total / np.sqrt(len(grams))) / UNIT)[None, :])[0]
        k = int(p.argmax())
        return FAMILIES[k], float(p[k]), len(grams & self.templates.get(FAMILIES[k], set())) / len(grams)


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def _constant(value: list, kind: str) -> Column:
    """A literal of nested lists; folded into a constant when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), VERSIONED, "$1 $2"), F.lit(WORD), F.lit(0))


def _grams(w: Column) -> Column:
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))


SPAN = "array<struct<start:int,end:int>>"


def _densest(hits: Column) -> Column:
    """start and end of the span of a family's pairs in which they outnumber the other pairs by most; the first of equal ones. ``hits``: where the pairs start, in order, one at least."""
    first = F.element_at(hits, 1)
    state = F.struct(F.lit(1).alias("k"), (F.lit(2) - first).alias("low"), first.alias("at"), F.lit(0).alias("best"), first.alias("start"), first.alias("last"))

    def step(s: Column, h: Column) -> Column:
        # 2 k - h of the k-th hit grows by one with a hit and falls by one with each pair between.
        level = 2 * s["k"] - h
        lower = level < s["low"]
        low, at = F.when(lower, level).otherwise(s["low"]), F.when(lower, h).otherwise(s["at"])
        more = level - low > s["best"]
        return F.struct(
            (s["k"] + 1).alias("k"), low.alias("low"), at.alias("at"), F.when(more, level - low).otherwise(s["best"]).alias("best"),
            F.when(more, at).otherwise(s["start"]).alias("start"), F.when(more, h).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(hits, state, step, lambda s: F.struct(s["start"].alias("start"), (s["last"] + 2).alias("end")))


def _parts(hits: Column) -> Column:
    """The hits in runs; a run ends before a gap of over GAP."""
    far = lambda a, b: b - a > GAP + 1
    n = F.size(hits)
    numbered = F.sequence(F.lit(1), n)
    starts = F.filter(numbered, lambda i: (i == 1) | far(F.get(hits, i - 2), F.get(hits, i - 1)))
    ends = F.filter(numbered, lambda i: (i == n) | far(F.get(hits, i - 1), F.get(hits, i)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(hits, a, b - a + 1))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<array<int>>"))


def _spans(words: Column) -> Column:
    """The spans of a paragraph that may be notices: array<struct<family, start, end, n, shared, grams>>; start and end count words."""
    c = classifier()
    every = sorted(set().union(*c.pairs.values()))
    hits = F.array_compact(
        F.transform(words, lambda a, i: F.when(F.concat_ws(" ", a, F.get(words, i + 1)).isin(every), F.struct(i.alias("i"), F.concat_ws(" ", a, F.get(words, i + 1)).alias("pair"))))
    )

    def of_family(family: str, hits: Column) -> Column:
        mine = F.transform(F.filter(hits, lambda h: h["pair"].isin(c.pairs[family])), lambda h: h["i"])
        spans = F.transform(let(mine, _parts), _densest)
        known = sorted(c.templates[family])

        def told(s: Column) -> Column:
            grams = _grams(F.slice(words, s["start"] + 1, s["end"] - s["start"]))
            return let(grams, lambda g: F.struct(
                F.lit(family).alias("family"), s["start"].alias("start"), s["end"].alias("end"), F.size(g).alias("n"),
                F.size(F.filter(g, lambda x: x.isin(known))).alias("shared"), g.alias("grams"),
            ))

        # The share counts before the classifier does: it is cheaper.
        return F.filter(F.transform(spans, told), lambda s: s["shared"] >= MIN_SHARED * s["n"])

    return let(hits, lambda h: F.concat(*(of_family(f, h) for f in TEMPLATES)))


def _told(spans: Column, vocabulary: Column, weights: Column) -> Column:
    """For each span: family, start, end, n, shared, probability of that family, and whether it is confirmed."""
    c = classifier()
    bias = [int(b) for b in c.bias]

    def scores(s: Column) -> Column:
        at = F.filter(F.transform(s["grams"], lambda g: F.array_position(vocabulary, g).cast("int")), lambda p: p > 0)
        root = F.sqrt(s["n"].cast("double"))

        def score(at: Column, k: int) -> Column:
            total = F.aggregate(at, F.lit(0).cast("long"), lambda a, p: a + F.get(F.get(weights, F.lit(k)), p - 1))
            return (F.lit(bias[k]) + total / root) / UNIT

        return let(at, lambda at: F.array(*(score(at, k) for k in range(len(bias)))))

    def named(s: Column, z: Column) -> Column:
        top = F.array_max(z)
        family = F.element_at(F.array(*(F.lit(f) for f in FAMILIES)), F.array_position(z, top).cast("int"))
        p = 1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        long_enough = (s["n"] >= MIN_GRAMS) | F.array_join(F.filter(s["grams"], lambda g: g.contains(" ")), ",").isin(SHORT)
        return F.struct(
            s["family"].alias("family"), s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), s["shared"].alias("shared"), p.alias("probability"),
            ((family == s["family"]) & (p >= MIN_PROBABILITY) & long_enough).alias("confirmed"),
        )

    return F.transform(spans, lambda s: let(scores(s), lambda z: named(s, z)))


NOTICE = "array<struct<start:int,end:int,net:int,family:string>>"


def _chosen(told: Column) -> Column:
    """Confirmed spans that don't overlap, in text order."""
    good = F.transform(
        F.filter(told, lambda s: s["confirmed"]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (2 * s["shared"] - s["n"]).alias("net"), s["family"].alias("family")),
    )

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        apart = (F.size(kept) == 0) | F.coalesce(F.get(kept, F.size(kept) - 1)["end"] <= x["start"], F.lit(True))
        return F.when(apart, F.concat(kept, F.array(x))).when(last["net"] >= x["net"], kept).otherwise(
            F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))
        )

    return F.aggregate(F.array_sort(good), F.array().cast(NOTICE), step)


def find_notices(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates and notices of each row of ``docs(doc_id, text)``: array<struct<paragraph, start, end, family>>, in text order; start and end count words of the paragraph, the end exclusive.

    Null and empty texts have none. Every row is read on its own, so nulls in
    other columns, repeats and extra columns change nothing.
    """
    c = classifier()
    vocabulary = _constant(list(c.vocabulary), "array<string>")
    weights = _constant(c.weights.T.tolist(), "array<array<bigint>>")

    def of_paragraph(text: Column, number: Column) -> Column:
        spans = let(_words(text), _spans)
        found = let(spans, lambda s: F.struct(F.size(s).alias("n"), _chosen(_told(s, vocabulary, weights)).alias("all")))
        return let(found, lambda f: F.struct(
            f["n"].alias("n"),
            F.transform(f["all"], lambda x: F.struct(number.alias("paragraph"), x["start"].alias("start"), x["end"].alias("end"), x["family"].alias("family"))).alias("all"),
        ))

    each = F.transform(F.split(F.coalesce("text", F.lit("")), PARAGRAPH), of_paragraph)
    out = let(each, lambda ps: F.struct(
        F.aggregate(ps, F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_candidates"), F.flatten(F.transform(ps, lambda p: p["all"])).alias("notices"),
    ))
    return docs.select("doc_id", out.alias("found")).select("doc_id", "found.n_candidates", "found.notices")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: n_candidates (spans that the classifier reads), n_licenses (notices that don't overlap), licenses (families in order, comma-joined).

    Null and empty texts have none; repeated ids come back as often; extra columns
    are ignored; an empty table gives an empty result.
    """
    x = F.col("notices")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda n: n["family"]))), ",")
    return find_notices(docs).select("doc_id", "n_candidates", F.size(x).cast("long").alias("n_licenses"), families.alias("licenses"))
