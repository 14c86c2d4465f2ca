"""Licence scans against a plain reading of the rule, over all paragraphs."""

import os
import random
import re

import pytest

from logdistill.llm import license_scan as ls

from helpers import corpus, make, rows, words

SF = "/root/testdata/sf0.01"


def plain(text):
    """Families of a text's notices, by the module's rule."""
    c, out, read = ls.classifier(), [], 0
    for paragraph in re.split(ls.PARAGRAPH, text or ""):
        ws, found = ls.words_of(paragraph), []
        pairs = [f"{a} {b}" for a, b in zip(ws, ws[1:])]
        for family in ls.TEMPLATES:
            known, runs = set(c.pairs[family]), []
            for i, p in enumerate(pairs):
                if p in known:
                    if runs and i - runs[-1][-1] <= ls.GAP + 1:
                        runs[-1].append(i)
                    else:
                        runs.append([i])
            for run in runs:
                inside = set(run)
                best = max(((sum(1 if p in inside else -1 for p in range(a, b + 1)), -b, -a, a, b) for a in run for b in run if a <= b), default=None)
                a, b = best[3:]
                span = ws[a : b + 2]
                grams = ls.ngrams(span)
                shared = len(grams & c.templates[family])
                if shared < ls.MIN_SHARED * len(grams):
                    continue
                read += 1
                named, p, _ = c.classify(span)
                if named == family and p >= ls.MIN_PROBABILITY and (len(grams) >= ls.MIN_GRAMS or " ".join(span) in ls.SHORT):
                    found.append((a, b + 2, 2 * shared - len(grams), family))
        kept = []
        for x in sorted(found):
            if not kept or kept[-1][1] <= x[0]:
                kept.append(x)
            elif kept[-1][2] < x[2]:
                kept[-1] = x
        out += [x[3] for x in kept]
    return read, out


def told(spark, texts):
    return [(r["n_candidates"], r["n_licenses"], r["licenses"]) for _, r in sorted(rows(ls.scan(make(spark, texts))).items())]


def check(spark, texts):
    want = [(n, len(f), ",".join(sorted(set(f)))) for n, f in map(plain, texts)]
    assert told(spark, texts) == want
    return want


def test_held_out_sentences_are_not_fitted_on():
    c = ls.classifier()
    assert not {s for _, s in ls.HELD} & {s for x in (*ls.TEMPLATES.values(), ls.OTHERS) for s in x}
    assert c.accuracy >= 0.9 and c.held_loss[c.temperature] <= 0.2


def test_parts_of_notices_without_any_key_word(spark):
    texts = {
        "bsd": "modification, are permitted provided that the following conditions are met",
        "mit": "obtaining a copy of this software and associated documentation",
        "apache": "you may not use this file except in compliance",
        "gpl": "under the terms of version 3 or any later version as published by the Free Software Foundation",
        "cc": "Content is available under CC BY",
        "isc": "Released under the ISC License.",
        "epl": "Licensed under the Eclipse Public License, version 2.0",
        "unlicense": "This is free and unencumbered software released into the public domain.",
    }
    assert [x[2] for x in check(spark, list(texts.values()))] == list(texts)


def test_every_template_anywhere_in_a_paragraph(spark):
    rng, texts, want = random.Random(8), [], []
    for family, sentences in ls.TEMPLATES.items():
        for s in sentences:
            for before, after in ((0, 60), (30, 30), (60, 0)):
                wrapped = re.sub(r"((?:\S+ ){4})", r"\1\n", s)
                texts += [f"{words(rng, before)} {s} {words(rng, after)}", f"{words(rng, before)}\n{wrapped}\n{words(rng, after)}"]
                want += [family, family]
    got = check(spark, texts)
    missed = [(t, g) for t, g, w in zip(texts, got, want) if w not in g[2].split(",")]
    assert not missed


def test_prose_is_left_alone(spark):
    rng = random.Random(3)
    texts = [*ls.OTHERS, *(f"{words(rng, 30)} {s} {words(rng, 30)}" for s in ls.OTHERS)]
    assert all(x[1] == 0 for x in check(spark, texts))


def test_held_out_accuracy_of_the_whole_rule(spark):
    """Spans, not only sentences: what the fit hasn't seen is found or left alone, nine times of ten."""
    got = check(spark, [s for _, s in ls.HELD])
    right = [(family == ls.UNKNOWN and not found) or family in found.split(",") for (family, _), (_, _, found) in zip(ls.HELD, got)]
    assert sum(right) >= 0.9 * len(right)


def test_several_notices_versions_and_short_names(spark):
    long = words(random.Random(2), 30)
    both = f"{long} Licensed under the Apache License, Version 2.0. {long} All rights reserved.\n\n{long}\nReleased under the MIT License."
    texts = [both, "This code is under GPLv3.", "Licensed under LGPLv2.1", "Licensed under MPLv2", "MIT License\n\nx", "mit nicht", "ungplv3 text here and there"]
    got = check(spark, texts)
    assert [x[2] for x in got] == ["apache,mit,proprietary", "gpl", "lgpl", "mpl", "mit", "", ""] and got[0][1] == 3


def test_edges(spark):
    texts = [*corpus(), None, "", "\n\n\n", "word", "All rights reserved. " * 3000, "the end of the " * 20_000]
    check(spark, texts[:-2])
    got = told(spark, texts)
    assert got[-2][2] == "proprietary" and got[-1][1:] == (0, "")
    assert ls.scan(make(spark, [])).collect() == []
    twice = ls.scan(make(spark, ["MIT License", "MIT License"], ids=[None, None])).collect()
    assert [(r.doc_id, r.licenses) for r in twice] == [(None, "mit")] * 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_candidates, r.n_licenses, r.licenses) for r in ls.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        n, f = plain(r.text)
        assert got[r.doc_id] == (n, len(f), ",".join(sorted(set(f))))
