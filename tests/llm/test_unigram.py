"""Segmentations against dynamic programming over all of them, and round trips."""

import math
import random

import numpy as np
import pytest

from logdistill.llm import unigram

from helpers import corpus, make, rows


def ids_of(model, text):
    return np.frombuffer(model.ids_of([text])[0], "<i4").tolist()


def best(text, score, longest):
    table = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - longest), j):
            if text[i:j] in score:
                table[j] = max(table[j], table[i] + score[text[i:j]])
    return table[-1]


def test_optimal_over_random_pieces():
    rng = random.Random(0)
    pieces = [("<unk>", 0.0, "unknown")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    texts = {unigram.MARK, "a", "b"} | {"".join(rng.choice("ab" + unigram.MARK) for _ in range(rng.randint(2, 4))) for _ in range(30)}
    pieces += [(p, -rng.random() * 9, "normal") for p in sorted(texts)]
    m = unigram.Unigram(pieces)
    score = {p: s for p, s, k in pieces if k == "normal"}
    for _ in range(300):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        ids = ids_of(m, t)
        assert abs(sum(m.scores[i] for i in ids) - best((" " + t).replace(" ", unigram.MARK), score, 4)) < 1e-9
        assert m.decode(ids) == t


def test_scores_are_log_probabilities():
    m = unigram.Unigram.load()
    normal = [i for i in range(len(m.scores)) if not m.is_byte[i] and m.texts[i] and m.scores[i] < 0]
    assert abs(sum(math.exp(m.scores[i]) for i in normal) - 1) < 1e-9
    p = np.exp(unigram.log_scores([-1.0, -5.0, -2.0, -2.0]))
    assert abs(p.sum() - 1) < 1e-12 and p[0] > p[2] > p[3] > p[1]
    with pytest.raises(ValueError):
        unigram.Unigram.load(ranked=False)


def test_public_pieces():
    m = unigram.Unigram.load()
    score = {}
    for i, t in enumerate(m.texts):
        if not m.is_byte[i] and m.scores[i] < 0:
            score[t.decode().replace(" ", unigram.MARK)] = m.scores[i]
    longest = max(map(len, score))
    texts = ["The quick brown fox jumps over the lazy dog", "Enoi réeuxpa en vioion de êment", "databases and internationalization", "  two  spaces "]
    for t in texts:
        assert abs(sum(m.scores[i] for i in ids_of(m, t)) - best((" " + t).replace(" ", unigram.MARK), score, longest)) < 1e-9
    assert len(ids_of(m, texts[0])) <= 11


def test_encode_and_decode(spark):
    m = unigram.Unigram.load()
    texts = [*corpus(), "玄 \U0001f600 x", "a " * 50_000, "▁ marker", "\ud800".encode("utf-8", "replace").decode()]
    docs = make(spark, texts).unionByName(make(spark, ["again", "again"], ids=[None, None]))
    encoded = unigram.encode(docs, m)
    got = encoded.collect()
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got) and len(got) == len(texts) + 2
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].ids == [] and by_id[len(corpus())].n_byte_ids > 0
    back = rows(unigram.decode(encoded.where("doc_id is not null"), m))
    assert [back[i]["text"] for i in range(len(texts))] == [(t or "").replace(unigram.MARK, " ") for t in texts]
    nulls = spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.text) for r in unigram.decode(nulls, m).collect()} == {(1, None), (None, "")}
    assert unigram.encode(make(spark, []), m).collect() == [] and unigram.decode(unigram.encode(make(spark, []), m), m).collect() == []
    many = [w for t in corpus() for w in m._words(t)]
    assert [np.frombuffer(b, "<i4").tolist() for b in m.viterbi_many(many)] == [m.viterbi(w) for w in many]
