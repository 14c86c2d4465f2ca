"""Components of near-duplicates against all pairs that share a shingle."""

import collections
import os
import random

import numpy as np
import pytest

from logdistill.llm import order_minhash as om
from logdistill.llm.common import components

from helpers import corpus, make, rows, words

SF = "/root/testdata/sf0.01"


def plain(texts):
    """Smallest index of each text's component, every pair that shares a shingle tried."""
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, links = collections.defaultdict(list), 0
    for i, t in enumerate(texts):
        grams = set(om.shingles(om.word_codes(t)).tolist())
        near = collections.Counter(j for g in grams for j in index[g])
        for j, both in near.items():
            if om.DEN * both >= om.NUM * len(grams) and om.linked(t, texts[j]):
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in grams:
            index[g].append(i)
    return [root(i) for i in range(len(texts))], links


def check(spark, texts):
    got = rows(om.near_duplicates(make(spark, texts)))
    want, links = plain(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got.values())
    return want, links


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


def test_small_corpus(spark):
    want, _ = check(spark, corpus())
    assert want[5] == 0 and want[6] == 1 and want[13] == 13


def test_repeated_passages(spark):
    rng, texts = random.Random(12), []
    for _ in range(100):
        a = words(rng, 300).split()
        texts += [" ".join(a), " ".join(a[100:247] + a)]
    want, links = check(spark, texts)
    assert links == 100 and want == [i - i % 2 for i in range(200)]


def test_few_distinct_shingles(spark):
    """Short texts, and texts that repeat a few words in another number."""
    rng, texts = random.Random(3), []
    for _ in range(150):
        a = words(rng, rng.randint(5, 14)).split()
        texts += [" ".join(a), " ".join(a + words(rng, 1).split()), " ".join(a * 3), " ".join(a * 4 + a[:2])]
    assert check(spark, texts)[1] > 200


def test_edited_copies(spark):
    """Substitutions, insertions and deletions about the threshold: no link of 1,000 is lost."""
    rng, texts = random.Random(5), []
    for _ in range(250):
        a = words(rng, rng.choice([40, 100, 300])).split()
        texts.append(" ".join(a))
        for edits in (1, len(a) // 60, len(a) // 45):
            b = list(a)
            for _ in range(edits):
                at = rng.randrange(len(b))
                rng.choice([lambda: b.__setitem__(at, "new"), lambda: b.insert(at, "more"), lambda: b.pop(at)])()
            texts.append(" ".join(b))
    assert check(spark, texts)[1] > 500


@pytest.mark.parametrize("large", [8, 80])
def test_large_buckets(spark, monkeypatch, large):
    """A passage that many texts share, with small blocks: buckets of two, and blocks of those."""
    monkeypatch.setattr(om, "BLOCK", 8)
    monkeypatch.setattr(om, "LARGE", large)
    rng = random.Random(7)
    shared, texts = words(rng, 60), []
    for k in range(60):
        own = words(rng, 90 if k % 3 else 12)
        texts += [f"{shared} {own}", f"{shared} {own} end"]
    assert check(spark, texts)[1] >= 60


@pytest.mark.parametrize("large", [1, 10**6])
def test_one_bucket(spark, monkeypatch, large):
    """Linked texts that share one bucket, with others: they are found whatever a large bucket is."""
    monkeypatch.setattr(om, "LARGE", large)
    texts = []
    for seed in (469512, 55341, 86751, 259701, 261376, 263914, 241535):
        rng = random.Random(seed)
        a = words(rng, 104).split()
        at = rng.randrange(4, 93)
        b = a[:at] + words(rng, 7).split() + a[at + 7 :]
        x, y = (om.sketch(om.shingles(om.word_codes(" ".join(t)))) for t in (a, b))
        same = np.flatnonzero((x == y) & (x != 0))
        assert len(same) == om.AGREE and sum(same < om.BUCKETS) == 1
        others = []
        while len(others) < 12:
            start, width = rng.randrange(60), rng.randint(24, 44)
            t = " ".join(a[:start] + words(rng, 6).split() + a[start + width :])
            if om.sketch(om.shingles(om.word_codes(t)))[same[0]] == x[same[0]] and not any(om.linked(t, u) for u in (*others, " ".join(a), " ".join(b))):
                others.append(t)
        texts += [" ".join(a), " ".join(b), *others]
    want, links = check(spark, texts)
    assert links == 7 and want == [i - (i % 14 == 1) for i in range(len(texts))]


def test_repeated_and_null_ids(spark):
    rng = random.Random(2)
    a, b, c = (words(rng, 50) for _ in range(3))
    texts = [a, a, b, c, a + " x", None, "", a, a]
    ids = [1, 1, 1, 2, 3, 4, 4, None, None]
    docs = make(spark, texts, ids=ids)
    got = {(r.doc_id, r.class_id, r.component_id, r.kept) for r in om.near_duplicates(docs).collect()}
    assert got == {(1, 1, 1, True), (2, 2, 2, True), (3, 3, 1, False), (4, 4, 4, True)}
    left = om.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    want = [(1, a), (1, b), (2, c), (4, None), (4, ""), (None, a), (None, a)]
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter(want)
    assert om.near_duplicates(make(spark, [])).collect() == [] and om.drop_near_duplicates(make(spark, [])).collect() == []


def test_edits_within():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                table[i, j] = i + j if not i or not j else table[i - 1, j - 1] if a[i - 1] == b[j - 1] else 1 + min(table[i - 1, j], table[i, j - 1])
        most = rng.randint(0, 10)
        assert om.edits_within(a, b, most) == (table[-1, -1] if table[-1, -1] <= most else None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want, links = plain([t for _, t in data])
    got = rows(om.near_duplicates(docs))
    assert links > 20 and [got[i]["component_id"] for i, _ in data] == [data[k][0] for k in want]
