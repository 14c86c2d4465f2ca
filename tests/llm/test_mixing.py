"""Budgets over a tree, and the documents chosen, against plain Python."""

import collections
import hashlib
import random
from fractions import Fraction

from logdistill.llm import mixing

from helpers import CLASHING, make, words


def fill(total, children):
    """children: (name, supply, weight); given by name. Shortages go round by round."""
    given, left = {}, min(total, sum(s for _, s, _ in children))
    for zero in (False, True):
        rest = [(n, s, w or 1) for n, s, w in children if (w == 0) is zero]
        budget = min(left, sum(s for _, s, _ in rest))
        left -= budget
        while True:
            mass = sum(w for *_, w in rest)
            full = [c for c in rest if c[1] * mass <= budget * c[2]]
            if not full:
                break
            for n, s, _ in full:
                given[n] = s
                budget -= s
            rest = [c for c in rest if c not in full]
        rest.sort(key=lambda c: (Fraction(c[1], c[2]), c[0] is None, c[0] or ""))
        for n, _, w in rest:
            given[n] = budget * w // mass
        for n, *_ in rest[: budget - sum(given[c[0]] for c in rest)]:
            given[n] += 1
    return given


def plain(leaves, share, weights, epochs):
    """leaves: path -> supply; path -> budget."""
    out = {}

    def go(paths, depth, budget):
        if depth == 3:
            out[paths[0]] = budget
            return
        children = collections.defaultdict(list)
        for p in paths:
            children[p[depth]].append(p)
        given = fill(budget, [(n, sum(leaves[p] for p in ps) * epochs, weights[depth].get(n, 1)) for n, ps in children.items()])
        for n, ps in children.items():
            go(ps, depth + 1, given[n])

    if leaves:
        go(list(leaves), 0, int(sum(leaves.values()) * share))
    return out


WEIGHTS = ({"d0": 3, "d1": 0, "d2": 7}, {"en": 5, "fr": 2, "xx": 0}, {"s1": 4, "it's": 2})


def test_budgets(spark):
    for seed, share, epochs in ((1, 0.5, 3), (2, 1.7, 2), (3, 0.01, 1), (4, 5.0, 3)):
        rng = random.Random(seed)
        leaves = {(rng.choice(["d0", "d1", "d2", None]), rng.choice(["en", "fr", "xx", None]), rng.choice(["s1", "it's", "s3", "s4", None])): rng.choice([1, 7, 40, 5000]) for _ in range(60)}
        data = spark.createDataFrame([(*p, s) for p, s in leaves.items()], "domain string, lang string, source string, supply long")
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(data, share, WEIGHTS, epochs).collect()}
        assert got == plain(leaves, share, WEIGHTS, epochs)
        assert sum(got.values()) == min(int(sum(leaves.values()) * share), sum(leaves.values()) * epochs)


def chosen(rows, share, weights, epochs):
    """rows: (doc_id, domain, lang, source, n); (id, path) -> copies."""
    docs = collections.Counter()
    for i, *path, n in rows:
        if n:
            docs[i, tuple(path)] += n
    leaves = collections.Counter()
    for (_, path), n in docs.items():
        leaves[path] += n
    out = {}
    for path, budget in plain(dict(leaves), share, weights, epochs).items():
        whole, rest = divmod(budget, leaves[path])
        order = sorted((hashlib.md5(f"{mixing.SEED}:{whole}:{'' if i is None else i}".encode()).hexdigest()[:15], i, n) for (i, p), n in docs.items() if p == path)
        used = 0
        for _, i, n in order:
            copies = whole + (used < rest)
            used += n
            if copies:
                out[i, path] = copies
    return out


def test_mix_over_a_tree(spark):
    rng, rows = random.Random(9), []
    for i in range(400):
        rows.append((i % 350, rng.choice(["d0", "d1", "d2", None]), rng.choice(["en", "fr", None]), rng.choice(["s1", "it's", None]), words(rng, rng.choice([0, 1, 5, 60]))))
    rows += [(None, "d0", "en", "s1", "a b c"), (None, "d0", "en", "s1", "d"), (7, "d0", "en", "s1", None), (8, "d2", "fr", None, " \n"), (9, "d2", "fr", None, "x " * 5000)]
    more = [c for c in CLASHING if c != "domain"]
    docs = spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, area string, lang string, source string, text string, " + ", ".join(f"{c} string" for c in more))
    for share, epochs in ((0.5, 3), (2.4, 3)):
        want = chosen([(*r[:4], len((r[4] or "").split())) for r in rows], share, WEIGHTS, epochs)
        got = {(r.doc_id, (r.domain, r.lang, r.source)): r.copies for r in mixing.mix(docs, share, epochs, "area", WEIGHTS).collect()}
        assert got == want
        taken = mixing.mix_documents(docs, share, epochs, "area", WEIGHTS)
        assert taken.columns == docs.columns
        count = collections.Counter((r.doc_id, (r.area, r.lang, r.source), r.text) for r in taken.collect())
        expect = collections.Counter()
        for r in rows:
            if (r[4] or "").split() and (r[0], r[1:4]) in want:
                expect[r[0], r[1:4], r[4]] += want[r[0], r[1:4]]
        assert count == expect


def test_stand_in_for_domains_and_edges(spark):
    docs = make(spark, ["a b", None, ""], source="src6").unionByName(make(spark, ["c"], None, None, ids=[5]))
    assert {(r.doc_id, r.domain) for r in mixing.mix(docs, share=3.0).collect()} == {(0, "d2"), (5, "d0")}
    assert mixing.mix(make(spark, [])).collect() == [] and mixing.mix_documents(make(spark, [])).collect() == []
    assert mixing.mix_documents(docs, share=3.0).count() == 6
