"""Maintained totals against a recount, with two writers, torn writes and compaction."""

import os
import random

import pytest

from logdistill.llm import bpe, token_counts as tc

from helpers import corpus, make


def batch(spark, rows):
    return spark.createDataFrame(rows, tc.CHANGES)


def totals(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_rollup(spark):
    more = make(spark, ["un deux trois quatre", "null id"], "fr", None, ids=[50, None])
    total = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in tc.rollup(make(spark, corpus()).unionByName(more)).collect()}
    one, two = (bpe.bpe(x) for x in (tc.FIRST_VERSION, tc.LATER_VERSION))
    unique = {}
    for t in corpus():
        unique.setdefault(t or "", t)
    want = {("src1", "en", tc.FIRST_VERSION): (len(unique), sum(len(one.ids(t)) // 4 for t in unique.values()))}
    want[(None, "fr", tc.LATER_VERSION)] = (1, len(two.ids("un deux trois quatre")) // 4)
    assert total == want
    assert tc.rollup(make(spark, [])).collect() == []


def test_changes(spark, tmp_path):
    store = tc.CountStore(spark, str(tmp_path / "s"))
    assert totals(store) == {} and store.ledger().count() == 0
    first = batch(spark, [(1, "v", "insert", "s", "en", 5), (2, "v", "insert", "s", "en", 7), (2, "v", "insert", "s", "en", 3)])
    assert store.commit("b/1 é", first) and not store.commit("b/1 é", first)
    assert totals(store) == {("s", "en", "v"): (2, 12)}
    store.commit("b2", batch(spark, [(1, "v", "revise", "t", None, 6), (2, "v", "delete", None, None, 0), (9, "v", "delete", None, None, None)]))
    assert totals(store) == {("t", None, "v"): (1, 6)}
    with pytest.raises(Exception, match="op of"):
        store.commit("b3", batch(spark, [(1, "v", "odd", "t", "en", 6)]))
    with pytest.raises(Exception, match="op of"):
        store.commit("b3", batch(spark, [(None, "v", "insert", "t", "en", 6)]))
    assert store.commit("b3", batch(spark, [])) and totals(store) == {("t", None, "v"): (1, 6)}


def test_a_stale_writer_is_refused_and_works_out_its_batch_again(spark, tmp_path):
    store, other = (tc.CountStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.commit("base", batch(spark, [(1, "v", "insert", "s", "en", 5)]))
    a = store.prepare("a", batch(spark, [(1, "v", "revise", "s", "en", 100)]))
    late = batch(spark, [(1, "v", "revise", "s", "en", 7)])
    b = other.prepare("b", late)
    assert store.publish(a) and not other.publish(b)
    assert totals(store) == {("s", "en", "v"): (1, 100)}
    assert other.commit("b", late) and totals(store) == {("s", "en", "v"): (1, 7)}
    assert [r.n_tokens for r in store.ledger().collect()] == [7]


def test_a_stop_at_any_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "s")
    store, change = tc.CountStore(spark, path), batch(spark, [(1, "v", "insert", "s", "en", 5)])
    store.commit("a", change)
    more = batch(spark, [(2, "v", "insert", "s", "en", 1)])
    prepared = store.prepare("b", more)  # stops before its version is written
    open(f"{path}/parts/torn", "w").close()  # stops while it is written
    assert totals(store) == {("s", "en", "v"): (1, 5)}
    assert store._write_once(f"versions/{prepared.seq:020d}", prepared.content)  # stops before its marker is written
    assert not store.commit("b", more) and totals(store) == {("s", "en", "v"): (2, 6)}


def test_many_batches_against_a_recount(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tc, "COMPACT_AFTER", 2)
    rng, store, counted = random.Random(5), tc.CountStore(spark, str(tmp_path / "s")), {}
    for k in range(7):
        rows = []
        for doc in rng.sample(range(12), 6):
            op = rng.choice(tc.OPS)
            rows.append((doc, rng.choice("vw"), op, rng.choice(["s", "t", None]), "en", rng.randint(0, 9)))
        for doc, v, op, source, lang, n in rows:
            counted.pop((doc, v), None)
            if op != "delete":
                counted[doc, v] = (source, lang, n)
        assert store.commit(f"b{k}", batch(spark, rows))
        want = {}
        for (_, v), (source, lang, n) in counted.items():
            d, t = want.get((source, lang, v), (0, 0))
            want[source, lang, v] = (d + 1, t + n)
        assert totals(store) == want
        assert {(r.doc_id, r.tokenizer_version): (r.source, r.lang, r.n_tokens) for r in store.ledger().collect()} == counted
    store.vacuum(keep=1)
    assert totals(store) == want and len(os.listdir(tmp_path / "s" / "versions")) == 1
    assert store.ledger().count() == len(counted) and not store.commit("b0", batch(spark, []))
