import collections
import functools
import hashlib
import os

import pytest

from logdistill.llm import maglev

from helpers import corpus, make


def test_table():
    table = maglev.lookup_table(maglev.SHARDS)
    sizes = collections.Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == len(maglev.SHARDS)
    fewer = maglev.lookup_table(maglev.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, fewer)) / len(table) < 0.1
    with pytest.raises(ValueError):
        maglev.lookup_table(["a"], 10)


@functools.cache
def placed(key):
    slot = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16) % maglev.TABLE_SIZE
    return slot, maglev.SHARDS[maglev.lookup_table(maglev.SHARDS)[slot]]


def test_whole_rows_are_placed(spark):
    docs = make(spark, corpus()).unionByName(make(spark, ["x", "x"], ids=[None, None]))
    got = maglev.assign_shards(docs, "doc_id")
    assert got.columns == [c for c in docs.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert all((r.slot, r.shard) == placed(r.doc_id) and r.kept == "own kept" for r in rows)
    assert {(r.slot, r.shard) for r in maglev.assign_shards(docs, "slot").collect()} == {placed("own slot")}
    assert maglev.assign_shards(make(spark, []), "doc_id").collect() == []


def test_written_shards(spark, tmp_path):
    docs = make(spark, corpus() * 30, ids=[7] * 15 * len(corpus()) + list(range(15 * len(corpus()))))
    maglev.write_shards(docs, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.shard == placed(r.doc_id)[1] for r in back.collect())
    hot = [f for f in os.listdir(tmp_path / "out" / f"shard={placed(7)[1]}") if f.endswith(".parquet")]
    assert 2 <= len(hot) <= 4
