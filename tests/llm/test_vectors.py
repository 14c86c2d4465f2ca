"""Links of vectors against all pairs."""

import numpy as np
import pytest

from logdistill.llm import hnsw

from helpers import rows


def table(spark, data, kind="float"):
    more = "id string, key string, copies string, shard string, dim string, n string, vector string, t_id string"
    return spark.createDataFrame([(*d, *"abcdefgh") for d in data], f"vec_id long, embedding array<{kind}>, label int, {more}")


def plain(ids, x, labels):
    """n_links and component of each row; ids differ."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    component = np.array(ids)
    while True:
        low = np.array([component[link[i]].min(initial=component[i]) for i in range(len(ids))])
        if (low == component).all():
            return link.sum(axis=1), component
        component = low


def test_edge_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:120] = x[0] + 0.02 * rng.normal(size=(20, 16))
    x[200] = x[201]
    x = x.astype(np.float32).astype(float)
    labels = np.array([i % 3 if i < 100 else 0 for i in range(300)])
    data = [(i, x[i].tolist(), int(labels[i])) for i in range(300)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [1.0, None], 0), (304, data[0][1], None), (305, [], 0), (306, [1.0], 0), (307, [float("inf")] * 16, 0)]
    got = rows(hnsw.near_duplicate_vectors(table(spark, data + odd)))
    n, component = plain(range(300), x, labels)
    assert [got[i]["n_links"] for i in range(300)] == n.tolist() and [got[i]["component_id"] for i in range(300)] == component.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(300, 308))
    assert list(got[0])[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert hnsw.near_duplicate_vectors(table(spark, [])).collect() == []


def test_very_large_and_small_components(spark):
    data = [(0, [1e300, 1e300], 0), (1, [1e-300, 1e-300], 0), (2, [1.0, 1.0], 0), (3, [5e-324, 0.0], 0), (4, [1e308, 0.0], 0)]
    got = rows(hnsw.near_duplicate_vectors(table(spark, data, "double")))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(5)] == [(2, 0), (2, 0), (2, 0), (1, 3), (1, 3)]


def test_repeated_rows_and_ids(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    data = [(1, a, 0), (1, a, 0), (2, a, 0), (3, b, 0), (3, c, 0), (None, a, 0)]
    got = [tuple(r) for r in hnsw.near_duplicate_vectors(table(spark, data)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 1, False), (None, 0, None, True)], key=repr)


@pytest.mark.parametrize("shard, block", [(150, 100), (400, 2000)])
def test_recall_over_several_shards(spark, monkeypatch, shard, block):
    """Clusters about the threshold, several shards and blocks of queries: recall of links of 0.99 at least, none invented."""
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 1500)] + rng.uniform(0.02, 0.2, size=(1500, 1)) * rng.normal(size=(1500, 32))
    labels = (rng.random(1500) < 0.2).astype(int)
    got = rows(hnsw.near_duplicate_vectors(table(spark, [(i, x[i].tolist(), int(labels[i])) for i in range(1500)], "double")))
    n, component = plain(range(1500), x, labels)
    found = np.array([got[i]["n_links"] for i in range(1500)])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum() and n.sum() > 5000
    assert np.mean([got[i]["component_id"] for i in range(1500)] == component) >= 0.99


def test_links_of_one_graph():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(150, 32)), 10, axis=0) + 0.08 * rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    found = {(int(r), int(c)) for rows_, cols in hnsw._links(g, x, g.audited_beam(0.98), 0.98) for r, c in zip(rows_, cols)}
    true = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.98))))
    assert found <= true and len(found) >= 0.99 * len(true) and len(true) > 3000
