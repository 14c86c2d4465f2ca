"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are compared only within their label. A label's distinct vectors are
dealt to shards of about ``SHARD`` vectors; each shard gets a graph (Malkov and
Yashunin, 2018) of its own. Blocks of queries then visit their own shard and those
numbered after it, so that every pair of shards of a label meets once; what a query
finds in another shard counts for both vectors. Before it answers, a shard is audited: synthetic queries near known
vectors are answered by beam search and by brute force, and the beam is widened
until recall passes. A query whose beam is full of links is asked again with a
wider beam. Every link is verified by cosine in double precision.

A task emits for each vector how many others it links with, and a spanning forest
of the links, never the links themselves. Shards bound a task's memory; a label of N
vectors has N / SHARD of them, so its searches grow with N * N / (2 * SHARD), each
logarithmic in SHARD.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import components, cut

THRESHOLD = 0.98
SHARD = 2_000
QUERY_BLOCK = 8_000
NEIGHBOURS = 12
BUILD_BEAM = 48
FIRST_BEAM = 32
AUDITED = 48
AUDIT_RECALL = 0.995
WAVE = 256


class Graph:
    """A graph over unit vectors. Layer l holds the nodes whose level is at least l; a row of ``links[l]`` has a node's neighbours, -1 where there is none."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x)
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.floor(-np.log1p(-draw) / np.log(NEIGHBOURS)).astype(int)
        self.links = [np.full((n, 2 * NEIGHBOURS if lv == 0 else NEIGHBOURS), -1, dtype=np.int32) for lv in range(self.level.max(initial=0) + 1)]
        self.entry = int(np.argmax(self.level[:WAVE])) if n else -1
        for at in range(0, n, WAVE):
            self._insert(np.arange(at, min(n, at + WAVE)))

    def _insert(self, wave: np.ndarray) -> None:
        """Adds nodes together: their candidates are what the graph so far shows, and each other."""
        begin = wave[0]
        near = self.x[wave] @ self.x[wave].T
        np.fill_diagonal(near, -np.inf)
        start = np.full((len(wave), 1), self.entry if begin else -1)
        for lv in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(self.level[wave] >= lv)
            found = sims = None
            if begin:
                wide = BUILD_BEAM if len(mine) else 1
                found, sims = self.beam(self.x[wave], start, wide, lv)
                start = found[:, :4]
            if not len(mine):
                continue
            added: dict[int, list[int]] = {}
            for i in mine:
                v = int(wave[i])
                peers = mine[np.argsort(-near[i, mine])[:BUILD_BEAM]]
                peers = peers[peers != i]
                ids, s = wave[peers], near[i, peers]
                if found is not None:
                    ok = found[i] >= 0
                    ids, s = np.r_[ids, found[i][ok]], np.r_[s, sims[i][ok]]
                kept = self._spread(ids, s, NEIGHBOURS)
                self.links[lv][v, : len(kept)] = kept
                for u in kept.tolist():
                    added.setdefault(u, []).append(v)
            for u, more in added.items():
                row = self.links[lv][u]
                ids = np.unique(np.r_[row[row >= 0], more])
                if len(ids) > len(row):
                    ids = self._spread(ids, self.x[ids] @ self.x[u], len(row))
                row[:] = -1
                row[: len(ids)] = ids
        best = wave[np.argmax(self.level[wave])]
        if begin and self.level[best] > self.level[self.entry]:
            self.entry = int(best)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours: the nearest that aren't nearer to one chosen before; free places go to the nearest others."""
        order = np.argsort(-sims, kind="stable")[: 4 * most]
        ids, sims = ids[order], sims[order]
        if len(ids) <= most // 2:
            return ids
        between = self.x[ids] @ self.x[ids].T
        cover = np.full(len(ids), -np.inf)
        chosen, rest = [], []
        for c in range(len(ids)):
            if len(chosen) == most:
                break
            if sims[c] > cover[c]:
                chosen.append(c)
                cover = np.maximum(cover, between[c])
            else:
                rest.append(c)
        return ids[chosen + rest[: most - len(chosen)]]

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, lv: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, nearest first, and their similarities; all queries step together, each expanding its best few unexpanded nodes until its beam has none."""
        links, x = self.links[lv], self.x
        b = len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(x) + 1), dtype=bool)  # the last column takes what -1 marks
        sims = np.where(start >= 0, np.einsum("bkd,bd->bk", x[start], q), -np.inf)
        ids = start.copy()
        seen[rows, ids] = True
        ids, sims = _dedupe(ids, sims)
        open_ = ids >= 0
        active = np.arange(b)
        while active.size:
            s, i, o = sims[active], ids[active], open_[active]
            few = min(4, s.shape[1])
            worth = np.where(o, s, -np.inf)
            pick = np.argpartition(-worth, few - 1, axis=1)[:, :few] if worth.shape[1] > few else np.tile(np.arange(few), (len(active), 1))
            live = np.take_along_axis(worth, pick, 1) > -np.inf
            nodes = np.where(live, np.take_along_axis(i, pick, 1), -1)
            np.put_along_axis(o, pick, False, 1)
            new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[active[:, None], new]] = -1
            seen[active[:, None], new] = True
            t = np.where(new >= 0, np.einsum("bkd,bd->bk", x[new], q[active]), -np.inf)
            i, s, o = np.concatenate([i, new], 1), np.concatenate([s, t], 1), np.concatenate([o, new >= 0], 1)
            if s.shape[1] > width:
                top = np.argpartition(-s, width - 1, axis=1)[:, :width]
                i, s, o = (np.take_along_axis(z, top, 1) for z in (i, s, o))
            if i.shape[1] != ids.shape[1]:
                pad = i.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
                open_ = np.pad(open_, ((0, 0), (0, pad)))
            ids[active], sims[active], open_[active] = i, s, o & (s > -np.inf)
            active = active[open_[active].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the entry down all layers."""
        start = np.full((len(q), 1), self.entry)
        for lv in range(len(self.links) - 1, 0, -1):
            start = self.beam(q, start, 4, lv)[0]
        return self.beam(q, start, width, 0)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All nodes for each query: what a beam as wide as the graph is."""
        return np.tile(np.arange(len(self.x)), (len(q), 1)), q @ self.x.T

    def audited_beam(self, threshold: float, seed: int = 11) -> int:
        """The width at which recall on AUDITED synthetic queries passes; len(x) means a scan."""
        n, dim = self.x.shape
        rng = np.random.default_rng(seed)
        origin = rng.choice(n, min(n, AUDITED), replace=False)
        noise = rng.normal(size=(len(origin), dim))
        noise -= np.einsum("bd,bd->b", noise, self.x[origin])[:, None] * self.x[origin]
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        angle = np.arccos(min(1.0, threshold)) * 0.9
        q = np.cos(angle) * self.x[origin] + np.sin(angle) * noise / np.where(length > 0, length, 1)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        true = (q @ self.x.T) >= threshold
        width = FIRST_BEAM
        while width < n:
            ids, sims = self.search(q, width)
            hit = int(((sims >= threshold) & (ids >= 0)).sum())
            if hit >= AUDIT_RECALL * true.sum():
                return width
            width *= 2
        return n


def _dedupe(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(ids.shape, dtype=bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    return np.where(again, -1, ids), np.where(again | (ids < 0), -np.inf, sims)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.to_list(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    graph = Graph(_unit(pdf["vector"]))
    blob = pickle.dumps((graph, pdf["id"].to_numpy(), pdf["copies"].to_numpy(), graph.audited_beam(THRESHOLD)))
    return pd.DataFrame({"label": [pdf["label"].iat[0]], "dim": [pdf["dim"].iat[0]], "shard": [pdf["shard"].iat[0]], "graph": [blob]})


def _links(graph: Graph, q: np.ndarray, width: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, nodes) of links, in blocks; beams that fill with links are widened."""
    todo = np.arange(len(q))
    while todo.size:
        later = []
        full = width >= len(graph.x)
        for at in range(0, len(todo), 256):
            part = todo[at : at + 256]
            ids, sims = graph.scan(q[part]) if full else graph.search(q[part], width)
            hit = (ids >= 0) & (sims >= threshold - 1e-9)
            if not full:
                again = hit.sum(axis=1) >= width // 2
                later.append(part[again])
                hit[again] = False
            r, c = np.nonzero(hit)
            rows, nodes = part[r], ids[r, c]
            exact = np.einsum("kd,kd->k", q[rows], graph.x[nodes]) >= threshold
            yield rows[exact], nodes[exact]
        todo = np.concatenate(later) if later else np.zeros(0, dtype=int)
        # A beam of a quarter of the shard costs more than reading all of it.
        width = 4 * width if 16 * width < len(graph.x) else len(graph.x)


def _ask(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Rows (a, b, n): n links of a where b is null; else an edge of the forest."""
    none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "n": pd.Series([], dtype="int64")})
    if not len(graphs) or not len(queries):
        return none
    graph, ids, copies, width = pickle.loads(graphs["graph"].iat[0])
    mine, many = queries["id"].to_numpy(), queries["copies"].to_numpy()
    guest = (queries["home"] != graphs["shard"].iat[0]).to_numpy()
    counts, back = np.zeros(len(queries), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    # A forest over the ids of both sides; of a block's links only those between different trees are looked at one by one.
    every, at = np.unique(np.r_[mine, ids], return_inverse=True)
    of_query, of_node = at[: len(mine)], at[len(mine) :]
    tree = np.arange(len(every))
    edges: list[tuple[int, int]] = []

    def root(v: int) -> int:
        while tree[v] != v:
            tree[v] = tree[tree[v]]
            v = int(tree[v])
        return v

    for rows, nodes in _links(graph, _unit(queries["vector"]), width, THRESHOLD):
        other = ids[nodes] != mine[rows]
        rows, nodes = rows[other], nodes[other]
        np.add.at(counts, rows, copies[nodes])
        away = guest[rows]
        np.add.at(back, nodes[away], many[rows[away]])
        x, y = tree[of_query[rows]], tree[of_node[nodes]]
        apart = np.flatnonzero(x != y)
        _, first = np.unique(x[apart] * len(every) + y[apart], return_index=True)
        for k in apart[first].tolist():
            p, q = root(int(x[k])), root(int(y[k]))
            if p != q:
                tree[max(p, q)] = min(p, q)
                edges.append((int(mine[rows[k]]), int(ids[nodes[k]])))
        while (tree != tree[tree]).any():
            tree = tree[tree]
    told = [(mine[counts > 0], counts[counts > 0]), (ids[back > 0], back[back > 0])]
    out = pd.DataFrame({"a": np.concatenate([*(a for a, _ in told), np.array([a for a, _ in edges], dtype=np.int64)])})
    out["b"] = pd.array([None] * sum(len(a) for a, _ in told) + [b for _, b in edges], dtype="Int64")
    out["n"] = np.concatenate([*(n for _, n in told), np.zeros(len(edges), dtype=np.int64)])
    return out


def near_duplicate_vectors(embeddings: DataFrame) -> DataFrame:
    """One row for each row of ``embeddings(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, they have as
    many components, and their cosine is at least THRESHOLD. Null, empty, zero and
    non-finite vectors link with nothing, nor do rows with a null id. Rows of the
    same id and vector are one vector; of one id with several vectors the links of
    all count. Components of any finite size count. Extra columns are ignored; an empty
    table gives an empty result.
    """
    v = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.array_max(F.transform("vector", F.abs))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite, F.lit(False))
    good = v.where(usable).where(largest > 0).distinct()
    text = F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))
    good = good.withColumn("key", F.sha2(F.concat_ws("|", F.col("label").cast("string"), text), 256))
    classes = good.groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label")
    )
    # A class has a number of its own, so that an id may have several vectors; it is read from the checkpoint from here on.
    classes = cut(classes.withColumns({"id": F.monotonically_increasing_id(), "dim": F.size("vector")}))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).select(
        "label", "dim", F.ceil(F.col("size") / SHARD).cast("int").alias("shards"), F.ceil(F.col("size") / QUERY_BLOCK).cast("int").alias("blocks")
    )
    dealt = classes.join(sizes, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.col("blocks")).cast("int"))
    kind = dict(classes.dtypes)["label"]
    built = dealt.select("label", "dim", "shard", "id", "copies", "vector").groupBy("label", "dim", "shard")
    graphs = cut(built.applyInPandas(_build, f"label {kind}, dim int, shard int, graph binary"))
    served = graphs.join(sizes, ["label", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = dealt.withColumn("home", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.col("home"), F.col("shards") - 1)))
    keys = ["label", "dim", "shard", "block"]
    found = cut(
        served.select(*keys, "graph").groupBy(*keys).cogroup(asked.select(*keys, "home", "id", "copies", "vector").groupBy(*keys)).applyInPandas(_ask, "a long, b long, n long")
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = classes.select("key", "id", "least", "copies").join(counts, "id", "left").join(components(found.where("b is not null").select("a", "b")), "id", "left")
    named = named.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("number"))
    least = named.groupBy("number").agg(F.min("least").alias("component"))
    named = named.join(least, "number").select("key", "n", "component")
    told = good.select("vec_id", "key").join(named, "key").groupBy(F.col("vec_id").alias("t_id")).agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = v.select("vec_id").join(told, F.col("vec_id") == F.col("t_id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
