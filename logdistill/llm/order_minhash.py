"""Near-duplicates by Order MinHash (Marcais et al., 2019).

A text is a sequence of words. Its five-word k-mers are labelled with how often
they came before, so repeats count. Each of ``SKETCHES`` sketches takes the
``PER_SKETCH`` labelled k-mers of least seeded hash and keeps them in text order:
two texts agree in a sketch if they share these k-mers *and* their order, which
makes agreement sensitive to edit similarity, not only to shared content. Labels
and order lower agreement where a passage comes twice, so each sketch also has an
order-blind value: the ``PER_SKETCH`` distinct k-mers of least hash, as a set. Texts of up to ``SHORT``
distinct k-mers have values of ``PER_SHORT`` as well, as three of few differ soon.

Two texts are linked if both hold: the Jaccard similarity of their sets of
five-word shingles is at least 0.8, and so is their alignment similarity
1 - d / (n + m), d being the fewest word insertions and deletions between them,
found by alignment in a band no wider than d can be. Texts of fewer than five
words have one shingle, the whole text. Texts with the same words form one class.

Candidates. An order-blind value is a bucket of classes. (1) Every class is paired with
its bucket's smallest class: a star, linear in the bucket, which joins large
groups of copies. (2) Buckets that still hold several components are compared inside
tasks, in blocks of ``BLOCK`` x ``BLOCK``, if they have up to ``LARGE`` classes.
Passages that many texts share fill larger buckets. Their classes meet by their rarest
shingles instead, with nothing lost: in one order of all shingles, two sets of a Jaccard
similarity of 0.8 have a shingle in common among the first n - ceil(0.8 n) + 1 of each.
These groups are compared in blocks whatever their size. Pairs of different components that
share a bucket, agree in ``AGREE`` values of either kind and whose sizes allow a link are
candidates, by whichever way they meet. Classes without a
candidate leave; the rest get their texts, and the task checks the pairs and joins
components as it goes, so it emits the edges of a forest, never the pairs.

A linked pair has a Jaccard similarity of 0.8 at least, whatever its order and
repeats. At 0.8 it agrees in about 10 of 20 order-blind values, and in fewer than two
with a probability of 2e-5; with a text of up to 20 distinct k-mers the other one has
up to 25, and the values for short ones make that 4e-7. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import components, cut, slices, unused

K = 5
SKETCHES = 20
PER_SKETCH = 3
PER_SHORT = 2
SHORT = 25
AGREE = 2
BLOCK = 512
#: Order-blind values first, then those of short texts (0 for others), then the ordered ones. The first two kinds are buckets.
BUCKETS = 2 * SKETCHES
VALUES = 3 * SKETCHES
#: Classes of buckets that have more than these meet by their rarest shingles.
LARGE = BLOCK * BUCKETS // 2
#: What a group of compared sketches is named by.
PLACE = ["j", "key", "low", "high"]
#: The ``j`` of groups that share a rare shingle.
RARE = BUCKETS
#: Counters by which shingles are ordered.
SLOTS = 1 << 20
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Words whose codes a Python worker keeps.
CACHED_WORDS = 400_000
_CODES: dict[bytes, int] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_SEEDS = np.random.default_rng(20190705).integers(1, 2**63, SKETCHES).astype(np.uint64)[:, None]
_PLACES = np.random.default_rng(5).integers(1, 2**63, K).astype(np.uint64) | np.uint64(1)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def codes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word that depends on the word alone, in every process. Known words are cached; a full cache starts afresh."""
    try:
        return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_CODES) > CACHED_WORDS:
            _CODES.clear()
        new = [w for w in set(words) if w not in _CODES]
        _CODES.update(zip(new, pd.util.hash_array(np.array(new, dtype=object), categorize=False).tolist()))
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: what ASCII white space separates."""
    return (text or "").encode("utf-8", "replace").split()


def word_codes(text: str | None) -> np.ndarray:
    return codes_of(split_words(text))


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of each five-word shingle, in text order; one for shorter texts, none for texts without words."""
    n = len(codes)
    if n == 0:
        return codes
    width = min(K, n)
    mixed = _scatter(codes)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out += mixed[j : j + len(out)] * _PLACES[j]
    return _scatter(out + np.uint64(width))


def _least(grams: np.ndarray, ranks: np.ndarray, most: int) -> np.ndarray:
    """Where the ``most`` k-mers of least rank are, for each sketch."""
    n = len(grams)
    few = min(most, n)
    return np.argpartition(ranks, few - 1, axis=1)[:, :few] if n > few else np.tile(np.arange(n), (SKETCHES, 1))


def _chained(chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(SKETCHES, dtype=np.uint64)
    for i in range(chosen.shape[1]):
        out = _scatter(out * _MIX[0] + chosen[:, i])
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """VALUES int64 values of a text's shingle hashes (one at least): the order-blind ones, then the ordered ones."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    labels = np.zeros(n, dtype=np.uint64)
    if not first.all():
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        labels[order] = (np.arange(n) - begin).astype(np.uint64)
    ranks = _scatter((grams + labels * _MIX[0])[None, :] ^ _SEEDS)
    chosen = _least(grams, ranks, PER_SKETCH)
    chosen.sort(axis=1)  # text order
    once = labels == 0
    # Each distinct k-mer's first occurrence has label 0, so these ranks depend on the set alone.
    distinct = np.flatnonzero(once)
    blind = chosen if once.all() else distinct[_least(grams[once], ranks[:, once], PER_SKETCH)]
    short = np.zeros(SKETCHES, dtype=np.uint64)
    if len(distinct) <= SHORT:
        short = _chained(np.sort(grams[distinct[_least(grams[once], ranks[:, once], PER_SHORT)]], axis=1))
    return np.r_[_chained(np.sort(grams[blind], axis=1)), short, _chained(grams[chosen])].view(np.int64)


def edits_within(a: list, b: list, most: int) -> int | None:
    """Fewest insertions and deletions that turn ``a`` into ``b``, or None if over ``most``: furthest-reaching alignment (Myers, 1986) in a band of ``most`` diagonals to each side."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            down = k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)
            x = reach.get(k + 1, 0) if down else reach.get(k - 1, 0) + 1
            y = x - k
            if x > n or y > m:
                reach[k] = x if x <= n else n + 1
                continue
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return d
    return None


def linked(text_a: str | None, text_b: str | None) -> bool:
    """The link rule on two texts."""
    a, b = word_codes(text_a), word_codes(text_b)
    if not len(a) or not len(b):
        return False
    sa, sb = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(sa, sb, assume_unique=True))
    if DEN * both < NUM * (len(sa) + len(sb) - both):
        return False
    total = len(a) + len(b)
    return edits_within(a.tolist(), b.tolist(), total * (DEN - NUM) // DEN) is not None


def _digest(words: list[bytes]) -> str:
    return hashlib.md5(b" ".join(words)).hexdigest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), digest (of the words), n (distinct shingles), sketch of each row that has an id and words."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("digest", pa.string()), ("n", pa.int32()), ("sketch", pa.list_(pa.int64()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 128):
            rows, values = [], []
            for doc, mark, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
                words = split_words(text)
                if words:
                    grams = shingles(codes_of(words))
                    values.append(sketch(grams))
                    rows.append((doc, mark, _digest(words), len(np.unique(grams))))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * VALUES)
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int64))
            columns = [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], names=schema.names)

    picked = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return picked.mapInArrow(batches, "doc_id long, mark long, digest string, n int, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the link rule holds for."""
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 256):
            keep = [linked(x, y) for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b").mapInArrow(batches, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame, sk: DataFrame) -> DataFrame:
    """id and text of classes: the text of a class's first document, found by its doc_id and mark."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            keep = [_digest(split_words(t)) == d for t, d in zip(b.column("text").to_pylist(), b.column("digest").to_pylist())]
            yield b.select(["id", "text"]).filter(pa.array(keep, pa.bool_()))

    known = ids.join(sk.select("id", "digest", "doc_id", "mark"), "id")
    found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return found.join(known, ["doc_id", "mark"]).select("id", "digest", "text").mapInArrow(batches, "id long, text string").dropDuplicates(["id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by PLACE, and where their groups begin and end."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        changed = np.zeros(max(0, t.num_rows - 1), dtype=bool)
        for name in PLACE:
            v = t.column(name).to_numpy()
            changed |= v[1:] != v[:-1]
        begins = np.flatnonzero(changed) + 1
        if begins.size:
            yield t.slice(0, begins[-1]).combine_chunks(), np.r_[0, begins]
            t = t.slice(begins[-1])
        rest = t
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


class _Blocks:
    """Numpy columns of a table of groups and the candidate pairs of each group.

    ``j`` is the column of a group's bucket, or RARE.
    ``large`` has a bit for each column whose bucket of the row is a large one.
    """

    def __init__(self, t: pa.Table):
        self.j, self.low, self.high, self.own, self.id, self.component, self.n, self.large = (
            t.column(c).to_numpy() for c in ("j", "low", "high", "own", "id", "component", "n", "large")
        )
        self.sketch = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, VALUES)

    def candidates(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the left and right block, and the matrix of candidates. A pair is told by its first small bucket, or where it has none by the rare shingles that it shares."""
        rows = np.arange(begin, end)
        one = self.low[begin] == self.high[begin]
        left = rows if one else rows[self.own[begin:end] == self.low[begin]]
        right = rows if one else rows[self.own[begin:end] == self.high[begin]]
        j = int(self.j[begin])
        nl, nr = self.n[left][:, None], self.n[right][None, :]
        ok = self.component[left][:, None] != self.component[right][None, :]
        ok &= DEN * np.minimum(nl, nr) >= NUM * np.maximum(nl, nr)
        if one:
            ok &= self.id[left][:, None] < self.id[right][None, :]
        if ok.any():
            agree = np.zeros(ok.shape, dtype=np.uint8)
            met = np.zeros(ok.shape, dtype=bool)
            bits = self.large[left]
            for c in range(VALUES):
                mine = self.sketch[left, c][:, None]
                same = (mine == self.sketch[right, c][None, :]) & (mine != 0)
                agree += same
                if c >= BUCKETS:
                    continue
                # An agreement is one bucket, so both rows have the same bit.
                met |= same
                if c < j:
                    ok &= ~same | (bits >> c & 1).astype(bool)[:, None]
            ok &= met & (agree >= AGREE)
        return left, right, ok


def _with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a candidate in their group."""
    for t, ends in _groups(batches):
        blocks, keep = _Blocks(t), np.zeros(t.num_rows, dtype=bool)
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            left, right, ok = blocks.candidates(begin, end)
            keep[left[ok.any(axis=1)]] = True
            keep[right[ok.any(axis=0)]] = True
        yield from t.filter(pa.array(keep)).to_batches()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b that join components, of candidates in each group; pairs of what is joined already aren't looked at."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = p
        return v

    for t, ends in _groups(batches):
        blocks, edges = _Blocks(t), []
        text, ids, component = t.column("text"), blocks.id, blocks.component.tolist()
        codes: dict[int, np.ndarray] = {}
        grams: dict[int, np.ndarray] = {}

        def know(row: int) -> np.ndarray:
            i = int(ids[row])
            if i not in grams:
                codes[i] = word_codes(text[row].as_py())
                grams[i] = np.unique(shingles(codes[i]))
            return grams[i]

        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            left, right, ok = blocks.candidates(begin, end)
            for at in np.flatnonzero(ok.any(axis=1)).tolist():
                x = int(left[at])
                mine = root(component[x])
                others = [y for y in right[ok[at]].tolist() if root(component[y]) != mine]
                if not others:
                    continue
                a = know(x)
                b = [know(y) for y in others]
                sizes = np.array([len(v) for v in b])
                every = np.concatenate(b)
                found = a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every
                both = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
                near = DEN * both >= NUM * (len(a) + sizes - both)
                for k in np.flatnonzero(near).tolist():
                    y = others[k]
                    p, q = root(component[x]), root(component[y])
                    if p == q:
                        continue
                    u, v = codes[int(ids[x])], codes[int(ids[y])]
                    if edits_within(u.tolist(), v.tolist(), (len(u) + len(v)) * (DEN - NUM) // DEN) is not None:
                        parent[max(p, q)] = min(p, q)
                        edges.append((int(ids[x]), int(ids[y])))
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _rare(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """key, id, component: the shingles of each of ``classes(id, component)`` of which two sets of a Jaccard similarity of NUM / DEN have one in common.

    They are each set's first ones in an order that all classes share, so which order
    it is matters for speed alone: shingles of few classes come first.
    """
    known = cut(classes.select("id", "component").join(texts, "id"))

    def grams(text: str) -> np.ndarray:
        return np.unique(shingles(word_codes(text)))

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for b in slices(it, 128):
            every = [grams(t) for t in b.column("text").to_pylist()]
            total += np.bincount((np.concatenate(every) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    # Shingles of up to a block of classes come first in any order.
    often = known.select("text").mapInArrow(counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).toPandas()
    slots, numbers = often["slot"].to_numpy(), often["n"].to_numpy()

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, dtype=np.int64)
        count[slots] = numbers
        for b in slices(it, 128):
            chosen = []
            for text in b.column("text").to_pylist():
                g = grams(text)
                order = np.lexsort((g, count[(g % np.uint64(SLOTS)).astype(np.int64)]))
                chosen.append(g[order[: len(g) - (NUM * len(g) + DEN - 1) // DEN + 1]].view(np.int64))
            at = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen)), b.column("id").take(pa.array(at)), b.column("component").take(pa.array(at))], names=["key", "id", "component"])

    return known.mapInArrow(first, "key long, id long, component long")


def _in_blocks(members: DataFrame, sk: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join different components within buckets, from members(j, key, id, component, size)."""
    is_large = F.col("size") > LARGE
    small = members.where(~is_large).select("j", "key", "id", "component", "size")
    # At most BUCKETS of them for each class.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    lists = cut(members.where(is_large).groupBy("id", "component").agg(F.bit_or(bit).alias("large")))
    rare = lists.limit(0).select(F.lit(0).cast("long").alias("key"), "id", "component") if lists.isEmpty() else _rare(lists, texts)
    sizes = rare.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1")
    large = rare.join(sizes.drop("c0", "c1"), "key").select(F.lit(RARE).alias("j"), "key", "id", "component", "size")

    dealt = small.unionByName(large).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.join(lists.select("id", "large"), "id", "left").withColumn("large", F.coalesce("large", F.lit(0).cast("long")))
    # 32 bits of each value: a chance agreement is one candidate more, and these rows are copied.
    slim = F.transform("sketch", lambda x: F.when(x == 0, 0).otherwise(F.hash(x)))
    dealt = dealt.join(sk.select("id", "n", slim.alias("sketch")), "id")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "j", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "component", "n", "large", "sketch"
    )
    schema = "j int, key long, low int, high int, own int, id long, component long, n int, large long, sketch array<int>"
    some = cut(dealt.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(_with_candidates, schema))
    with_text = some.join(texts, "id").repartition(*PLACE).sortWithinPartitions(*PLACE)
    return with_text.mapInArrow(_forest, "a long, b long")


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, mark, class_id, component_id, and chosen (its component's one that stays) of each distinct id and text that has words."""
    rows = cut(sketches(docs))
    one = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("x"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # A class has a number of its own, so that an id may have several texts; it is read from the checkpoint from here on.
    sk = cut(one.select(F.monotonically_increasing_id().alias("id"), "digest", "x.doc_id", "x.mark", "n", "sketch"))
    buckets = sk.select("id", F.posexplode(F.slice("sketch", 1, BUCKETS)).alias("j", "key")).where("key <> 0")
    stars = buckets.groupBy("j", "key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    multi = cut(buckets.join(stars, ["j", "key"]))
    texts = cut(_texts(docs, multi.select("id").distinct(), sk))
    pairs = multi.where("id > a").select("a", F.col("id").alias("b")).distinct()
    left = sk.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sk.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    agree = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: (x == y) & (x != 0)), lambda x: x))
    sized = f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)"
    pairs = pairs.join(right, "b").join(left, "a").where(sized).where(agree >= AGREE).select("a", "b")

    links = cut(_verified(pairs, texts))
    label = components(links)
    now = multi.select("j", "key", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Buckets of several components; a member of a settled bucket goes no further.
    mixed = now.groupBy("j", "key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("size"))
    members = cut(now.join(mixed.where("c0 <> c1").select("j", "key", "size"), ["j", "key"]))
    label = components(links.union(_in_blocks(members, sk, texts)))
    classes = sk.select("id", "digest", F.col("doc_id").alias("class_id"), F.col("mark").alias("class_mark")).join(label, "id", "left")
    classes = classes.select("digest", "class_id", "class_mark", F.coalesce("component", "id").alias("component"))
    least = classes.groupBy("component").agg(F.min(F.struct("class_id", "class_mark")).alias("least"))
    named = classes.join(least, "component").select("digest", "class_id", F.col("least.class_id").alias("component_id"), F.col("least.class_mark").alias("least_mark"))
    documents = rows.groupBy("doc_id", "mark", "digest").agg(F.lit(0).alias("none")).drop("none").join(named, "digest")
    chosen = (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("least_mark"))
    return documents.select("doc_id", "mark", "class_id", "component_id", chosen.alias("chosen"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document id of ``docs(doc_id, text)``: class_id (smallest id with the same words), component_id (smallest id reachable by links), kept (doc_id = component_id).

    Documents without words (null, empty, blank) are a class each and kept. Repeated
    rows are one document; an id with several texts has a row for each component that
    they belong to. Rows with a null id have no result. Extra columns are ignored; an
    empty table gives an empty result.
    """
    found = _labelled(docs).groupBy("doc_id", "component_id").agg(F.min("class_id").alias("class_id"))
    everyone = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    out = everyone.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, and if that has several texts of it, of the smallest hash.

    Rows with a null id and rows without words stay. An id's texts are judged one by
    one. Of rows that repeat both id and text any one stays.
    """
    told = cut(_labelled(docs))
    names = {c: unused(docs.columns, f"told_{c}") for c in ("doc_id", "mark")}

    def marked(x: DataFrame) -> DataFrame:
        return x.select(*(F.col(c).alias(n) for c, n in names.items()))

    def same(x: DataFrame) -> Column:
        return (x["doc_id"].cast("long") == F.col(names["doc_id"])) & (F.xxhash64(x["text"]) == F.col(names["mark"]))

    left = docs.join(marked(told.where("not chosen")), same(docs), "left_anti")
    repeated = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark")).count()
    repeated = cut(told.where("chosen").select("doc_id", "mark").join(repeated.where("count > 1"), ["doc_id", "mark"]))
    if repeated.isEmpty():
        return left
    number = unused(docs.columns, "number")
    several = left.join(marked(repeated), same(left), "left_semi").withColumn(number, F.xxhash64("text"))
    return left.join(marked(repeated), same(left), "left_anti").unionByName(several.dropDuplicates(["doc_id", number]).drop(number))
