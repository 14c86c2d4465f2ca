import collections
import random

import numpy as np

from logdistill.llm import bpe, packing

from helpers import corpus, make, words


def test_bpe_pieces_equal_whole_texts():
    tok, rng = bpe.bpe("byte_bpe_50k"), random.Random(3)
    for t in [*corpus(), *("".join(rng.choice(" ab\n\té'.1") for _ in range(20)) for _ in range(500))]:
        assert np.frombuffer(tok.ids(t), "<i4").tolist() == tok.encoding.encode_ordinary(t or "")


def test_best_fit():
    rng = random.Random(5)
    sizes = [rng.randint(1, 64) for _ in range(400)]
    packed = packing.best_fit(sizes, 64)
    assert sorted(i for r in packed for i in r) == list(range(400)) and max(sum(sizes[i] for i in r) for r in packed) <= 64
    free, count = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            count += 1
            free.append(64 - s)
    assert len(packed) == count


def read(packed, length):
    parts, ids = collections.defaultdict(dict), []
    for r in packed.collect():
        row = np.frombuffer(bytes(r.ids), "<u2")
        assert len(row) == length and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert packing.positions(r.cu_seqlens, length)[r.position_resets].tolist() == [0] * len(r.position_resets)
        assert set(row[r.n_tokens :].tolist()) <= {packing.PAD}
        ids.append(r.row_id)
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[d].setdefault(p, []).append(row[a:b].tolist())
    assert len(set(ids)) == len(ids)
    return parts


def test_lossless_over_windows_and_partitions(spark, tmp_path):
    rng, tok = random.Random(1), bpe.bpe("byte_bpe_50k")
    texts = [*corpus(), *(words(rng, rng.choice([1, 9, 400])) for _ in range(120)), "long " * 20_000]
    docs = make(spark, texts).repartition(5)
    for window in (500, 4_000_000):
        packed = packing.pack(docs, length=64, window=window)
        packing.write_packed(packed, str(tmp_path / "out"))
        parts = read(spark.read.parquet(str(tmp_path / "out")), 64)
        for i, t in enumerate(texts):
            assert [x for p in sorted(parts[i]) for x in parts[i][p][0]] == np.frombuffer(tok.ids(t), "<i4").tolist()


def test_null_and_repeated_ids(spark):
    docs = make(spark, ["a b c", "a b c", "d", None], ids=[None, None, 3, 3])
    parts = read(packing.pack(docs, length=64), 64)
    assert len(parts[None][0]) == 2 and len(parts[3][0]) == 1
    assert packing.pack(make(spark, [])).collect() == []
