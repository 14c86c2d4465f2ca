"""Each stage of the pipeline on its own input, against the plain versions that the operators' tests have."""

import collections
import random

import corpus_pipeline
from logdistill.llm import mixing, secret_entropy, unigram

import test_mixing
import test_near_duplicates
import test_quality
import test_secrets
from helpers import make, words


def texts():
    rng = random.Random(6)
    out = [words(rng, 50) for _ in range(80)]
    out += [out[0], " ".join([*out[1].split()[:-1], "changed"]), "short", None, "", f"{words(rng, 40)} token = a8Kf03LmQz9PwX7rT2vBn5Yc {words(rng, 5)}"]
    return out + [" ".join("#" + w for w in words(rng, 50).split())] + [words(rng, 3000)]


def table(spark):
    data = make(spark, texts()[:50]).unionByName(make(spark, texts()[50:], "fr", "src2", ids=range(50, len(texts()))))
    return data.unionByName(make(spark, ["no id " + words(random.Random(1), 40)] * 2, None, None, ids=[None, None]))


def as_rows(df):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_stages(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sf = docs.columns, str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    before = list(as_rows(docs).elements())

    kept = stages["quality_rules"](spark, docs, sf)
    verdict = test_quality.verdicts([(lang, source, t) for _, t, lang, source in before])
    want = collections.Counter(r for r, k in zip(before, verdict) if k)
    assert as_rows(kept) == want and kept.columns == columns and len(before) > sum(want.values()) > 70

    unique = stages["near_dedup"](spark, kept, sf)
    with_id = sorted(r for r in want.elements() if r[0] is not None)
    component, _ = test_near_duplicates.plain([r[1] for r in with_id])
    want = collections.Counter({r: 1 for i, r in enumerate(with_id) if component[i] == i}) + collections.Counter(r for r in want.elements() if r[0] is None)
    assert as_rows(unique) == want and unique.columns == columns and (80, *with_id[0][1:]) not in want

    masked = stages["secret_scan"](spark, unique, sf)
    plain = collections.Counter()
    for i, t, lang, source in want.elements():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in [*test_secrets.base(t).split(","), *test_secrets.entropy(t)] if s)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + secret_entropy.MASK
            at = max(at, b)
        plain[i, out + t[at:], lang, source] += 1
    assert as_rows(masked) == plain and masked.columns == columns and plain != want

    mixed = stages["mix_sources"](spark, masked, sf)
    domain = {"src1": "d1", "src2": "d2", None: "d0"}
    chosen = test_mixing.chosen([(i, domain[source], lang, source, len(t.split())) for i, t, lang, source in plain.elements()], mixing.SHARE, mixing.WEIGHTS, mixing.EPOCHS)
    want = collections.Counter()
    for i, t, lang, source in plain.elements():
        want[i, t, lang, source] += chosen.get((i, (domain[source], lang, source)), 0)
    assert as_rows(mixed) == +want and mixed.columns == columns

    encoded = stages["encode_pieces"](spark, mixed, sf).collect()
    model = unigram.Unigram.load()
    assert collections.Counter((r.doc_id, model.decode(r.ids)) for r in encoded) == collections.Counter((i, t) for i, t, *_ in (+want).elements())
    assert sum(len(r.ids) for r in encoded) == sum(len(model.viterbi(w)) for _, t, *_ in (+want).elements() for w in model._words(t))

    whole = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in whole) == collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded)


def test_empty_table(spark, tmp_path):
    make(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
