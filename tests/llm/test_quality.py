"""Base counts and adaptive verdicts against plain Python."""

import collections
import random
import re

from logdistill.llm import quality

from helpers import CLASHING, corpus, make, rows, words


def test_base_counts():
    for t in [*corpus(), "a b c d e f g h " * 3, "#a\n#a\n\n \n|x", "x y z  \x0b q " * 20, "w " * 30_000]:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert quality.base_counts(t) == want


def low(v):
    """The smallest value of a value's bucket."""
    s = max(v.bit_length() - 7, 0)
    return v >> s << s


def fences(values, k, slack):
    values = sorted(map(low, values))
    q1, q3 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
    return q3 + k * (q3 - q1) + slack, max(q1 - k * (q3 - q1) - slack, 0)


def verdicts(docs):
    """docs: (lang, source, text)."""
    feats = []
    for lang, source, t in docs:
        n, chars, symbols, dup, rep = quality.base_counts(t)
        failed = n < 20 or 100 * rep > 30 * n
        feats.append((lang, source, failed, None if failed else {"word_len": 100 * chars // n, "symbols": 1000 * symbols // n, "dup_lines": 1000 * dup // n, "repeats": 1000 * rep // n}))
    good = [f for f in feats if not f[2]]
    out = []
    for lang, source, failed, v in feats:
        keep = not failed
        for r, (_, k, slack, lower) in quality.RATIOS.items() if keep else ():
            groups = [[g[3][r] for g in good if g[:2] == (lang, source)], [g[3][r] for g in good if g[0] == lang], [g[3][r] for g in good]]
            n0, n1 = len(groups[0]), len(groups[1])
            for side in (0, 1) if lower else (0,):
                f0, f1, f2 = (fences(g, k, slack)[side] for g in groups)
                f1 = (n1 * f1 + quality.PRIOR * f2) // (n1 + quality.PRIOR)
                f = (n0 * f0 + quality.PRIOR * f1) // (n0 + quality.PRIOR)
                keep = keep and (v[r] >= f if side else v[r] <= f)
        out.append(keep)
    return out


def sample():
    rng, docs = random.Random(11), []
    for lang, source, n, size in (("en", "a", 150, 1), ("en", "b", 40, 4), ("fr", "a", 5, 1), (None, None, 30, 2), ("fr", None, 1, 3)):
        for i in range(n):
            ws = [w * size for w in words(rng, 40).split()]
            ws = ["#" + w if rng.random() < (0.9 if i % 17 == 3 else 0.02 * size) else w for w in ws]
            lines = [" ".join(ws[k : k + 5]) for k in range(0, 40, 5)]
            docs.append((lang, source, "\n".join(lines + lines[: i % 5 // 4])))
    return docs + [("en", "a", None), ("xx", "only", "few words"), ("en", "a", docs[0][2]), ("en", "b", "x" * 300 + " y" * 30 + " z" * 3)]


def table(spark, docs, ids):
    return spark.createDataFrame([(i, *d, *CLASHING) for i, d in zip(ids, docs)], "doc_id long, lang string, source string, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def test_verdicts_of_groups_that_decide(spark):
    docs = sample()
    want = verdicts(docs)
    got = rows(quality.quality_rules(table(spark, docs, range(len(docs)))))
    assert [got[i]["kept"] for i in range(len(docs))] == want
    assert 10 < sum(not k for k in want) < 60
    assert list(got[0]) == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source"]


def test_each_row_has_its_own_verdict(spark):
    """Null and repeated ids."""
    docs = sample()
    ids = [None if i % 7 == 0 else i % 20 for i in range(len(docs))]
    data = table(spark, docs, ids)
    kept = quality.filter_documents(data)
    want = collections.Counter((i, *d) for i, d, k in zip(ids, docs, verdicts(docs)) if k)
    assert collections.Counter((r.doc_id, r.lang, r.source, r.text) for r in kept.collect()) == want
    assert kept.columns == data.columns
    assert quality.quality_rules(make(spark, [])).collect() == [] and quality.filter_documents(make(spark, [])).collect() == []
