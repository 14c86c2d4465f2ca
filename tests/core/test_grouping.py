"""Logical lines against a plain loop: caps by lines and bytes, and the mode that follows the top source."""

import random

import pytest
from pyspark.sql import functions as F

from logdistill.functions import lines as L
from logdistill.operators.catalog import MODES
from logdistill.operators.grouping import RULES
from logdistill.plans import distill as P
from logdistill.sources import lines as S

KNOWN = {"pytest": ["pytest"], "junit": ["junit"], "go-test": ["go test"], "nginx": ["nginx"]}


def plain(texts, goes, mode):
    """(stream, first line, n, text) of each group; ``goes`` maps (line, rule) to whether it goes on the one before."""
    found = []
    for stream, values in texts.items():
        now, counts, group = "auto" if mode == "auto-source" else mode, {}, []

        def close():
            found.append((stream, group[0][0], len(group), "\n".join(v for _, v in group)))

        for no, v in enumerate(values):
            rule = now if now in RULES else "plain"
            if group and now != "off" and goes[v, rule] and len(group) < 200 and sum(len(x.encode()) for _, x in group) < 200_000:
                group.append((no, v))
                continue
            if group:
                close()
                for s, markers in KNOWN.items():
                    if any(m in x.lower() for _, x in group for m in markers):
                        counts[s] = counts.get(s, 0) + 1
                if mode == "auto-source":
                    best = sorted(counts, key=lambda s: (-counts[s], s))
                    now = MODES.get(best[0], "off") if best else "off"
            group = [(no, v)]
        if group:
            close()
    return sorted(found)


@pytest.mark.parametrize("mode", ["auto-source", "auto", "python", "java", "go"])
def test_groups(spark, mode):
    rng = random.Random(mode)
    pool = ["plain", "  more", "\tat x", "Caused by: y", "goroutine 1 [run]:", "created by z", "PyTest ran", "JUnit ran", "go test ran", "nginx up", "    [x", "", "  pytest"]
    texts = {f"s{i}": [rng.choice(pool) for _ in range(rng.randint(1, 80))] for i in range(30)}
    texts["many"] = ["a", *["\tb"] * 450, "c", "  d"]
    texts["wide"] = ["pytest", "x", *[f"\t{'é' * 30_000}{i}" for i in range(9)], "y", "\tz", "\t" + "w" * 250_000, "\tv", "end"]
    texts["first"] = ["\tgoes on nothing"]
    rows = [(s, i, v) for s, vs in texts.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "stream_id string, line_no long, value string")
    told = df.select("value", *(L.continues(F.col("value"), r).alias(r) for r in RULES)).distinct().collect()
    goes = {(r.value, k): r[k] for r in told for k in RULES}
    got = P.group_lines(df, mode, KNOWN).collect()
    assert sorted((r.stream_id, r.line_no, r.n_lines, r.value) for r in got) == plain(texts, goes, mode)


def test_auto_source_in_a_run(spark):
    text = "pytest session\n[ERROR] test_a failed\n  File x\n[ERROR] test_b failed\n  File y\n"
    o = P.Options(multiline="auto-source", dedupe=False)
    out = [r.text for r in P.reduce_lines(S.from_strings(spark, {"s": text}), o).orderBy("out_no").collect()]
    assert "[ERROR] test_a failed\n  File x" in out and "[ERROR] test_b failed\n  File y" in out
    assert P.report(S.from_strings(spark, {"s": text}), o).first().detected_sources[:1] == ["pytest"]


def test_no_lines(spark):
    none = spark.createDataFrame([], "stream_id string, line_no long, value string")
    assert all(P.group_lines(none, m).count() == 0 for m in ("off", "auto", "auto-source"))
