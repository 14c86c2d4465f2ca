"""Sources, their boosts, explanations and what tells a pasted log, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from logdistill.functions.rx import java
from logdistill.operators import catalog, detection
from logdistill.operators.kernel import Options
from logdistill.plans import distill as P
from logdistill.sources import config

LINES = "stream_id string, line_no long, value string"


def stream(spark, values, name="s"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], LINES)


def test_tables_fit_together():
    assert set(catalog.MODES.values()) <= {"python", "node", "java", "go", "rust"}
    assert len(set(catalog.BOOSTS) - set(catalog.CATALOG)) <= 2  # sources that no marker names
    for patterns in catalog.BOOSTS.values():
        for p, f in patterns:
            re.compile(p)
            assert java(p, f)


def test_boosts_against_running_confidence(spark):
    rng = random.Random(3)
    markers = {"one": ["abc"], "two": ["long marker here", "xy"], "none": ["zzz"]}
    boosts = {"one": [(r"\bhit\b", "")], "two": [(r"^HIT", "i")], "other": [(".", "")]}
    values = [" ".join(rng.choice(["abc", "xy", "hit", "long marker here", "w", "w", "w"]) for _ in range(rng.randint(1, 3))) for _ in range(40)]
    values += ["w"] * 220 + ["abc hit", "hit", "hit abc", "Hit"] + values
    lines = stream(spark, values).unionByName(stream(spark, ["hit", "hit"], "t")).withColumn("n_lines", F.lit(1))
    got = {(r.stream_id, r.line_no): r.source_boost for r in detection.boosted(lines, "value", markers, boosts).collect()}
    sure = {"one": 0, "two": 0}
    for i, v in enumerate(values):
        for s in sure:
            sure[s] += next((detection.marker_weight(m) for m in markers[s] if m in v.lower()), 0)
        need = 4 if i + 1 < 50 else 6 if i + 1 < 200 else 12
        hit = sure["one"] >= need and re.search(r"\bhit\b", v) or sure["two"] >= need and re.match("hit", v, re.I)
        assert got["s", i] == (40 if hit else 0), (i, v)
    assert got["t", 0] == 0


def test_custom_sources(spark):
    o = config.options(config.parse("sources:\n  - name: mine\n    markers:\n      - acmeflow\n  - name: pytest\n    markers: [checksuite]\n"), Options(sources={"mine": ["acme2"]}))
    assert o.sources == {"mine": ["acmeflow", "acme2"], "pytest": ["checksuite"]}
    lines = stream(spark, ["AcmeFlow started", "acme2 x", "checksuite run", "E   bad value", "fine"])
    told = P.report(lines, o).collect()[0]
    assert told.detected_sources == ["mine", "pytest"]
    scores = {r.line_no: r.extra for r in P.scored(lines, o).collect()}
    assert scores[3] == 40 and scores[4] == 0
    assert {r.line_no: r.extra for r in P.scored(lines, Options()).collect()}[3] == 0


def test_explain_alone(spark):
    lines = stream(spark, ["[ERROR] Error: x", "plain words", "", "[DEBUG] y", "custom thing"])
    o = Options(diagnostics=["custom"])
    got = {r.line_no: r.x for r in lines.select("line_no", P.explain_line(F.col("value"), o).alias("x")).collect()}
    assert [got[i].reason for i in range(5)] == ["hard-keep", "low-score", "empty", "ignored-tag", "hard-keep"]
    assert [got[i].kept for i in range(5)] == [True, False, False, False, True] and got[4].score == got[1].score + 50


def test_paste(spark):
    def told(values):
        r = P.paste_signals(stream(spark, values)).collect()[0]
        return r.score, r.is_log

    frames = ["at Service.load(a)", "at Service.load(b)", "at Service.load(c)"]
    assert told([*frames, "x", "y"]) == (2, True)
    assert told([*frames[:2], "x", "y", "z"]) == (1, False)
    assert told(frames) == (2, False)
    assert told(["2024-01-01 10:00 x", "10:00:00.123 y", "ERROR: a", " WARNING: b", "z"]) == (3, True)
    assert told(["word"] * 9) == (0, False)


def test_limits_and_estimates(spark):
    lines = stream(spark, [f"[ERROR] Error number {w}" for w in ("one", "two", "three", "four")])
    told = [r for r in P.decisions(lines, Options(sample_size=1, dedupe=False)).collect() if r.reason == "sample-limit"]
    assert [r.sanitized for r in told] == [f"[ERROR] Error number {w}" for w in ("two", "three", "four")]
    kept = P.reduce_lines(lines, Options(max_tokens=20, dedupe=False), estimate=lambda t: 10).collect()
    assert [r.tokens for r in kept] == [10, 10]


def test_flags_of_custom_masks(spark):
    from logdistill.functions import masks as M

    df = spark.createDataFrame([("a\nfoo x\nfoo",)], "v string")
    say = lambda p, by, f: df.select(M.custom_mask(F.col("v"), p, by, f)).first()[0]
    assert say("^foo", "bar", "gm") == "a\nbar x\nbar" and say("^foo", "bar", "m") == "a\nbar x\nfoo" and say("^foo", "bar", "g") == "a\nfoo x\nfoo"
    assert say("x.foo$", "!", "gs") == "a\nfoo !" and say("x.foo$", "!", "g") == "a\nfoo x\nfoo" and say("x$", "!", "gm") == "a\nfoo !\nfoo"


def test_window_plan_warns_of_an_open_block(spark):
    lines = stream(spark, ["[ERROR] Error: x", "-----BEGIN RSA PRIVATE KEY-----", "secret", "more"]).unionByName(stream(spark, ["-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "[ERROR] y"], "t"))
    o = Options(aggressiveness="high")
    windows = [(r.stream_id, r.text) for r in P.reduce_by_windows(lines, o).orderBy("stream_id", "line_no").collect()]
    fold = [(r.stream_id, r.text) for r in P.reduce_lines(lines, o).orderBy("stream_id", "out_no").collect()]
    assert sorted(windows) == sorted(fold) and [t for s, t in windows if s == "s"][-1].startswith("[PEM block unterminated")
