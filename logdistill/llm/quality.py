"""Quality rules with thresholds that adapt to each language and source.

Every document gets four base counts and four integer ratios. A sketch of each
ratio per (lang, source) gives quartiles; a document is rejected if a ratio lies
far outside its group's quartiles. The sketch is a log-linear histogram (as in
HDR histograms): integer buckets, 64 to each power of two, so relative error is
at most 1/64, sketches merge by adding counts, and the outcome doesn't depend on
the partitioning. Sketches of a language and of all documents are merged from
those of the groups. A group of n documents has fences of its own, of weight n,
drawn towards its language's with the weight ``PRIOR``, which are drawn towards all
documents' likewise: few documents say little, many decide, without a switch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logdistill.llm.common import cut, unused

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Documents that a parent's fences weigh as many as.
PRIOR = 50
#: Ratio: (SQL for its integer value, interquartile ranges allowed, slack in the ratio's unit, also a lower fence).
RATIOS = {
    "word_len": ("100 * word_chars div n_words", 4, 150, True),
    "symbols": ("1000 * n_symbols div n_words", 4, 200, False),
    "dup_lines": ("1000 * n_dup_lines div n_words", 4, 50, False),
    "repeats": ("1000 * n_repeat_words div n_words", 4, 150, False),
}
FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        *(T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ]
)
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1 for j in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of eight that occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        keys += codes[j : j + n] * _ODD[j]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    at = np.flatnonzero(np.isin(keys, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]  # the words themselves decide, not their hashes
    seen = Counter(windows)
    starts = np.array([i for i, w in zip(at, windows) if seen[w] > 1], dtype=np.int64)
    if not starts.size:
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text; a null text is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits bytes at exactly \x20 and \x09-\x0D
    chars = len(text) - sum(map(text.count, BLANK))
    lines = [x for x in text.split("\n") if x.strip(BLANK)] if "\n" in text else ()
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def features(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Base counts of each row of ``docs(doc_id, text, lang, source)``, and its columns ``carried``."""
    schema = T.StructType([*FEATURES, *(docs.schema[c] for c in carried)])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            counts = [base_counts(x if isinstance(x, str) else None) for x in pdf["text"]]
            out = pd.DataFrame(counts, columns=FEATURES.names[3:], dtype="int64")
            for c in ("doc_id", "lang", "source", *carried):
                out[c] = pdf[c].astype("Int64" if c == "doc_id" or c in carried else object).array
            yield out[schema.names]

    picked = docs.select(F.col("doc_id").cast("long"), "lang", "source", "text", *carried)
    return picked.mapInPandas(batches, schema)


def bucket_sql(v: str) -> str:
    """Bucket of a non-negative integer: below 128 itself, then 64 to each power of two."""
    s = f"greatest(length(bin({v})) - 7, 0)"
    return f"cast({s} * 64 + shiftright({v}, {s}) as int)"


def bucket_low_sql(b: str) -> str:
    """The smallest value of a bucket."""
    s = f"greatest({b} div 64 - 1, 0)"
    return f"shiftleft(cast({b} - {s} * 64 as bigint), {s})"


def with_verdict(feats: DataFrame) -> DataFrame:
    """Adds base_failed and kept. ``feats`` is read twice: cut it before.

    kept is false for base failures, else true unless a ratio lies beyond
    quartile + allowed interquartile ranges + slack of its group, drawn towards the
    language's and all documents'. Null languages and sources are groups of their own.
    """
    base = feats.withColumn(
        "base_failed",
        F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    )
    ratios = base.where("not base_failed").select(
        "lang", "source", *(F.expr(sql).alias(k) for k, (sql, *_) in RATIOS.items())
    )
    pairs = ", ".join(f"'{k}', {bucket_sql(k)}" for k in RATIOS)
    sketch = (
        ratios.select("lang", "source", F.expr(f"stack({len(RATIOS)}, {pairs}) as (ratio, bucket)"))
        .groupBy("lang", "source", "ratio", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = (
        sketch.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("lang", F.when(F.col("level") < 2, F.col("lang")))
        .withColumn("source", F.when(F.col("level") < 1, F.col("source")))
        .groupBy("level", "lang", "source", "ratio", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    group = "partition by level, lang, source, ratio"
    running = levels.selectExpr(
        "*", f"sum(n) over ({group} order by bucket) as upto", f"sum(n) over ({group}) as total"
    )
    quart = running.groupBy("level", "lang", "source", "ratio").agg(
        F.expr("min(case when 4 * upto >= total then bucket end)").alias("b1"),
        F.expr("min(case when 4 * upto >= 3 * total then bucket end)").alias("b3"),
        F.max("total").alias("total"),
    )
    q1, q3 = bucket_low_sql("b1"), bucket_low_sql("b3")
    k = "case ratio " + " ".join(f"when '{r}' then {k}" for r, (_, k, _, _) in RATIOS.items()) + " end"
    slack = "case ratio " + " ".join(f"when '{r}' then {s}" for r, (_, _, s, _) in RATIOS.items()) + " end"
    fences = quart.selectExpr(
        "level", "lang", "source", "ratio", "total",
        f"{q3} + ({k}) * ({q3} - {q1}) + {slack} as high", f"greatest({q1} - ({k}) * ({q3} - {q1}) - {slack}, 0) as low",
    )
    # Each group beside its language and the whole, by three keys: few rows, one for each group, level and ratio.
    places = fences.where("level = 0").selectExpr(
        "lang as g_lang", "source as g_source", "ratio as g_ratio",
        "explode(array(0, 1, 2)) as g_level", "lang as k_lang", "source as k_source",
    )
    places = places.withColumns({"k_lang": F.when(F.col("g_level") < 2, F.col("k_lang")), "k_source": F.when(F.col("g_level") < 1, F.col("k_source"))})
    met = places.join(fences, (F.col("g_level") == F.col("level")) & F.col("k_lang").eqNullSafe(F.col("lang")) & F.col("k_source").eqNullSafe(F.col("source")) & (F.col("g_ratio") == F.col("ratio")))
    at = {f"{c}{n}": F.max(F.when(F.col("level") == n, F.col(c))) for c in ("total", "high", "low") for n in range(3)}
    beside = met.groupBy("g_lang", "g_source", "ratio").agg(*(x.alias(name) for name, x in at.items()))
    drawn = beside.selectExpr("g_lang", "g_source", "ratio", *(f"{drawn_sql(side)} as {side}" for side in ("high", "low")))
    own = cut(
        drawn.groupBy("g_lang", "g_source").agg(
            *(F.max(F.when(F.col("ratio") == r, F.col("high"))).alias(f"{r}_high") for r in RATIOS),
            *(F.max(F.when(F.col("ratio") == r, F.col("low"))).alias(f"{r}_low") for r, x in RATIOS.items() if x[3]),
        )
    )
    inside = " and ".join(
        f"coalesce({sql} <= {r}_high" + (f" and {sql} >= {r}_low" if low else "") + ", true)"
        for r, (sql, _, _, low) in RATIOS.items()
    )
    joined = base.join(own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return joined.select(*feats.columns, "base_failed", F.expr(f"case when base_failed then false else {inside} end").alias("kept"))


def drawn_sql(side: str, div: str = "div") -> str:
    """A fence of level 0 drawn towards that of level 1, itself drawn towards that of level 2; all are whole numbers of 0 at least."""
    language = f"((total1 * {side}1 + {PRIOR} * {side}2) {div} (total1 + {PRIOR}))"
    return f"((total0 * {side}0 + {PRIOR} * {language}) {div} (total0 + {PRIOR}))"


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, the base counts, base_failed, kept, lang, source.

    Null or blank texts have no words and fail. Repeated rows and ids are each
    judged; extra columns are ignored; an empty table gives an empty result.
    """
    told = with_verdict(cut(features(docs)))
    return told.select("doc_id", *FEATURES.names[3:], "base_failed", "kept", "lang", "source")


def filter_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    Each row has its own verdict, which its text, language and source decide: rows
    with a null id are judged like others, and of several rows of an id only those
    rejected go. Copies of a text in one group fare alike.
    """
    # Two hashes of the text and its length: 160 bits, so that the texts needn't be carried.
    def named(x: DataFrame) -> list[Column]:
        return [x["doc_id"].cast("long"), x["lang"], x["source"], *(F.xxhash64(F.lit(seed), x["text"]) for seed in (1, 2)), F.length(x["text"])]

    names = [unused(docs.columns, f"kept_{i}") for i in range(6)]
    with_hash = docs.select("doc_id", "lang", "source", "text", *(x.alias(n) for x, n in zip(named(docs)[3:], names[3:])))
    told = with_verdict(cut(features(with_hash, tuple(names[3:])))).where("kept")
    kept = told.select(F.col("doc_id").alias(names[0]), F.col("lang").alias(names[1]), F.col("source").alias(names[2]), *names[3:]).distinct()
    same = [a.eqNullSafe(kept[n]) for a, n in zip(named(docs), names)]
    return docs.join(kept, reduce(and_, same), "left_semi")


def oracle() -> str:
    """DuckDB SQL for ``quality_rules`` over ``documents``."""

    def div(sql: str) -> str:
        return sql.replace("div", "//")

    bucket = "greatest(length(bin(v)) - 7, 0) * 64 + (v >> cast(greatest(length(bin(v)) - 7, 0) as int))"
    low = "((({b}) - greatest(({b}) // 64 - 1, 0) * 64) << cast(greatest(({b}) // 64 - 1, 0) as int))"
    q1, q3 = low.format(b="b1"), low.format(b="b3")
    k = "case ratio " + " ".join(f"when '{r}' then {k}" for r, (_, k, _, _) in RATIOS.items()) + " end"
    slack = "case ratio " + " ".join(f"when '{r}' then {s}" for r, (_, _, s, _) in RATIOS.items()) + " end"
    each = " union all ".join(f"select lang, source, '{r}' as ratio, {div(sql)} as v from base where not base_failed" for r, (sql, *_) in RATIOS.items())

    def bound(r: str, side: str, op: str) -> str:
        return f"coalesce({div(RATIOS[r][0])} {op} (select f.{side} from drawn f where f.ratio = '{r}' and f.lang is not distinct from b.lang and f.source is not distinct from b.source), true)"

    inside = " and ".join([bound(r, "high", "<=") for r in RATIOS] + [bound(r, "low", ">=") for r, x in RATIOS.items() if x[3]])
    return rf"""
    with w as (
      select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    windows as (
      select doc_id, i, array_to_string(words[i : i + 7], ' ') as win
      from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
    again as (
      select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1),
    covered as (
      select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from again) group by doc_id),
    lines as (
      select doc_id, count(*) - count(distinct l) as n
      from (select doc_id, unnest(string_split(t, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
    counts as (
      select w.doc_id, lang, source, len(words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
        coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
      from w left join lines using (doc_id) left join covered using (doc_id)),
    base as (
      select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counts),
    ratios as ({each}),
    sketch as (
      select lang, source, ratio, {bucket} as bucket, count(*) as n from ratios group by all),
    levels as (
      select 0 as level, lang, source, ratio, bucket, sum(n) as n from sketch group by all
      union all select 1, lang, null, ratio, bucket, sum(n) from sketch group by all
      union all select 2, null, null, ratio, bucket, sum(n) from sketch group by all),
    running as (
      select *, sum(n) over (partition by level, lang, source, ratio order by bucket) as upto, sum(n) over (partition by level, lang, source, ratio) as total from levels),
    quart as (
      select level, lang, source, ratio, min(case when 4 * upto >= total then bucket end) as b1, min(case when 4 * upto >= 3 * total then bucket end) as b3, max(total) as total
      from running group by all),
    fences as (
      select level, lang, source, ratio, total, {q3} + ({k}) * ({q3} - {q1}) + {slack} as high, greatest({q1} - ({k}) * ({q3} - {q1}) - {slack}, 0) as low from quart),
    beside as (
      select g.lang, g.source, g.ratio, g.total as total0, l.total as total1, g.high as high0, l.high as high1, a.high as high2, g.low as low0, l.low as low1, a.low as low2
      from fences g join fences l on l.level = 1 and l.ratio = g.ratio and l.lang is not distinct from g.lang join fences a on a.level = 2 and a.ratio = g.ratio where g.level = 0),
    drawn as (
      select lang, source, ratio, {drawn_sql("high", "//")}::bigint as high, {drawn_sql("low", "//")}::bigint as low from beside)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      case when base_failed then false else {inside} end as kept, lang, source
    from base b"""
