"""Secret scans with DataFrame functions only.

Base kinds are regular expressions over the whole text. The entropy kind slides
a window over every long token and tracks the Shannon entropy of its characters
by incremental counts: a step changes the counts of two characters only. Each
character class (hex, wider alphabet) has its own threshold, and an allow-list
suppresses tokens that look random but aren't secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import unused

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6
WINDOW = 20
#: Bits per character that a window must reach.
HEX_BITS, WIDE_BITS = 3.0, 3.6
#: Tokens of these forms are never entropy secrets: all digits; no digit; UUID; words joined by - or _; paths of plain words; examples.
ALLOW = [
    r"^[0-9_=+/-]+$",
    r"^[^0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^([A-Za-z]+|[0-9]+)([-_/=]+([A-Za-z]+|[0-9]+))*[-_/=]*$",
    r"[eE][xX][aA][mM][pP][lL][eE]|[dD][uU][mM][mM][yY]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]",
]
#: c * log2(c), in millionths, for c characters of one kind in a window.
PARTS = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 1)]
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"


def _limit(bits: float) -> int:
    """The largest sum of PARTS of a window of so many bits: H = log2(w) - sum / w."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(lengths: Column, block: int = 256) -> Column:
    """Inclusive running sums of a non-empty int array, in two levels so that the work for n entries is about n * block, never n * n."""

    def sums(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(xs))

    def add_up(blocks: Column) -> Column:
        starts = F.aggregate(
            F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)),
            F.array(F.lit(0)),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), sums))

    def in_blocks(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))
        return let(F.transform(numbers, lambda b: F.slice(xs, b * block + 1, F.lit(block))), add_up)

    return let(lengths, in_blocks)


NO_SPANS = "array<struct<start:int,end:int,word:string>>"


def _found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array<struct<start, end, word>>, in code points; empty where there is none."""
    none = F.array().cast(NO_SPANS)

    def spans(words: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(words))
        steps = F.zip_with(pieces, words, lambda p, w: F.length(p) + F.length(w))
        ends = running_sums(steps)
        placed = F.zip_with(ends, words, lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("end"), w.alias("word")))
        return F.when(F.size(words) > 0, placed).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def lowest_window(word: Column) -> Column:
    """The smallest sum of PARTS over the word's windows, that is, of the most even window.

    The state holds the count of each of the word's own characters; a step takes
    one character out and another in, and changes the sum by those two counts.
    """
    parts = F.array(*(F.lit(x) for x in PARTS))

    def f(c: Column) -> Column:
        return F.element_at(parts, c + 1)

    def slide(codes: Column) -> Column:
        head = F.slice(codes, F.lit(1), F.lit(WINDOW))
        counts = F.transform(F.sequence(F.lit(1), F.array_max(codes)), lambda k: F.size(F.filter(head, lambda c: c == k)))

        def begin(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0), lambda a, c: a + f(c))
            return F.struct(counts.alias("counts"), total.alias("sum"), total.alias("low"))

        def swap(s: Column, out: Column, come: Column) -> Column:
            n_out, n_in = F.element_at(s["counts"], out), F.element_at(s["counts"], come)
            now = s["sum"] + f(n_out - 1) - f(n_out) + f(n_in + 1) - f(n_in)
            moved = F.transform(s["counts"], lambda c, k: c - (k + 1 == out).cast("int") + (k + 1 == come).cast("int"))
            return F.struct(moved.alias("counts"), now.alias("sum"), F.least(s["low"], now).alias("low"))

        def step(s: Column, i: Column) -> Column:
            out, come = F.element_at(codes, i - WINDOW), F.element_at(codes, i)
            return F.when(out == come, s).otherwise(swap(s, out, come))

        steps = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(WINDOW + 1), F.size(codes))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, let(counts, begin), step, lambda s: s["low"])

    def coded(chars: Column) -> Column:
        kinds = F.array_distinct(chars)
        return let(let(kinds, lambda ks: F.transform(chars, lambda c: F.array_position(ks, c).cast("int"))), slide)

    return let(F.split(word, ""), coded)


def _random(word: Column) -> Column:
    allowed = F.lit(False)
    for rx in ALLOW:
        allowed = allowed | word.rlike(rx)
    limit = F.when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(_limit(HEX_BITS))).otherwise(F.lit(_limit(WIDE_BITS)))
    return F.when(allowed, F.lit(False)).otherwise(lowest_window(word) <= limit)


def find_secrets(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """Adds a column, by default ``secrets``, in place of one of that name: array<struct<start, kind_no, kind, end>>, ordered by start, then kind as in KINDS.

    Offsets count code points, ends are exclusive. A null or empty text has none.
    Works on each row alone: repeated rows, ties and extra columns change nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(NO_SPANS)
    # Cheap tests that every match passes go before the expressions.
    named_key = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named_key = named_key | F.contains(F.lower(t), F.lit(word))
    long_word = t.rlike(CANDIDATE)
    # The value's length counts, without the name before it.
    assign = F.filter(_found(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["word"], ASSIGN, 2)) >= MIN_VALUE)
    wide = F.filter(_found(t, CANDIDATE), lambda x: _random(x["word"]))
    kinds = [
        F.when(named_key, assign).otherwise(none),
        F.when(F.contains(t, F.lit("AKIA")), _found(t, ACCESS)).otherwise(none),
        F.when(long_word, _found(t, HEX)).otherwise(none),
        F.when(long_word, wide).otherwise(none),
    ]

    def named(i: int, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), F.lit(KINDS[i]).alias("kind"), x["end"].alias("end")),
        )

    return docs.withColumn(secrets, F.array_sort(F.concat(*(named(i, s) for i, s in enumerate(kinds)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: n_assign, n_access, n_hex, n_entropy, base_sha256, spans. Null and empty texts have none; null and repeated ids come back as they are; an empty table gives an empty result."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    s = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base = F.filter(s, lambda x: x["kind_no"] < 3)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("spans"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` put as ``[SECRET]``; n_chars, where there is one, follows. Other texts stay as they are, null ones too; each row is read on its own, so null and repeated ids and extra columns stay; an empty table gives an empty result."""
    name = unused(docs.columns, "secrets")
    found = find_secrets(docs, secrets=name)
    s, t = F.col(name), F.col("text")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        apart = F.concat(acc["out"], t.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when((x["start"] >= acc["at"]), apart).otherwise(acc["out"]).alias("out"),
        )

    new = F.aggregate(s, first, step, lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))))
    out = found.withColumn("text", F.when(F.size(s) > 0, new).otherwise(t))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(s) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def oracle() -> str:
    """DuckDB SQL for ``scan`` over ``documents``."""

    def found(kind: int, rx: str, keep: str) -> str:
        rx = rx.replace("'", "''")
        return f"""
        select doc_id, {kind} as no, '{KINDS[kind]}' as kind, e - length(word) as s, e, word from (
          select doc_id, words[i] as word, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + list_sum(list_transform(words[1:i], lambda w: length(w))) as e
          from (select doc_id, words, pieces, unnest(range(1, len(words) + 1)) as i from (
            select doc_id, regexp_extract_all(t, '{rx}') as words, string_split_regex(t, '{rx}') as pieces from d))) where {keep}"""

    allow = " or ".join(f"regexp_matches(word, '{rx}')" for rx in ALLOW)
    parts = "[" + ", ".join(map(str, PARTS)) + "]"
    total = f"list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: ({parts})[{WINDOW} - length(replace(w, c, '')) + 1]))"
    low = f"list_min(list_transform(list_transform(range(1, length(word) - {WINDOW - 2}), lambda k: substr(word, k, {WINDOW})), lambda w: {total}))"
    enough = f"{low} <= case when regexp_matches(word, '^([0-9a-f]+|[0-9A-F]+)$') then {_limit(HEX_BITS)} else {_limit(WIDE_BITS)} end"
    value = ASSIGN.replace("'", "''")
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    spans as ({" union all ".join([
        found(0, ASSIGN, f"length(regexp_extract(word, '{value}', 2)) >= {MIN_VALUE}"), found(1, ACCESS, "true"),
        found(2, HEX, "true"), found(3, CANDIDATE, f"not ({allow}) and {enough}")])}),
    per as (
      select doc_id, count(*) filter (where no = 0) as n_assign, count(*) filter (where no = 1) as n_access,
        count(*) filter (where no = 2) as n_hex, count(*) filter (where no = 3) as n_entropy,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, no) filter (where no < 3) as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, no) as spans
      from spans group by doc_id)
    select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
      coalesce(n_entropy, 0)::bigint as n_entropy, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join per using (doc_id)"""
