"""The whole reduction of ordered lines: columns that a row decides alone, one
shuffle by stream, then either windows (static levels) or the fold (all options)."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logdistill.functions import lines as L
from logdistill.functions import masks as M
from logdistill.functions.rx import apart, is_blank, matches, words
from logdistill.operators import detection
from logdistill.operators.grouping import CUT, GROUP_BYTES, GROUP_LINES, RULES, cutter, rule_of
from logdistill.operators.kernel import HIDDEN, TOP, UNTERMINATED, Options, Reducer

SCORED = (
    "stream_id string, line_no long, value string, n_lines int, words long, bytes long, reason string, truncated boolean, fmt string, sanitized string, "
    "pem string, internal boolean, stack_key string, score double, json_score int, quiet_warn boolean, notice boolean, quiet_path string, extra double"
)
OUTPUT = "stream_id string, out_no long, text string, score double, tokens long"
DECISIONS = "stream_id string, seq long, line_no long, sanitized string, reason string, kept boolean, dropped boolean, hard_keep boolean, repeated boolean, score double"
COUNTERS = "input_lines output_lines input_words output_words input_bytes output_bytes dropped_lines duplicate_lines hidden_internal_stack_lines truncated_lines".split()
REPORT = "stream_id string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", detected_format string, own_input_tokens long, own_output_tokens long"


def group_lines(lines: DataFrame, mode: str = "off", known: dict[str, list[str]] = detection.CATALOG) -> DataFrame:
    """Logical lines: a line and those that go on it, up to GROUP_LINES lines, none added at GROUP_BYTES or more. Adds n_lines.

    An island's number is a running count of lines that begin one; longer islands
    are cut every GROUP_LINES lines. Islands of GROUP_BYTES or more are cut by one
    pass over their lines, which reads the same shuffle. ``auto-source`` takes such
    a pass over all lines: the top source among ``known`` so far chooses the rule.
    """
    if mode == "off":
        return lines.select("stream_id", "line_no", "value", F.lit(1).alias("n_lines"))
    v = F.col("value")
    size = F.coalesce(F.octet_length(v), F.lit(0)).alias("bytes")
    if mode == "auto-source":
        bits = (F.when(L.continues(v, r), rule_of(r)).otherwise(0) for r in RULES)
        flat = lines.select("stream_id", "line_no", F.coalesce(v, F.lit("")).alias("value"), size, reduce(add, bits).alias("goes"), detection.named(v, known).alias("sources"))
        return flat.repartition("stream_id").sortWithinPartitions("stream_id", "line_no").mapInPandas(cutter(list(known)), CUT)
    w = Window.partitionBy("stream_id").orderBy("line_no")
    begins = ~L.continues(v, mode)
    islands = lines.select("stream_id", "line_no", "value", size).withColumn("island", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy("stream_id", "island")
    placed = islands.withColumn("place", F.row_number().over(one.orderBy("line_no")) - 1).withColumn("total", F.sum("bytes").over(one))
    cut = placed.where(F.col("total") < GROUP_BYTES).withColumn("part", F.floor(F.col("place") / GROUP_LINES))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    grouped = cut.groupBy("stream_id", "island", "part").agg(rows.alias("rows")).select(
        "stream_id",
        F.col("rows")[0]["line_no"].alias("line_no"),
        F.array_join(F.transform("rows", lambda x: x["value"]), "\n").alias("value"),
        F.size("rows").alias("n_lines"),
    )
    large = placed.where(F.col("total") >= GROUP_BYTES).select(
        "stream_id", "line_no", F.coalesce(v, F.lit("")).alias("value"), "bytes", (F.col("place") > 0).cast("int").alias("goes"), F.array().cast("array<int>").alias("sources")
    )
    return grouped.unionByName(large.sortWithinPartitions("stream_id", "line_no").mapInPandas(cutter(), CUT))


def drop_reason(raw: Column, line: Column, o: Options) -> Column:
    """First predicate that drops a line, or null; ``raw`` is the line before truncation."""
    out = F.when(is_blank(raw), "empty")
    if o.include:
        out = out.when(~matches(raw, o.include), "include-filter")
    if o.exclude:
        out = out.when(matches(raw, o.exclude), "exclude-filter")
    for p in o.ignores:
        out = out.when(matches(line, p), "custom-ignore")
    if o.severity:
        out = out.when(L.below_severity(line, o.severity), "severity")
    out = out.when(L.is_ci_noise(line), "ci-noise").when(L.is_progress(line), "progress")
    out = out.when(L.is_access_noise(line), "ci-noise").when(L.is_ignored(line), "ignored-tag")
    return out.when(L.is_cascade(line), "cascade") if o.root_cause else out


def catalog(o: Options) -> dict[str, list[str]]:
    return detection.merged(detection.CATALOG, o.sources)


def spread(lines: DataFrame) -> DataFrame:
    """Lines dealt evenly over the tasks, for what costs more than to move them: a table can be few files or row groups, and a stream can be most of it."""
    return lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id", "line_no").select("stream_id", "line_no", "value")


def scored(lines: DataFrame, o: Options, sources: bool = True) -> DataFrame:
    """What a row decides alone, and the boost of active sources; dropped rows stay, with their reason."""
    df = group_lines(spread(lines) if sources and o.multiline == "off" else lines, o.multiline, catalog(o)).withColumn("words", words(F.col("value"))).withColumn("bytes", F.octet_length("value").cast("long") + 1)
    raw, most = F.col("value"), max(1, int(o.max_line_length))
    df = df.withColumn("truncated", F.length(raw) > most)
    df = df.withColumn("shown", F.when(F.col("truncated"), F.concat(F.substring(raw, 1, most), F.lit("… [truncated]"))).otherwise(raw))
    line = F.col("shown")
    df = df.withColumn("reason", apart(drop_reason(raw, line, o))).withColumn("fmt", L.detect_format(raw))
    pem = F.when(matches(line, M.PEM_HEADER), "header").when(matches(line, M.PEM_FOOTER), "footer")
    masked = M.sanitize(line, o.keep_id_suffix)
    for pattern, by, flags in o.sanitizers:
        masked = M.custom_mask(masked, pattern, by, flags)
    df = df.withColumn("pem", F.when(F.col("reason").isNull(), pem)).withColumn("clean", apart(F.when(F.col("reason").isNull(), masked)))
    clean = F.col("clean")
    inner = L.is_internal_frame(clean)
    for p in o.internals:
        inner = inner | matches(clean, p)
    df = df.withColumn("internal", apart(F.coalesce(inner, F.lit(False))))
    df = df.withColumn("sanitized", F.when(~F.col("internal"), M.frame_numbers(clean)).otherwise(clean))
    s = F.col("sanitized")
    extra = F.lit(0.0)
    if o.diagnostics:
        extra = extra + F.when(L.any_of(s, [(p, "") for p in o.diagnostics]), 50.0).otherwise(0.0)
    if o.multilingual:
        extra = extra + F.when(L.is_foreign_diagnostic(s), 50.0).otherwise(0.0)
    hit = L.access_log(s)
    df = df.withColumn("score", apart(F.when(F.col("reason").isNull(), L.base_score(s))))
    df = df.withColumn("json_score", F.when(F.col("fmt") == "json", L.json_score(s)))
    df = df.withColumn("quiet_warn", F.coalesce(matches(s, r"\[(?:WARN|WARNING)\]", "i") & ~matches(s, L.DIAGNOSTIC, "i"), F.lit(False)))
    df = df.withColumn("notice", F.coalesce(matches(s, r"\[(?:NOTICE|STATUS)\]", "i"), F.lit(False)))
    df = df.withColumn("quiet_path", F.when(hit["status"] < 400, hit["path"])).withColumn("stack_key", M.stack_signature(s))
    df = df.withColumn("extra", F.coalesce(extra, F.lit(0.0)))
    if sources:
        df = detection.boosted(df, catalog=catalog(o)).withColumn("extra", F.col("extra") + F.coalesce("source_boost", F.lit(0)))
    return df.select([c.split()[0] for c in SCORED.split(", ")])


#: Rows of a batch that the fold gives out; one stream's end can add to it.
FOLDED = 10_000
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _fold(o: Options, what: str, schema: str, estimate=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over scored rows, sorted by stream and line. Holds a batch, and of a stream what its fold holds; decisions leave it with each batch."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def result(stream: str | None, r: Reducer) -> list[tuple]:
        if what == "report":
            own = (r.stats["input_tokens"], r.stats["output_tokens"]) if estimate else (None, None)
            return [(stream, *(r.stats[c] for c in COUNTERS), r.format, *own)]
        return [(stream, i, text, float(score), r.price(text)) for i, (text, score) in enumerate(r.out)] if what == "output" else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, stream, told, out, unnumbered = None, None, 0, [], []

        def drain() -> None:
            nonlocal told
            if what == "decisions":
                out.extend((stream, told + i, *d[:7], None if d[7] is None else float(d[7])) for i, d in enumerate(r.decisions))
                told += len(r.decisions)
            r.decisions.clear()

        def end() -> None:
            for row in unnumbered:
                r.push(row)
            unnumbered.clear()
            r.close()
            drain()
            out.extend(result(stream, r))

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
            out.clear()
            return batch

        for batch in batches:
            made = namedtuple("Row", batch.schema.names)._make
            for row in map(made, zip(*(c.to_pylist() for c in batch.columns))):
                if r is None or row.stream_id != stream:
                    if r is not None:
                        end()
                    if len(out) >= FOLDED:
                        yield given()
                    r, stream, told = Reducer(o, estimate), row.stream_id, 0
                # Lines without a number come last.
                unnumbered.append(row) if row.line_no is None else r.push(row)
            if r is not None:
                drain()
            if len(out) >= FOLDED:
                yield given()
        if r is not None:
            end()
        if out:
            yield given()

    return run


def folded(lines: DataFrame, o: Options, what: str, schema: str, estimate=None) -> DataFrame:
    """The fold over each stream's rows. They are dealt by stream and sorted already, so this adds no shuffle and no sort; the text goes along only for an estimate."""
    rows = scored(lines, o)
    rows = rows if estimate else rows.drop("value")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "line_no").mapInArrow(_fold(o, what, schema, estimate), schema)


def reduce_lines(lines: DataFrame, options: Options | None = None, estimate=None) -> DataFrame:
    """Reduced lines: stream_id, out_no, text, score, tokens. Streams run in parallel; one stream is ordered, so it is one task. ``estimate(text)`` replaces the token estimate, for the budget too."""
    return folded(lines, options or Options(), "output", OUTPUT, estimate)


def decisions(lines: DataFrame, options: Options | None = None) -> DataFrame:
    return folded(lines, options or Options(), "decisions", DECISIONS)


def with_tokens(report: DataFrame) -> DataFrame:
    """Token metrics of a report: words times 1.3, or the caller's estimate."""
    before = F.coalesce("own_input_tokens", L.tokens_of_words(F.col("input_words")))
    after = F.coalesce("own_output_tokens", L.tokens_of_words(F.col("output_words")))
    saved = F.greatest(F.lit(0), before - after)
    percent = F.when(before > 0, F.floor(saved / before * 100 * 100 + 0.5) / 100).otherwise(0.0)
    return report.select(
        "*", before.alias("input_tokens"), after.alias("output_tokens"), saved.alias("saved_tokens"), percent.alias("savings_percent")
    ).drop("own_input_tokens", "own_output_tokens")


def report(lines: DataFrame, options: Options | None = None, estimate=None) -> DataFrame:
    """One row of statistics for each stream, with its top sources. ``estimate(text)`` replaces the token estimate."""
    o = options or Options()
    stats = with_tokens(folded(lines, o, "report", REPORT, estimate))
    top = detection.ranked(detection.hits(group_lines(lines, o.multiline, catalog(o)), catalog(o)))
    top = top.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("detected_sources"))
    return stats.join(top, "stream_id", "left").withColumn("detected_sources", F.coalesce("detected_sources", F.array().cast("array<string>")))


def classify(lines: DataFrame, o: Options) -> DataFrame:
    """Row classes of a stream under a static level: E blank, D dropped, I internal frame, H hard keep, S soft, L low; with text and score."""
    if o.aggressiveness == "auto":
        raise ValueError("a static level is needed")
    df = scored(lines, o)
    w = Window.partitionBy("stream_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("pem").isNotNull(), F.col("pem") == "header"), ignorenulls=True).over(w)
    body = F.col("reason").isNull() & F.coalesce(state, F.lit(False)) & ~F.col("pem").eqNullSafe(F.lit("header"))
    df = df.withColumn("reason", F.when(body, "custom-ignore").otherwise(F.col("reason")))
    header = F.col("reason").isNull() & F.col("pem").eqNullSafe(F.lit("header"))
    df = df.withColumn("internal", F.col("internal") & ~header).withColumn("sanitized", F.when(header, M.PEM_MARKER).otherwise(F.col("sanitized")))
    counted = F.col("reason").isNull() & ~F.col("internal")
    seen = F.row_number().over(Window.partitionBy("stream_id", "sanitized", counted).orderBy("line_no"))
    df = df.withColumn("seen", F.when(counted, seen))
    base = F.when(header, 0.0).otherwise(F.col("score"))
    if o.aggressiveness == "aggressive":
        base = F.when(F.col("quiet_warn"), -1.0).otherwise(base)
    if o.aggressiveness == "low":
        base = base + F.when(F.col("notice"), 30).otherwise(0)
    df = df.withColumn("score", base + F.col("extra") - L.repeat_penalty(F.col("seen")))
    kind = F.when(F.col("reason") == "empty", "E").when(F.col("reason").isNotNull(), "D").when(F.col("internal"), "I")
    return df.withColumn("class", kind.when(F.col("score") >= L.KEEP_SCORE, "H").when(F.col("score") >= 0, "S").otherwise("L"))


def context(classed: DataFrame, o: Options) -> DataFrame:
    """Adds marker, after, before and emitted to rows with a class, by windows over the stream alone."""
    order = Window.partitionBy("stream_id").orderBy("line_no")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("class")
    df = classed.withColumn("ne", F.sum((c != "E").cast("int")).over(upto))
    df = df.withColumn("last_class", F.last(F.when(c != "E", c), ignorenulls=True).over(earlier))
    df = df.withColumn("marker", (c == "I") & (F.coalesce("last_class", F.lit("")) != "I"))
    df = df.withColumn("flush", (c == "H") | F.col("marker")).withColumn("sub", c.isin("S", "L"))
    df = df.withColumn("last_h", F.last(F.when(c == "H", F.col("ne")), ignorenulls=True).over(earlier))
    gap = F.coalesce(F.col("ne") - F.col("last_h"), F.col("ne") + 7)
    base = o.context_after
    wide = F.when(gap <= 2, max(1, base - 1)).when(gap >= 12, base + 2).otherwise(base) if o.adaptive else F.lit(base)
    df = df.withColumn("wide", F.when(c == "H", wide).when(F.col("marker"), 0)).withColumn("subs", F.sum(F.col("sub").cast("int")).over(upto))
    at = F.last(F.when(F.col("flush"), F.struct("subs", "wide")), ignorenulls=True).over(upto)
    df = df.withColumn("opened", at).withColumn("epoch", F.sum(F.col("flush").cast("int")).over(upto))
    df = df.withColumn("after", F.col("sub") & F.coalesce(F.col("subs") - F.col("opened.subs") <= F.col("opened.wide"), F.lit(False)))
    df = df.withColumn("buffered", (c == "S") & ~F.col("after"))
    rest = Window.partitionBy("stream_id", "epoch").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    total = F.max("epoch").over(Window.partitionBy("stream_id"))
    later = F.coalesce(F.sum(F.col("buffered").cast("int")).over(rest), F.lit(0))
    df = df.withColumn("before", F.col("buffered") & (total > F.col("epoch")) & (later < o.context_before))
    return df.withColumn("emitted", (c == "H") | F.col("marker") | F.col("after") | F.col("before"))


def fold_repeats(emitted: DataFrame, key: Column | None = None) -> DataFrame:
    """Adjacent lines of one signature as ``[xN] line``, values that vary listed up to three: islands over (stream_id ORDER BY line_no) of emitted(stream_id, line_no, text, score)."""
    order = Window.partitionBy("stream_id").orderBy("line_no")
    df = emitted.withColumn("sig", L.repeat_signature(F.col("text")) if key is None else F.coalesce(key, L.repeat_signature(F.col("text"))))
    new = F.coalesce((F.col("sig") != F.lag("sig").over(order)).cast("int"), F.lit(1))
    df = df.withColumn("island", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    folded = df.groupBy("stream_id", "island").agg(rows.alias("rows"), F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    folded = folded.withColumn("toks", F.transform("rows", lambda r: L.repeat_tokens(r["text"])))

    def slot(x: Column, i: Column) -> Column:
        said = F.array_distinct(F.filter(F.transform("toks", lambda t: F.when(F.get(t, i)["prefix"] == x["prefix"], F.get(t, i)["value"])), lambda v: v.isNotNull()))
        shown = F.concat(F.slice(said, 1, 3), F.when(F.size(said) > 3, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")))
        return F.when(x["value"].isNotNull() & (F.size(said) > 1), F.concat(x["prefix"], F.lit("["), F.array_join(shown, " | "), F.lit("]"))).otherwise(x["token"])

    many = F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit("] "), F.array_join(F.transform(F.col("toks")[0], slot), " "))
    text = F.when(F.col("n") > 1, many).otherwise(F.col("rows")[0]["text"])
    return folded.select("stream_id", F.col("rows")[0]["line_no"].alias("line_no"), F.col("n").cast("long").alias("n"), text.alias("text"), "score")


def reduce_by_windows(lines: DataFrame, options: Options) -> DataFrame:
    """The reduction under a static level with dedupe of adjacent lines, as windows only: for streams without JSON, soft access-log rows or post-passes it equals the fold. The warning of an open PEM block is a stream's last row; the fold writes it before its last group."""
    classed = classify(lines, options)
    rows = context(classed, options).where("emitted")
    text = F.when(F.col("marker"), HIDDEN).otherwise(F.col("sanitized"))
    score = F.when(F.col("marker"), 40.0).when(F.col("before"), 0.0).otherwise(F.col("score"))
    rows = rows.select("stream_id", "line_no", text.alias("text"), score.alias("score"), F.when(~F.col("marker") & ~F.col("before"), F.col("stack_key")).alias("sk"))
    # A stream whose last header has no footer ends with a warning.
    turn = F.when(F.col("pem").isNotNull(), F.struct("line_no", (F.col("pem") == "header").alias("open")))
    ends = classed.groupBy("stream_id").agg(F.max("line_no").alias("last"), F.max(turn).alias("turn")).where("turn.open")
    warned = ends.select("stream_id", (F.col("last") + 1).alias("line_no"), F.lit(UNTERMINATED).alias("text"), F.lit(float(TOP)).alias("score"), F.lit(UNTERMINATED).alias("sk"))
    return fold_repeats(rows.unionByName(warned), F.col("sk"))


def explain_line(line: Column, o: Options | None = None) -> Column:
    """struct(reason, kept, score, sanitized) of a line on its own, without what other lines would change: context, repeats and sources."""
    o = o or Options()
    reason = drop_reason(line, line, o)
    clean = M.sanitize(line, o.keep_id_suffix)
    for pattern, by, flags in o.sanitizers:
        clean = M.custom_mask(clean, pattern, by, flags)
    inner = reduce(or_, (matches(clean, p) for p in o.internals), L.is_internal_frame(clean))
    score = L.base_score(clean, "high" if o.aggressiveness == "auto" else o.aggressiveness)
    if o.diagnostics:
        score = score + F.when(L.any_of(clean, [(p, "") for p in o.diagnostics]), 50).otherwise(0)
    if o.multilingual:
        score = score + F.when(L.is_foreign_diagnostic(clean), 50).otherwise(0)
    told = F.coalesce(reason, F.when(inner, "internal-stack").when(score >= L.KEEP_SCORE, "hard-keep").otherwise("low-score"))
    return F.struct(
        told.alias("reason"), (reason.isNull() & (inner | (score >= L.KEEP_SCORE))).alias("kept"), F.when(reason.isNull() & ~inner, score).alias("score"),
        F.when(reason.isNull(), F.when(inner, HIDDEN).otherwise(clean)).alias("sanitized"),
    )


# What tells a pasted log, as (pattern, flags, lines that it takes for a point), and how much is enough.
PASTE_SIGNALS = {
    "stamped": (r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3})", "", [2]),
    "levelled": (r"\[(INFO|ERROR|WARN|DEBUG|TRACE|FATAL|WARNING)\]|(^|\s)(ERROR|WARNING|FATAL|INFO):|npm (ERR|WARN)!", "i", [2]),
    "framed": (r"at [a-zA-Z][a-zA-Z0-9_$]+\.[a-zA-Z]", "", [1, 3]),
    "built": (r"(FAIL|PASS|SKIP|RUN)\b|npm ERR!|cargo (error|warning)|make\[|pytest|jest|mocha", "i", [2]),
    "prefixed": (r"^\s*(npm ERR|npm WARN|yarn error|FAIL|PASS|SKIP|RUN|OK|ERR!|WARN!|\[ERROR\]|\[INFO\]|\[WARN\]|\[DEBUG\]|\[FATAL\]|\[TRACE\]|FATAL:|ERROR:|WARNING:)", "i", [2]),
}
PASTE_LINES, PASTE_POINTS = 5, 2


def paste_signals(lines: DataFrame) -> DataFrame:
    """stream_id, n_lines, score, is_log: if a pasted text looks like a log: PASTE_LINES lines and PASTE_POINTS points."""
    v = F.col("value")
    counts = (F.count_if(F.coalesce(matches(v, p, f), F.lit(False))).alias(k) for k, (p, f, _) in PASTE_SIGNALS.items())
    per = lines.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_lines"), *counts)
    score = sum((F.when(F.col(k) >= least, 1).otherwise(0) for k, (*_, limits) in PASTE_SIGNALS.items() for least in limits), F.lit(0))
    return per.select("stream_id", "n_lines", score.alias("score")).withColumn("is_log", (F.col("n_lines") >= PASTE_LINES) & (F.col("score") >= PASTE_POINTS))


def sample_output(output: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("out_no")
    return output.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def format_vote(lines: DataFrame, sample: int = 50) -> DataFrame:
    """stream_id, format: the most frequent known format among the first ``sample`` lines that aren't blank; ties go to the first seen; null under two lines."""
    w = Window.partitionBy("stream_id").orderBy("line_no")
    first = lines.where(~is_blank(F.col("value"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample)
    votes = first.select("stream_id", "rn", L.detect_format(F.col("value")).alias("format")).groupBy("stream_id", "format").agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("at")
    )
    best = F.max_by("format", F.when(F.col("format") != "unknown", F.struct(F.col("n"), (-F.col("at")).alias("at"))))
    per = votes.groupBy("stream_id").agg(F.sum("n").alias("sampled"), F.max(F.when(F.col("format") != "unknown", 1)).alias("known"), best.alias("format"))
    return per.select("stream_id", F.when((F.col("sampled") >= 2) & (F.col("known") == 1), F.col("format")).alias("format"))
