"""Which tools wrote a log, by markers in its lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logdistill.functions.rx import apart, java
from logdistill.operators.catalog import BOOSTS, CATALOG, MODES

SOURCE_BOOST = 40


def marker_weight(marker: str) -> int:
    m = marker.strip()
    return 6 if len(m) <= 3 else 16 if len(m) >= 12 or not m.isascii() or not m.isalnum() else 12


def merged(catalog: dict[str, list[str]], more: dict[str, list[str]]) -> dict[str, list[str]]:
    """Markers of same-named sources joined without repeats, new sources at the end."""
    out = {k: list(v) for k, v in catalog.items()}
    for name, markers in more.items():
        out[name] = list(dict.fromkeys([*out.get(name, []), *markers]))
    return out


def catalog_table(spark: SparkSession, catalog: dict[str, list[str]] = CATALOG) -> DataFrame:
    rows = [(i, s, j, m.lower(), marker_weight(m)) for i, (s, ms) in enumerate(catalog.items()) for j, m in enumerate(ms)]
    return spark.createDataFrame(rows, "source_no int, source string, ord int, marker string, weight int")


def multiline_mode(source: str) -> str:
    return MODES.get(source, "off")


def any_marker(catalog: dict[str, list[str]]) -> str:
    """A pattern that finds a line of lower case with a marker of any source: markers with a common beginning share it, so a place in a line is tried once for each first character."""
    trie: dict = {}
    for marker in (m.lower() for ms in catalog.values() for m in ms):
        node = trie
        for c in marker:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        if "" in node:
            return ""
        said = [("\\" if c.isascii() and not c.isalnum() else "") + c + written(below) for c, below in sorted(node.items())]
        return said[0] if len(said) == 1 else f"(?:{'|'.join(said)})"

    return written(trie) if trie else r"(?!)"


def _per_line(value: Column, catalog: dict[str, list[str]], entry: Callable[[Column, int, str, list[str]], Column]) -> Column:
    """Entries of the sources that a line names, without nulls. The lower-cased line is named once, or each marker would lower the line anew."""
    return F.element_at(F.transform(F.array(F.lower(value)), lambda low: F.array_compact(F.array(*(entry(low, i, s, ms) for i, (s, ms) in enumerate(catalog.items()) if ms)))), 1)


def hits(lines: DataFrame, catalog: dict[str, list[str]] = CATALOG) -> DataFrame:
    """stream_id, line_no, source_no, source, weight: one row for each source that a line names; its first marker counts.

    One pattern finds the lines with any marker; only they try the sources one by
    one. The join of lines with markers needs no shuffle and no row but the hits.
    """

    def entry(low: Column, i: int, source: str, markers: list[str]) -> Column:
        weight = reduce(lambda w, m: w.when(low.contains(m.lower()), marker_weight(m)), markers[1:], F.when(low.contains(markers[0].lower()), marker_weight(markers[0])))
        return F.when(weight.isNotNull(), F.struct(F.lit(i).alias("source_no"), F.lit(source).alias("source"), weight.alias("weight")))

    rows = lines.where(F.lower("value").rlike(any_marker(catalog)))
    return rows.select("stream_id", "line_no", F.explode(_per_line(F.col("value"), catalog, entry)).alias("h")).select("stream_id", "line_no", "h.*")


def named(value: Column, catalog: dict[str, list[str]] = CATALOG) -> Column:
    """array<int>: numbers of the sources that a line names."""
    found = _per_line(value, catalog, lambda low, i, _, markers: F.when(reduce(or_, (low.contains(m.lower()) for m in markers)), i))
    return F.when(F.lower(value).rlike(any_marker(catalog)), found).otherwise(F.array().cast("array<int>"))


def ranked(found: DataFrame, limit: int = 12) -> DataFrame:
    """The top sources of each stream: most hits first, then by name."""
    counts = found.groupBy("stream_id", "source").agg(F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("confidence"))
    w = Window.partitionBy("stream_id").orderBy(F.desc("hits"), "source")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def needed_confidence(lines_so_far: Column) -> Column:
    return F.when(lines_so_far < 50, 4).when(lines_so_far < 200, 6).otherwise(12)


def boosted(lines: DataFrame, text: str = "sanitized", catalog: dict[str, list[str]] = CATALOG, boosts: dict = BOOSTS) -> DataFrame:
    """``lines`` with ``source_boost``: SOURCE_BOOST where a source that is sure by then (this line included) has a pattern that matches.

    A source's confidence only grows, so two numbers for each stream and source tell
    from which line on it is sure: the first line with 6, enough for the first 200
    lines, and the first with 12. They come from the hits alone, which are few, and
    reach the stream as a row before its first: one shuffle of the lines, by stream,
    serves them, the count of lines and what follows. A line tries the patterns of
    its sure sources only. ``n_lines`` is the number of physical lines of a row.
    """
    known = {s: m for s, m in catalog.items() if m and boosts.get(s)}
    names = list(known)
    order = Window.partitionBy("stream_id", "source_no").orderBy("line_no")
    found = hits(lines, known).withColumn("sum", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    early, late = needed_confidence(F.lit(199)), needed_confidence(F.lit(200))
    per = found.groupBy("stream_id", "source_no").agg(F.min(F.when(F.col("sum") >= early, F.col("line_no"))).alias("early"), F.min(F.when(F.col("sum") >= late, F.col("line_no"))).alias("late"))
    # At most one entry for each source that has patterns.
    per = per.groupBy("stream_id").agg(F.collect_list(F.struct("source_no", "early", "late")).alias("s_all"))
    # Its line_no is null, and nulls come first; a line without a number is sure of nothing, wherever it stands.
    first = per.select("stream_id", "s_all", F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no"), F.lit(0).alias("n_lines"), F.lit(False).alias("s_line"))
    rows = lines.withColumn("s_all", F.lit(None).cast(per.schema["s_all"].dataType)).withColumn("s_line", F.lit(True)).unionByName(first, allowMissingColumns=True)
    upto = Window.partitionBy("stream_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumns({"s_upto": F.sum("n_lines").over(upto), "s_all": F.first("s_all", ignorenulls=True).over(upto)}).where("s_line")
    since = F.filter("s_all", lambda x: F.coalesce(F.col("line_no") >= x["late"], F.lit(False)) | ((F.col("s_upto") < 200) & F.coalesce(F.col("line_no") >= x["early"], F.lit(False))))
    df = df.withColumn("s_sure", F.transform(since, lambda x: x["source_no"]))
    hit = F.lit(False)
    for i, source in enumerate(names):
        line_hit = reduce(lambda a, b: a | b, (F.col(text).rlike(java(p, f)) for p, f in boosts[source]))
        hit = hit | (F.array_contains("s_sure", i) & F.coalesce(line_hit, F.lit(False)))
    boost = F.when(F.size("s_sure") > 0, F.when(hit, SOURCE_BOOST).otherwise(0)).otherwise(0)
    return df.withColumn("source_boost", apart(boost)).drop("s_all", "s_line", "s_upto", "s_sure")
