"""Queries over the test tables, one for each operator or group of small ones, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logdistill.functions import lines as L
from logdistill.functions import masks as M
from logdistill.functions.rx import is_blank, matches, replaced, words
from logdistill.operators import detection
from logdistill.operators.kernel import Options
from logdistill.plans import distill as P
from logdistill.sources import lines as S
from logdistill.sources import telemetry

STATIC = Options(aggressiveness="high", adaptive_context=True, multilingual=False)
MARKERS = {"payments": ["payment failed"], "shop": ["purchase", "signup"], "web": ["get /item"], "views": ["view item"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_lines(_table(spark, sf_dir, "events"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.explode_text(_table(spark, sf_dir, "documents"), "doc_id", "text")


def made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines turned into formats that the plain ones don't have."""
    e = event_lines(spark, sf_dir)
    n = F.col("line_no").cast("string")
    kind = F.col("line_no") % 10
    value = (
        F.when(kind == 0, F.concat(F.lit('10.0.0.1 - - [16/May/2026:10:12:04 +0000] "GET /healthz HTTP/1.1" 200 2 "-" "kube-probe/1.2'), n, F.lit('"')))
        .when(kind == 1, F.concat(F.lit('10.0.0.1 - - [16/May/2026:10:12:04 +0000] "GET /cart/'), n, F.lit(' HTTP/1.1" 503 7 "-" "Mozilla"')))
        .when(kind == 2, F.concat(F.lit("    at com.acme.Shop.pay(Shop.java:"), n, F.lit(")")))
        .when(kind == 3, F.lit("-----BEGIN RSA PRIVATE KEY-----"))
        .when(kind == 5, F.lit("-----END RSA PRIVATE KEY-----"))
        .when(kind == 6, F.concat(F.lit('{"level":"error","id":'), n, F.lit("}")))
        .when(kind == 7, F.concat(F.lit("id="), n, F.lit(" level=warn")))
        .otherwise(F.col("value"))
    )
    return e.withColumn("value", value)


MADE_SQL = f"""
  select stream_id, line_no, case line_no % 10
    when 0 then '10.0.0.1 - - [16/May/2026:10:12:04 +0000] "GET /healthz HTTP/1.1" 200 2 "-" "kube-probe/1.2' || line_no || '"'
    when 1 then '10.0.0.1 - - [16/May/2026:10:12:04 +0000] "GET /cart/' || line_no || ' HTTP/1.1" 503 7 "-" "Mozilla"'
    when 2 then '    at com.acme.Shop.pay(Shop.java:' || line_no || ')'
    when 3 then '-----BEGIN RSA PRIVATE KEY-----' when 5 then '-----END RSA PRIVATE KEY-----'
    when 6 then '{{"level":"error","id":' || line_no || '}}' when 7 then 'id=' || line_no || ' level=warn' else value end as value
  from ({S.EVENT_LINES_SQL})"""
DOC_LINES_SQL = """
  select cast(doc_id as varchar) as stream_id, cast(i - 1 as bigint) as line_no, pieces[i] as value
  from (select doc_id, pieces, unnest(range(1, len(pieces) + 1)) as i from (
    select doc_id, case when pieces[-1] = '' then pieces[:-2] else pieces end as pieces from (select doc_id, string_split(text, chr(10)) as pieces from documents)))"""


def _masked(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "line_no", M.sanitize(F.col("value")).alias("text"))


def adjacent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: drop ignored lines, mask, fold adjacent repeats."""
    kept = event_lines(spark, sf_dir).where(~L.is_ignored(F.col("value")))
    text = M.sanitize(F.col("value"))
    return P.fold_repeats(kept.select("stream_id", "line_no", text.alias("text"), F.lit(0.0).alias("score"))).select("stream_id", "line_no", "n", "text")


def _signature_sql(text: str) -> str:
    return f"regexp_replace({text}, '=\\S+', '=[VALUE]', 'g')"


def _mask_sql(v: str) -> str:
    octet = "(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)"
    v = f"regexp_replace({v}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}(?:[T\\s]\\d{{2}}:\\d{{2}}:\\d{{2}})?\\b', '[TIME]', 'g')"
    v = f"regexp_replace({v}, '\\b{octet}(?:\\.{octet}){{3}}\\b', '[IP]', 'g')"
    v = f"regexp_replace({v}, '\\b(?:\\d+d)?(?:\\d+h)?(?:\\d+m)?\\d+s\\b', '[AGO]', 'g')"
    return f"regexp_replace({v}, '(returned\\s+)4\\d\\d\\b', '\\1[HTTP 4xx]', 'g')"


_FOLD = f"""
  with e as ({S.EVENT_LINES_SQL}),
  m as (select stream_id, line_no, {_mask_sql("value")} as text from e where not regexp_matches(value, '\\[(?:INFO|DEBUG|TRACE|VERBOSE)\\]')),
  s as (select *, {_signature_sql("text")} as sig from m),
  i as (select *, sum(new) over (partition by stream_id order by line_no) as island from (
    select *, case when sig = lag(sig) over (partition by stream_id order by line_no) then 0 else 1 end as new from s)),
  g as (select stream_id, island, min(line_no) as line_no, count(*) as n, arg_min(text, line_no) as first_text, list(text order by line_no) as texts from i group by all),
  t as (select *, list_transform(string_split(first_text, ' '), lambda x, k: case when regexp_matches(x, '^[^=]+=.+$') and len(list_distinct(list_transform(texts, lambda y: string_split(y, ' ')[k]))) > 1
      then regexp_extract(x, '^([^=]+=)', 1) || '[' || array_to_string(list_transform(list_filter(list_transform(texts, lambda y: regexp_extract(string_split(y, ' ')[k], '=(.+)$', 1)),
        lambda v, p: list_position(list_transform(texts, lambda y: regexp_extract(string_split(y, ' ')[k], '=(.+)$', 1)), v) = p)[1:4], lambda v, p: case when p = 4 then '…' else v end), ' | ') || ']' else x end) as shown from g)
  select stream_id, line_no, n, case when n > 1 then '[x' || n || '] ' || array_to_string(shown, ' ') else first_text end as text from t"""


def filter_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    o = Options(include=r"\w", exclude=r"user=1\d\b", severity="warn", ignores=["amount=7"])
    return made_lines(spark, sf_dir).select("stream_id", "line_no", F.coalesce(P.drop_reason(v, v, o), F.lit("kept")).alias("reason"))


_REASON = f"""
  select stream_id, line_no, case when not regexp_matches(value, '\\S') then 'empty' when not regexp_matches(value, '\\w') then 'include-filter'
    when regexp_matches(value, 'user=1\\d\\b') then 'exclude-filter' when regexp_matches(value, 'amount=7') then 'custom-ignore'
    when not regexp_matches(value, '(?i)\\[FATAL\\]|\\bFATAL\\b|\\[ERROR\\]|"level"\\s*:\\s*"(fatal|error|warn)"|\\bERROR\\b|\\[WARN(ING)?\\]') and regexp_matches(value, '(?i)\\b(INFO|DEBUG|TRACE)\\b') then 'severity'
    when regexp_matches(value, '(?i)\\bNormal\\s+\\d+[smhd]\\b') then 'ci-noise' when regexp_matches(value, '"GET /healthz HTTP/1.1" 200') then 'ci-noise'
    when regexp_matches(value, '(?i)\\[(INFO|DEBUG|TRACE|VERBOSE)\\]') then 'ignored-tag' else 'kept' end as reason
  from ({MADE_SQL})"""


def score_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _masked(event_lines(spark, sf_dir).where(~L.is_ignored(F.col("value"))))
    seen = F.row_number().over(Window.partitionBy("stream_id", "text").orderBy("line_no"))
    base = df.select("stream_id", "line_no", L.base_score(F.col("text")).alias("base"), seen.alias("seen"))
    return base.select("stream_id", "line_no", F.col("seen").cast("long").alias("seen"), (F.col("base") - L.repeat_penalty(F.col("seen"))).cast("long").alias("score"))


_SCORED = f"""
  with m as (select stream_id, line_no, {_mask_sql("value")} as text from ({S.EVENT_LINES_SQL}) where not regexp_matches(value, '\\[INFO\\]')),
  c as (select *, row_number() over (partition by stream_id, text order by line_no) as seen from m)
  select stream_id, line_no, seen::bigint as seen, (case when regexp_matches(text, '\\[(ERROR|WARN|FATAL|CRITICAL|FAIL)\\]') then 100 else 0 end
    + case when regexp_matches(text, '(?i)\\b(error|failed|failure|timeout)\\b') then 50 else 0 end - case when seen >= 3 then 8 * (seen - 2) else 0 end)::bigint as score from c"""


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Options(aggressiveness="high", adaptive_context=True, multilingual=False)
    df = P.context(P.classify(event_lines(spark, sf_dir), o), o)
    return df.select("stream_id", "line_no", "class", "after", "before", "emitted")


_CONTEXT = f"""
  with sc as ({_SCORED}),
  k as (select e.stream_id, e.line_no, case when sc.line_no is null then 'D' when score >= 40 then 'H' when score >= 0 then 'S' else 'L' end as class
    from ({S.EVENT_LINES_SQL}) e left join sc using (stream_id, line_no)),
  a as (select *, row_number() over w as ne, sum((class in ('S', 'L'))::int) over w as subs, sum((class = 'H')::int) over w as epoch from k window w as (partition by stream_id order by line_no)),
  h as (select stream_id, epoch, subs as subs_h, ne - coalesce(lag(ne) over (partition by stream_id order by line_no), -7) as gap from a where class = 'H'),
  b as (select a.*, class in ('S', 'L') and coalesce(subs - subs_h <= case when gap <= 2 then 1 when gap >= 12 then 4 else 2 end, false) as after from a left join h using (stream_id, epoch)),
  d as (select *, class = 'S' and not after as buffered from b),
  f as (select *, coalesce(sum(buffered::int) over (partition by stream_id, epoch order by line_no rows between 1 following and unbounded following), 0) as later, max(epoch) over (partition by stream_id) as total from d),
  g as (select *, buffered and total > epoch and later < 3 as before from f)
  select stream_id, line_no, class, after, before, class = 'H' or after or before as emitted from g"""


def access_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, hit = F.col("value"), L.access_log(F.col("value"))
    return made_lines(spark, sf_dir).where(L.is_access_log(v)).select(
        "stream_id", "line_no", hit["path"].alias("path"), L.http_status(v).alias("status"), hit["user_agent"].alias("user_agent"), L.is_access_noise(v).alias("noise")
    )


def multiline_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.group_lines(made_lines(spark, sf_dir), "java")
    return g.select("stream_id", "line_no", "n_lines", F.md5("value").alias("digest"))


_MULTI = f"""
  with m as ({MADE_SQL}), b as (select *, sum((not regexp_matches(value, '^\\s'))::int) over (partition by stream_id order by line_no) as island from m),
  p as (select *, (row_number() over (partition by stream_id, island order by line_no) - 1) // 200 as part from b)
  select stream_id, min(line_no) as line_no, count(*)::int as n_lines, md5(string_agg(value, chr(10) order by line_no)) as digest from p group by stream_id, island, part"""


def pem_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = made_lines(spark, sf_dir)
    v, w = F.col("value"), Window.partitionBy("stream_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    head, foot = matches(v, M.PEM_HEADER), matches(v, M.PEM_FOOTER)
    inside = F.coalesce(F.last(F.when(head, True).when(foot, False), ignorenulls=True).over(w), F.lit(False))
    text = F.when(head, M.PEM_MARKER).when(~inside, v)
    return df.select("stream_id", "line_no", text.alias("text")).where("text is not null")


_PEM = f"""
  with s as (select *, value like '-----BEGIN%' as head, case when value like '-----BEGIN%' then true when value like '-----END%' then false end as turn from ({MADE_SQL})),
  t as (select *, coalesce(last_value(turn ignore nulls) over (partition by stream_id order by line_no rows between unbounded preceding and 1 preceding), false) as inside from s)
  select stream_id, line_no, case when head then '{M.PEM_MARKER}' else value end as text from t where head or not inside"""


def source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = detection.hits(event_lines(spark, sf_dir), MARKERS)
    return detection.ranked(h, 3).select("stream_id", "source", F.col("hits").cast("long").alias("hits"), F.col("confidence").cast("long").alias("confidence"), F.col("rank").cast("long").alias("rank"))


_HITS = f"""
  with e as ({S.EVENT_LINES_SQL}), h as (
    select stream_id, 'payments' as source, 16 as weight from e where contains(lower(value), 'payment failed')
    union all select stream_id, 'shop', 12 from e where contains(lower(value), 'purchase') or contains(lower(value), 'signup')
    union all select stream_id, 'web', 16 from e where contains(lower(value), 'get /item') union all select stream_id, 'views', 16 from e where contains(lower(value), 'view item')),
  c as (select stream_id, source, count(*) as hits, sum(weight)::bigint as confidence from h group by all)
  select stream_id, source, hits, confidence, row_number() over (partition by stream_id order by hits desc, source) as rank from c qualify rank <= 3"""


def source_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detection.boosted(event_lines(spark, sf_dir).withColumn("n_lines", F.lit(1)), "value", MARKERS, {"payments": [(r"\bpurchase\b", "")], "web": [(r"^\[ERROR\]", "")]})
    return df.select("stream_id", "line_no", "source_boost")


_BOOST = f"""
  with r as (select *, row_number() over w as n, sum(16 * contains(lower(value), 'payment failed')::int) over w as pay, sum(16 * contains(lower(value), 'get /item')::int) over w as web
    from ({S.EVENT_LINES_SQL}) window w as (partition by stream_id order by line_no)),
  t as (select *, case when n < 50 then 4 when n < 200 then 6 else 12 end as need from r)
  select stream_id, line_no, case when (pay >= need and regexp_matches(value, '\\bpurchase\\b')) or (web >= need and regexp_matches(value, '^\\[ERROR\\]')) then 40 else 0 end as source_boost from t"""


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    per = doc_lines(spark, sf_dir).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(words(v)).alias("n_words"), F.sum(F.octet_length(v) + 1).alias("n_bytes"), F.sum(L.tokens_of_text(v)).alias("text_tokens")
    )
    return per.withColumn("word_tokens", L.tokens_of_words(F.col("n_words")))


def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    runs = event_lines(spark, sf_dir).groupBy("stream_id").agg(
        F.max("line_no").alias("at"), F.sum(words(v)).alias("input_tokens"), F.sum(F.when(~L.is_ignored(v), words(v)).otherwise(0)).alias("output_tokens")
    )
    return telemetry.totals(telemetry.newest(runs.withColumn("saved_tokens", F.col("input_tokens") - F.col("output_tokens"))))


_RUNS = f"""
  with r as (select stream_id, max(line_no) as newest, sum(len(regexp_extract_all(value, '\\S+'))) as i, sum(case when value like '[INFO]%' then 0 else len(regexp_extract_all(value, '\\S+')) end) as o
    from ({S.EVENT_LINES_SQL}) group by stream_id order by newest desc, stream_id limit 1000)
  select count(*) as runs, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, sum(i - o)::bigint as saved_tokens, floor(1000 * sum(i - o) / sum(i))::bigint as saved_permille from r"""


#: Every few lines in another shape, so that each signal decides for some streams.
PASTED = """case when line_no % 11 < ascii(substr(stream_id, length(stream_id), 1)) % 4 then concat('   at app.Service', line_no % 3, '(x)') when line_no % 7 = ascii(substr(stream_id, length(stream_id), 1)) % 5 then concat('2024-01-01 10:00', substr(value, 9))
  when line_no % 13 = 1 and ascii(substr(stream_id, length(stream_id), 1)) % 2 = 0 then 'make[1]: pytest' else replace(replace(value, '[', ''), ']', '') end"""
_PASTE = f"""
  with c as (select stream_id, count(*) as n_lines, count(*) filter (where regexp_matches(v, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d|\\d\\d:\\d\\d:\\d\\d[.,]\\d{{3}}')) as a,
      count(*) filter (where regexp_matches(v, '(?i)\\[(info|error|warn|debug|trace|fatal|warning)\\]|(^|\\s)(error|warning|fatal|info):|npm (err|warn)!')) as b,
      count(*) filter (where regexp_matches(v, 'at [a-zA-Z][a-zA-Z0-9_$]+\\.[a-zA-Z]')) as f,
      count(*) filter (where regexp_matches(v, '(?i)(fail|pass|skip|run)\\b|npm err!|cargo (error|warning)|make\\[|pytest|jest|mocha')) as m,
      count(*) filter (where regexp_matches(v, '(?i)^\\s*(npm err|npm warn|yarn error|fail|pass|skip|run|ok|err!|warn!|\\[(error|info|warn|debug|fatal|trace)\\]|fatal:|error:|warning:)')) as p
    from (select stream_id, line_no, {PASTED} as v from ({S.EVENT_LINES_SQL})) group by 1),
  t as (select stream_id, n_lines, (a >= 2)::int + (b >= 2)::int + (f >= 1)::int + (f >= 3)::int + (m >= 2)::int + (p >= 2)::int as score from c)
  select stream_id, n_lines, score, n_lines >= 5 and score >= 2 as is_log from t"""


def _lines(build: Callable[[DataFrame], DataFrame], source=event_lines) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(source(spark, sf_dir))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "adjacent_fold": (adjacent_fold, _FOLD),
    "lines_explode": (
        _lines(lambda d: d.select("stream_id", "line_no", words(F.col("value")).alias("n_words"), (F.octet_length("value") + 1).cast("long").alias("n_bytes")), doc_lines),
        f"select stream_id, line_no, len(regexp_extract_all(value, '\\S+'))::bigint as n_words, (strlen(value) + 1)::bigint as n_bytes from ({DOC_LINES_SQL})",
    ),
    "mask_lines": (_lines(_masked), f"select stream_id, line_no, {_mask_sql('value')} as text from ({S.EVENT_LINES_SQL})"),
    "mask_email_secret": (
        _lines(lambda d: d.select("stream_id", "line_no", replaced(replaced(F.col("value"), M.SECRET_FIELD, "$1[REDACTED]", "i"), M.EMAIL, "[EMAIL]").alias("text")), doc_lines),
        f"select stream_id, line_no, regexp_replace(regexp_replace(value, '(?i)(\\b(?:password|secret|token|api[_-]?key|bearer)\\s*[:=]\\s*)\\S+', '\\1[REDACTED]', 'g'), '{M.EMAIL}', '[EMAIL]', 'g') as text from ({DOC_LINES_SQL})",
    ),
    "filter_reason": (filter_reason, _REASON),
    "severity_counts": (
        _lines(lambda d: d.groupBy(F.coalesce(L.severity(F.col("value")), F.lit("none")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))),
        f"select case when value like '[ERROR]%' then 'error' when value like '[WARN]%' then 'warn' when value like '[INFO]%' then 'info' else 'none' end as severity, count(*) as n from ({S.EVENT_LINES_SQL}) group by 1",
    ),
    "diagnostic_flags": (
        _lines(lambda d: d.select("stream_id", "line_no", L.is_diagnostic(F.col("value")).alias("diagnostic"), L.is_internal_frame(F.col("value")).alias("internal"), L.should_keep(F.col("value")).alias("keep")), made_lines),
        f"""select stream_id, line_no, diagnostic, false as internal, regexp_matches(value, '\\[(ERROR|WARN)\\]') or (diagnostic and not regexp_matches(value, '(?i)\\[[A-Z]+\\]')) as keep
        from (select *, regexp_matches(value, '(?i)\\b(error|failed)\\b|^\\s*at\\s+[\\w$_.<>/]+\\([^)]+:\\d+\\)$|"level":"error"') as diagnostic from ({MADE_SQL}))""",
    ),
    "score_static": (score_static, _SCORED),
    "seen_count": (
        _lines(lambda d: d.where(~is_blank(F.col("value"))).select("stream_id", "line_no", F.row_number().over(Window.partitionBy("stream_id", "value").orderBy("line_no")).cast("long").alias("seen")), doc_lines),
        f"select stream_id, line_no, row_number() over (partition by stream_id, value order by line_no) as seen from ({DOC_LINES_SQL}) where regexp_matches(value, '\\S')",
    ),
    "repeat_signature": (
        _lines(lambda d: d.select("stream_id", "line_no", L.repeat_signature(F.col("value")).alias("signature"))),
        f"select stream_id, line_no, {_signature_sql('value')} as signature from ({S.EVENT_LINES_SQL})",
    ),
    "context_windows": (context_windows, _CONTEXT),
    "format_vote": (
        _lines(lambda d: P.format_vote(d, 50), made_lines),
        f"""with f as (select *, row_number() over (partition by stream_id order by line_no) as rn, case when line_no % 10 = 6 then 'json' when line_no % 10 = 7 then 'logfmt' else 'unknown' end as fmt from ({MADE_SQL}) where regexp_matches(value, '\\S') qualify rn <= 50),
        c as (select stream_id, fmt, count(*) as n, min(rn) as first_rn from f where fmt <> 'unknown' group by all), s as (select stream_id, count(*) as sampled from f group by all)
        select s.stream_id, case when sampled >= 2 then (select fmt from c where c.stream_id = s.stream_id order by n desc, first_rn limit 1) end as format from s""",
    ),
    "json_level": (
        lambda spark, d: _table(spark, d, "events").select("event_id", F.concat(F.lit('{"lvl":'), F.when(F.col("event_id") % 3 == 0, F.lit('"WARN"')).otherwise((F.col("event_id") % 7 * 10).cast("string")), F.lit("}")).alias("j")).select("event_id", L.json_level(F.col("j")).alias("level"), L.json_score(F.col("j")).alias("score")),
        """with l as (select event_id, case when event_id % 3 = 0 then 'warn' else ['trace', 'trace', 'debug', 'info', 'warn', 'error', 'fatal'][event_id % 7 + 1] end as level from events)
        select event_id, level, case when level in ('fatal', 'error') then 100 when level = 'warn' then 50 else -1 end as score from l""",
    ),
    "access_log_parse": (
        access_parse,
        f"""select stream_id, line_no, regexp_extract(value, '"GET (\\S+) HTTP', 1) as path, regexp_extract(value, '" (\\d{{3}}) ', 1)::int as status, regexp_extract(value, '"([^"]*)"$', 1) as user_agent, line_no % 10 = 0 as noise from ({MADE_SQL}) where line_no % 10 < 2""",
    ),
    "multiline_groups": (multiline_groups, _MULTI),
    "pem_mask": (pem_mask, _PEM),
    "source_hits": (source_hits, _HITS),
    "source_boost": (source_boost, _BOOST),
    "token_metrics": (
        token_metrics,
        f"select stream_id, count(*) as n_lines, sum(len(regexp_extract_all(value, '\\S+')))::bigint as n_words, sum(strlen(value) + 1)::bigint as n_bytes, sum(ceil(length(value) / 4))::bigint as text_tokens, ceil(sum(len(regexp_extract_all(value, '\\S+'))) * 1.3::double)::bigint as word_tokens from ({DOC_LINES_SQL}) group by stream_id",
    ),
    "frame_numbers": (
        _lines(lambda d: d.select("stream_id", "line_no", M.frame_numbers(F.col("value")).alias("text")), made_lines),
        f"select stream_id, line_no, regexp_replace(value, ':\\d+\\)', ':[NN])', 'g') as text from ({MADE_SQL})",
    ),
    "sample_limit": (
        _lines(lambda d: P.sample_output(d.select("stream_id", F.col("line_no").alias("out_no"), F.col("value").alias("text")), 5)),
        f"select stream_id, line_no as out_no, value as text from ({S.EVENT_LINES_SQL}) qualify row_number() over (partition by stream_id order by line_no) <= 5",
    ),
    "paste_detect": (
        _lines(lambda d: P.paste_signals(d.withColumn("value", F.expr(PASTED)))),
        _PASTE,
    ),
    "telemetry_rollup": (telemetry_rollup, _RUNS),
    "reduce_by_windows": (_lines(lambda d: P.reduce_by_windows(d, STATIC)), None),
    "auto_pipeline": (_lines(P.reduce_lines), None),
    "decisions": (_lines(P.decisions), None),
    "stream_report": (_lines(P.report), None),
    "explain_lines": (_lines(lambda d: d.select("stream_id", "line_no", P.explain_line(F.col("value")).alias("x")).select("stream_id", "line_no", "x.*"), made_lines), None),
    "token_budget": (_lines(lambda d: P.reduce_lines(d, Options(max_tokens=60))), None),
    "block_collapse": (_lines(lambda d: P.reduce_lines(d, Options(collapse_blocks=4, dedupe=False))), None),
    "sliding_dedupe": (_lines(lambda d: P.reduce_lines(d, Options(dedupe_window=3))), None),
    "multilingual": (_lines(lambda d: d.select("stream_id", "line_no", L.is_foreign_diagnostic(F.col("value")).alias("hit")), doc_lines), None),
    "mask_hashes": (_lines(_masked, doc_lines), None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s is not None}
