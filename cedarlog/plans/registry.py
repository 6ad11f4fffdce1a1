"""Registered queries of the log engine and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import layout, sizing, text
from ..operators import asof, batching, cutting, degraded, filters, ledger, metrics, monitoring, reliability, sinks
from ..schema import high_priority, level_rank, resolve_mode, winning_properties
from ..scratch import shared_dir
from ..sources import adapters, logfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the same records in SQL -----------------------------------------------------------------------------------------

LOGS = """logs AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id AS seq, 'app.EventService#' || event_type AS method_key,
  event_type || ' value=' || printf('%.2f', value) AS content,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS level,
  CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END::BIGINT AS rank,
  epoch_us(ts) // 1000 AS ts_ms, ts, 'worker-' || (event_id % 4) AS thread_name, 'app.' || event_type AS logger_name,
  CASE WHEN event_type = 'error' THEN 'java.lang.IllegalStateException: error' || chr(10) || chr(9) || 'at app.Service.run(Service.java:1)' END AS throwable,
  json_extract_string(props, '$.k') AS mdc_k, value, user_id, event_id, event_type FROM events)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events_as_logs(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_pipeline(spark, sf_dir)


# ---- sources ---------------------------------------------------------------------------------------------------------


@query(f"WITH {LOGS} SELECT trace_id, seq, method_key, content, level, ts_ms, thread_name, logger_name, throwable, mdc_k FROM logs")
def src_event_records(spark, sf_dir):
    return _logs(spark, sf_dir).withColumn("mdc_k", F.col("mdc")["k"]).drop("mdc")


@query(f"WITH {LOGS} SELECT trace_id, count(*) AS n, sum(CASE WHEN rank >= CASE WHEN user_id % 2 = 0 THEN 2 ELSE 3 END THEN 1 ELSE 0 END)::BIGINT AS at_level FROM logs WHERE user_id % 3 <> 0 GROUP BY trace_id")
def src_context_lookup(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    contexts = logs.select("trace_id").distinct().filter(F.col("trace_id").cast("long") % 3 != 0).withColumn("min_rank", F.when(F.col("trace_id").cast("long") % 2 == 0, 2).otherwise(3))
    joined = adapters.of_contexts(logs, contexts)
    return joined.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(level_rank(F.col("level")) >= F.col("min_rank")).alias("at_level"))


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(role, '') WHEN turn % 3 = 1 THEN coalesce(text, role, '') ELSE coalesce(role, '') END AS message,"
    " CASE WHEN turn % 2 = 0 THEN role END AS mdc_role, coalesce(CASE WHEN turn % 2 = 0 THEN 'main' END, 'unknown') AS thread_name FROM conversations"
)
def src_message_mdc_thread(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    args = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("role"))
    mdc = F.map_from_arrays(F.array(F.lit("role"), F.lit("noise")), F.array(F.when(F.col("turn") % 2 == 0, F.col("role")), F.lit("x")))
    return c.select(
        "conv_id", "turn",
        adapters.resolved_message(F.col("role"), args, F.when(F.col("turn") % 3 == 1, F.col("text"))).alias("message"),
        adapters.projected_mdc(mdc, ["role"], [" traceId ", "other"])["role"].alias("mdc_role"),
        adapters.thread_name(F.when(F.col("turn") % 2 == 0, "main")).alias("thread_name"),
    )


@query(
    "SELECT source, count(*) FILTER (regexp_matches(text, '[0-9]{11}')) AS long_numbers, count(*) FILTER (regexp_matches(text, '@[a-z0-9]+\\.')) AS mails, count(*) FILTER (regexp_matches(text, '(?i)token')) AS tokens FROM documents GROUP BY source"
)
def src_marker_counts(spark, sf_dir):
    return adapters.marker_counts(_table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")), {"long_numbers": "[0-9]{11}", "mails": r"@[a-z0-9]+\.", "tokens": "(?i)token"}, ["source"])


# ---- filters and sampling --------------------------------------------------------------------------------------------

REASON = """CASE WHEN user_id % 10 = 9 THEN 'disabled' WHEN event_id % 50 = 0 THEN 'nesting_depth' WHEN event_id % 17 = 0 THEN 'ignored' WHEN rank < 1 THEN 'level_filter'
  WHEN logger_name LIKE 'app.sign%' THEN 'logger_filter' WHEN NOT (rank >= 3 OR length(content) < 20) THEN 'handler_filter' WHEN event_id > 9000 THEN 'buffer_closed_late_arrival' END"""


def _reasoned(spark, sf_dir, mode="pipeline"):
    trace = F.col("trace_id").cast("long")
    return _logs(spark, sf_dir).withColumn(
        "discard_reason",
        filters.discard_reason(
            least="debug ", exclude=["", "app.sign"], ignored=F.col("seq") % 17 == 0, collect=lambda level, summary: (level_rank(level) >= 3) | (F.length(summary) < 20),
            late=F.col("seq") > 9000, enabled=trace % 10 != 9, depth=F.when(F.col("seq") % 50 == 0, 10).otherwise(1), most_depth=10, mode=mode,
        ),
    )


@query(f"WITH {LOGS} SELECT coalesce({REASON}, 'collected') AS reason, method_key, count(*) AS n FROM logs GROUP BY 1, 2")
def flt_discard_reasons(spark, sf_dir):
    return filters.reason_counts(_reasoned(spark, sf_dir), by=["method_key"]).select("reason", "method_key", "n")


@query(
    f"WITH {LOGS}, u AS (SELECT *, (event_id % 100) / 100.0 AS util FROM logs) SELECT CASE WHEN util >= 0.95 THEN 'backpressure_pause' WHEN util >= 0.8 AND rank < 3 THEN 'backpressure_skip_low_level' ELSE 'collected' END AS reason, level, count(*) AS n FROM u GROUP BY 1, 2"
)
def flt_backpressure(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumn("discard_reason", filters.backpressure_reason((F.col("seq") % 100) / 100))
    return filters.reason_counts(df, by=["level"]).select("reason", "level", "n")


@query(
    f"""WITH {LOGS}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM logs),
    h AS (SELECT *, sum(CASE WHEN n > 30 AND rank >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS h FROM n)
    SELECT CASE WHEN n <= 30 THEN 'queued' WHEN rank < 3 THEN 'pipeline_backpressure' WHEN h <= 5 THEN 'overflow' ELSE 'pipeline_queue_full' END AS fate, n > 30 AS counted, count(*) AS n FROM h GROUP BY 1, 2"""
)
def flt_queue_shedding(spark, sf_dir):
    return filters.shed_queue(_logs(spark, sf_dir), 30, 5).groupBy("fate", "counted").agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT trace_id, count(*) AS n, sum(CASE WHEN rank >= 3 THEN 1 ELSE 0 END)::BIGINT AS kept FROM logs GROUP BY trace_id")
def flt_retain_high(spark, sf_dir):
    judged = _logs(spark, sf_dir).withColumn("reason", filters.rejected_reason(F.col("level"), F.lit(True)))
    return judged.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("kept"))


@query(f"WITH {LOGS}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM logs) SELECT trace_id, seq FROM n WHERE n % 3 = 0")
def smp_count(spark, sf_dir):
    return _logs(spark, sf_dir).withColumn("reason", filters.sampled_out("COUNT", 0.3)).filter("reason IS NULL").select("trace_id", "seq")


@query(
    f"WITH {LOGS}, u AS (SELECT *, (event_id % 100) / 100.0 AS util FROM logs) SELECT trace_id, seq, CASE WHEN util < 0.5 THEN true WHEN util < 0.8 THEN false ELSE rank >= 3 END AS keep FROM u"
)
def smp_adaptive(spark, sf_dir):
    return _logs(spark, sf_dir).select("trace_id", "seq", filters.sample_adaptive(0.0, (F.col("seq") % 100) / 100).alias("keep"))


@query()
def smp_rate(spark, sf_dir):
    return _logs(spark, sf_dir).filter(filters.sample_by_rate(0.3, F.col("seq"))).select("trace_id", "seq")


# ---- sanitizing, masking, the security pipeline ----------------------------------------------------------------------

ANSI_SQL = r"regexp_replace({c}, '\x1B\[[0-9;]*[A-Za-z]', '', 'g')"
HTML_SQL = r"regexp_replace({c}, '(?is)<script.*?</script>|<[^>]*>', '', 'g')"


def _san_sql(c: str) -> str:
    return r"regexp_replace(%s, '[\x00-\x1F\x7F]', ' ', 'g')" % HTML_SQL.format(c=ANSI_SQL.format(c=c))


def _mask_sql(c: str) -> str:
    """Twice each: a consumed separator hides every second adjacent match."""
    for pattern, to in ((r"(1[3-9][0-9])[0-9]{4}([0-9]{4})", r"\1\2****\3\4"), (r"([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])", r"\1\2********\3\4"), (r"([0-9]{4})[0-9]{4,11}([0-9]{4})", r"\1\2****\3\4")):
        for _ in range(2):
            c = f"regexp_replace({c}, '(^|[^0-9A-Za-z_]){pattern}([^0-9A-Za-z_]|$)', '{to}', 'g')"
    c = f"regexp_replace({c}, '(?:([0-9A-Za-z_.%+-]{{2}})[0-9A-Za-z_.%+-]+|[0-9A-Za-z_.%+-]{{1,2}})@([0-9A-Za-z_.-]+\\.[A-Za-z]{{2,}})', chr(57344) || '\\1' || chr(57345) || '@\\2', 'g')"
    c = f"regexp_replace({c}, chr(57344) || chr(57345), '**', 'g')"
    return f"regexp_replace({c}, chr(57344) || '(..)' || chr(57345), '\\1****', 'g')"


@query(f"SELECT page_id, {_san_sql('html')} AS clean, {_san_sql('html')} IS DISTINCT FROM html AS modified FROM pages")
def san_pages(spark, sf_dir):
    done = text.sanitize_with_stats(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", done["value"].alias("clean"), done["modified"].alias("modified"))


@query(
    r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(?is)<script.*?</script>|<[^>]*>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(10)) AS lines FROM documents)
    SELECT doc_id, array_to_string(list_transform(lines, lambda x, i: CASE WHEN i = 1 OR regexp_matches(x, '^[\x00-\x20]*((at [\x00-\x20]*[^\x00-\x20]|Caused by:|Suppressed:)|\.\.\. [0-9]+ (more|common frames omitted)[\x00-\x20]*$|$)') THEN x ELSE chr(9) || '[ex-msg] ' || x END), chr(10)) AS clean FROM t"""
)
def san_throwables(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.sanitize_throwable(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, substring(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), 1, 80) AS summary, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || chr(10) || '... [truncated]' ELSE text END AS guarded FROM documents")
def san_summaries(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.summarize(F.col("text"), 80).alias("summary"), text.guard_length(F.col("text"), 200).alias("guarded"))


@query(f"SELECT doc_id, CASE WHEN length(text) >= 8 THEN {_mask_sql('text')} ELSE text END AS masked FROM documents")
def msk_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.mask(F.col("text")).alias("masked"))


PII = "('tel 13300009999,17700001111 id 33010219850615002X card 6228480402564890018 mail ann.lee@mail.test ' || CAST(event_id AS VARCHAR) || ' x@y.net@z.test')"


@query(f"SELECT event_id, {_mask_sql(PII)} AS masked, regexp_replace({_mask_sql(PII)}, '(id) [0-9]+', '\\1 #', 'g') AS custom FROM events")
def msk_rules(spark, sf_dir):
    raw = F.concat(F.lit("tel 13300009999,17700001111 id 33010219850615002X card 6228480402564890018 mail ann.lee@mail.test "), F.col("event_id").cast("string"), F.lit(" x@y.net@z.test"))
    custom = text.Masker([("(id) [0-9]+", "$1 #")])
    return _table(spark, sf_dir, "events").select("event_id", text.mask(raw).alias("masked"), custom(raw).alias("custom"))


@query(
    f"""WITH d AS (SELECT doc_id, text, regexp_matches(text, '[<\\x00-\\x1F]') AS s, regexp_matches(text, '[0-9]{{11}}|@') AS m FROM documents),
    e AS (SELECT doc_id, text, s, m, CASE WHEN s THEN {_san_sql("text")} ELSE text END AS clean FROM d)
    SELECT doc_id, CASE WHEN m AND length(text) >= 8 THEN {_mask_sql("clean")} ELSE clean END AS value, text <> '' AND clean <> text AS sanitized, text <> '' AND m AND length(text) >= 8 AND {_mask_sql("clean")} <> clean AS masked, text <> '' AND NOT s AND NOT m AS fast_path, CAST(CAST(s AS INT) + 2 * CAST(m AS INT) AS INT) AS flags FROM e"""
)
def sec_documents(spark, sf_dir):
    done = text.secure_columns(_table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": False})
    return done.select("doc_id", *(F.col(f"text_{k}").alias(k) for k in ("value", "sanitized", "masked", "fast_path")), text.scan_flags(F.col("text")).alias("flags"))


@query(
    f"""WITH {LOGS}, r AS (SELECT *, CASE event_id % 4 WHEN 0 THEN content || ' call 13300009999 now' WHEN 1 THEN '<i>' || content || '</i>' || chr(10) || 'next' WHEN 2 THEN 'mail ann.lee@mail.test ' || content || '<br>' ELSE content END AS raw FROM logs),
    f AS (SELECT *, regexp_matches(raw, '[<\\x00-\\x1F]') AS s, regexp_matches(raw, '[0-9]{{11}}|@') AS m FROM r), c AS (SELECT *, CASE WHEN s THEN {_san_sql("raw")} ELSE raw END AS clean FROM f),
    v AS (SELECT *, CASE WHEN m THEN {_mask_sql("clean")} ELSE clean END AS done FROM c)
    SELECT trace_id, seq, done AS content, throwable, mdc_k, clean <> raw AS sanitized, done <> clean AS masked, NOT s AND NOT m AND throwable IS NULL AS fast_path FROM v"""
)
def sec_records(spark, sf_dir):
    nth, content = F.col("seq") % 4, F.col("content")
    raw = F.when(nth == 0, F.concat(content, F.lit(" call 13300009999 now"))).when(nth == 1, F.concat(F.lit("<i>"), content, F.lit("</i>\nnext"))).when(nth == 2, F.concat(F.lit("mail ann.lee@mail.test "), content, F.lit("<br>"))).otherwise(content)
    done = text.secure_record(_logs(spark, sf_dir).withColumn("content", raw))
    return done.select("trace_id", "seq", "content", "throwable", F.col("mdc")["k"].alias("mdc_k"), "sanitized", "masked", "fast_path")


# ---- sizes, scalar rules, layout -------------------------------------------------------------------------------------

U16 = r"(length({c}) + length(regexp_replace({c}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _s_sql(c: str) -> str:
    return f"coalesce(56 + ((2 * {U16.format(c=c)} + 7) // 8) * 8, 0)"


@query(
    f"""WITH {LOGS} SELECT trace_id, seq, CAST(112 + {" + ".join(_s_sql(c) for c in ("trace_id", "content", "level", "thread_name", "logger_name", "throwable"))} + 208 + 48 + {_s_sql("'k'")} + {_s_sql("mdc_k")} AS BIGINT) AS entry,
    CAST(112 + {" + ".join(f"coalesce(48 + 2 * {U16.format(c=c)}, 0)" for c in ("trace_id", "content", "level", "thread_name", "logger_name", "throwable"))} + 64 + 32 + 2 + 2 * length(mdc_k) AS BIGINT) AS processed,
    CAST(64 + {_s_sql("content")} + {_s_sql("throwable")} AS BIGINT) AS aggregate, CAST(2 * {U16.format(c="content")} AS BIGINT) AS line, CAST(64 + {_s_sql("content")} AS BIGINT) AS segment FROM logs"""
)
def est_sizes(spark, sf_dir):
    return _logs(spark, sf_dir).select(
        "trace_id", "seq", sizing.entry_bytes().alias("entry"), sizing.processed_bytes().alias("processed"), sizing.aggregate_bytes().alias("aggregate"), sizing.line_bytes(F.col("content")).alias("line"), sizing.segment_bytes(F.col("content")).alias("segment")
    )


@query(
    """WITH e AS (SELECT event_id, CAST(event_id * 1000003 AS BIGINT) AS n FROM events)
    SELECT event_id, CAST(event_id * 1024 AS BIGINT) AS parsed, CAST(event_id * 1.5 * 1048576 AS BIGINT) AS parsed_mb,
    CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS formatted,
    CAST(pow(2, ceil(log2(greatest(event_id, 2)))) AS BIGINT) AS ring, CASE WHEN event_id < 100 THEN 100 WHEN event_id < 1000 THEN 25 WHEN event_id < 10000 THEN 10 ELSE 5 END AS bucket FROM e"""
)
def est_scalars(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1000003).alias("n"))
    return e.select(
        "event_id",
        sizing.parse_size(F.concat(F.col("event_id").cast("string"), F.lit(" KB"))).alias("parsed"),
        sizing.parse_size(F.concat((F.col("event_id") * 1.5).cast("decimal(20,1)").cast("string"), F.lit("mb"))).alias("parsed_mb"),
        sizing.format_size(F.col("n")).alias("formatted"),
        sizing.ring_capacity(F.col("event_id")).alias("ring"),
        sizing.bucket_percent(F.col("event_id")).alias("bucket"),
    )


@query(f"WITH {LOGS} SELECT method_key, replace(replace(method_key, '.', '_'), '#', '_') AS config_key, regexp_replace(method_key, '^[^#]*\\.([^.#]*#)', '\\1') AS tag, count(*) AS n FROM logs GROUP BY method_key")
def est_method_names(spark, sf_dir):
    return _logs(spark, sf_dir).groupBy("method_key").agg(F.count("*").alias("n")).select("method_key", sizing.method_config_key(F.col("method_key")).alias("config_key"), sizing.method_tag(F.col("method_key")).alias("tag"), "n")


@query(f"WITH {LOGS}, r AS (SELECT {REASON} AS reason FROM logs) SELECT CASE WHEN reason IN ('level_filter', 'logger_filter', 'handler_filter', 'ignored') THEN 'filtered' ELSE coalesce(reason, 'collected') END AS tag, count(*) AS n FROM r GROUP BY 1")
def est_reason_tags(spark, sf_dir):
    return _reasoned(spark, sf_dir).groupBy(F.coalesce(sizing.reason_tag(F.col("discard_reason")), F.lit("collected")).alias("tag")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {LOGS} SELECT trace_id, seq, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0') || '] ' || rpad(level, 5, ' ') || ' [' || lpad(thread_name, 10, ' ') || '] ' || right(logger_name, 6) || ' ' ||
    CASE WHEN length(logger_name) <= 5 THEN logger_name ELSE 'a.' || event_type END || ' - ' || content || ' {{k=' || mdc_k || '}} ' || mdc_k || coalesce(chr(10) || throwable, '') || chr(10) AS line FROM logs"""
)
def fmt_layout(spark, sf_dir):
    return _logs(spark, sf_dir).select("trace_id", "seq", layout.compile_layout("[%d{yyyy-MM-dd HH:mm:ss.SSS}] %-5level [%10t] %.6loggerFull %c{5} - %msg %X %X{k}%ex%n").alias("line"))


# ---- batching --------------------------------------------------------------------------------------------------------

GROUPED = """SELECT trace_id, CAST(batch_id AS BIGINT) AS batch_id, string_agg(line, chr(10) ORDER BY seq) AS content, CAST(count(*) AS INT) AS entry_count, CAST(sum(bytes) AS BIGINT) AS total_bytes,
  arg_max(level, rank * 1000000000 - seq) AS max_level, arg_min(ts_ms, seq) AS first_ms, arg_max(ts_ms, seq) AS last_ms FROM b GROUP BY trace_id, batch_id"""


def _batches(df: DataFrame) -> DataFrame:
    return df.select("trace_id", "batch_id", "content", "entry_count", "total_bytes", "max_level", F.unix_millis("first_time").alias("first_ms"), F.unix_millis("last_time").alias("last_ms"))


@query(f"WITH {LOGS}, b AS (SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1) // 20 AS batch_id, content AS line, 2 * length(content) AS bytes FROM logs) {GROUPED}")
def agg_count_batches(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumns({"batch_id": batching.batches_by_count(20), "line": F.col("content"), "bytes": sizing.line_bytes(F.col("content"))})
    return _batches(batching.finalise(df))


def _fold_sql(size: str, condition_before: str, condition_after: str, more: str = "", rows: str = "(SELECT *, content AS line FROM logs)") -> str:
    """A recursive fold over each trace: state (batch, n, bytes) before a record decides where it goes."""
    return f"""WITH RECURSIVE {LOGS}{more}, s AS (SELECT *, CAST({size} AS BIGINT) AS bytes, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS i FROM {rows}),
    f AS (SELECT trace_id, i, 0 AS batch_id, 1 AS n, bytes AS total, bytes FROM s WHERE i = 1
      UNION ALL SELECT s.trace_id, s.i, CASE WHEN brk THEN p.batch_id + 1 ELSE p.batch_id END, CASE WHEN brk THEN 1 ELSE p.n + 1 END, CASE WHEN brk THEN s.bytes ELSE p.total + s.bytes END, s.bytes
      FROM f p JOIN s ON s.trace_id = p.trace_id AND s.i = p.i + 1, LATERAL (SELECT ({condition_after}) OR ({condition_before}) AS brk)),
    b AS (SELECT s.*, f.batch_id FROM s JOIN f USING (trace_id, i)) {GROUPED}"""


@query(_fold_sql("2 * length(content)", "false", "p.n >= 50 OR p.total >= 1200"))
def agg_pipeline_batches(spark, sf_dir):
    return _batches(batching.aggregate(_logs(spark, sf_dir).withColumn("line", F.col("content")), 50, 1200))


@query(_fold_sql(f"64 + {_s_sql('content')}", "p.n + 1 > 12 OR p.total + s.bytes > 2000", "p.n >= 12 OR p.total >= 2000"))
def agg_legacy_batches(spark, sf_dir):
    return _batches(batching.aggregate(_logs(spark, sf_dir).withColumn("line", F.col("content")), 12, 2000, mode="legacy"))


LEGACY_FLOW = f""", k AS (SELECT *, rpad(level, 5, ' ') || ' ' || logger_name || ' - ' || content || coalesce(chr(10) || throwable, '') AS line FROM (SELECT *, {REASON} AS reason FROM logs) WHERE reason IS NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS nr FROM k),
    a AS (SELECT trace_id, 1 AS nr, 1 AS seen, 0 AS kept, false AS taken FROM o WHERE nr = 1
      UNION ALL SELECT trace_id, nr + 1, CASE WHEN NOT past THEN seen + 1 WHEN (seen + 1) % 2 = 0 THEN seen + 2 ELSE seen + 1 END, kept + got::INT, got
      FROM (SELECT o.trace_id, a.nr, a.seen, a.kept, a.kept >= 8 AS past, CASE WHEN a.kept < 8 THEN (a.seen + 1) % 2 = 0 ELSE false END AS got FROM a JOIN o ON o.trace_id = a.trace_id AND o.nr = a.nr + 1)),
    t AS (SELECT o.* FROM o JOIN a USING (trace_id, nr) WHERE taken)"""


@query(_fold_sql(f"64 + {_s_sql('line')}", "p.n + 1 > 3 OR p.total + s.bytes > 700", "p.n >= 3 OR p.total >= 700", LEGACY_FLOW, "t"))
def legacy_flow(spark, sf_dir):
    """The legacy path from filters to overflow: reasons with the cleaned summary, security, then the total limit with the policy
    SAMPLE and every second record, whose sampler counts once more for a record over the limit, then batches."""
    kept = text.secure_record(_reasoned(spark, sf_dir, "legacy").filter("discard_reason IS NULL"))
    lines = kept.select("trace_id", "seq", "level", "ts_ms", layout.compile_layout("%-5p %C - %m%ex").alias("line"))
    lines = lines.withColumns({"bytes": sizing.segment_bytes(F.col("line")), "high": high_priority(F.col("level"))})
    taken = batching.ordered_fold(lines, ["trace_id"], ["seq"], ["bytes", "high"], "reason string", batching.total_limits(8, 0, "SAMPLE", "legacy", every=2)).filter("reason IS NULL")
    return _batches(batching.aggregate(taken.select("trace_id", "seq", "level", "ts_ms", "line"), 3, 700, mode="legacy"))


@query(
    f"""WITH {LOGS}, s AS (SELECT *, content AS line, CAST(64 + {_s_sql("content")} AS BIGINT) AS bytes FROM logs), w AS (SELECT *, count(*) OVER t AS n, sum(bytes) OVER t AS total FROM s WINDOW t AS (PARTITION BY trace_id ORDER BY seq DESC)),
    b AS (SELECT *, 0 AS batch_id FROM w WHERE n <= 10 AND total <= 1500) {GROUPED}"""
)
def agg_drop_oldest(spark, sf_dir):
    return _batches(batching.aggregate(_logs(spark, sf_dir).withColumn("line", F.col("content")), 10, 1500, mode="legacy", overflow="DROP_OLDEST"))


@query(
    f"""WITH {LOGS}, l AS (SELECT *, CASE WHEN event_id % 37 = 0 THEN repeat(content, 40) ELSE content END AS line FROM logs), s AS (SELECT *, CAST(64 + {_s_sql("line")} AS BIGINT) AS bytes FROM l),
    w AS (SELECT *, count(*) OVER t AS n, sum(bytes) OVER t AS total FROM s WHERE bytes <= 1500 WINDOW t AS (PARTITION BY trace_id ORDER BY seq DESC)),
    b AS (SELECT * EXCLUDE (n, total), 0 AS batch_id FROM w WHERE n <= 10 AND total <= 1500 UNION ALL SELECT *, -1 - seq FROM s WHERE bytes > 1500) {GROUPED}"""
)
def agg_oversized(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumn("line", F.when(F.col("seq") % 37 == 0, F.repeat("content", 40)).otherwise(F.col("content")))
    return _batches(batching.aggregate(df, 10, 1500, mode="legacy", overflow="DROP_OLDEST"))


@query(f"WITH {LOGS}, s AS (SELECT *, content AS line, CAST(64 + {_s_sql('content')} AS BIGINT) AS bytes, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM logs), b AS (SELECT *, 0 AS batch_id FROM s WHERE n <= 10) {GROUPED}")
def agg_drop_newest(spark, sf_dir):
    return _batches(batching.aggregate(_logs(spark, sf_dir).withColumn("line", F.col("content")), 10, 0, mode="legacy", overflow="DROP_NEWEST"))


@query(
    f"""WITH RECURSIVE {LOGS}, s AS (SELECT *, 2 * length(content) AS bytes, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS i FROM logs),
    f AS (SELECT trace_id, i, 0 AS batch_id, 1 AS n, bytes AS total FROM s WHERE i = 1 UNION ALL
      SELECT s.trace_id, s.i, CASE WHEN p.n >= 25 OR p.total >= 700 THEN p.batch_id + 1 ELSE p.batch_id END, CASE WHEN p.n >= 25 OR p.total >= 700 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n >= 25 OR p.total >= 700 THEN s.bytes ELSE p.total + s.bytes END
      FROM f p JOIN s ON s.trace_id = p.trace_id AND s.i = p.i + 1) SELECT trace_id, seq, CAST(f.batch_id AS BIGINT) AS batch_id FROM s JOIN f USING (trace_id, i)"""
)
def agg_single_batches(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumn("bytes", sizing.line_bytes(F.col("content")))
    return cutting.cut_batches(df, cutting.Limits(25, 700)).select("trace_id", "seq", "batch_id")


ENTRY_SQL = f"""CAST(112 + {" + ".join(_s_sql(c) for c in ("trace_id", "content", "level", "thread_name", "logger_name", "throwable"))} + 208 + 48 + {_s_sql("'k'")} + {_s_sql("mdc_k")} AS BIGINT)"""


@query(
    f"""WITH RECURSIVE {LOGS}, r AS (SELECT * REPLACE (CASE WHEN event_id % 37 = 0 THEN repeat(content, 200) ELSE content END AS content) FROM logs), e AS (SELECT *, {ENTRY_SQL} AS bytes FROM r),
    s AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS i FROM e WHERE bytes <= 6000),
    f AS (SELECT trace_id, i, 0 AS batch_id, 1 AS n, bytes AS total FROM s WHERE i = 1 UNION ALL
      SELECT s.trace_id, s.i, p.batch_id + brk::INT, CASE WHEN brk THEN 1 ELSE p.n + 1 END, CASE WHEN brk THEN s.bytes ELSE p.total + s.bytes END
      FROM f p JOIN s ON s.trace_id = p.trace_id AND s.i = p.i + 1, LATERAL (SELECT p.n + 1 > 9 OR p.total + s.bytes > 6000 OR p.total >= 6000 AS brk))
    SELECT trace_id, seq, bytes, CAST(f.batch_id AS BIGINT) AS batch_id, 'buffered' AS fate FROM s JOIN f USING (trace_id, i)
    UNION ALL SELECT trace_id, seq, bytes, -1 - seq, 'direct' FROM e WHERE bytes > 6000"""
)
def agg_legacy_single(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumn("content", F.when(F.col("seq") % 37 == 0, F.repeat("content", 200)).otherwise(F.col("content")))
    return batching.legacy_single(df, 9, 6000).select("trace_id", "seq", "bytes", "batch_id", "fate")


@query(f"WITH {LOGS}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM logs) SELECT trace_id, seq, CASE WHEN n > 40 THEN 'total_limit_reached' END AS reason FROM n")
def agg_total_limit(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumns({"bytes": sizing.aggregate_bytes(), "high": high_priority(F.col("level"))})
    return df.select("trace_id", "seq", batching.limit_reason(40).alias("reason"))


@query(f"WITH {LOGS}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM logs) SELECT trace_id, seq, CASE WHEN n > 40 AND rank < 3 THEN 'total_limit_downgrade' END AS reason FROM n")
def agg_limit_downgrade(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumns({"bytes": sizing.processed_bytes(), "high": high_priority(F.col("level"))})
    return df.select("trace_id", "seq", batching.limit_reason(40, "DOWNGRADE_LEVEL", "legacy").alias("reason"))


@query(
    f"""WITH RECURSIVE {LOGS}, s AS (SELECT *, CAST(64 + {_s_sql("content")} + {_s_sql("throwable")} AS BIGINT) AS bytes, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS i FROM logs),
    f AS (SELECT trace_id, i, bytes AS used, 'accepted' AS fate FROM s WHERE i = 1 UNION ALL
      SELECT s.trace_id, s.i, CASE WHEN p.used + s.bytes <= 4000 OR (s.rank >= 3 AND p.used + s.bytes <= 6000) THEN p.used + s.bytes ELSE p.used END,
        CASE WHEN p.used + s.bytes <= 4000 THEN 'accepted' WHEN s.rank >= 3 AND p.used + s.bytes <= 6000 THEN 'forced' ELSE 'rejected' END FROM f p JOIN s ON s.trace_id = p.trace_id AND s.i = p.i + 1)
    SELECT s.trace_id, s.seq, f.fate, CAST(f.used AS BIGINT) AS used FROM s JOIN f USING (trace_id, i)"""
)
def agg_quota(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumns({"bytes": sizing.aggregate_bytes(), "high": high_priority(F.col("level"))})
    return batching.ordered_fold(df, ["trace_id"], ["seq"], ["bytes", "high"], "fate string, used long", batching.quota(4000, floor=0)).select("trace_id", "seq", "fate", "used")


@query(
    f"WITH {LOGS} SELECT trace_id, seq, content, level AS max_level, CAST({_s_sql('content')} AS BIGINT) AS total_bytes, CAST(1 AS INT) AS entry_count FROM logs"
)
def agg_direct_writes(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumn("line", F.col("content"))
    return batching.direct(df).select("trace_id", F.col("batch_id").alias("seq"), "content", "max_level", "total_bytes", "entry_count")


@query(
    f"""WITH {LOGS}, f AS (SELECT trace_id AS store, method_key, min(ts_ms) AS mtime_ms, CAST(sum(length(content) + 1) AS BIGINT) AS size FROM logs GROUP BY 1, 2),
    m AS (SELECT max(mtime_ms) - 3600000 AS least FROM f), w AS (SELECT *, sum(CASE WHEN mtime_ms >= least THEN size ELSE 0 END) OVER (PARTITION BY store ORDER BY mtime_ms DESC, method_key DESC ROWS UNBOUNDED PRECEDING) AS newer FROM f, m)
    SELECT store, method_key AS file, size, CASE WHEN mtime_ms < least THEN 'expired' WHEN newer <= 900 THEN 'kept' ELSE 'evicted' END AS fate FROM w"""
)
def agg_degrade_retention(spark, sf_dir):
    files = _logs(spark, sf_dir).groupBy(F.col("trace_id").alias("store"), F.col("method_key").alias("file")).agg(F.min("ts_ms").alias("mtime_ms"), F.sum(F.length("content") + 1).alias("size"))
    now = files.agg(F.max("mtime_ms")).first()[0]
    return batching.retained(files, 3_600_000, now, 900).select("store", "file", "size", "fate")


# ---- reliability -----------------------------------------------------------------------------------------------------


@query()
def rel_breaker(spark, sf_dir):
    attempts = _logs(spark, sf_dir).select("method_key", F.col("ts_ms").alias("t_ms"), "seq", (F.col("seq") % 100 >= 55).alias("ok"))
    return reliability.run_breaker(attempts, interval_ms=60_000).select("method_key", "seq", "allowed", "state", "interval_ms", "recovered")


@query(
    f"""WITH {LOGS}, d AS (SELECT *, ['FILE', 'LIMITED_MEMORY', 'DISCARD_NON_ERROR', 'DISCARD_ALL'][CAST(event_id % 4 + 1 AS INT)] AS storage, event_id % 3 > 0 AS f, event_id % 5 > 0 AS m FROM logs),
    t AS (SELECT trace_id, seq, CASE WHEN storage = 'DISCARD_ALL' OR (storage = 'DISCARD_NON_ERROR' AND rank < 4) THEN 'discarded' WHEN storage = 'FILE' THEN CASE WHEN f THEN 'file' WHEN m THEN 'memory' ELSE 'failed' END ELSE CASE WHEN m THEN 'memory' WHEN f THEN 'file' ELSE 'failed' END END AS target FROM d)
    SELECT *, CASE WHEN target = 'failed' THEN 'ultimate_discard' END AS reason FROM t"""
)
def rel_degrade_routing(spark, sf_dir):
    storage = F.element_at(F.array(*(F.lit(x) for x in ("FILE", "LIMITED_MEMORY", "DISCARD_NON_ERROR", "DISCARD_ALL"))), (F.col("seq") % 4 + 1).cast("int"))
    target = reliability.degrade_target(storage, F.col("level"), F.col("seq") % 3 > 0, F.col("seq") % 5 > 0)
    return _logs(spark, sf_dir).select("trace_id", "seq", target.alias("target"), reliability.ultimate(target).alias("reason"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 5 + 1 AS INT) ELSE 3 END AS attempts, event_id % 5 < 3 AS success,
    CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 100 ELSE 300 END AS BIGINT) AS waited_ms, event_id % 11 > 5 AS timed_out FROM events"""
)
def rel_retries(spark, sf_dir):
    tries = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i == F.col("event_id") % 5)
    done = reliability.retried(tries)
    return _table(spark, sf_dir, "events").select("event_id", done.alias("r"), reliability.timed_out((F.col("event_id") % 11) * 1000).alias("timed_out")).select("event_id", "r.attempts", "r.success", "r.waited_ms", "timed_out")


@query(f"WITH {LOGS}, b AS (SELECT *, event_id // 50 AS batch_id FROM logs) SELECT trace_id, batch_id, arg_max(level, rank * 1000000000 - seq) AS level, string_agg(content, chr(10) ORDER BY seq) AS content, count(*) AS n FROM b GROUP BY 1, 2")
def rel_degraded_batches(spark, sf_dir):
    return reliability.degraded_batches(_logs(spark, sf_dir).withColumn("batch_id", F.floor(F.col("seq") / 50)))


# ---- sinks -----------------------------------------------------------------------------------------------------------


@query(f"WITH {LOGS} SELECT trace_id, content, level, ts_ms AS time_ms FROM logs")
def snk_single_rows(spark, sf_dir):
    return sinks.single_rows(_logs(spark, sf_dir)).select("trace_id", "content", "level", F.unix_millis("time").alias("time_ms"))


@query(
    f"""WITH {LOGS}, b AS (SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1) // 20 AS batch_id, content AS line, 2 * length(content) AS bytes FROM logs), g AS ({GROUPED})
    SELECT trace_id, content, entry_count, max_level, batch_id = max(batch_id) OVER (PARTITION BY trace_id) AS is_final, last_ms AS time_ms FROM g QUALIFY batch_id % 2 = 1"""
)
def snk_aggregate_rows(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumns({"batch_id": batching.batches_by_count(20), "line": F.col("content"), "bytes": sizing.line_bytes(F.col("content"))})
    batches = batching.finalise(df)
    return sinks.aggregate_rows(batches, batches.filter("batch_id % 2 = 0")).withColumn("time_ms", F.unix_millis("time")).drop("time")


@query(
    f"""WITH {LOGS}, g AS (SELECT trace_id, ts_ms, CAST(sum(strlen(content) + 1) AS BIGINT) AS size, count(*) AS lines FROM logs WHERE rank >= 3 GROUP BY 1, 2)
    SELECT substring(sha256(trace_id), 1, 32) || '_' || ts_ms || '.log' AS file, size, lines FROM g"""
)
def snk_degrade_files(spark, sf_dir):
    return sinks.degrade_files(_logs(spark, sf_dir).filter(high_priority(F.col("level")))).select("file", "size", "lines")


@query(f"WITH {LOGS} SELECT trace_id, seq, row_number() OVER (PARTITION BY trace_id ORDER BY seq) <= 15 AS stored, content AS decrypted FROM logs")
def snk_memory_and_encryption(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    kept = sinks.memory_kept(_logs(spark, sf_dir).withColumn("store", F.col("trace_id")), 15)
    return kept.select("trace_id", "seq", "stored", sinks.decrypted(sinks.encrypted(F.col("content"), key), key).alias("decrypted"))


# ---- metrics ---------------------------------------------------------------------------------------------------------


@query(f"WITH {LOGS} SELECT level, method_key, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM logs GROUP BY 1, 2")
def met_counters(spark, sf_dir):
    return metrics.counters(_logs(spark, sf_dir).withColumn("len", F.length("content").cast("long")), ["level", "method_key"], {"chars": "len"})


@query(f"WITH {LOGS} SELECT method_key, round(arg_max(value, seq), 6) AS value, max(seq) AS at FROM logs GROUP BY 1")
def met_gauges(spark, sf_dir):
    samples = _table(spark, sf_dir, "events").select(F.concat(F.lit("app.EventService#"), "event_type").alias("method_key"), "value", F.col("event_id").alias("ts_ms"))
    return metrics.gauges(samples, ["method_key"]).withColumn("value", metrics.rounded("value", 6))


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def met_timers(spark, sf_dir):
    t = metrics.timers(_table(spark, sf_dir, "events"), ["event_type"], "value")
    return t.select("event_type", "n", *(metrics.rounded(p, 6).alias(p) for p in ("p50", "p95", "p99")))


@query(
    """WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1), t AS (SELECT count(*) AS methods, count(*) FILTER (last = 'error') AS open, count(*) FILTER (last = 'purchase') AS half_open FROM s)
    SELECT CASE WHEN open > 0 THEN 'DOWN' WHEN half_open > 0 THEN 'DEGRADED' ELSE 'UP' END AS status, methods, open, half_open FROM t"""
)
def met_health(spark, sf_dir):
    states = _table(spark, sf_dir, "events").select(F.col("user_id").alias("method_key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "OPEN").when(F.col("event_type") == "purchase", "HALF_OPEN").otherwise("CLOSED").alias("state"))
    return metrics.health(states, order=["seq"])


@query(
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTES, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, epoch_ms(start) AS start_ms, n, round(n / 5.0, 6) AS per_minute FROM w WHERE n / 5.0 > 0.4"""
)
def met_alerts(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return metrics.alerts(e, "at", ["event_type"], 0.4).select("event_type", F.unix_millis("start").alias("start_ms"), "n", metrics.rounded("per_minute", 6).alias("per_minute"))


SAMPLES = "samples AS (SELECT CAST(event_id // 100 AS INT) AS run, event_type AS scenario, event_id, value, 1000 + event_id % 7 AS total_logs, value / 10 AS elapsed_s, event_id % 13 AS gc_time_ms FROM events)"


def _samples(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 100).cast("int").alias("run"), F.col("event_type").alias("scenario"), "event_id", "value", (1000 + F.col("event_id") % 7).alias("total_logs"), (F.col("value") / 10).alias("elapsed_s"), (F.col("event_id") % 13).alias("gc_time_ms"))


@query(f"WITH {SAMPLES} SELECT event_id, round(total_logs / elapsed_s, 4) AS throughput, round(elapsed_s * 1e9 / total_logs, 2) AS latency_ns, round(gc_time_ms / (elapsed_s * 1000) * 100, 6) AS gc_percent FROM samples WHERE value > 1")
def met_throughput(spark, sf_dir):
    return metrics.throughput(metrics.valid_series(_samples(spark, sf_dir).filter("value > 1"), "value")).select("event_id", metrics.rounded("throughput", 4).alias("throughput"), metrics.rounded("latency_ns", 2).alias("latency_ns"), metrics.rounded("gc_percent", 6).alias("gc_percent"))


@query(
    f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY run, scenario ORDER BY value) AS r, count(*) OVER (PARTITION BY run, scenario) AS c FROM samples),
    t AS (SELECT * FROM r WHERE r > greatest(0, least(2, (c - 3) // 2)) AND r <= c - greatest(0, least(2, (c - 3) // 2)))
    SELECT run, scenario, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, count(*) AS n FROM t GROUP BY 1, 2"""
)
def met_trimmed_mean(spark, sf_dir):
    t = metrics.trimmed(_samples(spark, sf_dir), ["run", "scenario"], "value", 2)
    return t.withColumns({c: metrics.rounded(c, 6) for c in ("mean", "p50", "p90")})


@query(
    f"""WITH {SAMPLES}, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY run, scenario) AS med, count(*) OVER (PARTITION BY run, scenario) AS c FROM samples),
    d AS (SELECT *, abs(value - med) / CASE WHEN abs(med) < 1e-9 THEN 1 ELSE abs(med) END AS dev FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY run, scenario ORDER BY dev DESC, event_id) AS r FROM d)
    SELECT run, scenario, round(avg(value) FILTER (NOT (dev > 0.25 AND r <= least(2, greatest(0, c - 3)))), 6) AS mean, count(*) FILTER (NOT (dev > 0.25 AND r <= least(2, greatest(0, c - 3)))) AS kept, count(*) AS n FROM r GROUP BY 1, 2"""
)
def met_outlier_mean(spark, sf_dir):
    return metrics.without_outliers(_samples(spark, sf_dir), ["run", "scenario"], "value", "event_id").withColumn("mean", metrics.rounded("mean", 6))


@query(f"WITH {SAMPLES}, r AS (SELECT run, max(value) FILTER (scenario = 'click') AS a, max(value) FILTER (scenario = 'view') AS b FROM samples GROUP BY 1) SELECT run, round(a / b, 6) AS ratio FROM r WHERE b > 0 AND a IS NOT NULL")
def met_ratio_series(spark, sf_dir):
    return metrics.ratio_series(_samples(spark, sf_dir), "run", "scenario", "value", "click", "view").withColumn("ratio", metrics.rounded("ratio", 6))


@query(
    f"""WITH {SAMPLES}, c AS (SELECT run, avg(value) AS current FROM samples WHERE scenario <> 'error' AND run % 7 > 0 GROUP BY 1), b AS (SELECT run, avg(value) AS baseline FROM samples WHERE scenario = 'error' AND run % 5 > 0 GROUP BY 1)
    SELECT run, round(current, 6) AS current, round(baseline, 6) AS baseline, round((current - baseline) / baseline * 100, 4) AS change, CASE WHEN baseline IS NULL THEN 'NEW' WHEN current IS NULL THEN 'REMOVED' WHEN (current - baseline) / baseline * 100 > 15 THEN 'SLOWER' WHEN (current - baseline) / baseline * 100 < -15 THEN 'FASTER' ELSE 'OK' END AS verdict FROM c FULL JOIN b USING (run)"""
)
def met_baseline_compare(spark, sf_dir):
    s = _samples(spark, sf_dir)
    now = s.filter("scenario <> 'error' AND run % 7 > 0").groupBy("run").agg(F.avg("value").alias("v"))
    base = s.filter("scenario = 'error' AND run % 5 > 0").groupBy("run").agg(F.avg("value").alias("v"))
    out = metrics.compare_baseline(now, base, "run", "v")
    return out.withColumns({"current": metrics.rounded("current", 6), "baseline": metrics.rounded("baseline", 6), "change": metrics.rounded("change", 4)})


@query(
    """WITH e AS (SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1), c AS (SELECT *, CASE WHEN first <> 0 THEN (last - first) / abs(first) * 100 WHEN last > 0 THEN 100.0 WHEN last < 0 THEN -100.0 ELSE 0.0 END AS change FROM e)
    SELECT user_id, first, last, round(change, 4) AS change, CASE WHEN change > 5 THEN 'improved' WHEN change < -5 THEN 'regressed' ELSE 'stable' END AS trend FROM c"""
)
def met_first_last(spark, sf_dir):
    return metrics.first_last(_table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").withColumn("change", metrics.rounded("change", 4))


@query(
    """WITH m AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type <> 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS baseline FROM events GROUP BY 1)
    SELECT user_id, round(v, 6) AS v, round(baseline * 0.9, 6) AS floor, CASE WHEN v >= baseline * 0.9 THEN 'PASS' WHEN user_id % 2 = 0 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM m JOIN b USING (user_id)"""
)
def met_gates(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    m, b = e.filter("event_type <> 'view'").groupBy("user_id").agg(F.avg("value").alias("v")), e.groupBy("user_id").agg(F.avg("value").alias("v"))
    return metrics.gate(m, b, "user_id", "v", 0.9, F.col("user_id") % 2 == 0).withColumns({"v": metrics.rounded("v", 6), "floor": metrics.rounded("floor", 6)})


@query("SELECT user_id, event_id, round((value - lag(value) OVER w) / lag(value) OVER w * 100, 4) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def met_percent_delta(spark, sf_dir):
    return metrics.percent_delta(_table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", metrics.rounded("delta", 4).alias("delta"))


@query(
    """WITH s AS (SELECT event_type, CASE WHEN value > 300 THEN 'FAIL' WHEN value > 200 THEN 'WARN' ELSE 'PASS' END AS s, user_id FROM events)
    SELECT event_type, user_id, count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'WARN') AS warned, count(*) FILTER (s = 'FAIL') AS failed, CASE WHEN count(*) FILTER (s = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (s = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM s GROUP BY 1, 2"""
)
def met_matrix(spark, sf_dir):
    s = _table(spark, sf_dir, "events").withColumn("s", F.when(F.col("value") > 300, "FAIL").when(F.col("value") > 200, "WARN").otherwise("PASS"))
    return metrics.matrix(s, ["event_type", "user_id"], "s")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def met_top_users(spark, sf_dir):
    return metrics.top(_table(spark, sf_dir, "events"), "user_id", 10)


# ---- configuration ---------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT event_id, event_type AS method_key, CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'method' END AS scope, CAST(user_id % 5 AS INT) AS source_order, ['level', 'mask', 'global_soft_bytes'][CAST(event_id % 3 + 1 AS INT)] AS key FROM events),
    u AS (SELECT scope, source_order, method_key, key, CAST(max(event_id) AS VARCHAR) AS value FROM p GROUP BY 1, 2, 3, 4),
    g AS (SELECT 'global' AS scope, source_order, key, max(CAST(value AS BIGINT))::VARCHAR AS value FROM u WHERE scope = 'global' GROUP BY 1, 2, 3),
    m AS (SELECT * FROM u WHERE scope = 'method' AND key <> 'global_soft_bytes'), a AS (SELECT method_key, key, 1 AS s, source_order, value FROM m UNION ALL SELECT k.method_key, g.key, 0, g.source_order, g.value FROM g, (SELECT DISTINCT method_key FROM m) k)
    SELECT method_key, key, arg_max(value, s * 1000 - source_order) AS value FROM a GROUP BY 1, 2"""
)
def cfg_resolution(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    key = F.element_at(F.array(F.lit("level"), F.lit("mask"), F.lit("global_soft_bytes")), (F.col("event_id") % 3 + 1).cast("int"))
    p = e.select("event_id", F.col("event_type").alias("method_key"), F.when(F.col("user_id") % 2 == 0, "global").otherwise("method").alias("scope"), (F.col("user_id") % 5).cast("int").alias("source_order"), key.alias("key"))
    m = p.filter("scope = 'method'").groupBy("scope", "source_order", "method_key", "key").agg(F.max("event_id").cast("string").alias("value"))
    g = p.filter("scope = 'global'").groupBy("scope", "source_order", "key").agg(F.max("event_id").cast("string").alias("value")).withColumn("method_key", F.lit(None).cast("string"))
    return winning_properties(m.unionByName(g))


def _as_of_sql() -> str:
    """One ASOF join for each key, scope and source: 12 of them, the last change of each, the first of which that is set wins."""
    joins, columns = "", []
    for key, valid in (("level", "true"), ("max_buffer_size", "regexp_full_match(trim(value), '[+-]?[0-9]{1,18}')")):
        found = []
        for scope in ("method", "global"):
            for order in (100, 200, 1000):
                name = f"{key}_{scope}_{order}"
                same = "l.method_key = " + name + ".method_key AND " if scope == "method" else ""
                joins += f" ASOF LEFT JOIN (SELECT method_key, from_ms, CASE WHEN {valid} THEN trim(value) END AS value FROM v WHERE key = '{key}' AND scope = '{scope}' AND source_order = {order}) {name} ON {same}l.ts_ms >= {name}.from_ms"
                found.append(f"{name}.value")
        columns.append(f"coalesce({', '.join(found)}, '{'INFO' if key == 'level' else '100'}') AS cfg_{key}")
    return f"""WITH {LOGS}, h AS (SELECT ts_ms AS from_ms, event_id AS version, [100, 200, 1000][CAST(event_id // 29 % 3 + 1 AS INT)] AS source_order, CASE WHEN event_id // 29 % 4 = 0 THEN 'global' ELSE 'method' END AS scope,
      CASE WHEN event_id // 29 % 4 = 0 THEN '' ELSE method_key END AS method_key, ['level', 'max_buffer_size'][CAST(event_id // 348 % 2 + 1 AS INT)] AS key,
      CASE WHEN event_id // 348 % 2 = 0 THEN ['DEBUG', 'WARN', 'ERROR', NULL, 'INFO'][CAST(event_id // 29 % 5 + 1 AS INT)] ELSE CASE WHEN event_id // 29 % 7 = 0 THEN 'many' ELSE CAST(event_id % 200 AS VARCHAR) END END AS value FROM logs WHERE event_id % 29 = 0),
    v AS (SELECT scope, method_key, source_order, key, from_ms, arg_max_null(value, version) AS value FROM h GROUP BY ALL),
    c AS (SELECT l.*, {', '.join(columns)} FROM logs l{joins})
    SELECT trace_id, seq, cfg_level, cfg_max_buffer_size, CASE WHEN rank < CASE cfg_level WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3 WHEN 'INFO' THEN 2 WHEN 'DEBUG' THEN 1 ELSE 0 END THEN 'level_filter' END AS reason FROM c"""


@query(_as_of_sql())
def cfg_as_of(spark, sf_dir):
    """Settings in force at each record: every 29th event is a change of some source's property, for its method or for all."""
    logs = _logs(spark, sf_dir)
    nth, of = F.floor(F.col("seq") / 29), F.floor(F.col("seq") / 348)
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))
    changes = logs.filter("seq % 29 = 0").select(
        F.col("ts_ms").alias("from_ms"), F.col("seq").alias("version"), pick((100, 200, 1000), nth).alias("source_order"), F.when(nth % 4 == 0, "global").otherwise("method").alias("scope"), "method_key",
        pick(("level", "max_buffer_size"), of).alias("key"),
        F.when(of % 2 == 0, pick(("DEBUG", "WARN", "ERROR", None, "INFO"), nth)).when(nth % 7 == 0, "many").otherwise((F.col("seq") % 200).cast("string")).alias("value"),
    )
    out = asof.configured(logs, changes, ["level", "max_buffer_size"], [100, 200, 1000])
    return out.select("trace_id", "seq", "cfg_level", "cfg_max_buffer_size", F.when(filters.below_configured(F.col("level"), F.col("cfg_level")), "level_filter").alias("reason"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN ['SINGLE', 'AGGREGATE'][CAST(event_id % 3 AS INT)] END, CASE WHEN event_id % 2 = 0 THEN 'SINGLE' END, 'AGGREGATE') AS mode FROM events")
def cfg_modes(spark, sf_dir):
    configured = F.when(F.col("event_id") % 3 == 1, "SINGLE").when(F.col("event_id") % 3 == 2, "AGGREGATE").otherwise("AUTO")
    return _table(spark, sf_dir, "events").select("event_id", resolve_mode(configured, F.when(F.col("event_id") % 2 == 0, "SINGLE").otherwise("AUTO")).alias("mode"))


# ---- more of batching, status and MDC --------------------------------------------------------------------------------


@query(f"WITH {LOGS}, b AS (SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1) // 20 AS batch_id FROM logs) SELECT trace_id, CAST(batch_id AS BIGINT) AS batch_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, CAST(count(*) AS INT) AS entry_count FROM b GROUP BY 1, 2")
def agg_time_bounds(spark, sf_dir):
    df = _logs(spark, sf_dir).withColumns({"batch_id": batching.batches_by_count(20), "line": F.col("content"), "bytes": sizing.line_bytes(F.col("content"))})
    return _batches(batching.finalise(df, by_time=True)).select("trace_id", "batch_id", "first_ms", "last_ms", "entry_count")


@query(f"WITH {LOGS} SELECT trace_id, round(greatest(count(*) / 50.0, sum(2 * length(content)) / 2000.0), 6) AS utilization FROM logs GROUP BY 1")
def agg_utilization(spark, sf_dir):
    one = _logs(spark, sf_dir).groupBy("trace_id").agg(F.count("*").alias("n"), F.sum(sizing.line_bytes(F.col("content"))).alias("b"))
    return one.select("trace_id", metrics.rounded(batching.utilization(F.col("n"), 50, F.col("b"), 2000), 6).alias("utilization"))


@query(
    f"""WITH {LOGS}, d AS (SELECT *, event_id % 40 = 0 AS drain FROM logs), g AS (SELECT *, sum(drain::INT) OVER (PARTITION BY trace_id ORDER BY seq) - drain::INT AS g FROM d),
    k AS (SELECT *, sum((NOT drain)::INT) OVER (PARTITION BY trace_id, g ORDER BY seq) AS k FROM g)
    SELECT trace_id, seq, CASE WHEN drain THEN 'drained' WHEN k <= 12 THEN 'offered' ELSE 'full' END AS fate, CAST(least(12, k) AS BIGINT) AS held FROM k"""
)
def agg_plain_buffer(spark, sf_dir):
    return batching.plain_buffer(_logs(spark, sf_dir), "trace_id", "seq", F.col("seq") % 40 == 0, 12).select("trace_id", "seq", "fate", "held")


@query(f"WITH {LOGS} SELECT to_json({{'level': level, 'n': count(*), 'chars': CAST(sum(length(content)) AS BIGINT), 'last': max(seq)}}) AS status FROM logs GROUP BY level")
def met_snapshot(spark, sf_dir):
    one = _logs(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("content").cast("long")).alias("c"), F.max("seq").alias("s"))
    return metrics.snapshot(one, level=F.col("level"), n=F.col("n"), chars=F.col("c"), last=F.col("s"))


@query(f"SELECT conv_id, turn, role AS role_x, CASE WHEN length({_san_sql('text')}) >= 8 THEN {_mask_sql(_san_sql('text'))} ELSE {_san_sql('text')} END AS text FROM conversations")
def sec_mdc(spark, sf_dir):
    mdc = text.secure_mdc(F.create_map(F.lit("role x"), F.col("role"), F.lit("text"), F.col("text")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", mdc.alias("m")).select("conv_id", "turn", F.col("m")["role_x"].alias("role_x"), F.col("m")["text"].alias("text"))


# ---- alerts, sketches and counter families -------------------------------------------------------------------------------

HOUR = 3_600_000
ALERTS = (
    monitoring.Rule("breaker_open", "circuit.state", "gauge", True, 0, 2 * HOUR, "warning"),
    monitoring.Rule("high_discard_rate", "discarded.total", "rate", True, 3 / 3600, 2 * HOUR, "warning", 5 * HOUR),
    monitoring.Rule("buffer_high_utilization", "buffer.global.utilization", "gauge", True, 0.5, 3 * HOUR, "warning"),
    monitoring.Rule("degrade_disk_low", "degrade.file.disk.free.bytes", "gauge", False, 1 << 30, 2 * HOUR, "critical"),
)


@query(
    f"""WITH s AS (SELECT 'breaker_open' AS rule, 'm' || (user_id % 10) AS series, epoch_ms(ts) AS tm, CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS v FROM events
      UNION ALL SELECT 'high_discard_rate', event_type, epoch_ms(ts), CAST((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) % 40 AS DOUBLE) FROM events
      UNION ALL SELECT 'buffer_high_utilization', 'all', epoch_ms(ts), (event_id % 100) / 100.0 FROM events UNION ALL SELECT 'degrade_disk_low', 'all', epoch_ms(ts), CAST(event_id * 37 % 1000 * 2147483 AS DOUBLE) FROM events),
    r AS (SELECT *, CAST(ceil(tm / {HOUR}) AS BIGINT) * {HOUR} AS g, v - lag(v) OVER (PARTITION BY rule, series ORDER BY tm, v) AS d FROM s),
    p AS (SELECT rule, series, g, sum(CASE WHEN d < 0 THEN v ELSE coalesce(d, 0) END) AS more, arg_max(v, (tm, v)) AS v FROM r GROUP BY ALL),
    l AS (SELECT rule, series, min(g) AS low FROM p GROUP BY ALL), k AS (SELECT rule, series, unnest(range(low, (SELECT max(g) + {HOUR} FROM p), {HOUR})) AS g FROM l),
    m AS (SELECT k.rule, k.series, k.g, CASE WHEN k.rule = 'high_discard_rate' THEN coalesce(sum(more) OVER (PARTITION BY k.rule, k.series ORDER BY k.g RANGE BETWEEN {5 * HOUR - 1} PRECEDING AND CURRENT ROW), 0) / {5 * 3600}
      ELSE last_value(v IGNORE NULLS) OVER (PARTITION BY k.rule, k.series ORDER BY k.g RANGE BETWEEN {2 * HOUR - 1} PRECEDING AND CURRENT ROW) END AS x FROM k LEFT JOIN p USING (rule, series, g)),
    h AS (SELECT *, coalesce(CASE rule WHEN 'breaker_open' THEN x > 0 WHEN 'high_discard_rate' THEN x > 3 / 3600 WHEN 'buffer_high_utilization' THEN x > 0.5 ELSE x < 1073741824 END, false) AS holds FROM m),
    b AS (SELECT *, holds AND NOT coalesce(lag(holds) OVER (PARTITION BY rule, series ORDER BY g), false) AS begins FROM h), i AS (SELECT *, sum(begins::INT) OVER (PARTITION BY rule, series ORDER BY g) AS island FROM b),
    a AS (SELECT rule, series, min(g) AS pending_from, max(g) AS last, CASE WHEN rule = 'degrade_disk_low' THEN min(x) ELSE max(x) END AS worst FROM i WHERE holds GROUP BY rule, series, island)
    SELECT rule, CASE WHEN rule = 'degrade_disk_low' THEN 'critical' ELSE 'warning' END AS severity, series, pending_from, CASE WHEN pending_from + w <= last THEN pending_from + w END AS firing_from,
      CASE WHEN last < (SELECT max(g) FROM p) THEN last + {HOUR} END AS ended_at, round(worst, 6) AS worst FROM (SELECT *, CASE WHEN rule = 'buffer_high_utilization' THEN {3 * HOUR} ELSE {2 * HOUR} END AS w FROM a)"""
)
def met_alert_rules(spark, sf_dir):
    """Four rules over samples that events make; hours for minutes, as events are minutes apart."""
    e = _table(spark, sf_dir, "events").withColumn("at_ms", F.expr("round(unix_micros(CAST(ts AS timestamp)), -3) div 1000"))  # the nearest, as of epoch_ms
    state = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    counter = F.row_number().over(W.partitionBy("event_type").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))) % 40
    parts = [
        ("circuit.state", F.concat(F.lit("m"), F.col("user_id") % 10), state), ("discarded.total", F.col("event_type"), counter),
        ("buffer.global.utilization", F.lit("all"), (F.col("event_id") % 100) / 100), ("degrade.file.disk.free.bytes", F.lit("all"), F.col("event_id") * 37 % 1000 * 2147483),
    ]
    samples = None
    for metric, series, value in parts:
        one = e.select(F.lit(metric).alias("metric"), series.alias("series"), "at_ms", value.cast("double").alias("value"))
        samples = one if samples is None else samples.unionByName(one)
    return monitoring.alert_intervals(samples, ALERTS, HOUR, 2 * HOUR).withColumn("worst", metrics.rounded("worst", 6))


@query("SELECT event_type, epoch_ms(date_trunc('day', ts)) AS day_ms, count(value) AS n, true AS within FROM events GROUP BY 1, 2")
def met_sketch_timers(spark, sf_dir):
    """Sketches of five minutes, merged to hours and then to days; within: each quantile's rank among the day's own values is at most a percent off."""
    e = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    kept = monitoring.sketches(e, ["event_type"], "value", "at")
    days = monitoring.timer_rows(monitoring.merged(monitoring.merged(kept, ["event_type"], "1 hour"), ["event_type"], "1 day"), ["event_type"])
    own = e.filter("value IS NOT NULL").select("event_type", F.date_trunc("day", "at").alias("start"), "value")
    both = own.join(days, ["event_type", "start"])
    off = [((F.count_if(F.col("value") < F.col(q)) <= (p + 0.01) * F.max("n")) & (F.count_if(F.col("value") <= F.col(q)) >= (p - 0.01) * F.max("n"))) for q, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return both.groupBy("event_type", F.unix_millis("start").alias("day_ms")).agg(F.max("n").alias("n"), (off[0] & off[1] & off[2]).alias("within"))


FAMILY_ROWS = f"""WITH {LOGS}, k AS (SELECT *, event_type AS method, {REASON} AS reason, event_id % 4 = 0 AS sanitized, event_id % 6 = 0 AS masked, event_id % 5 = 1 AS fast_path, CASE WHEN event_id % 97 = 0 THEN 'mask' END AS timeout_step FROM logs),
    c AS (SELECT *, CASE WHEN event_id % 31 = 0 THEN 'backpressure_pause' ELSE reason END AS why FROM k), b AS (SELECT trace_id, method, event_id // 50 AS nr, count(*) AS entries FROM c WHERE why IS NULL GROUP BY ALL),
    o AS (SELECT *, ['count', 'bytes', 'final'][CAST(nr % 3 + 1 AS INT)] AS trigger, CASE WHEN nr % 7 = 0 THEN NULL ELSE nr % 5 > 0 END AS persisted FROM b),
    f AS (SELECT 'collected' AS family, level, method, 'AGGREGATE' AS mode, NULL AS reason, NULL AS trigger, NULL AS overflow, NULL AS type, NULL AS outcome, NULL AS strategy, NULL AS step, NULL AS source, 1 AS n FROM c WHERE why IS NULL
      UNION ALL BY NAME SELECT 'discarded' AS family, method, why AS reason, 1 AS n FROM c WHERE why IS NOT NULL UNION ALL BY NAME SELECT 'sanitize.hits' AS family, method, 1 AS n FROM c WHERE sanitized
      UNION ALL BY NAME SELECT 'mask.hits' AS family, method, 1 AS n FROM c WHERE masked UNION ALL BY NAME SELECT 'fastpath.hits' AS family, method, 1 AS n FROM c WHERE fast_path
      UNION ALL BY NAME SELECT 'pipeline.backpressure' AS family, method, level, 1 AS n FROM c WHERE why LIKE 'backpressure%' UNION ALL BY NAME SELECT 'pipeline.timeout' AS family, method, timeout_step AS step, 1 AS n FROM c WHERE timeout_step IS NOT NULL
      UNION ALL BY NAME SELECT 'flush' AS family, method, 'AGGREGATE' AS mode, trigger, 1 AS n FROM o UNION ALL BY NAME SELECT 'persisted' AS family, method, 'AGGREGATE' AS mode, entries AS n FROM o WHERE persisted UNION ALL BY NAME SELECT 'persist.failed' AS family, method, 1 AS n FROM o WHERE NOT persisted
      UNION ALL BY NAME SELECT 'buffer.overflow' AS family, method, 'FLUSH_EARLY' AS overflow, 1 AS n FROM o WHERE trigger = 'bytes' UNION ALL BY NAME SELECT 'degrade.triggered' AS family, method, 'persist_failed' AS type, 1 AS n FROM o WHERE NOT persisted
      UNION ALL BY NAME SELECT 'direct_flush' AS family, method, 'ok' AS outcome, 1 AS n FROM o WHERE nr % 7 = 0 UNION ALL BY NAME SELECT 'overflow.degraded' AS family, method, 'FILE' AS strategy, 1 AS n FROM o WHERE nr % 11 = 0
      UNION ALL BY NAME SELECT 'force_allocate.rejected' AS family, method, 1 AS n FROM o WHERE nr % 13 = 0 UNION ALL BY NAME SELECT 'circuit.recovered' AS family, method, 1 AS n FROM o WHERE nr % 17 = 0 UNION ALL BY NAME SELECT 'handler.timeout' AS family, method, 1 AS n FROM o WHERE nr % 19 = 0
      UNION ALL BY NAME SELECT 'config.refresh' AS family, CASE WHEN event_id % 58 = 0 THEN 'nacos' ELSE 'unknown' END AS source, 1 AS n FROM logs WHERE event_id % 29 = 0)"""


def _families(spark, sf_dir):
    reasoned = _reasoned(spark, sf_dir)
    records = reasoned.select(
        "trace_id", "seq", F.substring_index("method_key", "#", -1).alias("method"), "level", F.lit("AGGREGATE").alias("mode"), F.when(F.col("seq") % 31 == 0, "backpressure_pause").otherwise(F.col("discard_reason")).alias("reason"),
        (F.col("seq") % 4 == 0).alias("sanitized"), (F.col("seq") % 6 == 0).alias("masked"), (F.col("seq") % 5 == 1).alias("fast_path"), F.when(F.col("seq") % 97 == 0, "mask").alias("timeout_step"),
    )
    nr = F.col("nr")
    flushed = records.filter("reason IS NULL").groupBy("trace_id", "method", F.floor(F.col("seq") / 50).alias("nr")).agg(F.count("*").alias("entries"))
    flushed = flushed.withColumn("persisted", F.when(nr % 7 != 0, nr % 5 > 0)).select(
        "method", F.lit("AGGREGATE").alias("mode"), F.element_at(F.array(F.lit("count"), F.lit("bytes"), F.lit("final")), (nr % 3 + 1).cast("int")).alias("trigger"), "persisted", "entries",
        F.when(nr % 3 == 1, "FLUSH_EARLY").alias("overflow"), F.when(~F.col("persisted"), "persist_failed").alias("degrade_type"), F.when(nr % 7 == 0, "ok").alias("direct_outcome"), F.when(nr % 11 == 0, "FILE").alias("strategy"),
        (nr % 13 == 0).alias("force_rejected"), (nr % 17 == 0).alias("recovered"), (nr % 19 == 0).alias("handler_timeout"),
    )
    refreshes = reasoned.filter("seq % 29 = 0").select(F.when(F.col("seq") % 58 == 0, "nacos").otherwise("").alias("source"))
    return monitoring.all_counters(records, flushed, refreshes)


@query(f"{FAMILY_ROWS} SELECT family, level, method, mode, reason, trigger, overflow, type, outcome, strategy, step, source, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL")
def met_families(spark, sf_dir):
    return _families(spark, sf_dir)


@query(
    f"""{FAMILY_ROWS}, t AS (SELECT family, concat_ws(',', 'level=' || level, 'method=' || method, 'mode=' || mode, 'reason=' || reason, 'trigger=' || trigger, 'overflow=' || overflow, 'type=' || type, 'outcome=' || outcome, 'strategy=' || strategy, 'step=' || step, 'source=' || source) AS tags, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL),
    g AS (SELECT family, sum(n) AS total, string_agg('{{"tags":"' || tags || '","n":' || n || '}}', ',' ORDER BY tags) AS by_tags FROM t GROUP BY 1)
    SELECT '{{' || string_agg('"' || family || '":{{"total":' || total || ',"by":[' || by_tags || ']}}', ',' ORDER BY family) || '}}' AS status FROM g"""
)
def met_status(spark, sf_dir):
    return monitoring.status_document(_families(spark, sf_dir))


# ---- files out and in ------------------------------------------------------------------------------------------------


@query(f"WITH {LOGS} SELECT ts_ms, level, thread_name, right(logger_name, 6) AS logger_name, content, throwable, mdc_k FROM logs")
def src_log_files(spark, sf_dir):
    """All records as lines of a layout, in files, and read back: records of several lines are put together and parsed."""
    pattern = "[%d{yyyy-MM-dd HH:mm:ss.SSS}] %-5level [%10t] %.6loggerFull {%X{k}} - %msg%ex%n"
    path = f"{shared_dir(spark)}/log-files-{uuid.uuid4().hex}"
    line = F.regexp_replace(layout.compile_layout(pattern), r"\n$", "")
    _logs(spark, sf_dir).select(line.alias("value")).write.text(path)
    back = logfiles.read_log_files(spark, path, pattern)
    return back.filter("parsed").select("ts_ms", "level", "thread_name", "logger_name", "content", "throwable", F.col("mdc")["k"].alias("mdc_k"))


@query(ORACLES["snk_degrade_files"])
def snk_written_files(spark, sf_dir):
    """Degrade files as they lie in the folder after they have been written."""
    path = f"{shared_dir(spark)}/degraded-{uuid.uuid4().hex}"
    degraded.write_degraded(_logs(spark, sf_dir).filter(high_priority(F.col("level"))), path, names=f"{path}-names", folders=1024)
    return degraded.read_degraded(spark, path, f"{path}-names")


@query(
    f"""WITH {LOGS}, b AS (SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1) // 20 AS batch_id, content AS line, 2 * length(content) AS bytes FROM logs), g AS ({GROUPED})
    SELECT trace_id, content, entry_count, max_level, batch_id = max(batch_id) OVER (PARTITION BY trace_id) AS is_final, last_ms AS time_ms, sha256(trace_id || '|' || batch_id) AS flush_id FROM g"""
)
def snk_ledger(spark, sf_dir):
    """Batches to a table that takes each once: two micro-batches, each handed over twice, and all of them under another run
    after the table has been compacted."""
    df = _logs(spark, sf_dir).withColumns({"batch_id": batching.batches_by_count(20), "line": F.col("content"), "bytes": sizing.line_bytes(F.col("content"))})
    batches = batching.finalise(df)
    book = ledger.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    main, again = ledger.LedgerHandler(book, "main"), ledger.LedgerHandler(book, "again")
    for part in (0, 0, 1, 1):
        main(batches.filter(F.col("batch_id") % 2 == part), part)
    book.compact()
    book.clean()
    again(batches, 0)
    return book.read().withColumn("time_ms", F.unix_millis("time")).drop("time")


# ---- end to end ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {LOGS}, k AS (SELECT *, {REASON} AS reason FROM logs), l AS (SELECT *, rpad(level, 5, ' ') || ' ' || logger_name || ' - ' || content || coalesce(chr(10) || throwable, '') AS line FROM k WHERE reason IS NULL),
    b AS (SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1) // 25 AS batch_id, 2 * length(line) AS bytes FROM l) {GROUPED}"""
)
def log_pipeline(spark, sf_dir):
    """Records with reasons, secured, laid out and batched: what the default path does with every event."""
    kept = text.secure_record(_reasoned(spark, sf_dir).filter("discard_reason IS NULL"))
    lines = kept.withColumn("line", layout.compile_layout("%-5p %C - %m%ex"))
    return _batches(batching.aggregate(lines, 25, 1 << 20))
