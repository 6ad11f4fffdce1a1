"""Tables and raw events as log records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record's level by the kind of event.
EVENT_LEVELS = {"error": "ERROR", "purchase": "WARN", "signup": "INFO", "click": "DEBUG", "view": "TRACE"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each user, ordered by event id."""
    kind = F.col("event_type")
    level = F.lit("TRACE")
    for k, v in EVENT_LEVELS.items():
        level = F.when(kind == k, v).otherwise(level)
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("app.EventService#"), kind).alias("method_key"),
        F.concat(kind, F.lit(" value="), F.format_string("%.2f", "value")).alias("content"),
        level.alias("level"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.concat(F.lit("worker-"), F.col("event_id") % 4).alias("thread_name"),
        F.concat(F.lit("app."), kind).alias("logger_name"),
        F.when(kind == "error", F.concat(F.lit("java.lang.IllegalStateException: "), kind, F.lit("\n\tat app.Service.run(Service.java:1)"))).alias("throwable"),
        F.from_json("props", "map<string,string>").alias("mdc"),
    )


def documents_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each source; levels from the labels."""
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = _table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("source").alias("trace_id"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("docs.Reader#"), "lang").alias("method_key"),
        F.col("text").alias("content"),
        F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARN").otherwise("INFO").alias("level"),
        (F.col("doc_id") * 1000).alias("ts_ms"),
        F.lit("reader").alias("thread_name"),
        F.concat(F.lit("docs."), "lang").alias("logger_name"),
        F.lit(None).cast("string").alias("throwable"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("mdc"),
    )


def conversations_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each conversation."""
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("trace_id"),
        F.col("turn").cast("long").alias("seq"),
        F.concat(F.lit("conv.Chat#"), "role").alias("method_key"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", "INFO").otherwise("DEBUG").alias("level"),
        (F.col("turn") * 1000).cast("long").alias("ts_ms"),
        F.lit(None).cast("string").alias("thread_name"),
        F.concat(F.lit("conv."), "role").alias("logger_name"),
        F.lit(None).cast("string").alias("throwable"),
        F.create_map(F.lit("role"), "role").alias("mdc"),
    )


def of_contexts(events: DataFrame, contexts: DataFrame, small: bool | None = None) -> DataFrame:
    """Events of registered contexts; others are left out and not counted.

    contexts grow with the traffic, so they are only broadcast where the caller knows them to be few (``small``);
    otherwise the planner decides by their size."""
    known = F.broadcast(contexts) if small else contexts
    return events.filter("trace_id IS NOT NULL").join(known, "trace_id")


def resolved_message(template: Column, args: Column, formatted: Column) -> Column:
    return F.when(F.coalesce(F.size(args), F.lit(0)) <= 0, F.coalesce(template, F.lit(""))).otherwise(F.coalesce(formatted, template, F.lit("")))


def projected_mdc(mdc: Column, static: Sequence[str], configured: Sequence[str], trace_key: str = "traceId") -> Column:
    """Allowed keys only: the static ones, then the configured ones (trimmed, without the trace key); nothing left is null."""
    keys = list(dict.fromkeys([*static, *(k for k in (x.strip() for x in configured) if k and k != trace_key)]))
    kept = F.map_filter(mdc, lambda k, v: k.isin(keys) & v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def thread_name(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def config_table(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Properties of several sources as rows (source, source_order, scope, method_key, key, value); unavailable ones give none."""
    rows = [(s["name"], s["order"], p["scope"], p.get("method_key"), p["key"], p["value"]) for s in sources if s.get("available", True) for p in s["properties"]]
    return spark.createDataFrame(rows, "source string, source_order int, scope string, method_key string, key string, value string")


def benchmark_samples(spark: SparkSession, path: str) -> DataFrame:
    """Runs of benchmark scenarios from JSON lines."""
    return spark.read.schema("run int, scenario string, total_logs long, elapsed_s double, throughput double, avg_latency_ns double, gc_count long, gc_time_ms long, heap_before long, heap_after long").json(path)


def marker_counts(lines: DataFrame, markers: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """How many lines (column value) match each marker's pattern."""
    return lines.groupBy(*by).agg(*(F.count_if(F.col("value").rlike(p)).alias(k) for k, p in markers.items()))


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
