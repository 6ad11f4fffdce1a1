"""Filters and sampling. Each dropped row gets a reason in one column; nothing is filtered before it is counted."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import summarize
from ..schema import config_rank, high_priority, level_rank

#: Loggers of the collecting library itself.
INTERNAL = ("cedarlog.", "org.apache.spark.")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_internal(logger: Column, prefixes: Sequence[str] = INTERNAL) -> Column:
    return F.coalesce(_any([logger.startswith(p) for p in prefixes]), F.lit(False))


def below_level(level: Column, least: str) -> Column:
    """A null level is below every threshold."""
    return level.isNull() | (level_rank(level) < config_rank(least))


def below_configured(level: Column, configured: Column) -> Column:
    """As ``below_level`` where every record has a threshold of its own."""
    name = F.upper(F.trim(configured))
    return level.isNull() | (level_rank(level) < level_rank(F.when(name == "WARNING", "WARN").otherwise(name)))


def excluded(logger: Column, prefixes: Sequence[str]) -> Column:
    return F.coalesce(_any([logger.startswith(p) for p in prefixes if p]), F.lit(False))


def discard_reason(
    least: str = "INFO",
    exclude: Sequence[str] = (),
    ignored: Column | None = None,
    collect: Callable[[Column, Column], Column] | None = None,
    mode: str = "pipeline",
    late: Column | None = None,
    enabled: Column | None = None,
    depth: Column | None = None,
    most_depth: int = 10,
) -> Column:
    """The first reason that holds, or null: switch, nesting, internal, ignore, level, logger, handler, late arrival.

    collect(level, summary) is the handler's predicate; its summary is the raw first 100 characters in pipeline mode,
    and 256 without control characters in legacy mode."""
    level, logger = F.col("level"), F.col("logger_name")
    summary = F.substring("content", 1, 100) if mode == "pipeline" else summarize(F.col("content"))
    rules = [
        (~enabled if enabled is not None else None, "disabled"),
        (depth >= most_depth if depth is not None else None, "nesting_depth"),
        (is_internal(logger), "internal"),
        (ignored, "ignored"),
        (below_level(level, least), "level_filter"),
        (excluded(logger, exclude), "logger_filter"),
        (~collect(level, summary) if collect else None, "handler_filter"),
        (late, "buffer_closed_late_arrival"),
    ]
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), r) for c, r in rules if c is not None))


def backpressure_reason(utilization: Column, pause: float = 0.95, skip: float = 0.8, callback: Callable[[Column], Column] | None = None) -> Column:
    """From a utilization column, or a callback that gives CONTINUE, SKIP_DEBUG_INFO or PAUSE; null means go on."""
    action = callback(utilization) if callback else F.when(utilization >= pause, "PAUSE").when(utilization >= skip, "SKIP_DEBUG_INFO").otherwise("CONTINUE")
    return F.when(action == "PAUSE", "backpressure_pause").when((action == "SKIP_DEBUG_INFO") & ~high_priority(F.col("level")), "backpressure_skip_low_level")


def shed_queue(df: DataFrame, capacity: int, overflow: int, key: str = "trace_id", order: str = "seq") -> DataFrame:
    """A ring of ``capacity`` records per key that is not drained: beyond it low levels are dropped
    (pipeline_backpressure); high ones go to an overflow queue, and beyond that degrade (pipeline_queue_full).
    counted: a discard is counted for every record beyond the ring, also for those the overflow queue takes."""
    w = W.partitionBy(key).orderBy(order)
    high = high_priority(F.col("level")).cast("int")
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__h", F.sum(F.when(F.col("__n") > capacity, high).otherwise(0)).over(w))
    full = F.col("__n") > capacity
    fate = F.when(~full, "queued").when(high == 0, "pipeline_backpressure").when(F.col("__h") <= overflow, "overflow").otherwise("pipeline_queue_full")
    return df.withColumns({"fate": fate, "counted": full}).drop("__n", "__h")


def retain_high(entries: Column) -> Column:
    """Of an array of structs with a level: those of WARN and above."""
    return F.filter(entries, lambda e: level_rank(e["level"]) >= 3)


def rejected_reason(level: Column, rejected: Column) -> Column:
    """The reason of records that go because their batch was rejected, or null: those below WARN. A record is judged
    in its row, so no batch is put together."""
    return F.when(rejected & (level_rank(level) < 3), "async_queue_full_low_level")


def normalise_rate(rate: float) -> float:
    return 0.0 if rate != rate or rate <= 0 else min(rate, 1.0)


def sample_by_rate(rate: float, key: Column | None = None, seed: int = 42) -> Column:
    """Keeps a share of the rows: by a random number, or repeatably by a key."""
    rate = normalise_rate(rate)
    if rate in (0.0, 1.0):
        return F.lit(rate == 1.0)
    return F.rand(seed) < rate if key is None else F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000)


def sample_by_count(rate: float, key: str = "trace_id", order: str = "seq") -> Column:
    """Keeps every k-th record of a key (not the first), k = max(1, round(1 / rate))."""
    rate = normalise_rate(rate)
    if rate in (0.0, 1.0):
        return F.lit(rate == 1.0)
    every = max(1, int(1 / rate + 0.5))
    return F.row_number().over(W.partitionBy(key).orderBy(order)) % every == 0


def sample_adaptive(rate: float, utilization: Column, key: Column | None = None) -> Column:
    """Below half all, below 0.8 a share, else WARN and above."""
    return F.when(utilization < 0.5, True).when(utilization < 0.8, sample_by_rate(rate, key)).otherwise(high_priority(F.col("level")))


def sampled_out(strategy: str, rate: float, utilization: Column | None = None, key: Column | None = None) -> Column:
    """The reason of rows that sampling drops, or null; rates of 1 and above keep all, 0 and below none."""
    rate = normalise_rate(rate)
    if rate in (0.0, 1.0):
        keep = F.lit(rate == 1.0)
    else:
        keep = {"RATE": lambda: sample_by_rate(rate, key), "COUNT": lambda: sample_by_count(rate), "ADAPTIVE": lambda: sample_adaptive(rate, utilization, key)}[strategy]()
    return F.when(~keep, "sampled_out")


def intercepted(df: DataFrame, transform: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """A hook that may replace or drop records."""
    return transform(df) if transform else df


def reason_counts(df: DataFrame, reason: str = "discard_reason", by: Sequence[str] = ()) -> DataFrame:
    """Kept rows count under 'collected'."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("collected")).alias("reason")).agg(F.count("*").alias("n"))
