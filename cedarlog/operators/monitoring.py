"""Monitoring over time: alerts that have to last, quantile sketches that merge, and all counters from one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- alerts ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """metric: what is watched. kind: gauge (the last value) or rate (increase a second over ``window_ms``). above: whether
    values above or below ``limit`` count. for_ms: how long they have to last until the alert fires."""

    name: str
    metric: str
    kind: str
    above: bool
    limit: float
    for_ms: int
    severity: str
    window_ms: int = 300_000


#: Limits and durations of the four rules.
RULES = (
    Rule("breaker_open", "circuit.state", "gauge", True, 0, 60_000, "warning"),
    Rule("high_discard_rate", "discarded.total", "rate", True, 10, 120_000, "warning"),
    Rule("buffer_high_utilization", "buffer.global.utilization", "gauge", True, 0.8, 180_000, "warning"),
    Rule("degrade_disk_low", "degrade.file.disk.free.bytes", "gauge", False, 1 << 30, 300_000, "critical"),
)


def alert_intervals(samples: DataFrame, rules: Sequence[Rule] = RULES, step_ms: int = 15_000, lookback_ms: int = 300_000) -> DataFrame:
    """(rule, severity, series, pending_from, firing_from, ended_at, worst) of ``samples`` (metric, series, at_ms, value).

    Rules are evaluated on a grid of ``step_ms``, from a series' first sample to the last of all. A gauge holds its last value for
    ``lookback_ms``. A counter's increase is the sum of the increments between successive samples that lie in the window; a value
    below the one before is a reset and counts whole; a first sample counts nothing. While a condition holds, an alert is
    pending, and it fires at the first point of the grid that is ``for_ms`` later (null: it ended before). ended_at is null for
    what still holds at the last point. Samples without time, series or value (NaN too) are left out. A series' points are
    one task's; their number is that of the steps."""
    table = [(r.name, r.metric, r.kind, r.above, float(r.limit), r.for_ms, r.severity, r.window_ms) for r in rules]
    known = samples.sparkSession.createDataFrame(table, "rule string, metric string, kind string, above boolean, limit double, for_ms long, severity string, window_ms long")
    good = samples.filter("at_ms IS NOT NULL AND series IS NOT NULL AND value IS NOT NULL AND NOT isnan(CAST(value AS double))")
    point = lambda at: (F.ceil(at / step_ms) * step_ms).cast("long")
    until = good.join(F.broadcast(known), "metric").agg(F.max(point(F.col("at_ms"))).alias("until")).scalar()
    series = ["rule", "series"]
    rows = good.join(F.broadcast(known), "metric").select(*series, "at_ms", F.col("value").cast("double").alias("value"), point(F.col("at_ms")).alias("g"))
    before = F.lag("value").over(W.partitionBy(*series).orderBy("at_ms", "value"))
    rows = rows.withColumn("more", F.when(F.col("value") < before, F.col("value")).otherwise(F.coalesce(F.col("value") - before, F.lit(0.0))))
    points = rows.groupBy(*series, "g").agg(F.sum("more").alias("more"), F.max_by("value", F.struct("at_ms", "value")).alias("value"))
    grid = points.groupBy(*series).agg(F.min("g").alias("low")).withColumn("until", until)
    grid = grid.select(*series, "until", F.explode(F.sequence("low", "until", F.lit(step_ms))).alias("g"))
    dense = grid.join(points, [*series, "g"], "left").join(F.broadcast(known.drop("metric")), "rule")
    by = W.partitionBy(*series).orderBy("g")
    rate = F.lit(None).cast("double")
    for width in sorted({r.window_ms for r in rules}):
        over = F.sum("more").over(by.rangeBetween(1 - width, 0)) / (width / 1000)
        rate = F.when(F.col("window_ms") == width, F.coalesce(over, F.lit(0.0))).otherwise(rate)
    gauge = F.last("value", ignorenulls=True).over(by.rangeBetween(1 - lookback_ms, 0))
    dense = dense.withColumn("measured", F.when(F.col("kind") == "rate", rate).otherwise(gauge))
    dense = dense.withColumn("holds", F.coalesce(F.when(F.col("above"), F.col("measured") > F.col("limit")).otherwise(F.col("measured") < F.col("limit")), F.lit(False)))
    begins = F.col("holds") & ~F.coalesce(F.lag("holds").over(by), F.lit(False))
    islands = dense.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(by)).filter("holds")
    found = islands.groupBy(*series, "severity", "island", "for_ms", "until").agg(F.min("g").alias("pending_from"), F.max("g").alias("last"), F.max(F.when(F.col("above"), F.col("measured"))).alias("most"), F.min("measured").alias("least"))
    fires = F.col("pending_from") + F.ceil(F.col("for_ms") / step_ms) * step_ms
    return found.select(
        "rule", "severity", "series", "pending_from", F.when(fires <= F.col("last"), fires).alias("firing_from"),
        F.when(F.col("last") < F.col("until"), F.col("last") + step_ms).alias("ended_at"), F.coalesce("most", "least").alias("worst"),
    )


# ---- quantiles -------------------------------------------------------------------------------------------------------

#: Entries of a sketch: 1.65 / k bounds the error of a rank about so that a percent is kept with a margin.
SKETCH_K = 400


def sketches(samples: DataFrame, tags: Sequence[str], value: str, at: str, width: str = "5 minutes", k: int = SKETCH_K) -> DataFrame:
    """(tags, start, sketch) of each window: a table to keep, from which longer spans are merged. A sketch has a few kilobytes,
    however many values it has seen; nulls and NaN are left out."""
    own = samples.select(*tags, F.window(F.col(at), width)["start"].alias("start"), F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)")
    return own.groupBy(*tags, "start").agg(F.kll_sketch_agg_double("__v", k).alias("sketch"))


def merged(kept: DataFrame, tags: Sequence[str], width: str, k: int = SKETCH_K) -> DataFrame:
    """Sketches of longer windows from those of shorter ones."""
    return kept.withColumn("start", F.window("start", width)["start"]).groupBy(*tags, "start").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def timer_rows(kept: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(tags, start, n, p50, p95, p99) of sketches."""
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return kept.select(*tags, "start", F.kll_sketch_get_n_double("sketch").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


# ---- counters --------------------------------------------------------------------------------------------------------

#: Families of counters, each with the tags it has.
FAMILIES = {
    "collected": ("level", "method", "mode"), "discarded": ("reason", "method"), "persisted": ("method", "mode"), "persist.failed": ("method",), "flush": ("method", "mode", "trigger"), "buffer.overflow": ("method", "overflow"),
    "degrade.triggered": ("type", "method"), "direct_flush": ("method", "outcome"), "overflow.degraded": ("method", "strategy"), "force_allocate.rejected": ("method",), "circuit.recovered": ("method",), "sanitize.hits": ("method",),
    "mask.hits": ("method",), "fastpath.hits": ("method",), "pipeline.backpressure": ("method", "level"), "pipeline.timeout": ("method", "step"), "handler.timeout": ("method",), "config.refresh": ("source",),
}
TAGS = ("level", "method", "mode", "reason", "trigger", "overflow", "type", "outcome", "strategy", "step", "source")
#: Tags that are unknown in small letters; the others are UNKNOWN.
SMALL_UNKNOWN = ("trigger", "type", "outcome", "strategy", "step", "source", "method", "reason")


#: Columns of outcomes that counters look at.
OUTCOMES = (
    "method", "level", "mode", "reason", "sanitized", "masked", "fast_path", "timeout_step", "trigger", "persisted", "overflow", "degrade_type", "direct_outcome", "strategy", "force_rejected", "recovered", "handler_timeout", "source",
)


def measurements(outcomes: DataFrame) -> DataFrame:
    """One long stream (family, a column for each of TAGS, n) of ``outcomes`` of one kind, whatever columns they have.

    Records: method, level, mode, reason (null: collected), sanitized, masked, fast_path, timeout_step. Batches: method, mode,
    trigger, persisted (true, false or null: not tried), entries, overflow, degrade_type, direct_outcome, strategy,
    force_rejected, recovered, handler_timeout. Refreshes: source. Every row is read once; equal ones are counted first,
    and each count then gives the families that it counts for."""
    has = set(outcomes.columns)
    entries = F.coalesce(F.col("entries"), F.lit(1)).cast("long") if "entries" in has else F.lit(1).cast("long")
    counted = outcomes.groupBy(*(c for c in OUTCOMES if c in has)).agg(F.count("*").alias("rows"), F.sum(entries).alias("entries"))
    col = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    true = lambda c: col(c, "boolean")
    record, tried = F.lit("level" in has and "reason" in has), col("persisted", "boolean")
    holds = {
        "collected": record & col("reason").isNull(), "discarded": record & col("reason").isNotNull(), "persisted": tried, "persist.failed": ~tried, "flush": F.lit("trigger" in has), "buffer.overflow": col("overflow").isNotNull(),
        "degrade.triggered": col("degrade_type").isNotNull(), "direct_flush": col("direct_outcome").isNotNull(), "overflow.degraded": col("strategy").isNotNull(), "force_allocate.rejected": true("force_rejected"),
        "circuit.recovered": true("recovered"), "sanitize.hits": true("sanitized"), "mask.hits": true("masked"), "fastpath.hits": true("fast_path"),
        "pipeline.backpressure": record & (col("reason").startswith("backpressure") | (col("reason") == "pipeline_backpressure")), "pipeline.timeout": col("timeout_step").isNotNull(), "handler.timeout": true("handler_timeout"),
        "config.refresh": col("source").isNotNull(),
    }
    each = counted.withColumn("family", F.explode(F.array_compact(F.array(*(F.when(holds[f], f) for f in FAMILIES)))))
    value = {c: col(c) for c in ("level", "method", "mode", "reason", "trigger", "overflow", "strategy", "source")} | {"type": col("degrade_type"), "outcome": col("direct_outcome"), "step": col("timeout_step")}
    tags = []
    for t in TAGS:
        own = F.coalesce(F.nullif(value[t], F.lit("")), F.lit("unknown" if t in SMALL_UNKNOWN else "UNKNOWN"))
        tags.append(F.when(F.col("family").isin(*(f for f, names in FAMILIES.items() if t in names)), own).alias(t))
    return each.select("family", *tags, F.when(F.col("family") == "persisted", F.col("entries")).otherwise(F.col("rows")).alias("n"))


def all_counters(*outcomes: DataFrame) -> DataFrame:
    """(family, TAGS, n): every family by its own tags; tags that a family does not have are null."""
    parts = [measurements(o).groupBy("family", *TAGS).agg(F.sum("n").alias("n")) for o in outcomes]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("family", *TAGS).agg(F.sum("n").alias("n"))


def status_document(counted: DataFrame) -> DataFrame:
    """One row with a nested document: {family: {total, by: [{tags, n}]}} as JSON, from the totals and tags of ``all_counters``.

    Grouping sets give a family's total beside its tags in one aggregation; the document has a row for each tag combination,
    so tags have to be few, as tags of counters are."""
    named = counted.withColumn("tags", F.concat_ws(",", *(F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}="), F.col(t))) for t in TAGS)))
    sets = named.groupingSets([["family", "tags"], ["family"]], "family", "tags").agg(F.sum("n").alias("n"), F.grouping("tags").alias("total"))
    entry = F.struct("tags", "n")
    per = sets.groupBy("family").agg(F.max(F.when(F.col("total") == 1, F.col("n"))).alias("total"), F.array_sort(F.collect_list(F.when(F.col("total") == 0, entry))).alias("by"))
    document = F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", F.struct("total", "by").alias("x")))))
    return per.agg(F.to_json(document).alias("status"))
