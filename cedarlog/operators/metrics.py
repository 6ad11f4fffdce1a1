"""Counters, gauges, timers, health and benchmark statistics over outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Breaker states as numbers.
STATES = {"CLOSED": 0, "HALF_OPEN": 1, "OPEN": 2}


def counters(df: DataFrame, tags: Sequence[str], sums: Mapping[str, str] | None = None) -> DataFrame:
    """One family of counters: events, and sums of columns, by tags."""
    return df.groupBy(*tags).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in (sums or {}).items()))


def gauges(samples: DataFrame, tags: Sequence[str], value: str = "value", at: str = "ts_ms", then: Sequence[str] = ()) -> DataFrame:
    """The latest value by tags; of values at one time the last by ``then`` (a sequence number, say), of equal ones the greatest."""
    return samples.groupBy(*tags).agg(F.max_by(value, F.struct(at, *then, value)).alias("value"), F.max(at).alias("at"))


def timers(samples: DataFrame, tags: Sequence[str], value: str, exact: bool = True) -> DataFrame:
    """Count, P50, P95 and P99. Exact ones hold distinct values of a group; at scale use the sketch (exact=False)."""
    q = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, p, 10_000).cast("double"))
    return samples.groupBy(*tags).agg(F.count(value).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def state_number(state: Column) -> Column:
    out = F.lit(0)
    for k, v in STATES.items():
        out = F.when(state == k, v).otherwise(out)
    return out


def health(states: DataFrame, key: str = "method_key", order: Sequence[str] = ("t_ms", "seq")) -> DataFrame:
    """From the latest state of each key: DOWN if any is OPEN, DEGRADED if any is HALF_OPEN, else UP."""
    latest = states.groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("state"))
    totals = latest.agg(F.count("*").alias("methods"), F.count_if(F.col("state") == "OPEN").alias("open"), F.count_if(F.col("state") == "HALF_OPEN").alias("half_open"))
    return totals.select(F.when(F.col("open") > 0, "DOWN").when(F.col("half_open") > 0, "DEGRADED").otherwise("UP").alias("status"), "methods", "open", "half_open")


def snapshot(df: DataFrame, **sections: Column) -> DataFrame:
    """A status document: one JSON text of named sections."""
    return df.select(F.to_json(F.struct(*(c.alias(k) for k, c in sections.items()))).alias("status"))


def alerts(events: DataFrame, at: str, tags: Sequence[str], more_than: float, window: str = "5 minutes") -> DataFrame:
    """Tumbling windows in which the events per minute exceed a limit."""
    minutes = _minutes(window)
    counted = events.groupBy(*tags, F.window(at, window)).agg(F.count("*").alias("n"))
    return counted.select(*tags, F.col("window.start").alias("start"), "n", (F.col("n") / minutes).alias("per_minute")).filter(F.col("per_minute") > more_than)


def _minutes(window: str) -> float:
    n, unit = window.split()
    return int(n) * {"second": 1 / 60, "minute": 1, "hour": 60}[unit.rstrip("s")]


def throughput(df: DataFrame) -> DataFrame:
    """logs/s, ns per log and GC share of a benchmark run; no time or no logs gives 0."""
    s, n = F.col("elapsed_s"), F.col("total_logs")
    return df.withColumns(
        {
            "throughput": F.when(s > 0, n / s).otherwise(0.0),
            "latency_ns": F.when(n > 0, s * 1e9 / n).otherwise(0.0),
            "gc_percent": F.when(s > 0, F.col("gc_time_ms") / (s * 1000) * 100).otherwise(0.0),
        }
    )


def quotient(above: Column, below: Column) -> Column:
    """above / below of doubles as SQL has it, by IEEE 754: by zero it is infinite, and NaN if above is zero too."""
    above, below = above.cast("double"), below.cast("double")
    return F.when(below == 0, above * F.pow(below, F.lit(-1.0))).otherwise(above / below)


def rounded(value: Column | str, digits: int) -> Column:
    """A double as SQL rounds it: what it is times 10^digits, to the nearest whole number, halves away from zero. Spark's own round
    goes by the decimal digits of the value itself, which differs where that product falls on a half, or beside one."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    scaled = value * 10.0**digits
    return F.when(F.abs(scaled) == float("inf"), value).otherwise(F.signum(value) * F.round(F.abs(scaled)) / 10.0**digits)


def valid_series(df: DataFrame, value: str, allow_zero: bool = False) -> DataFrame:
    return df.filter(F.col(value) >= 0 if allow_zero else F.col(value) > 0)


def trimmed(df: DataFrame, keys: Sequence[str], value: str, trim: int = 1, keep: int = 3) -> DataFrame:
    """Mean, least, greatest, P50 and P90 after cutting min(trim, (n - keep) // 2) values at either end."""
    w = W.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(value))
    n = F.count("*").over(w)
    cut = F.greatest(F.lit(0), F.least(F.lit(trim), F.floor((n - keep) / 2)))
    inner = df.withColumns({"__r": rank, "__n": n, "__c": cut}).filter((F.col("__r") > F.col("__c")) & (F.col("__r") <= F.col("__n") - F.col("__c")))
    return inner.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.9)).alias("p90"), F.count("*").alias("n")
    )


def without_outliers(df: DataFrame, keys: Sequence[str], value: str, order: str, most_share: float = 0.25, most: int = 2, keep: int = 3) -> DataFrame:
    """Mean after at most min(2, n - 3) values that deviate from the median by more than a share of it are removed, the
    largest deviations first; all stay if fewer than three would."""
    w = W.partitionBy(*keys)
    median = F.percentile(value, F.lit(0.5)).over(w)
    df = df.withColumns({"__m": median, "__n": F.count("*").over(w)})
    base = F.when(F.abs("__m") < 1e-9, 1.0).otherwise(F.abs("__m"))
    df = df.withColumn("__d", F.abs(F.col(value) - F.col("__m")) / base)
    df = df.withColumn("__r", F.row_number().over(w.orderBy(F.desc("__d"), order)))
    gone = (F.col("__d") > most_share) & (F.col("__r") <= F.least(F.lit(most), F.greatest(F.lit(0), F.col("__n") - keep)))
    return df.groupBy(*keys).agg(F.avg(F.when(~gone, F.col(value))).alias("mean"), F.count_if(~gone).alias("kept"), F.count("*").alias("n"))


def ratio_series(df: DataFrame, run: str, scenario: str, value: str, above: str, below: str) -> DataFrame:
    """Per run, one scenario's value by another's, where that is positive."""
    one = df.groupBy(run).agg(F.max(F.when(F.col(scenario) == above, F.col(value))).alias("a"), F.max(F.when(F.col(scenario) == below, F.col(value))).alias("b"))
    return one.filter("b > 0 AND a IS NOT NULL").select(run, (F.col("a") / F.col("b")).alias("ratio"))


def compare_baseline(now: DataFrame, base: DataFrame, key: str, value: str, tolerance: float = 15.0, higher_is_slower: bool = True) -> DataFrame:
    """Change in percent and SLOWER, FASTER, OK, NEW or REMOVED, over the union of keys."""
    both = now.select(key, F.col(value).alias("current")).join(base.select(key, F.col(value).alias("baseline")), key, "full_outer")
    change = quotient(F.col("current") - F.col("baseline"), F.col("baseline")) * 100
    worse = change if higher_is_slower else -change
    verdict = F.when(F.col("baseline").isNull(), "NEW").when(F.col("current").isNull(), "REMOVED").when(worse > tolerance, "SLOWER").when(worse < -tolerance, "FASTER").otherwise("OK")
    return both.select(key, "current", "baseline", change.alias("change"), verdict.alias("verdict"))


def first_last(df: DataFrame, keys: Sequence[str], order: str, value: str, tolerance: float = 5.0, higher_is_better: bool = True) -> DataFrame:
    """improved, regressed or stable from the first to the last value; from 0 any rise counts as one of 100 %."""
    ends = df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100).when(F.col("last") > 0, 100.0).when(F.col("last") < 0, -100.0).otherwise(0.0)
    better = change if higher_is_better else -change
    return ends.withColumn("change", change).withColumn("trend", F.when(better > tolerance, "improved").when(better < -tolerance, "regressed").otherwise("stable"))


def gate(measured: DataFrame, baseline: DataFrame, key: str, value: str, multiplier: float, healthy: Column | None = None) -> DataFrame:
    """PASS, WARN or FAIL against baseline * multiplier; a failing ratio is a warning where its numerator is healthy."""
    both = measured.join(baseline.select(key, F.col(value).alias("baseline")), key)
    low = F.col(value) < F.col("baseline") * multiplier
    ok = healthy if healthy is not None else F.lit(False)
    return both.select(key, value, (F.col("baseline") * multiplier).alias("floor"), F.when(~low, "PASS").when(ok, "WARN").otherwise("FAIL").alias("verdict"))


def percent_delta(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Change in percent from the value before, keys without an order last; from 0 it is infinite, and NaN if the value stays 0."""
    df = df.withColumn("__before", F.lag(value).over(W.partitionBy(*keys).orderBy(F.asc_nulls_last(order))))
    return df.withColumn("delta", quotient(F.col(value) - F.col("__before"), F.col("__before")) * 100).drop("__before")


def matrix(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """FAIL if any failed, WARN if any warned, else PASS, by keys, with counts."""
    n = lambda s: F.count_if(F.col(status) == s)
    return df.groupBy(*keys).agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), F.when(n("FAIL") > 0, "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS").alias("status"))


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
