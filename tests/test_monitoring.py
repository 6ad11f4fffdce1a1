"""Alerts on small histories, sketches against exact ranks, counters of every family."""

import json
import random

from pyspark.sql import functions as F

from cedarlog.operators import monitoring
from cedarlog.operators.monitoring import FAMILIES, Rule

DDL = "metric string, series string, at_ms long, value double"
MIN = 60_000


def intervals(spark, rows, rule, step=MIN, lookback=5 * MIN):
    df = spark.createDataFrame([("m", s, int(t * MIN), v) for s, t, v in rows] + [("other", "x", 10**9, 5.0)], DDL)
    out = monitoring.alert_intervals(df, [rule], step, lookback).collect()
    least = lambda x: None if x is None else x / MIN
    return sorted((r["series"], least(r["pending_from"]), least(r["firing_from"]), least(r["ended_at"])) for r in out)


def test_a_gauge_that_lasts_fires_and_a_short_one_stays_pending(spark):
    rule = Rule("r", "m", "gauge", True, 0.8, 2 * MIN, "warning")
    rows = [("a", 0, 0.1), ("a", 1, 0.9), ("a", 2, 0.1), ("a", 3, 0.9), ("a", 4, 0.95), ("a", 5, 0.85), ("a", 6, 0.8), ("b", 6, 0.9), ("a", 7, None), ("a", 8, float("nan"))]
    assert intervals(spark, rows, rule) == [("a", 1, None, 2), ("a", 3, 5, 6), ("b", 6, None, None)]


def test_a_gauge_is_carried_forward_for_its_lookback_only(spark):
    rule = Rule("r", "m", "gauge", False, 10, 3 * MIN, "critical")
    assert intervals(spark, [("a", 1, 5.0), ("a", 20, 50.0)], rule) == [("a", 1, 4, 6)]  # from 6 on there is no value
    assert intervals(spark, [("a", 1, 5.0), ("a", 3.5, 50.0)], rule) == [("a", 1, None, 4)]


def test_rates_survive_resets_of_a_counter(spark):
    rule = Rule("r", "m", "rate", True, 1.0, MIN, "warning", 2 * MIN)
    # by minute: +0 (first), +100, +100, reset to 30 (+30), +0, +0; over two minutes: 100, 200, 130, 30, 0
    rows = [("a", 1, 500.0), ("a", 2, 600.0), ("a", 3, 700.0), ("a", 4, 30.0), ("a", 5, 30.0), ("a", 6, 30.0)]
    assert intervals(spark, rows, rule) == [("a", 3, 4, 5)]
    assert intervals(spark, rows, Rule("r", "m", "rate", True, 0.8, MIN, "warning", 2 * MIN)) == [("a", 2, 3, 5)]
    assert intervals(spark, [], rule) == []


def test_merged_sketches_keep_ranks_within_a_percent(spark):
    rng = random.Random(3)
    rows = [("a", i, rng.choice([rng.random(), rng.gauss(50, 9), float(rng.randint(0, 5))])) for i in range(60_000)] + [("b", 5, 1.0), ("b", 6, None), ("b", 7, float("nan"))]
    df = spark.createDataFrame(rows, "tag string, s long, v double").repartition(8).withColumn("at", F.timestamp_seconds(F.col("s") * 1))
    kept = monitoring.sketches(df, ["tag"], "v", "at")
    assert kept.count() == 201
    whole = monitoring.merged(monitoring.merged(kept, ["tag"], "1 hour"), ["tag"], "1 day")
    got = {r["tag"]: r for r in monitoring.timer_rows(whole, ["tag"]).collect()}
    values = sorted(v for t, _, v in rows if t == "a")
    assert got["a"]["n"] == 60_000 and got["b"]["n"] == 1 and got["b"]["p99"] == 1.0
    for q, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below, upto = sum(v < got["a"][q] for v in values), sum(v <= got["a"][q] for v in values)
        assert below <= (p + 0.01) * len(values) and upto >= (p - 0.01) * len(values), q
    small = monitoring.sketches(df.filter("s < 300"), ["tag"], "v", "at", "1 day").select(F.octet_length("sketch")).first()[0]
    large = whole.filter("tag = 'a'").select(F.octet_length("sketch")).first()[0]
    assert large < 20_000 and small < 20_000  # bytes do not grow with the distinct values


def test_every_family_counts(spark):
    records = spark.createDataFrame(
        [("m", "INFO", "SINGLE", None, True, True, True, "mask"), ("m", None, None, None, None, None, None, None), ("m", "WARN", "SINGLE", "backpressure_pause", False, False, False, None), ("", "INFO", "SINGLE", "level_filter", False, False, False, None)],
        "method string, level string, mode string, reason string, sanitized boolean, masked boolean, fast_path boolean, timeout_step string",
    )
    batches = spark.createDataFrame(
        [("m", "SINGLE", "count", True, 7, None, None, None, None, False, False, False), ("m", "SINGLE", "count", True, 5, None, None, None, None, False, False, False), ("m", None, None, False, 3, "FLUSH_EARLY", "persist_failed", "failed", "FILE", True, True, True), ("m", "SINGLE", "final", None, 1, None, None, None, None, None, None, None)],
        "method string, mode string, trigger string, persisted boolean, entries long, overflow string, degrade_type string, direct_outcome string, strategy string, force_rejected boolean, recovered boolean, handler_timeout boolean",
    )
    refreshes = spark.createDataFrame([("nacos",), ("nacos",), ("",), (None,)], "source string")
    counted = monitoring.all_counters(records, batches, refreshes)
    got = {(r["family"], *(f"{t}={r[t]}" for t in monitoring.TAGS if r[t] is not None)): r["n"] for r in counted.collect()}
    assert {k[0] for k in got} == set(FAMILIES) and len(FAMILIES) == 18
    assert all({t.split("=")[0] for t in k[1:]} == set(FAMILIES[k[0]]) for k in got)
    assert got["collected", "level=INFO", "method=m", "mode=SINGLE"] == 1 and got["collected", "level=UNKNOWN", "method=m", "mode=UNKNOWN"] == 1
    assert got["discarded", "method=unknown", "reason=level_filter"] == 1 and got["pipeline.backpressure", "level=WARN", "method=m"] == 1
    assert got["persisted", "method=m", "mode=SINGLE"] == 12 and got["persist.failed", "method=m"] == 1 and got["flush", "method=m", "mode=UNKNOWN", "trigger=unknown"] == 1
    assert got["config.refresh", "source=nacos"] == 2 and got["config.refresh", "source=unknown"] == 1
    status = json.loads(monitoring.status_document(counted).first()[0])
    assert status["discarded"] == {"total": 2, "by": [{"tags": "method=m,reason=backpressure_pause", "n": 1}, {"tags": "method=unknown,reason=level_filter", "n": 1}]}
    assert set(status) == set(FAMILIES)
