"""Small operators, one by one, against what they are defined to do."""

import json

import pytest
import xxhash
from pyspark.sql import functions as F

from cedarlog.functions import layout, sizing, text
from cedarlog.operators import batching, filters, ledger, sinks
from cedarlog.schema import Config
from cedarlog.sources import adapters


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_benchmark_samples(spark, tmp_path):
    runs = [{"run": i, "scenario": "clean", "total_logs": 1000, "elapsed_s": 0.5 * i, "throughput": 2000.0, "gc_count": i} for i in (1, 2)]
    (tmp_path / "runs.json").write_text("\n".join(map(json.dumps, runs)))
    rows = adapters.benchmark_samples(spark, str(tmp_path / "runs.json")).orderBy("run").collect()
    assert [(r["run"], r["elapsed_s"], r["gc_count"], r["heap_after"]) for r in rows] == [(1, 0.5, 1, None), (2, 1.0, 2, None)]


def batch_frame(spark, n=3):
    rows = [(f"t{i}", 0, f"line {i}", "INFO", i) for i in range(n)]
    return batching.aggregate(spark.createDataFrame(rows, "trace_id string, seq long, line string, level string, ts_ms long"))


def records(spark):
    return spark.createDataFrame([("t", "x", "INFO", 5), ("u", "y", "WARN", 6)], "trace_id string, content string, level string, ts_ms long")


def test_handlers_and_their_defaults(spark):
    base = sinks.BaseHandler()
    base.append(records(spark))
    assert base.discarded == 2 and base.preferred_mode == "AUTO" and base.separator == "\n" and base.pattern is None
    assert records(spark).filter(base.collect(F.col("level"), F.col("content"))).count() == 2
    with pytest.raises(NotImplementedError):
        base.flush(batch_frame(spark))
    memory = sinks.MemoryHandler()
    memory.append(records(spark))
    memory.flush(batch_frame(spark))
    assert len(memory.records) == 2 and len(memory.batches) == 3 and [r["content"] for r in memory.of("t")] == ["x"]
    memory.clear()
    assert memory.of("t") == [] and memory.batches == []
    wrote = []
    table = sinks.TableHandler("logs", lambda df, name: wrote.append((name, df.columns, df.count())), lambda: batch_frame(spark, 1))
    table.append(records(spark))
    table.flush(batch_frame(spark))
    assert wrote == [("logs", ["trace_id", "content", "level", "time"], 2), ("logs", ["trace_id", "content", "entry_count", "max_level", "is_final", "time"], 2)]
    with pytest.raises(ValueError):
        sinks.TableHandler("logs; drop", lambda *_: None)


def test_a_batch_is_tried_again_and_then_degraded(spark):
    class Flaky(sinks.BaseHandler):
        def __init__(self, failures):
            super().__init__()
            self.failures, self.calls = failures, []

        def before(self):
            self.calls.append("before")

        def after(self):
            self.calls.append("after")

        def on_error(self, error):
            self.calls.append(str(error))

        def flush(self, batches):
            self.failures -= 1
            if self.failures >= 0:
                raise OSError("down")
            self.calls.append("flushed")

    good, bad, degraded = Flaky(2), Flaky(9), []
    sinks.foreach_batch(good)(batch_frame(spark), 0)
    assert good.calls == ["before", "down", "down", "flushed", "after"]
    sinks.foreach_batch(bad, lambda df, e: degraded.append((df.count(), str(e))))(batch_frame(spark), 0)
    assert bad.calls == ["before", "down", "down", "down", "after"] and degraded == [(3, "down")]
    with pytest.raises(OSError):
        sinks.foreach_batch(Flaky(9))(batch_frame(spark), 0)
    with pytest.raises(NotImplementedError):
        sinks.foreach_batch(sinks.BaseHandler())(batch_frame(spark), 0)


def test_ledger_handler_calls_its_hooks(spark, tmp_path):
    calls = []

    class Handler(ledger.LedgerHandler):
        def before(self):
            calls.append("before")

        def after(self):
            calls.append("after")

        def on_error(self, error):
            calls.append(type(error).__name__)

    handler = Handler(ledger.Ledger(spark, str(tmp_path / "t")), "run", keep=lambda df: df.select("no_such_column"))
    with pytest.raises(Exception, match="no_such_column"):
        handler(batch_frame(spark), 0)
    assert calls[0] == "before" and calls[-1] == "after" and len(calls) == 3 and handler.ledger.entries() == {} and handler.ledger.read() is None


def test_audit_appends_a_line_for_each_action(spark, tmp_path):
    for action in ("reset", "disable"):
        sinks.audit(spark.createDataFrame([("2024-01-01", "ann", action, "m1")], "at string, actor string, action string, target string"), str(tmp_path / "audit"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "audit")).collect()) == ["2024-01-01 ann disable m1", "2024-01-01 ann reset m1"]


def test_internal_loggers_go_before_everything_but_the_switches(spark):
    df = spark.createDataFrame([("cedarlog.operators", "ERROR", "x"), ("org.apache.spark.sql", "INFO", "x"), ("org.apache.sparkling", "INFO", "x"), (None, "INFO", "x"), ("app.A", "DEBUG", "x")], "logger_name string, level string, content string")
    reasons = [r[0] for r in df.select(filters.discard_reason("INFO", ignored=F.lit(False))).collect()]
    assert reasons == ["internal", "internal", None, None, "level_filter"]
    assert [r[0] for r in df.select(filters.discard_reason(enabled=F.lit(False))).collect()] == ["disabled"] * 5


def test_handler_summary_of_both_modes(spark):
    df = spark.createDataFrame([("app", "INFO", "a\x01b" + "c" * 300)], "logger_name string, level string, content string")
    reason = lambda mode, ok: df.select(filters.discard_reason("TRACE", collect=lambda level, s: ok(s), mode=mode)).first()[0]
    assert reason("legacy", lambda s: (F.length(s) == 256) & s.startswith("abc")) is None
    assert reason("pipeline", lambda s: (F.length(s) == 100) & s.startswith("a\x01b")) is None
    assert reason("legacy", lambda s: F.length(s) == 100) == "handler_filter"


def test_backpressure_by_a_callback(spark):
    df = spark.createDataFrame([(0.1, "INFO"), (0.5, "INFO"), (0.5, "ERROR"), (0.9, "ERROR")], "u double, level string")
    call = lambda u: F.when(u > 0.8, "PAUSE").when(u > 0.3, "SKIP_DEBUG_INFO").otherwise("CONTINUE")
    assert [r[0] for r in df.select(filters.backpressure_reason(F.col("u"), callback=call)).collect()] == [None, "backpressure_skip_low_level", None, "backpressure_pause"]


def test_total_limit_by_sampling(spark):
    """Legacy: over the limit a sampler decides, and counts again as for any record; dropped records use nothing up."""
    df = spark.createDataFrame([("t", i, 10, False) for i in range(12)], "trace_id string, seq int, b long, h boolean")
    run = lambda **k: [r["reason"] for r in batching.ordered_fold(df, ["trace_id"], ["seq"], ["b", "h"], "reason string", batching.total_limits(3, 0, "SAMPLE", "legacy", **k)).orderBy("seq").collect()]
    assert run(every=1) == [None] * 12
    seen, kept, want = 0, 0, []
    for _ in range(12):
        reason = None
        if kept >= 3:
            seen += 1
            reason = None if seen % 2 == 0 else "total_limit_sampled"
        if reason is None:
            seen += 1
            reason = None if seen % 2 == 0 else "sampled_out"
        kept += reason is None
        want.append(reason)
    assert run(every=2) == want and {"total_limit_sampled", "sampled_out", None} <= set(want)


def test_empty_lines_are_refused_by_the_legacy_buffer(spark):
    df = spark.createDataFrame([("t", 0, "", "INFO", 1), ("t", 1, None, "INFO", 1), ("t", 2, "x", "INFO", 1)], "trace_id string, seq long, line string, level string, ts_ms long")
    assert [(r["content"], r["entry_count"]) for r in batching.aggregate(df, mode="legacy").collect()] == [("x", 1)]


def test_interceptor_may_replace_and_drop(spark):
    df = records(spark)
    assert filters.intercepted(df, None) is df
    out = filters.intercepted(df, lambda d: d.filter("level = 'WARN'").withColumn("content", F.upper("content"))).collect()
    assert [r["content"] for r in out] == ["Y"]


def test_rates_and_guards():
    assert [filters.normalise_rate(r) for r in (float("nan"), -1, 0, 0.25, 1, 7)] == [0.0, 0.0, 0.0, 0.25, 1.0, 1.0]


def test_sampling_strategies_and_their_guard_order(spark):
    df = spark.range(3000).select(F.lit("t").alias("trace_id"), F.col("id").alias("seq"), F.lit("INFO").alias("level"))
    for strategy in ("RATE", "COUNT", "ADAPTIVE"):
        for rate, left in ((1.0, 3000), (5, 3000), (0.0, 0), (-1, 0), (float("nan"), 0)):
            reason = filters.sampled_out(strategy, rate, utilization=F.lit(0.6), key=F.col("seq"))
            assert df.filter(reason.isNull()).count() == left, (strategy, rate)
    kept = [r["seq"] for r in df.filter(filters.sampled_out("RATE", 0.3, key=F.col("seq")).isNull()).orderBy("seq").collect()]
    hashed = lambda i: xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), seed=42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    assert kept == [i for i in range(3000) if signed(hashed(i)) % 1_000_000 < 300_000]
    adaptive = filters.sampled_out("ADAPTIVE", 0.3, utilization=F.lit(0.9), key=F.col("seq"))
    assert df.filter(adaptive.isNull()).count() == 0 and df.withColumn("level", F.lit("ERROR")).filter(adaptive.isNull()).count() == 3000
    assert 700 < df.filter(filters.sample_by_rate(0.3)).count() < 1100


def test_stages_that_are_switched_off(spark):
    raw = "<b>x</b> 13300009999"
    assert text.SANITIZERS["default"] is None and text.MASKERS["none"] is None
    off = one(spark, lambda c: text.secure(c, sanitizer=text.SANITIZERS["none"], masker=text.MASKERS["none"]), raw)
    assert (off["value"], off["sanitized"], off["masked"]) == (raw, False, False)
    own = one(spark, lambda c: text.secure(c, sanitizer=lambda x: F.upper(x), masker=lambda x: F.concat(x, F.lit("!"))), "plain")
    assert (own["value"], own["sanitized"], own["masked"], own["fast_path"]) == ("PLAIN!", True, True, False)  # other stages always run


def test_record_security_in_projections_equals_the_single_column(spark):
    rows = ["plain", "", None, "<b>a</b>\n13300009999", "bob@mail.test", "133<i></i>00009999 x", "tab\there", "E: x\n\tat a.B(C.java:1)\nINFO fake 17700001111"]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in rows for b in rows)], "i int, a string, b string")
    names = ("value", "sanitized", "masked", "fast_path")
    for masker in (text.mask, None, lambda c: F.upper(c)):
        fast = text.secure_columns(df, {"a": False, "b": True}, masker).orderBy("i").select(*(f"{c}_{k}" for c in "ab" for k in names)).collect()
        slow = df.orderBy("i").select(text.secure(F.col("a"), masker=masker).alias("x"), text.secure(F.col("b"), True, masker).alias("y")).collect()
        assert [tuple(r) for r in fast] == [(*r["x"], *r["y"]) for r in slow]


def test_quota_format_and_method_keys(spark):
    assert [one(spark, sizing.format_quota, n, "long") for n in (-1, 5, 2048, 3 << 20)] == ["unknown", "5B", "2.0KB", "3.0MB"]
    assert [one(spark, sizing.method_normalised, k) for k in (" com_app_A_pay ", "a.B#c", "pay", "", None)] == ["com.app.A#pay", "a.B#c", "pay", "", None]


def test_pattern_detection():
    found = layout.detect_pattern([(5, lambda: "%m late"), (1, lambda: None), (2, lambda: "%zz %m"), (3, lambda: "%d only"), (4, lambda: "%clr(%p){faint} --- %m")])
    assert found == "%p %m"
    assert layout.detect_pattern([]) == layout.DEFAULT_PATTERN and layout.detect_pattern([(1, lambda: "%q")], "%m!") == "%m!"


def test_configuration_warns():
    assert Config().warnings == ()
    words = " ".join(Config(max_buffer_size=0, max_buffer_bytes=10, global_soft_bytes=5, sampling_rate=2.0, total_limit_policy="SAMPLE").warnings)
    assert all(w in words for w in ("max_buffer_size", "max_buffer_bytes", "sampling_rate", "pipeline mode"))
    assert Config(pipeline=False, overflow="DROP_OLDEST").warnings == ()
