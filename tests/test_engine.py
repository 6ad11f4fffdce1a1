import pytest
from pyspark.sql import functions as F

from cedarlog.functions import layout, sizing
from cedarlog.operators import batching, filters, metrics, reliability, sinks
from cedarlog.schema import Config, config_rank, resolve


def fold(spark, rows, inputs, outputs, start, ddl):
    df = spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], "trace_id string, seq int, " + ddl)
    names = [x.split()[0] for x in outputs.split(", ")]
    return [tuple(r[n] for n in names) for r in batching.ordered_fold(df, ["trace_id"], ["seq"], inputs, outputs, start).orderBy("seq").collect()]


def test_pipeline_fold(spark):
    sizes = [(100, 1), (900, 1), (50, 1), (2000, 1), (10, 1), (10, 2)]
    assert [b for (b,) in fold(spark, sizes, ["b", "v"], "batch_id long", batching.pipeline_batches(3, 1000, floor=0), "b long, v int")] == [0, 0, 1, 1, 2, 3]


def test_legacy_fold(spark):
    sizes = [(100,), (900,), (50,), (2000,), (10,), (10,)]
    assert fold(spark, sizes, ["b"], "batch_id long, fate string", batching.legacy_batches(3, 1000), "b long") == [(0, "buffered"), (0, "buffered"), (1, "buffered"), (-1, "direct"), (1, "buffered"), (1, "buffered")]
    assert [f for _, f in fold(spark, [(600,), (600,), (300,)], ["b"], "batch_id long, fate string", batching.legacy_batches(9, 1000, "DROP_NEWEST"), "b long")] == ["buffered", "buffer_overflow_rejected", "buffered"]


def test_modes_differ(spark):
    df = spark.createDataFrame([("t", i, "x" * 300, "INFO", i) for i in range(9)], "trace_id string, seq int, line string, level string, ts_ms long")
    pipeline, legacy = (batching.aggregate(df, 100, 1300, mode=m).count() for m in ("pipeline", "legacy"))
    assert (pipeline, legacy) == (3, 9)


def test_finalise(spark):
    rows = [("t", 2, "b", "warn", 5), ("t", 1, "a", "info", 9), ("t", 3, "c", "WARN", 7)]
    df = spark.createDataFrame(rows, "trace_id string, seq int, line string, level string, ts_ms long")
    r = batching.aggregate(df).first()
    assert (r["content"], r["entry_count"], r["max_level"], r["final_flush"], r["total_bytes"]) == ("a\nb\nc", 3, "warn", True, 6)
    assert r["first_time"].microsecond == 9000 and r["last_time"].microsecond == 7000


def test_limits_and_quota(spark):
    rows = [(10, False)] * 3 + [(10, True)]
    assert [r for (r,) in fold(spark, rows, ["b", "h"], "reason string", batching.total_limits(2, 0, "DOWNGRADE_LEVEL", "legacy"), "b long, h boolean")] == [None, None, "total_limit_downgrade", None]
    assert [r for (r,) in fold(spark, rows, ["b", "h"], "reason string", batching.total_limits(0, 25), "b long, h boolean")] == [None, None, "total_limit_reached", "total_limit_reached"]
    assert fold(spark, rows, ["b", "h"], "fate string, used long", batching.quota(20, floor=0), "b long, h boolean") == [("accepted", 10), ("accepted", 20), ("rejected", 20), ("forced", 30)]
    with pytest.raises(ValueError):
        batching.quota(-1)


def test_breaker(spark):
    rows = [("m", i, t, ok) for i, (t, ok) in enumerate([(0, False)] * 5 + [(10, True), (40_000, True), (40_001, True), (40_002, True), (40_003, True)])]
    df = spark.createDataFrame(rows, "method_key string, seq int, t_ms long, ok boolean")
    out = reliability.run_breaker(df, samples=5, rate=0.6, interval_ms=30_000, half_open=3, successes=3).orderBy("seq").collect()
    assert [r["state"] for r in out] == ["CLOSED"] * 4 + ["OPEN", "OPEN", "HALF_OPEN", "HALF_OPEN", "CLOSED", "CLOSED"]
    assert not out[5]["allowed"] and out[8]["recovered"]


def test_layout(spark):
    df = spark.createDataFrame([("hi", "ERROR", 1706745600000, "w-1", "com.example.MyService", "boom", {"k": "v"})], "content string, level string, ts_ms long, thread_name string, logger_name string, throwable string, mdc map<string,string>")
    line = lambda p: df.select(layout.compile_layout(p)).first()[0]
    assert line("%d{yyyy-MM-dd HH:mm:ss} %-6p[%t] %c{1} - %m%n") == "2024-02-01 00:00:00 ERROR [w-1] c.e.MyService - hi\n"
    assert line("%.3p|%7p|%m%ex|%X{k}|%X|%q") == "ROR|  ERROR|hi\nboom|v|{k=v}|%q"
    assert layout.clean_pattern("%clr(%d{HH:mm}){faint} ${LEVEL:-%5p} --- [%t]  %m%n") == "%d{HH:mm} %5p [%t] %m%n"
    with pytest.raises(ValueError):
        layout.validate_pattern("%m %zz")


def test_sizes(spark):
    df = spark.createDataFrame([("1.5KB", 1536), ("12", 5), ("x", 1073741824)], "s string, n long")
    assert [r[0] for r in df.select(sizing.parse_size(F.col("s"))).collect()] == [1536, 12, None]
    assert [r[0] for r in df.select(sizing.format_size(F.col("n"))).collect()] == ["1.5 KB", "5 B", "1.00 GB"]
    assert [r[0] for r in df.select(sizing.ring_capacity(F.col("n"))).collect()] == [2048, 8, 1073741824]


def test_config():
    sources = [
        {"order": 100, "properties": [{"scope": "global", "key": "level", "value": "WARN"}, {"scope": "method", "method_key": "m", "key": "mask", "value": "no"}, {"scope": "method", "method_key": "m", "key": "global_soft_bytes", "value": "5"}]},
        {"order": 1000, "properties": [{"scope": "global", "key": "level", "value": "DEBUG"}, {"scope": "global", "key": "max_total", "value": "bad"}]},
        {"order": 1, "available": False, "properties": [{"scope": "global", "key": "level", "value": "FATAL"}]},
    ]
    c = resolve("m", Config(max_total=7), sources)
    assert (c.level, c.mask, c.max_total, c.global_soft_bytes) == ("WARN", False, 7, Config().global_soft_bytes)
    assert config_rank(" warning ") == 3
    with pytest.raises(ValueError):
        Config(mode="x")


def test_sampling_keeps_every_nth(spark):
    df = spark.range(10).selectExpr("'t' AS trace_id", "id AS seq")
    assert [r["seq"] for r in df.withColumn("r", filters.sampled_out("COUNT", 0.34)).filter("r IS NULL").orderBy("seq").collect()] == [2, 5, 8]


def test_outliers(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([10.0, 11.0, 10.0, 100.0, 9.0])], "k string, i int, v double")
    assert metrics.without_outliers(df, ["k"], "v", "i").first()["mean"] == 10.0


def test_sinks(spark):
    assert sinks.identifier("a_1") == "a_1"
    with pytest.raises(ValueError):
        sinks.identifier("a;b")
    df = spark.createDataFrame([("t", "x")], "trace_id string, content string")
    key = F.lit("0123456789abcdef")
    assert df.select(sinks.decrypted(sinks.encrypted(F.col("content"), key), key)).first()[0] == "x"


def test_stream_equals_batch(spark, tmp_path):
    from cedarlog.streaming.batcher import stream_batches

    ddl = "trace_id string, seq long, line string, bytes long, level string, ts_ms long, close boolean"
    rows = [(f"t{i % 3}", i, "x" * (i % 40), 2 * (i % 40), ["INFO", "WARN", "DEBUG"][i % 3], i, False) for i in range(120)]
    for n, part in enumerate((rows[:50], rows[50:], [(f"t{k}", 1000, None, None, None, None, True) for k in range(3)])):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    out, path = [], f"{tmp_path}/flat"
    import os
    import shutil

    os.makedirs(path)
    for n in range(3):
        (name,) = (x for x in os.listdir(f"{tmp_path}/in/{n}") if x.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/{n}/{name}", f"{path}/{n}.parquet")
        os.utime(f"{path}/{n}.parquet", (1_700_000_000 + n,) * 2)  # files are taken in order of these times; equal ones have none
    stream = stream_batches(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path), 10, 300, floor=0)
    q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    expected = batching.aggregate(spark.createDataFrame([r for r in rows], ddl), 10, 300, floor=0).collect()
    got = {(r["trace_id"], r["batch_id"]): (r["content"], r["entry_count"], r["total_bytes"], r["max_level"]) for r in out}
    assert got == {(r["trace_id"], r["batch_id"]): (r["content"], r["entry_count"], r["total_bytes"], r["max_level"]) for r in expected}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_legacy_batches_of_oversized_records_and_versions(spark):
    from cedarlog.operators import batching

    rows = [("t", 0, "a", 1), ("t", 1, "x" * 2000, 1), ("t", 2, "b", 1), ("t", 3, "c", 2), ("u", 0, "y" * 2000, 1)]
    df = spark.createDataFrame(rows, "trace_id string, seq long, line string, pattern_version int").selectExpr("*", "'INFO' AS level", "seq AS ts_ms")
    for overflow, kept in (("FLUSH_EARLY", ["a\nb", "c"]), ("DROP_OLDEST", ["a\nb", "c"])):
        got = batching.aggregate(df, 100, 1000, mode="legacy", overflow=overflow).orderBy("trace_id", "batch_id").collect()
        assert [(r["trace_id"], r["content"][:3], r["batch_id"], r["final_flush"]) for r in got] == [("t", "xxx", -2, False), *(("t", x, i, i == 1) for i, x in enumerate(kept)), ("u", "yyy", -1, False)]
        assert len({r["flush_id"] for r in got}) == 4
    plain = batching.aggregate(df.drop("pattern_version"), 100, 1000, mode="legacy").filter("batch_id >= 0").collect()
    assert [r["content"] for r in plain] == ["a\nb\nc"]
