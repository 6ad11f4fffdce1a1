"""Settings as of the event against a plain search of the history; refresh while a stream runs."""

import os
import random
import shutil

from pyspark.sql import functions as F

from cedarlog.operators import asof, filters
from cedarlog.schema import Config, resolve, winning_properties
from cedarlog.sources import adapters

KEYS = ["level", "max_buffer_size", "mask", "overflow"]


def history(seed, n):
    rng = random.Random(seed)
    values = {"level": ["DEBUG", "WARN", None], "max_buffer_size": ["5", " 70 ", "many", None], "mask": ["true", "no", None], "overflow": ["drop_oldest", "never", None], "global_soft_bytes": ["9"]}
    out = []
    for i in range(n):
        key = rng.choice(list(values))
        scope = rng.choice(["global", "method", "method"])
        out.append((rng.randint(0, 40) * 250, i, rng.choice([100, 200, 1000]), scope, rng.choice(["m1", "m2"]) if scope == "method" else None, key, rng.choice(values[key])))
    return out + [(None, n, 100, "global", None, "level", "FATAL"), (5, n + 1, 100, "method", None, "level", "FATAL")]


def plain(changes, method, at):
    """The last change of each source and scope, handed to the resolution of four levels."""
    last = {}
    for c in sorted((c for c in changes if c[0] is not None and at is not None and c[0] <= at), key=lambda c: (c[0], c[1])):
        last[c[3], c[4], c[2], c[5]] = c[6]
    sources = []
    for order in (100, 200, 1000):
        props = [{"scope": s, "method_key": m, "key": k, "value": v} for (s, m, o, k), v in last.items() if o == order and v is not None and (s == "global" or m is not None)]
        sources.append({"order": order, "properties": props})
    return resolve(method, Config(), sources)


def test_settings_as_of_the_event(spark):
    changes = history(3, 160)
    rng = random.Random(8)
    events = [(i, rng.choice(["m1", "m2", "m3", None]), rng.choice([rng.randint(-50, 11_000), rng.randint(0, 40) * 250])) for i in range(400)] + [(400, "m1", None)]
    df = spark.createDataFrame(events, "id int, method_key string, ts_ms long").repartition(4)
    hist = spark.createDataFrame(changes, asof.HISTORY)
    for width in (100, 3_600_000):
        got = asof.configured(df, hist, KEYS, [100, 200, 1000], width_ms=width).collect()
        assert len(got) == len(events)
        for r in got:
            want = plain(changes, r["method_key"], r["ts_ms"])
            assert (r["cfg_level"], int(r["cfg_max_buffer_size"]), r["cfg_mask"] == "true", r["cfg_overflow"]) == (want.level, want.max_buffer_size, want.mask, want.overflow), r
    assert "CartesianProduct" not in asof.configured(df, hist, KEYS, [100, 200, 1000])._jdf.queryExecution().toString()
    empty = asof.configured(df, hist.limit(0), ["level"], [100])
    assert {r["cfg_level"] for r in empty.collect()} == {"INFO"}
    assert asof.configured(df.limit(0), hist, ["level"], [100]).count() == 0


def test_a_changed_level_holds_from_its_time_on(spark):
    df = spark.createDataFrame([("m", t, level) for t in (9, 10, 11) for level in ("INFO", "WARN", None)], "method_key string, ts_ms long, level string")
    hist = spark.createDataFrame([(10, 1, 100, "method", "m", "level", "warning")], asof.HISTORY)
    out = asof.configured(df, hist, ["level"], [100]).filter(~filters.below_configured(F.col("level"), F.col("cfg_level")))
    assert sorted((r["ts_ms"], r["level"]) for r in out.collect()) == [(9, "INFO"), (9, "WARN"), (10, "WARN"), (11, "WARN")]


def test_refresh_between_micro_batches(spark, tmp_path):
    path, log = str(tmp_path / "history"), str(tmp_path / "in")
    os.makedirs(log)
    schema = "id int, method_key string, ts_ms long"

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        (name,) = (x for x in os.listdir(f"{tmp_path}/part{n}") if x.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/part{n}/{name}", f"{log}/{n}.parquet")

    out = []
    write = asof.refreshing(lambda: spark.read.schema(asof.HISTORY).parquet(path), ["level"], [100, 200], lambda df, _: out.extend(df.collect()))

    def run():
        q = spark.readStream.schema(schema).parquet(log).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)

    spark.createDataFrame([(100, 1, 200, "global", None, "level", "WARN")], asof.HISTORY).write.parquet(path)
    put(0, [(1, "m", 50), (2, "m", 150)])
    run()
    spark.createDataFrame([(200, 2, 100, "method", "m", "level", "ERROR")], asof.HISTORY).write.mode("append").parquet(path)
    put(1, [(3, "m", 250), (4, "m", 160), (5, "other", 250)])  # the second is late
    run()
    assert {r["id"]: r["cfg_level"] for r in out} == {1: "INFO", 2: "WARN", 3: "ERROR", 4: "WARN", 5: "WARN"}


def test_config_sources_as_rows_give_the_winners(spark):
    sources = [
        {"name": "a", "order": 100, "properties": [{"scope": "global", "key": "level", "value": "WARN"}, {"scope": "method", "method_key": "m", "key": "mask", "value": "no"}]},
        {"name": "b", "order": 1000, "properties": [{"scope": "global", "key": "level", "value": "DEBUG"}, {"scope": "method", "method_key": "m", "key": "global_soft_bytes", "value": "5"}, {"scope": "method", "method_key": "n", "key": "level", "value": "INFO"}]},
        {"name": "c", "order": 1, "available": False, "properties": [{"scope": "global", "key": "level", "value": "FATAL"}]},
    ]
    rows = adapters.config_table(spark, sources)
    assert rows.count() == 5 and set(rows.columns) >= {"source", "source_order", "scope", "method_key", "key", "value"}
    won = winning_properties(rows)
    assert {(r["method_key"], r["key"]): r["value"] for r in won.collect()} == {("m", "level"): "WARN", ("m", "mask"): "no", ("n", "level"): "INFO"}
    assert "NestedLoop" not in won._jdf.queryExecution().executedPlan().toString()
    only = winning_properties(rows.filter("scope = 'method'"))
    assert {(r["method_key"], r["key"]) for r in only.collect()} == {("m", "mask"), ("n", "level")}
