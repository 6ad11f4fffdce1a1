"""Queries against their SQL on tables with zeros, nulls and NaN."""

import math
import os

import pytest

from cedarlog.operators import metrics

duckdb = pytest.importorskip("duckdb")


def both(spark, folder, name, events):
    """Rows of a query and of its SQL over a table of events that SQL selects."""
    from cedarlog.plans import registry

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    os.makedirs(folder, exist_ok=True)
    con.execute(f"COPY ({events}) TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    norm = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([norm(r[c]) for c in columns]) for r in df.collect()), sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())


EVENTS = """SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ({at}) AS ts, i % 5 AS user_id, ['view', 'click', 'error', 'purchase'][1 + i % 4] AS event_type, {value} AS value, '{{"k": 1}}' AS props
  FROM range({n}) t(i)"""


@pytest.mark.parametrize("name", ["met_percent_delta", "met_baseline_compare"])
def test_change_from_zero_is_that_of_sql(spark, tmp_path, name):
    value = "CASE WHEN i % 20 IN (5, 10, 2) THEN 0.0 WHEN i % 20 = 3 THEN '-0.0'::DOUBLE WHEN i = 44 THEN NULL WHEN i = 49 THEN 'nan'::DOUBLE ELSE (i * 37 % 11) - 5.0 END::DOUBLE"
    mine, want = both(spark, tmp_path, name, EVENTS.format(value=value, n=200, at='420 * i'))
    assert mine == want
    if name == "met_percent_delta":
        assert {x for x in ("inf,", "-inf,", "NaN") if any(x in r for r in mine)} == {"inf,", "-inf,", "NaN"}


def test_alerts_beside_nulls_are_those_of_sql(spark, tmp_path):
    events = f"SELECT * REPLACE (CASE WHEN event_id % 100 <> 7 THEN ts END AS ts) FROM ({EVENTS.format(value='1.0', n=2000, at='285 * i + i * i * 7919 % 7200')})"
    mine, want = both(spark, tmp_path, "met_alert_rules", events)
    assert mine and mine == want


def test_alerts_close_to_the_hour_are_those_of_sql(spark, tmp_path):
    """Times of microseconds up to a millisecond from an hour, before and after 1970: SQL takes the nearest millisecond."""
    micros = "CASE WHEN event_id % 3 = 0 THEN [-1000, -501, -500, -499, -1, 0, 1, 499, 500, 501, 999][1 + event_id % 11] ELSE -1000000 * (event_id % 23) END"
    at = f"TIMESTAMP '1969-12-31' + INTERVAL 1 HOUR * (event_id // 23) + INTERVAL 1 MICROSECOND * ({micros})"
    events = f"SELECT * REPLACE ({at} AS ts) FROM ({EVENTS.format(value='1.0', n=2000, at='i')})"
    mine, want = both(spark, tmp_path, "met_alert_rules", events)
    assert mine and mine == want


@pytest.mark.parametrize("name", ["met_percent_delta", "met_first_last", "met_throughput", "met_ratio_series", "met_timers"])
def test_numbers_halfway_are_rounded_as_those_of_sql(spark, tmp_path, name):
    """Cents by 32, 160 and so on make quotients that end in a half at the last digit kept, or close to one in binary."""
    value = "CASE WHEN i % 10 < 5 THEN [0.32, 1.6, 16.0, 160.0, 3.2][1 + i % 5] ELSE (i * 7919 % 56021) / 100.0 END::DOUBLE"
    mine, want = both(spark, tmp_path, name, EVENTS.format(value=value, n=40000, at='i'))
    assert mine and mine == want


def test_rounding_is_that_of_sql(spark):
    values = [1.00005, 2.675, -62.54375, 62.54375, -2.5e-5, 0.49999999999999994e-4, 0.5e-4, 8.518982e176, 1.7e308, -1e-9, -0.0, 0.0, math.inf, -math.inf, math.nan, None, *(i / 160 for i in range(-400, 400)), *((i - 5603) / 5603 * 100 for i in range(0, 56000, 7))]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", *(metrics.rounded("x", d).alias(f"r{d}") for d in (2, 4, 6)))
    rows = {r["i"]: [r["r2"], r["r4"], r["r6"]] for r in df.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    assert {r[0]: repr(list(r[1:])) for r in con.execute("SELECT i, round(x, 2), round(x, 4), round(x, 6) FROM t").fetchall()} == {i: repr(r) for i, r in rows.items()}
