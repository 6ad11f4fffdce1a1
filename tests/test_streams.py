"""Counters over a stream of files: windows on event time, late rows, a stream that is stopped and goes on."""

import datetime
import os
import shutil

from cedarlog.sources import adapters
from cedarlog.streaming.batcher import stream_counters

DDL = "at timestamp, level string"
START = datetime.datetime(2024, 1, 1, 12, 0)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def put(spark, tmp_path, n, rows):
    """One more file of the stream, in order of its number."""
    os.makedirs(f"{tmp_path}/in", exist_ok=True)
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{tmp_path}/p{n}")
    (name,) = (x for x in os.listdir(f"{tmp_path}/p{n}") if x.endswith(".parquet"))
    shutil.copy(f"{tmp_path}/p{n}/{name}", f"{tmp_path}/in/{n}.parquet")
    os.utime(f"{tmp_path}/in/{n}.parquet", (1_700_000_000 + n,) * 2)


def run(spark, tmp_path):
    counters = stream_counters(adapters.event_stream(spark, f"{tmp_path}/in", DDL), "at", ["level"])
    q = counters.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    found = spark.read.schema("start timestamp, level string, n long").parquet(f"{tmp_path}/out")
    return sorted(((r["start"] - START).total_seconds() // 60, str(r["level"]), r["n"]) for r in found.collect()), [p["numInputRows"] for p in q.recentProgress]


def test_counters_close_with_the_watermark_and_late_rows_stay_out(spark, tmp_path):
    put(spark, tmp_path, 0, [(at(0), "INFO"), (at(4), "INFO"), (at(4), "WARN"), (at(1), None), (at(5), "INFO"), (None, "INFO")])
    put(spark, tmp_path, 1, [(at(2), "INFO"), (at(30), "INFO")])  # out of order, but within ten minutes; moves the watermark to 20
    put(spark, tmp_path, 2, [(at(3), "INFO"), (at(31), "WARN")])  # windows close at the end of this trigger, so this row still counts
    put(spark, tmp_path, 3, [(at(3), "INFO"), (at(7), "INFO")])  # both windows are closed by now
    found, rows = run(spark, tmp_path)
    assert [n for n in rows if n] == [6, 2, 2, 2]  # a file for each trigger
    closed = [(0, "INFO", 4), (0, "None", 1), (0, "WARN", 1), (5, "INFO", 1)]
    assert found == sorted(closed)
    put(spark, tmp_path, 4, [(at(60), "INFO")])  # the stream goes on where it stopped
    put(spark, tmp_path, 5, [(at(61), "INFO"), (at(30), "INFO")])  # as above, its window is still open
    put(spark, tmp_path, 6, [(at(30), "INFO")])
    found, rows = run(spark, tmp_path)
    assert [n for n in rows if n] == [1, 2, 1]
    assert found == sorted([*closed, (30, "INFO", 2), (30, "WARN", 1)])
