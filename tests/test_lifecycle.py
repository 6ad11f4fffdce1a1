"""A replayed stream: closed traces refuse late records, idle ones are closed, all are forgotten, and state stays small."""

import datetime
import os
import shutil

import pytest

from cedarlog.streaming import lifecycle

DDL = "trace_id string, seq long, line string, bytes long, level string, ts_ms long, close boolean, at timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def row(trace, seq, second, close=None, line=None, level="INFO"):
    return (trace, seq, None if close else line or f"{trace}{seq}", 10, level, second * 1000, close, START + datetime.timedelta(seconds=second))


def replay(spark, tmp_path, steps, **options):
    """Feeds each step as a micro-batch of its own; returns rows and the state's size after each."""
    source, out, sizes = tmp_path / "in", [], []
    os.makedirs(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, lifecycle.ROCKSDB)
    try:
        df = lifecycle.trace_lives(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(source)), **options)
        for n, rows in enumerate(steps):
            spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{tmp_path}/step{n}")
            (name,) = (x for x in os.listdir(f"{tmp_path}/step{n}") if x.endswith(".parquet"))
            shutil.copy(f"{tmp_path}/step{n}/{name}", f"{source}/{n}.parquet")
            os.utime(f"{source}/{n}.parquet", (1_700_000_000 + n,) * 2)
            # a query that starts anew for each step: its state has to come back from the checkpoint
            q = df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
            sizes.append(q.recentProgress[-1].stateOperators[0].numRowsTotal if q.recentProgress else None)
    finally:
        spark.conf.set(provider, was)
    return out, sizes


@pytest.fixture(scope="module")
def story(spark, tmp_path_factory):
    steps = [
        [row("a", 1, 0), row("a", 2, 1, level="WARN"), row("a", 3, 2), row("b", 1, 0), row("idle", 1, 0, level="error")],
        [row("a", 4, 5), row("a", 5, 5, close=True), row("b", 2, 6), row("b", 3, 7), row("b", 4, 8)],
        [row("a", 6, 9), row("a", 7, 9, close=True), row("a", 8, 9), row("b", 5, 9, close=True)],  # late; closed again; late
        [row("clock", 1, 60)],  # moves the watermark to 50: idle (0 + 20) is closed, a and b are remembered until 105, 109
        [row("idle", 2, 62), row("a", 9, 61)],  # late for a trace that idleness closed, and still late for a
        [row("clock", 2, 300)],  # a, b and idle are forgotten
        [row("a", 10, 301)],  # the id starts anew
        [row("clock", 3, 700)],
        [row("clock", 4, 1500)],
        [row("clock", 4, 2500, close=True)],
        [row("last", 1, 9000, close=True)],
    ]
    return replay(spark, tmp_path_factory.mktemp("life"), steps, lateness="10 seconds", most=3, most_bytes=1000, floor=0, idle_ms=20_000, remember_ms=100_000)


def test_batches_and_late_records(story):
    out, _ = story
    batches = sorted((r["trace_id"], r["batch_id"], r["content"], r["max_level"], r["final_flush"]) for r in out if r["kind"] == "batch" and r["trace_id"] != "clock")
    assert batches == [
        ("a", 0, "a1\na2\na3", "WARN", False), ("a", 0, "a10", "INFO", True), ("a", 1, "a4", "INFO", True),
        ("b", 0, "b1\nb2\nb3", "INFO", False), ("b", 1, "b4", "INFO", True), ("idle", 0, "idle1", "error", True),
    ]
    late = sorted((r["trace_id"], r["seq"], r["reason"]) for r in out if r["kind"] == "rejected")
    assert late == [("a", 6, lifecycle.LATE), ("a", 8, lifecycle.LATE), ("a", 9, lifecycle.LATE), ("idle", 2, lifecycle.LATE)]


def test_state_does_not_grow_with_the_traces_that_ever_were(story):
    _, sizes = story
    assert max(s for s in sizes if s is not None) > sizes[-1]
    assert sizes[-1] <= 6  # one trace that has just been closed, and its timer


def test_many_short_traces_leave_nothing_behind(spark, tmp_path):
    steps = [[row(f"t{n}-{i}", k, n * 200, close=k == 2) for i in range(40) for k in (1, 2)] for n in range(5)]
    out, sizes = replay(spark, tmp_path, steps, lateness="1 second", most=10, idle_ms=20_000, remember_ms=100_000)
    assert sum(r["kind"] == "batch" for r in out) == 200 and not [r for r in out if r["kind"] == "rejected"]
    assert sizes[-1] <= 2 * sizes[0]
