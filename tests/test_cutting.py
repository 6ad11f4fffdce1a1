"""Batches from parallel cut points against the fold that defines them, record by record."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cedarlog.operators import batching, cutting
from cedarlog.operators.cutting import Limits, Path


def fold(records, limits):
    """(batch of each record, last batch) of one trace: records are (seq, size, version)."""
    batch, n, size, version, out = 0, 0, 0, None, []
    for _, b, v in sorted(records, key=lambda r: r[0]):
        if n and (v != version or (limits.before and (n + 1 > limits.most or (limits.size > 0 and size + b > limits.size)))):
            batch, n, size = batch + 1, 0, 0
        out.append(batch)
        n, size, version = n + 1, size + b, v
        if n >= limits.most or (limits.size > 0 and size >= limits.size):
            batch, n, size = batch + 1, 0, 0
    return out, out[-1]


def traces(seed, count, longest):
    rng = random.Random(seed)
    out = {}
    for t in range(count):
        n = rng.choice([1, 2, rng.randint(1, longest), longest])
        seqs = rng.sample(range(-5 * n, 5 * n), n)
        version, rows = 1, []
        for s in sorted(seqs):
            version += rng.random() < 0.02
            rows.append((s, rng.choice([0, 1, 5, 10, rng.randint(0, 60)]), version))
        out[None if t == 0 else f"t{t}"] = rows
    return out


@pytest.mark.parametrize("limits", [Limits(7, 100), Limits(1, 0), Limits(30, 0), Limits(12, 60, True), Limits(1000, 61, True), Limits(5000, 90_000)])
@pytest.mark.parametrize("range_rows", [40, 100_000])
def test_cuts_equal_the_fold(spark, limits, range_rows):
    data = traces(limits.most + range_rows, 12, 700)
    rows = [(t, *r) for t, rs in data.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "trace_id string, seq long, bytes long, v int").selectExpr("*", "'x' AS key", "1 AS part", "2 AS at", "3 AS cuts", "map('a', seq) AS mdc").repartition(5)
    got = {}
    for r in cutting.cut_batches(df, limits, version="v", range_rows=range_rows).collect():
        got.setdefault(r["trace_id"], []).append((r["seq"], r["batch_id"], r["last_batch"]))
        assert r["mdc"] == {"a": r["seq"]} and r["key"] == "x"
    assert set(got) == set(data)
    for t, rs in data.items():
        want, last = fold(rs, limits)
        assert sorted(got[t]) == [(s, b, last) for s, b in zip(sorted(x[0] for x in rs), want, strict=True)], t


def test_paths_equal_the_fold_from_any_open_batch():
    """What a range answers for each possible first start, and its entry for a batch that comes in open, on random runs."""
    rng = np.random.default_rng(5)
    for trial in range(150):
        m = int(rng.integers(1, 40))
        n, size, forced = np.ones(m, dtype=np.int64), rng.integers(0, 30, m), rng.random(m) < 0.1
        forced[0] = False
        limits = Limits(int(rng.integers(1, 12)), int(rng.choice([0, 25, 60])), bool(trial % 2))
        if limits.before and limits.size:
            size = np.minimum(size, limits.size)
        path = Path(n, size, forced, limits)
        version = np.cumsum(forced)
        for first in range(m + 1):
            closed, open_n, open_size = (int(x[0]) for x in path.outcome(np.array([first])))
            rows = [(i, int(size[i]), int(version[i])) for i in range(first, m)]
            if not rows:
                assert (closed, open_n, open_size) == (0, 0, 0)
                continue
            batches, last = fold(rows, limits)
            assert list(path.starts(first)) == [first + i for i in range(len(rows)) if i == 0 or batches[i] != batches[i - 1]]
            tail = [b for (_, b, _), k in zip(rows, batches, strict=True) if k == last]
            full = len(tail) >= limits.most or (limits.size > 0 and sum(tail) >= limits.size)
            assert (closed, open_n, open_size) == ((last + 1, 0, 0) if full else (last, len(tail), sum(tail)))
        carried = [(-1, int(s), 0) for s in rng.integers(0, 20, int(rng.integers(0, limits.most)))]
        if limits.size and sum(b for _, b, _ in carried) >= limits.size:
            continue
        entry = path.entry(len(carried), sum(b for _, b, _ in carried), False)
        rows = [(i - len(carried), b, 0) for i, (_, b, _) in enumerate(carried)] + [(i, int(size[i]), int(version[i])) for i in range(m)]
        batches, _ = fold(rows, limits)
        later = batches[len(carried) :]
        want = next((i for i, b in enumerate(later) if b > 0 or not carried), None)
        if want is None:
            filled = len(rows) >= limits.most or (limits.size > 0 and sum(b for _, b, _ in rows) >= limits.size)
            want = m if filled else m + 1
        assert entry == want


def test_records_of_one_place_stay_together(spark):
    rows = [("t", s, 10, 1) for s in (1, 2, 2, 2, 3, 4)] + [("t", None, None, None)]
    df = spark.createDataFrame(rows, "trace_id string, seq long, bytes long, v int")
    got = sorted((r["batch_id"], r["seq"] or 0) for r in cutting.cut_batches(df, Limits(3, 0), version="v").collect())
    assert got == [(0, 0), (1, 1), (1, 2), (1, 2), (1, 2), (2, 3), (2, 4)]
    empty = spark.createDataFrame([], "trace_id string, seq long, bytes long")
    assert cutting.cut_batches(empty, Limits(3, 0)).count() == 0


def test_a_hot_trace_is_many_even_tasks(spark):
    """A trace that holds most rows: ranges are even, so no task of the cuts or of the window sees much more than its share."""
    n = 400_000
    df = spark.range(n).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('t', id % 1000) END AS trace_id", "id * id AS seq", "id % 50 AS bytes")
    rows = df.select(F.col("trace_id").alias("key"), F.col("seq").alias("at"))
    (cuts,) = cutting.quantile_cuts(rows, 40_000).collect()
    assert cuts["key"] == "hot" and len(cuts["cuts"]) == 8
    sizes = np.diff(np.searchsorted([i * i for i in range(n) if i % 10 < 9], [-1, *cuts["cuts"], n * n], side="right"))
    assert sizes.max() < 1.2 * sizes.mean()
    out = cutting.cut_batches(df, Limits(100, 2300), range_rows=40_000)
    own = [(i * i, i % 50, "1") for i in range(n) if i % 10 < 9]
    want, _ = fold(own, Limits(100, 2300))
    got = out.filter("trace_id = 'hot'").orderBy("seq").select("batch_id").toPandas()["batch_id"].to_numpy()
    assert (got == np.array(want)).all()


def test_legacy_single_batches(spark):
    """A buffer that hands records on: emptied before a record that would exceed the bytes, and at a limit; large ones bypass it."""
    rows = [("t", i, "x" * k) for i, k in enumerate([10, 10, 1500, 10, 400, 400, 10, 10, 10])]
    df = spark.createDataFrame(rows, "trace_id string, seq long, content string")
    df = df.selectExpr("*", "'INFO' AS level", "'w' AS thread_name", "'l' AS logger_name", "CAST(NULL AS string) AS throwable", "CAST(NULL AS map<string,string>) AS mdc")
    sizes = {r["seq"]: r["bytes"] for r in batching.legacy_single(df, 3, 2700).collect()}
    want, n, size, batch = [], 0, 0, 0
    for i in sorted(sizes):
        b = sizes[i]
        if b > 2700:
            want.append((i, -1 - i, "direct"))
            continue
        if n and (n + 1 > 3 or size + b > 2700):
            batch, n, size = batch + 1, 0, 0
        want.append((i, batch, "buffered"))
        n, size = n + 1, size + b
        if n >= 3 or size >= 2700:
            batch, n, size = batch + 1, 0, 0
    assert sorted((r["seq"], r["batch_id"], r["fate"]) for r in batching.legacy_single(df, 3, 2700).collect()) == want
    assert {f for _, _, f in want} == {"direct", "buffered"}
    for overflow, kept in (("DROP_OLDEST", [6, 7, 8]), ("DROP_NEWEST", [0, 1, 2])):
        got = batching.legacy_single(df, 3, 0, overflow).filter("batch_id >= 0")
        assert sorted(r["seq"] for r in got.collect()) == kept
    got = batching.legacy_single(df, 9, 1100, "DROP_NEWEST").orderBy("seq").collect()
    assert {r["fate"] for r in got} == {"direct", "buffered", "buffer_overflow_rejected"}
    assert sum(r["bytes"] for r in got if r["fate"] == "buffered") <= 1100


def test_limit_by_count_equals_the_fold(spark):
    rows = [("t", i, ["INFO", "ERROR", "DEBUG"][i % 3], 1) for i in range(12)]
    df = spark.createDataFrame(rows, "trace_id string, seq long, level string, bytes long").withColumn("high", F.col("level") == "ERROR")
    for policy, mode in (("STOP_COLLECTING", "pipeline"), ("DOWNGRADE_LEVEL", "legacy"), ("STOP_COLLECTING", "legacy")):
        slow = batching.ordered_fold(df, ["trace_id"], ["seq"], ["bytes", "high"], "reason string", batching.total_limits(5, 0, policy, mode)).orderBy("seq")
        fast = df.withColumn("reason", batching.limit_reason(5, policy, mode)).orderBy("seq")
        assert [r["reason"] for r in slow.collect()] == [r["reason"] for r in fast.collect()]


def test_batches_by_time_have_the_size_of_the_joined_content(spark):
    rows = [("t", 0, "aé", "INFO", -5, 0), ("t", 1, "b" * 7, "WARN", 9, 0), ("t", 2, "c", "INFO", 4, 0)]
    df = spark.createDataFrame(rows, "trace_id string, seq long, line string, level string, ts_ms long, batch_id long").withColumn("bytes", F.lit(1))
    r = batching.finalise(df, by_time=True).first()
    assert r["total_bytes"] == 56 + -(-2 * 12 // 8) * 8 and (r["first_time"].microsecond, r["last_time"].microsecond) == (4000, 9000)


def test_a_task_holds_few_rows_and_strings():
    """Groups of three rows, and one longer than a chunk, come whole, in frames of about a chunk, with few string objects."""
    names = [f"trace-{i // 3}" for i in range(300_000)] + ["trace-long"] * 200_000 + [None] * 5
    rows = pd.DataFrame({"key": names, "part": 0, "at": np.arange(len(names)), "size": 1, "version": "1"})

    def batches():
        for i in range(0, len(rows), 10_000):
            b = rows.iloc[i : i + 10_000]
            yield b.assign(key=[None if k is None else "".join([k]) + "" for k in b["key"]], version=["".join(["v", str(j % 1)]) for j in range(len(b))])

    frames = list(cutting._whole_groups(batches()))
    assert sum(map(len, frames)) == len(rows) and np.array_equal(np.concatenate([f["at"] for f in frames]), rows["at"])
    for f, g in zip(frames[:-1], frames[1:], strict=True):
        assert f["key"].iloc[-1] != g["key"].iloc[0]
    assert max(map(len, frames[:-1])) <= 230_000 and len(frames) >= 3
    assert len({id(v) for f in frames for v in f["version"]}) <= 60
    assert sum(k is None for k in frames[-1]["key"]) == 5


@pytest.mark.parametrize("work", [cutting._mark_whole, cutting._summarize, cutting._mark_ranges])
def test_memory_of_a_task_does_not_grow_with_its_groups(work):
    """A task lets a group and its paths go before it reads the next one, and rows of a group share their strings."""
    size = 200_000
    make = work(batching.pipeline_limits(50, 1200))

    def peak(groups):
        def batches():
            for i in range(0, groups * size, 10_000):
                at = np.arange(i, i + 10_000)
                text = ["".join(["v", str(1)]) for _ in at]  # a string of its own for each row, as from Arrow
                yield pd.DataFrame({"key": f"hot-{i // size}", "part": 0, "at": at, "size": at % 50, "version": text, "batch_id": 3, "open_n": 1, "open_size": 10, "open_version": list(text), "last_batch": 9})

        tracemalloc.start()
        done = sum(1 for _ in make(batches()))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert done >= 1
        return most

    peak(1)
    one, four = peak(1), peak(4)
    assert four < 1.25 * one and four < 300 * size, (one, four)
