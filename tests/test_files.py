"""Files out and in: a table that takes each batch once, degrade files that are whole or absent, log files read back."""

import glob
import os
import pickle
import shutil
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cedarlog.functions import layout
from cedarlog.operators import batching, degraded, ledger, sinks
from cedarlog.sources import logfiles

DDL = "trace_id string, seq long, line string, level string, ts_ms long"


def batches(spark, rows):
    return batching.aggregate(spark.createDataFrame(rows, DDL), 3)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("when", ["before", "after", "written"])
def test_a_stopped_stream_gives_each_batch_once(spark, tmp_path, when):
    """Stopped before anything is written, between write and commit, and between the ledger's commit and the stream's own."""
    source = str(tmp_path / "in")
    os.makedirs(source)
    for n in range(3):
        spark.createDataFrame([(f"t{n}-{i % 4}", i, f"{n}:{i}", "INFO", i) for i in range(20)], DDL).coalesce(1).write.parquet(f"{tmp_path}/p{n}")
        (name,) = (x for x in os.listdir(f"{tmp_path}/p{n}") if x.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/p{n}/{name}", f"{source}/{n}.parquet")
        os.utime(f"{source}/{n}.parquet", (1_700_000_000 + n,) * 2)
    book = ledger.Ledger(spark, str(tmp_path / "table"))
    stops = {1: 2}  # micro-batch 1 is stopped twice

    class Handler(ledger.LedgerHandler):
        def flush_batch(self, df, batch):
            stop = stops.get(batch, 0) > 0
            if stop:
                stops[batch] -= 1
                if when == "before":
                    raise Stopped
                if when == "written":
                    book.write(df)
                    raise Stopped
            done = super().flush_batch(df, batch)
            if stop:
                raise Stopped
            return done

    def run():
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
        handler = Handler(book, "main")
        q = stream.writeStream.foreachBatch(lambda df, n: handler(batching.aggregate(df, 3), n)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)

    for _ in range(2):
        with pytest.raises(Exception, match="Stopped"):
            run()
    run()
    rows = book.read()
    want = [b for n in range(3) for b in batches(spark, [(f"t{n}-{i % 4}", i, f"{n}:{i}", "INFO", i) for i in range(20)]).collect()]
    assert sorted((r["trace_id"], r["content"], r["flush_id"]) for r in rows.collect()) == sorted((b["trace_id"], b["content"], b["flush_id"]) for b in want)
    assert set(book.entries()) == {"main-0", "main-1", "main-2"}
    assert book.clean() == (2 if when == "written" else 0) and rows.count() == len(want)
    # a stream that lost its checkpoint counts from 0 under another name: what is there already is known by its flush_id
    again = ledger.LedgerHandler(book, "again")
    again(batches(spark, [("t0-0", i, f"0:{i}", "INFO", i) for i in range(0, 20, 4)] + [("new", 1, "x", "INFO", 1)]), 0)
    assert book.read().count() == len(want) + 1
    with pytest.raises(FileExistsError):
        book.commit("again", 0, "other")


def test_a_compacted_ledger_reads_the_same(spark, tmp_path, monkeypatch):
    """Rows before and after, commits beside the base and below it, a stopped and a repeated compaction, full folders."""
    book = ledger.Ledger(spark, str(tmp_path / "table"))

    def put(run, batch, rows):
        book.commit(run, batch, book.write(spark.createDataFrame(rows, "flush_id string, n long").coalesce(1)))

    def held():
        return sorted((r["flush_id"], r["n"]) for r in book.read().collect())

    assert book.read() is None and book.compact() == 0
    want = []
    for n in (0, 1, 2, 5):  # 3 and 4 are not there yet
        put("a", n, rows := [(f"a{n}", i) for i in range(3)])
        want += rows
    put("b", 7, [("b7", 0), ("b7", 0)])  # rows that are equal stay as many as they are
    want += [("b7", 0)] * 2
    with monkeypatch.context() as m:
        m.setattr(book, "_publish", lambda *_: (_ for _ in ()).throw(Stopped))
        with pytest.raises(Stopped):
            book.compact()
    assert held() == sorted(want) and len(book.entries()) == 5
    assert book.compact() == 5 and book.entries() == {} and held() == sorted(want)
    assert book.base()["ranges"] == {"a": [[0, 2], [5, 5]], "b": [[7, 7]]} and len(book.base()["folders"]) == 1
    for _ in range(2):  # with and without the old entries' files
        assert all(book.committed("a", n) for n in (0, 1, 2, 5)) and not book.committed("a", 3) and not book.committed("c", 0)
        with pytest.raises(FileExistsError):
            book.commit("a", 1, "other")
        assert book.clean() in (6, 0) and held() == sorted(want)
    assert len(os.listdir(tmp_path / "table" / "data")) == 1
    assert not [n for n in os.listdir(tmp_path / "table" / "ledger") if n.endswith(".json")]
    put("a", 3, [("late", 1)])  # a number between those of the base counts
    assert held() == sorted([*want, ("late", 1)])
    (full,) = book.base()["folders"]
    assert book.compact(full_bytes=full[1]) == 0 and full in book.base()["folders"]  # the full one is not written again
    assert held() == sorted([*want, ("late", 1)]) and book.base()["ranges"]["a"] == [[0, 3], [5, 5]]
    put("a", 4, [])
    assert book.compact() == 3 and book.base()["ranges"]["a"] == [[0, 5]] and book.compact() == 0
    book.clean()
    assert held() == sorted([*want, ("late", 1)])
    handler = ledger.LedgerHandler(book, "a", keep=lambda df: df)
    assert not handler.flush_batch(spark.createDataFrame([("x", 1)], "flush_id string, n long"), 4)
    assert handler.flush_batch(spark.createDataFrame([("late", 9), ("x", 1)], "flush_id string, n long"), 6)
    assert held() == sorted([*want, ("late", 1), ("x", 1)])


def test_what_happens_during_a_compaction(spark, tmp_path, monkeypatch):
    """A stream commits while rows are merged, one number below others; another compaction is faster."""
    book = ledger.Ledger(spark, str(tmp_path / "table"))
    write = book.write

    def put(batch):
        book.commit("a", batch, write(spark.createDataFrame([(f"a{batch}", 1)], "flush_id string, n long").coalesce(1)))

    def held():
        return sorted(r["flush_id"] for r in book.read().collect())

    put(0), put(2)
    with monkeypatch.context() as m:
        m.setattr(book, "write", lambda rows: (put(1), write(rows))[1])
        assert book.compact() == 2
    assert held() == ["a0", "a1", "a2"] and set(book.entries()) == {"a-1"} and book.base()["ranges"] == {"a": [[0, 0], [2, 2]]}
    other = ledger.Ledger(spark, str(tmp_path / "table"))
    with monkeypatch.context() as m:
        m.setattr(book, "write", lambda rows: (other.compact(), write(rows))[1])
        with pytest.raises(FileExistsError):
            book.compact()
    assert held() == ["a0", "a1", "a2"] and book.entries() == {} and book.base()["number"] == 2
    book.clean()
    assert held() == ["a0", "a1", "a2"] and len(os.listdir(tmp_path / "table" / "data")) == 1


def test_degrade_files_equal_the_rows(spark, tmp_path):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    rows = [(t, at, i, f"{t} line {i} é") for t in (uuid, "plain/../id", None) for at in (5, 6) for i in range(30)] + [(uuid, 7, 1, None), (uuid, 8, 1, "x" * 500), (uuid, 8, 2, "y")]
    df = spark.createDataFrame(rows, "trace_id string, ts_ms long, seq long, content string").repartition(5)
    path = str(tmp_path / "files")
    for _ in range(2):  # a call that is repeated changes nothing
        degraded.write_degraded(df, path, most_bytes=300)
        names = sorted(os.listdir(path))
        assert not [n for n in names if n.startswith("_")]
    sizes = {n: os.path.getsize(f"{path}/{n}") for n in names}
    assert all(s <= 300 for n, s in sizes.items() if s != 501) and list(sizes.values()).count(501) == 1
    assert {os.stat(f"{path}/{n}").st_mode & 0o777 for n in names} == {0o600}
    got = {}
    for n in sorted(names, key=lambda n: (n.split(".")[0], int(n.split(".")[1]) if n.count(".") == 2 else 0)):
        got[n.split(".")[0]] = got.get(n.split(".")[0], "") + open(f"{path}/{n}", encoding="utf-8").read()
    want = {}
    for r in df.withColumn("f", degraded.file_of()).orderBy("f", "seq").collect():
        want[r["f"]] = want.get(r["f"], "") + (r["content"] or "") + "\n"
    assert got == want and all("/" not in n for n in names)
    assert {n.split(".")[0] for n in names} == {r["file"].removesuffix(".log") for r in sinks.degrade_files(df).collect()}
    degraded.write_degraded(df.limit(0), str(tmp_path / "none"))
    assert not glob.glob(f"{tmp_path}/none/*")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('t', id % 7) AS trace_id", "id % 3 AS ts_ms", "id AS seq", "CASE WHEN id = 777 THEN raise_error('broken') ELSE 'x' END AS content")
    with pytest.raises(Exception, match="broken"):
        degraded.write_degraded(df, str(tmp_path / "files"))
    bad = spark.range(400).selectExpr("concat('t', id) AS file", "'x' AS line", "id AS size").repartition(4)

    @F.udf("string")
    def late(line, size):
        if size == 399:
            raise ValueError("late failure")
        return line

    spark.dataSource.register(degraded.DegradedFiles)
    with pytest.raises(Exception, match="late failure"):
        bad.withColumn("line", late("line", "size")).write.format(degraded.FORMAT).mode("append").option("path", str(tmp_path / "files")).save()
    assert not [f for f in glob.glob(f"{tmp_path}/files/**", recursive=True) if os.path.isfile(f)] and not glob.glob(f"{tmp_path}/files/_temporary*")


PATTERN = "[%d{yyyy-MM-dd HH:mm:ss.SSS}] %-5level [%10t] %.6loggerFull %c{5} - %msg %X %X{k}%ex%n"


def test_lines_of_a_layout_written_read_and_parsed(spark, tmp_path):
    rows = [
        (i, 1_706_745_600_000 + i, ["ERROR", "INFO", "WARN"][i % 3], f"worker-{i % 4}", "app.order", f"message {i} - [x] value=1.{i}", "java.lang.IllegalStateException: e\n\tat a.B.c(B.java:1)\n\n[not a record] x" if i % 3 == 0 else None, f"v{i % 9}")
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "seq long, ts_ms long, level string, thread_name string, logger_name string, content string, throwable string, k string").withColumn("mdc", F.create_map(F.lit("k"), "k"))
    text = df.select("seq", F.rtrim(F.regexp_replace(layout.compile_layout(PATTERN), r"\n$", "")).alias("value")).orderBy("seq").select("value").coalesce(1)
    text.write.text(str(tmp_path / "logs"))
    os.makedirs(tmp_path / "flat")
    with open(glob.glob(f"{tmp_path}/logs/part*")[0], encoding="utf-8") as f, open(tmp_path / "flat" / "app.log", "w", encoding="utf-8") as out:
        out.write("Banner\nof the program\n" + f.read())  # lines before the first record
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3k", "128m"):  # many splits, whose borders lie anywhere
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = logfiles.read_log_files(spark, str(tmp_path / "flat"), PATTERN)
            splits = got.select("split").distinct().count()
            assert splits > 50 if size == "3k" else splits < 10
            found = got.filter("parsed").select("ts_ms", "level", "thread_name", "logger_name", "content", "throwable", F.col("mdc")["k"].alias("k"))
            assert sorted(map(tuple, found.collect()), key=str) == sorted(((r[1], r[2], r[3], r[4][-6:], r[5], r[6], r[7]) for r in rows), key=str)
            assert [r["value"] for r in got.filter("NOT parsed").collect()] == ["Banner\nof the program"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_default_layout_and_validation_lines(spark):
    lines = ["2024-02-01 00:00:00.123 WARN  [main] c.e.Service - hello", "no record", "场景校验: basic, expected=3, collected=3, discarded=0, flushCount=1, status=PASS", " 场景校验: deep, expected=>1, collected=0, discarded=2, flushCount=0, status=FAIL", "场景校验: odd, expected=3, collected=x, discarded=0, flushCount=1, status=PASS", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = logfiles.parse(df).collect()
    assert [(r["parsed"], r["level"], r["content"], r["ts_ms"]) for r in got[:2]] == [(True, "WARN", "hello", 1706745600123), (False, None, None, None)] and not got[5]["parsed"]
    assert tuple(logfiles.validations(df).first()) == (2, 1)


def test_names_of_degrade_files_do_not_go_through_the_driver(spark, tmp_path):
    """A task's message is as long for many files as for one, and files are read back from the tasks' lists."""
    path, names = str(tmp_path / "files"), str(tmp_path / "names")
    os.makedirs(path)
    sizes = []
    for n in (1, 3000):
        writer = degraded.Writer(path, 0, "")
        os.makedirs(writer.temporary)
        message = writer.write(iter([Row(file=f"f{n}-{i}", line="x", size=0) for i in range(n)]))
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message, None])
    assert sizes[0] == sizes[1] and len(os.listdir(path)) == 3001
    df = spark.range(4000).selectExpr("concat('t', id % 700) AS trace_id", "id % 2 AS ts_ms", "id AS seq", "concat('é', id) AS content").repartition(5)
    degraded.write_degraded(df, path, names=names)
    got = {r["file"]: (r["size"], r["lines"]) for r in degraded.read_degraded(spark, path, names).collect()}
    assert got == {r["file"]: (r["size"], r["lines"]) for r in sinks.degrade_files(df).collect()} and len(got) == 700
    assert all(os.path.getsize(f"{path}/{f}") == size for f, (size, _) in got.items())
    degraded.write_degraded(df.limit(0), str(tmp_path / "none"), names=f"{names}-none")
    assert degraded.read_degraded(spark, str(tmp_path / "none"), f"{names}-none").count() == 0


def test_degrade_files_are_dealt_over_folders(spark, tmp_path):
    """No folder grows with all files; a call that is repeated, or brings some more, replaces files of the same name and keeps the others."""
    path, names = str(tmp_path / "files"), str(tmp_path / "names")
    df = spark.range(3000).selectExpr("concat('t', id % 900) AS trace_id", "id % 2 AS ts_ms", "id AS seq", "concat('é', id) AS content").repartition(5)
    want = {r["file"]: (r["size"], r["lines"]) for r in sinks.degrade_files(df).collect()}
    for part in (df.filter("ts_ms = 0"), df, df):
        degraded.write_degraded(part, path, names=f"{names}-{uuid.uuid4().hex}", folders=16)
    degraded.write_degraded(df, path, names=names, folders=16)
    assert sorted(os.listdir(path)) == [f"{n:03x}" for n in range(16)]
    held = {f: os.path.getsize(f"{path}/{d}/{f}") for d in os.listdir(path) for f in os.listdir(f"{path}/{d}")}
    assert held == {f: size for f, (size, _) in want.items()} and max(len(os.listdir(f"{path}/{d}")) for d in os.listdir(path)) < len(held) / 4
    read = degraded.read_degraded(spark, path, names).collect()
    assert {r["file"]: (r["size"], r["lines"]) for r in read} == want and len(read) == len(want)
    # where folders cannot be moved whole, files are
    writer = degraded.Writer(path, 0, "", 16)
    os.makedirs(writer.temporary)
    message = writer.write(iter([Row(file="zz", line="x", size=0)]))
    writer._move_files(degraded.fs.LocalFileSystem(), message.own, writer.temporary, str(tmp_path / "moved"), None)
    assert glob.glob(f"{tmp_path}/moved/*/zz.log")
    # the registered query deals its files too
    from cedarlog.plans import registry

    source, shared = str(tmp_path / "tables"), registry.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{shared}/degraded-*"))
    spark.sql("SELECT id AS event_id, timestamp_micros(id * 1000000)::timestamp_ntz AS ts, id % 50 AS user_id, 'error' AS event_type, 1.0D AS value, '{}' AS props FROM range(3000)").write.parquet(f"{source}/events.parquet")
    assert registry.QUERIES["snk_written_files"](spark, source).count() == 3000
    (made,) = (x for x in set(glob.glob(f"{shared}/degraded-*")) - before if not x.endswith("-names"))
    assert len(os.listdir(made)) > 500 and not glob.glob(f"{made}/*.log")
