"""Where batches and records go."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def identifier(name: str) -> str:
    """A table or column name that needs no quoting; anything else is refused."""
    if not IDENTIFIER.fullmatch(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


class Handler(Protocol):
    """What a sink may define; ``BaseHandler`` has the defaults."""

    def collect(self, level: Column, summary: Column) -> Column: ...
    def append(self, records: DataFrame) -> None: ...
    def flush(self, batches: DataFrame) -> None: ...


class BaseHandler:
    """Collects everything, prefers AGGREGATE; records appended without a sink are counted as discarded."""

    preferred_mode = "AUTO"
    pattern: str | None = None
    separator = "\n"

    def __init__(self) -> None:
        self.discarded = 0

    def before(self) -> None: ...
    def after(self) -> None: ...
    def on_error(self, error: Exception) -> None: ...
    def on_degrade(self, events: DataFrame) -> None: ...

    def collect(self, level: Column, summary: Column) -> Column:
        return F.lit(True)

    def append(self, records: DataFrame) -> None:
        self.discarded += records.count()

    def flush(self, batches: DataFrame) -> None:
        raise NotImplementedError("this sink takes no batches")


class TableHandler(BaseHandler):
    """Writes parameters of records or batches to a table (Parquet, or JDBC through ``write``), each batch once."""

    def __init__(self, name: str, write: Callable[[DataFrame, str], None], written: Callable[[], DataFrame | None] = lambda: None):
        super().__init__()
        self.name, self.write, self.written = identifier(name), write, written

    def append(self, records: DataFrame) -> None:
        self.write(single_rows(records), self.name)

    def flush(self, batches: DataFrame) -> None:
        self.write(aggregate_rows(batches, self.written()), self.name)


class MemoryHandler(BaseHandler):
    """For tests: keeps what it gets."""

    def __init__(self) -> None:
        super().__init__()
        self.records: list = []
        self.batches: list = []

    def append(self, records: DataFrame) -> None:
        self.records += records.collect()

    def flush(self, batches: DataFrame) -> None:
        self.batches += batches.collect()

    def of(self, trace_id: str) -> list:
        return [r for r in (*self.records, *self.batches) if r["trace_id"] == trace_id]

    def clear(self) -> None:
        self.records.clear()
        self.batches.clear()


def single_rows(records: DataFrame) -> DataFrame:
    return records.select("trace_id", "content", "level", F.timestamp_millis("ts_ms").alias("time"))


def aggregate_rows(batches: DataFrame, written: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """What a batch's row holds (and ``also`` further columns); batches whose flush_id is written already are left out."""
    new = batches if written is None else batches.join(written.select("flush_id"), "flush_id", "left_anti")
    return new.select("trace_id", "content", "entry_count", "max_level", F.col("final_flush").alias("is_final"), F.col("last_time").alias("time"), *also)


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def degrade_files(events: DataFrame, at_ms: str = "ts_ms") -> DataFrame:
    """Names and sizes of degrade files: <trace>_<ms>.log with a line for each record; an id that is no UUID is hashed."""
    safe = F.when(F.col("trace_id").rlike(UUID), F.col("trace_id")).otherwise(F.substring(F.sha2(F.coalesce("trace_id", F.lit("")), 256), 1, 32))
    return events.groupBy("trace_id", at_ms).agg(F.sum(F.octet_length("content") + 1).alias("size"), F.count("*").alias("lines")).select(F.concat(safe, F.lit("_"), F.col(at_ms).cast("string"), F.lit(".log")).alias("file"), "size", "lines", "trace_id", F.col(at_ms).alias("mtime_ms"))


def memory_kept(events: DataFrame, most: int = 1000, key: str = "store", order: str = "seq") -> DataFrame:
    """A bounded memory sink per store: later items are refused."""
    return events.withColumn("stored", F.row_number().over(W.partitionBy(key).orderBy(order)) <= most)


def encrypted(c: Column, key: Column) -> Column:
    """AES-GCM with a random vector, as base64."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypted(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def foreach_batch(handler: BaseHandler, degrade: Callable[[DataFrame, Exception], None] | None = None, attempts: int = 3):
    """For writeStream.foreachBatch: a micro-batch is written as a whole or tried again; the last failure degrades."""

    def write(batches: DataFrame, _: int) -> None:
        handler.before()
        try:
            for n in range(attempts):
                try:
                    handler.flush(batches)
                    return
                except NotImplementedError:
                    raise
                except Exception as e:
                    handler.on_error(e)
                    if n + 1 == attempts:
                        if degrade is None:
                            raise
                        degrade(batches, e)
        finally:
            handler.after()

    return write


def audit(actions: DataFrame, path: str) -> None:
    """Appends a line for each management action (at, actor, action, target)."""
    actions.select(F.concat_ws(" ", "at", "actor", "action", "target").alias("value")).write.mode("append").text(path)
