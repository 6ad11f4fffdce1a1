"""The life of a trace on a stream: open, closed by a marker or by idleness, remembered, forgotten.

State of a trace is one open batch (bounded by the batch limits) or, once it is closed, one row that says so. Timers on event
time end both: a trace without records for ``idle_ms`` is closed, and a closed one is forgotten ``remember_ms`` after its end,
so that state does not grow with the traces that ever were. A record of a closed trace is not batched; it comes out with
the reason ``buffer_closed_late_arrival``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.batching import LEAST_BATCH_BYTES
from ..schema import RANKS

LATE = "buffer_closed_late_arrival"
OUT = "trace_id string, kind string, seq long, reason string, batch_id long, content string, entry_count int, total_bytes long, max_level string, first_ms long, last_ms long, final_flush boolean"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def _rank(level: str | None) -> int:
    return RANKS.get((level or "").upper(), 0)


class Trace(StatefulProcessor):
    """One trace: its records in order of seq within a micro-batch, its timers and its end."""

    def __init__(self, most: int, most_bytes: int, idle_ms: int, remember_ms: int):
        self.most, self.most_bytes, self.idle_ms, self.remember_ms = most, most_bytes, idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: until_ms: when the timer that counts is due; batch_id: of the next batch; closed: the trace has ended.
        self.life = handle.getValueState("life", "closed boolean, until_ms long, batch_id long")
        self.open = handle.getValueState("open", "bytes long, level string, first_ms long, last_ms long")
        self.lines = handle.getListState("lines", "line string")

    def _timer(self, until: int) -> None:
        """One timer at a time: one that has been put off is taken back."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(until)

    def _load(self):
        held = [x[0] for x in self.lines.get()] if self.open.exists() else []
        size, level, first, last = self.open.get() if held else (0, None, None, None)
        return held, size, level, first, last

    def _batch(self, key, batch, held, size, level, first, last, final) -> tuple:
        return (key[0], "batch", None, None, batch, "\n".join(held), len(held), size, level or "TRACE", first, last, final)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        closed, until, batch = self.life.get() if self.life.exists() else (False, 0, 0)
        held, size, level, first, last = self._load()
        out, was_closed = [], closed
        for r in pd.concat(frames).sort_values(["seq", "close"], kind="stable").itertuples(index=False):
            if closed:
                if not r.close:
                    out.append((key[0], "rejected", int(r.seq), LATE, None, r.line, None, None, r.level, None, None, None))
                continue
            at = int(r.at_ms)
            if r.close:
                if held:
                    out.append(self._batch(key, batch, held, size, level, first, last, True))
                    batch, held, size, level = batch + 1, [], 0, None
                closed, until = True, max(until, at)
                continue
            if not held:
                first = int(r.ts_ms)
            last, until = int(r.ts_ms), max(until, at)
            if level is None or _rank(r.level) > _rank(level):
                level = r.level
            held.append(r.line)
            size += int(r.bytes)
            if len(held) >= self.most or size >= self.most_bytes:
                out.append(self._batch(key, batch, held, size, level, first, last, False))
                batch, held, size, level = batch + 1, [], 0, None
        self._store(closed, was_closed, until, batch, held, size, level, first, last, timerValues)
        yield pd.DataFrame(out, columns=NAMES)

    def _store(self, closed, was_closed, until, batch, held, size, level, first, last, timers) -> None:
        self.life.update((closed, until, batch))
        if held:
            self.open.update((size, level, first, last))
            self.lines.put([(x,) for x in held])
        else:
            self.open.clear()
            self.lines.clear()
        if not was_closed:  # late records do not keep a closed trace in mind
            self._timer(max(until + (self.remember_ms if closed else self.idle_ms), timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.life.exists():
            return
        closed, until, batch = self.life.get()
        if closed:
            self.life.clear()
            return
        held, size, level, first, last = self._load()
        self._store(True, False, until + self.idle_ms, batch + bool(held), [], 0, None, None, None, timerValues)
        if held:
            yield pd.DataFrame([self._batch(key, batch, held, size, level, first, last, True)], columns=NAMES)


def trace_lives(
    lines: DataFrame, at: str = "at", lateness: str = "10 minutes", most: int = 100, most_bytes: int = 1 << 20, floor: int = LEAST_BATCH_BYTES, idle_ms: int = 600_000, remember_ms: int = 3_600_000
) -> DataFrame:
    """Batches (kind batch) and refused records (kind rejected, with their reason) of a stream of formatted records (trace_id,
    seq, line, bytes, level, ts_ms, close, and the timestamp ``at``, when the record was seen).

    A row with close = true ends its trace; a second one changes nothing. Rows of a closed trace come out as late until it
    is forgotten; after that its id starts a new trace with batch 0. Rows that are older than ``lateness`` behind the newest
    are dropped by the watermark before they get here and show in the query's progress. State lies in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``); its size is that of the open and remembered traces."""
    rows = lines.withColumn("at", F.col(at)).withWatermark("at", lateness)
    rows = rows.select("trace_id", "seq", "line", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "level", F.coalesce("ts_ms", F.lit(0)).cast("long").alias("ts_ms"), F.coalesce("close", F.lit(False)).alias("close"), "at", F.unix_millis("at").alias("at_ms"))
    life = Trace(max(1, most), max(floor, most_bytes), idle_ms, remember_ms)
    return rows.groupBy("trace_id").transformWithStateInPandas(life, OUT, "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
