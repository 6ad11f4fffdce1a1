"""The batcher as a streaming query: the same batches as ``operators.batching`` gives for the same ordered input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.batching import LEAST_BATCH_BYTES
from ..schema import RANKS

OUT = "trace_id string, batch_id long, content string, entry_count int, total_bytes long, max_level string, first_ms long, last_ms long, final_flush boolean"
STATE = "batch_id long, lines array<string>, bytes long, level string, first_ms long, last_ms long"


def _rank(level: str | None) -> int:
    return RANKS.get((level or "").upper(), 0)


def stream_batches(lines: DataFrame, most: int = 100, most_bytes: int = 1 << 20, floor: int = LEAST_BATCH_BYTES, idle: str | None = None) -> DataFrame:
    """Batches of a stream of formatted records (trace_id, seq, line, bytes, level, ts_ms, close).

    A row with close = true ends its trace and flushes what is open, as does ``idle`` time (processing time) without
    records. State is one open batch per trace, so it is bounded by the batch limits; rows of a micro-batch are taken in
    order of seq; rows of a closed trace start a new one."""
    most, most_bytes = max(1, most), max(floor, most_bytes)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        batch, held, size, level, first, last = state.get if state.exists else (0, [], 0, None, 0, 0)
        held = list(held)

        def emit(final: bool) -> None:
            nonlocal batch, held, size, level
            if held:
                out.append((key[0], batch, "\n".join(held), len(held), size, level or "TRACE", first, last, final))
                batch, held, size, level = batch + 1, [], 0, None

        closed = state.hasTimedOut
        if closed:
            emit(True)
        else:
            for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
                if row.close:
                    emit(True)
                    closed = True
                    continue
                closed = False
                if not held:
                    first = int(row.ts_ms)
                last = int(row.ts_ms)
                if level is None or _rank(row.level) > _rank(level):
                    level = row.level
                held.append(row.line)
                size += int(row.bytes)
                if len(held) >= most or size >= most_bytes:
                    emit(False)
        if closed:
            state.remove()
        else:
            state.update((batch, held, size, level, first, last))
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return lines.select("trace_id", "seq", "line", "bytes", "level", "ts_ms", F.coalesce("close", F.lit(False)).alias("close")).groupBy("trace_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)


def stream_counters(events: DataFrame, at: str, tags: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counters by event-time windows. A row counts as long as its window is open, that is until the micro-batch after the
    one that moved the watermark beyond it; later rows, and rows without a time, are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *tags).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *tags, "n")
