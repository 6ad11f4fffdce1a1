"""Circuit breaking, retries and degrade routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import level_rank
from .batching import ordered_fold

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


def breaker(samples: int = 5, rate: float = 0.6, interval_ms: int = 30_000, most_interval_ms: int = 300_000, half_open: int = 3, successes: int = 3, window_s: int = 10, enabled: bool = True):
    """(allowed, state, interval_ms, recovered) of each attempt (t_ms, ok, control) of a method, in order.

    CLOSED opens once at least ``samples`` outcomes are counted and their failed share reaches ``rate``. OPEN lets a probe
    pass after the interval and is HALF_OPEN then; the probe is not counted. HALF_OPEN lets ``half_open`` more pass, closes
    after ``successes`` of them, and opens again at a failure with twice the interval, up to a limit. Counts are halved
    when the decay interval is over. control: 'reset' closes, 'open' opens."""
    decay_ms = 1000 * min(max(window_s // 2, 5), 30)

    def start():
        state, interval, opened, total, failed, passed, good, decayed = CLOSED, interval_ms, 0, 0, 0, 0, 0, 0

        def fall(t):
            nonlocal state, opened, passed, good
            state, opened, passed, good = OPEN, t, 0, 0

        def step(t, ok, control):
            nonlocal state, interval, total, failed, passed, good, decayed
            t = int(t)
            if control == "reset":
                state, interval, total, failed, passed, good = CLOSED, interval_ms, 0, 0, 0, 0
                return (False, state, interval, False)
            if control == "open":
                fall(t)
                return (False, state, interval, False)
            if not enabled or state == CLOSED:
                allowed = True
            elif state == OPEN:
                allowed = t - opened >= interval
                if allowed:
                    state, passed, good = HALF_OPEN, 0, 0
            else:
                passed += 1
                allowed = passed <= half_open
            recovered = False
            if allowed and enabled:
                if t - decayed >= decay_ms:
                    total, failed, decayed = total // 2, failed // 2, t
                total += 1
                if ok:
                    if state == HALF_OPEN:
                        good += 1
                        if good >= successes:
                            state, interval, total, failed, recovered = CLOSED, interval_ms, 0, 0, True
                else:
                    failed += 1
                    if state == HALF_OPEN:
                        interval = min(2 * interval, most_interval_ms)
                        fall(t)
                    elif state == CLOSED and total >= samples and failed / total >= rate:
                        fall(t)
            return (allowed, state, interval, recovered)

        return step

    return start


def run_breaker(attempts: DataFrame, key: str = "method_key", order: tuple[str, ...] = ("t_ms", "seq"), **settings) -> DataFrame:
    """Attempts (key, t_ms, seq, ok and, if there is one, control) with the breaker's answers."""
    if "control" not in attempts.columns:
        attempts = attempts.withColumn("control", F.lit(None).cast("string"))
    return ordered_fold(attempts, [key], order, ["t_ms", "ok", "control"], "allowed boolean, state string, interval_ms long, recovered boolean", breaker(**settings))


def retried(ok: Column, attempts: int = 3, base_ms: int = 100, most_ms: int = 2000, sync_ms: int | None = None) -> Column:
    """From an array of outcomes of consecutive tries: (attempts, success, waited_ms), without jitter."""
    first = F.array_position(F.slice(ok, 1, attempts), True).cast("int")
    used = F.when(first > 0, first).otherwise(F.least(F.size(ok), F.lit(attempts)))
    limit = min(most_ms, sync_ms) if sync_ms else most_ms
    waited = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), F.lit(0).cast("long"), lambda a, k: a + F.when(k < used - 1, F.least(F.lit(limit), F.lit(base_ms) * F.pow(F.lit(2), k))).otherwise(0).cast("long"))
    return F.struct(used.alias("attempts"), (first > 0).alias("success"), waited.alias("waited_ms"))


def degrade_target(storage: Column, level: Column, file_ok: Column, memory_ok: Column) -> Column:
    """Where a record that could not be written goes: file, memory, discarded (which counts as success) or failed."""
    file_first = F.when(file_ok, "file").when(memory_ok, "memory").otherwise("failed")
    memory_first = F.when(memory_ok, "memory").when(file_ok, "file").otherwise("failed")
    return (
        F.when(storage == "FILE", file_first)
        .when(storage == "LIMITED_MEMORY", memory_first)
        .when(storage == "DISCARD_NON_ERROR", F.when(level_rank(level) >= 4, memory_first).otherwise("discarded"))
        .when(storage == "DISCARD_ALL", "discarded")
        .otherwise(file_first)
    )


def ultimate(target: Column, block: bool = False) -> Column:
    """After every storage failed: an error, or a reason."""
    return F.when(target == "failed", F.raise_error(F.lit("degrade failed")).cast("string") if block else F.lit("ultimate_discard"))


def degraded_batches(df: DataFrame, by: tuple[str, ...] = ("trace_id", "batch_id")) -> DataFrame:
    """A batch that degrades: its highest level, and its contents without layout as lines."""
    return df.groupBy(*by).agg(
        F.max_by("level", F.struct(level_rank(F.col("level")), -F.col("seq"))).alias("level"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("content"),
        F.count("*").alias("n"),
    )


def timed_out(duration_ms: Column, timeout_ms: int = 5000) -> Column:
    return F.coalesce(duration_ms > timeout_ms, F.lit(False)) if timeout_ms > 0 else F.lit(False)
