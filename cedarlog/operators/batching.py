"""Ordered batching of records per trace.

Batches by count alone are window expressions; batches by count and bytes come from cut points (``cutting``), which divide a
long trace over many tasks. What a batch contains is then an ordinary aggregation. Limits and quotas in which a record
that does not fit is left out, so that a later one may fit, are a fold over each key's records in order: keys, order and
inputs are shuffled by key, sorted inside the partition, and streamed through a small state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sizing import entry_bytes, line_bytes, segment_bytes, string_bytes
from ..schema import high_priority, level_rank
from .cutting import RANGE, Limits, cut_batches

LEAST_BATCH_BYTES = 1024


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """``df`` with columns ``outputs`` (DDL) that a fold gives each row.

    start() makes the step function of a key; a step takes the ``inputs`` of a row and returns its outputs. A key is one task's
    and the other columns travel along as Arrow batches: give it the columns it needs."""
    names = [x.split()[0] for x in outputs.split(", ")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = object(), None
        for batch in batches:
            rows = []
            for own, values in zip(zip(*(batch[k] for k in keys), strict=True), zip(*(batch[i] for i in inputs), strict=True), strict=True):
                if own != key:
                    key, step = own, start()
                rows.append(step(*values))
            yield batch.assign(**{n: [r[i] for r in rows] for i, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, fields)


def batches_by_count(most: int, key: str = "trace_id", order: str = "seq") -> Column:
    """Batch number of a record where only the count closes a batch."""
    return F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / max(1, most)).cast("long")


def pipeline_limits(most: int, most_bytes: int, floor: int = LEAST_BATCH_BYTES) -> Limits:
    """Add, then close once count or bytes reach their limit; a new pattern version closes before. Batches may exceed the
    byte limit by their last record."""
    return Limits(max(1, most), max(floor, most_bytes))


def legacy_single(df: DataFrame, most: int, most_bytes: int, overflow: str = "FLUSH_EARLY", range_rows: int = RANGE) -> DataFrame:
    """Records that a legacy buffer hands on one by one, with the batch that they are handed on in and their fate.

    A record's size is that of the entry (``sizing.entry_bytes``). One larger than the byte limit is handed on at once
    (batch -1 and below, fate direct); the others fill the buffer, which is emptied before a record that would exceed a limit
    and once a limit is reached (FLUSH_EARLY), evicts its oldest (DROP_OLDEST) or refuses what does not fit (DROP_NEWEST)."""
    sized = df.withColumn("bytes", entry_bytes())
    large = F.col("bytes") > most_bytes if most_bytes > 0 else F.lit(False)
    direct_ = sized.filter(large).withColumns({"batch_id": -1 - F.col("seq").cast("long"), "fate": F.lit("direct")})
    rest = sized.filter(~large)
    if overflow == "DROP_OLDEST":
        held = evict_oldest(rest, most, most_bytes, "bytes").withColumn("batch_id", F.when(F.col("fate") == "kept", F.lit(0)).cast("long"))
    elif overflow == "DROP_NEWEST":
        held = refuse_newest(rest, most, most_bytes, "bytes").withColumn("batch_id", F.when(F.col("fate") == "buffered", F.lit(0)).cast("long"))
    else:
        held = cut_batches(rest, Limits(max(1, most), max(0, most_bytes), before=True), range_rows=range_rows).drop("last_batch").withColumn("fate", F.lit("buffered"))
    return held.unionByName(direct_)


def refuse_newest(df: DataFrame, most: int, most_bytes: int, size: str, key: str = "trace_id", order: str = "seq") -> DataFrame:
    """DROP_NEWEST: a record that does not fit is refused, a later and smaller one may fit. fate: buffered or
    buffer_overflow_rejected. Without a byte limit the first ``most`` records of a key fit."""
    if most_bytes <= 0:
        fits = F.row_number().over(W.partitionBy(key).orderBy(order)) <= max(1, most)
        return df.withColumn("fate", F.when(fits, "buffered").otherwise("buffer_overflow_rejected"))
    return ordered_fold(df.withColumn("__size", F.col(size)), [key], [order], ["__size"], "__batch long, fate string", legacy_batches(most, most_bytes, "DROP_NEWEST")).drop("__size", "__batch")


def limit_reason(most: int, policy: str = "STOP_COLLECTING", mode: str = "pipeline", key: str = "trace_id", order: str = "seq") -> Column:
    """``total_limits`` where only the count is limited and nothing is sampled: until the limit every record counts, so it is
    reached at a record's number."""
    over = F.row_number().over(W.partitionBy(key).orderBy(order)) > most if most > 0 else F.lit(False)
    if mode == "legacy" and policy == "DOWNGRADE_LEVEL":
        return F.when(over & ~high_priority(F.col("level")), "total_limit_downgrade")
    return F.when(over, "total_limit_reached")


def pipeline_batches(most: int, most_bytes: int, floor: int = LEAST_BATCH_BYTES):
    """``pipeline_limits`` as a fold: the definition, one record after the other."""
    most, most_bytes = max(1, most), max(floor, most_bytes)

    def start():
        batch, n, size, version = 0, 0, 0, None

        def step(b, v):
            nonlocal batch, n, size, version
            if n and v != version:
                batch, n, size = batch + 1, 0, 0
            own, version = batch, v
            n, size = n + 1, size + int(b)
            if n >= most or size >= most_bytes:
                batch, n, size = batch + 1, 0, 0
            return (own,)

        return step

    return start


def single_batches(most: int, most_bytes: int):
    """As ``pipeline_batches`` for records that are emitted one by one; 0 bytes is no limit."""

    def start():
        batch, n, size = 0, 0, 0

        def step(b):
            nonlocal batch, n, size
            own, n, size = batch, n + 1, size + int(b)
            if n >= max(1, most) or (most_bytes > 0 and size >= most_bytes):
                batch, n, size = batch + 1, 0, 0
            return (own,)

        return step

    return start


def legacy_batches(most: int, most_bytes: int, overflow: str = "FLUSH_EARLY"):
    """(batch, fate): close before a record that would exceed the bytes, add it, close again at a limit. A record larger
    than a batch bypasses the buffer as a batch of its own (fate direct). DROP_NEWEST refuses what does not fit, row by
    row, and closes once, at the end (fate buffer_overflow_rejected)."""

    def start():
        batch, n, size = 0, 0, 0

        def close():
            nonlocal batch, n, size
            if n:
                batch, n, size = batch + 1, 0, 0

        def step(b, version=None):
            nonlocal n, size, batch
            b = int(b)
            if most_bytes > 0 and b > most_bytes:
                return (-1, "direct")
            full = n + 1 > max(1, most) or (most_bytes > 0 and size + b > most_bytes)
            if overflow == "DROP_NEWEST":
                if full:
                    return (-1, "buffer_overflow_rejected")
            elif full:
                close()
            own, n, size = batch, n + 1, size + b
            if overflow == "FLUSH_EARLY" and (n >= max(1, most) or (most_bytes > 0 and size >= most_bytes)):
                close()
            return (own, "buffered")

        return step

    return start


def evict_oldest(df: DataFrame, most: int, most_bytes: int, size: str, keys: Sequence[str] = ("trace_id",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """DROP_OLDEST: the head goes until a record fits. fate: kept or buffer_overflow_evicted, decided from the end.

    A record stays if it and all later ones fit; so the fold runs in reverse order and needs no queue."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)).rowsBetween(W.unboundedPreceding, 0)
    fits = (F.count("*").over(w) <= max(1, most)) & ((F.lit(most_bytes) <= 0) | (F.sum(size).over(w) <= most_bytes))
    return df.withColumn("fate", F.when(fits, "kept").otherwise("buffer_overflow_evicted"))


def total_limits(most: int, most_bytes: int, policy: str = "STOP_COLLECTING", mode: str = "pipeline", every: int = 1):
    """Reason (or None) by running totals; dropped records use nothing up. 0 is no limit.

    In pipeline mode the totals are checked without, then with the record's size, and always stop. In legacy mode the
    policy may let high levels pass (DOWNGRADE_LEVEL) or sample by count (SAMPLE: the sampler counts twice over the
    limit, once for the policy and once as any record)."""

    def start():
        count = size = seen = 0

        def step(b, high):
            nonlocal count, size, seen
            b = int(b)
            over = (most > 0 and count >= most) or (most_bytes > 0 and size + b > most_bytes) or (mode == "pipeline" and most_bytes > 0 and size > most_bytes)
            reason = None
            if over:
                if mode == "pipeline" or policy == "STOP_COLLECTING":
                    reason = "total_limit_reached"
                elif policy == "DOWNGRADE_LEVEL":
                    reason = None if high else "total_limit_downgrade"
                else:
                    seen += 1
                    reason = None if seen % every == 0 else "total_limit_sampled"
            if reason is None and mode == "legacy" and every > 1:
                seen += 1
                reason = None if seen % every == 0 else "sampled_out"
            if reason is None:
                count, size = count + 1, size + b
            return (reason,)

        return step

    return start


def quota(soft: int, hard_factor: float = 1.5, sync: int = 0, floor: int = 1 << 20):
    """(fate, used) over reservations and releases in order: accepted, forced (high priority up to the hard limit) or
    rejected. soft 0 is unlimited; a small limit is raised to ``floor``; negative is an error. ``sync``: local sums of
    accepted bytes are only added once they reach it, so the total may lag."""
    if soft < 0:
        raise ValueError("the quota must not be negative")
    soft = max(soft, floor) if soft else 0

    def start():
        used = local = 0

        def step(b, high):
            nonlocal used, local
            b = int(b)
            if b < 0:
                used = max(0, used + b)
                return ("released", used)
            fate = "accepted" if not soft or used + b <= soft else "forced" if high and used + b <= soft * hard_factor else "rejected"
            if fate != "rejected":
                local += b
                if local >= sync:
                    used, local = used + local, 0
            return (fate, used)

        return step

    return start


def plain_buffer(df: DataFrame, key: str, order: str, drain: Column, capacity: int) -> DataFrame:
    """``df`` with fate and held: a row that drains empties its key's buffer, of the others ``capacity`` are taken between two
    drains and the rest find it full; held is what lies in it after a row, or what a drain takes out."""
    rows = df.withColumn("__drain", drain.cast("int"))
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__drains", F.coalesce(F.sum("__drain").over(before), F.lit(0)))
    within = W.partitionBy(key, "__drains").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    offers = F.sum(1 - F.col("__drain")).over(within)
    fate = F.when(F.col("__drain") == 1, "drained").when(offers <= capacity, "offered").otherwise("full")
    return rows.withColumns({"fate": fate, "held": F.least(offers, F.lit(capacity)).cast("long")}).drop("__drain", "__drains")


def utilization(count: Column, most: int, size: Column, most_bytes: int) -> Column:
    return F.greatest(count / most if most > 0 else F.lit(0.0), size / most_bytes if most_bytes > 0 else F.lit(0.0))


def flush_id(trace: Column, batch: Column) -> Column:
    """A repeatable identity, so that a batch that is written again is known."""
    return F.sha2(F.concat_ws("|", trace, batch.cast("string")), 256)


def finalise(df: DataFrame, separator: str = "\n", key: str = "trace_id", legacy: bool = False, line: str = "line", size: str = "bytes", by_time: bool = False) -> DataFrame:
    """One row per batch: lines joined in order, count, bytes, the highest level (as the first record that has it spells it;
    legacy never goes below TRACE), first and last time in order (or, ``by_time``, least and greatest positive ones, where the size is that of the joined content), and
    whether it is the trace's last batch. A batch's size is bounded by its limits, so its lines fit in one row."""
    if legacy:
        level = F.when(F.max(level_rank(F.col("level"))) > 0, F.max_by("level", F.struct(level_rank(F.col("level")), -F.col("seq")))).otherwise("TRACE")
    else:
        level = F.coalesce(F.max_by("level", F.struct(F.col("level").isNotNull(), level_rank(F.col("level")), -F.col("seq"))), F.lit("TRACE"))
    positive = F.when(F.col("ts_ms") > 0, F.col("ts_ms"))
    grouped = df.groupBy(key, "batch_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col(line).alias("line")))), lambda x: x["line"]), separator).alias("content"),
        F.count("*").cast("int").alias("entry_count"),
        F.sum(size).alias("total_bytes"),
        level.alias("max_level"),
        F.timestamp_millis(F.min(positive) if by_time else F.min_by("ts_ms", "seq")).alias("first_time"),
        F.timestamp_millis(F.max(positive) if by_time else F.max_by("ts_ms", "seq")).alias("last_time"),
        *([F.max("last_batch").alias("last_batch")] if "last_batch" in df.columns else []),
    )
    if by_time:
        grouped = grouped.withColumn("total_bytes", string_bytes(F.col("content")))
    grouped = grouped.withColumn("flush_id", flush_id(F.col(key), F.col("batch_id")))
    if "last_batch" in df.columns:
        return grouped.withColumn("final_flush", F.col("batch_id") == F.col("last_batch")).drop("last_batch")
    return grouped.withColumn("final_flush", F.col("batch_id") == F.max("batch_id").over(W.partitionBy(key)))


def aggregate(df: DataFrame, most: int = 100, most_bytes: int = 1 << 20, mode: str = "pipeline", overflow: str = "FLUSH_EARLY", separator: str = "\n", floor: int = LEAST_BATCH_BYTES) -> DataFrame:
    """Formatted records (column line, and pattern_version if there is one) as batches, in either mode."""
    versions = "pattern_version" in df.columns
    if not versions:
        df = df.withColumn("pattern_version", F.lit(1))
    if mode == "pipeline":
        sized = df.withColumn("bytes", line_bytes(F.col("line")))
        return finalise(cut_batches(sized, pipeline_limits(most, most_bytes, floor), version="pattern_version"), "\n")
    sized = df.filter(F.length("line") > 0).withColumn("bytes", segment_bytes(F.col("line")))
    rest = sized.filter(F.col("bytes") <= most_bytes) if most_bytes > 0 else sized
    if overflow == "DROP_OLDEST":
        folded = evict_oldest(rest, most, most_bytes, "bytes").filter("fate = 'kept'").withColumn("batch_id", F.lit(0).cast("long"))
    elif overflow == "DROP_NEWEST":
        folded = refuse_newest(rest, most, most_bytes, "bytes").filter("fate = 'buffered'").withColumn("batch_id", F.lit(0).cast("long"))
    else:
        folded = cut_batches(rest, Limits(max(1, most), max(0, most_bytes), before=True))
    if versions:  # what is drained together is written in parts of one pattern version each
        w = W.partitionBy("trace_id").orderBy("seq")
        here, before = F.struct("batch_id", "pattern_version"), F.lag(F.struct("batch_id", "pattern_version")).over(w)
        folded = folded.withColumn("__new", (~here.eqNullSafe(before)).cast("long")).withColumn("batch_id", F.sum("__new").over(w) - 1).drop("__new", "last_batch")
    batches = finalise(folded, separator, legacy=True)
    if most_bytes <= 0:
        return batches
    # a record larger than a batch bypasses the buffer: a batch of its own, known by a negative number, never the last
    return batches.unionByName(direct(sized.filter(F.col("bytes") > most_bytes)).withColumn("batch_id", -1 - F.col("batch_id")).withColumn("flush_id", flush_id(F.col("trace_id"), F.col("batch_id"))).withColumn("total_bytes", F.col("total_bytes") + 64))


def direct(df: DataFrame) -> DataFrame:
    """Unbuffered writes: every record is a batch of one, whose number is its place (seq)."""
    at = F.timestamp_millis("ts_ms")
    return df.select(
        "trace_id", F.col("seq").cast("long").alias("batch_id"), F.col("line").alias("content"), F.lit(1).alias("entry_count"), (segment_bytes(F.col("line")) - 64).alias("total_bytes"),
        F.when(level_rank(F.col("level")) > 0, F.col("level")).otherwise("TRACE").alias("max_level"), at.alias("first_time"), at.alias("last_time"),
        flush_id(F.col("trace_id"), F.col("seq")).alias("flush_id"), F.lit(False).alias("final_flush"),
    )


def retained(files: DataFrame, ttl_ms: int, now_ms: int, most_bytes: int) -> DataFrame:
    """Degrade files (file, size, mtime_ms): expired ones go, then the oldest until the rest fits. fate: kept, expired or evicted.

    The running sum is over all files of one store; a store is a partition (column store) so that stores are independent."""
    alive = F.col("mtime_ms") >= now_ms - ttl_ms
    newer = F.sum(F.when(alive, F.col("size")).otherwise(0)).over(W.partitionBy("store").orderBy(F.desc("mtime_ms"), F.desc("file")).rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("fate", F.when(~alive, "expired").when(newer <= most_bytes, "kept").otherwise("evicted"))
