"""Cut points of batches in parallel, so that one trace of any length is the work of many tasks.

A batch that starts at a record ends where the running count or the running bytes since then reach a limit: running sums
and a binary search give every record the start of the batch after it. From any record on, batches are the path along
these pointers, and pointer jumping follows all paths at once, in as many passes over an array as the number of records
has binary digits.

Traces of up to ``RANGE`` records are cut inside a task, many at a time. A longer one is divided into ranges of its order by
approximate quantiles. A range does not know where the first batch starts in it; it works out, for each of its first
``most`` records, how many batches close in it and what stays open at its end if that record is a start. A scan of
these answers, a row for each range, then says where each range begins, and the ranges mark their starts.

Only keys, order, sizes and versions take part. Their result is a mark for each start, and the records learn their batch
from the last mark before them, by a window inside their range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written

#: Records of a range (approximately), most ranges of a trace, and records that a task works on at once.
RANGE, MOST_RANGES, CHUNK = 500_000, 4096, 1 << 17
#: Rows up to which a table of work is broadcast.
SMALL = 500_000

#: Columns of text of the frames that tasks work on.
STRINGS = ("key", "version", "open_version")
MARKS = "key string, part int, at bigint, batch_id bigint, last_batch bigint"
SUMMARY = "key string, part int, first string, last string, heads_n binary, heads_size binary, breaks int, units int, n bigint, size bigint, closed binary, open_n binary, open_size binary"


@dataclass(frozen=True)
class Limits:
    """most: records of a batch. size: its bytes, 0 for no limit. before: a record that would exceed a limit starts the next
    batch; otherwise it is the last one of its batch."""

    most: int
    size: int
    before: bool = False


class Path:
    """The starts that follow each unit of a run of units; a unit is the records that share a place in the order.

    Units are 0 to m - 1, and m is the end. ``after[i]`` is the start that follows a batch begun at i, m + 1 if that batch is
    still open at the end."""

    def __init__(self, n: np.ndarray, size: np.ndarray, forced: np.ndarray, limits: Limits):
        self.limits, self.m = limits, len(n)
        self.n, self.size = (np.concatenate([[0], np.cumsum(x)]) for x in (n, size))
        places = np.where(forced, np.arange(self.m), self.m + 1)
        self.forced = np.append(np.minimum.accumulate(places[::-1])[::-1], self.m + 1)  # the first forced start from here on
        at = np.arange(self.m)
        self.after = np.maximum(self.start_after(self.n[:-1], self.size[:-1], self.forced[1:]), at + 1)
        self.jumps = None

    def start_after(self, n: np.ndarray, size: np.ndarray, forced: np.ndarray) -> np.ndarray:
        """The start that follows a batch for which count and bytes stood at ``n`` and ``size`` when it began."""
        out = forced
        for sums, began, limit in ((self.n, n, self.limits.most), (self.size, size, self.limits.size)):
            if limit > 0:
                end = np.searchsorted(sums, began + limit)
                if self.limits.before:
                    end = np.where((end <= self.m) & (sums[np.minimum(end, self.m)] > began + limit), end - 1, end)
                out = np.minimum(out, np.where(end > self.m, self.m + 1, end))
        return out

    def doubled(self) -> list[np.ndarray]:
        """after, after twice, four times, ...; the end and a start whose batch stays open lead to themselves."""
        if self.jumps is None:
            step = np.append(np.where(self.after > self.m, np.arange(self.m), self.after), self.m)
            step = step.astype(np.int32 if self.m < 1 << 31 else np.int64)
            self.jumps = [step]
            while not np.array_equal(step, nxt := step[step]):
                self.jumps.append(step := nxt)
        return self.jumps

    def starts(self, first: int) -> np.ndarray:
        """All starts from ``first`` on, in order."""
        seen = np.zeros(self.m + 1, dtype=bool)
        seen[first] = True
        found = np.array([first])
        for jump in self.doubled():
            more = jump[found]
            more = more[~seen[more]]
            seen[more] = True
            found = np.concatenate([found, np.unique(more)])
        return np.flatnonzero(seen[: self.m])

    def outcome(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(batches that close, records and bytes of the one that stays open) for each start."""
        total = np.append((self.after <= self.m).astype(np.int64), 0)
        for jump in self.doubled()[:-1]:  # total: of the steps that the jump stands for
            total = total + total[jump]
        end = self.jumps[-1]
        open_ = end[starts]
        return total[starts], self.n[-1] - self.n[open_], self.size[-1] - self.size[open_]

    def entry(self, n: int, size: int, fresh: bool) -> int:
        """The first start in this run if a batch of ``n`` records and ``size`` bytes comes in open; m + 1 if it stays open.
        fresh: the run's first record may not join it."""
        if n == 0 or fresh:
            return 0
        return int(self.start_after(np.array([-n]), np.array([-size]), self.forced[1:2] if self.m else np.array([1]))[0])


def _units(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a row for each unit, records, bytes, whether its group begins, whether its version differs from the unit before)."""
    key = pd.factorize(rows["key"], use_na_sentinel=False)[0]
    version = pd.factorize(rows["version"], use_na_sentinel=False)[0]
    part, at = rows["part"].to_numpy(), rows["at"].to_numpy()
    group = np.ones(len(rows), dtype=bool)
    group[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    unit = group.copy()
    unit[1:] |= at[1:] != at[:-1]
    first = np.flatnonzero(unit)
    other = np.ones(len(first), dtype=bool)
    other[1:] = version[first[1:]] != version[first[1:] - 1]
    return rows if len(first) == len(rows) else rows.iloc[first], np.diff(np.append(first, len(rows))), np.add.reduceat(rows["size"].to_numpy(), first), group[first], other


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of about CHUNK rows that end where a group (key, part) ends; the last group is held back until it is complete.

    Equal strings of a batch are one object each, and what is held back keeps nothing of the frame before it, so a
    task holds CHUNK rows or its largest group, whichever is more, and few strings. A frame is let go here once the next one
    is asked for; whoever takes it lets it go before asking."""
    held: list[pd.DataFrame] = []
    size, only = 0, None  # only: the group that all held rows belong to
    for batch in batches:
        if not len(batch):
            continue
        batch = batch.assign(**{c: _shared(batch[c]) for c in STRINGS if c in batch})
        held.append(batch)
        size += len(batch)
        last = (batch["key"].iloc[-1], batch["part"].iloc[-1])
        if size >= CHUNK and last != only:
            rows = pd.concat(held, ignore_index=True)
            key = pd.factorize(rows["key"], use_na_sentinel=False)[0]
            same = (key == key[-1]) & (rows["part"].to_numpy() == last[1])
            cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [rows.iloc[cut:].copy()]
            size, only = len(held[0]), last
            frames = [rows.iloc[:cut]] if cut else []
            del rows, key, same
            while frames:
                yield frames.pop()
    if held:
        frames = [pd.concat(held, ignore_index=True)]
        held.clear()
        while frames:
            yield frames.pop()


def _shared(column: pd.Series) -> np.ndarray:
    code, values = pd.factorize(column, use_na_sentinel=False)
    values = np.asarray(values, dtype=object)
    values[pd.isna(values)] = None
    return values[code]


def _mark_whole(limits: Limits):
    """Marks of traces that lie in one task each: a group begins a batch, so all groups of a frame are one path."""

    def run(batches):
        for rows in _whole_groups(batches):
            units, n, size, group, other = _units(rows)
            path = Path(n, size, group | other, limits)
            starts = path.starts(0)
            of = np.cumsum(group)[starts] - 1  # group of each start
            first = np.searchsorted(of, np.arange(group.sum()))
            batch = np.arange(len(starts)) - first[of]
            last = np.diff(np.append(first, len(starts))) - 1
            at = units.iloc[starts]
            marks = pd.DataFrame({"key": at["key"], "part": at["part"], "at": at["at"], "batch_id": batch, "last_batch": last[of]})
            del rows, units, n, size, group, other, path, starts, of, first, batch, last, at
            yield marks

    return run


def _groups(batches) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    for rows in _whole_groups(batches):
        units, n, size, group, other = _units(rows)
        del rows
        edges = np.append(np.flatnonzero(group), len(units))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            forced = other[a:b].copy()
            forced[0] = False
            yield units.iloc[a:b], n[a:b], size[a:b], forced
        del units, n, size, group, other, forced


def _summarize(limits: Limits):
    def run(batches):
        for units, n, size, forced in _groups(batches):
            path = Path(n, size, forced, limits)
            head = min(path.m, limits.most) + 1
            closed, open_n, open_size = path.outcome(np.arange(head))
            answer = pd.DataFrame([(
                units["key"].iloc[0], int(units["part"].iloc[0]), units["version"].iloc[0], units["version"].iloc[-1], path.n[:head].tobytes(), path.size[:head].tobytes(), int(path.forced[1]),
                path.m, int(path.n[-1]), int(path.size[-1]), closed.tobytes(), open_n.tobytes(), open_size.tobytes(),
            )], columns=[c.split()[0] for c in SUMMARY.split(", ")])
            del units, n, size, forced, path
            yield answer

    return run


def _scan(limits: Limits):
    """(key, part, batch_id, n, size, version) at the start of each range, in order; part -1: the trace's last batch."""

    def run(batches):
        key, batch, n, size, version, out, begun = None, 0, 0, 0, None, [], False

        def last() -> tuple:
            return (key, -1, batch if n else batch - 1, 0, 0, None)

        for frame in batches:
            for r in frame.itertuples(index=False):
                if not begun or r.key != key:
                    if begun:
                        out.append(last())
                    key, batch, n, size, version, begun = r.key, 0, 0, 0, None, True
                out.append((key, r.part, batch, n, size, version))
                head = Path.__new__(Path)
                head.limits, head.m = limits, r.units
                head.n, head.size = np.frombuffer(r.heads_n, dtype=np.int64), np.frombuffer(r.heads_size, dtype=np.int64)
                short = len(head.n) - 1  # units whose sums are at hand: as many as a batch has at most
                head.m, head.forced = short, np.array([0, r.breaks if r.breaks <= short else short + 1])
                at = head.entry(n, size, r.first != version)
                if at > short:  # only if the range is shorter than a batch
                    n, size = n + r.n, size + r.size
                else:
                    was_open = n > 0
                    closed, open_n, open_size = (np.frombuffer(x, dtype=np.int64)[at] for x in (r.closed, r.open_n, r.open_size))
                    batch, n, size = batch + was_open + int(closed), int(open_n), int(open_size)
                version = r.last
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["key", "part", "batch_id", "n", "size", "version"])
                out = []
        if begun:
            out.append(last())
        yield pd.DataFrame(out, columns=["key", "part", "batch_id", "n", "size", "version"])

    return run


def _mark_ranges(limits: Limits):
    def run(batches):
        for units, n, size, forced in _groups(batches):
            path, one = Path(n, size, forced, limits), units.iloc[0]
            first = path.entry(int(one["open_n"]), int(one["open_size"]), one["version"] != one["open_version"])
            starts = path.starts(first) if first < path.m else np.empty(0, dtype=np.int64)
            batch = int(one["batch_id"]) + (one["open_n"] > 0) + np.arange(len(starts))
            if first > 0:  # up to the first start, records belong to the batch that came in open
                starts, batch = np.concatenate([[0], starts]), np.concatenate([[int(one["batch_id"])], batch])
            at = units.iloc[starts]
            marks = pd.DataFrame({"key": at["key"], "part": at["part"], "at": at["at"], "batch_id": batch, "last_batch": int(one["last_batch"])})
            del units, n, size, forced, path, one, starts, batch, at
            yield marks

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def quantile_cuts(rows: DataFrame, range_rows: int) -> DataFrame | None:
    """(key, cuts) of traces above ``range_rows`` records, or None; a record's range is the number of cuts below its place."""
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > range_rows), "large-traces")
    if large.isEmpty():
        return None
    most = min(MOST_RANGES, -(-large.agg(F.max("n")).first()[0] // range_rows))
    of = large.withColumn("ranges", F.least(F.lit(most), F.ceil(F.col("n") / range_rows)))
    points = F.percentile_approx("at", [i / most for i in range(1, most)], F.lit(100_000)) if most > 1 else F.array().cast("array<bigint>")
    joined = rows.join(_small(of.withColumnRenamed("key", "of")), F.col("key").eqNullSafe(F.col("of")))
    found = joined.groupBy("key").agg(points.alias("points"), F.max("ranges").alias("ranges"))
    step = F.transform(F.sequence(F.lit(1), F.col("ranges") - 1), lambda i: F.element_at("points", F.greatest(F.lit(1), F.floor(i * most / F.col("ranges"))).cast("int")))
    return written(found.select("key", F.array_sort(F.array_distinct(step)).alias("cuts")), "trace-cuts")


def cut_batches(
    df: DataFrame, limits: Limits, size: str = "bytes", version: str | None = None, key: str = "trace_id", order: str = "seq", range_rows: int = RANGE
) -> DataFrame:
    """``df`` with ``batch_id`` (from 0, by key) and ``last_batch`` (the key's last one), batches cut in the order of ``order``.

    A record whose version differs from that of the one before starts a batch. Records that share key and order are one
    unit: they stay together, though their batch then may exceed its limits. A null key is one key, a null place the first,
    a null size 0. Memory is that of one range; a key's hot trace is cut in as many tasks as it has ranges."""
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    text = F.col(version).cast("string") if version else F.lit("1")
    rows = df.select(F.col(key).cast("string").alias("key"), place.alias("at"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), F.coalesce(text, F.lit("")).alias("version"))
    rows = written(rows, "batch-units")
    cuts = quantile_cuts(rows, range_rows)
    frame = "key string, part int, at long, size long, version string"
    if cuts is None:
        parted = rows.select("key", F.lit(0).alias("part"), "at", "size", "version")
        marks = parted.repartition("key").sortWithinPartitions("key", "at", "version").mapInPandas(_mark_whole(limits), MARKS)
        wide = df.withColumn("__part", F.lit(0))
    else:
        cuts = _small(cuts.withColumnsRenamed({"key": "__of", "cuts": "__cuts"}))
        number = lambda at: F.coalesce(F.size(F.filter("__cuts", lambda c: c < at)), F.lit(0))
        parted = rows.join(cuts, F.col("key").eqNullSafe(F.col("__of")), "left").select("key", F.when(F.col("__cuts").isNotNull(), number(F.col("at"))).otherwise(0).alias("part"), "at", "size", "version", F.col("__cuts").isNotNull().alias("large"))
        whole = parted.filter("NOT large").drop("large").repartition("key").sortWithinPartitions("key", "at", "version").mapInPandas(_mark_whole(limits), MARKS)
        large = parted.filter("large").drop("large")
        summary = large.repartition("key", "part").sortWithinPartitions("key", "part", "at", "version").mapInPandas(_summarize(limits), SUMMARY)
        scanned = written(summary.repartition("key").sortWithinPartitions("key", "part").mapInPandas(_scan(limits), "key string, part int, batch_id long, n long, size long, version string"), "range-starts")
        ends = scanned.filter("part < 0").select(F.col("key").alias("of"), F.col("batch_id").alias("last_batch"))
        known = scanned.filter("part >= 0").join(ends, F.col("key").eqNullSafe(F.col("of")))
        known = known.select(F.col("key").alias("k"), F.col("part").alias("p"), "batch_id", F.col("n").alias("open_n"), F.col("size").alias("open_size"), F.coalesce("version", F.lit("")).alias("open_version"), "last_batch")
        large = large.join(_small(known), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))).drop("k", "p")
        marked = large.repartition("key", "part").sortWithinPartitions("key", "part", "at", "version").mapInPandas(_mark_ranges(limits), MARKS)
        marks = whole.unionByName(marked)
        wide = df.join(cuts, F.col(key).cast("string").eqNullSafe(F.col("__of")), "left").withColumn("__part", F.when(F.col("__cuts").isNotNull(), number(place)).otherwise(0)).drop("__cuts", "__of")
    marks = marks.select(F.col("key").cast(df.schema[key].dataType).alias(key), F.col("part").alias("__part"), F.col("at").alias("__at"), F.struct("batch_id", "last_batch").alias("__mark"))
    both = wide.drop("batch_id", "last_batch").withColumn("__at", place).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(key, "__part").orderBy("__at", F.col("__mark").isNull()).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("__of", F.last("__mark", ignorenulls=True).over(w)).filter("__mark IS NULL")
    return both.withColumns({"batch_id": F.col("__of.batch_id"), "last_batch": F.col("__of.last_batch")}).drop("__part", "__at", "__mark", "__of")
