"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how many copies of it the mix should hold. Rates are as near to 1 as they can be (in relative
entropy) while every source's words add up to its target and no rate is above the most. The solution is min(most,
exp(tilt * size)) with one tilt for each source, which Newton steps on the convex dual find, in logarithms and between
known bounds. Rates depend on source and size alone, so the steps run over a table of (source, size, documents), and only
the last step deals a class's whole copies to its documents. Everything is a DataFrame; sums that decide anything are
decimals, whose order of addition does not matter, so that reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

#: White space that parts words, as a class of characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (1, 2, 3), 3
#: Newton steps at most (bisection alone would need as many), relative error of a source's words, and passes that mend what rounding left.
STEPS, ERROR, MENDS = 60, 1e-9, 12
#: Documents of a class that one group deals copies to, and rows of a table that may be broadcast.
DEALT, SMALL = 256, 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(x: Column) -> Column:
    """A sum that is the same in any order; terms of about 1e28 fit."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counting finds it small; otherwise a shuffle join, in which AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= SMALL else df


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``place`` (from 0) in the order of columns that make rows distinct: sorted by ranges, each of which adds how
    many rows lie before it, so that no task sees all rows."""
    ranged = materialize(df.orderBy(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(counts.select("range", "before")), "range")
    return placed.withColumn("place", F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1 + F.col("before")).drop("range", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (known, source, source_size) with ``target``: shares by weight of all sizes; a source is full at ``most`` times
    its size, and what is left over goes to the others by weight until none is above. The driver sees a few totals a round."""
    placed = numbered(sources, F.col("known").desc(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(placed.select("known", "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-weights")
    total = rows.agg(F.sum(F.col("source_size").cast("decimal(38,0)")).alias("n")).first()["n"] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * level
        now = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("cap")).cast("decimal(38,0)")).alias("taken"), F.sum(F.when(~over, F.col("weight").cast("decimal(38,9)"))).alias("open")).first()
        if now["full"] == full or not now["open"]:
            break
        full, level = now["full"], float((total - (now["taken"] or 0)) / now["open"])
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).drop("cap", "weight")


def _rate(most: int) -> Column:
    """The tilted rate of a class; a source whose target is all it may take has every rate at the most."""
    return F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size"))))


def tilts(classes: DataFrame, sources: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """``sources`` with ``tilt``: min(most, exp(tilt * size)) times size, summed over a source's documents, is its target.

    In logarithms the sum is convex in the tilt where no rate is at the most, so Newton steps close in fast; bounds hold
    from the start (least size: at ln(most) / least all rates are at the most; at ln(target / size) / least, or 0, the sum
    is not above the target), and a step that leaves them, or a flat place, becomes a halving. Each step is one job over the
    classes, which returns a row for each source; the driver learns how many sources are not there yet."""
    least = classes.filter("size > 0").groupBy("known", "source").agg(F.min("size").alias("least"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    start = sources.join(_small(materialize(least, "mix-least")), ["known", "source"], "left").select(
        "known", "source", "source_size", "target",
        F.when(F.col("target") > 0, F.least(F.lit(0.0), ratio) / F.col("least")).alias("low"),
        F.when(F.col("target") > 0, F.lit(math.log(most)) / F.col("least")).alias("high"),
        F.when(F.col("target") >= F.col("source_size") * most, F.lit(math.log(most)) / F.col("least")).otherwise(0.0).alias("tilt"),
    )
    now = materialize(start.withColumn("done", (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * most)), "mix-tilts")
    for _ in range(steps):
        if now.filter("NOT done").isEmpty():
            break
        weight = F.col("n") * F.col("size") * _rate(most)
        open_ = F.exp(F.col("tilt") * F.col("size")) < most
        sums = classes.filter("size > 0").join(_small(now.filter("NOT done")), ["known", "source"]).groupBy("known", "source").agg(_exact(weight).alias("f"), _exact(F.when(open_, weight * F.col("size")).otherwise(0.0)).alias("slope"))
        after = now.join(_small(materialize(sums, "mix-sums")), ["known", "source"], "left")
        off = F.col("f") - F.col("target")
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        after = after.withColumns({"new_low": low, "new_high": high, "step": F.col("tilt") + F.log(F.col("target") / F.nullif(F.col("f"), F.lit(0.0))) * F.col("f") / F.nullif(F.col("slope"), F.lit(0.0))})
        inside = (F.col("step") > F.col("new_low")) & (F.col("step") < F.col("new_high"))
        found = F.abs(off) <= F.col("target") * ERROR
        tilt = F.when(F.col("done") | found, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), F.col("step")).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        after = after.select("known", "source", "source_size", "target", *(F.when(F.col("done"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in ("low", "high")), tilt.alias("tilt"), (F.col("done") | found).alias("done"))
        after = materialize(after, "mix-tilts")
        discard(now)
        now = after
    return now.select("known", "source", "source_size", "target", "tilt")


def _mended(rounded: DataFrame, most: int) -> DataFrame:
    """Whole copies of each class so that a source's words are its target but for less than fits: again and again the class
    of the largest size that fits into what is missing (or too much) takes (or gives) as many copies as it can."""
    for _ in range(MENDS):
        left = rounded.groupBy("known", "source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies")).cast("double")).alias("left"))
        left = materialize(left, "mix-left")
        each = rounded.filter("size > 0").join(_small(left), ["known", "source"])
        room = F.when(F.col("left") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = F.least(room, F.floor(F.abs("left") / F.col("size")))
        best = each.select("known", "source", "size", (fits * F.signum("left")).cast("long").alias("change")).filter("change != 0")
        best = materialize(best.groupBy("known", "source").agg(F.max(F.struct("size", "change")).alias("best")).select("known", "source", "best.size", "best.change"), "mix-best")
        if best.isEmpty():
            break
        after = rounded.join(_small(best), ["known", "source", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
        after = materialize(after, "mix-rounded")
        discard(rounded)
        rounded = after
    return rounded


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rate, copies) for each row of ``documents`` (doc_id, text, source).

    size: words of the text, 0 for null and for white space only; a null source is a source of its own, the last; sources
    without words have target 0; documents without words are taken once and add nothing; rates are those of the balance,
    copies whole numbers whose words are ``taken``. A source's words miss its target by less than its least document that
    still has room. Of documents with equal source and size, hashes of their ids decide which get a copy more, then the
    ids, so reruns agree; rows that are equal in all of these are interchangeable. Null ids are kept; an empty table gives
    an empty result; other columns are not read. Texts are read once and never shuffled; a class of many equal sizes is
    dealt out in groups of about DEALT documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("of"), words(F.col("text").cast("string")).alias("size"))
    rows = rows.select("doc_id", F.col("of").isNotNull().alias("known"), F.coalesce("of", F.lit("")).alias("source"), "size", F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256).alias("h"))
    docs = materialize(rows, "mix-sizes")
    classes = materialize(docs.groupBy("known", "source", "size").agg(F.count("*").alias("n")), "mix-classes")
    sources = classes.groupBy("known", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tilted = tilts(classes, targets(sources, weights, most), most)

    rated = classes.join(_small(tilted), ["known", "source"]).withColumn("rate", _rate(most))
    # copies of a class: what the rounded running sum of a source's copies, from the largest size down, grows by
    w = W.partitionBy("known", "source").orderBy(F.desc("size"))
    run = F.sum(F.col("n") * F.col("rate")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rated = rated.withColumn("run", F.when(F.col("size") > 0, F.round(run)).otherwise(0.0))
    grown = F.when(F.col("size") == 0, F.col("n")).otherwise((F.col("run") - F.coalesce(F.lag("run").over(w), F.lit(0.0))).cast("long"))
    rounded = rated.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * most, grown)))
    rounded = _mended(materialize(rounded.drop("run", "tilt"), "mix-rounded"), most)

    largest = rounded.agg(F.max("n").alias("n")).first()["n"] or 0
    group = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % max(1, math.ceil(largest / DEALT))).alias("g")
    key = ["known", "source", "size"]
    groups = docs.groupBy(*key, group).agg(F.count("*").alias("in_group"))
    groups = groups.join(_small(rounded), key)
    # a class's extra copies are spread over its groups in proportion, by whole parts of the running count
    upto = F.sum(F.col("in_group").cast("decimal(20,0)")).over(W.partitionBy(*key).orderBy("g").rowsBetween(W.unboundedPreceding, 0))
    groups = groups.withColumns({"upto": upto, "over": (F.col("copies") % F.col("n")).cast("decimal(18,0)")})
    groups = groups.withColumn("extra", F.expr("(over * upto) div n - (over * (upto - in_group)) div n"))
    groups = materialize(groups.select(*key, "g", "source_size", "target", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), "extra"), "mix-groups")
    dealt = docs.withColumn("g", group).join(groups, [*key, "g"])
    place = F.row_number().over(W.partitionBy(*key, "g").orderBy("h", "doc_id"))
    dealt = dealt.withColumn("copies", F.col("each") + (place <= F.col("extra")).cast("long"))
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
