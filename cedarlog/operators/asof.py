"""Configuration as of the event: a history of changes, and the settings that were in force when a record was written.

Changes of one scope become versions, intervals in which nothing changes, with one column for each key that is asked for.
Intervals and records meet in buckets of time: a version is listed in each bucket that it reaches into, a record has one, so
that the join is by equality of method and bucket, whatever the number of records of a method.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CHOICES, GLOBAL_ONLY, Config

#: A change of a property: when, of which source (a lower order wins), for all methods (scope global) or one; null takes it back.
HISTORY = "from_ms bigint, version bigint, source_order int, scope string, method_key string, key string, value string"
#: Rows of a table of versions up to which it is broadcast.
SMALL = 200_000


def typed_value(key: str, value: Column) -> Column:
    """A configured value as it counts, or null where it is none and what is below stays. Keys that are no setting are taken as text."""
    default = Config.__dataclass_fields__[key].default if key in Config.__dataclass_fields__ else ""
    text = F.trim(value)
    if isinstance(default, bool):
        return F.when(value.isNotNull(), (F.lower(text) == "true").cast("string"))
    if isinstance(default, int):
        return F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text)
    if isinstance(default, float):
        return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text)
    if key in CHOICES:
        return F.when(F.upper(text).isin(*CHOICES[key]), F.upper(text))
    if isinstance(default, tuple):
        return F.when(F.length(F.regexp_replace(text, r"[,\s]", "")) > 0, text)
    return value


def versions(changes: DataFrame, keys: Sequence[str], orders: Sequence[int]) -> DataFrame:
    """(scope, method_key, from_ms, to_ms, a column for each key) of ``changes`` (HISTORY): what holds from each change to the next.

    Of a key's sources the one of least order that has a valid value wins; of changes at one time the one of the highest
    version. Keys that only count globally are left out for methods; a change without a time, or for a method that is
    null, counts for nobody. ``orders``: the sources' orders, which a deployment has a handful of. The history of one
    method, or the global one, is one task's: it holds changes, not records."""
    own = changes.filter("from_ms IS NOT NULL AND (scope = 'global' OR method_key IS NOT NULL)").filter(F.col("key").isin(*keys))
    own = own.filter(~((F.col("scope") == "method") & F.col("key").rlike("^(" + "|".join(GLOBAL_ONLY) + ")")))
    own = own.withColumn("method_key", F.when(F.col("scope") == "method", F.col("method_key")).otherwise(""))
    own = own.groupBy("scope", "method_key", "source_order", "key", "from_ms").agg(F.max_by("value", F.struct("version")).alias("value"))
    w = W.partitionBy("scope", "method_key").orderBy("from_ms").rangeBetween(W.unboundedPreceding, 0)
    held = {}
    for key in keys:
        latest = [F.last(F.when((F.col("key") == key) & (F.col("source_order") == o), F.struct(typed_value(key, F.col("value")).alias("value"))), ignorenulls=True).over(w)["value"] for o in sorted(orders)]
        held[f"__{key}"] = F.coalesce(*latest, F.lit(None).cast("string"))
    each = own.withColumns(held).select("scope", "method_key", "from_ms", *(F.col(f"__{k}").alias(k) for k in keys)).distinct()
    to = F.lead("from_ms").over(W.partitionBy("scope", "method_key").orderBy("from_ms"))
    return each.withColumn("to_ms", to)


def _in_buckets(one: DataFrame, width_ms: int, first: int, last: int) -> DataFrame:
    """Versions listed in each bucket between ``first`` and ``last`` that they reach into."""
    low, high = F.floor(F.col("from_ms") / width_ms), F.coalesce(F.floor((F.col("to_ms") - 1) / width_ms), F.lit(last))
    low, high = F.greatest(low, F.lit(first)), F.least(high, F.lit(last))
    return one.withColumn("__bucket", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))


def _as_of(events: DataFrame, one: DataFrame, on: str | None, keys: Sequence[str], prefix: str) -> DataFrame:
    small = F.broadcast(one) if one.count() <= SMALL else one
    small = small.select(F.col("method_key").alias("__m"), F.col("__bucket").alias("__b"), F.col("from_ms").alias("__from"), F.col("to_ms").alias("__to"), *(F.col(k).alias(f"{prefix}{k}") for k in keys))
    at = F.col("__at")
    condition = (F.col("__bucket") == F.col("__b")) & (at >= F.col("__from")) & (F.col("__to").isNull() | (at < F.col("__to")))
    if on:
        condition = condition & (F.col(on) == F.col("__m"))
    return events.join(small, condition, "left").drop("__m", "__b", "__from", "__to")


def configured(
    events: DataFrame, changes: DataFrame, keys: Sequence[str], orders: Sequence[int], defaults: dict[str, str | None] | None = None, at: str = "ts_ms", method: str = "method_key", width_ms: int = 3_600_000, span: tuple[int, int] | None = None
) -> DataFrame:
    """``events`` with a column ``cfg_<key>`` for each key: the method's value as of the event, else the global one, else the default.

    A change holds from its time on, that time included. Events without a time or method get global values, or defaults. Each event
    is returned once. ``span``: least and greatest time of the events, looked up if it is not given; ``width_ms``: of a
    bucket; the join compares a record with the versions of its method that reach into its bucket."""
    settings = {f: None if isinstance(d.default, tuple) else str(d.default).lower() if isinstance(d.default, bool) else str(d.default) for f, d in Config.__dataclass_fields__.items()} | (defaults or {})
    if span is None:
        found = events.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
        span = (found["a"], found["b"])
    known = versions(changes, keys, orders)
    if span[0] is None:
        return events.withColumns({f"cfg_{k}": F.lit(settings.get(k)) for k in keys})
    listed = _in_buckets(known, width_ms, span[0] // width_ms, span[1] // width_ms)
    out = events.withColumns({"__at": F.col(at), "__bucket": F.floor(F.col(at) / width_ms)})
    out = _as_of(out, listed.filter("scope = 'method'"), method, keys, "__m_")
    out = _as_of(out, listed.filter("scope = 'global'"), None, keys, "__g_")
    return out.withColumns({f"cfg_{k}": F.coalesce(f"__m_{k}", f"__g_{k}", F.lit(settings.get(k))) for k in keys}).drop("__at", "__bucket", *(f"__{s}_{k}" for k in keys for s in "mg"))


def refreshing(history: Callable[[], DataFrame], keys: Sequence[str], orders: Sequence[int], then: Callable[[DataFrame, int], None], **options):
    """For writeStream.foreachBatch: reads the history anew for every micro-batch, so that a change that has come in counts from
    its time on, also for late events, without a restart; ``then`` gets the batch with its settings."""

    def run(batch: DataFrame, batch_id: int) -> None:
        then(configured(batch, history(), keys, orders, **options), batch_id)

    return run
