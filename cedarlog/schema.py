"""Record schemas, levels and the typed configuration with its four-level resolution."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = "trace_id string, seq bigint, method_key string, content string, level string, ts_ms bigint, thread_name string, logger_name string, throwable string, mdc map<string,string>"
CONTEXT = "trace_id string, method_key string, mode string, min_level string, close_seq bigint, depth int, enabled boolean"
AGGREGATED = "trace_id string, batch_id bigint, flush_id string, content string, entry_count int, total_bytes bigint, max_level string, first_time timestamp, last_time timestamp, final_flush boolean"
DEGRADED = "trace_id string, method_key string, reason string, storage string, ts_ms bigint, level string, content string"

#: Ranks of the level names.
RANKS = {"FATAL": 5, "ERROR": 4, "WARN": 3, "INFO": 2, "DEBUG": 1, "TRACE": 0}


def level_rank(level: Column) -> Column:
    """Rank of a record's level, any case; unknown and null are 0."""
    name = F.upper(level)
    out = F.lit(0)
    for k, v in RANKS.items():
        if v:
            out = F.when(name == k, v).otherwise(out)
    return out


def config_rank(level: str | None) -> int:
    """Rank of a configured level, which is trimmed and may be WARNING."""
    name = (level or "").strip().upper()
    return RANKS.get("WARN" if name == "WARNING" else name, 0)


def high_priority(level: Column) -> Column:
    return level_rank(level) >= 3


CHOICES = {
    "mode": ("AUTO", "SINGLE", "AGGREGATE"),
    "sampling_strategy": ("RATE", "COUNT", "ADAPTIVE"),
    "total_limit_policy": ("STOP_COLLECTING", "DOWNGRADE_LEVEL", "SAMPLE"),
    "degrade_storage": ("FILE", "LIMITED_MEMORY", "DISCARD_NON_ERROR", "DISCARD_ALL"),
    "overflow": ("FLUSH_EARLY", "DROP_OLDEST", "DROP_NEWEST"),
}
MIB = 1 << 20


@dataclass(frozen=True)
class Config:
    """Settings of a collected method; the defaults are fixed values."""

    enabled: bool = True
    level: str = "INFO"
    exclude_loggers: tuple[str, ...] = ()
    mode: str = "AUTO"
    pipeline: bool = True
    pattern: str = ""
    separator: str = "\n"
    max_buffer_size: int = 100
    max_buffer_bytes: int = MIB
    overflow: str = "FLUSH_EARLY"
    global_soft_bytes: int = 100 * MIB
    sanitize: bool = True
    mask: bool = True
    max_total: int = 100_000
    max_total_bytes: int = 50 * MIB
    total_limit_policy: str = "STOP_COLLECTING"
    sampling_rate: float = 1.0
    sampling_strategy: str = "RATE"
    degrade_storage: str = "FILE"
    block_when_degrade_fails: bool = False
    max_nesting_depth: int = 10
    breaker_enabled: bool = True
    breaker_samples: int = 5
    breaker_rate: float = 0.6
    breaker_interval_ms: int = 30_000
    breaker_most_interval_ms: int = 300_000
    breaker_half_open: int = 3
    breaker_successes: int = 3
    breaker_window_s: int = 10
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        found = []
        if self.max_buffer_size <= 0:
            found.append("max_buffer_size is not positive; 1 is used")
        if self.max_buffer_bytes and self.max_buffer_bytes > self.global_soft_bytes > 0:
            found.append("max_buffer_bytes is above the global limit")
        if not 0 <= self.sampling_rate <= 1:
            found.append("sampling_rate is outside 0 to 1 and is clamped")
        if self.pipeline and (self.sampling_rate < 1 or self.total_limit_policy != "STOP_COLLECTING" or self.overflow != "FLUSH_EARLY" or self.separator != "\n"):
            found.append("sampling, limit policy, overflow and separator have no effect in pipeline mode")
        object.__setattr__(self, "warnings", tuple(found))


#: Keys that only count globally; at method level they are dropped.
GLOBAL_ONLY = ("global_", "breaker_window", "max_nesting")


def _typed(name: str, value: str, default: object) -> object:
    """The typed value, or None where a lower level's stays. Booleans: anything but true is false."""
    if isinstance(default, bool):
        return value.strip().lower() == "true" if value is not None else None
    try:
        if isinstance(default, int):
            return int(value)
        if isinstance(default, float):
            return float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(default, tuple):
        return tuple(x.strip() for x in value.split(",") if x.strip()) or None
    if name in CHOICES:
        up = value.strip().upper()
        return up if up in CHOICES[name] else None
    return value


def resolve(method: str, declared: Config, sources: Iterable[Mapping]) -> Config:
    """defaults < declared (where it differs from the defaults) < global < method. Of one scope, the source of least order
    wins. sources: {order, available, properties: [{scope: global or method, method_key, key, value}]}."""
    base = Config()
    out = {f.name: getattr(declared, f.name) for f in fields(Config) if f.name != "warnings" and getattr(declared, f.name) != getattr(base, f.name)}
    usable = sorted((s for s in sources if s.get("available", True)), key=lambda s: -s["order"])
    for scope in ("global", "method"):
        for source in usable:
            for p in source["properties"]:
                if p["scope"] != scope or (scope == "method" and (p["method_key"] != method or p["key"].startswith(GLOBAL_ONLY))):
                    continue
                if p["key"] in base.__dataclass_fields__ and p["key"] != "warnings" and (v := _typed(p["key"], p["value"], getattr(base, p["key"]))) is not None:
                    out[p["key"]] = v
    return replace(base, **out)


def resolve_mode(configured: Column, preferred: Column) -> Column:
    """A configured mode, unless AUTO, goes before what the sink prefers; the last resort is AGGREGATE."""
    return F.coalesce(F.nullif(configured, F.lit("AUTO")), F.nullif(preferred, F.lit("AUTO")), F.lit("AGGREGATE"))


def winning_properties(properties):
    """The value that wins for each (method_key, key) of a table (source_order, scope, method_key, key, value), as an aggregate.

    Global values are one map (of as many entries as there are keys), looked up by a scalar subquery for each method."""
    own = properties.filter(~((F.col("scope") == "method") & F.col("key").rlike("^(" + "|".join(GLOBAL_ONLY) + ")")))
    best = F.max_by("value", F.struct(-F.col("source_order"), F.col("value"))).alias("value")
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    whole = own.filter("scope = 'global'").groupBy("key").agg(best).agg(entries.alias("m")).scalar()
    each = own.filter("scope = 'method'").groupBy("method_key", "key").agg(best).groupBy("method_key").agg(entries.alias("own"))
    each = each.withColumn("whole", F.coalesce(whole, F.create_map().cast("map<string,string>")))
    rest = F.map_filter("whole", lambda k, _: ~F.array_contains(F.map_keys("own"), k))
    return each.select("method_key", F.explode(F.map_concat("own", rest)).alias("key", "value"))
