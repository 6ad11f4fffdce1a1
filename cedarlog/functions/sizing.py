"""Byte estimates of records and other scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf16_units


def _align8(n: Column) -> Column:
    return (F.shiftright(n + 7, 3) * 8).cast("long")


def string_bytes(c: Column) -> Column:
    """A string object: 56 and its UTF-16 bytes, aligned; null is 0."""
    return F.coalesce(56 + _align8(2 * utf16_units(c)), F.lit(0)).cast("long")


def _sum(parts) -> Column:
    parts = list(parts)
    return sum(parts[1:], parts[0])


def _mdc(mdc: Column, head: int, each: int, size) -> Column:
    total = F.aggregate(F.map_entries(mdc), F.lit(head).cast("long"), lambda a, e: a + F.lit(each) + size(e["key"]) + size(e["value"]))
    return F.coalesce(F.when(F.size(mdc) > 0, total), F.lit(0)).cast("long")


FIELDS = ("trace_id", "content", "level", "thread_name", "logger_name", "throwable")


def entry_bytes(factor: float = 1.0, fields=FIELDS) -> Column:
    """A buffered single record: 112, its strings, and 208 and 48 a pair for its MDC."""
    total = F.lit(112) + _sum(string_bytes(F.col(f)) for f in fields) + _mdc(F.col("mdc"), 208, 48, string_bytes)
    return (total if factor == 1 else F.floor(total * factor)).cast("long")


def processed_bytes(fields=FIELDS) -> Column:
    """A secured record against the total limit: 112, 48 + 2 a unit for each string, 64 and 32 a pair for the MDC."""
    plain = lambda c: F.coalesce(48 + 2 * utf16_units(c), F.lit(0)).cast("long")
    units = lambda c: F.coalesce(2 * utf16_units(c), F.lit(0)).cast("long")
    return (F.lit(112) + _sum(plain(F.col(f)) for f in fields) + _mdc(F.col("mdc"), 64, 32, units)).cast("long")


def aggregate_bytes() -> Column:
    """What a record takes from the quota in the pipeline: 64, message and throwable."""
    return (F.lit(64) + string_bytes(F.col("content")) + string_bytes(F.col("throwable"))).cast("long")


def line_bytes(line: Column) -> Column:
    """What a formatted line adds to the pipeline's batch: two bytes a unit."""
    return (2 * utf16_units(line)).cast("long")


def segment_bytes(line: Column) -> Column:
    """What a formatted line adds to a legacy batch."""
    return (F.lit(64) + string_bytes(line)).cast("long")


UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}


def parse_size(c: Column) -> Column:
    """A number of bytes, or a number with B, KB, MB, GB or TB (1024 each), truncated; else null."""
    number = F.regexp_extract(c, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:B|KB|MB|GB|TB)\s*$", 1)
    unit = F.upper(F.regexp_extract(c, r"(?i)(B|KB|MB|GB|TB)\s*$", 1))
    scale = F.lit(None).cast("double")
    for k, v in UNITS.items():
        scale = F.when(unit == k, float(1024**v)).otherwise(scale)
    return F.when(c.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(c).cast("long")).when(number != "", (number.cast("double") * scale).cast("long"))


def format_size(c: Column, space: str = " ", negative: str | None = None) -> Column:
    """N B, %.1f KB, %.1f MB or %.2f GB."""
    n = c.cast("double")
    out = (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(f"{space}B")))
        .when(c < 1024**2, F.format_string(f"%.1f{space}KB", n / 1024))
        .when(c < 1024**3, F.format_string(f"%.1f{space}MB", n / 1024**2))
        .otherwise(F.format_string(f"%.2f{space}GB", n / 1024**3))
    )
    return out if negative is None else F.when(c < 0, negative).otherwise(out)


def format_quota(c: Column) -> Column:
    return format_size(c, space="", negative="unknown")


def method_display(cls: Column, method: Column) -> Column:
    return F.concat(cls, F.lit("#"), method)


def method_config_key(display: Column) -> Column:
    """a.b.C#m to a_b_C_m."""
    return F.translate(display, ".#", "__")


def method_normalised(key: Column) -> Column:
    """A key as it may be configured, trimmed, in the display form: one without # is a configured one, whose last _ stands for
    the # and the others for dots."""
    trimmed, form = F.trim(key), r"^(.*\S.*)_([^_]*[^_\s][^_]*)$"
    shown = F.concat(F.translate(F.regexp_extract(trimmed, form, 1), "_", "."), F.lit("#"), F.regexp_extract(trimmed, form, 2))
    return F.when(trimmed.contains("#") | ~trimmed.rlike(form), trimmed).otherwise(shown)


def method_tag(display: Column) -> Column:
    """Without the package: what follows the last dot before #."""
    return F.regexp_replace(display, r"^[^#]*\.(?=[^.#]*#)", "")


#: Reasons that are counted under one name.
REASONS = {
    "filtered": ("level_filter", "logger_filter", "handler_filter", "ignored"),
    "backpressure": ("backpressure_pause", "backpressure_skip_low_level"),
}


def reason_tag(reason: Column) -> Column:
    out = reason
    for name, own in REASONS.items():
        out = F.when(reason.isin(*own), name).otherwise(out)
    return out


def ring_capacity(n: Column) -> Column:
    """The least power of two that is at least max(2, n)."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")))).cast("long")


def bucket_percent(ns: Column) -> Column:
    """Allowed slowdown by a benchmark's time."""
    return F.when(ns < 100, 100).when(ns < 1000, 25).when(ns < 10000, 10).otherwise(5)
