"""A layout language for log lines: a pattern is compiled once, on the driver, into one Column expression."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PATTERN = "%d{yyyy-MM-dd HH:mm:ss.SSS} %-5p [%t] %c{1} - %m%n"
DEFAULT_DATE = "yyyy-MM-dd HH:mm:ss.SSS"
MOST_PATTERN = 1024
# Names of the conversions.
NAMES = ("loggerFull", "throwable", "logger", "thread", "level", "wEx", "msg", "ex", "d", "p", "t", "m", "c", "C", "X", "n")
TOKEN = re.compile(r"%(-?)(\d+)?(?:\.(\d+))?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")(?:\{([^}]*)\})?")
DATE = re.compile(r"^(?:'[^']*'|[yMdHhmsSaEDkK]|[^A-Za-z'])*$")


def _abbreviated(name: Column, most: int) -> Column:
    """Leading segments are cut to one character, left to right, until the whole fits; the last one never is."""
    if most <= 0:
        return name
    kept = F.filter(F.split(name, r"\."), lambda x, i: (x != "") | (i == 0))
    start = F.struct(F.length(name).alias("size"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, seg: Column) -> Column:
        last = F.size(a["out"]) == F.size(kept) - 1
        cut = F.when((a["size"] > most) & ~last, F.substring(seg, 1, 1)).otherwise(seg)
        return F.struct((a["size"] - F.length(seg) + F.length(cut)).alias("size"), F.array_append(a["out"], cut).alias("out"))

    return F.when(F.length(name) <= most, name).otherwise(F.aggregate(kept, start, step, lambda a: F.array_join(a["out"], ".")))


def _sized(c: Column, left: bool, least: int | None, most: int | None) -> Column:
    """Too long: the rightmost characters stay; too short: padded; padding never cuts."""
    if most is not None:
        c = F.when(F.length(c) > most, F.right(c, F.lit(most))).otherwise(c)
    if least is not None:
        c = F.when(F.length(c) < least, (F.rpad if left else F.lpad)(c, least, " ")).otherwise(c)
    return c


def _token(name: str, arg: str | None) -> Column:
    if name == "d":
        stamp = F.timestamp_millis("ts_ms")
        fmt = arg or DEFAULT_DATE
        return F.date_format(stamp, fmt) if DATE.match(fmt) else F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    if name in ("c", "logger"):
        return _abbreviated(F.col("logger_name"), int(arg) if arg and arg.lstrip("-").isdigit() else 0)
    if name in ("ex", "throwable", "wEx"):
        return F.when(F.length("throwable") > 0, F.concat(F.lit("\n"), "throwable"))
    if name == "X":
        if arg:
            return F.element_at("mdc", arg)
        pairs = F.transform(F.map_entries("mdc"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
        return F.when(F.size("mdc") > 0, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
    if name == "n":
        return F.lit("\n")
    return F.col({"p": "level", "level": "level", "t": "thread_name", "thread": "thread_name", "m": "content", "msg": "content", "C": "logger_name", "loggerFull": "logger_name"}[name])


def compile_layout(pattern: str = DEFAULT_PATTERN) -> Column:
    """The line that ``pattern`` gives a record; nulls are empty; text that is no conversion stays."""
    parts, at = [], 0
    for m in TOKEN.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        value = F.coalesce(_token(m[4], m[5]).cast("string"), F.lit(""))
        parts.append(_sized(value, bool(m[1]), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None))
        at = m.end()
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


WRAPPERS = r"%(?:clr|highlight|style|boldRed|boldGreen|boldYellow|boldBlue|red|green|yellow|blue|magenta|cyan|gray|white|black)"


def _unwrapped(pattern: str) -> str:
    """Colour and style wrappers, which may be nested, without the wrapper and its argument."""
    while m := re.search(WRAPPERS + r"([({])", pattern):
        opening, closing = m[1], ")" if m[1] == "(" else "}"
        depth, at = 1, m.end()
        while at < len(pattern) and depth:
            depth += (pattern[at] == opening) - (pattern[at] == closing)
            at += 1
        inner = pattern[m.end() : at - (depth == 0)]
        rest = re.sub(r"^\{[^}]*\}", "", pattern[at:])
        pattern = pattern[: m.start()] + inner + rest
    return pattern


def clean_pattern(pattern: str) -> str:
    """A console pattern without placeholders, colours and process id: ${name:-default} gives its default."""
    while m := re.search(r"\$\{[^${}]*\}", pattern):
        pattern = pattern[: m.start()] + (m[0][2:-1].split(":-", 1)[1] if ":-" in m[0] else "") + pattern[m.end() :]
    pattern = re.sub(r"%(?:-?\d+(?:\.\d+)?)?(?:pid|processId)\b", "", _unwrapped(pattern))
    return re.sub(r" {2,}", " ", pattern.replace(" --- ", " ")).strip()


def validate_pattern(pattern: str) -> str:
    """The pattern, if it is short enough and all conversions are known."""
    if len(pattern) > MOST_PATTERN:
        raise ValueError("the pattern is too long")
    unknown = re.sub(r"%%", "", TOKEN.sub("", pattern))
    if m := re.search(r"%-?\d*(?:\.\d+)?([A-Za-z]+)", unknown):
        raise ValueError(f"unknown conversion %{m[1]}")
    return pattern


def detect_pattern(detectors: list[tuple[int, Callable[[], str | None]]], fallback: str = DEFAULT_PATTERN) -> str:
    """The first pattern, by order, that survives cleaning and validation and shows the message; else ``fallback``."""
    for _, find in sorted(detectors, key=lambda d: d[0]):
        if (found := find()) is None:
            continue
        try:
            cleaned = validate_pattern(clean_pattern(found))
        except ValueError:
            continue
        if re.search(r"%m", cleaned):
            return cleaned
    return fallback


