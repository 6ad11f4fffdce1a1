"""Log files back into records: lines are put together over file splits, and a layout's inverse parses them.

A record may have several lines (a stack trace belongs to the line above). Splits of a file are read by different tasks, so a
split's first lines may belong to a record that began in an earlier one. Every line learns its record inside its split from
the lines that begin one; a table of splits, a row each, then says which record was open when a split began.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.layout import DEFAULT_DATE, DEFAULT_PATTERN, TOKEN

#: How a sample run reports a scenario, and what stands for one that went well.
VALIDATION = r"^场景校验: (.+), expected=([^,]+), collected=(\d+), discarded=(\d+), flushCount=(\d+), status=(PASS|FAIL)$"
LEVELS = "FATAL|ERROR|WARN|INFO|DEBUG|TRACE"
DATE_PARTS = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "SSS": r"\d{3}"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, n, value): n is increasing inside a split, in the order of the file."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")


def whole_records(lines: DataFrame, begins: Column) -> DataFrame:
    """(file, split, record, value): lines of a record joined by line feeds; ``begins``: whether a line begins one.

    split and record are those of the record's first line. Lines before a file's first record are one record, 0. A record's
    lines come together in one row, whatever splits they lie in; a file's splits are sorted one by one, and only a row for
    each is looked at in the file's order."""
    inside = W.partitionBy("file", "split").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    numbered = lines.withColumn("record", F.sum(F.when(F.coalesce(begins, F.lit(False)), 1).otherwise(0)).over(inside))
    splits = lines.groupBy("file", "split").agg(F.count_if(begins).alias("records"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("records") > 0, F.struct(F.col("split").alias("of"), F.col("records").alias("record"))), ignorenulls=True).over(before)
    splits = splits.select("file", "split", F.coalesce(open_, F.struct(F.lit(-1).cast("long").alias("of"), F.lit(0).cast("long").alias("record"))).alias("open"))
    owned = numbered.join(splits, ["file", "split"]).select(
        "file", "split", "n", "value",
        F.when(F.col("record") > 0, F.col("split")).otherwise(F.col("open.of")).alias("of"), F.when(F.col("record") > 0, F.col("record")).otherwise(F.col("open.record")).alias("record"),
    )
    parts = F.sort_array(F.collect_list(F.struct("split", "n", "value")))
    return owned.groupBy("file", F.col("of").alias("split"), "record").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n", "").alias("value"))


def _date(fmt: str) -> str:
    out, at = "", 0
    for m in re.finditer("yyyy|MM|dd|HH|mm|ss|SSS|'([^']*)'", fmt):
        out += re.escape(fmt[at : m.start()]) + (re.escape(m[1]) if m[1] is not None else DATE_PARTS[m[0]])
        at = m.end()
    return out + re.escape(fmt[at:])


def inverse(pattern: str) -> tuple[str, list[tuple[str, str | None]]]:
    """(regular expression of a whole record, (conversion, argument) of each group). The message may be of any length and have
    several lines; a throwable is what follows it from a new line on; other fields keep to their line."""
    out, groups, at = "^", [], 0
    tokens = list(TOKEN.finditer(pattern))
    while tokens and tokens[-1][4] == "n" and tokens[-1].end() == len(pattern):
        pattern, tokens = pattern[: tokens[-1].start()], tokens[:-1]
    for m in tokens:
        out += re.escape(pattern[at : m.start()])
        at, name, pad = m.end(), m[4], r"\s*"
        if name == "n":
            out += "\n"
            continue
        body = {"d": _date(m[5] or DEFAULT_DATE), "p": LEVELS, "level": LEVELS, "m": r"(?s:.*?)", "msg": r"(?s:.*?)", "ex": r"(?:\n(?s:.*))?", "throwable": r"(?:\n(?s:.*))?", "wEx": r"(?:\n(?s:.*))?", "X": r"\{[^{}\n]*\}|" if not m[5] else r"[^\n]*?"}.get(name, r"[^\n]*?")
        before, after = ("", "") if not m[2] else ("", " *") if m[1] else (" *", "")
        out += f"{before}({body}){after}"
        groups.append((name, m[5]))
    return out + re.escape(pattern[at:]) + r"\s*$", groups


def parse(records: DataFrame, pattern: str = DEFAULT_PATTERN, value: str = "value") -> DataFrame:
    """``records`` with the fields that ``pattern`` shows (ts_ms, level, thread_name, logger_name, content, throwable, mdc) and
    ``parsed``: whether the record has the pattern's form; else its fields are null, and its text stays in ``value``.

    A field is as the layout showed it: abbreviated names stay abbreviated. Of several conversions of one field the first counts."""
    expression, groups = inverse(pattern)
    matches = F.col(value).rlike(expression)
    out = {"parsed": F.coalesce(matches, F.lit(False))}
    pairs: Column = F.create_map().cast("map<string,string>")
    single: dict[str, Column] = {}
    for i, (name, arg) in enumerate(groups, 1):
        got = F.when(matches, F.regexp_extract(value, expression, i))
        if name == "d":
            out.setdefault("ts_ms", F.unix_millis(F.try_to_timestamp(got, F.lit(arg or DEFAULT_DATE))))
        elif name in ("ex", "throwable", "wEx"):
            out.setdefault("throwable", F.when(F.length(got) > 0, F.substring(got, 2, 1 << 30)))
        elif name == "X" and arg:
            single[arg] = F.nullif(got, F.lit(""))
        elif name == "X":
            inner = F.nullif(F.regexp_extract(got, r"^\{(.*)\}$", 1), F.lit(""))
            pairs = F.coalesce(F.str_to_map(inner, F.lit(", "), F.lit("=")), pairs)
        else:
            field = {"p": "level", "level": "level", "t": "thread_name", "thread": "thread_name", "m": "content", "msg": "content"}.get(name, "logger_name")
            out.setdefault(field, got)
    if single:
        named = F.map_from_arrays(F.array(*(F.lit(k) for k in single)), F.array(*single.values()))
        pairs = F.map_concat(pairs, F.map_filter(named, lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(pairs), k)))
    if any(name == "X" for name, _ in groups):
        out["mdc"] = F.when(F.size(pairs) > 0, pairs)
    return records.withColumns(out)


def begins_record(pattern: str = DEFAULT_PATTERN, value: str = "value") -> Column:
    """Whether a line begins with what the pattern shows up to its message."""
    first = next((m.start() for m in TOKEN.finditer(pattern) if m[4] in ("m", "msg")), len(pattern))
    return F.col(value).rlike(inverse(pattern[:first])[0].removesuffix(r"\s*$"))


def read_log_files(spark: SparkSession, path: str, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """Records of the log files under ``path``: (file, split, record, value) and the fields of ``parse``."""
    return parse(whole_records(read_lines(spark, path), begins_record(pattern)), pattern)


def validations(lines: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """How many lines report the check of a scenario, and how many of these say that it failed."""
    line = F.trim(F.col(value))
    status = F.regexp_extract(line, VALIDATION, 6)
    return lines.groupBy(*(by or [])).agg(F.count_if(line.rlike(VALIDATION)).alias("validations"), F.count_if(status == "FAIL").alias("failures"))
