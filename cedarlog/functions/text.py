"""Sanitizing against log injection and masking of personal data, as Column expressions."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what is removed, replaced or masked.
ANSI = r"\x1B\[[0-9;]*[A-Za-z]"
HTML = r"(?is)<script.*?</script>|<[^>]*>"
CONTROL = r"[\x00-\x1F\x7F]"
DANGEROUS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ISO_CONTROL = r"[\x00-\x1F\x7F-\x9F]"
FRAME = r"^[\x00-\x20]*((at [\x00-\x20]*[^\x00-\x20]|Caused by:|Suppressed:)|\.\.\. [0-9]+ (more|common frames omitted)[\x00-\x20]*$|$)"
MARK = "\t[ex-msg] "
EDGE = r"[0-9A-Za-z_]"
PHONE = rf"(?<!{EDGE})(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}})(?!{EDGE})"
NATIONAL_ID = rf"(?<!{EDGE})([0-9]{{6}})[0-9]{{8}}([0-9]{{3}}[0-9Xx])(?!{EDGE})"
BANK_CARD = rf"(?<!{EDGE})([0-9]{{4}})[0-9]{{4,11}}([0-9]{{4}})(?!{EDGE})"
EMAIL = r"(?:([\w._%+-]{2})[\w._%+-]+|[\w._%+-]{1,2})@([\w.-]+\.[A-Za-z]{2,})"
TRUSTED_KEYS = ("_traceId", "traceId")
LEAST_MASKED = 8


def utf16_units(c: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, HTML, "")


def sanitize(c: Column) -> Column:
    """Of a message: terminal codes, then markup removed; each control character becomes a space."""
    return F.regexp_replace(strip_html(strip_ansi(c)), CONTROL, " ")


def mark_injected(c: Column) -> Column:
    """Lines after the first that do not look like a stack trace's are marked."""

    def line(x: Column, i: Column) -> Column:
        return F.when((i == 0) | x.rlike(FRAME), x).otherwise(F.concat(F.lit(MARK), x))

    return F.when(c.contains("\n"), F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")).otherwise(c)


def sanitize_throwable(c: Column) -> Column:
    """Of a stack trace: line ends and tabs stay, other control characters go, foreign lines are marked."""
    return mark_injected(F.regexp_replace(strip_html(strip_ansi(c)), DANGEROUS, ""))


def sanitize_with_stats(c: Column) -> Column:
    done = sanitize(c)
    return F.struct(done.alias("value"), (~done.eqNullSafe(c)).alias("modified"))


def quick_sanitize(c: Column) -> Column:
    return F.regexp_replace(c, ISO_CONTROL, "")


def summarize(c: Column, most: int = 256) -> Column:
    return F.substring(quick_sanitize(c), 1, most if most > 0 else 256)


def guard_length(c: Column, most: int, marker: str = "\n... [truncated]") -> Column:
    if most <= 0:
        raise ValueError("the limit must be positive")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


#: Private characters that mark a user part while it is masked, and what stands for them where a text has them itself.
MARKS = {"\uE002": "\uE002\uE005", "\uE000": "\uE002\uE003", "\uE001": "\uE002\uE004"}


def _mask_email(c: Column) -> Column:
    """One pass from left to right puts marks (private characters) around each user part; the marks then become stars."""
    marked = F.regexp_replace(c, EMAIL, "\uE000$1\uE001@$2")
    return F.regexp_replace(F.regexp_replace(marked, "\uE000\uE001", "**"), "\uE000(..)\uE001", "$1****")


def _mask_email_beside_marks(c: Column) -> Column:
    """The same for a text that holds the marks' characters: they are written differently meanwhile."""
    for mark, other in MARKS.items():
        c = F.replace(c, F.lit(mark), F.lit(other))
    c = _mask_email(c)
    for mark, other in reversed(MARKS.items()):
        c = F.replace(c, F.lit(other), F.lit(mark))
    return c


def unsafe_regex(pattern: str | None, budget_s: float = 0.1) -> str | None:
    """Why a custom rule's pattern is refused, or None: too long, nested quantifiers, bad syntax, or slow on a probe."""
    if pattern is None:
        return "null"
    if len(pattern) > 500:
        return "too long"
    if re.search(r"\([^)]*[+*][^)]*\)\s*[+*]", pattern):
        return "nested quantifier"
    try:
        compiled = re.compile(pattern)
    except re.error:
        return "syntax"
    began = time.monotonic()
    compiled.fullmatch("a" * 20 + "!")
    return "slow" if time.monotonic() - began > budget_s else None


def unsafe_regex_column(pattern: Column) -> Column:
    """The checks of ``unsafe_regex`` that need no run, for a table of patterns."""
    return F.when(pattern.isNull(), "null").when(F.length(pattern) > 500, "too long").when(pattern.rlike(r"\([^)]*[+*][^)]*\)\s*[+*]"), "nested quantifier")


Rule = tuple[str, str] | Callable[[Column], Column]


class Masker:
    """Built-in rules in their order (phone, national id, bank card, email), then added ones; each sees the one before."""

    def __init__(self, rules: Sequence[Rule] = ()):
        self.rules: list[Rule] = []
        for rule in rules:
            if not self.add(rule):
                raise ValueError(f"refused: {rule!r}")

    def add(self, rule: Rule) -> bool:
        """Adds (pattern, replacement) or a function of a Column; False if the pattern is refused."""
        if not callable(rule) and unsafe_regex(rule[0]):
            return False
        self.rules.append(rule)
        return True

    def __call__(self, c: Column) -> Column:
        out = F.regexp_replace(c, PHONE, "$1****$2")
        out = F.regexp_replace(out, NATIONAL_ID, "$1********$2")
        out = F.regexp_replace(out, BANK_CARD, "$1****$2")
        # no built-in rule matches anything else
        out = F.when(~needs_masking(c), c).when(c.rlike("[\uE000-\uE002]"), _mask_email_beside_marks(out)).otherwise(_mask_email(out))
        for rule in self.rules:
            out = rule(out) if callable(rule) else F.regexp_replace(out, *rule)
        return F.when(utf16_units(c) >= LEAST_MASKED, out).otherwise(c)


mask = Masker()


def needs_sanitizing(c: Column, throwable: bool = False) -> Column:
    """Fast-path flag. A message's DEL alone does not set it; a stack trace's line end does."""
    return F.coalesce(c.rlike(r"[<\x00-\x08\x0A-\x0C\x0E-\x1F\x7F]" if throwable else r"[<\x00-\x1F]"), F.lit(False))


def needs_masking(c: Column) -> Column:
    return F.coalesce(c.rlike("[0-9]{11}|@"), F.lit(False))


def scan_flags(c: Column, throwable: bool = False) -> Column:
    """Bit 1: sanitize, bit 2: mask."""
    return F.when(needs_sanitizing(c, throwable), 1).otherwise(0) + F.when(needs_masking(c), 2).otherwise(0)


def secure(c: Column, throwable: bool = False, masker: Callable[[Column], Column] | None = mask, sanitizer: Callable[[Column], Column] | None = None, strict_mask: bool = False) -> Column:
    """(value, sanitized, masked, fast_path). Both flags come from the raw text, so a number that sanitizing joins is not
    masked unless ``strict_mask``. Built-in stages run only if flagged; another sanitizer or masker always runs."""
    own = sanitizer or (sanitize_throwable if throwable else sanitize)

    def cleaned(raw: Column) -> Column:
        s_flag = needs_sanitizing(raw, throwable) if sanitizer is None else F.lit(True)
        return F.struct(raw.alias("raw"), s_flag.alias("s"), F.when(s_flag, own(raw)).otherwise(raw).alias("clean"))

    def valued(x: Column) -> Column:
        m_flag = (needs_masking(x["clean"] if strict_mask else x["raw"]) if isinstance(masker, Masker) else F.lit(True)) if masker else F.lit(False)
        return F.struct(*(x[k].alias(k) for k in ("raw", "s", "clean")), m_flag.alias("m"), (F.when(m_flag, masker(x["clean"])).otherwise(x["clean"]) if masker else x["clean"]).alias("value"))

    def judged(x: Column) -> Column:
        filled = F.coalesce(F.length(x["raw"]) > 0, F.lit(False))
        return F.struct(x["value"].alias("value"), (filled & ~x["clean"].eqNullSafe(x["raw"])).alias("sanitized"), (filled & ~x["value"].eqNullSafe(x["clean"])).alias("masked"), (filled & ~x["s"] & ~x["m"]).alias("fast_path"))

    # each stage is a function of the one before, so that it is worked out once, however often it is referred to
    staged = F.transform(F.transform(F.transform(F.array(c), cleaned), valued), judged)[0]
    if sanitizer is not None or not (masker is None or isinstance(masker, Masker)):
        return staged
    # most texts need neither stage: they do not get into the functions, which run outside of generated code
    quiet = ~needs_sanitizing(c, throwable) & (~needs_masking(c) if masker else F.lit(True))
    filled = F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(quiet, F.struct(c.alias("value"), F.lit(False).alias("sanitized"), F.lit(False).alias("masked"), filled.alias("fast_path"))).otherwise(staged)


def secure_columns(df, columns: dict[str, bool], masker: Callable[[Column], Column] | None = mask):
    """``df`` with <column>_value, _sanitized, _masked and _fast_path for each of ``columns`` (name: whether it is a throwable), as
    ``secure`` has them. Stages are projections one after the other, each worked out once and inside generated code."""
    flag = {c: needs_masking(F.col(c)) if isinstance(masker, Masker) else F.lit(masker is not None) for c in columns}
    df = df.withColumns({f"__{c}_s": needs_sanitizing(F.col(c), t) for c, t in columns.items()} | {f"__{c}_m": flag[c] for c in columns})
    df = df.withColumns({f"__{c}_clean": F.when(F.col(f"__{c}_s"), (sanitize_throwable if t else sanitize)(F.col(c))).otherwise(F.col(c)) for c, t in columns.items()})
    if masker:
        df = df.withColumns({f"{c}_value": F.when(F.col(f"__{c}_m"), masker(F.col(f"__{c}_clean"))).otherwise(F.col(f"__{c}_clean")) for c in columns})
    else:
        df = df.withColumns({f"{c}_value": F.col(f"__{c}_clean") for c in columns})
    out = {}
    for c in columns:
        filled = F.coalesce(F.length(c) > 0, F.lit(False))
        out |= {
            f"{c}_sanitized": filled & ~F.col(f"__{c}_clean").eqNullSafe(F.col(c)), f"{c}_masked": filled & ~F.col(f"{c}_value").eqNullSafe(F.col(f"__{c}_clean")),
            f"{c}_fast_path": filled & ~F.col(f"__{c}_s") & ~F.col(f"__{c}_m"),
        }
    return df.withColumns(out).drop(*(f"__{c}_{x}" for c in columns for x in ("s", "m", "clean")))


def secure_mdc(mdc: Column) -> Column:
    """Keys are sanitized, cut to 128 and reduced to [A-Za-z0-9._-]; values are sanitized and masked; trusted keys stay.
    Of keys that become equal the last wins."""

    def entry(e: Column) -> Column:
        trusted = e["key"].isin(*TRUSTED_KEYS)
        key = F.regexp_replace(F.substring(sanitize(e["key"]), 1, 128), "[^a-zA-Z0-9._-]", "_")
        return F.struct(F.when(trusted, e["key"]).otherwise(key).alias("key"), F.when(trusted, e["value"]).otherwise(mask(sanitize(e["value"]))).alias("value"))

    entries = F.filter(F.transform(F.map_entries(mdc), entry), lambda e: F.length(e["key"]) > 0)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    made = F.map_from_entries(last)
    if mask.rules:
        return made
    # maps in which nothing would change, found by a look at all keys and all values, are left as they are
    keys, values = F.array_join(F.map_keys(mdc), ""), F.array_join(F.map_values(mdc), " ")
    quiet = ~keys.rlike("[^a-zA-Z0-9._-]") & (F.length(keys) <= 128) & ~F.array_contains(F.map_keys(mdc), "") & ~values.rlike(r"[<\x00-\x1F\x7F@]|[0-9]{11}")
    return F.when(quiet, mdc).otherwise(made)


def secure_record(df, masker: Callable[[Column], Column] | None = mask):
    """Content strictly, throwable leniently, MDC by entries; trusted fields pass. Adds flags for the metrics."""
    df = secure_columns(df, {"content": False, "throwable": True}, masker)
    out = {k: F.col(f"content_{k}") | F.col(f"throwable_{k}") for k in ("sanitized", "masked")}
    out["fast_path"] = F.col("content_fast_path") & (F.col("throwable").isNull() | F.col("throwable_fast_path"))
    out |= {"content": F.col("content_value"), "throwable": F.col("throwable_value"), "mdc": secure_mdc(F.col("mdc"))}
    return df.withColumns(out).drop(*(f"{c}_{k}" for c in ("content", "throwable") for k in ("value", "sanitized", "masked", "fast_path")))


#: Components by name, for a configuration that switches stages off.
SANITIZERS = {"default": None, "none": lambda c: c}
MASKERS = {"default": mask, "none": None}
