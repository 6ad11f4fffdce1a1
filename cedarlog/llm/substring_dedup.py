"""Exact removal of repeated byte strings by bucket refinement, as in building a suffix array by bucket pointers.

A string of ``length`` bytes starts at every byte, too many to sort. Each is put in the bucket of one q-gram inside it:
the least by hash, leftmost at ties, so equal strings share bucket and offset, and neighbouring strings share buckets in
runs. Buckets are then refined level by level. A run is cut into blocks of neighbouring offsets; a block is identified by
the bucket it comes from and the hash of all bytes of its strings. Blocks that meet an equal one are settled: all their
strings repeat. Blocks of which even the bytes common to all their strings are unique are dropped. Only the others, at
the edges of what is repeated, go to the next level with smaller blocks, the last of single strings. Identifiers of a
level are sorted within those of the level before, and only bounded rows, never texts, are grouped.

Texts lie in a table bucketed by document, so that levels join them without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ids_back, materialize, mix64, parts

LENGTH, GRAM = 400, 128
STEPS = (16, 1)
SEGMENT = 1 << 20
CUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
ROW = "k long, h long, a long, r0 int, r1 int, bucket long, b int, inner long, whole long, settled boolean"

_RANDOM = np.random.default_rng(400128)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the rolling hash by which anchors are chosen; strings are told apart by hashes of their bytes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` + 1 of each."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _POWERS[size]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all q-grams of ``size`` bytes, from the prefix sums of a polynomial."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    n = len(sums) - size
    return mix64((sums[size:] - sums[:n]) * down[:n])


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to each end, which no structure of a text makes collide."""
    view = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))


def _marked(h: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    return mix64(h ^ mix64((r0 * 4096 + r1).astype(np.uint64))).view(np.int64)


def _runs(data: np.ndarray, good: np.ndarray, length: int, gram: int):
    """(anchor, first start, last start, bucket, whole) of each run of strings with the same anchor; good: valid starts."""
    grams = _grams(data, gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = np.flatnonzero(good[: len(least)])
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor) != 0)) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
    anchor = anchor[np.concatenate([[0], cut])]
    whole = _marked(_digests(data, first, last + length), anchor - last, anchor - first)
    return anchor, first, last, grams[anchor].view(np.int64), whole


def _anchors(length: int, gram: int):
    """Level 0 rows of documents; small documents are hashed together, long ones in overlapping segments."""

    def rows(pieces: list[tuple]) -> pd.DataFrame:  # (k, h, offset, bytes)
        data = np.frombuffer(b"".join(p[3] for p in pieces), dtype=np.uint8)
        sizes = np.array([len(p[3]) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        good = np.ones(len(data), dtype=bool)
        for s, n in zip(starts, sizes, strict=True):
            good[s + n - length + 1 : s + n] = False
        anchor, first, last, bucket, whole = _runs(data, good, length, gram)
        doc = np.searchsorted(starts, first, side="right") - 1
        k, h, offset = (np.array([p[i] for p in pieces], dtype=np.int64)[doc] for i in range(3))
        return pd.DataFrame(
            {"k": k, "h": h, "a": anchor - starts[doc] + offset, "r0": (anchor - last).astype(np.int32), "r1": (anchor - first).astype(np.int32), "bucket": bucket, "b": np.int32(0), "inner": 0, "whole": whole, "settled": False}
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k, h, text in zip(batch["k"], batch["h"], batch["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(data) - length + 1, SEGMENT):
                    piece = data[at : at + SEGMENT + length - 1]
                    held.append((k, h, at, piece))
                    size += len(piece)
                    if size >= SEGMENT:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)

    return run


def _blocks(step: int, length: int):
    """Rows of the next level: each open range of starts cut into blocks of ``step`` offsets from its anchor."""

    def rows(k, h, data: bytes, ranges: np.ndarray) -> pd.DataFrame:
        a, r0, r1, bucket, settled = ranges.T
        low = int((a - r1).min())
        text = np.frombuffer(data[low : int((a - r0).max()) + length], dtype=np.uint8)
        counts = r1 // step - r0 // step + 1
        which = np.repeat(np.arange(len(a)), counts)
        b = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + (r0 // step)[which]
        a, r0, r1, bucket, settled = (x[which] for x in (a, r0, r1, bucket, settled))
        s0, s1 = np.maximum(r0, b * step), np.minimum(r1, b * step + step - 1)
        a_ = a - low
        inner = _digests(text, a_ - b * step, a_ - b * step - step + 1 + length).view(np.int64)
        whole = _marked(_digests(text, a_ - s1, a_ - s0 + length), s0, s1)
        return pd.DataFrame({"k": k, "h": h, "a": a, "r0": s0.astype(np.int32), "r1": s1.astype(np.int32), "bucket": bucket, "b": b.astype(np.int32), "inner": inner, "whole": whole, "settled": settled.astype(bool)})

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for k, h, text, ranges in zip(batch["k"], batch["h"], batch["text"], batch["ranges"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spots = np.array([(x["a"], x["r0"], x["r1"], x["bucket"], x["settled"]) for x in ranges], dtype=np.int64)
                spots = spots[np.argsort(spots[:, 0], kind="stable")]
                while len(spots):
                    near = spots[:, 0] < spots[0, 0] + SEGMENT
                    out.append(rows(k, h, data, spots[near]))
                    size += len(out[-1])
                    spots = spots[~near]
                if size > 200_000:
                    yield pd.concat(out)
                    out, size = [], 0
            if out:
                yield pd.concat(out)

    return run


def _refine(level: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled spans, ranges that stay open, classes that both read) of a level: counts of equal blocks, and of blocks with equal inner bytes."""
    key = ["bucket", "b", "inner"]
    classes = level.groupBy(*key, "whole").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "a", "r0", "r1", "settled")).alias("one"))
    classes = materialize(classes, "substring-classes")
    open_ = (F.col("n") == 1) & ~F.col("one.settled")
    groups = classes.groupBy(*key).agg(F.count("*").alias("kinds"), F.max(open_).alias("open")).filter("kinds > 1 AND open").select(*key)
    stay = classes.join(groups, key).select("one.k", "one.h", "one.a", "one.r0", "one.r1", "bucket", (F.col("one.settled") | (F.col("n") > 1)).alias("settled"))
    spans = level.filter("NOT settled").join(classes.filter("n > 1").select(*key, "whole"), [*key, "whole"], "left_semi").select("k", "h", (F.col("a") - F.col("r1")).alias("lo"), (F.col("a") - F.col("r0")).alias("hi"))
    return spans, stay, classes


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                removed, runs, at, kept = 0, 0, 0, []
                end = -1
                for lo, hi in sorted((x["lo"], x["hi"] + length) for x in spans) if spans is not None else ():
                    if lo > end:
                        kept.append(data[at:lo])
                        runs, at = runs + 1, lo
                        end = lo
                    if hi > end:
                        removed += hi - end
                        end = at = hi
                left = b"".join([*kept, data[at:]])
                out.append((len(data), removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=CUT[1:]).assign(doc_id=batch["doc_id"].to_numpy())[CUT]

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) for each row of ``documents``; text: what remains of it, where
    a character that lost some of its bytes is a replacement mark.

    Null texts are empty; texts shorter than ``length`` bytes lose nothing; a string that occurs twice in one document
    or in two rows that are equal in all columns is repeated; null ids are kept; an empty table gives an empty result;
    other columns are not read. A document is known by its id and its text's hash, so equal rows get equal results."""
    spark = documents.sparkSession
    name, n = f"cedarlog_texts_{uuid.uuid4().hex}", parts(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), F.xxhash64("text").alias("h"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    try:
        texts.repartition(n, "k", "h").write.bucketBy(n, "k", "h").option("compression", "zstd").saveAsTable(name)
        return ids_back(_without_repeats(spark.table(name), length, gram, steps), "doc_id")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _without_repeats(table: DataFrame, length: int, gram: int, steps: tuple[int, ...]) -> DataFrame:
    level = materialize(table.select("k", "h", "text").mapInPandas(_anchors(length, gram), ROW), "substring-0")
    done = []
    for i, step in enumerate([*steps, 0]):
        spans, stay, classes = _refine(level)
        done.append(materialize(spans, f"substring-spans-{i}"))
        if step:
            ranges = stay.groupBy("k", "h").agg(F.collect_set(F.struct("a", "r0", "r1", "bucket", "settled")).alias("ranges"))
            one = table.select("k", "h", "text").join(ranges, ["k", "h"])
            new = materialize(one.mapInPandas(_blocks(step, length), ROW), f"substring-{i + 1}")
        discard(level)
        discard(classes)
        if step:
            level = new
    spans = done[0]
    for more in done[1:]:
        spans = spans.union(more)
    spans = spans.groupBy("k", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = table.join(spans, ["k", "h"], "left").select("doc_id", "text", "spans").mapInPandas(_cut(length), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    out = materialize(cut, "substring-cut")
    for spans in done:
        discard(spans)
    return out
