"""Product codes for vectors: each of equal parts of a vector becomes the index of its codebook's nearest entry.

Codebooks are fitted by rounds of assignment and means in exact whole numbers. A part keeps the exact distance to its entry.
If that entry did not move, all entries that stayed are as far as before and cannot win now, so only entries that moved
are compared with the stored distance; parts whose own entry moved are compared with the whole codebook.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vector_blocks import STATE, Bucketed, beside, finite, floored, gather, matrix, moved_to, squared, state_batch, sums_by

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to which their sums are broadcast.
LABELS = 100_000
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def nearest(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None, was: np.ndarray | None, stored: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry of ``book`` for each row of x, lower ones first at equal distance; squared distance; how
    many distances were worked out). ``moved``: which entries moved since ``was`` and ``stored`` were found."""
    if was is None:
        d = squared(x, book)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at], d.size
    at, best, work = was.astype(np.int64), stored.copy(), 0
    again = moved[at]
    if (rows := np.flatnonzero(again)).size:
        d = squared(x[rows], book)
        at[rows] = d.argmin(axis=1)
        best[rows] = d[np.arange(len(rows)), at[rows]]
        work += d.size
    active = np.flatnonzero(moved)
    if len(active) and (rows := np.flatnonzero(~again)).size:
        d = squared(x[rows], book[active])
        first = d.argmin(axis=1)
        away, entry = d[np.arange(len(rows)), first], active[first]
        wins = (away < best[rows]) | ((away == best[rows]) & (entry < at[rows]))
        at[rows[wins]], best[rows[wins]] = entry[wins], away[wins]
        work += d.size
    return at, best, work


def _assign(books: np.ndarray, moved: np.ndarray | None, last: bool):
    """One pass over the blocks of a task. books: part, entry, position within the part; moved: part, entry."""
    n_parts, entries, width = books.shape
    k = n_parts * entries

    def run(batches):
        total, n, work, block = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64), 0, None
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                x = matrix(get("v"), "<i4", n_parts * width).astype(np.int64)
                codes, away = np.empty((len(x), n_parts), dtype=np.int64), np.empty((len(x), n_parts), dtype=np.int64)
                was = stored = None
                if moved is not None:
                    was, stored = matrix(get("own"), "<u2", n_parts), matrix(get("away"), "<i8", n_parts)
                for p in range(n_parts):
                    before = (None, None, None) if was is None else (moved[p], was[:, p], stored[:, p])
                    codes[:, p], away[:, p], done = nearest(x[:, p * width : (p + 1) * width], books[p], *before)
                    work += done
                if last:
                    text = codes.astype(np.uint8).tobytes().hex()
                    text = [text[i : i + 2 * n_parts] for i in range(0, len(text), 2 * n_parts)]
                    yield pa.RecordBatch.from_arrays([get("vec_id").values, get("label").values, pa.array(text, pa.string()), pa.array(away.sum(axis=1))], ["vec_id", "label", "code", "error"])
                    continue
                block = get("block").as_py()
                yield state_batch(block, {"own": codes.astype("<u2").tobytes(), "away": away.tobytes()}, None, k)
                for p in range(n_parts):
                    piece, at = x[:, p * width : (p + 1) * width], slice(p * entries, (p + 1) * entries)
                    changed = np.arange(len(x)) if was is None else np.flatnonzero(codes[:, p] != was[:, p])
                    came, in_ = sums_by(codes[changed, p], piece[changed], entries)
                    total[at], n[at] = total[at] + came, n[at] + in_
                    if was is not None:
                        left, out = sums_by(was[changed, p].astype(np.int64), piece[changed], entries)
                        total[at], n[at] = total[at] - left, n[at] - out
        if block is not None:
            yield state_batch(block, {"own": b"", "away": b""}, (total, n, np.zeros(k), work), k)

    return run


def compress_vectors(vectors: DataFrame, n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, compared: list[int] | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept row of ``vectors`` (vec_id, embedding, label).

    Kept are rows whose embedding holds no null or non-finite component and has as many components as that of the least vec_id
    among those whose number of components divides into ``n_parts``; vectors of another length have no place in its codebooks
    and are left out. Components become floor(scale * x); one beyond 2^26 after that is an error. Rows that share a vec_id
    are vectors each (as starting entries, the lesser vector first); rows without vec_id are coded and start nothing before
    others; with fewer kept rows than ``entries`` (at most 256) the codebooks have as many; equal entries leave the later one
    unused, which stays; null labels are one label; an empty table gives an empty result; other columns are not read.
    ``compared`` gets the number of distances that each round worked out."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter((F.size("embedding") > 0) & (F.size("embedding") % n_parts == 0)).filter(finite("embedding"))
    by = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = rows.orderBy(*by).limit(1).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    dims = len(first[0]["embedding"])
    rows, width = rows.filter(F.size("embedding") == dims), dims // n_parts
    starts = floored(np.array([r["embedding"] for r in rows.orderBy(*by).limit(entries).collect()]), scale)
    books = starts.reshape(len(starts), n_parts, width).transpose(1, 0, 2)  # part, entry, position
    k = books.shape[1]
    tables, moved, state = Bucketed(spark), None, None
    total, n = np.zeros((n_parts * k, width), dtype=object), np.zeros(n_parts * k, dtype=object)
    try:
        blocks = tables.blocks(rows, scale, dims, ["vec_id", "label"])
        for _ in range(rounds):
            new = tables.write(beside(blocks, state).mapInArrow(_assign(books, moved, False), f"{STATE}, own binary, away binary"))
            if state is not None:
                spark.sql(f"DROP TABLE {tables.names.pop(-2)}")
            state = new
            changes, came, _, work = gather(state, n_parts * k, width)
            total, n = total + changes, n + came
            after = moved_to(total, n, books.reshape(n_parts * k, width)).reshape(books.shape)
            moved, books = (after != books).any(axis=2), after
            if compared is not None:
                compared.append(work)
        found = materialize(beside(blocks, state).mapInArrow(_assign(books, moved, True), "vec_id bigint, label string, code string, error bigint"), "codes")
    finally:
        tables.drop()
    per = materialize(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-labels")
    if per.count() <= LABELS:
        per = F.broadcast(per)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return found.join(per, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
