"""Centroid clustering in exact whole numbers, with bounds that keep most vectors from being compared with all centroids.

Each vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other. When
centroids move, the lower bound of a cluster's vectors need not sink by the greatest drift: they lie in a sphere about
their old centroid, and in the plane of that centroid and of another's old and new place (a, b), the distance of a
point x shrinks by at most |ab| cos(angle of x and b at a). The sphere bounds that angle, so a centroid that passes by or
moves away costs little or nothing. Vectors whose bounds overlap are scanned against all centroids exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vector_blocks import STATE, Bucketed, beside, finite, floored, gather, matrix, moved_to, squared, state_batch, sums_by

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Bounds are doubles: they give way by this share, far above their rounding errors.
SLACK = 1e-9


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the distance from a point within ``radius`` of its old centroid to any other centroid
    can shrink when the centroids move from ``old`` to ``new``; below 0 if all others move away from the sphere."""
    k, old, new = len(old), old.astype(np.float64), new.astype(np.float64)
    step = new - old
    drift = np.sqrt((step * step).sum(axis=1))
    out = np.full(k, -np.inf)
    for i in range(k):
        for j in range(k):
            if i == j:
                continue
            to = old[i] - old[j]
            far = np.sqrt(to @ to)
            if drift[j] == 0:
                shrinks = 0.0
            elif radius[i] >= far:
                shrinks = drift[j]
            else:
                angle = np.arccos(np.clip(to @ step[j] / far / drift[j], -1, 1)) - np.arcsin(radius[i] / far)
                shrinks = drift[j] * np.cos(max(0.0, angle))
            out[i] = max(out[i], shrinks + SLACK * (far + drift[j] + radius[i]))
    return out


def _assign(old: np.ndarray | None, new: np.ndarray, radius: np.ndarray | None, last: bool):
    """One pass over the blocks of a task; ``last``: rows of vectors instead of state."""
    k, dims = new.shape
    if old is not None:
        drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
        looser = loosening(old, new, radius)

    def pass_over(x, was, upper, lower):
        """(centroid, upper, lower, number scanned)."""
        if was is None:
            own, doubt = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
            upper, lower = np.empty(len(x)), np.empty(len(x))
        else:
            own = was.astype(np.int64)
            upper = (upper + drift[own]) * (1 + SLACK)
            lower = lower - looser[own]
            doubt = np.flatnonzero(upper * (1 + SLACK) >= lower)
            exact = np.sqrt(((x[doubt] - new[own[doubt]]) ** 2).sum(axis=1))
            upper[doubt] = exact * (1 + SLACK)
            doubt = doubt[upper[doubt] * (1 + SLACK) >= lower[doubt]]
        if len(doubt):
            d = squared(x[doubt], new)
            at, rows = d.argmin(axis=1), np.arange(len(doubt))
            own[doubt] = at
            upper[doubt] = np.sqrt(d[rows, at]) * (1 + SLACK)
            d[rows, at] = np.iinfo(np.int64).max
            lower[doubt] = np.sqrt(d.min(axis=1)) * (1 - SLACK) if k > 1 else np.inf
        return own, upper, lower, len(doubt)

    def run(batches):
        total, n, far, work, block = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k), 0, None
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                x = matrix(get("v"), "<i4", dims).astype(np.int64)
                was = upper = lower = None
                if old is not None:
                    was, upper, lower = (np.frombuffer(get(c).as_py(), dtype=t) for c, t in (("own", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
                own, upper, lower, scanned = pass_over(x, was, upper, lower)
                if last:
                    away = ((x - new[own]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([get("vec_id").values, pa.array(own.astype(np.int32)), pa.array(away)], ["vec_id", "cluster", "distance"])
                    continue
                block = get("block").as_py()
                yield state_batch(block, {"own": own.astype("<i4").tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes()}, None, k)
                changed = np.arange(len(x)) if was is None else np.flatnonzero(own != was)
                came, in_ = sums_by(own[changed], x[changed], k)
                total, n, work = total + came, n + in_, work + scanned
                if was is not None:
                    left, out = sums_by(was[changed], x[changed], k)
                    total, n = total - left, n - out
                np.maximum.at(far, own, upper)
        if block is not None:
            yield state_batch(block, {"own": b"", "upper": b"", "lower": b""}, (total, n, far, work), k)

    return run


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = "3:", scanned: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of ``vectors``.

    Kept are rows whose embedding has exactly ``dims`` components, none null or non-finite; components become
    floor(scale * x). A component beyond 2^26 after that is an error, as its distances may not fit a long. Centroids start as the
    kept vectors of least sha256 of seed and vec_id; rows that share a vec_id are vectors each, and of equal hashes the least
    vector comes first; rows without vec_id have none, come last as starts and are assigned like others. With fewer kept
    rows than ``clusters``, there are as many centroids; equal centroids leave the later one empty, which stays; an empty
    table gives an empty result; other columns are not read. ``scanned`` gets the number of vectors that each round compared with
    all centroids. Every pass is one job over the blocks and one over its sums; a lost executor repeats tasks of one pass."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.size("embedding") == dims).filter(finite("embedding"))
    rank = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = rows.orderBy(rank.asc_nulls_last(), "embedding").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = floored(np.array([r["embedding"] for r in starts]), scale)
    tables, old, radius, state, k = Bucketed(spark), None, None, None, len(centres)
    total, n = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object)
    try:
        blocks = tables.blocks(rows, scale, dims, ["vec_id"])
        for _ in range(rounds):
            new = tables.write(beside(blocks, state).mapInArrow(_assign(old, centres, radius, False), f"{STATE}, own binary, upper binary, lower binary"))
            if state is not None:
                spark.sql(f"DROP TABLE {tables.names.pop(-2)}")
            state = new
            changes, came, radius, work = gather(state, k, dims)
            total, n = total + changes, n + came
            old, centres = centres, moved_to(total, n, centres)
            if scanned is not None:
                scanned.append(work)
        found = materialize(beside(blocks, state).mapInArrow(_assign(old, centres, radius, True), "vec_id bigint, cluster int, distance bigint"), "clusters")
    finally:
        tables.drop()
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    about = [(c, sums.get(c, 0), sum(sums.values()), digest[c]) for c in range(k)]  # a row for each centroid
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
