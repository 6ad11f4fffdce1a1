"""Vectors as matrices of whole numbers, thousands to a row, for operators that pass over them in rounds.

Blocks lie in a table bucketed by block and are written once. What a round finds out about its vectors (assignment,
bounds) is a much smaller row for each block in a table bucketed alike, so that the next round joins both inside the
bucket: vectors are neither shuffled nor rewritten. Sums leave a task as one row for each centre, and the driver holds
the centres alone."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts

#: Vectors of a block, and the largest component that sums and squares are worked out for.
BLOCK, LARGEST = 4096, 1 << 26


def finite(vector: str) -> Column:
    """The vector holds no null, no NaN and no infinity; false where it is null."""
    return F.coalesce(F.expr(f"forall({vector}, x -> x IS NOT NULL AND abs(x) < double('infinity'))"), F.lit(False))


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64."""
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    if not (np.abs(x) <= LARGEST).all():
        raise ArithmeticError(f"a component is beyond {LARGEST} after scaling by {scale}: its squared distances could leave the range of long")
    return x.astype(np.int64)


def _pack(scale: int, dims: int, carried: list[str]):
    def run(batches):
        for batch in batches:
            x = floored(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale).astype("<i4")
            for at in range(0, len(x), BLOCK):
                piece = batch.slice(at, BLOCK)
                lists = [pa.ListArray.from_arrays([0, len(piece)], piece.column(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x[at : at + BLOCK].tobytes()], pa.binary())], [*carried, "v"])

    return run


class Bucketed:
    """Tables bucketed by block, dropped together at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets, self.names = spark, parts(spark), []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"cedarlog_blocks_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.bucketBy(self.buckets, "block").option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """All tables but the first ``keep``."""
        while len(self.names) > keep:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")

    def blocks(self, vectors: DataFrame, scale: int, dims: int, carried: list[str]) -> DataFrame:
        """(block, carried columns as lists, v) of ``vectors``, whose column embedding holds ``dims`` finite components."""
        kinds = ", ".join(f"`{c}` array<{vectors.schema[c].dataType.simpleString()}>" for c in carried)
        packed = vectors.select(*carried, "embedding").mapInArrow(_pack(scale, dims, carried), f"{kinds}, v binary")
        return self.write(packed.withColumn("block", F.monotonically_increasing_id()).repartition(self.buckets, "block"))


def beside(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    """Blocks with the state that the last round left for each; a hash join within the bucket, built on the small side."""
    if state is None:
        return blocks
    return blocks.join(state.filter("NOT sums").drop("sums", "centre", "n", "far", "work", "total").hint("shuffle_hash"), "block")


def matrix(value: pa.Scalar, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(value.as_py(), dtype=kind).reshape(-1, width)


def sums_by(index: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the rows of x by index, number of rows) for 0 to k - 1."""
    n = np.bincount(index, minlength=k)
    total = np.zeros((k, x.shape[1]), dtype=np.int64)
    used = np.flatnonzero(n)
    if len(used):
        total[used] = np.add.reduceat(x[np.argsort(index, kind="stable")], (np.cumsum(n) - n)[used], axis=0)
    return total, n


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row of x to every centre, as exact whole numbers: in doubles, where all terms stay below
    2^53 and the product is a fast one, else in int64."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def gather(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sums, counts, greatest radius, vectors scanned) over all tasks, for each of ``k`` centres: k * dims numbers."""
    own = state.filter("sums")
    per = own.groupBy("centre").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("work").alias("work")).collect()
    each = own.select("centre", F.posexplode("total").alias("at", "x")).groupBy("centre", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
    total, n, far = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object), np.zeros(k)
    for r in per:
        n[r["centre"]], far[r["centre"]] = r["n"], r["far"]
    for r in each:
        total[r["centre"], r["at"]] = int(r["x"])
    return total, n, far, sum(r["work"] for r in per)


def moved_to(total: np.ndarray, n: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Floor of the mean for each centre that has vectors; the others stay."""
    out = centres.copy()
    for c in np.flatnonzero(n):
        out[c] = [int(x) // int(n[c]) for x in total[c]]
    return out


STATE = "block bigint, sums boolean, centre int, n bigint, far double, work bigint, total array<bigint>"


def state_batch(block: int, held: dict[str, bytes], sums: tuple | None, k: int) -> pa.RecordBatch:
    """A block's state (``held``: binary columns), or the sums of a task as one row for each centre, under a block of the same bucket."""
    if sums is None:
        rows = {"block": [block], "sums": [False], "centre": [None], "n": [None], "far": [None], "work": [None], "total": [None]} | {c: [v] for c, v in held.items()}
    else:
        total, n, far, work = sums
        rows = {"block": [block] * k, "sums": [True] * k, "centre": list(range(k)), "n": n.tolist(), "far": far.tolist(), "work": [int(work)] + [0] * (k - 1), "total": total.tolist()} | {c: [None] * k for c in held}
    kinds = {"block": pa.int64(), "sums": pa.bool_(), "centre": pa.int32(), "n": pa.int64(), "far": pa.float64(), "work": pa.int64(), "total": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.binary())) for c, v in rows.items()], list(rows))

