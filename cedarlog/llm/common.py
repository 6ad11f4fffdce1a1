"""Helpers shared by the training-data operators: shared scratch tables, word splitting and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one, but only for a
    local master: executors elsewhere could not read it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.cedarlog.scratch", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cedarlog-")
        spark.conf.set("spark.cedarlog.scratch", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``materialize`` that no later step reads."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split("://")[-1].split(":")[-1] in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ids_back(df: DataFrame, *columns: str) -> DataFrame:
    """Ids that went through Python as strings (a column of numbers with a null would be one of doubles) as numbers again."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker is kept for the next task, and what it once held with it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _local_stars(batches):
    """Edges of one partition to edges from each node to the least node of its part of the partition's graph.
    Memory: one entry for each node seen in batches of bounded size."""
    for batch in batches:
        u, v = batch["u"].to_numpy(), batch["v"].to_numpy()
        nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = flat[: len(u)], flat[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        keep = root != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[keep], "v": nodes[root[keep]]})


def connected_components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v: long); component is the least node reachable.

    Alternating large-star and small-star rounds until a round changes nothing, which is when all edges form stars. Each round
    is one job that is written to the shared folder, with a count and a sum of hashes of its edges to tell a change by; a
    lost executor repeats one round at most, and the rounds are logarithmic in the longest path. Loops and nulls are left out."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").mapInPandas(_local_stars, "u long, v long").distinct()
    known = None
    for _ in range(most_rounds):
        seen = Observation()
        new = materialize(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
        if known:
            discard(known[0])
            if known[1] == seen.get:
                break
        known = (new, seen.get)
        if not known[1]["n"]:
            break
        both = new.union(new.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
    else:
        raise RuntimeError("components did not settle")
    members = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
