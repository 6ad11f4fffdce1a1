"""Near-duplicate vectors by counting collisions on sorted one-dimensional projections.

Equal vectors are one class. Classes are dealt into small cells, several times over, by the signs of a few projections;
within a cell, each of many other projections is sorted and every vector's centred window is looked up; pairs that meet
in enough windows are verified by their cosine in double precision. Cell width, repetitions and the least count are set
from the collision chances of a pair at the threshold, so that such a pair is missed with a known small chance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, ids_back, materialize

PROJECTIONS = 24
#: Mean classes of a cell, and most classes of a block of a cell that is larger.
CELL, BLOCK = 128, 2048
#: Chance that all dealings part a pair at the threshold, and that its count stays below the least.
MISS = 0.002


def plan(n: int, cosine: float) -> tuple[int, int, float, int]:
    """(signs of a cell, dealings, half width of a window, least count) for ``n`` classes."""
    same_sign = 1 - math.acos(cosine) / math.pi
    signs = max(0, min(30, round(math.log2(max(1, n) / CELL))))
    dealings = 1 if signs == 0 else math.ceil(math.log(MISS) / math.log(1 - same_sign**signs))
    apart = math.sqrt(2 - 2 * cosine)  # a difference of unit vectors, projected on a Gaussian direction, has this deviation
    width = 1.35 * apart
    p = math.erf(width / apart / math.sqrt(2))
    least, below = 0, 0.0
    while below + (term := math.comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least)) <= MISS:
        below, least = below + term, least + 1
    return signs, dealings, width, least


def _directions(seed: int, count: int, dims: int) -> np.ndarray:
    return np.random.default_rng((seed, dims)).standard_normal((dims, count))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype="<f8") for v in vectors])
    return x / np.linalg.norm(x / (m := np.abs(x).max(axis=1, keepdims=True)), axis=1, keepdims=True) / m


def _classes(batches):
    """Usable vectors as bytes; others (null, zero, or with a null or non-finite component) as null."""
    for batch in batches:
        out = []
        for v in batch["embedding"]:
            x = np.array([], dtype="<f8") if v is None else np.array([np.nan if c is None else c for c in v], dtype="<f8")
            out.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "v": out})


def _deal(signs: int, dealings: int):
    def run(batches):
        for batch in batches:
            for size, part in batch.groupby(batch["v"].str.len()):
                dims = int(size) // 8
                bits = (_unit(part["v"]) @ _directions(1, signs * dealings, dims) > 0).reshape(len(part), dealings, signs)
                keys = bits @ (1 << np.arange(signs, dtype=np.int64)) if signs else np.zeros((len(part), dealings), dtype=np.int64)
                packed = [k.astype("<i4").tobytes() for k in keys]
                for d in range(dealings):
                    yield pd.DataFrame({"dims": dims, "dealing": d, "cell": keys[:, d], "rep": part["rep"].to_numpy(), "m": part["m"].to_numpy(), "v": part["v"].to_numpy(), "keys": packed})

    return run


def _collide(cosine: float, width: float, least: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rep", kind="stable")
        dims, dealing = int(block["dims"].iloc[0]), int(block["dealing"].iloc[0])
        x, rep, m, side = _unit(block["v"]), block["rep"].to_numpy(), block["m"].to_numpy(), block["side"].to_numpy()
        keys = np.stack([np.frombuffer(k, dtype="<i4") for k in block["keys"]])
        lines = x @ _directions(2, PROJECTIONS, dims)
        orders = np.argsort(lines, axis=0)
        total, root, n = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), len(x)
        for at in range(0, n, 256):
            rows = np.arange(at, min(n, at + 256))
            count = np.zeros(len(rows) * n, dtype=np.uint8)
            for p in range(PROJECTIONS):
                line = lines[orders[:, p], p]
                low, high = np.searchsorted(line, lines[rows, p] - width), np.searchsorted(line, lines[rows, p] + width, side="right")
                for i, (a, b) in enumerate(zip(low, high, strict=True)):
                    count[i * n + orders[a:b, p]] += 1
            i, j = np.divmod(np.flatnonzero(count >= least), n)
            i += at
            keep = (i < j) & ~((side[i] == side[j]) & (side[i] != 2))
            i, j = i[keep], j[keep]
            keep = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[keep], j[keep]
            first = (keys[i] == keys[j]).argmax(axis=1) == dealing  # a pair counts in the first cell that it shares
            i, j = i[first], j[first]
            np.add.at(total, i, m[j])
            np.add.at(total, j, m[i])
            while len(i):  # components of the block: every end of a link takes the lesser root
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, root[i], low)
                np.minimum.at(new, root[j], low)
                while not np.array_equal(new, new[new]):
                    new = new[new]
                if np.array_equal(new, root):
                    break
                root = new
        linked = total > 0
        return pd.DataFrame({"rep": rep[linked], "n": total[linked], "root": rep[root[linked]]})

    return run


def near_vectors(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of different
    lengths; rows that share a vec_id count as vectors each and are one node; a null vec_id has no component, counts for
    nobody and is kept; an empty table gives an empty result; other columns (labels too) are not read. Cells of more
    than BLOCK classes are cut into blocks that meet in pairs; a block returns sums and a spanning star for each of its
    vectors, not its pairs."""
    rows = embeddings.select(F.col("vec_id").cast("long").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = ids_back(materialize(rows.mapInPandas(_classes, "vec_id string, v binary"), "vectors"), "vec_id")
    usable = known.filter("vec_id IS NOT NULL AND v IS NOT NULL")
    classes = materialize(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vector-classes")
    signs, dealings, width, least = plan(classes.count(), cosine)
    dealt = materialize(classes.mapInPandas(_deal(signs, dealings), "dims int, dealing int, cell long, rep long, m long, v binary, keys binary"), "vector-cells")
    cells = dealt.groupBy("dims", "dealing", "cell").agg(F.count("*").alias("n")).filter("n > 1").selectExpr("dims", "dealing", "cell", f"ceil(n / {BLOCK}) AS blocks")
    own = "pmod(xxhash64(rep), blocks)"
    blocks = dealt.join(cells, ["dims", "dealing", "cell"]).selectExpr(
        "dims", "dealing", "cell", "rep", "m", "v", "keys",
        f"explode(transform(sequence(0, blocks - 1), j -> struct(least({own}, j) AS p, greatest({own}, j) AS q, IF({own} = j, 2, IF({own} < j, 0, 1)) AS side))) AS b",
    ).select("dims", "dealing", "cell", "rep", "m", "v", "keys", "b.*")
    # a block paired with itself has one side (2), two blocks have sides 0 and 1; a block's own pairs count there alone
    found = materialize(blocks.groupBy("dims", "dealing", "cell", "p", "q").applyInPandas(_collide(cosine, width, least), "rep long, n long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    same = usable.join(classes, "v").filter("vec_id != rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    comps = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).union(same), "vector-cc")
    per_class = classes.join(links, "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = known.join(per_class, "v", "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    out = out.join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
