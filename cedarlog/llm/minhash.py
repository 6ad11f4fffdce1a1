"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every distinct shingle set is signed once. Each tree of the forest orders the sets by its own run of minima: neighbours
in that order share the longest prefix of their region, so the depth at which candidates meet adapts to the region. The
best neighbour of each set is confirmed on full sets and linked; then every region in which unlinked components still
share a prefix of the least depth is compared in full, the part that is one component left out. Regions of any size are
cut into blocks, so no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, connected_components, discard, give_back, ids_back, materialize, mix64

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
#: Most sets in a block of a region that is compared in full.
BLOCK = 2048
#: Standard errors by which a signature's estimate may be below the least similarity of a pair that is confirmed.
MARGIN = 3.5
#: Trees in which each set's best partner is looked for before whole regions are compared.
FIRST_TREES = 4
SIGNED = "doc_id string, key long, n long, k1 long, k2 long, sig binary"

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """The distinct shingles of ``size`` words, as sorted 64-bit hashes; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    out = mix64(h[: len(h) - size + 1] + np.uint64(size))
    for i in range(1, size):
        out = mix64(out ^ h[i : len(h) - size + 1 + i])
    return np.unique(out)


def signature(found: np.ndarray) -> bytes:
    """TREES * DEPTH minima as big-endian 32-bit numbers, so that their bytes sort as they do."""
    least = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return least.astype(">u4").tobytes()


def _identity(found: np.ndarray) -> tuple[int, int, int]:
    """What a set is known by: its size and two sums of its shingles, 64 bits each."""
    if not len(found):
        return 0, 0, 0
    return len(found), int(np.bitwise_xor.reduce(mix64(found + np.uint64(1))).view(np.int64)), int(found.sum(dtype=np.uint64).view(np.int64))


def _sign(size: int):
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in batch["text"]:
                found = shingles(text, size, hashes)
                for column, value in zip((n, k1, k2), _identity(found), strict=True):
                    column.append(value)
                sig.append(signature(found) if len(found) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "n": n, "k1": k1, "k2": k2, "sig": sig})
        del hashes
        give_back()

    return run


CROWDED = "tree int, region long, rep long, prev long"


def _crowded(batches):
    """Of a tree's order, the sets that share LEAST_DEPTH minima with an adjacent one, with the one before them if it is
    such (prev). The first and last set of a partition are always kept: their region may go on in another one."""
    held = None

    def rows(data: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The kept rows of ``data`` but for its last row, which is kept only if no batch follows."""
        tree, region, rep, prev, keep = (data[c].to_numpy() for c in ("tree", "region", "rep", "prev", "keep"))
        same = (tree[1:] == tree[:-1]) & (region[1:] == region[:-1])
        prev, keep = prev.copy(), keep.copy()
        prev[1:][same] = rep[:-1][same]
        keep[1:] |= same
        keep[:-1] |= same
        keep[-1] |= last
        done = len(data) if last else len(data) - 1
        out = pd.DataFrame({"tree": tree, "region": region, "rep": rep, "prev": prev, "keep": keep})
        return out.iloc[:done][keep[:done]], out.iloc[done:]

    for batch in batches:
        data = batch[["tree", "region", "rep"]].assign(prev=np.int64(-1), keep=False)
        data["prev"] = data["rep"]
        if held is None:
            data["keep"] = np.arange(len(data)) == 0
        else:
            data = pd.concat([held, data], ignore_index=True)
        if len(data):
            kept, held = rows(data, False)
            yield kept[["tree", "region", "rep", "prev"]]
    if held is not None and len(held):
        yield rows(held, True)[0][["tree", "region", "rep", "prev"]]


#: Bits of the map of row keys by which texts are sifted before they are shuffled: 4 MB at most, however many rows.
SIFT_BITS = 1 << 25
CLASS = ["n", "k1", "k2"]


def _texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``documents`` (key, text) whose key is in ``wanted``, with the columns of both. A bitmap of hashed keys, of a
    fixed size, keeps most other texts out of the shuffle; the join that follows is exact, so a full bitmap costs time
    only. Keys are dealt out by bucket first, as a partial bitmap in every task would be larger than its keys; an inner
    join stays above the bitmap's, where a left semi join would be pushed below it."""
    bit = F.pmod(F.xxhash64("key"), F.lit(SIFT_BITS))
    maps = wanted.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map"))
    sifted = documents.withColumns({"bucket": F.bitmap_bucket_number(bit), "place": F.bitmap_bit_position(bit)}).join(F.broadcast(maps), "bucket")
    held = F.expr("shiftright(CAST(conv(hex(substring(map, CAST(place DIV 8 AS int) + 1, 1)), 16, 10) AS int), CAST(place % 8 AS int)) & 1") == 1
    return sifted.filter(held).select("key", "text").join(wanted, "key")


def _sets(size: int):
    """Sets of texts, for those that are of the class they are wanted for: two rows may share a key."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            reps, out = [], []
            for rep, text, *own in zip(*(batch[c] for c in ("rep", "text", *CLASS)), strict=True):
                found = shingles(text, size, hashes)
                if _identity(found) == tuple(own):
                    reps.append(rep)
                    out.append(found.tobytes())
            yield pd.DataFrame({"rep": pd.Series(reps, dtype="int64"), "found": out})
        del hashes
        give_back()

    return run


def _sets_of(documents: DataFrame, classes: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(rep, found): the set of each class in ``reps`` once, however many rows its chosen text has."""
    found = _texts_of(documents, classes.drop("sig").join(reps, "rep")).mapInPandas(_sets(size), "rep long, found binary")
    return found.groupBy("rep").agg(F.any_value("found").alias("found"))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_similar(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), percent) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.loc[np.array(keep, dtype=bool), ["u", "v"]].copy()
            del batch
        give_back()

    return run


def _confirmed(pairs: DataFrame, documents: DataFrame, classes: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. A pair carries one set through each of two joins."""
    reps = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    sets = materialize(_sets_of(documents, classes, reps, size), f"{name}-sets")
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("found").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("found").alias("b")), "v")
    links = materialize(both.mapInPandas(_confirm(percent), "u long, v long").distinct(), f"{name}-links")
    discard(sets)
    return links


BLOCK_KEY = ["tree", "region", "kind", "p", "q"]


def _by_block(handle, fields: str):
    """For mapInPandas over rows that are sorted by BLOCK_KEY: handle(key, part) gives a block pair's rows as tuples. Most
    regions are tiny, so they are cut out of whole batches; what is held over a batch is one block pair at most."""
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = {x.split()[0]: {"long": "int64", "int": "int32"}.get(x.split()[1], "object") for x in fields.split(", ")}

    def rows(data: pd.DataFrame, bounds) -> pd.DataFrame:
        columns = {c: data[c].to_numpy() for c in data.columns}
        out = []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = {c: v[start:end] for c, v in columns.items()}
            out += handle(tuple(part[k][0] for k in BLOCK_KEY), part)
        return pd.DataFrame(out, columns=names).astype(kinds)

    def run(batches):
        held = None
        for batch in batches:
            data = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.zeros(max(0, len(data) - 1), dtype=bool)
            for k in BLOCK_KEY:
                v = data[k].to_numpy()
                new |= v[1:] != v[:-1]
            bounds = [0, *(np.flatnonzero(new) + 1)]
            held = data.iloc[bounds[-1] :].copy()  # a view would keep the whole batch
            if len(bounds) > 1:
                yield rows(data, bounds)
            del data, batch
        if held is not None and len(held):
            yield rows(held, [0, len(held)])
        del held
        give_back()

    return run


def _sides(part: dict):
    """Either side of a block pair: (ids, components, signatures); a block that is paired with itself is both."""
    sigs = np.frombuffer(b"".join(part["sig"]), dtype=">u4").reshape(len(part["sig"]), -1)
    for side in (part["side"] != 1, part["side"] != 0):
        yield part["rep"][side], part["comp"][side], sigs[side]


def _least(percent: int) -> float:
    """Equal minima below which a pair is not worth confirming."""
    p = percent / 100
    return TREES * DEPTH * (p - MARGIN * np.sqrt(p * (1 - p) / (TREES * DEPTH)))


def _best(percent: int):
    """Of each set of a block pair, the partner of another component whose signature agrees most: (u, v, near)."""
    least = _least(percent)

    def handle(key: tuple, part: dict) -> list[tuple]:
        (mine, own, x), (theirs, foreign, y) = _sides(part)
        out = []
        top, at = np.zeros(len(y), dtype=np.int32), np.zeros(len(y), dtype=np.int64)
        for i in range(len(x)) if len(y) else ():
            same = np.where(foreign != own[i], (x[i] == y).sum(axis=1, dtype=np.int32), 0)
            j = int(same.argmax())
            out.append((mine[i], theirs[j], same[j]))
            better = same > top
            top[better], at[better] = same[better], mine[i]
        out += zip(theirs, at, top, strict=True)
        return [r for r in out if r[2] >= least]

    return handle


def _candidates(percent: int):
    """The sets of a block pair that may be similar to one of another component, with these partners' ids packed. A pair
    counts in the first tree in which it shares a region, so in one block pair alone."""
    least = _least(percent)

    def handle(key: tuple, part: dict) -> list[tuple]:
        (mine, own, x), (theirs, foreign, y) = _sides(part)
        twice = bool((part["side"] == 2).any())
        partners, met = {}, set()
        for i in range(len(x)) if len(y) else ():
            j = np.flatnonzero((foreign != own[i]) & ((theirs > mine[i]) | (not twice)))
            j = j[(x[i] == y[j]).sum(axis=1) >= least]
            for t in range(key[0]) if len(j) else ():
                j = j[(x[i, t * DEPTH : t * DEPTH + LEAST_DEPTH] != y[j, t * DEPTH : t * DEPTH + LEAST_DEPTH]).any(axis=1)]
            if len(j):
                partners[int(mine[i])] = theirs[j].astype("<i8").tobytes()
                met.update(theirs[j].tolist())
        comps = dict(zip(part["rep"].tolist(), part["comp"].tolist(), strict=True)) if partners else {}
        return [(r, comps[r], partners.get(r, b""), *key) for r in sorted(met | partners.keys())]

    return handle


def _linked(percent: int):
    """Confirmed links of a block pair that join components; pairs that earlier links have joined need no look."""

    def handle(key: tuple, part: dict) -> list[tuple]:
        sets = {r: np.frombuffer(f, dtype=np.uint64) for r, f in zip(part["rep"].tolist(), part["found"], strict=True)}
        comp = dict(zip(part["rep"].tolist(), part["comp"].tolist(), strict=True))
        root = {c: c for c in comp.values()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for r, packed in zip(part["rep"].tolist(), part["partners"], strict=True):
            for other in np.frombuffer(packed, dtype="<i8").tolist():
                a, b = find(comp[r]), find(comp[other])
                if a != b and _similar(sets[r], sets[other], percent):
                    root[max(a, b)] = min(a, b)
                    out.append((r, other))
        return out

    return handle


def _of_blocks(df: DataFrame, handle, fields: str) -> DataFrame:
    return df.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).mapInPandas(_by_block(handle, fields), fields)


def _blocks(trees: DataFrame, sigs: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of every region of ``trees`` in which there is more than one component, dealt to pairs of blocks."""
    rows = trees.join(comps, "rep", "left").select("tree", "region", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = rows.groupBy("tree", "region", "comp").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("tree", "region").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("n")).filter("comps > 1")
    regions = regions.select("tree", "region", F.col("major.comp").alias("major"), F.ceil(F.col("major.n") / BLOCK).cast("int").alias("majors"), F.ceil((F.col("n") - F.col("major.n")) / BLOCK).cast("int").alias("minors"))
    mixed = rows.join(regions, ["tree", "region"])
    # blocks: those of the largest component face all others'; the others also face each other, each pair of blocks once
    own = "pmod(xxhash64(rep), minors)"
    dealt = mixed.selectExpr(
        "tree", "region", "rep", "comp",
        f"explode(IF(comp = major, transform(sequence(0, minors - 1), j -> struct(1 AS kind, CAST(j AS bigint) AS p, pmod(xxhash64(rep), majors) AS q, 1 AS side)),"
        f" concat(transform(sequence(0, majors - 1), j -> struct(1 AS kind, {own} AS p, CAST(j AS bigint) AS q, 0 AS side)),"
        f" transform(sequence(0, minors - 1), j -> struct(2 AS kind, least({own}, j) AS p, greatest({own}, j) AS q, IF({own} = j, 2, IF({own} < j, 0, 1)) AS side))))) AS b",
    )
    return dealt.select("tree", "region", "rep", "comp", "b.*").join(sigs, "rep")


def _best_pairs(trees: DataFrame, sigs: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Of each set that meets another component in a region of ``trees``, the two best partners: pairs (u, v)."""
    found = _of_blocks(_blocks(trees, sigs, comps), _best(percent), "u long, v long, near int")
    first = found.groupBy("u").agg(F.max(F.struct("near", "v")).alias("first"), F.max(F.struct("near", -F.col("v"))).alias("second"))
    both = first.select("u", F.explode(F.array(F.col("first.v"), -F.col("second.col2"))).alias("v"))
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _rest(trees: DataFrame, sigs: DataFrame, comps: DataFrame, documents: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between components, from all regions of all trees; sets go to blocks, not to pairs."""
    kept = "rep long, comp long, partners binary, tree int, region long, kind int, p long, q long"
    asked = materialize(_of_blocks(_blocks(trees, sigs, comps), _candidates(percent), kept), "minhash-asked")
    sets = _sets_of(documents, classes, asked.select("rep").distinct(), size)
    links = materialize(_of_blocks(asked.join(sets, "rep"), _linked(percent), "u long, v long"), "minhash-rest")
    discard(asked)
    return links


def _forest(documents: DataFrame, size: int, percent: int, null_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(members, links): each row of ``documents`` as (doc_id, key, n, rep), key being a hash of id and text and rep the row's
    class of equal sets (null: no words, or no id unless ``null_ids``); and edges (u, v) that connect similar classes."""
    docs = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    signed = ids_back(materialize(docs.mapInPandas(_sign(size), SIGNED), "minhash-signed"), "doc_id")
    docs = docs.select("key", "text")
    usable = signed.filter("n > 0") if null_ids else signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy(*CLASS).agg(F.min(F.struct("key", "sig")).alias("least")).select(F.monotonically_increasing_id().alias("rep"), *CLASS, F.col("least.key").alias("key"), F.col("least.sig").alias("sig"))
    classes = materialize(classes, "minhash-classes")  # numbered once: what is written does not change
    of_class = F.struct(*(F.when(F.lit(null_ids) | F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in CLASS))
    members = materialize(signed.select("doc_id", "key", "n", of_class.alias("c")).join(classes.select(F.struct(*CLASS).alias("c"), "rep"), "c", "left").select("doc_id", "key", "n", "rep"), "minhash-members")
    discard(signed)
    forest = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("key"), "rep")
    order = forest.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    # a region is known by the hash of its prefix: two that share one are compared together, which loses nothing
    trees = materialize(order.select("tree", F.xxhash64(F.substring("key", 1, 4 * LEAST_DEPTH)).alias("region"), "rep").mapInPandas(_crowded, CROWDED), "minhash-trees")
    sigs = materialize(classes.select("rep", "sig").join(trees.select("rep").distinct(), "rep", "left_semi"), "minhash-sigs")
    near = trees.select(F.greatest("rep", "prev").alias("u"), F.least("rep", "prev").alias("v")).filter("u > v")
    best = near.groupBy("u", "v").count().groupBy("u").agg(F.max(F.struct("count", -F.col("v"))).alias("b")).select("u", (-F.col("b.col2")).alias("v"))
    links = _confirmed(materialize(best, "minhash-best"), docs, classes, size, percent, "minhash-first")
    comps = connected_components(links, "minhash-cc").select(F.col("node").alias("rep"), "component")
    best = materialize(_best_pairs(trees.filter(F.col("tree") < FIRST_TREES), sigs, comps, percent), "minhash-best")
    links = comps.select(F.col("rep").alias("u"), F.col("component").alias("v"))  # as stars, to which more links are added
    if not best.isEmpty():
        comps = connected_components(links.union(_confirmed(best, docs, classes, size, percent, "minhash-second")), "minhash-cc").select(F.col("node").alias("rep"), "component")
        links = comps.select(F.col("rep").alias("u"), F.col("component").alias("v"))
    return members, links.union(_rest(trees, sigs, comps, docs, classes, size, percent))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents``; links at Jaccard >= percent / 100.

    Null texts and texts without words have no shingles and link with nothing; equal sets are one set; rows that share a
    doc_id are one node, whatever their texts; a row whose doc_id is null links with nothing, has no component and is
    kept; an empty table gives an empty result; other columns are not read."""
    members, links = _forest(documents, size, percent, null_ids=False)
    of_id = members.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).filter("v < w").select("doc_id", "v")
    same = members.join(of_id, "doc_id").filter("rep > v").select(F.col("rep").alias("u"), "v")
    comps = connected_components(links.union(same), "minhash-cc").select(F.col("node").alias("rep"), "component")
    least = members.filter("rep IS NOT NULL").groupBy("rep").agg(F.min("doc_id").alias("least")).join(comps, "rep", "left").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("rep", "component_id")
    return members.join(named, "rep", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        (component := F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, with all their columns, of which one stays of each group of linked texts.

    Here each row is a node of its own: rows that share an id but not a text are judged by their texts, and rows without an
    id as any other. The one that stays has the least id (a null id is the greatest), then the least hash of its text; of
    rows equal in both, one. Null texts and texts without words link with nothing and all stay. No column is added, so
    names do not clash; an empty table gives an empty result."""
    members, links = _forest(documents, size, percent, null_ids=True)
    comps = connected_components(links, "minhash-cc").select(F.col("node").alias("rep"), "component")
    rows = members.filter("rep IS NOT NULL").groupBy("rep", "doc_id", "key").agg(F.count("*").alias("n")).join(comps, "rep", "left")
    rows = rows.select(F.coalesce("component", "rep").alias("component"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("row"), "n")
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    judged = rows.join(first, "component").select(F.col("row.doc_id").alias("d"), F.col("row.key").alias("k"), "n", (F.col("row") == F.col("first")).alias("stays")).filter("n > 1 OR NOT stays")
    judged = materialize(judged, "minhash-judged")
    own = documents["doc_id"].cast("long")
    of_row = own.eqNullSafe(judged["d"]) & (F.xxhash64(own.cast("string"), documents["text"].cast("string")) == judged["k"])
    single = documents.join(judged, of_row, "left_anti")
    repeated = judged.filter("stays")
    if repeated.isEmpty():
        return single
    return single.union(documents.join(repeated, of_row, "left_semi").dropDuplicates(["doc_id", "text"]))
