"""Benchmark decontamination with DataFrame functions only.

The hash set of all benchmark windows (13 consecutive normalised words; a shorter item is one window) goes to every
task; each document's word windows are hashed and looked up in its own row, and hits are then verified by their words
in a join with the windows. Documents without hits are never shuffled, and texts are not either. What a window brings
into the joins is one identifier of the set of items that hold it; items are listed once for each combination of sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: What parts words, after lower-casing (splitting is many times faster than extracting all matches).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Most distinct windows that go to every task as a set of hashes in the plan; beyond it windows are looked up in a join.
SET_BOUND = 50_000
#: Most windows whose hashes (16 bytes each), and most bytes of windows, that such a join sends to every task.
HASH_BOUND, BYTES_BOUND = 2_000_000, 32 << 20
SPOTS = "array<struct<pos:int,len:int,gram:string>>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, len, h, items, owner): each distinct window with its length in words, its hash, the items that hold it in
    order, and an identifier of these items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("words")).filter("size(words) > 0 AND item IS NOT NULL")
    grams = items.selectExpr("item", f"explode(IF(size(words) < {window}, array(words), transform(sequence(1, greatest(1, size(words) - {window - 1})), i -> slice(words, i, {window})))) AS w")
    held = grams.groupBy(F.array_join("w", " ").alias("gram"), F.size("w").alias("len"), F.xxhash64("w").alias("h")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return held.withColumn("owner", F.sha2(F.to_json("items"), 256))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns. Rows are known by id and text, so rows
    without an id and repeated rows are judged too, and alike. Only keys of contaminated rows are joined with texts."""
    found = contamination(documents.select("doc_id", "text"), benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("id"), F.col("key").alias("hash")).distinct()
    return documents.join(found, documents["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(documents["text"]) == found["hash"]), "left_anti")


def _spot(n: int) -> str:
    return f"named_struct('pos', i, 'len', {n}, 'gram', array_join(slice(words, i, {n}), ' '))"


def _looked_up(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` with hits: the windows of each document whose hash is in the set of all benchmark windows' hashes."""
    each = []
    for n in lengths:
        # three words of a window are looked up first: cheaper than all of them, and nearly as rare
        hashes, probe = f"xxhash64(slice(words, i, {n}))", f"xxhash64(get(words, i - 1), get(words, i + {n // 2 - 1}), get(words, i + {n - 2}))"
        own = grams.filter(F.col("len") == n).selectExpr("h", "split(gram, ' ') AS words", "1 AS i").selectExpr("h", f"{probe} AS probe").collect()
        probes, known = (", ".join(f"CAST('{x}' AS bigint)" for x in sorted(set(col))) for col in zip(*((r["probe"], r["h"]) for r in own), strict=True))
        at = f"filter(filter(sequence(1, size(words) - {n - 1}), i -> {probe} IN ({probes})), i -> {hashes} IN ({known}))"
        each.append(f"IF(size(words) < {n}, array(), transform({at}, i -> {_spot(n)}))")
    return docs.selectExpr("doc_id", "key", "CAST(size(words) AS bigint) AS n_words", f"CAST({f'concat({", ".join(each)})' if each else 'array()'} AS {SPOTS}) AS hits")


def _joined(docs: DataFrame, grams: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """(doc_id, key, pos, len, gram): as ``_looked_up`` finds them, by a join of all windows' hashes; for more windows than a set
    in the plan may hold. Only texts with hits are read again, by id and text, as equal rows have equal hits."""
    each = ", ".join(f"IF(size(words) < {n}, array(), transform(sequence(1, size(words) - {n - 1}), i -> named_struct('pos', i, 'len', {n}, 'h', xxhash64(slice(words, i, {n})))))" for n in lengths)
    windows = docs.select("doc_id", "key", F.explode(F.expr(f"concat({each})")).alias("w")).select("doc_id", "key", "w.*")
    known = grams.select("h", "len").distinct()
    near = windows.join(F.broadcast(known) if few else known, ["h", "len"], "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "len")).alias("near"))
    texts = docs.withColumnsRenamed({"doc_id": "d", "key": "k"})
    both = near.join(texts, near["doc_id"].eqNullSafe(texts["d"]) & (near["key"] == texts["k"]))
    return both.selectExpr("doc_id", "key", "explode(transform(near, x -> named_struct('pos', x.pos, 'len', x.len, 'gram', array_join(slice(words, x.pos, x.len), ' ')))) AS hit").select("doc_id", "key", "hit.*")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bound: int = SET_BOUND, hash_bound: int = HASH_BOUND) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, key) for each row of ``documents``.

    spans: the merged hit word ranges (first, last; from 1). key: a hash of the text. Null and empty texts have no words and are clean; null
    ids are kept; repeated rows give repeated results; an empty benchmark hits nothing; other columns are not read.
    The windows are counted before they are sent: up to ``set_bound`` of them are a set in the plan, more are joined by
    hash, up to ``hash_bound`` of them without a shuffle of the documents' windows. All ways find the same hits, which are
    then compared word for word."""
    grams = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram") + 96).alias("bytes")).collect()  # ``window`` rows at most
    lengths, total, light = sorted(r["len"] for r in sizes), sum(r["n"] for r in sizes), sum(r["bytes"] for r in sizes) <= BYTES_BOUND
    docs = documents.select("doc_id", F.xxhash64("text").alias("key"), _words(F.col("text")).alias("words"))
    small = total <= set_bound
    if small:
        scanned = materialize(_looked_up(docs, grams, lengths), "benchmark-hits")
        rows, free = scanned.filter("size(hits) > 0"), scanned.filter("size(hits) = 0").select("doc_id", "key", "n_words")
        spots = rows.select("doc_id", "key", F.explode("hits").alias("hit")).select("doc_id", "key", "hit.*")
    else:
        rows, free = docs.selectExpr("doc_id", "key", "CAST(size(words) AS bigint) AS n_words"), None
        spots = _joined(docs, grams, lengths, total <= hash_bound)
    known = grams.select("gram", "len", "owner")
    hits = spots.join(F.broadcast(known) if light else known, ["gram", "len"])
    per = hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "len")).alias("at"), F.sort_array(F.collect_set("owner")).alias("owners"))
    per = per.select("doc_id", "key", F.expr("array_sort(array_distinct(flatten(transform(at, x -> sequence(x.pos, x.pos + x.len - 1)))))").alias("covered"), "owners", F.sha2(F.array_join("owners", ","), 256).alias("combo"))
    per = per.selectExpr(
        "doc_id", "key", "combo", "owners", "CAST(size(covered) AS bigint) AS n_hit",
        "transform(arrays_zip(filter(covered, (x, i) -> i = 0 OR get(covered, i - 1) < x - 1), filter(covered, (x, i) -> i = size(covered) - 1 OR get(covered, i + 1) > x + 1)), s -> named_struct('first', s['0'], 'last', s['1'])) AS spans",
    )
    # items are listed once for each combination of item sets that occurs, however many documents have it
    listed = per.select("combo", "owners").distinct().select("combo", F.explode("owners").alias("owner")).join(grams.select("owner", "items").distinct(), "owner")
    listed = listed.select("combo", F.explode("items").alias("item")).groupBy("combo").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("combo", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = per.join(listed, "combo").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_hit", "n_items", "items_sha256", "spans")
    judged = rows.select("doc_id", "key", "n_words").join(found, rows["doc_id"].eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    judged = judged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("spans", none).alias("spans"),
        "key",
    )
    if free is None:
        return judged
    zero = F.lit(0).cast("long")
    return judged.union(free.select("doc_id", "n_words", zero, zero, F.sha2(F.lit(""), 256), F.lit(False), none, "key"))
