"""Scores of texts under a byte model (prediction by partial matching) and a word model, both learned from the corpus.

The trie is never held whole by anything: texts are dealt into blocks of bounded size by their place in the input; a
block asks for its distinct (context, symbol) pairs and words, with its own training counts of them; the counts are
summed over all blocks; probabilities are worked out for pairs that share their nearest three bytes together; and each
block gets back exactly what it asked for. So traffic grows in proportion to the input, and no part with the model.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ppm
from .common import discard, give_back, ids_back, materialize

FOLDS = 10
#: Bytes of text in a block, about.
BLOCK = 32 << 20
CHUNK = 1 << 20
#: Bytes of text that are scored at a time.
SCORED = 1 << 18
#: Pairs whose values are worked out at a time, about; most counts of three bytes that go to every task (16 bytes each).
LOOKED_UP, LOW_BOUND = 200_000, 4_000_000
#: Times that many bytes make a block heavy.
HEAVY = 3
END = b" "  # no word has a space


def _word_keys(words) -> np.ndarray:
    """Words as negative numbers (packed pairs are not negative): 63 bits of a hash."""
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64) | np.uint64(1 << 63)).view(np.int64)


class _WordKeys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        k = self[word] = (xxhash.xxh64_intdigest(word) | 1 << 63) - (1 << 64)
        return k


class Lookup:
    """Vectorised open addressing from int64 keys to values."""

    EMPTY = np.int64(-(2**63))

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (len(keys) * 5 // 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.EMPTY), np.zeros(1 << self.bits)
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == self.EMPTY]
            self.keys[slot[free]] = keys[free]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.values[slot] = values

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        rest = np.flatnonzero(self.keys[slot] != keys)
        while len(rest):
            if (self.keys[slot[rest]] == self.EMPTY).any():
                raise KeyError("a key that its block did not ask for")
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            rest = rest[self.keys[slot[rest]] != keys[rest]]
        return self.values[slot]


class _Asked:
    """Distinct pairs and words of one block, with training counts."""

    def __init__(self, order: int):
        self.order, self.words, self.parts = order, Counter(), []
        self.held, self.size = {False: [], True: []}, 0

    def add(self, data: bytes, held_out: bool) -> None:
        words = data.split()
        if held_out:
            for w in (*words, END):
                if w not in self.words:
                    self.words[w] = 0
        else:
            self.words.update(words)
            self.words[END] += 1
        self.held[held_out].append(data)
        self.size += len(data)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        for held_out, texts in self.held.items():
            if texts:
                keys, n = np.unique(ppm.pack(texts, self.order)[0], return_counts=True)
                self.parts.append((keys, n * (not held_out)))
        self.held, self.size = {False: [], True: []}, 0
        if sum(len(k) for k, _ in self.parts[1:]) > 1_500_000:
            self.merge()

    def merge(self) -> None:
        keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        self.parts = []
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], np.add.reduceat(n, first))]

    def frames(self, block: int):
        self.flush()
        if self.parts:
            self.merge()
            yield from self._cut(block, *self.parts[0])
        yield from self._cut(block, _word_keys(self.words), np.fromiter(self.words.values(), dtype=np.int64))

    @staticmethod
    def _cut(block, keys, n):
        for at in range(0, len(keys), 200_000):
            yield pd.DataFrame({"block": block, "key": keys[at : at + 200_000], "n": n[at : at + 200_000]})


def _ask(order: int):
    def run(batches):
        block, asked = None, None
        for batch in batches:
            for b, held_out, text in zip(batch["block"], batch["held_out"], batch["text"], strict=True):
                if b != block:
                    if asked:
                        yield from asked.frames(block)
                    block, asked = b, _Asked(order)
                asked.add(ppm.normalise(text), bool(held_out))
        if asked:
            yield from asked.frames(block)
        del asked
        give_back()

    return run


def _lengths(order: int, low: ppm.LowOrders):
    """Values of pairs that come sorted by their nearest bytes, some hundred thousand at a time; only pairs that share all of
    these bytes have to come together."""

    def frame(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        keys = rows["key"].to_numpy()
        return pd.DataFrame({"key": keys, "value": ppm.code_lengths(keys, rows["n"].to_numpy(), low, order)})

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            near = (batch["key"].to_numpy() >> ppm.BITS) & (1 << low.least * ppm.BITS) - 1
            start = int(np.searchsorted(near, near[-1]))  # of the group that may go on
            if start or near[0] != last:
                if start:
                    held.append(batch.iloc[:start])
                    size += start
                if held and size >= LOOKED_UP:
                    yield frame(held)
                    held, size = [], 0
            held.append(batch.iloc[start:])
            size, last = size + len(near) - start, near[-1]
        if held:
            yield frame(held)
        del held
        give_back()

    return run


def _score(order: int, tokens: int, kinds: int):
    def run(docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        model = Lookup(got["key"].to_numpy(), got["value"].to_numpy())  # of pairs and of words, whose keys are negative
        del got
        known, scale = _WordKeys(), tokens + 0.1 * (kinds + 1)
        out, held, size = [], [], 0

        def flush() -> None:
            keys, sizes = ppm.pack(held, order)
            scores = np.add.reduceat(model.get(keys), np.cumsum(sizes) - sizes)
            for data, score in zip(held, scores, strict=True):
                found = data.split()
                c = model.get(np.fromiter(map(known.__getitem__, (*found, END)), dtype=np.int64, count=len(found) + 1))
                out.append((len(c), int((c > 0).sum()), float(np.log10((c + 0.1) / scale).sum()), float(score)))
            held.clear()

        for text in docs["text"]:
            held.append(ppm.normalise(text))
            size += len(held[-1])
            if size >= SCORED:
                flush()
                size = 0
        if held:
            flush()
        del model
        give_back()
        scored = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "held_out": docs["held_out"].to_numpy(), "n_tokens": scored["n_tokens"], "n_known": scored["n_known"], "train_tokens": tokens, "base_score": scored["base_score"], "score": scored["score"]})

    return run


def _blocks(documents: DataFrame, block_bytes: int) -> DataFrame:
    """``documents`` (doc_id, text) with a number of the block that a row is dealt to, by its place in its file.

    A block spans as many places as hold ``block_bytes`` on average. Blocks in which much more lies (a run of long texts) are
    found by a first look at the sizes and cut into as many as it takes; a single text is never cut."""
    try:
        documents.select("_metadata.row_index")
    except AnalysisException:  # not a plain scan of files: only those know a row's place
        documents = materialize(documents.select("doc_id", "text"), "lm-texts")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    total = documents.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    span = max(1, total["n"] * block_bytes // max(1, total["bytes"] or 0))
    place, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    rows = documents.select("doc_id", "text", F.xxhash64(file, F.floor(place / span)).alias("block"), (place % span).alias("at"))
    heavy = rows.groupBy("block").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > HEAVY * block_bytes).select("block", F.greatest(F.lit(1), F.floor(F.lit(span * block_bytes // 2) / F.col("bytes"))).alias("part"))
    heavy = materialize(heavy, "lm-heavy")
    if not heavy.isEmpty():  # a block each for every HEAVY * block_bytes of text at most
        rows = rows.join(heavy, "block", "left").withColumn("block", F.when(F.col("part").isNull(), F.col("block")).otherwise(F.xxhash64("block", F.floor(F.col("at") / F.col("part")))))
    return rows.select("doc_id", "text", "block")


def score_texts(documents: DataFrame, order: int = ppm.ORDER, folds: int = FOLDS, block_bytes: int = BLOCK, low_bound: int = LOW_BOUND) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``documents``.

    Texts are modelled lower-cased (A-Z), as words are, and with their end. Rows whose crc32(doc_id as text) mod
    ``folds`` is 0 teach nothing. Null texts are empty; a null id is not held out; repeated rows count as often as they
    occur; an empty table gives an empty result; other columns are not read. The driver gets two totals and the counts of
    the lowest orders, which go to every task: of three bytes if there are at most ``low_bound`` of them (they are counted
    first), else of two, of which there are SYMBOLS squared at most; both give the same values."""
    rows = _blocks(documents.select("*"), block_bytes).select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
        "block",
    )
    asked = materialize(rows.select("block", "held_out", "text").mapInPandas(_ask(order), "block long, key long, n long"), "lm-asked")
    summed = materialize(asked.groupBy("key").agg(F.sum("n").alias("n")), "lm-summed")
    total = summed.filter("key < 0").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    pairs = summed.filter("key >= 0")
    least = min(3, order)
    counts = materialize(pairs.groupBy(F.col("key").bitwiseAND(ppm.mask(least - 1)).alias("key")).agg(F.sum("n").alias("n")), "lm-low")
    if counts.count() > low_bound and least > 2:
        least = 2
        counts = counts.groupBy(F.col("key").bitwiseAND(ppm.mask(least - 1)).alias("key")).agg(F.sum("n").alias("n"))
    low = counts.toArrow()
    low = ppm.low_orders(low["key"].to_numpy(), low["n"].to_numpy(), least)
    near = F.shiftright("key", ppm.BITS).bitwiseAND((1 << least * ppm.BITS) - 1)
    lengths = pairs.select("key", "n").repartition(near).sortWithinPartitions(near).mapInPandas(_lengths(order, low), "key long, value double")
    values = materialize(lengths.union(summed.filter("key < 0").select("key", F.col("n").cast("double"))), "lm-values")
    discard(summed)
    given = asked.select("block", "key").join(values, "key").select("block", "key", "value")
    result = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ids_back(rows.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(_score(order, total["n"] or 0, total["kinds"] or 0), result), "doc_id")
