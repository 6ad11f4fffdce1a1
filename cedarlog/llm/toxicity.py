"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Features are the presence of lower-cased byte n-grams inside a text, hashed to a fixed number of slots. A slot's ratio
r = log((p / |p|) / (q / |q|)) compares how often toxic and other training texts hold it; the classifier's inputs are the
present slots' ratios, of which logistic regression weighs each one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discard, give_back, ids_back, materialize

SIZES = (3, 4, 5, 6)
SLOTS = 1 << 21
#: Most labelled rows that the classifier is fitted on (those of least hash; all labelled rows if there are fewer).
FIT_BOUND = 20_000
#: A slot is used if that many fitting texts hold it, in the order of the likelihood ratio statistic of it and the label,
#: until the used slots make that many entries for each fitting text on average. No least statistic: it grows with the labels.
LEAST_TEXTS, ENTRIES = 3, 30
FOLDS = 5


def _grams(data: np.ndarray, sizes: tuple[int, ...], slots: int):
    """For each size, the slot of the n-gram that starts at each byte."""
    x = data.astype(np.uint64)
    key = x.copy()
    for n in range(2, max(sizes) + 1):
        if len(x) < n:
            return
        key = (key[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :]
        if n in sizes:
            h = (key + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
            yield (h >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


def _bytes(text: str | None) -> np.ndarray:
    """Lower-cased bytes with white space as single spaces and one at either end."""
    return np.frombuffer(b" " + b" ".join((text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()) + b" ", dtype=np.uint8)


def _present(text: str | None, sizes, slots) -> np.ndarray:
    found = list(_grams(_bytes(text), sizes, slots))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def _counts(sizes, slots):
    """Per task: how many texts, and how many toxic ones, hold each slot."""

    def run(batches):
        n = np.zeros((2, slots), dtype=np.int32)
        texts = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                n[int(toxic)][_present(text, sizes, slots)] += 1
                texts[int(toxic)] += 1
        at = np.flatnonzero(n[0] + n[1])
        yield pd.DataFrame({"slot": np.append(at, -1), "clean": np.append(n[0][at], texts[0]), "toxic": np.append(n[1][at], texts[1])})

    return run


def _rows(sizes, slots, chosen: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [np.searchsorted(chosen, x[np.isin(x, chosen, assume_unique=True)]) for x in (_present(t, sizes, slots) for t in batch["text"])]
            yield pd.DataFrame({"toxic": batch["toxic"], "at": [x.astype("<i4").tobytes() for x in found]})

    return run


def _logistic(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, rounds: int = 200, l2: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and a bias, by full-batch Adam on the log loss."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    col = np.concatenate([*rows, np.empty(0, dtype="<i4")])
    w, b = np.zeros(len(r)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, n = np.zeros(len(r) + 1), np.zeros(len(r) + 1), max(1, len(y))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, (w * r)[col], len(rows)) + b, -30, 30)))
        g = np.append(np.bincount(col, (p - y)[row], len(r)) * r / n + l2 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * r, b


class ToxicityModel:
    """Slots in use, their weights (bounded by the number of slots, so a broadcast never grows with the data) and a bias."""

    def __init__(self, sizes, slots, at: np.ndarray, weights: np.ndarray, bias: float):
        self.sizes, self.slots, self.at, self.weights, self.bias = sizes, slots, at, weights, bias

    def scorer(self):
        table = np.zeros(self.slots, dtype=np.float32)
        table[self.at] = self.weights

        def score(text: str | None) -> float:
            total = self.bias
            found = [x[table[x] != 0] for x in _grams(_bytes(text), self.sizes, self.slots)]
            if found:
                total += float(table[np.unique(np.concatenate(found))].sum(dtype=np.float64))
            return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))

        return score


def _association(n0: int, n1: int):
    """Likelihood ratio statistic of columns clean and toxic, counts of texts with a slot among n0 clean and n1 toxic ones."""
    total, out = n0 + n1, F.lit(0.0)
    held = F.col("clean") + F.col("toxic")
    for n, with_it in ((n0, F.col("clean")), (n1, F.col("toxic"))):
        for seen, margin in ((with_it, held), (n - with_it, total - held)):
            out = out + F.when(seen > 0, 2 * seen * F.log(seen * total / (margin * n))).otherwise(0.0)
    return out


def fit_toxicity(documents: DataFrame, labels: DataFrame, bound: int = FIT_BOUND, sizes=SIZES, slots: int = SLOTS, folds: int = FOLDS) -> ToxicityModel:
    """Fits on labelled rows outside fold 0 of crc32(doc_id) mod ``folds``, at most ``bound`` of them, least hash first; rows
    that are equal in id and text count once.

    Null ids, texts or labels teach nothing; a document with several labels is toxic if any says so. The driver gets
    the slots that rank first, at most ``ENTRIES`` / ``LEAST_TEXTS`` for each of at most ``bound`` texts, and ``ENTRIES``
    places of used slots for each text on average."""
    known = labels.filter(f"toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS string)) % {folds} != 0")
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    own = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # an id may have many rows: one for each of its texts, and of these at most ``bound``, are taken, by hashes first
    taken = own.join(F.broadcast(known), "doc_id").select("doc_id", "h", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(bound)
    taken = materialize(taken, "toxicity-ids")
    texts = materialize(own.join(F.broadcast(taken), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-texts")
    discard(taken)
    counts = materialize(texts.mapInPandas(_counts(sizes, slots), "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    total = counts.filter("slot < 0").first()
    n0, n1 = (total["clean"], total["toxic"]) if total else (0, 0)
    if not n0 or not n1:
        discard(texts)
        return ToxicityModel(sizes, slots, np.empty(0, dtype=np.int64), np.empty(0), float(np.log((n1 + 1) / (n0 + 1))))
    p, q = (F.col("toxic") + 1) / (n1 + 2), (F.col("clean") + 1) / (n0 + 2)
    held, entries = F.col("toxic") + F.col("clean"), ENTRIES * (n0 + n1)
    ranked = counts.filter("slot >= 0").filter(held >= LEAST_TEXTS).select("slot", held.alias("held"), F.log(p / q).alias("r"), F.round(_association(n0, n1), 9).alias("rank"))
    # whole bands of the statistic while their entries fit, then the first slots of the next band; only these come to the driver
    band, left, cut = F.floor(F.log1p(F.greatest("rank", F.lit(0.0))) * 64), entries, None
    for row in sorted(ranked.groupBy(band.alias("band")).agg(F.sum("held").alias("held")).collect(), key=lambda r: -r["band"]):
        cut = row["band"]
        if row["held"] > left:
            break
        left -= row["held"]
    chosen = pd.DataFrame({"slot": [], "held": [], "r": [], "rank": []})
    if cut is not None:
        whole, part = ranked.filter(band > cut), ranked.filter(band == cut).orderBy(F.desc("rank"), "slot").limit(max(1, left // LEAST_TEXTS))
        chosen = pd.concat([whole.toArrow().to_pandas(), part.toArrow().to_pandas()]).sort_values(["rank", "slot"], ascending=[False, True])
        chosen = chosen[chosen["held"].cumsum() <= entries].sort_values("slot")
    discard(counts)
    at = chosen["slot"].to_numpy(dtype=np.int64)
    rows = texts.mapInPandas(_rows(sizes, slots, at), "toxic int, at binary").toArrow().to_pandas()
    weights, bias = _logistic([np.frombuffer(x, dtype="<i4") for x in rows["at"]], rows["toxic"].to_numpy(dtype=float), chosen["r"].to_numpy())
    discard(texts)
    del rows, chosen
    give_back()  # what the fit held would stay with the driver for the later stages
    return ToxicityModel(sizes, slots, at, weights, bias)


def _score(model: ToxicityModel):
    def run(batches):
        score = model.scorer()
        for batch in batches:
            yield batch.drop(columns="text").assign(score=[score(t) for t in batch["text"]])

    return run


def score_toxicity(documents: DataFrame, model: ToxicityModel, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``documents``; whole texts, no shuffle.

    Null and empty texts get the score of a text without features; a null id is not held out; repeated rows give
    repeated results; other columns are not read."""
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.expr(f"coalesce(crc32(CAST(doc_id AS string)) % {folds} = 0, false)").alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = ids_back(rows.mapInPandas(_score(model), "doc_id string, held_out boolean, score double"), "doc_id")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def remove_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose score is below ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for part in texts:
            yield part.map(one, na_action=None).astype(float)

    return documents.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)
