"""Language-model scores do not depend on how pairs are dealt to tasks: many symbols, several scripts, several layouts."""

import random
import zlib

import numpy as np
import pytest

from cedarlog.llm import lm_score, ppm
from cedarlog.llm.common import LOWER_BYTES
from tests.llm.test_llm import frame, ppm_brute

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèçñ0123456789.,;:!?()[]+-*/=<>%&#@жзиклмнопрст日本語の文字列"


def texts(seed=1, n=90):
    """Short texts over about 80 letters, in which most pairs of bytes are rare and some contexts are shared by all."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        own = rng.sample(LETTERS, 25)
        out.append("".join(rng.choice(own if rng.random() < 0.8 else LETTERS) for _ in range(rng.randint(0, 90))))
    return [*out, "", None, "\x00\x01\xff", out[0]]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_groups_alone_equal_all_pairs_together(least):
    data = [ppm.normalise(t) for t in texts()]
    learnt, counts = np.unique(ppm.pack(data[:60])[0], return_counts=True)
    keys = np.union1d(learnt, ppm.pack(data[60:])[0])
    n = np.zeros(len(keys), dtype=np.int64)
    n[np.searchsorted(keys, learnt)] = counts
    low = ppm.low_orders(keys, n, least)
    whole = ppm.code_lengths(keys, n, low)
    assert np.isfinite(whole).all()
    near = (keys >> ppm.BITS) & ((1 << least * ppm.BITS) - 1)
    for group in np.unique(near):
        at = near == group
        assert np.allclose(ppm.code_lengths(keys[at], n[at], low), whole[at], atol=1e-9)
    for text in data[60:75]:
        score = whole[np.searchsorted(keys, ppm.pack([text])[0])].sum()
        assert abs(score - ppm_brute(data[:60], text)) < 1e-6


@pytest.mark.parametrize(("partitions", "low_bound"), [(1, 1 << 22), (7, 1 << 22), (64, 1 << 22), (7, 10)])
def test_scores_at_several_layouts(spark, partitions, low_bound):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    rows = list(enumerate(texts(2, 70)))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(frame(spark, rows), block_bytes=2000, low_bound=low_bound).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    norm = {i: (t or "").encode().translate(LOWER_BYTES) for i, t in rows}
    train = [b for i, b in norm.items() if zlib.crc32(str(i).encode()) % 10]
    assert all(np.isfinite(s) for s in got.values())
    for i, b in norm.items():
        assert abs(got[i] - ppm_brute(train, b)) < 1e-6, i
