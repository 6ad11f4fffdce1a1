"""Clustering, codes and mixing against plain versions of the same definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cedarlog.llm import clustering, mixing, queries, vector_blocks, vector_codes

NAN, INF = float("nan"), float("inf")
DDL = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=300, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    rows = [(i * 7, [float(np.float32(x)) for x in 0.2 * (centres[i % 5] + 0.5 * rng.standard_normal(dims))], None if i % 11 == 0 else i % 4) for i in range(n)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(40)]  # one vector many times
    rows += [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, rows[4][1], None)]  # repeated rows, no id
    odd = [None, [], [0.5] * (dims - 1), [0.5] * (dims - 16), [None] * dims, [NAN] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [INF], [0.0] * dims]
    return rows + [(9000 + i, v, 3) for i, v in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).selectExpr("vec_id", "embedding", "label", "1 AS block", "2 AS cluster", "'x' AS code", "3 AS n").repartition(5)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, scale, dims):
    kept = [(i, np.array([math.floor(scale * x) for x in v], dtype=object)) for i, v, _ in rows if fine(v) and len(v) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), list(r[1])))
    centres = [c for _, c in order[:k]]
    for last in [False] * rounds + [True]:
        own = [min((int(sum((x - c) ** 2)), j) for j, c in enumerate(centres)) for _, x in kept]
        if not last:
            for j in range(len(centres)):
                mine = [x for (_, x), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    centres[j] = np.array([int(s) // len(mine) for s in sum(mine)], dtype=object)
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, own, strict=True))


@pytest.mark.parametrize(("k", "n"), [(8, 300), (1, 40), (8, 3)])
def test_clusters(spark, k, n):
    rows = vectors(n=n) if n > 3 else vectors()[:3]
    scanned = []
    got = clustering.cluster_vectors(frame(spark, rows), clusters=k, rounds=5, scanned=scanned)
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, k, 5, 1024, 64)
    assert clustering.cluster_vectors(frame(spark, []), clusters=k).count() == 0
    if n == 300:
        assert scanned[0] > scanned[-1]  # bounds spare vectors


def test_a_component_out_of_range_is_an_error(spark):
    rows = [(1, [1e30] + [0.0] * 63, 0), (2, [0.0] * 64, 0)]
    with pytest.raises(ArithmeticError):
        clustering.cluster_vectors(frame(spark, rows))


def test_drift_is_bounded_in_the_plane():
    """No point of the sphere comes nearer to a moved centroid than the bound allows, and the bound is below the full drift."""
    rng, spared = np.random.default_rng(1), 0
    for _ in range(60):
        k, dims = int(rng.integers(2, 6)), int(rng.integers(1, 6))
        old = rng.integers(-100, 100, (k, dims))
        new = old + rng.integers(-30, 31, (k, dims))
        radius = rng.random(k) * 120
        looser = clustering.loosening(old, new, radius)
        for i in range(k):
            ray = rng.standard_normal((400, dims))
            x = old[i] + ray / np.linalg.norm(ray, axis=1, keepdims=True) * radius[i] * rng.random((400, 1)) ** (1 / dims)
            other = [j for j in range(k) if j != i]
            before = np.min([np.linalg.norm(x - old[j], axis=1) for j in other], axis=0)
            after = np.min([np.linalg.norm(x - new[j], axis=1) for j in other], axis=0)
            assert (before - after <= looser[i] + 1e-9).all()
            drift = max(np.linalg.norm(new[j] - old[j]) for j in other)
            assert looser[i] <= drift + 1e-4
            spared += looser[i] < 0.9 * drift
    assert spared > 50


def plain_codes(rows, parts, entries, rounds, scale):
    usable = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if fine(v) and v and len(v) % parts == 0]
    by = sorted(usable, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(by[0][1])
    by = [r for r in by if len(r[1]) == dims]
    w = dims // parts
    books = [[r[1][p * w : (p + 1) * w] for r in by[:entries]] for p in range(parts)]
    for last in [False] * rounds + [True]:
        codes = []
        for _, v, _ in by:
            codes.append([min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)])
        if not last:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [v[p * w : (p + 1) * w] for (_, v, _), c in zip(by, codes, strict=True) if c[p][1] == j]
                    if mine:
                        books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors, labels = [sum(d for d, _ in c) for c in codes], Counter()
    for (_, _, label), e in zip(by, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{j:02x}" for _, j in c), e, labels[label], digest) for (i, _, label), c, e in zip(by, codes, errors, strict=True))


@pytest.mark.parametrize(("entries", "rounds", "n"), [(64, 2, 150), (8, 6, 150), (64, 1, 5)])
def test_codes(spark, entries, rounds, n):
    rows = vectors(seed=5, n=n, dims=32)
    compared = []
    got = vector_codes.compress_vectors(frame(spark, rows), entries=entries, rounds=rounds, compared=compared)
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(rows, 16, entries, rounds, 256)
    assert vector_codes.compress_vectors(frame(spark, [])).count() == 0
    if rounds == 6:
        assert compared[-1] < compared[0]


def test_active_entries_equal_a_whole_scan():
    """With many ties: whole numbers from a small range, entries that repeat, some that move."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        x, book = rng.integers(-2, 3, (200, 2)), rng.integers(-2, 3, (12, 2))
        at, away, _ = vector_codes.nearest(x, book, None, None, None)
        moved = rng.random(12) < 0.3
        after = book + np.where(moved[:, None], rng.integers(-1, 2, (12, 2)), 0)
        moved = (after != book).any(axis=1)
        want, far, _ = vector_codes.nearest(x, after, None, None, None)
        got, near, _ = vector_codes.nearest(x, after, moved, at, away)
        assert (got == want).all() and (near == far).all()


def test_exact_distances_of_large_components():
    x = np.array([[vector_blocks.LARGEST, -vector_blocks.LARGEST]], dtype=np.int64)
    assert vector_blocks.squared(x, -x)[0, 0] == 2 * (2 * vector_blocks.LARGEST) ** 2


def documents(seed=4, n=900):
    rng = random.Random(seed)
    rows = [(i, None if i % 50 == 0 else " ".join("w" for _ in range(int(rng.paretovariate(1.1) * 5) % 4000)), rng.choice(["a", "a", "b", "ä", "Z", "", None, "😀", "z"])) for i in range(n)]
    rows += [(10_000 + i, "one two three four", "hot") for i in range(1500)]  # a class of equal sizes
    rows += [(3, "x y", "b"), (3, "x y", "b"), (None, "x y   z\x0b\x0cq", "b"), (None, None, None), (20_000, "tiny", "lone"), (20_001, " \n ", "blank"), (20_002, "word " * 30_000, "long")]
    return rows


def mix_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS n", "'x' AS h", "3 AS copies", "4 AS target").repartition(6)


def full(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; full sources give the rest back, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, target, closed = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, set()
    left = sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in closed]
        target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if target[s] >= most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            closed.add(s)


def test_mix(spark):
    rows = documents()
    got = mixing.mix(mix_frame(spark, rows)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, count(t)) for i, t, _ in rows)
    sizes, taken, of = Counter(), Counter(), defaultdict(set)
    for i, t, s in rows:
        sizes[s] += count(t)
        of[i, count(t)].add(s)
    want = full(sizes)
    rates = defaultdict(set)
    for r in got:
        s = min(of[r["doc_id"], r["size"]], key=lambda s: abs(want[s] - r["target"]))
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-12)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        rates[s, r["size"]].add(r["copies"])
        if r["size"] and 0 < want[s] < 3 * sizes[s]:
            assert 0 < r["rate"] <= 3
    assert all(max(x) - min(x) <= 1 for x in rates.values())  # equal documents are treated alike
    for s in sizes:
        if s not in ("long", "lone"):  # a single document can only be taken whole times
            assert abs(taken[s] - want[s]) <= max(20, 0.002 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(mix_frame(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(mix_frame(spark, [])).count() == 0
    assert [tuple(r)[:5] for r in mixing.mix(mix_frame(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_rates_are_tilted_to_the_target(spark):
    """Rates are min(3, exp(tilt * size)) with one tilt for a source, and their words are its target."""
    rows = documents(seed=9)
    per = defaultdict(list)
    for r in mixing.mix(mix_frame(spark, rows)).collect():
        per[r["target"], r["source_size"]].append(r)
    for (target, _), mine in per.items():
        mine = [r for r in mine if r["size"]]
        if not mine or target >= 3 * mine[0]["source_size"]:
            continue
        assert math.isclose(sum(r["rate"] * r["size"] for r in mine), target, rel_tol=1e-6)
        tilt = [math.log(r["rate"]) / r["size"] for r in mine if 1e-200 < r["rate"] < 3]
        assert max(tilt) - min(tilt) <= 1e-9 * max(1e-6, abs(tilt[0]))


def test_mix_equals_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in documents() if r[0] is not None and r[0] != 3]
    mix_frame(spark, rows).select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES["op13_mixing"])
    names = [c[0] for c in cur.description]
    df = queries.op13_mixing(spark, str(tmp_path))
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.collect()) == theirs


def test_places_over_ranges(spark):
    rows = [(random.Random(i).random(),) for i in range(500)]
    got = mixing.numbered(spark.createDataFrame(rows, "x double").repartition(7), "x").collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["place"])] == sorted(x for (x,) in rows) and sorted(r["place"] for r in got) == list(range(500))
