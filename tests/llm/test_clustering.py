import hashlib
import math

import numpy as np
import pytest

from voltsheaf.llm import clustering as C


def brute(rows, components, k, rounds, scale=1024):
    """Lloyd's rounds over all distances, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    cents = [list(v) for _, v in start]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        at = [min(range(len(cents)), key=lambda j, v=v: (away(v, cents[j]), j)) for _, v in kept]
        if turn == rounds:
            break
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    dist = [away(v, cents[a]) for (_, v), a in zip(kept, at)]
    per = [sum(d for d, a in zip(dist, at) if a == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, a, d, per[a], sum(dist), sha[a]) for (i, _), a, d in zip(kept, at, dist)), key=str)


def as_rows(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, label int")


@pytest.mark.parametrize("seed,k,n", [(0, 8, 400), (1, 3, 50), (2, 8, 9), (3, 20, 300)])
def test_equals_all_distances(spark, seed, k, n):
    rng = np.random.default_rng(seed)
    rows = [(i, v) for i, v in enumerate((np.round(rng.normal(size=(n, 4)) * 4) / (1 if seed % 2 else 64)).tolist())]  # coarse: many ties
    assert as_rows(C.clusters(made(spark, rows), components=4, k=k, rounds=6)) == brute(rows, 4, k, 6)


def test_odd_rows(spark):
    good = [[float(i % 3), 0.25 * i] for i in range(20)]
    rows = list(enumerate(good)) + [(3, [5.0, 5.0]), (3, [5.0, 5.0]), (None, [1.0, 1.0]), (50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [1.0, float("nan")]), (55, [float("inf"), 1.0]), (56, [1.0, 2.0, 3.0])]
    assert as_rows(C.clusters(made(spark, rows), components=2, k=4, rounds=5)) == brute(rows, 2, 4, 5)
    assert as_rows(C.clusters(made(spark, rows).limit(0), components=2)) == []
    assert len(C.clusters(made(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0])]), components=2).collect()) == 1  # no distance in 64 bits
    same = [(i, [1.0, 2.0]) for i in range(30)]  # equal centroids: the first takes all
    assert as_rows(C.clusters(made(spark, same), components=2, k=4, rounds=3)) == brute(same, 2, 4, 3)


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-C.MOST, C.MOST, (30, 64)), rng.integers(-C.MOST, C.MOST, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert C.squared(x, c).tolist() == want


def test_bounds_spare_comparisons():
    """Clear groups: after some rounds hardly a vector is compared, and the result stays that of all distances."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    now, before = x[:40].copy(), None
    cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    used = []
    for _ in range(8):
        used.append(C.Centroids(now, before).search(x, cluster, upper, lower))
        assert (cluster == C.squared(x, now).argmin(1)).all()
        before = now
        now = np.array([x[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else now[j] for j in range(40)])
    assert used[-1] < 0.15 * 40 * len(x)
