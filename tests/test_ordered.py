"""Places inside groups that may hold any share of the rows."""

import random

import numpy as np
import pytest

from voltsheaf.functions import kernels
from voltsheaf.operators import stats
from voltsheaf.plans import kernels as K


@pytest.fixture()
def hot(spark):
    """One group of most rows, in it one value of most rows; NULL groups and values, NaN, a group of one."""
    rng = random.Random(5)
    rows = [("hot", 1.5) for _ in range(900)] + [("hot", round(rng.gauss(0, 1), 2)) for _ in range(300)]
    rows += [(None, float(i % 7)) for i in range(20)] + [("one", 3.0), ("one", None), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(4), rows


def expected(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {(g, i): (v, len(vs)) for g, vs in groups.items() for i, v in enumerate(sorted(vs, key=lambda v: (v != v, v)), 1)}


@pytest.mark.parametrize("piece", (7, 1 << 16))
def test_ordered_is_a_sort_of_each_group(hot, monkeypatch, piece):
    monkeypatch.setattr(stats, "PIECE_ROWS", piece)
    df, rows = hot
    got = stats.ordered(df, "v", ["g"]).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        v, n = want[r.g, r["__i"]]
        assert r["__n"] == n and (r.v == v or r.v != r.v and v != v)


def test_no_window_holds_a_group(hot):
    df, _ = hot
    for out in (stats.quantile_points(df, "v", ["g"]), K.shapiro_by_bins(df.selectExpr("g as response", "v as covariate", "v as z"), "response", "covariate", "z", 3)):
        plan = out._jdf.queryExecution().analyzed().toString()
        for line in plan.splitlines():
            if "Window " in line:
                # per range of the order, or over the sums of ranges
                assert "__range" in line, line


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert stats.ordered(df, "v", ["g"]).collect() == [] and stats.quantile_points(df, "v", ["g"]).collect() == []


def test_shapiro_of_a_hot_bin(spark):
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=1500), 2)
    rows = [("a", 0.1, float(v)) for v in z] + [("a", 0.9, float(v)) for v in z[:40]] + [("a", 1.0, 0.0), ("a", 0.0, None)]
    got = K.shapiro_by_bins(spark.createDataFrame(rows, "response string, covariate double, z double"), "response", "covariate", "z", 2, True).first()
    want = np.mean([kernels.shapiro_w(z), kernels.shapiro_w(np.r_[z[:40], 0.0])])
    assert got.n_bins == 2 and abs(got.w - want) < 1e-9


def test_split_r_hat_of_one_long_chain(spark):
    rng = np.random.default_rng(9)
    rows = [("p", c, d, float(rng.normal() + c)) for c, n in ((0, 1201), (1, 8)) for d in range(n)]
    rng.shuffle(rows)
    rows = [(p, int(c), int(d), float(v)) for p, c, d, v in rows]
    got = stats.split_r_hat(spark.createDataFrame(rows, "p string, c int, d int, v double").repartition(3), ["p"], "c", "d", "v").first()
    halves = []
    for c in (0, 1):
        v = [x[3] for x in sorted(rows, key=lambda r: r[2]) if x[1] == c]
        halves += [v[: len(v) // 2], v[len(v) // 2 :]]
    n, within, between = np.mean([len(h) for h in halves]), np.mean([np.var(h, ddof=1) for h in halves]), np.var([np.mean(h) for h in halves], ddof=1)
    assert got.n_chains == 4 and abs(got.r_hat - np.sqrt(((n - 1) / n * within + between) / within)) < 1e-9
