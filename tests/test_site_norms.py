import numpy as np
import pytest

from voltsheaf.operators import site_norms as S

ROWS = "response string, site string, age double, y double"


def dense(y, x, site, form, rounds=30):
    """The same posterior on one dense problem: Newton rounds with numeric second derivatives."""
    names = sorted(set(site))
    col = np.array([names.index(s) for s in site])
    c, k = form.width - 2, len(names)
    prior = np.concatenate([np.full(c - 2 * form.shape, form.ridge), np.full(2 * form.shape, form.shape_prior), np.full(k, form.site_mean), np.full(k, form.site_spread)])

    def value_and_slope(t):
        u, v = t[c : c + k][col], t[c + k :][col]
        ll, h = S.row_scores(form, y, x, np.tile(t[:c], (len(y), 1)), u, v)
        g = np.zeros_like(t)
        g[:c] = h[:, :c].sum(0)
        np.add.at(g, c + col, h[:, -2])
        np.add.at(g, c + k + col, h[:, -1])
        return ll.sum() - 0.5 * (prior * t * t).sum(), g - prior * t

    t = np.zeros(c + 2 * k)
    for _ in range(rounds):
        f, g = value_and_slope(t)
        if np.abs(g).max() < 1e-5:
            break
        eps = 1e-5
        hess = np.stack([(value_and_slope(t + eps * d)[1] - value_and_slope(t - eps * d)[1]) / (2 * eps) for d in np.eye(len(t))])
        a, b = np.linalg.eigh(-(hess + hess.T) / 2)
        step = b @ ((b.T @ g) / np.maximum(np.abs(a), 1e-3))
        share = 1.0
        while value_and_slope(t + share * step)[0] < f and share > 1e-8:
            share /= 2
        t = t + share * step
    return t, value_and_slope(t)[0]


def cohort(n=600, seed=0, skew=False):
    rng = np.random.default_rng(seed)
    out = []
    for name in ("alpha", "beta"):
        site = rng.choice(["A", "B", "C"], n, p=[0.6, 0.35, 0.05])
        age = rng.uniform(5, 80, n)
        noise = rng.normal(size=n)
        noise = np.sinh((np.arcsinh(noise) + 0.4) / 0.8) if skew else noise
        y = 3 + 0.05 * age + {"alpha": 0.0, "beta": 1.0}[name] + np.array([{"A": 0, "B": 1.5, "C": -1}[s] for s in site]) + noise * np.array([{"A": 1, "B": 2.0, "C": 0.5}[s] for s in site])
        out += [(name, s, float(a), float(v)) for s, a, v in zip(site, age, y)]
    return out


@pytest.mark.parametrize("shape,wave_bytes", [(False, S.WAVE_BYTES), (True, 1)])
def test_fit_equals_the_dense_problem(spark, shape, wave_bytes):
    form = S.Form(shape=shape)
    rows = cohort(skew=shape)
    models = {r.response: r for r in S.fit_site_norms(spark.createDataFrame(rows, ROWS), "age", "site", form, rounds=30, tolerance=1e-4, wave_bytes=wave_bytes).collect()}
    for name in ("alpha", "beta"):
        mine = [r for r in rows if r[0] == name]
        site, x, y = [r[1] for r in mine], np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        t, best = dense((y - y.mean()) / y.std(), (x - x.mean()) / x.std(), site, form)
        m = models[name]
        assert m.n == 600 and abs(m.log_posterior - best) < 1e-2
        got = np.concatenate([m.b, m.g, [m.e, m.log_d] if shape else [], [m.sites[s].u for s in "ABC"], [m.sites[s].v for s in "ABC"]])
        assert np.abs(got - t).max() < 2e-2


def test_scores_are_normal_and_centiles_invert(spark):
    rows = spark.createDataFrame(cohort(3000, 1, True), ROWS)
    models = S.fit_site_norms(rows, "age", "site", S.Form(degree=1, shape=True), rounds=20)
    z = np.array([r.z for r in S.z_scores(S.predicted(rows, models, "age", "site")).collect()])
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05 and abs((z**3).mean()) < 0.2 and abs((z**4).mean() - 3) < 0.6
    cut = S.centiles(S.predicted(rows.limit(50), models, "age", "site"), (0.05, 0.5, 0.95))
    back = S.z_scores(cut.withColumn("y", cut.value)).collect()
    assert all(abs(r.z - {0.05: -1.6448536269514722, 0.5: 0.0, 0.95: 1.6448536269514722}[r.quantile]) < 1e-9 for r in back) and len(back) == 150


def test_small_sites_lean_on_the_others(spark):
    rows = [("r", "big", float(i % 60), float(i % 7)) for i in range(700)] + [("r", "tiny", 30.0, 50.0)]
    models = S.fit_site_norms(spark.createDataFrame(rows, ROWS), "age", "site", S.Form(degree=1, spread_degree=0), rounds=15).first()
    y = np.array([r[3] for r in rows])
    shift = models.sites["tiny"].u * models.y_sd
    assert 0 < shift < 0.95 * (50 - y[:-1].mean())


def test_odd_rows(spark):
    rows = [("r", None, 1.0, 1.0), ("r", None, 2.0, 3.0), ("r", "a", None, 1.0), ("r", "a", 3.0, None), ("r", "a", 3.0, float("nan")), ("r", "a", 4.0, 2.0), (None, "a", 1.0, 1.0), ("flat", "a", 1.0, 5.0), ("flat", "a", 1.0, 5.0)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.response: r for r in S.fit_site_norms(df, "age", "site", S.Form(degree=1), rounds=15).collect()}
    assert set(got) == {"r", "flat"} and got["r"].n == 3 and set(got["r"].sites) == {"", "a"} and got["flat"].y_sd == 1.0
    assert np.isfinite(got["flat"].log_posterior)
    assert S.fit_site_norms(df.limit(0), "age", "site").count() == 0
    new = spark.createDataFrame([("r", "never", 2.0, 1.0)], ROWS)
    assert S.predicted(new, S.fit_site_norms(df, "age", "site", S.Form(degree=1), rounds=3), "age", "site").first().sigma > 0


def test_curve_marks_peak_and_turns(spark):
    m = [("r", 0.0, 1.0, 0.0, 1.0, [0.0, 10.0, -0.1], [0.0], 0.0, 0.0, {"a": (5.0, 0.0), "b": (0.0, 0.0)}, 1, 0.0, 1), ("flat", 0.0, 1.0, 0.0, 1.0, [1.0], [0.0], 0.0, 0.0, {}, 1, 0.0, 1)]
    rows = spark.createDataFrame([("r", "a", 0.0, 1.0), ("r", "a", 100.0, 1.0), ("r", "b", 50.0, 1.0), ("flat", "q", 0.0, 1.0), ("flat", "q", 10.0, 1.0)], ROWS)
    got = S.response_curve(rows, spark.createDataFrame(m, S.MODEL), "age", "site", points=101, upper=80.0).collect()
    r = sorted((g.x, g.value, g.peak, g.lowest, g.turn) for g in got if g.response == "r")
    assert len(r) == 81 and [x for x, _, p, _, _ in r if p] == [50.0] and [x for x, _, _, low, _ in r if low] == [0.0] and [x for x, *_, t in r if t] == [50.0]
    assert max(v for _, v, *_ in r) == 100.0 and min(v for _, v, *_ in r) == 0.0
    assert all(g.value is None and not g.turn for g in got if g.response == "flat")
    raw = S.response_curve(rows, spark.createDataFrame(m, S.MODEL), "age", "site", points=101, upper=80.0, to_percent=False).collect()
    assert {g.value for g in raw if g.response == "flat"} == {1.0} and max(g.value for g in raw if g.response == "r") == pytest.approx(255.0)
