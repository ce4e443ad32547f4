import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltsheaf import config
from voltsheaf.functions import kernels
from voltsheaf.operators import qc, spectral, stats
from voltsheaf.plans import cleaning, extraction
from voltsheaf.plans import kernels as K
from voltsheaf.sources import tables


def test_default_settings_are_the_documented_ones(tmp_path):
    c = config.RunConfig()
    assert c.ratios[0] == ["Theta", "Beta"] and c.ratios[-1] == ["Delta", "Gamma"] and len(c.ratios) == 10
    assert [k for k, on in c.features.items() if on] == ["Offset", "Exponent", "Adjusted_Canonical_Relative_Power", "Adjusted_Canonical_Absolute_Power", "OriginalPSD_Canonical_Relative_Power", "OriginalPSD_Canonical_Absolute_Power", "Adjusted_Band_Ratio", "OriginalPSD_Band_Ratio", "Hemispheric_Asymmetry_index"]
    c.save(f"{tmp_path}/c.json")
    assert config.RunConfig.load(f"{tmp_path}/c.json").features == c.features
    with pytest.raises(ValueError):
        config.RunConfig(features={"Other": True})
    assert json.load(open(f"{tmp_path}/c.json"))["psd_method"] == "welch"


def test_feature_flags_and_missing_peaks(spark):
    f = [float(x) for x in range(1, 61)]
    psd = spark.createDataFrame([("s", "a_lh_1", f, [1.0] * 60), ("s", "a_rh_1", f, [3.0] * 60), ("s", "bad", f, [1.0] * 60)], "subject string, channel string, freqs array<double>, power array<double>")
    kind = "subject string, channel string, offset double, exponent double, r2 double, ap array<double>, peaks array<struct<cf:double,pw:double,bw:double>>"
    models = spark.createDataFrame([("s", "a_lh_1", 1.0, 2.0, 0.9, [-1.0] * 60, [(10.0, 1.0, 2.0), (9.0, 1.0, 3.0), (11.0, float("nan"), 1.0)]), ("s", "a_rh_1", 1.5, 2.0, None, [-1.0] * 60, []), ("s", "bad", 1.0, 1.0, 0.89, [0.0] * 60, [])], kind)
    on = config.RunConfig(features=dict.fromkeys(config.FEATURE_CATEGORIES, True), which_layout=None)
    got = {(r.channel, r.feature, r.band): r.value for r in spectral.features(psd, models, on).collect()}
    assert not any(k[0] == "bad" for k in got)
    assert got["a_lh_1", "Peak_Center", "Alpha"] == 9.0 and got["a_lh_1", "Peak_Width", "Alpha"] == 3.0 and ("a_rh_1", "Peak_Center", "Alpha") not in got
    assert got["a_lh_1", "OriginalPSD_Canonical_Absolute_Power", "Alpha"] == pytest.approx(np.log10(5)) and got["a_lh_1", "OriginalPSD_Canonical_Relative_Power", "Alpha"] == pytest.approx(5 / 37)
    assert got["a_lh_1", "OriginalPSD_Individualized_Absolute_Power", "Alpha"] == pytest.approx(np.log10(5)) and ("a_lh_1", "Adjusted_Individualized_Relative_Power", "Theta") not in got
    assert got["a_lh_1", "Adjusted_Canonical_Absolute_Power", "Alpha"] == pytest.approx(np.log10(4.5))
    assert got["a_lh_vs_rh_1", "Offset", ""] == -0.5 and got["a_lh_1", "OriginalPSD_Band_Ratio", "Theta_over_Alpha"] == 0.0
    few = config.RunConfig(features={"Offset": True}, which_layout=None)
    assert {r.feature for r in spectral.features(psd, models, few).collect()} == {"Offset"}
    assert spectral.features(psd, models, config.RunConfig(features={})).count() == 0


def test_segments_are_rows(spark):
    samples = spark.createDataFrame([("s", "c", i, float(i)) for i in range(25)] + [("t", "c", i, 1.0) for i in range(7)], "subject string, channel string, t_idx long, value double")
    got = sorted((r.subject, r.segment, r.x[0], len(r.x)) for r in K.segments(samples, 10, 5).collect())
    assert got == [("s", 0, 0.0, 10), ("s", 1, 5.0, 10), ("s", 2, 10.0, 10), ("s", 3, 15.0, 10), ("t", 0, 1.0, 7)]


def test_spectra_find_a_tone(spark):
    rng = np.random.default_rng(3)
    x = np.sin(2 * np.pi * 10 * np.arange(3000) / 100) + 0.1 * rng.normal(size=3000)
    samples = spark.createDataFrame([("s", "c", i, float(v)) for i, v in enumerate(x)], "subject string, channel string, t_idx long, value double")
    for df in (K.welch(samples, 100.0), K.multitaper(samples, 100.0), K.irasa(samples, 100.0, (1.0, 40.0))):
        r = df.first()
        assert abs(r.freqs[int(np.argmax(r.power))] - 10.0) < 0.6
    f, p = kernels.welch(x, 100.0)
    assert np.allclose(K.welch(samples, 100.0).first().power, p)
    kept = cleaning.filtered(samples, 100.0, 5.0, 20.0, None, block=10.0).orderBy("t_idx").collect()
    assert len(kept) == 3000 and np.corrcoef([r.value for r in kept][200:-200], np.sin(2 * np.pi * 10 * np.arange(3000) / 100)[200:-200])[0, 1] > 0.99


def test_fits_recover_their_models():
    f = np.arange(1, 61, dtype=float)
    y = 10 ** (1.0 - 1.5 * np.log10(f) + 0.8 * np.exp(-((f - 10) ** 2) / (2 * 1.5**2)) + 0.5 * np.exp(-((f - 25) ** 2) / (2 * 2.0**2)))
    m = kernels.parameterize(f, y)
    assert [round(p["cf"]) for p in m["peaks"]] == [10, 25] and m["r2"] > 0.99
    slopes = kernels.gaussian_slopes(f, np.array([10.0, 0.8, 1.5, 25.0, 0.5, 2.0]))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        p = np.array([10.0, 0.8, 1.5, 25.0, 0.5, 2.0])
        assert np.allclose(slopes[:, k], (kernels.gaussians(f, p + step) - kernels.gaussians(f, p - step)) / 2e-6, atol=1e-6)
    knee = kernels.aperiodic_fit(f, 2.0 - np.log10(20.0 + f**2.0), True)
    assert knee[2] == pytest.approx(2.0, abs=0.05)


def test_normal_functions(spark):
    from math import erfc, sqrt
    from statistics import NormalDist

    p = [1e-12, 1e-6, 0.001, 0.07, 0.3, 0.5, 0.7, 0.93, 0.999999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(stats.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-9)
    z = [0.0, 0.5, -1.96, 2.5, 3.5, 3.6, -8.0, 20.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(stats.two_sided_p(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([erfc(abs(x) / sqrt(2)) for x in z], rel=1e-9, abs=1e-14)


def test_ranks_and_adjusted_p_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(3000) ** 3, 4)
    got = {r.k: r.p_adjusted for r in stats.false_discovery(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "k long, p double"), "p", "k", 20).collect()}
    order = np.lexsort((np.arange(3000), p))
    raw = p[order] * 3000 / np.arange(1, 3001)
    want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert [got[i] for i in order.tolist()] == pytest.approx(want.tolist())
    assert stats.false_discovery(spark.createDataFrame([], "k long, p double"), "p", "k").collect() == []


def test_effective_size_follows_long_memory(spark):
    rng = np.random.default_rng(5)
    x = [0.0]
    for _ in range(1500):
        x.append(0.97 * x[-1] + rng.normal())
    rows = spark.createDataFrame([("a", 0, i, v) for i, v in enumerate(x)] + [("b", 0, i, float(v)) for i, v in enumerate(rng.normal(size=400))], "name string, chain int, draw int, v double")
    got = {r.name: r.ess for r in stats.effective_size(rows, ["name"], "chain", "draw", "v").collect()}
    c = np.array(x) - np.mean(x)
    rho = [float((c[k:] * c[: len(c) - k]).sum() / (c * c).sum()) for k in range(1, 700)]
    stop = next(i for i, r in enumerate(rho) if r <= 0)
    assert stop > 20 and got["a"] == pytest.approx(1501 / (1 + 2 * sum(rho[:stop]))) and got["b"] > 200
    table = {r.name: r for r in stats.convergence(rows, ["name"], "chain", "draw", "v").collect()}
    assert table["b"].r_hat < 1.02 and table["a"].ess_bulk < 100 and table["b"].ess_tail > 50 and table["b"].mcse_sd < 0.1


def test_stated_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", "p", 1.0, 2.0, 3.0, 4, "x")], "model string, parameter string, r_hat double, ess_bulk double, ess_tail double, mcse_sd int, extra string")
    tables.save(df, "diagnostics", f"{tmp_path}/d")
    assert [tuple(r) for r in tables.load(spark, "diagnostics", f"{tmp_path}/d").collect()] == [("m", "p", 1.0, 2.0, 3.0, 4.0)]
    cube = spark.createDataFrame([("r1", 0, 1, 20.0, 0.5, 1.5), ("r2", 1, 1, 20.0, 0.5, 2.5)], "response string, sex int, site int, age double, quantile double, value double")
    tables.save(cube, "quantile_cube", f"{tmp_path}/q")
    assert tables.load(spark, "quantile_cube", f"{tmp_path}/q").filter("response = 'r2'").first().value == 2.5
    with pytest.raises(ValueError):
        tables.save(df, "splits", f"{tmp_path}/s")
    ids = [spark.createDataFrame([(x,)], "subject string") for x in "abc"]
    assert sorted(tuple(r) for r in tables.exclusions(*ids).collect()) == [("a", "failed"), ("b", "missing"), ("c", "quality")]


def test_elbow_of_explained_variance(spark):
    values = [100.0, 60.0, 40.0, 1.0, 0.9, 0.8, 0.7]
    assert kernels.pca_elbow(np.array(values), 2) == 3 and kernels.pca_elbow(np.array(values)) == 30 and kernels.pca_elbow(np.zeros(4)) == 30
    cov = spark.createDataFrame([("s", f"c{i}", f"c{i}", v) for i, v in enumerate(values)] + [("s", "c7", "c7", 0.0)], "subject string, a string, b string, cov double")
    r = qc.covariance_spectrum(cov, ["subject"], least=2).first()
    assert (r["rank"], r.condition, r.components) == (7, None, 3)


def test_models_of_both_methods_in_one_schema(spark):
    rng = np.random.default_rng(7)
    t = np.arange(6000) / 100
    noise = np.cumsum(rng.normal(size=6000)) * 0.05 + rng.normal(size=6000) * 0.5
    x = noise + 2 * np.sin(2 * np.pi * 10 * t)
    samples = spark.createDataFrame([("s", "c", i, float(v)) for i, v in enumerate(x)], "subject string, channel string, t_idx long, value double")
    for method, mode in (("fooof", "fixed"), ("fooof", "knee"), ("irasa", "knee"), ("irasa", "fixed")):
        psd, models = extraction.decomposed(samples, config.RunConfig(parameterization=method, aperiodic_mode=mode), 100.0)
        m, s = models.first(), psd.first()
        assert models.schema.simpleString() == "struct<subject:string,channel:string,offset:double,knee:double,exponent:double,r2:double,ap:array<double>,peaks:array<struct<cf:double,pw:double,bw:double>>>"
        assert (m.knee is None) == (mode == "fixed") and len(m.ap) == len(s.freqs)
        curve = m.offset - np.log10((m.knee or 0) + np.array(s.freqs) ** m.exponent)
        assert np.allclose(m.ap, curve)
        bands = {r.band: r for r in spectral.fits_by_band(models, {"Low": (3, 8), "Alpha": (8, 13)}).collect()}
        assert set(bands) == {"Low", "Alpha"} and all(np.isclose(r.exponent, m.exponent) and r.n_peaks == len(m.peaks) for r in bands.values())
        if method == "fooof":
            assert abs(bands["Alpha"].cf - 10) < 0.5 and np.isclose(bands["Alpha"].pw, max(p.pw for p in m.peaks if 8 <= p.cf <= 13))
        else:
            assert bands["Alpha"].cf is None and bands["Alpha"].pw is None


def test_from_samples_to_features(spark):
    rng = np.random.default_rng(6)
    t = np.arange(6000) / 100
    noise = np.cumsum(rng.normal(size=(2, 6000)), axis=1) * 0.05 + rng.normal(size=(2, 6000)) * 0.5
    rows = [("s", f"e_{side}h_1", i, float(v)) for side, x in zip("lr", noise + 2 * np.sin(2 * np.pi * 10 * t)) for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "subject string, channel string, t_idx long, value double")
    flags = dict.fromkeys(config.FEATURE_CATEGORIES, True)
    for settings in (config.RunConfig(features=flags, which_layout=None, parameterization="fooof", aperiodic_mode="fixed", least_r2=0.2), config.RunConfig(features=flags, which_layout=None, parameterization="irasa", aperiodic_mode="fixed", least_r2=0.2, psd_method="multitaper")):
        got = {(r.channel, r.feature, r.band): r.value for r in extraction.extracted(samples, settings, 100.0).collect()}
        assert got["e_lh_1", "OriginalPSD_Canonical_Relative_Power", "Alpha"] > 0.5 and ("e_lh_vs_rh_1", "Exponent", "") in got
        assert (settings.parameterization == "fooof") == (("e_lh_1", "Peak_Center", "Alpha") in got)
        if settings.parameterization == "fooof":
            assert abs(got["e_lh_1", "Peak_Center", "Alpha"] - 10) < 0.5
