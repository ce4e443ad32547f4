import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltsheaf import catalogue
from voltsheaf.config import RunConfig
from voltsheaf.functions import kernels
from voltsheaf.functions import spectral as S
from voltsheaf.operators import cohort, normative, normdata, qc, segments, spectral, stats
from voltsheaf.plans import charts
from voltsheaf.plans import kernels as K


def test_flat_spectrum(spark):
    psd = spark.createDataFrame([("s", "c", [float(f) for f in range(3, 41)], [1.0] * 38), ("s", "zero", [float(f) for f in range(3, 41)], [0.0] * 38)], "subject string, channel string, freqs array<double>, power array<double>")
    rows = {(r.channel, r.band): r for r in spectral.band_powers(psd).collect()}
    assert rows["c", "Alpha"].abs_power == pytest.approx(math.log10(5)) and rows["c", "Alpha"].rel_power == pytest.approx(5 / 37)
    assert rows["zero", "Alpha"].abs_power is None and rows["zero", "Alpha"].rel_power is None
    assert {r.value for r in spectral.band_ratios(psd).filter("channel = 'zero'").collect()} == {None}
    names = {r.feature for r in spectral.feature_table(psd).select("feature").distinct().collect()}
    assert "Rel_OriginalPSD_Canonical" in names and "OriginalPSD_Theta_over_Alpha" in names


def test_metamorphic_scaling(spark):
    psd = spark.createDataFrame([("s", "c", [float(f) for f in range(1, 65)], [abs(math.sin(f)) + 0.1 for f in range(1, 65)])], "subject string, channel string, freqs array<double>, power array<double>")
    a = spectral.band_powers(psd).collect()
    for n in (1, 4):
        b = spectral.band_powers(psd.repartition(n).withColumn("power", F.transform("power", lambda p: p * 100))).collect()
        for x, y in zip(sorted(a), sorted(b)):
            assert y.abs_power == pytest.approx(x.abs_power + 2) and y.rel_power == pytest.approx(x.rel_power)


def test_asymmetry_parcels_and_peaks(spark):
    f = spark.createDataFrame([("s", "f", "x_lh_1", 3.0), ("s", "f", "x_rh_1", 1.0), ("s", "f", "y_lh_1", 9.0)], "subject string, feature string, region string, value double")
    assert [(r.region, r.value) for r in spectral.hemispheric_asymmetry(f).collect()] == [("x_lh_vs_rh_1", 2.0)]
    c = spark.createDataFrame([("s", "f", "a", 1.0), ("s", "f", "b", None), ("s", "g", "a", None), ("s", "f", "q", 5.0)], "subject string, feature string, channel string, value double")
    layout = spark.createDataFrame([("a", "p"), ("b", "p")], "channel string, parcel string")
    assert [(r.feature, r.parcel, r.value) for r in spectral.parcel_mean(c, layout).collect()] == [("f", "p", 1.0)]
    assert [r.channel for r in spectral.unassigned_channels(c, layout).collect()] == ["q"]
    m = spark.createDataFrame([([(9.0, 1.0, 2.0), (10.0, 1.0, 2.0), (11.0, float("nan"), 1.0)],)], "peaks array<struct<cf:double,pw:double,bw:double>>")
    assert m.select(S.strongest_peak(F.col("peaks"), 8.0, 13.0).alias("x")).first().x == 9.0


def test_gates(spark):
    models = spark.createDataFrame([("a", 0.9), ("b", 0.89), ("c", None)], "subject string, r2 double")
    assert {r.subject for r in spectral.well_fitted(models).collect()} == {"a", "c"} and spectral.poorly_fitted(models).count() == 1
    g = spark.createDataFrame([(1.0,), (3.0,), (0.9,), (5.1,)], "v double").select(S.gauge(F.col("v"), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(5.0)).alias("g"))
    assert [r.g for r in g.collect()] == ["below normal", "normal", "extremely low", "extremely high"]


def test_cohort(spark):
    features = spark.createDataFrame([(1, 0.5), (2, 0.7)], "participant_id long, x double")
    a = spark.createDataFrame([("1", 30.0, "open")], "participant_id string, age double, eyes string")
    b = spark.createDataFrame([("2", 40.0, "site7"), ("001", 5.0, "s")], "participant_id string, age double, site string")
    rows = {r.participant_id: r for r in cohort.with_demographics(features, [("one", a), ("two", b)]).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].site == "one" and rows["2"].site == "site7" and "eyes" not in rows["1"]
    subjects = spark.createDataFrame([("s1",), ("s2",)], "subject string")
    rec = spark.createDataFrame([("s1", "b"), ("s1", "a")], "subject string, path string")
    got = {r.subject: r.recordings for r in cohort.manifest(subjects, rec).collect()}
    assert got == {"s1": ["a", "b"], "s2": []}
    assert [r.path for r in cohort.kth_file(rec, 2).collect()] == ["b"] and cohort.kth_file(rec, 3).count() == 0
    assert cohort.only(subjects, rec.limit(0), "subject").count() == 0
    raw = spark.createDataFrame([("7", 20, "1", None), ("7", 20, "1", None), ("8", 30, "9", "x")], "id string, a int, s string, d string")
    t = {r.participant_id: r for r in cohort.demographics_table(raw, 0, 1, {"col_name": "sex", "col_id": 2, "mapping": {1: "F"}}, {"col_name": "diagnosis", "col_id": 3, "mapping": {"x": "pat"}}).collect()}
    assert t["7"].sex == "F" and t["8"].sex is None and t["7"].diagnosis == "nan" and t["8"].diagnosis == "pat"
    with pytest.raises(ValueError):
        cohort.demographics_table(raw, 0, 1, {"col_name": "sex"})
    near = cohort.nearest(spark.createDataFrame([(30.0,)], "m double"), "m", [("a", 24), ("b", 36)])
    assert near.first().template == "a"
    wide = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, 1.0, 1.0), (4, 1.0, 1.0), (5, 1.0, 1.0)], "k int, a double, b double")
    assert cohort.drop_sparse_columns(wide, ["a", "b"], 0.2).columns == ["k"]
    assert cohort.excluded_columns(["ab", "cd"], "^a") == ["cd"] and cohort.included_columns(["x_roi_1", "y", "age"], ["roi-lh"], ("age",)) == ["x_roi_1", "age"]
    w = cohort.widen(cohort.melt(wide, ["k"], ["a", "b"]), ["k"], ["a", "b"])
    assert sorted(w.collect()) == sorted(wide.collect())


def test_imputation(spark):
    rows = [(1, "g", 10, 1.0), (2, "g", 12, None), (3, "g", 14, 3.0), (4, "g", 40, None), (5, None, 12, None), (6, "h", 1, None), (7, "h", 2, None)]
    df = spark.createDataFrame(rows, "k long, g string, age int, v double")
    mean = {r.k: r.imputed for r in normdata.impute_mean(df, "v", ["g"], "age").collect()}
    median = {r.k: r.imputed for r in normdata.impute_median(df, "v", "k", ["g"], "age").collect()}
    assert mean == median == {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0, 5: 2.0, 6: 2.0, 7: 2.0}
    wide = {r.k: r.imputed for r in normdata.impute_median(df.filter("k <> 1"), "v", "k", ["g"], "age", 1.0, {"g": 30}, "g").collect()}
    assert wide[4] == 3.0
    split = normdata.stratified_split(spark.range(100).withColumn("s", F.col("id") % 3), ["s"], "id", 0.5, 0.25)
    n = {(r.s, r.split): r.n for r in split.groupBy("s", "split").agg(F.count("*").alias("n")).collect()}
    assert n[0, "train"] == 17 and n[1, "train"] == 16 and n[1, "validation"] == 8
    x, b, y = normdata.split_tables(df, "k", ["age"], [], ["v"])
    assert b.columns == ["k", "batch"] and y.columns == ["k", "v"]


def test_quality(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100, -100])], "k int, v double")
    bad = [r.k for r in qc.robust_z(df, "v").collect() if r.failed]
    assert bad == [5]
    flat = spark.createDataFrame([(i, 0.0) for i in range(5)], "k int, v double")
    assert {r.robust_z for r in qc.robust_z(flat, "v").collect()} == {0.0}
    assert {r.k for r in qc.absolute_deviation(df, "v", 50.0).collect() if r.failed} == {4, 5}

    def ratio(values):
        s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "g string, i int, v double")
        r = qc.largest_ratio(s, ["g"], "i", "v").first()
        return r.idx, r.ratio

    assert ratio([2, 4, 1, 8]) == (1, 4.0) and ratio([0, 5, 0, 10]) == (0, 0.0)
    z = spark.createDataFrame([("g", 1, 2.0), ("g", 1, -2.0), ("g", 1, 2.1), ("g", 2, 0.0)], "grp string, run int, z double")
    r = qc.extreme_rates(z, "grp", "run").first()
    assert r.mean_high == pytest.approx(100 / 6) and r.mean_low == 0
    c = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 1.0, 2.0, 1.0])], "g string, x int, y double")
    assert [r.x for r in qc.slope_changes(c, ["g"], "x", "y").orderBy("x").collect()] == [1, 2, 3]
    states = spark.createDataFrame([("a|CANCELLED by 123",), ("nonsense",), ("b|TIMEOUT",)], "line string")
    assert {r.state: r.n for r in qc.state_counts(qc.job_states(states)).collect()} == {"CANCELLED": 1, "TIMEOUT": 1}
    s = spark.createDataFrame([("m", "c1", float(i), float(i)) for i in range(5)] + [("m", "c2", float(i % 2), float(i)) for i in range(5)], "s string, c string, v double, ref double")
    assert qc.best_component(s, ["s"], "c", "v", "ref").first().c == "c1"


def test_segments(spark):
    e = spark.createDataFrame([("s", 0, "rest"), ("s", 26, "task"), ("s", 30, "rest"), ("s", 35, "rest")], "subject string, t long, kind string")
    found = segments.blocks(e, ["subject"], "t", "kind", "rest", spark.createDataFrame([("s", 50)], "subject string, end long"))
    assert sorted((r.start, r.duration) for r in found.collect()) == [(0, 26), (30, 5), (35, 15)]
    onsets = [r.onset for r in segments.block_onsets(found, ["subject"], 10, 2).orderBy("onset").collect()]
    assert onsets == [0, 8, 16, 26]
    with pytest.raises(ValueError):
        segments.assert_blocks(found, 100)
    seg = spark.createDataFrame([("s", 0.0, 10.0), ("s", 10.0, 20.0)], "subject string, start double, stop double")
    ann = spark.createDataFrame([("s", 5.0, 5.0)], "subject string, onset double, duration double")
    assert [r.start for r in segments.without_overlap(seg, ann, ["subject"], 10.0).collect()] == [10.0]
    with pytest.raises(ValueError):
        segments.cropped(e, ["subject"], "t", tmax=0)
    t = segments.trimmed(spark.createDataFrame([("s", "o", 0, 10), ("s", "o", 20, 3), ("s", "o", 30, 10)], "s string, lab string, onset int, duration int"), ["s"], "onset", "duration", "lab", 1, 2)
    assert sorted((r.start, r.length, r.position) for r in t.collect()) == [(1, 7, 0), (31, 7, 7)]


def test_stretches_that_begin_together_have_one_order(spark):
    rows = [("s", "a", 5, 40, 2), ("s", "a", 5, 60, 1), ("s", "a", 0, 30, 3), ("s", "a", 5, 35, 4), ("s", "b", 5, 50, 0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "subject string, label string, onset long, duration long, id long").coalesce(1)
        at = lambda ties: sorted((r.label, r.position, r.length) for r in segments.trimmed(df, ["subject"], "onset", "duration", "label", 10, 15, ties).collect())  # noqa: B023, E731
        assert at(("id",)) == [("a", 0, 5), ("a", 5, 35), ("a", 40, 15), ("a", 55, 10), ("b", 0, 25)]
        assert at(()) == [("a", 0, 5), ("a", 5, 10), ("a", 15, 15), ("a", 30, 35), ("b", 0, 25)]


def test_trim_concat_takes_a_second_by_event(spark, tmp_path):
    ts = "TIMESTAMP_NTZ '2024-01-01 00:00:01'"
    spark.sql(f"SELECT id AS event_id, {ts} AS ts, 1L AS user_id, 'view' AS event_type, 1.0D AS value, '' AS props FROM range(30, 60)").orderBy(F.desc("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.position, r.length) for r in catalogue.queries()["trim_concat"](spark, str(tmp_path)).orderBy("position").collect()]
    assert got == [(sum(range(5, k)), k) for k in range(5, 35)]


def test_norms(spark):
    rng = np.random.default_rng(0)
    age, site = rng.uniform(0, 1, 400), rng.integers(0, 2, 400)
    rows = [("r", float(a), f"s{s}", float(2 + 3 * a + 0.5 * s + 0.1 * e)) for a, s, e in zip(age, site, rng.normal(size=400))]
    long = spark.createDataFrame(rows, "response string, age double, site string, y double")
    batch = {"site": ["s0", "s1"]}
    models = normative.fit_norms(long, "age", batch, degree=1)
    assert models[0]["beta"] == pytest.approx([2, 3, 0.5], abs=0.05) and models[0]["sigma"] == pytest.approx(0.1, abs=0.02)
    z = normative.z_scores(normative.predicted(long, normative.model_table(spark, models), "age", batch, degree=1)).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(z.m) < 0.01 and z.s == pytest.approx(1, abs=0.02)
    c = normative.centiles(normative.predicted(long, normative.model_table(spark, models), "age", batch, degree=1))
    assert normative.calibration_error(c, ["response"], "y", "value").first().mace < 0.03


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (3.0, 0)], "v double, g int")
    r = stats.rank_sum(df, "v", "g", 1).first()
    assert (r.n1, r.n2, r.r1) == (2, 2, 3.5) and r.z == pytest.approx(-1.5 / math.sqrt(5 / 3))
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    assert {r.k: round(r.p_adjusted, 6) for r in stats.false_discovery(p, "p", "k").collect()} == {"a": 0.03, "c": 0.04, "b": 0.04}
    assert stats.rank_sum(df.limit(0), "v", "g", 1).first().z is None
    assert df.select(stats.two_sided_p(F.lit(1.959964)).alias("p")).first().p == pytest.approx(0.05, abs=1e-6)
    h = stats.histogram(spark.createDataFrame([(5.0,), (85.0,), (86.0,), (4.9,)], "a double"), "a", [], 5, 85, 5)
    assert sorted((r.bin_lo, r.n) for r in h.collect()) == [(5, 1), (80, 1)]


def test_kernels():
    t = np.arange(0, 60, 0.01)
    rng = np.random.default_rng(1)
    f, p = kernels.welch(np.sin(2 * np.pi * 10 * t) + 0.1 * rng.normal(size=len(t)), 100.0)
    assert f[p.argmax()] == 10.0
    f, p = kernels.welch(rng.normal(size=len(t)), 100.0)
    assert np.trapezoid(p, f) == pytest.approx(1.0, abs=0.05)
    f = np.arange(3, 40.5, 0.5)
    m = kernels.parameterize(f, 10 ** (1.0 - 1.5 * np.log10(f) + 0.8 * np.exp(-((f - 10) ** 2) / (2 * 1.5**2))))
    assert m["exponent"] == pytest.approx(1.5, abs=0.05) and m["peaks"][0]["cf"] == pytest.approx(10, abs=0.2) and m["r2"] > 0.99
    assert kernels.shapiro_w(rng.normal(size=300)) > 0.98 and kernels.shapiro_w(np.array([1.0, 1.0])) is None
    assert kernels.shapiro_w(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)) == pytest.approx(0.79, abs=0.005)
    s = np.stack([np.sign(np.sin(7 * t)), t % 1])
    parts = kernels.fast_ica(np.array([[1, 0.5], [0.4, 1]]) @ s, 2)
    r = np.abs(np.corrcoef(np.vstack([parts, s]))[:2, 2:])
    assert (r.max(axis=0) > 0.98).all()
    noise = np.cumsum(rng.normal(size=4096))
    out = kernels.irasa(noise + 20 * np.sin(2 * np.pi * 10 * np.arange(4096) / 100), 100.0, (1.0, 30.0))
    assert abs(out["freqs"][out["periodic"].argmax()] - 10) < 0.5
    assert kernels.knee_point(np.array([0.0, 0.8, 0.9, 0.95, 1.0])) == 1 and kernels.knee_point(np.ones(5)) is None


def test_shapiro_by_bins(spark):
    df = spark.createDataFrame([("r", float(i % 20), float((i * 37) % 101)) for i in range(200)], "response string, covariate double, z double")
    a, b = K.shapiro_by_bins(df, "response", "covariate", "z", 4).first(), K.shapiro_by_bins(df, "response", "covariate", "z", 4, True).first()
    assert 0.8 < a.w <= 1 and a.n_bins == b.n_bins == 4


def test_config(tmp_path):
    c = RunConfig()
    c.save(f"{tmp_path}/c.json")
    assert RunConfig.load(f"{tmp_path}/c.json") == c
    with pytest.raises(FileExistsError):
        c.save(f"{tmp_path}/c.json")
    for bad in ({"ica_corr_threshold": 1.0}, {"segments_tmax": 0.0}, {"which_sensor": "x"}, {"segments_overlap": 10.0}, {"ratios": [["A", "B"]]}, {"same_environmental_noise": True, "environmental_noise": False}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    with pytest.warns(UserWarning):
        RunConfig(muscle_z=2.0)


def test_charts(spark):
    assert charts.contour_radius(0.5) == pytest.approx(1.17741)
    df = spark.createDataFrame([("lh_G-x",), ("G_y-rh",)], "region string")
    assert [(r.hemi, r.bare) for r in charts.region_parts(df).collect()] == [("lh", "G-x"), ("rh", "G_y")]
    s = charts.life_stages(spark.createDataFrame([(11,), (12,), (70,)], "age int"))
    assert [r.stage for r in s.collect()] == [0, 1, 4]
