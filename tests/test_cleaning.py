import numpy as np
import pytest

from voltsheaf.config import RunConfig
from voltsheaf.functions import filters
from voltsheaf.operators import stats
from voltsheaf.plans import cleaning as C


def table(spark, rows):
    return spark.createDataFrame([(s, c, int(t), None if v is None else float(v)) for s, c, t, v in rows], C.SAMPLES)


def series(df, subject="s", channel="c"):
    rows = sorted((r.t_idx, r.value) for r in df.collect() if (r.subject, r.channel) == (subject, channel))
    return np.array([t for t, _ in rows]), np.array([v for _, v in rows])


def test_kernel_passes_and_stops():
    h = filters.fir_kernel(200.0, 5.0, 40.0, 50.0)
    gain = lambda f: abs(np.sum(h * np.exp(-2j * np.pi * f / 200 * np.arange(len(h)))))
    assert np.allclose(h, h[::-1])
    assert abs(gain(20) - 1) < 0.01 and abs(gain(8) - 1) < 0.01 and gain(1) < 0.01 and gain(50) < 0.01 and gain(70) < 0.01
    high = filters.band_kernel(200.0, 5.0, None)
    assert abs(high.sum()) < 1e-9 and filters.band_kernel(200.0, None, None).tolist() == [1.0]


@pytest.mark.parametrize("n,block", [(700, 100), (701, 333), (90, 100), (20, 100), (1, 100), (700, 1)])
def test_blocks_equal_the_whole_signal(spark, n, block):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    taps = filters.fir_kernel(50.0, 2.0, 15.0, None)
    want = np.convolve(filters.reflected(x, len(taps) // 2, len(taps) // 2), taps, "valid")
    t, y = series(C.fir_filtered(table(spark, [("s", "c", i, v) for i, v in enumerate(x)]), taps, block))
    assert t.tolist() == list(range(n)) and np.abs(y - want).max() < 1e-9


@pytest.mark.parametrize("sfreq,rate,block", [(50.0, 20.0, 3.0), (20.0, 50.0, 4.0), (100.0, 99.0, 2.0), (50.0, 25.0, 0.1)])
def test_resampling_in_blocks(spark, sfreq, rate, block):
    n = 400
    x = np.sin(2 * np.pi * 2.0 * np.arange(n) / sfreq) + 3
    t, y = series(C.resampled(table(spark, [("s", "c", i, v) for i, v in enumerate(x)]), sfreq, rate, block))
    assert t.tolist() == list(range(int((n - 1) * rate / sfreq) + 1))
    whole = series(C.resampled(table(spark, [("s", "c", i, v) for i, v in enumerate(x)]), sfreq, rate, 1000.0))[1]
    assert np.abs(y - whole).max() < 1e-9
    inner = slice(len(t) // 4, -len(t) // 4)
    assert np.abs(y - np.sin(2 * np.pi * 2.0 * t / rate) - 3)[inner].max() < 0.01


def test_gaps_stay_gaps(spark):
    rows = [("s", "c", i, 2.0) for i in range(100) if i not in (40, 41)] + [("s", "c", 40, None), ("s", "d", 5, 1.0)]
    t, y = series(C.filtered(table(spark, rows), 50.0, None, 10.0, None, block=0.5))
    assert 40 not in t and len(t) == 98 and np.allclose(y, 2.0)
    assert C.filtered(table(spark, rows).limit(0), 50.0).count() == 0


def mixture(n=1200, subjects=("a", "b")):
    rng = np.random.default_rng(11)
    out = {}
    for k, s in enumerate(subjects):
        heart = (np.arange(n) % (37 + k) < 3).astype(float) * 4 + 0.01 * rng.normal(size=n)
        others = np.stack([rng.laplace(size=n), np.sign(np.sin(np.arange(n) / (9 + k))), rng.uniform(-1, 1, n)])
        sources = np.vstack([heart, others])
        mix = rng.normal(size=(6, 4))
        out[s] = (mix @ sources + rng.normal(size=6)[:, None], heart, mix[:, 1:] @ others)
    return out


def plain(x, heart, n, threshold, rounds=200, tolerance=1e-6):
    """The same on a whole recording with dense matrices."""
    mean = x.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(np.cov(x, bias=True))
    keep = np.argsort(-values)[:n]
    keep = keep[values[keep] > 1e-10 * values.max()]
    e = vectors[:, keep] * np.sign(vectors[np.abs(vectors[:, keep]).argmax(0), keep])
    z = (e / np.sqrt(values[keep])).T @ (x - mean)
    orth = lambda m: np.linalg.svd(m)[0] @ np.linalg.svd(m)[2]
    w = orth(np.random.default_rng(42).normal(size=(len(keep), len(keep))))
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = orth(g @ z.T / z.shape[1] - (1 - g * g).mean(1)[:, None] * w)
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tolerance
        w = new
        if done:
            break
    u = w @ z
    r = np.array([np.corrcoef(v, heart)[0, 1] for v in u])
    j = int(np.abs(r).argmax())
    if abs(r[j]) < threshold:
        return x, r
    return x - np.outer((e * np.sqrt(values[keep])) @ w[j], u[j]), r


@pytest.mark.parametrize("wave_bytes", [C.WAVE_BYTES, 200])
def test_components_equal_the_dense_form(spark, wave_bytes):
    mixed = mixture()
    rows = [(s, f"e{i}", t, v) for s, (x, _, _) in mixed.items() for i, line in enumerate(x) for t, v in enumerate(line)]
    refs = [(s, "ecg", t, v) for s, (_, heart, _) in mixed.items() for t, v in enumerate(heart)]
    clean, found = C.components_removed(table(spark, rows), table(spark, refs), n=4, threshold=0.9, block=100, wave_bytes=wave_bytes)
    got = clean.collect()
    assert len(got) == len(rows)
    for s, (x, heart, without) in mixed.items():
        want, r = plain(x, heart, 4, 0.9)
        y = np.stack([[v for _, v in sorted((g.t_idx, g.value) for g in got if (g.subject, g.channel) == (s, f"e{i}"))] for i in range(6)])
        assert np.abs(y - want).max() < 1e-6
        mine = sorted((f.component, f.correlation, f.removed) for f in found.collect() if f.subject == s)
        assert np.allclose([c for _, c, _ in mine], r, atol=1e-6) and [m for _, _, m in mine] == [i == np.abs(r).argmax() for i in range(4)]
        # what is left is the mixture of the other sources
        centred = lambda m: m - m.mean(1, keepdims=True)
        assert np.corrcoef(centred(y).ravel(), centred(without).ravel())[0, 1] > 0.99


def test_incomplete_instants_and_odd_recordings(spark):
    mixed = mixture(subjects=("a",))
    x, heart, _ = mixed["a"]
    rows = [("a", f"e{i}", t, v) for i, line in enumerate(x) for t, v in enumerate(line) if not (i == 2 and 100 <= t < 300)]
    rows += [("a", "e2", 150, None), ("a", "e2", 151, float("nan")), ("one", "e0", 0, 5.0), ("flat", "e0", 0, 1.0), ("flat", "e0", 1, 1.0)]
    refs = [("a", "ecg", t, v) for t, v in enumerate(heart)] + [("none", "ecg", 0, 1.0), ("one", "ecg", 0, 1.0)]
    clean, found = C.components_removed(table(spark, rows), table(spark, refs), n=4, block=64)
    got = {(r.subject, r.channel, r.t_idx): r.value for r in clean.collect()}
    assert len(got) == len(rows) - 2 and got["a", "e0", 120] == x[0, 120] and got["one", "e0", 0] == 5.0 and got["flat", "e0", 1] == 1.0
    assert abs(got["a", "e0", 400] - x[0, 400]) > 0 and {r.subject for r in found.collect()} == {"a"}
    clean, found = C.components_removed(table(spark, rows).limit(0), table(spark, refs))
    assert clean.count() == 0 and found.count() == 0


def test_chain_by_settings(spark):
    sfreq, n = 100.0, 1500
    t = np.arange(n) / sfreq
    heart = ((np.arange(n) + 40) % 83 < 4) * 5.0  # no beat at the ends
    rows = []
    rng = np.random.default_rng(2)
    for i in range(5):
        x = np.sin(2 * np.pi * (6 + i) * t) + np.sin(2 * np.pi * 50 * t) + heart * (i - 2) + 0.05 * rng.normal(size=n) + 7
        rows += [("s", f"EEG{i}", k, v) for k, v in enumerate(x)]
    rows += [("s", "ECG1", k, v) for k, v in enumerate(heart)] + [("s", "STI", k, 1.0) for k in range(n)]
    types = spark.createDataFrame([(f"EEG{i}", "EEG") for i in range(5)] + [("ECG1", "ecg"), ("STI", "stim")], "channel string, type string")
    settings = RunConfig(which_sensor="eeg", cutoff_low=1.0, cutoff_high=30.0, resample_rate=80.0, ica_corr_threshold=0.8)
    out = C.cleaned(table(spark, rows), sfreq, types, settings, line=50.0, components=4)
    got = out.collect()
    assert {r.channel for r in got} == {f"EEG{i}" for i in range(5)} and len(got) == 5 * ((n - 1) * 80 // 100 + 1)
    beats = np.interp(np.arange(1200) / 80, t, heart)
    y = series(out, channel="EEG4")[1]
    assert abs(np.corrcoef(y[200:-200], beats[200:1000])[0, 1]) < 0.2 and abs(y[200:-200].mean()) < 0.05


def test_sequence_numbers_run_on_over_ranges(spark):
    rows = spark.range(5000).selectExpr("case when id % 10 = 0 then cast(id % 7 as string) end AS g", "id * 7919 % 5003 AS o", "id")
    got = stats.sequence(rows, ["g"], ["o"], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.o, r.n))
    assert len(got) == 5000 and all([n for _, n in sorted(v)] == list(range(len(v))) for v in by.values())


def test_components_within_a_task_equal_those_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k, n in enumerate((400, 401, 700, 130, 900, 60)):
        x = rng.normal(size=(3, 2)) @ np.stack([rng.laplace(size=n) ** 3, np.sign(np.sin(np.arange(n) / (5 + k)))])
        gap = range(20, 30) if k % 2 else ()
        rows += [(f"s{k}", f"e{i}", t, v) for i, line in enumerate(x) for t, v in enumerate(line) if not (i == 1 and t in gap)]
        want[f"s{k}"] = 2 * (n - len(gap))
    rows += [("one", "e0", 0, 5.0), ("flat", "e0", 0, 1.0), ("flat", "e0", 1, 1.0)]
    found = lambda **k: {(r.subject, r.component, r.t): r.value for r in C.independent_components(table(spark, rows), n=2, block=100, **k).collect()}
    by_rounds, mixed = found(task_values=0), found(task_values=1203)
    monkeypatch.setattr(C, "rotations", None)  # the driver has no part in short recordings
    within = found()
    assert {s: sum(k[0] == s for k in within) for s in want} == want and len(within) == sum(want.values())
    for other in (by_rounds, mixed):
        assert within.keys() == other.keys() and max(abs(within[k] - other[k]) for k in within) < 1e-6


def test_waves_bound_the_recordings_at_the_driver(spark, monkeypatch):
    rows = [(f"s{k}", "e0", t, float((t * 7 + k) % 11)) for k in range(40) for t in range(20)]
    seen, inner = [], C.rotations
    monkeypatch.setattr(C, "rotations", lambda z, sizes, *a: seen.append(len(sizes)) or inner(z, sizes, *a))
    out = C.independent_components(table(spark, rows), n=1, wave_bytes=10 * 6_000, task_values=0)
    assert out.count() == 800 and sum(seen) == 40 and len(seen) == 5 and max(seen) < 20


def test_batches_of_short_recordings_are_small_and_the_session_keeps_its_own(spark, monkeypatch):
    rows = [(f"s{k}", "e0", t, float((t * 7 + k) % 11)) for k in range(5) for t in range(20)]
    seen, inner = {}, C.held_components
    keys = list(C.BATCHES)
    monkeypatch.setattr(C, "held_components", lambda *a: seen.update({k: spark.conf.get(k) for k in keys}) or inner(*a))
    own = {keys[0]: "70000", keys[1]: "1000"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        assert C.independent_components(table(spark, rows), n=1).count() == 100
        assert seen == {keys[0]: "1000", keys[1]: "1000"} and {k: spark.conf.get(k) for k in keys} == own
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
