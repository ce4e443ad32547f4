import numpy as np
import pytest

from voltsheaf.plans import rejection as R

EPOCHS = "subject string, channel string, epoch long, x array<double>"


def fold(e, folds):
    return e * 40503 % 65521 % folds


def brute(epochs, steps, folds):
    """Threshold and error of one channel: dict epoch -> array."""
    ptp = {e: x.max() - x.min() for e, x in epochs.items()}
    lo, hi = min(ptp.values()), max(ptp.values())
    step = {e: max(1, min(int(np.ceil((p - lo) / (hi - lo) * steps)) if hi > lo else 1, steps)) for e, p in ptp.items()}
    best = None
    for j in range(1, steps + 1):
        errors = []
        for f in range(folds):
            test = [x for e, x in epochs.items() if fold(e, folds) == f]
            train = [x for e, x in epochs.items() if fold(e, folds) != f and step[e] <= j]
            if test:
                errors.append(np.sqrt(((np.mean(train, 0) - np.median(test, 0)) ** 2).mean()) if train else np.nan)
        error = np.mean(errors)
        if not np.isnan(error) and (best is None or error < best[1] - 1e-12):
            best = (j, error)
    j = best[0] if best else steps
    return (hi if j == steps else lo + (hi - lo) * j / steps), best and best[1]


def data():
    rng = np.random.default_rng(8)
    out = {}
    for s in "ab":
        for c in range(6):
            for e in range(40):
                x = np.sin(np.arange(30) / 4) + 0.3 * rng.normal(size=30)
                if e % 8 == 3 or (c == 2 and e % 3 == 0):
                    x += 30 * rng.normal() * (np.arange(30) > 10)
                out[s, f"c{c}", e] = x
    return out


def test_thresholds_equal_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*k, x.tolist()) for k, x in rows.items()], EPOCHS)
    got = {(r.subject, r.channel): (r.threshold, r.error) for r in R.learnt_thresholds(df, 12, 5).collect()}
    for s, c in got:
        want = brute({e: x for (a, b, e), x in rows.items() if (a, b) == (s, c)}, 12, 5)
        assert got[s, c] == pytest.approx(want, abs=1e-9)
    kept = {(r.subject, r.epoch): r.keep for r in R.rejected(df, 12, 5, 6).collect()}
    assert len(kept) == 80
    assert not any(kept[s, e] for s in "ab" for e in range(3, 40, 8)) and sum(kept.values()) >= 45


def test_odd_epochs(spark):
    rows = [("one", "c", 0, [1.0, 2.0]), ("flat", "c", 0, [1.0, 1.0]), ("flat", "c", 1, [1.0, 1.0]), ("flat", "c", 2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, EPOCHS)
    got = {r.subject: r for r in R.learnt_thresholds(df, 4, 3).collect()}
    assert got["one"].threshold == 1.0 and got["one"].error is None and got["flat"].threshold == 0.0 and got["flat"].error == 0.0
    assert all(r.keep for r in R.rejected(df, 4, 3).collect())
    assert R.rejected(df.limit(0), 4, 3).count() == 0


def test_steps_without_epochs_are_no_candidates(spark):
    rows = [("a", "c", e, e % 7 % 2 * 2 + 1, [float(e), 1.0]) for e in range(12)]  # at steps 1 and 3
    df = spark.createDataFrame(rows, "subject string, channel string, epoch long, step int, x array<double>")
    assert {r.step for r in R.held_out_errors(df, ["subject", "channel"], 5, 3).collect()} == {1, 3}
