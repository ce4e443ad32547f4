"""Bad channels by windows: bursts, dead and noisy channels, marks made before, odd input."""

import numpy as np

from voltsheaf.operators import qc

SCHEMA = "subject string, channel string, t_idx long, value double"


def recording():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(9):
        x = rng.normal(size=1000)
        if c == 1:
            x[:] = 3.0
        if c == 2:
            x[:600] *= 40  # noisy in six windows
        if c == 3:
            x[:200] *= 40  # a burst of two
        if c == 4:
            x[500:700] = 0.0  # flat in two
        rows += [("s", f"c{c}", i, float(v)) for i, v in enumerate(x)]
    return rows


def test_verdicts(spark):
    samples = spark.createDataFrame(recording(), SCHEMA).repartition(3)
    known = spark.createDataFrame([("s", "c5"), ("s", "c5"), ("other", "c6")], "subject string, channel string")
    out = qc.bad_channels(samples, 100, flat=1e-3, known=known)
    got = {r.channel: (r.n_windows, r.n_noisy, r.n_flat, r.verdict) for r in out.collect()}
    assert got["c1"] == (10, 0, 10, "flat") and got["c2"] == (10, 6, 0, "noisy") and got["c3"] == (10, 2, 0, "good") and got["c4"] == (10, 0, 2, "good")
    assert {c: v[3] for c, v in got.items() if v[3] != "good"} == {"c1": "flat", "c2": "noisy", "c5": "known"}
    empty_room = spark.createDataFrame([("s", "c1", 0, 1.0), ("s", "c3", 0, 1.0)], SCHEMA)
    assert [r.channel for r in qc.without_bad_channels(empty_room, out).collect()] == ["c3"]
    assert qc.without_bad_channels(samples, out).count() == 6 * 1000


def test_nulls_single_samples_and_no_rows(spark):
    rows = [("s", "a", 0, 1.0), ("s", "a", 1, None), ("s", "b", 0, float("nan")), (None, "a", 0, 2.0)]
    got = sorted(((r.subject, r.channel, r.n_windows, r.n_noisy, r.n_flat) for r in qc.bad_channels(spark.createDataFrame(rows, SCHEMA), 10, flat=0.5, least=2).collect()), key=str)
    assert got == [("s", "a", 1, 0, 1), (None, "a", 1, 0, 1)] or got == [(None, "a", 1, 0, 1), ("s", "a", 1, 0, 1)]
    assert qc.bad_channels(spark.createDataFrame([], SCHEMA), 10, flat=0.5).collect() == []
