"""The cleaning chain of recordings: resampling, filters, reference and removal of artefact components.

Samples are rows (subject, channel, t_idx, value).  Recordings are worked on in blocks of some
seconds, each with the margin that a kernel reaches; a block is a row, so a recording of any length
is many tasks, and what comes out equals the same step on the whole signal.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltsheaf.config import RunConfig
from voltsheaf.functions import filters
from voltsheaf.sources.scratch import Scratch, scratch

SAMPLES = "subject string, channel string, t_idx long, value double"


def blocks_with_margin(samples: DataFrame, length: int, margin: int) -> DataFrame:
    """subject, channel, block, t, x: blocks of length samples with those up to margin samples away, in order."""
    lo, hi = F.greatest(F.floor((F.col("t_idx") - margin) / length), F.lit(0)), F.floor((F.col("t_idx") + margin) / length)
    rows = samples.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("block", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    cut = rows.groupBy("subject", "channel", "block").agg(F.array_sort(F.collect_list(F.struct("t_idx", "value"))).alias("s"))
    return cut.select("subject", "channel", "block", F.col("s.t_idx").alias("t"), F.col("s.value").alias("x"))


def filled(t: np.ndarray, x: np.ndarray, first: int, last: int) -> np.ndarray:
    """The signal at first..last: gaps lie on lines between their neighbours, and beyond the ends of t it is turned about them."""
    whole = np.interp(np.arange(t[0], t[-1] + 1), t, x) if t[-1] - t[0] + 1 != len(t) else x
    out = filters.reflected(whole, max(0, int(t[0]) - first), max(0, last - int(t[-1])))
    start = min(first, int(t[0]))
    return out[first - start : last - start + 1]


def _map_blocks(cut: DataFrame, kernel) -> DataFrame:
    def run(frames):
        for pdf in frames:
            out = [(s, c, *kernel(int(b), np.asarray(t, np.int64), np.asarray(x, float))) for s, c, b, t, x in pdf.itertuples(index=False) if len(t)]
            for s, c, t, y in out:
                if len(t):
                    yield pd.DataFrame({"subject": s, "channel": c, "t_idx": t, "value": y})

    return cut.mapInPandas(run, SAMPLES)


def fir_filtered(samples: DataFrame, taps: np.ndarray, length: int) -> DataFrame:
    """samples through a symmetric kernel without delay, block by block (overlap-save).

    Beyond its ends a recording is turned about its end values as far as it reaches, then zero.
    Missing samples lie on lines between their neighbours while they are filtered, and stay missing.
    """
    half = len(taps) // 2
    length = max(length, half)

    def kernel(block, t, x):
        a = block * length
        mine = (t >= a) & (t < a + length)
        if not mine.any():
            return t[:0], x[:0]
        y = filters.convolved(filled(t, x, a - half, a + length - 1 + half), taps)
        return t[mine], y[t[mine] - a]

    return _map_blocks(blocks_with_margin(samples, length, half), kernel)


def filtered(samples: DataFrame, sfreq: float, lo: float | None = 1.0, hi: float | None = 80.0, line: float | None = 50.0, block: float = 60.0) -> DataFrame:
    """Band-passed samples without the line frequency and its multiples."""
    return fir_filtered(samples, filters.fir_kernel(sfreq, lo, hi, line), int(round(block * sfreq)))


def resampled(samples: DataFrame, sfreq: float, rate: float, block: float = 60.0) -> DataFrame:
    """samples at another rate by a polyphase windowed sinc: output m lies at input m * sfreq / rate, up to the last input."""
    ratio = Fraction(rate).limit_denominator(10**6) / Fraction(sfreq).limit_denominator(10**6)
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return samples.select("subject", "channel", "t_idx", "value")
    reach = filters.resample_taps(up, down)[1]
    length = max(int(round(block * sfreq)), reach + 1)

    def kernel(block, t, x):
        a = block * length
        if not ((t >= a) & (t < a + length)).any():
            return t[:0], x[:0]
        stop = min(a + length - 1, int(t[-1]))
        first = max(a, int(t[0]))
        m = np.arange(-(-first * up // down), stop * up // down + 1)
        if stop == a + length - 1 and len(t) and t[-1] > stop:  # outputs between this block's last input and the next block's first
            m = np.arange(m[0] if len(m) else -(-first * up // down), -(-(a + length) * up // down))
        if not len(m):
            return t[:0], x[:0]
        return m, filters.resampled(filled(t, x, a - reach - 1, a + length + reach), a - reach - 1, m, up, down)

    return _map_blocks(blocks_with_margin(samples, length, reach + 1), kernel)


def average_reference(samples: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """samples of the channels less their mean at each instant; other channels stay as they are.

    channels: a column channel, a table of names (some hundreds).  The group of an instant is a row a channel.
    """
    marked = samples.withColumn("__in", F.lit(True)) if channels is None else samples.join(F.broadcast(channels.select("channel").distinct().withColumn("__in", F.lit(True))), "channel", "left")
    means = marked.filter("__in").groupBy("subject", "t_idx").agg(F.avg("value").alias("__mean"))
    return marked.join(means, ["subject", "t_idx"], "left").select("subject", "channel", "t_idx", F.when(F.col("__in") & F.col("__mean").isNotNull(), F.col("value") - F.col("__mean")).otherwise(F.col("value")).alias("value"))


# independent components, by sums over blocks

#: Bytes of unmixing matrices that a wave of recordings may send to the executors.
WAVE_BYTES = 64 << 20

#: Bytes that the driver needs for a recording besides its matrices: names, arrays, rows and their copies (measured: some 4,000).
RECORDING_BYTES = 6_000

#: Values up to which a recording is decomposed within one task, and whitened values that pass their rounds together there.
TASK_VALUES, TOGETHER = 1 << 20, 1 << 18

#: Bounds of the Arrow batches of short recordings, where a batch has many of them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches within BATCHES for what is computed inside, unless the session has smaller ones."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    try:
        for key, most in BATCHES.items():
            now = before[key].rstrip("b")
            if not now.isdigit() or not 0 < int(now) <= most:  # 0 and below: no bound
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def instants(samples: DataFrame, length: int) -> DataFrame:
    """subject, block, t, channel, value (arrays): all channels of a block of a recording as one row."""
    rows = samples.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("block", F.floor(F.col("t_idx") / length))
    cut = rows.groupBy("subject", "block").agg(F.collect_list(F.struct("t_idx", "channel", "value")).alias("s"))
    return cut.select("subject", "block", F.col("s.t_idx").alias("t"), F.col("s.channel").alias("channel"), F.col("s.value").alias("value"))


def matrix(t, channel, value, names: list[str] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The channels, instants and values (channels x instants, NaN where there is none) of a block."""
    names = sorted(set(channel)) if names is None else names
    at = {c: i for i, c in enumerate(names)}
    row = np.array([at.get(c, -1) for c in channel])
    times, col = np.unique(np.asarray(t), return_inverse=True)
    x = np.full((len(names), len(times)), np.nan)
    x[row[row >= 0], col[row >= 0]] = np.asarray(value, float)[row >= 0]
    return names, times, x


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v: the element-wise sums of the arrays v by keys, combined on the map side."""
    each = rows.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return whole.select(*keys, F.col("s.x").alias("v"))


def block_moments(t, channel, value) -> tuple[tuple[str, ...], np.ndarray]:
    """The channels of a block; count, sums and products over the instants that have them all."""
    names, _, x = matrix(t, channel, value)
    x = x[:, ~np.isnan(x).any(0)]
    return tuple(names), np.concatenate([[x.shape[1]], x.sum(1), (x @ x.T).ravel()])


def channel_moments(blocks: DataFrame) -> DataFrame:
    """subject, channels, v: count, sums and products of the largest set of channels that occur together, over the instants that have them all."""

    def run(frames):
        for pdf in frames:
            held: dict = {}
            for subject, t, channel, value in pdf[["subject", "t", "channel", "value"]].itertuples(index=False):
                names, v = block_moments(t, channel, value)
                held[subject, names] = held.get((subject, names), 0) + v
            yield pd.DataFrame([(s, list(c), list(v)) for (s, c), v in held.items()], columns=["subject", "channels", "v"])

    sums = summed(blocks.mapInPandas(run, "subject string, channels array<string>, v array<double>"), ["subject", "channels"])
    best = F.max_by(F.struct("channels", "v"), F.struct(F.size("channels"), F.element_at("v", 1))).alias("b")
    return sums.groupBy("subject").agg(best).select("subject", "b.channels", "b.v")


def whitening(v: np.ndarray, c: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """mean, white (n x channels), back (channels x n) by count, sums and products of c channels; None where nothing varies."""
    if v[0] < 2:
        return None
    mean = v[1 : c + 1] / v[0]
    values, vectors = np.linalg.eigh(v[c + 1 :].reshape(c, c) / v[0] - np.outer(mean, mean))
    keep = np.argsort(-values, kind="stable")[:n]
    keep = keep[values[keep] > 1e-10 * max(values.max(), 1e-300)]
    if not len(keep):
        return None
    e = vectors[:, keep] * np.sign(vectors[np.abs(vectors[:, keep]).argmax(0), keep])
    root = np.sqrt(values[keep])
    return mean, (e / root).T, e * root


def whitened_by(moments: DataFrame, n: int) -> DataFrame:
    """subject, channels, n, mean, white (n x channels), back (channels x n): the first n principal components at unit variance."""

    def run(frames):
        for pdf in frames:
            out = []
            for subject, names, v in pdf.itertuples(index=False):
                if (found := whitening(np.asarray(v, float), len(names), n)) is not None:
                    mean, white, back = found
                    out.append((subject, list(names), len(white), mean.tolist(), white.ravel().tolist(), back.ravel().tolist()))
            yield pd.DataFrame(out, columns=["subject", "channels", "n", "mean", "white", "back"])

    return moments.mapInPandas(run, "subject string, channels array<string>, n int, mean array<double>, white array<double>, back array<double>")


def block_whitened(t, channel, value, names, mean: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The complete instants of a block and their whitened values (n x instants)."""
    _, times, x = matrix(t, channel, value, list(names))
    whole = ~np.isnan(x).any(0)
    return times[whole], white @ (x[:, whole] - mean[:, None])


def whitened(blocks: DataFrame, state: dict) -> DataFrame:
    """subject, block, t, z: complete instants of the subjects of state, n whitened values each."""

    def run(frames):
        for pdf in frames:
            for subject, block, t, channel, value in pdf[["subject", "block", "t", "channel", "value"]].itertuples(index=False):
                if subject in state:
                    s = state[subject]
                    times, z = block_whitened(t, channel, value, s["channels"], s["mean"], s["white"])
                    yield pd.DataFrame({"subject": [subject], "block": [block], "t": [times], "z": [z.ravel()]})

    return blocks.mapInPandas(run, "subject string, block long, t array<long>, z array<double>")


def orthogonal(w: np.ndarray) -> np.ndarray:
    a, _, b = np.linalg.svd(w)
    return a @ b


def first_rotation(n: int, seed: int) -> np.ndarray:
    return orthogonal(np.random.default_rng(seed).normal(size=(n, n)))


def tanh_sums(w: dict[str, np.ndarray]):
    """For mapInPandas: subject, v: the count, sums of 1 - tanh^2 and products of tanh with the signals."""

    def run(frames):
        held: dict = {}
        for pdf in frames:
            for subject, values in pdf[["subject", "z"]].itertuples(index=False):
                if subject in w and len(values):
                    x = np.asarray(values, float).reshape(len(w[subject]), -1)
                    g = np.tanh(w[subject] @ x)
                    held[subject] = held.get(subject, 0) + np.concatenate([[x.shape[1]], (1 - g * g).sum(1), (g @ x.T).ravel()])
        yield pd.DataFrame([(s, v.tolist()) for s, v in held.items()], columns=["subject", "v"])

    return run


def rotations(z: DataFrame, sizes: dict[str, int], rounds: int, tolerance: float, seed: int) -> dict[str, np.ndarray]:
    """The rotation of each subject's whitened signals into independent components (Hyvarinen 1999, tanh, symmetric).

    A round is one pass over the blocks of subjects that still move; only n * (n + 1) sums a subject
    reach the driver.
    """
    w = {s: first_rotation(n, seed) for s, n in sizes.items()}
    going = set(w)
    for _ in range(rounds):
        if not going:
            break
        now = {s: w[s] for s in going}
        moving = z.filter(F.col("subject").isin(sorted(going))) if len(going) < min(100, len(w)) else z
        sums = summed(moving.mapInPandas(tanh_sums(now), "subject string, v array<double>"), ["subject"])
        seen = set()
        for r in sums.collect():  # a row for each subject of the wave
            s, v = r["subject"], np.asarray(r["v"])
            n = len(now[s])
            new = orthogonal(v[n + 1 :].reshape(n, n) / v[0] - (v[1 : n + 1] / v[0])[:, None] * now[s])
            if np.abs(np.abs((new * now[s]).sum(1)) - 1).max() < tolerance:
                going.discard(s)
            w[s] = new
            seen.add(s)
        going &= seen
    return w


def correlations(z: DataFrame, reference: DataFrame, w: dict[str, np.ndarray], length: int) -> DataFrame:
    """subject, reference, component, correlation of every component with every reference channel, over the instants of both."""
    rows = reference.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("block", F.floor(F.col("t_idx") / length))
    cut = rows.groupBy("subject", F.col("channel").alias("reference"), "block").agg(F.array_sort(F.collect_list(F.struct("t_idx", "value"))).alias("r"))
    both = z.join(cut.select("subject", "reference", "block", F.col("r.t_idx").alias("rt"), F.col("r.value").alias("rv")), ["subject", "block"])

    def run(frames):
        for pdf in frames:
            held: dict = {}
            for subject, reference, t, values, rt, rv in pdf[["subject", "reference", "t", "z", "rt", "rv"]].itertuples(index=False):
                _, i, j = np.intersect1d(t, rt, assume_unique=True, return_indices=True)
                n = len(w[subject])
                u, r = w[subject] @ np.asarray(values, float).reshape(n, -1)[:, i], np.asarray(rv, float)[j]
                sums = np.concatenate([[len(r), r.sum(), r @ r], u.sum(1), (u * u).sum(1), u @ r])
                held[subject, reference] = held.get((subject, reference), 0) + sums
            yield pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=["subject", "reference", "v"])

    v = F.col("v")
    sums = summed(both.mapInPandas(run, "subject string, reference string, v array<double>"), ["subject", "reference"])
    n = ((F.size(v) - 3) / 3).cast("int")
    each = sums.withColumn("n", n).withColumn("component", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda k: F.element_at(v, (4 + k * F.col("n") + F.col("component")).cast("int"))
    count, sr, srr = v[0], v[1], v[2]
    cov = count * at(2) - sr * at(0)
    return each.select("subject", "reference", "component", (cov / F.sqrt(F.nullif(F.greatest((count * srr - sr * sr) * (count * at(1) - at(0) * at(0)), F.lit(0.0)), F.lit(0.0)))).alias("correlation"))


def without_components(blocks: DataFrame, parts: dict) -> DataFrame:
    """samples of the blocks; where a subject has parts (channels, mean, unmixing rows, mixing columns), less these components."""

    def run(frames):
        for pdf in frames:
            for subject, t, channel, value in pdf[["subject", "t", "channel", "value"]].itertuples(index=False):
                value = np.array(value, float)
                if subject in parts:
                    p = parts[subject]
                    at = {c: i for i, c in enumerate(p["channels"])}
                    _, times, x = matrix(t, channel, value, p["channels"])
                    whole = ~np.isnan(x).any(0)
                    gone = np.zeros_like(x)
                    gone[:, whole] = p["mixing"] @ (p["unmixing"] @ (x[:, whole] - p["mean"][:, None]))
                    row, col = np.array([at.get(c, -1) for c in channel]), np.searchsorted(times, t)
                    value -= np.where(row >= 0, gone[np.maximum(row, 0), col], 0.0)
                yield pd.DataFrame({"subject": subject, "channel": channel, "t_idx": t, "value": value})

    return blocks.mapInPandas(run, SAMPLES)


def decomposed(s: Scratch, blocks: DataFrame, n: int, rounds: int, tolerance: float, seed: int, wave_bytes: int) -> Iterator[tuple[DataFrame, dict, DataFrame, dict]]:
    """Wave by wave of recordings: their blocks, whitening matrices by subject, whitened blocks and rotations.

    A wave's matrices and what the driver holds with them have about wave_bytes at most.
    """
    white = s.saved(whitened_by(channel_moments(blocks), n), "whitening")
    size, recordings = white.agg(F.coalesce(F.sum(8 * (F.size("white") + F.size("back") + F.size("mean")) + RECORDING_BYTES), F.lit(0)), F.count("*")).first()
    waves = max(1, min(-(-int(size) // wave_bytes), recordings))
    wave = F.pmod(F.xxhash64("subject"), F.lit(waves))
    if waves > 1:
        blocks = s.saved(blocks.withColumn("wave", wave), "waves", ("wave",))
    for k in range(waves):
        mine = blocks.filter(F.col("wave") == k).drop("wave") if waves > 1 else blocks
        state = {}
        for r in white.filter(wave == k).collect():  # about wave_bytes
            c = len(r["channels"])
            state[r["subject"]] = {"channels": r["channels"], "mean": np.array(r["mean"]), "white": np.array(r["white"]).reshape(-1, c), "back": np.array(r["back"]).reshape(c, -1)}
        z = s.saved(whitened(mine, state), "whitened")
        yield mine, state, z, rotations(z, {k: len(v["white"]) for k, v in state.items()}, rounds, tolerance, seed)


def settled(signals: list[np.ndarray], rounds: int, tolerance: float, seed: int) -> list[np.ndarray]:
    """The rotation of each of several recordings' whitened signals (n x instants), as rotations finds it.

    Recordings of one length pass their rounds as a stack, in which each has the sums that it has alone: where
    the rounds do not settle, the last bit decides, and that must not depend on the other recordings.
    """
    out: list = [None] * len(signals)
    stacks: dict = {}
    for k, x in enumerate(signals):
        stacks.setdefault(x.shape, []).append(k)
    for (n, count), at in stacks.items():
        x, at = np.stack([signals[k] for k in at]), np.array(at)
        w = np.repeat(first_rotation(n, seed)[None], len(at), 0)
        for _ in range(rounds):
            if not len(at):
                break
            g = np.tanh(w @ x)
            new = orthogonal(g @ x.transpose(0, 2, 1) / count - ((1 - g * g).sum(2) / count)[:, :, None] * w)
            done = np.abs(np.abs((new * w).sum(2)) - 1).max(1) < tolerance
            w = new
            if done.any():
                for k, found in zip(at[done], w[done]):
                    out[k] = found
                w, x, at = w[~done], x[~done], at[~done]
        for k, found in zip(at, w):
            out[k] = found
    return out


def held_components(blocks: DataFrame, n: int, rounds: int, tolerance: float, seed: int) -> DataFrame:
    """subject, component, t, value of recordings that fit a task: whitened, rotated and written out within it.

    The blocks of a recording meet in one task, one recording after the other; those of about
    TOGETHER values pass their rounds together, and nothing of them reaches the driver.
    """

    def recordings(frames):
        subject, parts = None, []
        for pdf in frames:
            for row in pdf[["subject", "t", "channel", "value"]].itertuples(index=False):
                if parts and row[0] != subject:
                    yield subject, parts
                    parts = []
                subject = row[0]
                parts.append(row[1:])
        if parts:
            yield subject, parts

    def run(frames):
        wait, size = [], 0
        for subject, parts in recordings(frames):
            sums: dict = {}
            for part in parts:
                names, v = block_moments(*part)
                sums[names] = sums.get(names, 0) + v
            names = max(sorted(sums), key=lambda c: (len(c), sums[c][0]))
            if (found := whitening(sums[names], len(names), n)) is not None:
                each = [block_whitened(*part, names, *found[:2]) for part in parts]
                wait.append((subject, np.concatenate([t for t, _ in each]), np.concatenate([z for _, z in each], 1)))
                size += wait[-1][2].size
            if size >= TOGETHER:
                yield components(wait)
                wait, size = [], 0
        if wait:
            yield components(wait)

    def components(wait):
        u = [w @ z for w, (_, _, z) in zip(settled([z for _, _, z in wait], rounds, tolerance, seed), wait)]
        return pd.DataFrame({
            "subject": np.repeat(np.array([subject for subject, _, _ in wait], object), [x.size for x in u]),
            "component": np.concatenate([np.repeat(np.arange(len(x)), x.shape[1]) for x in u]),
            "t": np.concatenate([np.tile(t, len(x)) for x, (_, t, _) in zip(u, wait)]),
            "value": np.concatenate([x.ravel() for x in u]),
        })

    whole = blocks.repartition("subject").sortWithinPartitions("subject", "block")
    return whole.mapInPandas(run, "subject string, component int, t long, value double")


def independent_components(samples: DataFrame, n: int = 2, block: int = 10_000, rounds: int = 200, tolerance: float = 1e-6, seed: int = 42, wave_bytes: int = WAVE_BYTES, task_values: int = TASK_VALUES) -> DataFrame:
    """subject, component, t, value: the components over the instants that have all channels.

    Recordings of up to task_values values are each decomposed within one task; the rounds of longer ones
    are passes over their blocks, in waves that bound what the driver holds.
    """
    with scratch(samples.sparkSession) as s:
        blocks = s.saved(instants(samples, block), "instants")
        sizes = blocks.groupBy("subject").agg(F.sum(F.size("t")).alias("values"))
        long = s.saved(sizes.filter(F.col("values") > task_values).select("subject"), "long")
        some = not long.isEmpty()
        with small_batches(samples.sparkSession):
            out = [s.saved(held_components(blocks.join(long, "subject", "left_anti") if some else blocks, n, rounds, tolerance, seed), "components", lasts=True)]
        if some:
            mine = s.saved(blocks.join(long, "subject", "left_semi"), "instants")
            for _, _, z, w in decomposed(s, mine, n, rounds, tolerance, seed, wave_bytes):
                out.append(s.saved(sources(z, w), "components", lasts=True))
    return reduce(DataFrame.unionByName, out)


def sources(z: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for subject, t, values in pdf[["subject", "t", "z"]].itertuples(index=False):
                u = w[subject] @ np.asarray(values, float).reshape(len(w[subject]), -1)
                i, at = np.indices(u.shape)
                yield pd.DataFrame({"subject": subject, "component": i.ravel(), "t": np.asarray(t)[at.ravel()], "value": u.ravel()})

    return z.mapInPandas(run, "subject string, component int, t long, value double")


def lagged(samples: DataFrame, lags: int) -> DataFrame:
    """Copies of every channel that run 0 to lags - 1 samples ahead, as channels of their own."""
    rows = samples.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1)))).filter("t_idx >= lag")
    return rows.select("subject", F.concat("channel", F.lit("+"), F.col("lag").cast("string")).alias("channel"), (F.col("t_idx") - F.col("lag")).alias("t_idx"), "value")


def components_removed(samples: DataFrame, reference: DataFrame, n: int = 30, threshold: float = 0.9, block: int = 10_000, rounds: int = 200, tolerance: float = 1e-6, seed: int = 42, wave_bytes: int = WAVE_BYTES) -> tuple[DataFrame, DataFrame]:
    """samples without the component that follows each reference channel, and what was found of each.

    For every reference channel (heart, eyes) the component of largest absolute correlation goes if that
    reaches the threshold.  The second table has subject, reference, component, correlation, removed.
    Components come from the instants that have all channels; the others pass as they are, and so do
    recordings with none such.  Covariances, the fixed-point rounds and correlations are sums over blocks.
    """
    spark = samples.sparkSession
    cleaned, found = [], []
    with scratch(spark) as s:
        blocks = s.saved(instants(samples, block), "instants")
        for mine, state, z, w in decomposed(s, blocks, n, rounds, tolerance, seed, wave_bytes):
            rows = [tuple(r) for r in correlations(z, reference, w, block).collect()]  # n rows a subject and reference
            best: dict = {}
            for subject, name, component, r in sorted(rows, key=lambda r: r[:3]):
                if r is not None and abs(r) > abs(best.get((subject, name), (0, 0.0))[1]):
                    best[subject, name] = (component, r)
            bad: dict = {}
            for (subject, _), (component, r) in best.items():
                if abs(r) >= threshold:
                    bad.setdefault(subject, set()).add(component)
            parts = {}
            for subject, those in bad.items():
                at, v = sorted(those), state[subject]
                parts[subject] = {"channels": v["channels"], "mean": v["mean"], "unmixing": (w[subject] @ v["white"])[at], "mixing": (v["back"] @ w[subject].T)[:, at]}
            cleaned.append(s.saved(without_components(mine, parts), "cleaned", lasts=True))
            marked = [(*r, best.get(r[:2], (None,))[0] == r[2] and r[2] in bad.get(r[0], ())) for r in rows]
            found.append(s.saved(spark.createDataFrame(marked, "subject string, reference string, component int, correlation double, removed boolean"), "correlations", lasts=True))
    return reduce(DataFrame.unionByName, cleaned), reduce(DataFrame.unionByName, found)


def cleaned(samples: DataFrame, sfreq: float, types: DataFrame, config: RunConfig, line: float | None = 50.0, components: int = 30) -> DataFrame:
    """The chain by the run's settings: rate, line frequency, band, reference, artefact components.

    types (channel, type): sensors are channels of config.which_sensor (meg: mag and grad too); ecg and
    eog channels serve as references and leave at the end, and so do all others.
    """
    kinds = ["mag", "grad", "meg"] if config.which_sensor == "meg" else [config.which_sensor]
    kind = F.broadcast(types.select("channel", F.lower("type").alias("type")))
    rate = min(config.resample_rate, sfreq) if config.resample_rate else sfreq
    at_rate = resampled(samples, sfreq, rate)
    smooth = filtered(at_rate, rate, config.cutoff_low, config.cutoff_high, line)
    with_kind = smooth.join(kind, "channel")
    sensors = with_kind.filter(F.col("type").isin(kinds)).drop("type")
    if config.which_sensor == "eeg" and config.reference == "average":
        sensors = average_reference(sensors)
    references = with_kind.filter(F.col("type").isin("ecg", "eog")).drop("type")
    return components_removed(sensors, references, components, config.ica_corr_threshold, seed=config.random_state)[0]
