"""Kernels over spectra and series: Spark cuts recordings into segments, numpy works on blocks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.functions import kernels
from voltsheaf.operators.stats import normal_quantile, ordered, sequence

#: Models of either method: the aperiodic fit (knee: NULL where none was asked for), log10 of its curve, and peaks.
MODEL = "subject string, channel string, offset double, knee double, exponent double, r2 double, ap array<double>, peaks array<struct<cf:double,pw:double,bw:double>>"
FIT = ["offset", "knee", "exponent", "r2", "ap", "peaks"]


def event_series(spark, sf_dir: str) -> DataFrame:
    """events as samples: subject, channel, t_idx (the number of a sample in its recording), value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("value").isNotNull())
    return sequence(e, ["user_id"], ["event_id"], "t_idx").select(F.col("user_id").cast("string").alias("subject"), F.lit("value").alias("channel"), "t_idx", "value")


def segments(samples: DataFrame, length: int, step: int) -> DataFrame:
    """subject, channel, segment, x: windows of ``length`` samples, one every ``step``, each a row.

    A sample is sent to the windows that hold it, so a long recording is many rows and many tasks,
    never one array.  Windows at the end that are not full go, but a recording shorter than one
    window keeps what it has as its only segment.  t_idx numbers the samples of a recording from 0.
    """
    first, last = F.greatest(F.floor((F.col("t_idx") - length) / step) + 1, F.lit(0)), F.floor(F.col("t_idx") / step)
    rows = samples.filter(F.col("value").isNotNull()).withColumn("segment", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "value"))), lambda x: x["value"])
    cut = rows.groupBy("subject", "channel", "segment").agg(ordered.alias("x"))
    lengths = samples.filter(F.col("value").isNotNull()).groupBy("subject", "channel").agg((F.max("t_idx") + 1).alias("n"))
    return cut.join(lengths, ["subject", "channel"]).filter((F.size("x") == length) | ((F.col("n") < length) & (F.col("segment") == 0))).drop("n")


def spectra_of(cut: DataFrame, names: tuple[str, ...], kernel) -> DataFrame:
    """Spectra of segments, averaged by recording: subject, channel, freqs and an array for each name.

    kernel takes a block of equally long segments, the rows of a matrix, and gives the frequencies
    and for each name a matrix of as many rows.
    """

    def run(frames):
        for pdf in frames:
            for _, part in pdf.groupby(pdf["x"].map(len)):
                x = np.stack([np.asarray(v, float) for v in part["x"]])
                if x.shape[1] < 4:
                    continue
                freqs, *power = kernel(x)
                yield part[["subject", "channel"]].assign(freqs=[freqs] * len(part), **{n: list(p) for n, p in zip(names, power)})

    fields = ", ".join(f"{n} array<double>" for n in ("freqs", *names))
    each = cut.select("subject", "channel", "x").mapInPandas(run, f"subject string, channel string, {fields}")
    points = each.select("subject", "channel", F.posexplode(F.arrays_zip("freqs", *names)).alias("i", "p")).select("subject", "channel", "i", "p.*")
    means = points.groupBy("subject", "channel", "i").agg(F.first("freqs").alias("freqs"), *[F.avg(n).alias(n) for n in names])
    whole = means.groupBy("subject", "channel").agg(F.array_sort(F.collect_list(F.struct("i", "freqs", *names))).alias("p"))
    return whole.select("subject", "channel", *[F.col(f"p.{n}").alias(n) for n in ("freqs", *names)])


def banded(freqs: np.ndarray, band: tuple, *power: np.ndarray) -> list[np.ndarray]:
    keep = (freqs >= band[0]) & (freqs <= band[1])
    return [freqs[keep], *[p[..., keep] for p in power]]


def welch(samples: DataFrame, sfreq: float, segment: float = 2.0, overlap: float = 1.0, band: tuple = (0.0, float("inf"))) -> DataFrame:
    """subject, channel, freqs, power: the mean of the periodograms of overlapping segments."""
    n = int(round(segment * sfreq))
    cut = segments(samples, n, max(1, n - int(round(overlap * sfreq))))
    return spectra_of(cut, ("power",), lambda x: banded(np.fft.rfftfreq(x.shape[1], 1 / sfreq), band, kernels.periodograms(x, sfreq)))


def multitaper(samples: DataFrame, sfreq: float, segment: float = 2.0, overlap: float = 1.0, band: tuple = (0.0, float("inf")), tapers: int = 7) -> DataFrame:
    """subject, channel, freqs, power: the mean of the multitaper spectra of the segments."""
    n = int(round(segment * sfreq))
    cut = segments(samples, n, max(1, n - int(round(overlap * sfreq))))
    return spectra_of(cut, ("power",), lambda x: banded(np.fft.rfftfreq(x.shape[1], 1 / sfreq), band, kernels.multitaper(x, sfreq, tapers)))


def parameterize(psd: DataFrame, knee: bool = False, fit_range: tuple = (3.0, 40.0), **options) -> DataFrame:
    """The spectral model of each spectrum.  A fit takes milliseconds while a spectrum is a few hundred
    bytes, so spectra are dealt out by recording and channel first."""

    def run(frames):
        for pdf in frames:
            out = []
            for f, p in zip(pdf["freqs"], pdf["power"]):
                f, p = np.asarray(f, float), np.asarray(p, float)
                keep = (f >= fit_range[0]) & (f <= fit_range[1])
                out.append(kernels.parameterize(f[keep], p[keep], knee, **options))
            yield pd.concat([pdf[["subject", "channel"]].reset_index(drop=True), pd.DataFrame(out, columns=FIT)], axis=1)

    return dealt(psd, "power").mapInPandas(run, MODEL)


def dealt(spectra: DataFrame, power: str) -> DataFrame:
    """Spectra dealt out by recording and channel."""
    spark = spectra.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spectra.select("subject", "channel", "freqs", power).repartition(parts, "subject", "channel")


def aperiodic_models(spectra: DataFrame, knee: bool = False) -> DataFrame:
    """Models of aperiodic spectra (freqs, aperiodic): offset, exponent and fit, without peaks."""

    def run(frames):
        for pdf in frames:
            out = []
            for f, p in zip(pdf["freqs"], pdf["aperiodic"]):
                f, p = np.asarray(f, float), np.asarray(p, float)
                good = (f > 0) & (p > 0)
                if good.sum() < 6:
                    out.append((None, None, None, None, [], []))
                    continue
                x, y = f[good], np.log10(p[good])
                fit = kernels.aperiodic_fit(x, y, knee)
                rest, spread = y - kernels.aperiodic_curve(x, fit), y - y.mean()
                r2 = 1 - float(rest @ rest / (spread @ spread)) if spread @ spread > 0 else None
                out.append((float(fit[0]), kernels.knee_of(fit), float(fit[-1]), r2, kernels.aperiodic_curve(np.where(f > 0, f, np.nan), fit).tolist(), []))
            yield pd.concat([pdf[["subject", "channel"]].reset_index(drop=True), pd.DataFrame(out, columns=FIT)], axis=1)

    return dealt(spectra, "aperiodic").mapInPandas(run, MODEL)


def irasa(samples: DataFrame, sfreq: float, band: tuple, segment: float = 10.0, overlap: float = 2.0, factors: np.ndarray | None = None) -> DataFrame:
    """subject, channel, freqs, power, aperiodic, periodic: IRASA of every epoch, then the mean over epochs."""
    n = int(round(segment * sfreq))
    cut = segments(samples, n, max(1, n - int(round(overlap * sfreq))))

    def kernel(x: np.ndarray):
        each = [kernels.irasa(v, sfreq, band, factors) for v in x]
        return [each[0]["freqs"], *[np.stack([e[k] for e in each]) for k in ("power", "aperiodic", "periodic")]]

    return spectra_of(cut, ("power", "aperiodic", "periodic"), kernel)


def shapiro_by_bins(df: DataFrame, response: str, covariate: str, z: str, n_bins: int = 10, include_right_edge: bool = False) -> DataFrame:
    """Mean Shapiro-Wilk W over equal-width covariate bins, by response.

    As edges are half-open, the largest covariate falls outside the last bin unless asked for.
    Bins of fewer than three values have no W and make no mean worse.
    """
    w = df.groupBy(response).agg(F.min(covariate).alias("__lo"), F.max(covariate).alias("__hi"))
    rows = df.join(w, response).withColumn("bin", F.floor((F.col(covariate) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * n_bins))
    if include_right_edge:
        rows = rows.withColumn("bin", F.least("bin", F.lit(n_bins - 1)))
    rows = rows.filter(F.col("bin").between(0, n_bins - 1))

    # W is (sum of weights times order statistics) squared over the sum of squares: places by ranges, sums by groups
    finite = rows.filter(F.col(z).isNotNull() & ~F.isnan(z)).select(response, "bin", F.col(z).alias("__z"))
    n, i = F.col("__n").cast("double"), F.col("__i")
    scored = ordered(finite, "__z", [response, "bin"]).withColumn("__m", normal_quantile((i - 0.375) / (n + 0.25)))
    moments = scored.groupBy(response, "bin").agg(F.first("__n").alias("__n"), F.sum(F.col("__m") * F.col("__m")).alias("ss"), F.sum(F.col("__m") * F.col("__z")).alias("mz"), F.var_pop("__z").alias("v"), *[F.max(F.when(F.col("__i") == at, F.col(c))).alias(k) for k, c, at in (("m1", "__m", F.col("__n")), ("m2", "__m", F.col("__n") - 1), ("hi", "__z", F.col("__n")), ("hi2", "__z", F.col("__n") - 1), ("lo", "__z", F.lit(1)), ("lo2", "__z", F.lit(2)))])
    return moments.withColumn("w", shapiro_from_moments()).groupBy(response).agg(F.avg("w").alias("w"), F.count("w").alias("n_bins"))


def shapiro_from_moments():
    """W from the sums of a group (Royston 1995); null for fewer than three values or equal ones.

    ss: sum of squared normal scores, mz: scores times values, m1, m2: the two largest scores, hi,
    hi2, lo, lo2: the two largest and smallest values, v: variance.
    """
    n, ss, m1, m2 = F.col("__n").cast("double"), F.col("ss"), F.col("m1"), F.col("m2")
    u, root = 1 / F.sqrt(n), F.sqrt(ss)
    # fixed values: the published polynomials for the two extreme weights
    last = m1 / root + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - 2.706056 * u))))
    second = m2 / root + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u))))
    ends, ends2 = F.col("hi") - F.col("lo"), F.col("hi2") - F.col("lo2")
    wide = (ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * last * last - 2 * second * second)
    narrow = (ss - 2 * m1 * m1) / (1 - 2 * last * last)
    big = last * ends + second * ends2 + (F.col("mz") - m1 * ends - m2 * ends2) / F.sqrt(wide)
    small = last * ends + (F.col("mz") - m1 * ends) / F.sqrt(narrow)
    total = F.when(n == 3, F.sqrt(F.lit(0.5)) * ends).when(n > 5, big).otherwise(small)
    return F.when((n >= 3) & (ends > 0), total * total / (n * F.col("v")))
