"""Quality control of recordings, subjects and jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltsheaf.functions import kernels
from voltsheaf.operators import stats


def robust_z(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """df with robust_z and failed: distance from the median in scaled MADs; only the low tail fails.

    The scale is 1.4826 MAD, if that is 0 the interquartile range over 1.349, if that is 0 one.
    Both passes give one row, which is then sent to all tasks.
    """
    first = stats.quantiles(df, value, {"__med": 0.5, "__q1": 0.25, "__q3": 0.75})
    near = df.crossJoin(F.broadcast(first))  # one row
    scale = stats.quantiles(near.select(F.abs(F.col(value) - F.col("__med")).alias("__d")), "__d", {"__mad": 0.5})
    iqr = F.col("__q3") - F.col("__q1")
    unit = F.when(F.col("__mad") > 0, 1.4826 * F.col("__mad")).when(iqr > 0, iqr / 1.349).otherwise(1.0)
    out = near.crossJoin(F.broadcast(scale)).withColumn("robust_z", (F.col(value) - F.col("__med")) / unit)  # one row
    return out.withColumn("failed", F.col("robust_z") < -threshold).drop("__med", "__q1", "__q3", "__mad")


def absolute_deviation(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """df with failed: further than the threshold from the median, on either side."""
    return df.crossJoin(F.broadcast(stats.quantiles(df, value, {"__med": 0.5}))).withColumn("failed", F.abs(F.col(value) - F.col("__med")) > threshold).drop("__med")  # one row


def hemisphere_minimum(df: DataFrame, left: str = "lh_en", right: str = "rh_en") -> DataFrame:
    return df.withColumn("en", F.least(left, right))


def binned_mean_std(df: DataFrame, value: str, covariate: str, start: int, stop: int, step: int, by: tuple = ()) -> DataFrame:
    """Mean and population deviation of values in covariate bins [s, s + step); others are left out."""
    inside = df.filter((F.col(covariate) >= start) & (F.col(covariate) < stop + step))
    lo = (F.floor((F.col(covariate) - start) / step) * step + start).cast("int")
    return inside.groupBy(*by, lo.alias("bin_lo")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def extreme_rates(z: DataFrame, group: str, run: str, value: str = "z", limit: float = 2.0) -> DataFrame:
    """Per group: mean over runs of the percentage of z beyond the limit (strictly), with its 95 % half-width."""
    per_run = z.groupBy(group, run).agg((F.avg((F.col(value) > limit).cast("double")) * 100).alias("hi"), (F.avg((F.col(value) < -limit).cast("double")) * 100).alias("lo"))
    half = lambda c: 1.96 * F.stddev_samp(c) / F.sqrt(F.count("*"))
    return per_run.groupBy(group).agg(F.avg("hi").alias("mean_high"), half("hi").alias("ci_high"), F.avg("lo").alias("mean_low"), half("lo").alias("ci_low"))


def modal_level(df: DataFrame, column: str) -> DataFrame:
    """The most frequent level, the first in order of equals."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(1)


def scaled_curve(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per curve: x of its greatest and least value (the first of equals), and both values."""
    return curve.groupBy(*by).agg(F.max(F.struct(F.col(y), -F.col(x))).alias("hi"), F.min(F.struct(F.col(y), F.col(x))).alias("lo")).select(*by, (-F.col("hi.col2")).alias("x_peak"), F.col(f"hi.{y}").alias("y_peak"), F.col(f"lo.{x}").alias("x_trough"), F.col(f"lo.{y}").alias("y_trough"))


def percent_of_range(curve: DataFrame, by: list[str], y: str) -> DataFrame:
    """y scaled to 0..100 % of its curve's range; NULL for a constant curve."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(y).over(w), F.max(y).over(w)
    return curve.withColumn(y, F.when(hi > lo, (F.col(y) - lo) / (hi - lo) * 100))


def slope_changes(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Points where the sign of the slope differs from that of the slope before; a zero slope counts."""
    w = Window.partitionBy(*by).orderBy(x)
    before, after = F.signum(F.col(y) - F.lag(y).over(w)), F.signum(F.lead(y).over(w) - F.col(y))
    return curve.withColumn("__b", before).withColumn("__a", after).filter(F.col("__b") != F.col("__a")).select(*by, x, y)


def largest_ratio(df: DataFrame, by: list[str], index: str, value: str) -> DataFrame:
    """Place (from 0) and size of the largest |value / next value|, the first of equals; pairs with
    a zero are left out, and without any other pair both are 0."""
    w = Window.partitionBy(*by).orderBy(index)
    after = F.lead(value).over(w)
    pairs = df.select(*by, (F.row_number().over(w) - 1).alias("i"), F.when(F.col(value) != 0, F.abs(F.col(value) / F.nullif(after, F.lit(0.0)))).alias("r"))
    best = pairs.groupBy(*by).agg(F.max(F.when(F.col("r").isNotNull(), F.struct("r", (-F.col("i")).alias("i")))).alias("best"))
    return best.select(*by, F.coalesce(-F.col("best.i"), F.lit(0)).cast("long").alias("idx"), F.coalesce(F.col("best.r"), F.lit(0.0)).alias("ratio"))


def best_component(series: DataFrame, by: list[str], component: str, value: str, reference: str, threshold: float = 0.5) -> DataFrame:
    """The component that correlates most with a reference signal, where |r| reaches the threshold."""
    r = series.groupBy(*by, component).agg(F.corr(value, reference).alias("r"))
    best = r.groupBy(*by).agg(F.max_by(F.struct(component, "r"), F.struct(F.abs("r").alias("a"), F.col(component))).alias("b"))
    return best.select(*by, F.col(f"b.{component}").alias(component), F.col("b.r").alias("r")).filter(F.abs("r") >= threshold)


def job_states(lines: DataFrame, line: str = "line") -> DataFrame:
    """job, state of scheduler lines "name|state words"; malformed lines are left out."""
    parts = F.split(line, r"\|")
    return lines.filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("job"), F.element_at(F.split(F.trim(parts[1]), " "), 1).alias("state"))


def state_counts(states: DataFrame, state: str = "state") -> DataFrame:
    return states.groupBy(state).agg(F.count("*").alias("n"))


def subject_status(has_log: Column, success: Column, minutes_since: Column, locked: Column, lock_minutes: Column) -> Column:
    """missing, success, running (touched within 30 minutes), stalled (locked, untouched for a day) or failed."""
    fresh = (minutes_since <= 30) | F.coalesce(lock_minutes <= 30, F.lit(False))
    return F.when(~has_log, "missing").when(success, "success").when(fresh, "running").when(locked & (minutes_since > 1440) & (lock_minutes > 1440), "stalled").otherwise("failed")


def covariances(wide: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Sample covariances of all column pairs, in one pass: by, a, b, cov."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = wide.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return row.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`").alias("cov")) for a, b in pairs])).alias("x")).select(*by, "x.a", "x.b", "x.cov")


def shrunk(cov: DataFrame, by: list[str], dimensions: int, shrinkage: float = 0.05) -> DataFrame:
    """Covariances shrunk towards the mean variance: (1 - s) C + s tr(C) / p I."""
    trace = cov.filter("a = b").groupBy(*by).agg((F.sum("cov") / dimensions).alias("__m"))
    return cov.join(trace, by).withColumn("cov", (1 - shrinkage) * F.col("cov") + F.when(F.col("a") == F.col("b"), shrinkage * F.col("__m")).otherwise(0.0)).drop("__m")


def flat_or_noisy(samples: DataFrame, by: list[str], value: str, flat: float, noisy: float) -> DataFrame:
    """by, sd, verdict: channels whose deviation lies under flat or over noisy, else good."""
    sd = F.stddev_samp(value)
    return samples.groupBy(*by).agg(sd.alias("sd")).withColumn("verdict", F.when(F.col("sd") < flat, "flat").when(F.col("sd") > noisy, "noisy").otherwise("good"))


def bad_channels(samples: DataFrame, window: int, flat: float, limit: float = 7.0, least: int = 5, known: DataFrame | None = None) -> DataFrame:
    """subject, channel, n_windows, n_noisy, n_flat, verdict (known, flat, noisy or good).

    samples: subject, channel, t_idx, value, cut into windows of ``window`` samples.  In a window a
    channel is flat if its values span less than ``flat``, and noisy if its deviation is over the
    median of the recording's channels by more than ``limit`` scaled MADs; a channel that is so in
    ``least`` windows is bad, so that a short burst is not.  Where all channels of a window deviate
    alike (MAD 0) none is noisy there.  Windows without values do not count; a channel without any
    has no row.  known: subject, channel of those marked before.  The medians are over the channels
    of one window, so no group grows with the length of a recording.
    """
    here = ["subject", F.floor(F.col("t_idx") / window).alias("__w")]
    valid = samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    per = valid.groupBy(*here, "channel").agg((F.max("value") - F.min("value")).alias("__span"), F.stddev_samp("value").alias("__sd"))
    among = Window.partitionBy("subject", "__w")  # a row a channel
    apart = per.withColumn("__d", F.col("__sd") - F.median("__sd").over(among)).withColumn("__mad", F.median(F.abs("__d")).over(among))
    noisy = F.coalesce((F.col("__mad") > 0) & (F.col("__d") / (1.4826 * F.col("__mad")) > limit), F.lit(False))
    out = apart.groupBy("subject", "channel").agg(F.count("*").alias("n_windows"), F.count_if(noisy).alias("n_noisy"), F.count_if(F.col("__span") < flat).alias("n_flat"))
    marked = F.lit(False)
    if known is not None:
        out = out.join(known.select("subject", "channel").distinct().withColumn("__known", F.lit(True)), ["subject", "channel"], "left")
        marked = F.coalesce("__known", F.lit(False))
    verdict = F.when(marked, "known").when(F.col("n_flat") >= least, "flat").when(F.col("n_noisy") >= least, "noisy").otherwise("good")
    return out.select("subject", "channel", "n_windows", "n_noisy", "n_flat", verdict.alias("verdict"))


def without_bad_channels(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """samples of channels that no verdict calls bad: of a recording, or of the empty room that goes with it."""
    return samples.join(verdicts.filter("verdict <> 'good'").select("subject", "channel"), ["subject", "channel"], "left_anti").select(*samples.columns)


def covariance_spectrum(cov: DataFrame, by: list[str], tolerance: float = 1e-10, least: int = 15, default: int = 30) -> DataFrame:
    """by, rank, condition, components of covariance matrices given as rows (a, b, cov): the square of the
    number of channels in a group, whatever the length of the recordings.

    components: where explained variance has its elbow, or the default.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cov.select(*by).schema.fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["cov"]):
            m[at[a], at[b]] = m[at[b], at[a]] = c
        values = np.linalg.eigvalsh(m)
        good = values > tolerance * max(values[-1], 0.0)
        condition = float(values[-1] / values[0]) if good.all() and len(values) else None
        return pd.DataFrame([(*key, int(good.sum()), condition, kernels.pca_elbow(values[::-1], least, default))], columns=[*by, "rank", "condition", "components"])

    return cov.groupBy(*by).applyInPandas(run, f"{fields}, rank int, condition double, components int")
