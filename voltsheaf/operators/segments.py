"""Segmentation of recordings and events: epochs, blocks, rejection by amplitude and annotation.

Times are seconds (or samples) as numbers, so that the same expressions serve both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epochs(samples: DataFrame, t: str, length: float, by: tuple = ()) -> DataFrame:
    """samples with the number and start of their fixed-length epoch."""
    k = F.floor(F.col(t) / length)
    return samples.withColumn("epoch", k).withColumn("epoch_start", k * length)


def amplitudes(samples: DataFrame, by: list[str], channel: str, value: str) -> DataFrame:
    """Peak-to-peak amplitude of each channel of each epoch."""
    return samples.groupBy(*by, channel).agg((F.max(value) - F.min(value)).alias("ptp"), F.count("*").alias("n"))


def rejected_epochs(amplitude: DataFrame, by: list[str], reject: float, flat: float) -> DataFrame:
    """Epochs with their verdict: a channel over reject (noisy), else one under flat (flat), else good."""
    wide = amplitude.groupBy(*by).agg(F.max("ptp").alias("max_ptp"), F.min("ptp").alias("min_ptp"), F.count("*").alias("n_channels"))
    return wide.withColumn("verdict", F.when(F.col("max_ptp") > reject, "noisy").when(F.col("min_ptp") < flat, "flat").otherwise("good"))


def rejection_summary(verdicts: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """Counts by verdict, the share retained in percent and its length in seconds."""
    good = F.sum((F.col("verdict") == "good").cast("long"))
    return verdicts.groupBy(*by).agg(F.count("*").alias("total"), good.alias("good"), F.sum((F.col("verdict") == "noisy").cast("long")).alias("noisy"), F.sum((F.col("verdict") == "flat").cast("long")).alias("flat"), (good / F.count("*") * 100).alias("retained"), (good * seconds).alias("seconds"))


def noise_flags(samples: DataFrame, by: list[str], t: str, channel: str, value: str, window: int, step: int, reject: float, flat: float, span: DataFrame | None = None) -> DataFrame:
    """Sliding windows with a channel over reject (BAD_peak) or, else, under flat (BAD_flat).

    A sample is copied to the few windows it lies in; only windows within the recording count.
    """
    ends = samples.groupBy(*by).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"))
    k = F.floor(F.col(t) / step)
    rows = samples.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(-(-window // step) - 1)), lambda i: (k - i) * step)))
    rows = rows.filter(F.col(t) < F.col("start") + window)
    ptp = rows.groupBy(*by, "start", channel).agg((F.max(value) - F.min(value)).alias("ptp"))
    flags = ptp.groupBy(*by, "start").agg(F.max("ptp").alias("hi"), F.min("ptp").alias("lo"))
    flags = flags.join(ends, by).filter((F.col("start") >= F.col("__t0")) & (F.col("start") + window <= F.col("__t1")))
    return flags.select(*by, "start", F.when(F.col("hi") > reject, "BAD_peak").when(F.col("lo") < flat, "BAD_flat").alias("flag")).filter("flag is not null")


def noisy_epochs(samples: DataFrame, epoch: list[str], channel: str, value: str, limit: float) -> DataFrame:
    """Epochs in which a channel's deviation lies more than limit deviations above that channel's mean."""
    spread = samples.groupBy(*epoch, channel).agg(F.stddev_pop(value).alias("sd"))
    stats = spread.groupBy(channel).agg(F.avg("sd").alias("m"), F.stddev_pop("sd").alias("s"))
    z = spread.join(stats, channel).withColumn("z", F.when(F.col("s") > 0, (F.col("sd") - F.col("m")) / F.col("s")))
    return z.groupBy(*epoch).agg(F.max("z").alias("max_z")).filter(F.col("max_z") > limit)


def blocks(events: DataFrame, by: list[str], t: str, kind: str, wanted, end: DataFrame | None = None) -> DataFrame:
    """Blocks from each wanted event to the next event; the last runs to the end of the recording.

    end: by and the column end; without it the last event's time.
    """
    w = Window.partitionBy(*by).orderBy(t, kind)
    rows = events.withColumn("stop", F.lead(t).over(w))
    last = events.groupBy(*by).agg(F.max(t).alias("end")) if end is None else end
    rows = rows.join(last, by).withColumn("stop", F.coalesce("stop", "end"))
    return rows.filter(F.col(kind) == wanted).select(*by, F.col(t).alias("start"), "stop", (F.col("stop") - F.col(t)).alias("duration"))


def block_onsets(found: DataFrame, by: list[str], length: float, overlap: float) -> DataFrame:
    """Overlapping segments of blocks that are long enough, on the time axis of the blocks strung together.

    A group without such a block raises nothing here: it has no rows (see assert_blocks).
    """
    step = length - overlap
    good = found.filter(F.col("duration") >= length)
    w = Window.partitionBy(*by).orderBy("start")
    placed = good.withColumn("offset", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("block", F.row_number().over(w) - 1)
    n = F.floor((F.col("duration") - length + 1e-9) / step).cast("int")
    rows = placed.withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    return rows.select(*by, "block", "k", (F.col("offset") + F.col("k") * step).alias("onset"), (F.col("start") + F.col("k") * step).alias("source_time"))


def assert_blocks(found: DataFrame, length: float) -> DataFrame:
    if found.filter(F.col("duration") >= length).isEmpty():
        raise ValueError("no block is as long as a segment")
    return found


def trimmed(annotations: DataFrame, by: list[str], onset: str, duration: str, label: str, before: float, after: float, ties: tuple = ()) -> DataFrame:
    """Annotated stretches cut at both ends and strung together by label; too short ones are left out.

    ties: columns that order stretches of one label that begin together; without them the shorter comes first.
    """
    good = annotations.filter(F.col(duration) > before + after)
    kept = good.withColumn("start", F.col(onset) + before).withColumn("length", F.col(duration) - before - after)
    w = Window.partitionBy(*by, label).orderBy("start", *ties, "length").rowsBetween(Window.unboundedPreceding, -1)
    return kept.select(*by, label, "start", "length", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("position"))


def without_overlap(segments: DataFrame, annotations: DataFrame, by: list[str], width: float) -> DataFrame:
    """Segments (start, stop) that no annotation (onset, duration) overlaps; touching is no overlap.

    Both sides are cut into cells of the time axis, an equi-join, instead of comparing all pairs.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    s = segments.select(*by, "start", "stop", cells(F.col("start"), F.col("stop")).alias("__cell"))
    a = annotations.select(*by, "onset", (F.col("onset") + F.col("duration")).alias("__end")).withColumn("__cell", cells(F.col("onset"), F.col("__end")))
    hit = s.join(a, [*by, "__cell"]).filter((F.col("onset") < F.col("stop")) & (F.col("__end") > F.col("start"))).select(*by, "start", "stop").distinct()
    return segments.join(hit, [*by, "start", "stop"], "left_anti")


def cropped(samples: DataFrame, by: list[str], t: str, tmin: float = 20.0, tmax: float = -20.0) -> DataFrame:
    """Samples from tmin to |tmax| before the end of the recording."""
    if tmax >= 0:
        raise ValueError("tmax is negative: seconds before the end")
    ends = samples.groupBy(*by).agg(F.max(t).alias("__t1"))
    return samples.join(ends, by).filter((F.col(t) >= tmin) & (F.col(t) <= F.floor(F.col("__t1") + tmax))).drop("__t1")


def usable(annotations: DataFrame, totals: DataFrame, by: list[str], step: float, length: float) -> DataFrame:
    """Recordings whose time without annotated movement has room for a segment after both crops."""
    moved = annotations.groupBy(*by).agg(F.sum("duration").alias("__moved"))
    return totals.join(moved, by, "left").withColumn("usable", F.col("total") - F.coalesce("__moved", F.lit(0.0))).filter(F.col("usable") >= 2 * step + length).drop("__moved")


def weighted_parcels(samples: DataFrame, weights: DataFrame, t: str = "t_idx", value: str = "value") -> DataFrame:
    """Region time courses from a given region x channel weight matrix (small, broadcast by its size)."""
    return samples.join(weights, "channel").groupBy("subject", "region", t).agg(F.sum(F.col("weight") * F.col(value)).alias(value))
