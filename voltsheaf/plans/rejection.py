"""Rejection of epochs by thresholds that cross-validation learns.

Epochs are rows (subject, channel, epoch, x), as segments() cuts them.  For each channel a grid of
peak-to-peak thresholds is tried: the mean of the training epochs that a threshold keeps is held
against the pointwise median of the left-out fold, and the threshold of least mean error wins.  Then, in
the same way, the largest share of bad channels that an epoch may have is learnt for each recording.

All sums are aggregates by (fold, step of the grid, point), which combine on the map side; sums of
training folds and of thresholds are differences and running totals of these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(epoch: str, folds: int):
    """The fold of an epoch by a hash of its number, the same in every engine."""
    return F.pmod(F.pmod(F.col(epoch) * F.lit(40503), F.lit(65521)), F.lit(folds)).cast("int")


def spans(epochs: DataFrame) -> DataFrame:
    """epochs with ptp, the distance of the largest from the smallest value."""
    return epochs.withColumn("ptp", F.array_max("x") - F.array_min("x"))


def stepped(rows: DataFrame, by: list[str], value: str, steps: int) -> DataFrame:
    """rows with step: the first of so many equal steps from the least to the largest value of a group that reaches the row's."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.ceil((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * steps)
    return rows.join(ends, by).withColumn("step", F.greatest(F.lit(1), F.least(F.coalesce(at, F.lit(1)), F.lit(steps))).cast("int"))


def held_out_errors(epochs: DataFrame, by: list[str], steps: int, folds: int) -> DataFrame:
    """by, step, error: the mean over folds of the root mean square distance of the kept training mean from the fold's median.

    epochs: channel, epoch, step and x beside by; a group's points are all points of all its channels.
    A step that leaves some fold without training epochs, or that no epoch is at, has no row; a fold without epochs takes no part.
    """
    keys = list(dict.fromkeys([*by, "channel"]))
    points = epochs.select(*keys, fold("epoch", folds).alias("fold"), "step", F.posexplode("x").alias("t", "v"))
    # medians and sums of a point and fold: at most the fold's epochs meet, never a recording
    cells = points.groupBy(*keys, "t", "fold").agg(F.median("v").alias("median"), *[F.sum(F.when(F.col("step") == j, F.col("v"))).alias(f"s{j}") for j in range(1, steps + 1)], *[F.count(F.when(F.col("step") == j, F.col("v"))).alias(f"n{j}") for j in range(1, steps + 1)])
    sums = F.array(*[F.coalesce(F.col(f"s{j}"), F.lit(0.0)) for j in range(1, steps + 1)])
    counts = F.array(*[F.col(f"n{j}") for j in range(1, steps + 1)])
    at_point = cells.groupBy(*keys, "t").agg(F.collect_list(F.struct("fold", "median", sums.alias("s"), counts.alias("n"))).alias("f"))  # a row a fold
    names = ", ".join(f"{c} string" for c in by)

    def run(frames):
        for pdf in frames:
            held: dict = {}
            for row in pdf.itertuples(index=False):
                *key, found = row
                s, n = np.zeros((folds, steps)), np.zeros((folds, steps))
                median = np.full(folds, np.nan)
                for f in found:
                    s[f["fold"]], n[f["fold"]], median[f["fold"]] = f["s"], f["n"], f["median"]
                s, n = s.cumsum(1), n.cumsum(1)
                s, n = s.sum(0) - s, n.sum(0) - n  # of the other folds
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = (s / n - median[:, None]) ** 2  # no training epoch: NaN
                d[np.isnan(median)] = 0.0
                k = tuple(key)
                held[k] = held.get(k, 0) + np.concatenate([d.ravel(), (~np.isnan(median)).astype(float)])
            yield pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=[*by, "v"])

    partial = at_point.select(*by, "f").mapInPandas(run, f"{names}, v array<double>")
    total = partial.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))
    used = total.filter(F.col("i") >= folds * steps).select(*by, (F.col("i") - folds * steps).alias("fold"), F.col("x").alias("points"))
    each = total.filter(F.col("i") < folds * steps).select(*by, F.expr(f"cast(i div {steps} as int)").alias("fold"), (F.col("i") % steps + 1).alias("step"), "x")
    scored = each.join(used.filter("points > 0"), [*by, "fold"]).withColumn("rms", F.sqrt(F.col("x") / F.col("points")))
    errors = scored.groupBy(*by, "step").agg(F.avg("rms").alias("error")).filter(~F.isnan("error"))
    # a step that no epoch is at keeps what the one before keeps: its equal error, summed in another order, might be the lesser by rounding
    return errors.join(epochs.select(*by, "step").distinct(), [*by, "step"], "left_semi")


def best_step(errors: DataFrame, by: list[str]) -> DataFrame:
    """by, best, error: the first step of least error."""
    return errors.groupBy(*by).agg(F.min(F.struct("error", "step")).alias("b")).select(*by, F.col("b.step").alias("best"), F.col("b.error").alias("error"))


def learnt_thresholds(epochs: DataFrame, steps: int = 20, folds: int = 10) -> DataFrame:
    """subject, channel, threshold, error.  A channel whose every step leaves a fold untrained keeps all: its threshold is the largest distance."""
    by = ["subject", "channel"]
    on_grid = stepped(spans(epochs), by, "ptp", steps)
    best = best_step(held_out_errors(on_grid, by, steps, folds), by)
    ends = on_grid.groupBy(*by).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    step = F.coalesce("best", F.lit(steps))
    return ends.join(best, by, "left").select(*by, F.when(step == steps, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * step / steps).alias("threshold"), "error")


def rejected(epochs: DataFrame, steps: int = 20, folds: int = 10, shares: int = 10) -> DataFrame:
    """subject, epoch, bad_share, largest_share, keep: epochs by the learnt thresholds and the learnt share of bad channels.

    shares: the steps, from none to all channels, among which the largest share is learnt.
    """
    by = ["subject", "channel"]
    marked = spans(epochs).join(learnt_thresholds(epochs, steps, folds), by).withColumn("bad", F.col("ptp") > F.col("threshold"))
    per = marked.groupBy("subject", "epoch").agg(F.avg(F.col("bad").cast("double")).alias("bad_share"))
    # step j keeps epochs with at most (j - 1) / shares of their channels bad
    at = per.withColumn("step", (F.ceil(F.col("bad_share") * shares) + 1).cast("int"))
    rows = epochs.join(at.select("subject", "epoch", "step"), ["subject", "epoch"])
    best = best_step(held_out_errors(rows, ["subject"], shares + 1, folds), ["subject"])
    out = at.join(best, "subject", "left").withColumn("best", F.coalesce("best", F.lit(shares + 1)))
    return out.select("subject", "epoch", "bad_share", ((F.col("best") - 1) / shares).alias("largest_share"), (F.col("step") <= F.col("best")).alias("keep"))
