"""Band-power expressions over spectra held as arrays, in built-in array functions.

A spectrum is a pair of equally long arrays, frequencies (ascending) and power.  Missing results
are NULL: a zero total, a band without spectrum, a logarithm of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log10_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def trapezoid(freqs: Column, power: Column, lo, hi) -> Column:
    """Trapezoidal integral of power over lo <= f <= hi, both ends included."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    points = F.filter(F.arrays_zip(freqs.alias("f"), power.alias("p")), lambda x: (x["f"] >= lo) & (x["f"] <= hi))
    ahead = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    back = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    parts = F.zip_with(back, ahead, lambda a, b: (a["p"] + b["p"]) / 2 * (b["f"] - a["f"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def abs_band_power(freqs: Column, power: Column, lo, hi) -> Column:
    """log10 of the power in a band."""
    return log10_or_null(trapezoid(freqs, power, lo, hi))


def rel_band_power(freqs: Column, power: Column, lo, hi, total_lo=3.0, total_hi=40.0) -> Column:
    """Share of the band in the power of the whole range; NULL for a range without power."""
    return ratio_or_null(trapezoid(freqs, power, lo, hi), trapezoid(freqs, power, total_lo, total_hi))


def band_ratio(freqs: Column, power: Column, num: tuple, den: tuple) -> Column:
    """log10 of the ratio of two bands' power."""
    return log10_or_null(ratio_or_null(trapezoid(freqs, power, *num), trapezoid(freqs, power, *den)))


def dominant_peak(freqs: Column, power: Column, lo, hi) -> Column:
    """Frequency of the largest power in the band, the first of equals; NULL for an empty band."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    points = F.filter(F.arrays_zip(freqs.alias("f"), power.alias("p")), lambda x: (x["f"] >= lo) & (x["f"] <= hi))
    best = F.array_max(F.transform(points, lambda x: F.struct(x["p"].alias("p"), (-x["f"]).alias("f"))))
    return -best["f"]


def peak_in_band(peaks: Column, lo, hi) -> Column:
    """The strongest of parameterised peaks (cf, pw, bw) in a band, the lowest of equals; peaks with a missing value are left out."""
    inside = F.filter(peaks, lambda p: (p["cf"] >= lo) & (p["cf"] <= hi) & F.nvl2(p["pw"] + p["bw"], ~F.isnan(p["pw"] + p["bw"]), F.lit(False)))
    best = F.array_max(F.transform(inside, lambda p: F.struct(p["pw"].alias("pw"), (-p["cf"]).alias("back"), p["bw"].alias("bw"))))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("cf"), best["pw"].alias("pw"), best["bw"].alias("bw")))


def strongest_peak(peaks: Column, lo, hi) -> Column:
    """Centre of the strongest of parameterised peaks in a band."""
    return peak_in_band(peaks, lo, hi)["cf"]


def periodic_part(power: Column, aperiodic_log10: Column) -> Column:
    """What a spectrum has above its aperiodic fit (log10), never below zero."""
    return F.zip_with(power, aperiodic_log10, lambda p, a: F.greatest(F.lit(0.0), p - F.pow(F.lit(10.0), a)))


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def mapped(x: Column, table: dict) -> Column:
    """x looked up in a small dictionary; unmapped values are NULL."""
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def gauge(observed: Column, p5: Column, q1: Column, q3: Column, p95: Column) -> Column:
    """Five-way class of a value among centiles; values are first rounded to three decimals."""
    v, a, b, c, d = (F.round(x, 3) for x in (observed, p5, q1, q3, p95))
    return F.when(v < a, "extremely low").when(v < b, "below normal").when(v <= c, "normal").when(v <= d, "above normal").otherwise("extremely high")


def compressed_age(age: Column, cut: float, factor: float = 3.0) -> Column:
    """Age with everything above ``cut`` compressed, for growth charts."""
    return F.when(age <= cut, age).otherwise(cut + (age - cut) / factor)


def layout_unit_scale(radius: Column) -> Column:
    """Metres per unit of sensor positions, told from the head radius they give."""
    return F.when(radius < 0.25, 1.0).when(radius < 2.5, 0.1).when(radius < 25, 0.01).otherwise(0.001)
