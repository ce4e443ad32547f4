"""Chart-ready tables; nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.functions.spectral import compressed_age
from voltsheaf.operators import cohort, qc, stats


def population_chart(df: DataFrame, start: int, stop: int, step: int, by: tuple = ("band",)) -> DataFrame:
    """Mean and 1.96 deviations in percent, by band and age slice."""
    bins = qc.binned_mean_std(df, "value", "age", start, stop, step, by)
    return bins.select(*by, F.col("bin_lo").alias("age_lo"), (F.col("mean") * 100).alias("mean_percent"), (1.96 * F.col("std") * 100).alias("band_percent"))


def growth_curves(df: DataFrame, by: list[str], age: str, value: str, cut: float) -> DataFrame:
    """Curves averaged over sites, with ages above the cut compressed."""
    return df.groupBy(*by, age).agg(F.avg(value).alias("value")).withColumn("x", compressed_age(F.col(age).cast("double"), cut))


def site_differences(centiles: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """One quantile of each site beside the mean over sites."""
    rows = centiles.filter(F.abs(F.col("quantile") - quantile) < 1e-9)
    return rows.join(rows.groupBy(*by).agg(F.avg("value").alias("site_mean")), by)


def scatter_sizes(df: DataFrame, x: str, low: float = 20.0, spread: float = 500.0) -> DataFrame:
    ends = df.agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    return df.crossJoin(F.broadcast(ends)).withColumn("size", low + spread * F.coalesce((F.col(x) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)), F.lit(0.0))).drop("__a", "__b")  # one row


def contour_radius(p: float) -> float:
    """Radius that holds a share p of a standard bivariate normal distribution."""
    import math

    return math.sqrt(-2 * math.log(1 - p))


def magnitudes(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn("magnitude", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))


def metric_densities(long: DataFrame, prefix: str, lo: float, hi: float, points: int = 4000, bandwidth: float = 0.05) -> DataFrame:
    """Densities of the values of all metrics whose name starts with a prefix."""
    return stats.density(long.filter(F.col("metric").startswith(prefix)), "value", ["metric"], lo, hi, points, bandwidth)


def brain_texture(vertices: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with the value of their region (by hemisphere and name, else by name), and regions without one."""
    joined = cohort.lookup_with_fallback(vertices, values, "full_name", "region_name")
    return joined, joined.filter("value is null").select("full_name").distinct()


def life_stages(centiles: DataFrame, age: str = "age", edges: tuple = (12, 20, 40, 60)) -> DataFrame:
    stage = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        stage = F.when(F.col(age) < edges[i], i).otherwise(stage)
    return centiles.withColumn("stage", stage)


def region_parts(df: DataFrame, name: str = "region") -> DataFrame:
    """Hemisphere and bare name of atlas regions such as G_front_sup-lh or lh_G_front_sup."""
    n = F.col(name)
    hemi = F.when(n.rlike("(^lh[._-])|([._-]lh$)"), "lh").when(n.rlike("(^rh[._-])|([._-]rh$)"), "rh")
    return df.withColumn("hemi", hemi).withColumn("bare", F.regexp_replace(n, "^(lh|rh)[._-]|[._-](lh|rh)$", ""))


def range_markers(centiles: DataFrame, observed: DataFrame, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """by, low, high, value: an individual's value on the range between two centiles, ends of each bar."""
    ends = centiles.filter(F.col("quantile").isin([low, high])).groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.join(observed.select(*by, F.col("value")), by)
