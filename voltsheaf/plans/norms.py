"""The way from a cohort table to normative data, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.functions.spectral import finite
from voltsheaf.operators import cohort, normdata


def prepared(wide: DataFrame, key: str, responses: list[str], covariate: str, groups: list[str], diagnoses: tuple[str, list] | None = None, subjects: DataFrame | None = None, exclude: str | None = None, include: list[str] | None = None, missing: float = 0.2, half_width: float = 5.0, train: float = 0.5, impute: bool = True) -> DataFrame:
    """Long normative data: key, groups, covariate, response, y, split.

    Cohort filters, column selection, infinities as missing, features with too many gaps dropped,
    gaps imputed by group and covariate window (or, without imputation, subjects with a gap dropped),
    rows split by strata.  Features stay long, so the plan does not grow with their number.
    """
    rows = wide
    if diagnoses is not None:
        rows = rows.filter(F.col(diagnoses[0]).isin(diagnoses[1]))
    if subjects is not None:
        rows = cohort.only(rows, subjects, key)
    names = cohort.excluded_columns(responses, exclude) if exclude else responses
    names = cohort.included_columns(names, include) if include else names
    ids = [key, *groups, covariate]
    split = normdata.stratified_split(rows.select(*ids), groups, key, train).select(key, "split")
    long = cohort.melt(rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]), ids, names, "response", "y").withColumn("y", finite(F.col("y")))
    good = cohort.drop_sparse_features(long, "response", "y", missing)
    if not impute:
        gaps = good.filter(F.col("y").isNull()).select(key).distinct()
        return cohort.without(good, gaps, key).join(split, key)
    filled = normdata.impute_mean(good, "y", ["response", *groups], covariate, half_width)
    return filled.withColumn("y", F.col("imputed")).drop("imputed").join(split, key)
