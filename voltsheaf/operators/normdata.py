"""Imputation and splits of normative data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.operators import stats


def impute_mean(df: DataFrame, value: str, groups: list[str], covariate: str, half_width: float = 5.0) -> DataFrame:
    """Missing values from neighbours in the same group and covariate window (both ends included),
    else from the group, else from all rows; a missing group or covariate falls through.

    Neighbours are original values.  Observed values are first summed up by group and covariate, and
    gaps meet these sums in bands of the covariate (an equi-join), so no group is sorted as a whole.
    """
    band = half_width or 1.0
    seen = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(covariate).cast("double").alias("__o")).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    seen = seen.withColumn("__band", F.floor(F.col("__o") / band))
    gaps = df.filter(F.col(value).isNull() & F.col(covariate).isNotNull()).select(*groups, F.col(covariate).cast("double").alias("__c")).distinct()
    at = F.floor(F.col("__c") / band)
    gaps = gaps.withColumn("__band", F.explode(F.array(at - 1, at, at + 1)))
    near = gaps.join(seen, [*groups, "__band"]).filter(F.abs(F.col("__o") - F.col("__c")) <= half_width).groupBy(*groups, "__c").agg((F.sum("__s") / F.sum("__n")).alias("__near"))
    by_group = seen.groupBy(*groups).agg((F.sum("__s") / F.sum("__n")).alias("__group"))
    overall = df.agg(F.avg(value).alias("__all"))
    out = df.withColumn("__c", F.col(covariate).cast("double")).join(near, [*groups, "__c"], "left").join(by_group, groups, "left").crossJoin(F.broadcast(overall))  # one row
    return out.withColumn("imputed", F.coalesce(value, "__near", "__group", "__all")).select(*df.columns, "imputed")


def impute_median(df: DataFrame, value: str, key: str, groups: list[str], covariate: str, half_width: float = 5.0, widths: dict | None = None, width_by: str | None = None) -> DataFrame:
    """The same with medians, and with a half-width that may be widened for some sites.

    Missing rows meet observed ones in bands of the covariate (an equi-join on group and band), so
    no row meets its whole group.
    """
    extra = F.coalesce(F.create_map(*[F.lit(x) for k, v in widths.items() for x in (k, float(v))])[F.col(width_by)], F.lit(0.0)) if widths and width_by else F.lit(0.0)
    band = half_width + max([0.0, *(widths or {}).values()])
    gaps = df.filter(F.col(value).isNull()).select(key, *groups, F.col(covariate).alias("__c"), (F.lit(half_width) + extra).alias("__w"))
    at = F.floor(F.col("__c") / band)
    gaps = gaps.withColumn("__band", F.explode(F.array(at - 1, at, at + 1)))
    seen = df.filter(F.col(value).isNotNull()).select(*groups, F.floor(F.col(covariate) / band).alias("__band"), F.col(covariate).alias("__o"), F.col(value).alias("__v"))
    near = gaps.join(seen, [*groups, "__band"]).filter(F.abs(F.col("__o") - F.col("__c")) <= F.col("__w")).groupBy(key).agg(F.median("__v").alias("__near"))
    by_group = stats.quantiles(df, value, {"__group": 0.5}, by=tuple(groups))
    overall = stats.quantiles(df, value, {"__all": 0.5})
    out = df.join(near, key, "left").join(by_group, groups, "left").crossJoin(F.broadcast(overall))  # one row
    return out.withColumn("imputed", F.coalesce(value, "__near", "__group", "__all")).drop("__near", "__group", "__all")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing value (NULL or NaN) in the columns: the alternative to imputation."""
    return df.dropna(subset=columns)


def stratified_split(df: DataFrame, strata: list[str], key: str, train: float = 0.5, validation: float = 0.0, seed: int = 42) -> DataFrame:
    """df with column split: in each stratum the first share in a seeded order is train.

    The order is arithmetic on the key (of text and other types, on the first eight hexadecimal digits of
    its md5), so that it is the same in every run and engine; ties are in the order of the key.  Shares are
    of the stratum's rows, rounded down; validation is taken from what train leaves.
    """
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(key).cast("long") if whole else F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    # reduced first, so that no key overflows
    order = F.coalesce(F.pmod(F.pmod(number, F.lit(1_000_003)) * 2654435761 + F.lit(seed) * 40503, F.lit(1_000_003)), F.lit(-1))
    ranked = stats.before(df.withColumn("__order", order), "__order", F.lit(1), tuple(strata), key=(key,))
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__size"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in strata])
    out = ranked.join(sizes.withColumnsRenamed({c: f"__r_{c}" for c in strata}), same)
    n, place = F.col("__size"), F.col("__before") + 1
    cut = F.floor(n * F.lit(float(train)))
    return out.withColumn("split", F.when(place <= cut, "train").when(place <= cut + F.floor(n * F.lit(float(validation))), "validation").otherwise("test")).select(*df.columns, "split")


def split_tables(df: DataFrame, key: str, covariates: list[str], batch: list[str], responses: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Covariates, batch effects (a constant 0 where there is none) and responses, each with the key."""
    b = df.select(key, *batch) if batch else df.select(key, F.lit(0).alias("batch"))
    return df.select(key, *covariates), b, df.select(key, *responses)


def without_outliers(df: DataFrame, responses: list[str], z: float) -> DataFrame:
    """Rows none of whose responses lies more than z deviations from its mean; missing values pass."""
    stats = df.agg(*[f(c).alias(f"__{k}_{c}") for c in responses for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in responses:
        out = out.filter(F.col(c).isNull() | F.col(f"__s_{c}").isNull() | (F.abs(F.col(c) - F.col(f"__m_{c}")) <= z * F.col(f"__s_{c}")))
    return out.select(*df.columns)
