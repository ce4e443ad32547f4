"""Normative models by distributed sufficient statistics, their centiles and calibration."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltsheaf.operators import stats

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def linear_norms(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope, intercept, sigma, n: a straight norm for each group, in one shuffle."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(F.greatest(F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x), F.lit(0.0)) / F.nullif(F.regr_count(y, x) - 2, F.lit(0))).alias("sigma"), F.regr_count(y, x).alias("n")
    )


def basis(x: Column, knots: tuple, degree: int = 3) -> list[Column]:
    """A truncated power basis: 1, x, ..., x**degree and (x - k)+**degree for each knot."""
    return [F.pow(x, F.lit(float(d))) for d in range(degree + 1)] + [F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), F.lit(float(degree))) for k in knots]


def fit_norms(long: DataFrame, covariate: str, batch: dict[str, list], knots: tuple = (), degree: int = 3, ridge: float = 1e-6, response: str = "response", y: str = "y") -> list[dict]:
    """Bayesian linear norms (a Gaussian prior of precision ridge) of every response.

    X'X, X'y and y'y are sums over rows, so one shuffle of a few numbers for each response; only the
    small systems are solved on the driver.  batch: the levels of each batch column (the first is
    the base line).  Rows with a missing value are left out.
    """
    terms = basis(F.col(covariate), knots, degree) + [(F.col(c) == F.lit(v)).cast("double") for c, levels in batch.items() for v in levels[1:]]
    p = len(terms)
    rows = long.select(response, y, F.array(*terms).alias("x")).filter(F.col(y).isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col("x")[i] * F.col(y)).alias(f"xy_{i}") for i in range(p)]
    out = []
    for r in rows.groupBy(response).agg(*sums, F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).collect():
        xx = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        xy = np.array([r[f"xy_{i}"] for i in range(p)])
        beta = np.linalg.solve(xx + ridge * np.eye(p), xy)
        rest = max(r["yy"] - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        out.append({"response": r[response], "beta": beta.tolist(), "sigma": float(np.sqrt(rest / max(r["n"] - p, 1))), "n": r["n"]})
    return out


def model_table(spark, models: list[dict]) -> DataFrame:
    return spark.createDataFrame([(m["response"], m["beta"], m["sigma"], m["n"]) for m in models], "response string, beta array<double>, sigma double, n long")


def predicted(df: DataFrame, models: DataFrame, covariate: str, batch: dict[str, list], knots: tuple = (), degree: int = 3, response: str = "response") -> DataFrame:
    """df with mu and sigma of its response's model (a small table)."""
    terms = basis(F.col(covariate), knots, degree) + [(F.col(c) == F.lit(v)).cast("double") for c, levels in batch.items() for v in levels[1:]]
    mu = F.aggregate(F.zip_with(F.array(*terms), "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.join(models.select(F.col("response").alias(response), "beta", "sigma"), response).withColumn("mu", mu).drop("beta")


def z_scores(df: DataFrame, y: str = "y") -> DataFrame:
    return df.withColumn("z", F.when(F.col("sigma") > 0, (F.col(y) - F.col("mu")) / F.col("sigma")))


def centiles(df: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """Rows of (mu, sigma) by quantile: mu + sigma * the normal quantile."""
    items = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(NormalDist().inv_cdf(q)).alias("zq")) for q in quantiles])
    return df.withColumn("c", F.explode(items)).withColumn("quantile", F.col("c.quantile")).withColumn("value", F.col("mu") + F.col("sigma") * F.col("c.zq")).drop("c")


def empirical_centiles(df: DataFrame, by: list[str], y: str, quantiles=QUANTILES) -> DataFrame:
    """by, quantile, value: exact quantiles of every group; groups without values have none."""
    q = stats.quantiles(df, y, {f"__q{i}": x for i, x in enumerate(quantiles)}, by=tuple(by))
    pairs = F.array(*[F.struct(F.lit(x).alias("quantile"), F.col(f"__q{i}").alias("value")) for i, x in enumerate(quantiles)])
    return q.select(*by, F.explode(pairs).alias("x")).select(*by, "x.quantile", "x.value")


def calibration_error(rows: DataFrame, by: list[str], y: str, pred: str, quantile: str = "quantile") -> DataFrame:
    """Mean absolute calibration error of each group: |q - share of y at or below the q centile|, over q."""
    share = rows.groupBy(*by, quantile).agg(F.avg((F.col(pred) >= F.col(y)).cast("double")).alias("__share"))
    return share.groupBy(*by).agg(F.avg(F.abs(F.col(quantile) - F.col("__share"))).alias("mace"))


def individual_centiles(centile: DataFrame, by: list[str], age: float, sites: bool = False) -> DataFrame:
    """Centile values at the grid age closest to an individual's (the lower of equals), over sites."""
    nearest = centile.groupBy(*by).agg(F.min(F.struct(F.abs(F.col("age") - F.lit(float(age))).alias("d"), F.col("age").alias("age"))).alias("b")).select(*by, F.col("b.age").alias("age"))
    return centile.join(nearest, [*by, "age"]).groupBy(*by, "age").agg(F.avg("value").alias("value"))
