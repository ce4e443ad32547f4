"""Normative models with site effects in mean and spread, and a skewed or heavy-tailed shape, by MAP.

For a response the standardised y has mean x'b + u[site] and log spread q'g + v[site]; x is a basis of the
standardised covariate and q its first powers.  z = (y - mean) / spread is standard normal, or sinh-arcsinh
distributed (Jones and Pewsey 2009): sinh(d asinh(z) - e) is standard normal.  u, v, e and log d have normal
priors around zero, so that small sites lean on the others (partial pooling).

A Newton-type round needs sums over rows alone: of the scores and their products, by response and site.
All responses of a wave share one pass a round, and a response whose step did not help halves it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.operators.normative import QUANTILES
from voltsheaf.sources.scratch import scratch

#: Bytes of sums that a wave of responses may send to the driver in a round.
WAVE_BYTES = 64 << 20
MODEL = "response string, y_mean double, y_sd double, x_mean double, x_sd double, b array<double>, g array<double>, e double, log_d double, sites map<string,struct<u:double,v:double>>, n long, log_posterior double, rounds int"


@dataclass(frozen=True)
class Form:
    """What a model holds: degrees of mean and log spread, the shape, and precisions of the priors."""

    degree: int = 2
    spread_degree: int = 1
    shape: bool = False
    ridge: float = 1e-3
    site_mean: float = 1.0
    site_spread: float = 4.0
    shape_prior: float = 1.0

    @property
    def width(self) -> int:
        """Numbers of a row's score within its site."""
        return self.degree + self.spread_degree + 4 + 2 * self.shape


@dataclass
class Fit:
    """The state of a response between rounds; a parameter vector is b, g, (e, log d), u, v."""

    sites: list
    now: np.ndarray
    tried: np.ndarray
    step: np.ndarray | None = None
    best: float = -np.inf
    share: float = 1.0
    rounds: int = 0
    done: bool = False
    scale: tuple = field(default_factory=tuple)


def powers(x: np.ndarray, degree: int) -> np.ndarray:
    return x[:, None] ** np.arange(degree + 1)


def row_scores(form: Form, y: np.ndarray, x: np.ndarray, common: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods and scores (b, g, e, log d, u, v) of rows; common has a row of parameters for each."""
    p, q = form.degree + 1, form.spread_degree + 1
    bx, gx = powers(x, form.degree), powers(x, form.spread_degree)
    log_s = np.clip((common[:, p : p + q] * gx).sum(1) + v, -30, 30)
    z = (y - (common[:, :p] * bx).sum(1) - u) * np.exp(-log_s)
    if form.shape:
        e, d = common[:, p + q], np.exp(np.clip(common[:, p + q + 1], -5, 5))
        w = np.clip(d * np.arcsinh(z) - e, -300, 300)
        s = np.sinh(w)
        dw = np.tanh(w) - s * np.cosh(w)
        log_f = np.log(d) + np.logaddexp(w, -w) - np.log(2) - 0.5 * s * s - 0.5 * np.log1p(z * z)
        dz = dw * d / np.sqrt(1 + z * z) - z / (1 + z * z)
        extra = np.stack([-dw, 1 + dw * d * np.arcsinh(z)], 1)
    else:
        log_f, dz, extra = -0.5 * z * z, -z, np.zeros((len(z), 0))
    a, b = -dz * np.exp(-log_s), -1 - z * dz
    return log_f - log_s - 0.5 * np.log(2 * np.pi), np.concatenate([a[:, None] * bx, b[:, None] * gx, extra, a[:, None], b[:, None]], 1)


def information(form: Form, y: np.ndarray, x: np.ndarray, common: np.ndarray, u: np.ndarray, v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row's share of the information: expected for the normal form, products of scores for the shaped one."""
    if form.shape:
        return h[:, :, None] * h[:, None, :]
    p, q = form.degree + 1, form.spread_degree + 1
    s = np.exp(-np.clip((common[:, p : p + q] * powers(x, form.spread_degree)).sum(1) + v, -30, 30))
    k = np.zeros((len(y), 2, form.width))
    k[:, 0, :p], k[:, 0, -2] = powers(x, form.degree) * s[:, None], s
    k[:, 1, p : p + q], k[:, 1, -1] = powers(x, form.spread_degree) * np.sqrt(2), np.sqrt(2)
    return np.einsum("nki,nkj->nij", k, k)


def sums_by_site(form: Form, tried: dict[str, tuple[np.ndarray, dict]]):
    """For mapInPandas: response, site, v: log-likelihood, scores and information summed."""
    m = form.width

    def run(frames):
        held: dict = {}
        for pdf in frames:
            pdf = pdf[pdf["response"].isin(tried.keys())]
            if not len(pdf):
                continue
            key, names = pd.factorize(pd.MultiIndex.from_arrays([pdf["response"], pdf["site"]]))
            order = np.argsort(key, kind="stable")
            key, y, x = key[order], pdf["y"].to_numpy(float)[order], pdf["x"].to_numpy(float)[order]
            common = np.stack([tried[r][0] for r, _ in names])[key]
            site = np.array([tried[r][1].get(s, (0.0, 0.0)) for r, s in names])[key]
            ll, h = row_scores(form, y, x, common, site[:, 0], site[:, 1])
            info = information(form, y, x, common, site[:, 0], site[:, 1], h).reshape(len(y), m * m)
            head = np.flatnonzero(np.diff(key, prepend=-1))
            for k, v in zip(key[head], np.add.reduceat(np.concatenate([ll[:, None], h, info], 1), head)):
                held[names[k]] = held.get(names[k], 0) + v
        yield pd.DataFrame([(r, s, v.tolist()) for (r, s), v in held.items()], columns=["response", "site", "v"])

    return run


def advanced(form: Form, fit: Fit, sums: dict[str, np.ndarray], tolerance: float) -> None:
    """A round of one response: keep or halve the last step, then take the next."""
    m, c, n_sites = form.width, form.width - 2, len(fit.sites)
    size = c + 2 * n_sites
    prior = np.concatenate([np.full(c - 2 * form.shape, form.ridge), np.full(2 * form.shape, form.shape_prior), np.full(n_sites, form.site_mean), np.full(n_sites, form.site_spread)])
    value, grad, info = -0.5 * (prior * fit.tried**2).sum(), -prior * fit.tried, np.diag(prior)
    for i, s in enumerate(fit.sites):
        if s in sums:
            at = np.r_[np.arange(c), c + i, c + n_sites + i]
            value += sums[s][0]
            grad[at] += sums[s][1 : m + 1]
            info[np.ix_(at, at)] += sums[s][m + 1 :].reshape(m, m)
    fit.rounds += 1
    if fit.step is not None and not value >= fit.best - 1e-12 * abs(fit.best):
        fit.share /= 2
        fit.done = fit.share < 1e-6
    else:
        fit.now, fit.best, fit.share = fit.tried, value, 1.0
        d = np.sqrt(np.diag(info))  # spreads differ by many powers of ten
        fit.step = np.linalg.solve(info / np.outer(d, d) + 1e-10 * np.eye(size), grad / d) / d
        if np.abs(fit.step).max() < tolerance:
            fit.done, fit.now = True, fit.now + fit.step
    fit.tried = fit.now + fit.share * fit.step


def fit_site_norms(long: DataFrame, covariate: str, site: str, form: Form = Form(), rounds: int = 60, tolerance: float = 1e-6, response: str = "response", y: str = "y", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """A model (MODEL) for each response.  Rows with a missing y or covariate are left out; a missing site is one of its own ("").

    A response of no spread has y_sd 1.  The sums of a round pass the driver wave by wave, about
    wave_bytes at a time, and rows are read once a round.
    """
    spark = long.sparkSession
    rows = long.select(F.col(response).cast("string").alias("response"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col(covariate).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter(F.col("response").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y"))
    models = []
    with scratch(spark) as s:
        moments = [f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
        scales = s.saved(rows.groupBy("response").agg(*moments, F.count("*").alias("n"), F.sort_array(F.collect_set("site")).alias("sites")), "scales")
        size = 8 * (1 + form.width + form.width**2)
        total, responses = scales.agg(F.coalesce(F.sum(F.size("sites") * size), F.lit(0)), F.count("*")).first()
        waves = max(1, min(-(-int(total) // wave_bytes), responses))
        wave = F.pmod(F.xxhash64("response"), F.lit(waves))
        sd = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
        scaled = rows.join(scales.select("response", "x_mean", "x_sd", "y_mean", "y_sd"), "response")
        scaled = s.saved(scaled.select("response", "site", ((F.col("x") - F.col("x_mean")) / sd("x_sd")).alias("x"), ((F.col("y") - F.col("y_mean")) / sd("y_sd")).alias("y"), wave.alias("wave")), "scaled", ("wave",))
        for k in range(waves):
            mine = scaled.filter(F.col("wave") == k).select("response", "site", "x", "y")
            fits: dict[str, Fit] = {}
            for r in scales.filter(wave == k).collect():
                zero = np.zeros(form.width - 2 + 2 * len(r["sites"]))
                fits[r["response"]] = Fit(r["sites"], zero, zero, scale=(r["y_mean"], r["y_sd"] or 1.0, r["x_mean"], r["x_sd"] or 1.0, r["n"]))
            for _ in range(rounds):
                open_ = {name: f for name, f in fits.items() if not f.done}
                if not open_:
                    break
                tried = {name: (f.tried[: form.width - 2], by_site(form, f, f.tried)) for name, f in open_.items()}
                partial = mine.mapInPandas(sums_by_site(form, tried), "response string, site string, v array<double>")
                cells = partial.select("response", "site", F.posexplode("v").alias("i", "x")).groupBy("response", "site", "i").agg(F.sum("x").alias("x"))
                found: dict = {}
                for r in cells.groupBy("response", "site").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
                    found.setdefault(r["response"], {})[r["site"]] = np.array([c["x"] for c in r["v"]])
                for name, f in open_.items():
                    advanced(form, f, found.get(name, {}), tolerance)
            models += [model_row(form, name, f) for name, f in sorted(fits.items())]
    return spark.createDataFrame(models, MODEL)


def by_site(form: Form, fit: Fit, at: np.ndarray) -> dict[str, tuple[float, float]]:
    u, v = np.split(at[form.width - 2 :], 2)
    return {s: (float(a), float(b)) for s, a, b in zip(fit.sites, u, v)}


def model_row(form: Form, name: str, fit: Fit) -> tuple:
    p, c = form.degree + 1, form.width - 2
    b, g = fit.now[:p], fit.now[p : p + form.spread_degree + 1]
    e, log_d = fit.now[c - 2 : c] if form.shape else (0.0, 0.0)
    y_mean, y_sd, x_mean, x_sd, n = fit.scale
    return (name, y_mean, y_sd, x_mean, x_sd, b.tolist(), g.tolist(), float(e), float(log_d), by_site(form, fit, fit.now), n, float(fit.best), fit.rounds)


def predicted(df: DataFrame, models: DataFrame, covariate: str, site: str, response: str = "response") -> DataFrame:
    """df with mu and sigma (of y, on its own scale) and the shape e, d of its response and site; an unknown site is an average one."""
    m = models.select(F.col("response").alias("__response"), "y_mean", "y_sd", "x_mean", "x_sd", "b", "g", "e", F.exp("log_d").alias("d"), "sites")
    x = (F.col(covariate).cast("double") - F.col("x_mean")) / F.col("x_sd")
    effect = F.try_element_at("sites", F.coalesce(F.col(site).cast("string"), F.lit("")))

    def line(name: str):
        return F.aggregate(F.reverse(name), F.lit(0.0), lambda s, c: s * x + c)

    both = df.join(m, F.col(response).cast("string") == F.col("__response"))
    mu = F.col("y_mean") + F.col("y_sd") * (line("b") + F.coalesce(effect["u"], F.lit(0.0)))
    sigma = F.col("y_sd") * F.exp(line("g") + F.coalesce(effect["v"], F.lit(0.0)))
    return both.select(*df.columns, mu.alias("mu"), sigma.alias("sigma"), "e", "d")


def z_scores(df: DataFrame, y: str = "y") -> DataFrame:
    """predicted rows with z, standard normal under the model."""
    z = (F.col(y) - F.col("mu")) / F.col("sigma")
    return df.withColumn("z", F.when(F.col("sigma") > 0, F.sinh(F.col("d") * F.asinh(z) - F.col("e"))))


def centiles(df: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """predicted rows by quantile, with their value on the scale of y."""
    items = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(NormalDist().inv_cdf(q)).alias("zq")) for q in quantiles])
    rows = df.withColumn("__c", F.explode(items))
    value = F.col("mu") + F.col("sigma") * F.sinh((F.asinh(F.col("__c.zq")) + F.col("e")) / F.col("d"))
    return rows.select(*df.columns, F.col("__c.quantile").alias("quantile"), value.alias("value"))


def response_curve(rows: DataFrame, models: DataFrame, covariate: str, site: str, response: str = "response", points: int = 150, upper: float = 80.0, to_percent: bool = True) -> DataFrame:
    """response, x, value, peak, lowest, turn: the median curve of every response at its most frequent site.

    The grid runs from the least to the largest covariate of a response and ends at ``upper`` before it is
    scaled to 0 to 100.  peak and lowest mark the first such point, turn those where the slope changes its
    sign.  A constant curve has no scaled value.  Ties of sites go to the smallest name.
    """
    own = rows.filter(F.col(covariate).isNotNull()).groupBy(F.col(response).cast("string").alias("response"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site")).agg(F.count("*").alias("n"), F.min(covariate).cast("double").alias("lo"), F.max(covariate).cast("double").alias("hi"))
    ends = own.groupBy("response").agg(F.min(F.struct(-F.col("n"), "site")).alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    i = F.sequence(F.lit(0), F.lit(points - 1))
    grid = ends.select("response", F.col("s.site").alias("site"), F.explode(F.transform(i, lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / (points - 1))).alias("x")).filter(F.col("x") <= upper)
    curve = centiles(predicted(grid, models, "x", "site"), (0.5,)).groupBy("response").agg(F.array_sort(F.collect_list(F.struct("x", "value"))).alias("c"))  # points rows
    lo, hi = F.array_min(F.col("c.value")), F.array_max(F.col("c.value"))
    scale = (lambda v: (v - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100) if to_percent else (lambda v: v)
    scaled = curve.withColumn("v", F.transform("c", lambda p: scale(p["value"])))
    marks = F.posexplode(F.arrays_zip(F.col("c.x").alias("x"), F.col("v").alias("value")))
    flat = scaled.select("response", "v", F.array_position("v", F.array_max("v")).alias("top"), F.array_position("v", F.array_min("v")).alias("low"), marks.alias("i", "p"))
    at = F.col("i")
    turn = (at >= 1) & (at < F.size("v") - 1) & (F.try_element_at("v", (at + 2).cast("int")).isNotNull()) & (F.signum(F.try_element_at("v", (at + 2).cast("int")) - F.element_at("v", (at + 1).cast("int"))) != F.signum(F.element_at("v", (at + 1).cast("int")) - F.try_element_at("v", F.when(at >= 1, at.cast("int")).otherwise(1))))
    return flat.select("response", F.col("p.x").alias("x"), F.col("p.value").alias("value"), (at + 1 == F.col("top")).alias("peak"), (at + 1 == F.col("low")).alias("lowest"), F.coalesce(turn, F.lit(False)).alias("turn"))
