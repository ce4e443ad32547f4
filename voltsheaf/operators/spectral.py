"""Spectral features of channels and parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf import config
from voltsheaf.functions import spectral as S

BANDS = {k: (float(a), float(b)) for k, (a, b) in config.BANDS.items()}
OFFSETS = {k: (float(a), float(b)) for k, (a, b) in config.OFFSETS.items()}
RATIOS = config.RATIO_PAIRS  # pairs of a band that is not asked for are left out
FIT_RANGE = (3.0, 40.0)


def bands_column(bands: dict = BANDS):
    return F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for n, (a, b) in bands.items()]))


def band_powers(psd: DataFrame, bands: dict = BANDS, total: tuple = FIT_RANGE, keys: tuple = ("subject", "channel")) -> DataFrame:
    """keys, band, abs_power, rel_power: one row per spectrum and band."""
    rows = psd.select(*keys, "freqs", "power", bands_column(bands).alias("b"))
    return rows.select(*keys, "b.band", S.abs_band_power(F.col("freqs"), F.col("power"), F.col("b.lo"), F.col("b.hi")).alias("abs_power"), S.rel_band_power(F.col("freqs"), F.col("power"), F.col("b.lo"), F.col("b.hi"), *total).alias("rel_power"))


def band_ratios(psd: DataFrame, bands: dict = BANDS, ratios=RATIOS, keys: tuple = ("subject", "channel")) -> DataFrame:
    """keys, feature (num_over_den), value; ratios of undefined bands are left out."""
    items = [F.struct(F.lit(f"{a}_over_{b}").alias("feature"), S.band_ratio(F.col("freqs"), F.col("power"), bands[a], bands[b]).alias("value")) for a, b in ratios if a in bands and b in bands]
    return psd.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.feature", "x.value")


def individual_powers(psd: DataFrame, bands: dict = BANDS, offsets: dict = OFFSETS, total: tuple = FIT_RANGE, keys: tuple = ("subject", "channel")) -> DataFrame:
    """Band power around each band's own peak: keys, band, peak, abs_power, rel_power."""
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), *[F.lit(float(v)).alias(k) for k, v in zip(("lo", "hi", "down", "up"), (*bands[n], *offsets[n]))]) for n in bands if n in offsets]))
    rows = psd.select(*keys, "freqs", "power", spec.alias("b")).withColumn("peak", S.dominant_peak(F.col("freqs"), F.col("power"), F.col("b.lo"), F.col("b.hi")))
    lo, hi = F.col("peak") + F.col("b.down"), F.col("peak") + F.col("b.up")
    return rows.select(*keys, "b.band", "peak", S.abs_band_power(F.col("freqs"), F.col("power"), lo, hi).alias("abs_power"), S.rel_band_power(F.col("freqs"), F.col("power"), lo, hi, *total).alias("rel_power"))


def parcel_mean(features: DataFrame, layout: DataFrame | None = None, keys: tuple = ("subject", "feature"), region: str = "channel", values: tuple = ("value",)) -> DataFrame:
    """Mean of values over the channels of each parcel, missing values left out.

    Features that are missing on all channels of a subject go.  The layout is a small table of
    (channel, parcel) that Spark broadcasts by its size; without one all channels make one parcel.
    """
    rows = features.withColumn("parcel", F.lit("all")) if layout is None else features.join(layout, region)
    means = rows.groupBy(*keys, "parcel").agg(*[F.avg(v).alias(v) for v in values])
    return means.filter(F.coalesce(*values).isNotNull())


def unassigned_channels(features: DataFrame, layout: DataFrame, region: str = "channel") -> DataFrame:
    """Channels that no parcel of the layout has."""
    return features.select(region).distinct().join(layout, region, "left_anti")


def hemispheric_asymmetry(features: DataFrame, keys: tuple = ("subject", "feature"), region: str = "region", value: str = "value", left: str = "_lh_", right: str = "_rh_") -> DataFrame:
    """Left minus right for each region with a twin: keys, region (name of the pair), value."""
    a = features.filter(F.col(region).contains(left)).select(*keys, F.replace(F.col(region), F.lit(left), F.lit(right)).alias("__twin"), F.replace(F.col(region), F.lit(left), F.lit("_lh_vs_rh_")).alias("__name"), F.col(value).alias("__l"))
    b = features.filter(F.col(region).contains(right)).select(*keys, F.col(region).alias("__twin"), F.col(value).alias("__r"))
    return a.join(b, [*keys, "__twin"]).select(*keys, F.col("__name").alias(region), (F.col("__l") - F.col("__r")).alias(value))


def periodic_residual(psd: DataFrame, models: DataFrame, keys: tuple = ("subject", "channel")) -> DataFrame:
    """Spectra with what lies above their aperiodic fit (column ap of models, log10)."""
    return psd.join(models.select(*keys, "ap"), list(keys)).select(*keys, "freqs", S.periodic_part(F.col("power"), F.col("ap")).alias("power"))


def fits_by_band(models: DataFrame, bands: dict = BANDS, keys: tuple = ("subject", "channel")) -> DataFrame:
    """keys, offset, knee, exponent, r2, n_peaks and of each band the strongest peak (cf, pw, bw; NULL
    without one): a row a band, the same for models of either method."""
    at = F.array(*[F.struct(F.lit(b).alias("band"), S.peak_in_band(F.col("peaks"), lo, hi).alias("peak")) for b, (lo, hi) in bands.items()])
    rows = models.select(*keys, "offset", "knee", "exponent", "r2", F.size("peaks").alias("n_peaks"), F.explode(at).alias("__b"))
    return rows.select(*keys, "offset", "knee", "exponent", "r2", "n_peaks", "__b.band", "__b.peak.cf", "__b.peak.pw", "__b.peak.bw")


def well_fitted(models: DataFrame, least_r2: float = 0.9) -> DataFrame:
    """Models whose fit is good enough; a missing R2 passes, as no comparison fails it."""
    return models.filter(F.col("r2").isNull() | F.isnan("r2") | (F.col("r2") >= least_r2))


def poorly_fitted(models: DataFrame, least_r2: float = 0.9) -> DataFrame:
    return models.filter(F.col("r2") < least_r2)


def feature_names(features: DataFrame) -> DataFrame:
    """column = feature__band__region, the name of a long row's column in the wide table."""
    return features.withColumn("column", F.concat_ws("__", "feature", F.coalesce("band", F.lit("")), "region"))


def feature_table(psd: DataFrame, models: DataFrame | None = None, bands: dict = BANDS, least_r2: float = 0.9, keys: tuple = ("subject", "channel")) -> DataFrame:
    """The long feature table: keys, feature, band, value, from spectra and their models.

    Canonical and individual band power of the original and, with models, of the adjusted
    (periodic) spectrum, band ratios, and the aperiodic offset and exponent.
    """
    def long(df: DataFrame, prefix: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit(f"Abs_{prefix}").alias("feature"), F.col("abs_power").alias("value")), F.struct(F.lit(f"Rel_{prefix}").alias("feature"), F.col("rel_power").alias("value"))))
        return df.select(*keys, "band", both.alias("x")).select(*keys, "x.feature", "band", "x.value")

    out = long(band_powers(psd, bands, keys=keys), "OriginalPSD_Canonical").unionByName(long(individual_powers(psd, bands, keys=keys), "OriginalPSD_Individualized"))
    out = out.unionByName(band_ratios(psd, bands, keys=keys).select(*keys, F.concat(F.lit("OriginalPSD_"), "feature").alias("feature"), F.lit("").alias("band"), "value"))
    if models is not None:
        good = well_fitted(models, least_r2)
        adjusted = periodic_residual(psd, good, keys)
        out = out.unionByName(long(band_powers(adjusted, bands, keys=keys), "AdjustedPSD_Canonical")).unionByName(long(individual_powers(adjusted, bands, keys=keys), "AdjustedPSD_Individualized"))
        shape = F.explode(F.array(*[F.struct(F.lit(n.capitalize()).alias("feature"), F.col(n).alias("value")) for n in ("offset", "exponent")]))
        out = out.unionByName(good.select(*keys, shape.alias("x")).select(*keys, "x.feature", F.lit("").alias("band"), "x.value"))
    return out


def features(psd: DataFrame, models: DataFrame, settings: config.RunConfig, layout: DataFrame | None = None, keys: tuple = ("subject",), channel: str = "channel", left: str = "_lh_", right: str = "_rh_") -> DataFrame:
    """keys, channel (or parcel), feature, band, value: what the settings' feature flags ask for.

    Spectra meet their models (offset, exponent, r2, ap, peaks); poorly fitted ones go.  All features
    of a spectrum are expressions over its row, so there is one join, and one shuffle more for the
    parcels of a layout (channel, parcel), if the settings name one.  Individualised power lies
    around the strongest peak of the model in the band; without one it is missing, and missing
    values are no rows.  Asymmetries are named by ``_lh_vs_rh_``.
    """
    on = {k for k, v in settings.features.items() if v}
    bands = {k: (float(a), float(b)) for k, (a, b) in settings.bands.items()}
    total = tuple(settings.freq_range)
    good = well_fitted(models, settings.least_r2).select(*keys, channel, "offset", "exponent", "ap", "peaks")
    rows = psd.join(good, [*keys, channel]).withColumn("adjusted", S.periodic_part(F.col("power"), F.col("ap")))
    # areas and peaks are columns, since several features come from each
    freqs, spectra = F.col("freqs"), {"Adjusted": F.col("adjusted"), "OriginalPSD": F.col("power")}
    rows = rows.withColumns({f"__peak_{b}": S.peak_in_band(F.col("peaks"), lo, hi) for b, (lo, hi) in bands.items()})
    areas = {}
    for kind, power in spectra.items():
        areas[f"__all_{kind}"] = S.trapezoid(freqs, power, *total)
        for band, (lo, hi) in bands.items():
            areas[f"__area_{kind}_{band}"] = S.trapezoid(freqs, power, lo, hi)
            if band != "Broadband" and band in settings.offsets:
                peak = F.col(f"__peak_{band}.cf")
                down, up = (peak + F.lit(float(x)) for x in settings.offsets[band])
                areas[f"__own_{kind}_{band}"] = F.when(peak.isNotNull(), S.trapezoid(freqs, power, down, up))
    rows = rows.withColumns(areas)
    found = [("Offset", "", F.col("offset")), ("Exponent", "", F.col("exponent"))]
    for kind in spectra:
        area = {band: F.col(f"__area_{kind}_{band}") for band in bands}
        found += [(f"{kind}_Band_Ratio", f"{a}_over_{b}", S.log10_or_null(S.ratio_or_null(area[a], area[b]))) for a, b in settings.ratios if a in bands and b in bands]
        for band in bands:
            found.append((f"{kind}_Canonical_Absolute_Power", band, S.log10_or_null(area[band])))
            if band != "Broadband":
                found.append((f"{kind}_Canonical_Relative_Power", band, S.ratio_or_null(area[band], F.col(f"__all_{kind}"))))
            if f"__own_{kind}_{band}" in areas:
                own = F.col(f"__own_{kind}_{band}")
                found.append((f"{kind}_Individualized_Absolute_Power", band, S.log10_or_null(own)))
                found.append((f"{kind}_Individualized_Relative_Power", band, S.ratio_or_null(own, F.col(f"__all_{kind}"))))
    for band in bands:
        found += [(f"Peak_{name}", band, F.col(f"__peak_{band}.{part}")) for name, part in (("Center", "cf"), ("Power", "pw"), ("Width", "bw"))]
    items = [F.struct(F.lit(f).alias("feature"), F.lit(b).alias("band"), v.cast("double").alias("value")) for f, b, v in found if f in on]
    if not items:
        return rows.select(*keys, channel, F.lit("").alias("feature"), F.lit("").alias("band"), F.lit(0.0).alias("value")).limit(0)
    out = rows.select(*keys, channel, F.explode(F.array(*items)).alias("x")).select(*keys, channel, "x.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    if settings.which_layout and layout is not None:
        out = parcel_mean(out, layout, (*keys, "feature", "band"), channel).withColumnRenamed("parcel", channel)
    if "Hemispheric_Asymmetry_index" in on:
        out = out.unionByName(hemispheric_asymmetry(out, (*keys, "feature", "band"), channel, "value", left, right))
    return out
