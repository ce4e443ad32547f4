"""From samples to the long feature table, as the run's settings say."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from voltsheaf.config import RunConfig
from voltsheaf.operators import spectral
from voltsheaf.plans import kernels


def decomposed(samples: DataFrame, settings: RunConfig, sfreq: float) -> tuple[DataFrame, DataFrame]:
    """Spectra (subject, channel, freqs, power) and their models, in the one schema of models.

    samples: subject, channel, t_idx, value.  Spectra by the settings' method; models by peak
    parameterisation of these spectra, or by IRASA of the epochs, whose own mean spectra are then the
    ones that features are taken from.  Samples are shuffled once, by segment.
    """
    knee, band = settings.aperiodic_mode == "knee", tuple(settings.freq_range)
    if settings.parameterization == "irasa":
        spectra = kernels.irasa(samples, sfreq, band, settings.segments_length, settings.segments_overlap, np.arange(*settings.hset))
        return spectra.select("subject", "channel", "freqs", "power"), kernels.aperiodic_models(spectra, knee)
    method = {"welch": kernels.welch, "multitaper": kernels.multitaper}[settings.psd_method]
    psd = method(samples, sfreq, settings.psd_segment, settings.psd_overlap, band)
    return psd, kernels.parameterize(psd, knee, band, widths=tuple(settings.peak_width), least_height=settings.least_peak_height, threshold=settings.peak_threshold)


def extracted(samples: DataFrame, settings: RunConfig, sfreq: float, layout: DataFrame | None = None) -> DataFrame:
    """subject, channel (or parcel), feature, band, value, from samples (subject, channel, t_idx, value)."""
    psd, models = decomposed(samples, settings, sfreq)
    return spectral.features(psd, models, settings, layout)
