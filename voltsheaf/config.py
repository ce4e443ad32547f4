"""The validated configuration of a feature-extraction run."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, fields

# fixed values: the documented defaults
BAND_NAMES = ("Delta", "Theta", "Alpha", "Beta", "Gamma")
BANDS = {"Theta": (3, 8), "Alpha": (8, 13), "Beta": (13, 30), "Gamma": (30, 40)}
OFFSETS = {"Theta": (-2, 3), "Alpha": (-2, 3), "Beta": (-8, 9), "Gamma": (-5, 5)}
RATIO_PAIRS = [
    ("Theta", "Beta"),
    ("Theta", "Alpha"),
    ("Alpha", "Beta"),
    ("Delta", "Beta"),
    ("Delta", "Alpha"),
    ("Delta", "Theta"),
    ("Beta", "Gamma"),
    ("Alpha", "Gamma"),
    ("Theta", "Gamma"),
    ("Delta", "Gamma"),
]
FEATURE_CATEGORIES = {
    "Offset": True,
    "Exponent": True,
    "Peak_Center": False,
    "Peak_Power": False,
    "Peak_Width": False,
    "Adjusted_Canonical_Relative_Power": True,
    "Adjusted_Canonical_Absolute_Power": True,
    "Adjusted_Individualized_Relative_Power": False,
    "Adjusted_Individualized_Absolute_Power": False,
    "OriginalPSD_Canonical_Relative_Power": True,
    "OriginalPSD_Canonical_Absolute_Power": True,
    "OriginalPSD_Individualized_Relative_Power": False,
    "OriginalPSD_Individualized_Absolute_Power": False,
    "Adjusted_Band_Ratio": True,
    "OriginalPSD_Band_Ratio": True,
    "Hemispheric_Asymmetry_index": True,
}


@dataclass(frozen=True)
class RunConfig:
    which_session: int = 0
    which_layout: str | None = "all"
    which_sensor: str = "meg"
    cutoff_low: float = 1.0
    cutoff_high: float = 80.0
    resample_rate: float = 1000.0
    muscle_z: float = 4.0
    muscle_band: tuple[float, float] = (110.0, 140.0)
    ica_method: str = "fastica"
    ica_corr_threshold: float = 0.5
    reference: str = "average"
    bad_segments: str | None = "autoreject"
    reject: dict = field(default_factory=lambda: {"mag": 5000e-15, "grad": 5000e-13, "eeg": 40e-6})
    flat: dict = field(default_factory=lambda: {"mag": 10e-15, "grad": 10e-13, "eeg": 40e-6})
    segments_tmin: float = 20.0
    segments_tmax: float = -20.0
    segments_length: float = 10.0
    segments_overlap: float = 2.0
    psd_method: str = "welch"
    psd_overlap: float = 1.0
    psd_segment: float = 2.0
    parameterization: str = "irasa"
    hset: tuple[float, float, float] = (1.05, 2.0, 0.05)
    freq_range: tuple[float, float] = (3.0, 40.0)
    aperiodic_mode: str = "knee"
    peak_width: tuple[float, float] = (1.0, 12.0)
    least_peak_height: float = 0.0
    peak_threshold: float = 2.0
    least_r2: float = 0.9
    bands: dict = field(default_factory=lambda: {k: list(v) for k, v in BANDS.items()})
    offsets: dict = field(default_factory=lambda: {k: list(v) for k, v in OFFSETS.items()})
    ratios: list = field(default_factory=lambda: [list(p) for p in RATIO_PAIRS])
    features: dict = field(default_factory=lambda: dict(FEATURE_CATEGORIES))
    same_environmental_noise: bool = False
    environmental_noise: bool = True
    random_state: int = 42

    def __post_init__(self) -> None:
        choices = {
            "which_layout": ("all", "lobe", None), "which_sensor": ("mag", "grad", "meg", "eeg", "opm"), "ica_method": ("fastica", "infomax", "picard"), "reference": ("average", "REST", "None"),
            "bad_segments": ("autoreject", "fixed_thr", None), "psd_method": ("welch", "multitaper"), "parameterization": ("irasa", "fooof"), "aperiodic_mode": ("fixed", "knee"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")
        if not 0 < self.ica_corr_threshold < 1:
            raise ValueError("ica_corr_threshold lies between 0 and 1")
        if self.segments_tmax >= 0:
            raise ValueError("segments_tmax is negative: seconds before the end")
        if not 0 <= self.segments_overlap < self.segments_length:
            raise ValueError("segments_overlap is shorter than a segment")
        if not 0 < self.cutoff_low < self.cutoff_high:
            raise ValueError("cutoff_low lies below cutoff_high")
        if self.same_environmental_noise and not self.environmental_noise:
            raise ValueError("same_environmental_noise needs environmental_noise")
        if unknown := set(self.features) - set(FEATURE_CATEGORIES):
            raise ValueError(f"unknown feature categories: {sorted(unknown)}")
        for a, b in self.ratios:
            if a not in BAND_NAMES or b not in BAND_NAMES:
                raise ValueError(f"band ratios name bands of {BAND_NAMES}")
        if self.muscle_z < 3:
            warnings.warn("muscle_z below 3 rejects much clean data", stacklevel=2)
        if self.muscle_band[0] < 100:
            warnings.warn("muscle_band below 100 Hz holds brain signal", stacklevel=2)

    @classmethod
    def load(cls, path: str) -> RunConfig:
        with open(path) as f:
            raw = json.load(f)
        unknown = set(raw) - {x.name for x in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) and k in ("muscle_band", "hset", "freq_range", "peak_width") else v for k, v in raw.items()})

    def save(self, path: str, overwrite: bool = False) -> None:
        with open(path, "w" if overwrite else "x") as f:
            json.dump(asdict(self), f, indent=2)
