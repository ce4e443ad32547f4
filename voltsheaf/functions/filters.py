"""Linear-phase filters and rational resampling of sampled signals: designs, and their use on blocks with margins."""

from __future__ import annotations

import math

import numpy as np

#: Half-width of a resampling kernel, in periods of the slower of the two rates.
LOBES = 10


def low_pass(cut: float, sfreq: float, half: int) -> np.ndarray:
    """A Hamming-windowed sinc of 2 * half + 1 taps with unit gain at zero."""
    n = np.arange(-half, half + 1)
    h = np.sinc(2 * cut / sfreq * n) * (0.54 + 0.46 * np.cos(np.pi * n / max(half, 1)))
    return h / h.sum()


def half_length(transition: float, sfreq: float) -> int:
    """Taps on each side for a transition of so many Hz (a Hamming window spends 3.3 / width seconds)."""
    return max(1, math.ceil(3.3 / transition * sfreq / 2))


def band_kernel(sfreq: float, lo: float | None, hi: float | None) -> np.ndarray:
    """Band-pass taps; the transitions are a quarter of the edge, at least 2 Hz, and end at zero and at the Nyquist rate."""
    top = sfreq / 2
    parts = []
    if hi is not None and hi < top:
        wide = min(max(0.25 * hi, 2.0), top - hi)
        parts.append((1.0, hi + wide / 2, wide))
    if lo is not None and lo > 0:
        wide = min(max(0.25 * lo, 2.0), lo)
        parts.append((-1.0, lo - wide / 2, wide))
    half = max([half_length(w, sfreq) for _, _, w in parts], default=0)
    out = np.zeros(2 * half + 1)
    if not any(sign > 0 for sign, _, _ in parts):
        out[half] = 1.0
    for sign, cut, _ in parts:
        out += sign * low_pass(cut, sfreq, half)
    return out


def notch_kernel(sfreq: float, freqs: list[float], transition: float = 1.0) -> np.ndarray:
    """Taps that stop a two-hundredth of each frequency around it, with transitions of ``transition`` Hz."""
    half = half_length(transition, sfreq)
    out = np.zeros(2 * half + 1)
    out[half] = 1.0
    for f in freqs:
        edge = f / 400 + transition / 2
        if f + edge < sfreq / 2:
            out -= low_pass(f + edge, sfreq, half)
        else:
            out[half] -= 1.0
        out += low_pass(f - edge, sfreq, half)
    return out


def fir_kernel(sfreq: float, lo: float | None = 1.0, hi: float | None = 80.0, line: float | None = 50.0) -> np.ndarray:
    """Band-pass and notches at up to four multiples of the line frequency in one symmetric kernel."""
    notches = [k * line for k in range(1, 5) if k * line <= sfreq / 2] if line else []
    band = band_kernel(sfreq, lo, hi)
    return np.convolve(band, notch_kernel(sfreq, notches)) if notches else band


def reflected(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """x with so many values added at its ends: turned about the end value, then zeros where x is too short."""
    left, right = min(before, len(x) - 1), min(after, len(x) - 1)
    head, tail = 2 * x[0] - x[left:0:-1], 2 * x[-1] - x[-2 : -2 - right : -1]
    return np.concatenate([np.zeros(before - left), head, x, tail, np.zeros(after - right)])


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of the convolution that need nothing outside x, by Fourier transforms."""
    n = len(x) - len(h) + 1
    if n <= 0:
        return np.zeros(0)
    size = 1 << (len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[len(h) - 1 : len(h) - 1 + n]


def filtered(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A whole signal through a symmetric kernel, without delay."""
    half = len(h) // 2
    return convolved(reflected(x, half, half), h)


def resample_taps(up: int, down: int) -> tuple[np.ndarray, int]:
    """A row of taps for each of the ``up`` phases, each of unit sum, and how many inputs a row reaches back.

    Output m lies at input m * down / up; its phase is m * down mod up, and tap i of a row
    belongs to input floor(m * down / up) - reach + i.
    """
    slow = max(up, down)
    reach = math.ceil(LOBES * slow / up)
    at = (np.arange(2 * reach + 1) - reach)[None, :] - (np.arange(up) / up)[:, None]  # distance from the output, in inputs
    u = at * up / slow
    taps = np.where(np.abs(u) < LOBES, np.sinc(u) * (0.54 + 0.46 * np.cos(np.pi * u / LOBES)), 0.0)
    return taps / taps.sum(1, keepdims=True), reach


def resampled(padded: np.ndarray, first: int, outputs: np.ndarray, up: int, down: int) -> np.ndarray:
    """The outputs (their numbers) from inputs of which padded[0] has the number ``first``."""
    taps, reach = resample_taps(up, down)
    whole, phase = outputs * down // up, outputs * down % up
    at = whole - reach - first
    return (padded[at[:, None] + np.arange(2 * reach + 1)] * taps[phase]).sum(1)
