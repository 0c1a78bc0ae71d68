"""Panel filters of whole panels in memory, as the other side of tests: f(matrix [trace, sample], headers)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tracefold.operators.kernels import _irfft, _rfft, polygon, real_fft_length


def dip_filter(slopes: list[float], amps: list[float], dt: float, dx: float, bias: float = 0.0) -> Callable:
    """F-K weights by piecewise linear interpolation of k / w + bias, constant outside."""
    if any(b <= a for a, b in zip(slopes, slopes[1:])) or len(slopes) != len(amps):
        raise ValueError("rising slopes with an amplitude each")

    def run(x: np.ndarray, _) -> np.ndarray:
        nx, nt = x.shape
        n1, n2 = real_fft_length(nt), real_fft_length(nx)
        s = np.fft.fft(_rfft(x, n1), n2, axis=0)
        w = 2 * np.pi * np.fft.rfftfreq(n1, dt)
        k = 2 * np.pi * np.fft.fftfreq(n2, dx)
        w = w + 1e-6 * (w[1] if len(w) > 1 else 1.0)
        weight = np.interp(k[:, None] / w[None, :] + bias, slopes, amps)
        return _irfft(np.fft.ifft(s * weight, axis=0)[:nx], n1, nt)

    return run


def _wavenumbers(x: np.ndarray, d1: float, d2: float):
    n2, n1 = (real_fft_length(n) for n in x.shape)
    return np.fft.fft2(x, (n2, n1)), np.fft.fftfreq(n1, d1), np.fft.fftfreq(n2, d2)


def radial_filter(k: list[float], amps: list[float], d1: float = 1.0, d2: float = 1.0) -> Callable:
    """Polygonal filter (sine slopes) of the radial wavenumber of a depth panel, with unit gain where the amplitude is 1."""

    def run(x: np.ndarray, _) -> np.ndarray:
        s, k1, k2 = _wavenumbers(x, d1, d2)
        r = np.hypot(k2[:, None], k1[None, :])
        return np.fft.ifft2(s * polygon(k, amps, r.reshape(-1), 1).reshape(r.shape)).real[: x.shape[0], : x.shape[1]]

    return run


def separable_filter(k1: list[float], amps1: list[float], k2: list[float], amps2: list[float], d1: float = 1.0, d2: float = 1.0) -> Callable:
    """Product of polygonal filters along both axes of a depth panel."""

    def run(x: np.ndarray, _) -> np.ndarray:
        s, f1, f2 = _wavenumbers(x, d1, d2)
        weight = polygon(k2, amps2, np.abs(f2), 1)[:, None] * polygon(k1, amps1, np.abs(f1), 1)[None, :]
        return np.fft.ifft2(s * weight).real[: x.shape[0], : x.shape[1]]

    return run


def radial_power(power: float = 0.0, d1: float = 1.0, d2: float = 1.0) -> Callable:
    """Fractional Laplacian-like filter |k| ** power; the mean is dropped when the power is negative."""

    def run(x: np.ndarray, _) -> np.ndarray:
        s, f1, f2 = _wavenumbers(x, d1, d2)
        r = 2 * math.pi * np.hypot(f2[:, None], f1[None, :])
        weight = np.where(r > 0, np.where(r > 0, r, 1.0) ** power, 1.0 if power == 0 else 0.0)
        return np.fft.ifft2(s * weight).real[: x.shape[0], : x.shape[1]]

    return run


def gaussian_panel(a1: float = 0.0, a2: float = 0.0) -> Callable:
    """Gaussian wavenumber weights exp(-(a k / 2)^2) along both axes, rescaled to the input's largest value."""

    def run(x: np.ndarray, _) -> np.ndarray:
        s, f1, f2 = _wavenumbers(x, 1.0, 1.0)
        weight = np.exp(-((a2 * 2 * math.pi * f2[:, None] / 2) ** 2) - (a1 * 2 * math.pi * f1[None, :] / 2) ** 2)
        y = np.fft.ifft2(s * weight).real[: x.shape[0], : x.shape[1]]
        top = np.abs(y).max()
        return y * (np.abs(x).max() / top) if top > 0 else y

    return run


def eigenimages(count: int | None = None, subtract: bool = True) -> Callable:
    """Keep, or subtract, the panel's first singular images (1 in 100 traces by default, at least 1)."""

    def run(x: np.ndarray, _) -> np.ndarray:
        n = count or max(1, len(x) // 100)
        u, s, v = np.linalg.svd(x, full_matrices=False)
        part = (u[:, :n] * s[:n]) @ v[:n]
        return x - part if subtract else part

    return run


def phase_coherence_filter(high: float = 1.0, low: float = 0.3) -> Callable:
    """Zero F-X cells whose phase step to the next trace has a cosine outside [low, high]; the last trace stays."""

    def run(x: np.ndarray, _) -> np.ndarray:
        n = real_fft_length(x.shape[1])
        s = _rfft(x, n)
        step = np.cos(np.angle(s[1:]) - np.angle(s[:-1]))
        keep = np.ones(s.shape, dtype=bool)
        keep[:-1, :-1] = ((step <= high + 1e-12) & (step >= low))[:, :-1]
        return _irfft(np.where(keep, s, 0), n, x.shape[1])

    return run


def low_frequency_array(dt: float, f1: float = 3.0, f2: float = 20.0, ramp: float = 5.0, velocity: float = 1000.0, dx: float = 10.0, max_mix: int | None = None) -> Callable:
    """Mix traces more at lower frequencies: an odd width of velocity / (f dx) traces between f1 and f2, blended over the ramp."""

    def run(x: np.ndarray, _) -> np.ndarray:
        nx, nt = x.shape
        n = real_fft_length(nt)
        s, f = _rfft(x, n), np.fft.rfftfreq(n, dt)
        out = s.copy()
        sums = np.concatenate((np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)))
        for j in np.flatnonzero((f >= f1) & (f <= f2 + ramp)):
            width = min(int(round(velocity / (f[j] * dx))) | 1, (max_mix or nx) | 1)
            lo, hi = np.maximum(np.arange(nx) - width // 2, 0), np.minimum(np.arange(nx) + width // 2 + 1, nx)
            mixed = (sums[hi, j] - sums[lo, j]) / (hi - lo)
            share = 1.0 if f[j] <= f2 else 1 - (f[j] - f2) / ramp
            out[:, j] = share * mixed + (1 - share) * s[:, j]
        return _irfft(out, n, nt)

    return run
