"""Interpolation by eight least-squares sinc coefficients.

The coefficients for a fraction d of a sample are the best least-squares fit, for
frequencies up to (0.066 + 0.265 ln 8) of Nyquist, to the ideal shift: they solve a
symmetric Toeplitz system of sinc values. A table holds them for 512 steps of d; the
nearest step is used. Samples outside the trace are ``left`` or ``right``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tracefold.operators.kernels import Kernel

TAPS, STEPS = 8, 512


def coefficients(fraction: float, taps: int = TAPS) -> np.ndarray:
    """Weights of the samples from 1 - taps / 2 to taps / 2 after the place's whole part; a unit for fraction 0 and 1."""
    if fraction in (0.0, 1.0):
        return np.eye(taps)[taps // 2 - 1 + int(fraction)]
    reach = min(0.066 + 0.265 * math.log(taps), 1.0)
    j = np.arange(taps)
    return np.linalg.solve(np.sinc(reach * (j[:, None] - j[None, :])), np.sinc(reach * (taps // 2 - j - 1 + fraction)))


@lru_cache(maxsize=1)
def table() -> np.ndarray:
    """Coefficients of all steps from 0 to 1."""
    return np.stack([coefficients(k / STEPS) for k in range(STEPS + 1)])


def at_places(x: np.ndarray, places: np.ndarray, left: float = 0.0, right: float = 0.0) -> np.ndarray:
    """Values of rows at places counted in samples; places: one row for all, or a row each."""
    places = np.broadcast_to(places, (len(x), places.shape[-1]))
    whole = np.floor(places)
    weights = table()[np.floor((places - whole) * STEPS + 0.5).astype(np.int64)]
    n, rows = x.shape[1], np.arange(len(x))[:, None]
    out = np.zeros(places.shape)
    for j in range(TAPS):
        at = (whole + (j + 1 - TAPS // 2)).astype(np.int64)
        inside = x[rows, np.clip(at, 0, n - 1)]
        out += weights[..., j] * np.where(at < 0, left, np.where(at >= n, right, inside))
    return out


def resample(n_out: int, dt_out: float, start: float = 0.0, left: float = 0.0, right: float = 0.0) -> Kernel:
    """Samples at start, start + dt_out, ... (in seconds after the first sample)."""
    return lambda x, dt: at_places(x, ((start + dt_out * np.arange(n_out)) / dt)[None, :], left, right)


def shift(seconds: float, left: float = 0.0, right: float = 0.0) -> Kernel:
    """y(t) = x(t + seconds), by the coefficients of this very fraction."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        whole = math.floor(seconds / dt)
        weights, n = coefficients(seconds / dt - whole), x.shape[1]
        out = np.zeros(x.shape)
        for j, w in enumerate(weights):
            at = np.arange(n) + whole + j + 1 - TAPS // 2
            out += w * np.where(at < 0, left, np.where(at >= n, right, x[:, np.clip(at, 0, n - 1)]))
        return out

    return run
