"""Transforms of radially symmetric functions given along the radius.

Abel: g(x) = 2 * integral of f(r) r / sqrt(r² - x²) from x on, where 1 / sqrt is a sum
of nine exponentials in log r, so that g follows from the outermost sample inwards by
a bank of nine first-order recursions. Hankel: the Abel transform, then a cosine
(order 0) or sine transform (order 1) of it over 2 (n - 1) places.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tracefold.operators.kernels import Kernel

# Weights and exponents of the nine exponentials.
WEIGHTS = (1.0, 0.610926299405048390, 0.895089852938535935, 1.34082948787002865, 2.02532848558443890, 3.18110895533701843, 5.90898360396353794, 77.6000213494180286, 528.221800846070892)
EXPONENTS = (0.0, -2.08424632126539366, -5.78928630565552371, -14.6268676854951032, -35.0617158334443104, -83.3258406398958158, -210.358805421311445, -6673.64911325382036, -34897.7050244132261)


@lru_cache(maxsize=16)
def _bank(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places 1 to n - 1: decay of the states, and weights of the next sample outwards and of the place's own."""
    i = np.arange(1, n, dtype=np.float64)[:, None]
    h, p = np.array(WEIGHTS)[None, :], np.array(EXPONENTS)[None, :]
    decay = ((i + 1) / i) ** p
    step = decay * (i + 1) / i
    scale = 2 * h * i / ((p + 1) * (p + 2))
    return decay, scale * (i + (p + 1 - i) * step), -scale * (p + 2 + i - (i + 1) * step)


def _abel(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    out = np.zeros(x.shape)
    out[:, 0] = x[:, 0] + 2 * x[:, 1:].sum(axis=1)
    if n > 1:
        decay, outer, own = _bank(n)
        states = np.zeros((len(x), len(WEIGHTS)))
        for i in range(n - 1, 0, -1):
            following = x[:, i + 1, None] if i + 1 < n else 0.0
            states = states * decay[i - 1] + outer[i - 1] * following + own[i - 1] * x[:, i, None]
            out[:, i] = states.sum(axis=1)
    return out


def abel() -> Kernel:
    return lambda x, dt: _abel(np.asarray(x, dtype=np.float64))


def hankel(order: int = 0) -> Kernel:
    """Hankel transform of order 0 or 1, in units of a sample."""
    if order not in (0, 1):
        raise ValueError("order 0 or 1")

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        n = x.shape[1]
        if n < 2:
            return np.zeros(x.shape)
        if order == 0:
            g = _abel(x)
            return np.fft.rfft(np.concatenate((g, g[:, -2:0:-1]), axis=1), axis=1).real / (2 * np.pi)
        places = np.arange(n)
        ratio = np.where(places > 0, x / np.maximum(places, 1), 0.0)
        g = _abel(ratio) * places
        g[:, -1] = 0
        return -np.fft.rfft(np.concatenate((g, -g[:, -2:0:-1]), axis=1), axis=1).imag / (2 * np.pi)

    return run
