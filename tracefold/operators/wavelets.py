"""Orthogonal wavelet transforms of traces (Daubechies filters, periodic ends).

A level splits n samples into n / 2 coarse and n / 2 detail coefficients: with a
filter c of ``order`` taps, coarse[m] is the sum of c[k] x[2 m + k + 2 - order / 2],
and detail[m] the same with d[k] = (-1)^k c[order - 1 - k], places modulo n.
The coarse half is split again at the next level; coefficients lie in the order
coarsest, its details, finer details. The inverse is the transpose.

Filters follow from the order by spectral factorisation: of the roots of the
half-band polynomial those within the unit circle are taken.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.kernels import Kernel


@lru_cache(maxsize=16)
def daubechies(order: int) -> tuple[np.ndarray, np.ndarray]:
    """(coarse, detail) taps of the extremal-phase filter of an even order from 2 to 20."""
    if order % 2 or not 2 <= order <= 20:
        raise ValueError("an even order from 2 to 20")
    half = order // 2
    c = np.ones(1)
    for _ in range(half):
        c = np.convolve(c, [1.0, 1.0])
    # roots in y = (2 - z - 1 / z) / 4 of the sum of C(half - 1 + k, k) y^k, each to the root z within the circle
    for y in np.roots([math.comb(half - 1 + k, k) for k in range(half - 1, -1, -1)]):
        b = 1 - 2 * y
        z = b + np.sqrt(b * b - 1 + 0j)
        c = np.convolve(c, [1.0, -(z if abs(z) < 1 else 1 / z)])
    c = c.real * math.sqrt(2) / c.real.sum()
    return c, c[::-1] * (-1.0) ** np.arange(order)


def _places(n: int, order: int) -> np.ndarray:
    return (2 * np.arange(n // 2)[:, None] + np.arange(order)[None, :] + 2 - order // 2) % n


def split(x: np.ndarray, order: int) -> np.ndarray:
    """One level along the last axis."""
    c, d = daubechies(order)
    near = x[..., _places(x.shape[-1], order)]
    return np.concatenate((near @ c, near @ d), axis=-1)


def join(x: np.ndarray, order: int) -> np.ndarray:
    """Inverse of :func:`split`."""
    c, d = daubechies(order)
    n = x.shape[-1]
    out, places = np.zeros(x.shape), _places(n, order)
    for k in range(order):  # the places of one tap differ
        out[..., places[:, k]] += c[k] * x[..., : n // 2] + d[k] * x[..., n // 2 :]
    return out


def _check(n: int, levels: int) -> None:
    if levels < 1 or n % (1 << levels) or n >> levels < 4:
        raise ValueError(f"{n} samples can't be halved {levels} times to 4 or more")


def transform(order: int = 4, levels: int = 1) -> Kernel:
    """Coefficients of ``levels`` levels."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        n = x.shape[1]
        _check(n, levels)
        x = np.array(x, dtype=np.float64)
        for k in range(levels):
            x[:, : n >> k] = split(x[:, : n >> k], order)
        return x

    return run


def inverse(order: int = 4, levels: int = 1, coarse_only: bool = False) -> Kernel:
    """Samples from coefficients; ``coarse_only`` leaves all details out."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        n = x.shape[1]
        _check(n, levels)
        x = np.array(x, dtype=np.float64)
        if coarse_only:
            x[:, n >> levels :] = 0
        for k in range(levels - 1, -1, -1):
            x[:, : n >> k] = join(x[:, : n >> k], order)
        return x

    return run


def cascade(order: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(scaling function, mother wavelet) at steps of 2 ** -levels, by refining the filter."""
    c, d = daubechies(order)
    phi, psi = c, d
    for _ in range(levels - 1):
        fine = lambda x: np.convolve(np.repeat(x, 2) * np.tile([1.0, 0.0], len(x)), c)[: 2 * len(x) + order - 2]
        phi, psi = fine(phi), fine(psi)
    scale = math.sqrt(2) ** levels
    return phi * scale, psi * scale


def across(traces: DataFrame, panel: list[str], order: int = 4, invert: bool = False) -> DataFrame:
    """One level across the traces of each panel, numbered by ``place`` from 0 and even in number: panel, place, data.

    Each trace is sent to the coefficients that it is part of, and those are summed sample by sample with
    map-side sums, so no task holds a panel. A level of a panel of one trace or an odd number raises.
    """
    c, d = daubechies(order)
    sizes = traces.groupBy(*panel).agg(F.count(F.lit(1)).alias("n_")).withColumnsRenamed({k: f"{k}_size_" for k in panel})
    sized = traces.join(sizes, [traces[k].eqNullSafe(sizes[f"{k}_size_"]) for k in panel]).drop(*(f"{k}_size_" for k in panel))
    n = F.when(F.col("n_") % 2 == 0, F.col("n_")).otherwise(F.raise_error(F.lit("a panel with an odd number of traces can't be split")).cast("long"))
    half = n / 2
    if invert:
        own = F.when(F.col("place") < half, F.col("place")).otherwise(F.col("place") - half).cast("long")
        taps = F.array(*[F.struct(F.pmod(2 * own + k + 2 - order // 2, n).alias("to"), F.when(F.col("place") < half, float(c[k])).otherwise(float(d[k])).alias("w")) for k in range(order)])
    else:
        parts = []
        for k in range(order):
            m = F.col("place") - k - 2 + order // 2  # 2 m of the coefficient that reads this place by tap k
            for detail, w in ((0, c[k]), (1, d[k])):
                parts.append(F.when(m % 2 == 0, F.struct((F.pmod(m, n) / 2 + detail * half).cast("long").alias("to"), F.lit(float(w)).alias("w"))))
        taps = F.array_compact(F.array(*parts))
    rows = sized.select(*panel, "data", F.explode(taps).alias("t")).select(*panel, F.col("t.to").alias("place"), F.col("t.w").alias("w_"), F.posexplode("data").alias("it", "v"))
    summed = rows.groupBy(*panel, "place", "it").agg(F.sum(F.col("v").cast("double") * F.col("w_")).alias("v"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("it", "v"))), lambda s: s["v"]).cast(T.ArrayType(T.DoubleType()))
    return summed.groupBy(*panel, "place").agg(data.alias("data"))
