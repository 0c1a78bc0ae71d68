"""The incomplete gamma function, as an Arrow-batched column function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x), the part of the gamma integral above x; nan unless a > 0 and x >= 0. Series below a + 1, continued fraction above."""
    a, x = np.asarray(a, dtype=np.float64), np.asarray(x, dtype=np.float64)
    out = np.full(a.shape, np.nan)
    valid = (a > 0) & (x >= 0)
    with np.errstate(all="ignore"):
        lead = np.exp(a * np.log(x) - x - np.array([math.lgamma(v) if v > 0 and np.isfinite(v) else np.nan for v in a.ravel()]).reshape(a.shape))
    low = valid & (x < a + 1)
    if low.any():
        p, q, term, total, k = a[low], x[low], 1 / a[low], 1 / a[low], 0
        while (np.abs(term) > np.abs(total) * 1e-16).any():
            k += 1
            term = term * q / (p + k)
            total = total + term
        out[low] = np.where(q == 0, 1.0, 1 - lead[low] * total)
    high = valid & ~low
    if high.any():
        p, q = a[high], x[high]
        # the fraction 1 / (q + 1 - p - 1 (1 - p) / (q + 3 - p - 2 (2 - p) / (q + 5 - p ...))), by its convergents' ratios
        b = q + 1 - p
        c, d = np.full(p.shape, 1e300), 1 / b
        value, k = d.copy(), 0
        change = np.full(p.shape, 2.0)
        while (np.abs(change - 1) > 1e-15).any() and k < 100_000:
            k += 1
            step = k * (p - k)
            b = b + 2
            d, c = step * d + b, b + step / c
            d, c = np.where(np.abs(d) < 1e-300, 1e-300, d), np.where(np.abs(c) < 1e-300, 1e-300, c)
            d = 1 / d
            change = c * d
            value = value * change
        out[high] = lead[high] * value
    return out


def chi_square_tail(chi2: Column, freedom: Column) -> Column:
    """Chance that chi squared of so many degrees of freedom is exceeded; null without freedom or for nulls."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        got = pd.Series(upper_gamma(n.to_numpy(dtype=float, na_value=np.nan) / 2, x.to_numpy(dtype=float, na_value=np.nan) / 2), index=x.index)
        return got.where(got.notna(), None)

    return run(chi2.cast("double"), freedom.cast("double"))
