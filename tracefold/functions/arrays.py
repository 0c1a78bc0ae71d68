"""Column functions over sample arrays, built from Spark's array functions only.

Every function takes and returns columns, so Catalyst sees the whole expression
and no Python runs on the executors. Sums are in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _each(n, f) -> Column:
    """array of f(0) .. f(n - 1); n is a number or a column."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<double>"))


def let(c, f) -> Column:
    """f of a column that is evaluated once, also where f uses it inside lambdas.

    Without it the optimizer may put the column's whole expression into the lambda.
    """
    return F.get(F.transform(F.array(_col(c)), f), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _at(a: Column, i: Column) -> Column:
    """a[i] in double, 0 outside."""
    return F.coalesce(F.when(i >= 0, F.get(a, i.cast("int"))), F.lit(0.0)).cast("double")


# --- sums, norms, extremes (BLAS level 1) -------------------------------------


def dot(x, y) -> Column:
    return _sum(F.zip_with(_col(x), _col(y), lambda a, b: a.cast("double") * b))


def norm2(x) -> Column:
    return F.sqrt(dot(x, x))


def abs_sum(x) -> Column:
    return _sum(F.transform(_col(x), lambda v: F.abs(v).cast("double")))


def axpy(a, x, y) -> Column:
    a = F.lit(float(a)) if isinstance(a, int | float) else a
    return F.zip_with(_col(x), _col(y), lambda u, v: a * u + v)


def scale(a, x) -> Column:
    a = F.lit(float(a)) if isinstance(a, int | float) else a
    return F.transform(_col(x), lambda v: a * v)


def abs_max(x) -> Column:
    return F.array_max(F.transform(_col(x), F.abs)).cast("double")


def abs_argmax(x) -> Column:
    """First index of the largest absolute value; -1 for an empty array."""
    a = F.transform(_col(x), F.abs)
    return F.coalesce(F.array_position(a, F.array_max(a)) - 1, F.lit(-1).cast("long"))


def argmax(x) -> Column:
    return F.coalesce(F.array_position(_col(x), F.array_max(_col(x))) - 1, F.lit(-1).cast("long"))


def argmin(x) -> Column:
    return F.coalesce(F.array_position(_col(x), F.array_min(_col(x))) - 1, F.lit(-1).cast("long"))


def rms(x) -> Column:
    x = _col(x)
    return F.when(F.size(x) > 0, F.sqrt(dot(x, x) / F.size(x)))


def mean(x) -> Column:
    x = _col(x)
    return F.when(F.size(x) > 0, _sum(F.transform(x, lambda v: v.cast("double"))) / F.size(x))


# --- filters and windows ------------------------------------------------------


def convolve(x, ifx: int, y, ify: int, lz: int, ifz: int) -> Column:
    """z[i] = sum over j of x[j] * y[i - j], with first indices ifx, ify and ifz; zero outside the arrays."""

    def one(x: Column, y: Column, k: Column) -> Column:
        i = k + ifz
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(0.0), lambda s, j: s + F.get(x, j).cast("double") * _at(y, i - (j + ifx) - ify))

    return let(x, lambda xs: let(y, lambda ys: _each(lz, lambda k: one(xs, ys, k))))


def correlate(x, ifx: int, y, ify: int, lz: int, ifz: int) -> Column:
    """z[i] = sum over j of x[j] * y[i + j]."""

    def one(x: Column, y: Column, k: Column) -> Column:
        i = k + ifz
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(0.0), lambda s, j: s + F.get(x, j).cast("double") * _at(y, i + (j + ifx) - ify))

    return let(x, lambda xs: let(y, lambda ys: _each(lz, lambda k: one(xs, ys, k))))


def differentiate(x, h: float) -> Column:
    """Centred differences, one-sided at both ends; needs two samples."""

    def all_(x: Column) -> Column:
        n = F.size(x)
        at = lambda i: F.get(x, i).cast("double")
        return F.transform(x, lambda v, i: F.when(i == 0, (at(F.lit(1)) - v) / h).when(i == n - 1, (v - at(n - 2)) / h).otherwise((at(i + 1) - at(i - 1)) / (2 * h)))

    return let(x, all_)


def hilbert_taps(half: int = 30) -> list[float]:
    """2 * half + 1 Hamming-tapered coefficients of the Hilbert transformer; even places are 0."""
    right = [(0.54 + 0.46 * math.cos(math.pi * i / half)) * (2 / (math.pi * i) if i % 2 else 0.0) for i in range(1, half + 1)]
    return [-v for v in reversed(right)] + [0.0] + right


def hilbert(x, half: int = 30, n: int | None = None) -> Column:
    """Hilbert transform by convolution with :func:`hilbert_taps`."""
    x = _col(x)
    if n is None:
        return let(F.lit(hilbert_taps(half)), lambda t: let(x, lambda y: F.transform(y, lambda v, i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * half)), F.lit(0.0), lambda s, j: s + F.get(t, j) * _at(y, i - (j - half))))))
    return convolve(F.lit(hilbert_taps(half)), -half, x, 0, n, 0)


def running_average(x, length: int) -> Column:
    """Mean of the samples within ``length // 2`` places; the window shrinks at the ends."""
    half = length // 2
    part = lambda x, i: F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(x) - 1) - F.greatest(i - half, F.lit(0)) + 1)
    return let(x, lambda x: F.transform(x, lambda v, i: mean(part(x, i))))


def rotate(x, by: int) -> Column:
    """Circular rotation: sample i goes to place i + by."""
    x = _col(x)
    k = F.pmod(F.lit(-by), F.size(x))
    return F.when(F.size(x) > 0, F.concat(F.slice(x, k + 1, F.size(x)), F.slice(x, F.lit(1), k))).otherwise(x)


def hanning(n: int) -> Column:
    return _each(n, lambda k: 0.5 * (1 - F.cos(F.lit(2 * math.pi) * (k + 1) / (n + 1))))


def taper(x, first: int, last: int) -> Column:
    """Linear ramps over the first and the last samples."""
    up = lambda i: F.when(i < first, (i + 1) / F.lit(float(first + 1))).otherwise(1.0) if first else F.lit(1.0)
    down = lambda n, i: F.when(n - 1 - i < last, (n - i) / F.lit(float(last + 1))).otherwise(1.0) if last else F.lit(1.0)
    return let(x, lambda x: F.transform(x, lambda v, i: v * up(i) * down(F.size(x), i)))


def clip(x, low: float, high: float) -> Column:
    return F.transform(_col(x), lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def mute(x, first_live: Column, ramp: int = 0) -> Column:
    """Zero before a sample index, with a linear ramp after it."""
    return F.transform(_col(x), lambda v, i: F.when(i < first_live, 0.0).when(i < first_live + ramp, v * (i - first_live + 1) / (ramp + 1)).otherwise(v))


# --- interpolation ------------------------------------------------------------


def bracket(ax, x) -> Column:
    """Largest i with ax[i] <= x for rising ax (>= for falling), between 0 and n - 1."""
    ax = _col(ax)
    rising = F.get(ax, F.size(ax) - 1) >= F.get(ax, F.lit(0))
    count = F.when(rising, F.size(F.filter(ax, lambda a: a <= x))).otherwise(F.size(F.filter(ax, lambda a: a >= x)))
    return F.greatest(count - 1, F.lit(0))


def interpolate(xin, yin, x, below=None, above=None) -> Column:
    """Piecewise linear y(x) for rising or falling xin, constant outside (the end values unless given)."""
    xin, yin, x = _col(xin), _col(yin), _col(x)
    n = F.size(xin)
    first, last = F.get(xin, F.lit(0)), F.get(xin, n - 1)
    rising = last >= first
    low = F.get(yin, F.lit(0)) if below is None else F.lit(float(below))
    high = F.get(yin, n - 1) if above is None else F.lit(float(above))
    i = F.least(bracket(xin, x), n - 2)
    x0, x1, y0, y1 = F.get(xin, i), F.get(xin, i + 1), F.get(yin, i), F.get(yin, i + 1)
    inside = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when((rising & (x < first)) | (~rising & (x > first)), low).when((rising & (x > last)) | (~rising & (x < last)), high).when(n == 1, F.get(yin, F.lit(0))).otherwise(inside).cast("double")


def extrapolate(xin, yin, x, mode: int = 1) -> Column:
    """Piecewise linear y(x), continued beyond the ends: mode 0 nowhere, 1 at both, 2 below, 3 above."""
    xin, yin, x = _col(xin), _col(yin), _col(x)
    n = F.size(xin)
    low, high = x < F.get(xin, F.lit(0)), x > F.get(xin, n - 1)
    i = F.least(F.greatest(F.size(F.filter(xin, lambda a: a <= x)) - 1, F.lit(0)), n - 2)
    x0, x1, y0, y1 = F.get(xin, i), F.get(xin, i + 1), F.get(yin, i), F.get(yin, i + 1)
    line = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    out = F.when(n < 2, F.get(yin, F.lit(0)))
    if mode not in (1, 2):
        out = out.when(low, F.get(yin, F.lit(0)))
    if mode not in (1, 3):
        out = out.when(high, F.get(yin, n - 1))
    return out.otherwise(line).cast("double")


def bilinear(grid, x, y, dx: float = 1.0, fx: float = 0.0, dy: float = 1.0, fy: float = 0.0) -> Column:
    """Bilinear value at (x, y) of an array of rows along y of arrays along x; places outside take the nearest edge."""

    def cell(c, step: float, first: float, n: Column) -> tuple[Column, Column, Column]:
        at = F.least(F.greatest((_col(c).cast("double") - first) / step, F.lit(0.0)), (n - 1).cast("double"))
        low = F.least(F.floor(at).cast("int"), F.greatest(n - 2, F.lit(0)))
        return low, F.least(low + 1, n - 1), at - low

    grid = _col(grid)
    x0, x1, wx = cell(x, dx, fx, F.size(F.get(grid, F.lit(0))))
    y0, y1, wy = cell(y, dy, fy, F.size(grid))
    value = lambda j, i: F.get(F.get(grid, j), i).cast("double")
    return (1 - wy) * ((1 - wx) * value(y0, x0) + wx * value(y0, x1)) + wy * ((1 - wx) * value(y1, x0) + wx * value(y1, x1))


def upper_bound(values, x) -> Column:
    """Number of values that are at most x, in a rising array."""
    return F.size(F.filter(_col(values), lambda a: a <= x))


def sinc(x) -> Column:
    x = _col(x)
    return F.when(x == 0, 1.0).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * x))


# --- wavelets (n samples, interval dt) ----------------------------------------


def _wavelet(n: int, dt: float, f) -> Column:
    return _each(n, lambda k: f(k * F.lit(float(dt))))


def ricker(n: int, dt: float, fpeak: float) -> Column:
    """Ricker wavelet that peaks at 1 / fpeak."""

    def f(t):
        x = F.pow(F.lit(math.pi * fpeak) * (t - 1 / fpeak), 2)
        return F.exp(-x) * (1 - 2 * x)

    return _wavelet(n, dt, f)


def distorted_ricker(half: int, dt: float, period: float, ampl: float = 1.0, distort: float = 0.0) -> Column:
    """Ricker wavelet of 2 * half - 1 samples around its centre; ``distort`` tilts it."""

    def f(k):
        t = (k - (half - 1)) * F.lit(dt / period)
        x = t * t * 6.25
        return ampl * (1 - 2 * x) * F.exp(-x) * (1 - 2 * distort * t)

    return _each(2 * half - 1, f)


def akb(n: int, dt: float, fpeak: float) -> Column:
    t0 = 1.8 / fpeak
    return _wavelet(n, dt, lambda t: -60 * (t - t0) * F.exp(-2 * fpeak * fpeak * (t - t0) * (t - t0)))


def spike_wavelet(n: int, at: int) -> Column:
    return _each(n, lambda k: F.when(k == at, 1.0).otherwise(0.0))


def unit_wavelet(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def zero_wavelet(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def berlage(n: int, dt: float, fpeak: float, ampl: float = 1.0, tn: float = 0.0, decay: float = 0.0, ipa: float = 0.0) -> Column:
    return _wavelet(n, dt, lambda t: ampl * F.pow(t, F.lit(float(tn))) * F.exp(-decay * t) * F.cos(F.lit(2 * math.pi * fpeak) * t + ipa))


def gaussian(n: int, dt: float, fpeak: float) -> Column:
    t0, s = 1 / fpeak, 1 / (math.sqrt(2) * math.pi * fpeak)
    return _wavelet(n, dt, lambda t: F.exp(-(t - t0) * (t - t0) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)))


def gaussian_derivative(n: int, dt: float, fpeak: float) -> Column:
    t0, s = 1 / fpeak, 1 / (math.sqrt(2) * math.pi * fpeak)
    return _wavelet(n, dt, lambda t: -(t - t0) * F.exp(-(t - t0) * (t - t0) / (2 * s * s)) / (s**3 * math.sqrt(2 * math.pi)))


# --- spectra of short traces --------------------------------------------------


def dft(x, sign: int = 1) -> Column:
    """Discrete Fourier transform by its sums: array of (r, i) for frequencies 0 to n // 2, unscaled."""

    def one(x: Column, k: Column) -> Column:
        n = F.size(x)
        angle = lambda j: F.lit(2 * math.pi * sign) * F.pmod(j * k, n) / n
        part = lambda f: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, j: s + F.get(x, j).cast("double") * f(angle(j)))
        return F.struct(part(F.cos).alias("r"), part(F.sin).alias("i"))

    return let(x, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int")), lambda k: one(x, k)))


def amplitude(spectrum) -> Column:
    return F.transform(_col(spectrum), lambda c: F.hypot(c["r"], c["i"]))
