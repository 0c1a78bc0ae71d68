"""Curves and small linear systems per row: splines and structured solvers as Arrow-batched functions.

Rows of a batch with arrays of like lengths are stacked and worked on together; all
functions work along the last axis. A null array gives null, a null number in it counts
as NaN.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracefold.functions import stacks

#: Numbers of one stack at most, so that long arrays are stacked fewer at a time.
STACK = 1 << 20


def _by_lengths(f: Callable[..., np.ndarray], *columns: pa.Array, square: bool = False) -> pa.Array:
    """f of stacks of rows [row, place] of like lengths, as one column; square: f makes a matrix of each row."""
    sizes, found = np.stack([stacks.lengths(c) for c in columns], axis=1), []
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    for kind, shape in enumerate(kinds):
        if shape.min() < 0:
            continue
        own = np.flatnonzero(kind_of.ravel() == kind)
        longest = max(1, int(shape.max()))
        step = max(1, STACK // (longest * longest if square else longest))
        for rows in (own[k : k + step] for k in range(0, len(own), step)):
            found.append((rows, f(*(stacks.stack(c, rows, n) for c, n in zip(columns, shape, strict=True)))))
    return stacks.lists(len(sizes), found)


def natural_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Knot slopes of the natural cubic spline."""
    h = np.diff(x)
    d = np.diff(y) / h
    one = np.ones_like(x[..., :1])
    rhs = np.concatenate((d[..., :1], h[..., 1:] * d[..., :-1] + h[..., :-1] * d[..., 1:], d[..., -1:]), axis=-1)
    return tridiagonal(np.concatenate((0 * one, h[..., 1:], one), axis=-1), np.concatenate((2 * one, 2 * (h[..., :-1] + h[..., 1:]), 2 * one), axis=-1), np.concatenate((one, h[..., :-1], 0 * one), axis=-1), 3 * rhs)


def akima_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes weighted by how much the neighbouring chords turn."""
    d = np.diff(y) / np.diff(x)
    if d.shape[-1] == 1:
        return np.repeat(d, 2, axis=-1)
    first, second, last, other = d[..., :1], d[..., 1:2], d[..., -1:], d[..., -2:-1]
    m = np.concatenate((3 * first - 2 * second, 2 * first - second, d, 2 * last - other, 3 * last - 2 * other), axis=-1)
    w1, w2 = np.abs(m[..., 3:] - m[..., 2:-1]), np.abs(m[..., 1:-2] - m[..., :-3])
    total = w1 + w2
    return np.where(total > 0, (w1 * m[..., 1:-2] + w2 * m[..., 2:-1]) / np.where(total > 0, total, 1), (m[..., 1:-2] + m[..., 2:-1]) / 2)


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes by weighted harmonic means, 0 at turning points: the curve never overshoots its knots."""
    h = np.diff(x)
    d = np.diff(y) / h
    if d.shape[-1] == 1:
        return np.repeat(d, 2, axis=-1)
    out = np.zeros_like(y)
    w1, w2 = 2 * h[..., 1:] + h[..., :-1], h[..., 1:] + 2 * h[..., :-1]
    same = d[..., :-1] * d[..., 1:] > 0
    safe = lambda v: np.where(same, v, 1.0)
    out[..., 1:-1] = np.where(same, (w1 + w2) / (w1 / safe(d[..., :-1]) + w2 / safe(d[..., 1:])), 0.0)
    for k, near, far in ((0, 0, 1), (-1, -1, -2)):
        h0, h1, d0, d1 = h[..., near], h[..., far], d[..., near], d[..., far]
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        out[..., k] = np.where(s * d0 <= 0, 0.0, np.where((d0 * d1 <= 0) & (np.abs(s) > np.abs(3 * d0)), 3 * d0, s))
    return out


SLOPES = {"natural": natural_slopes, "akima": akima_slopes, "monotone": monotone_slopes}


def _interval(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of the last knot but one at or before each place, or 0: by halving steps."""
    top = x.shape[-1] - 2
    k = np.zeros(at.shape, dtype=np.int64)
    step = 1 << max(0, top.bit_length() - 1)
    while step:
        there = np.minimum(k + step, top)
        k = np.where((k + step <= top) & (np.take_along_axis(x, there, axis=-1) <= at), there, k)
        step >>= 1
    return k


def evaluate(x: np.ndarray, y: np.ndarray, slopes: np.ndarray, at: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Piecewise cubic with given knot slopes, or its derivative up to the third; continued outside."""
    k = _interval(x, at)
    here = lambda v, j: np.take_along_axis(v, k + j, axis=-1)
    x0, y0, s0, s1 = here(x, 0), here(y, 0), here(slopes, 0), here(slopes, 1)
    h = here(x, 1) - x0
    t, d = at - x0, (here(y, 1) - y0) / h
    c2, c3 = (3 * d - 2 * s0 - s1) / h, (s0 + s1 - 2 * d) / (h * h)
    if derivative == 0:
        return y0 + t * (s0 + t * (c2 + t * c3))
    return [s0 + t * (2 * c2 + 3 * t * c3), 2 * c2 + 6 * t * c3, 6 * c3][derivative - 1]


def spline(xin, yin, at, kind: str = "natural", derivative: int = 0):
    """Column: the curve through (xin, yin) at the places ``at``; one knot is a constant, two a line. Arrays of double."""

    def curves(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        if x.shape[1] == 1:
            return np.repeat(y if derivative == 0 else 0 * y, p.shape[1], axis=1)
        slopes = np.repeat(np.diff(y) / np.diff(x), 2, axis=1) if x.shape[1] == 2 else SLOPES[kind](x, y)
        return evaluate(x, y, slopes, p, derivative)

    @F.arrow_udf("array<double>")
    def run(xs: pa.Array, ys: pa.Array, places: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return _by_lengths(curves, xs, ys, places)

    return run(xin, yin, at)


def levinson(r: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solution of the symmetric Toeplitz system with first row r, in n * n steps."""
    f, a = g[..., :1] / r[..., :1], np.ones_like(r[..., :1])
    v, none = r[..., :1], np.zeros_like(r[..., :1])
    for j in range(1, g.shape[-1]):
        back = r[..., j:0:-1]
        c = -(a * back).sum(axis=-1, keepdims=True) / v
        a = np.concatenate((a, none), axis=-1)
        a = a + c * a[..., ::-1]
        v = v * (1 - c * c)
        e = (g[..., j : j + 1] - (f * back).sum(axis=-1, keepdims=True)) / v
        f = np.concatenate((f, none), axis=-1) + e * a[..., ::-1]
    return f


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Solution with lower, main and upper diagonals a, b, c (a[0] and c[-1] unused)."""
    n = b.shape[-1]
    cp, dp = np.zeros(b.shape), np.zeros(b.shape)
    cp[..., 0], dp[..., 0] = c[..., 0] / b[..., 0], r[..., 0] / b[..., 0]
    for i in range(1, n):
        m = b[..., i] - a[..., i] * cp[..., i - 1]
        cp[..., i], dp[..., i] = c[..., i] / m, (r[..., i] - a[..., i] * dp[..., i - 1]) / m
    for i in range(n - 2, -1, -1):
        dp[..., i] -= cp[..., i] * dp[..., i + 1]
    return dp


def vandermonde(v: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with sum over j of x[j] * v[j] ** i = b[i]."""
    powers = v[..., None, :] ** np.arange(v.shape[-1])[:, None]
    return np.linalg.solve(powers, b[..., None])[..., 0]


def toeplitz_solve(r, g):
    @F.arrow_udf("array<double>")
    def run(r: pa.Array, g: pa.Array) -> pa.Array:
        return _by_lengths(levinson, r, g)

    return run(r, g)


def tridiagonal_solve(a, b, c, r):
    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, r: pa.Array) -> pa.Array:
        return _by_lengths(tridiagonal, a, b, c, r)

    return run(a, b, c, r)


def vandermonde_solve(v, b):
    @F.arrow_udf("array<double>")
    def run(v: pa.Array, b: pa.Array) -> pa.Array:
        return _by_lengths(vandermonde, v, b, square=True)

    return run(v, b)
