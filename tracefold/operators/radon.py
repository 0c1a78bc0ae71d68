r"""Tau-p transforms of panels of any size: least-squares Radon, and slant stacks with their inverses.

A panel's traces lie at positions g (a function of the offset, see
``geometry.offset_function``); a model trace of slope p holds what lies on t = tau + p g.
With numpy's sign of the Fourier transform, at angular frequency w:

    forward (adjoint)   u(p) = sum over traces of d(g) e^{iwpg}
    inverse (modelling) d(g) = sum over slopes of u(p) e^{-iwpg}

*Going to slopes* is a sum over traces. Every Arrow batch sums its own traces by
panel, (frequency, slope) rows are added up in Spark with map-side sums, and only
that model, whose size the parameters bound, is gathered by panel. *Coming back*,
each trace needs its panel's whole model: traces are dealt to blocks of about
``BLOCK`` by panel, and the model goes to each block once. So no task holds a panel.

Least squares: with n traces and m slopes the normal equations of the modelling
(1/m) sum u e^{-iwpg} have the matrix R[a, b] = 1/(nm) sum e^{iw(p_a - p_b)g}. For
evenly spaced slopes it is Hermitian and Toeplitz, whatever the positions, so its
first row is summed over the traces like the right-hand side, and all frequencies of
a panel are solved together by Levinson's recursion.

Defined results: traces with a null position or null samples add nothing to a model,
and come back null; shorter traces are padded with zeros and longer ones cut at nt;
panels without a usable trace give no model; a null panel is a panel; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.kernels import real_fft_length

BLOCK = 4096


def frequencies(nt: int, dt: float) -> tuple[int, np.ndarray]:
    """(transform length, angular frequencies) for nt samples."""
    n = real_fft_length(nt)
    return n, 2 * np.pi * np.fft.rfftfreq(n, dt)


def frequency_weights(nt: int, dt: float, f1: float | None, f2: float | None) -> np.ndarray:
    """1 up to f1, falling linearly to 0 at f2; all 1 without them."""
    n, w = frequencies(nt, dt)
    if f1 is None or f2 is None:
        return np.ones(len(w))
    return np.clip((f2 - w / (2 * np.pi)) / (f2 - f1), 0, 1)


def solve_toeplitz(row: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many Hermitian Toeplitz systems at once by Levinson's recursion; row (systems, n) is each matrix's first row.

    A system whose leading minors aren't positive gets zeros.
    """
    n = row.shape[1]
    column = np.conj(row)
    with np.errstate(all="ignore"):
        f = np.zeros_like(column)  # solves the leading system for (1, 0, ..., 0); reversed and conjugated, for (0, ..., 0, 1)
        x = np.zeros_like(column)
        f[:, 0] = 1 / row[:, 0].real
        x[:, 0] = b[:, 0] * f[:, 0]
        for k in range(1, n):
            last = column[:, k:0:-1]  # the new row's entries over the old unknowns
            miss = np.einsum("sj,sj->s", last, f[:, :k])
            g = np.conj(f[:, :k][:, ::-1])
            grown = np.zeros((len(row), k + 1), dtype=complex)
            grown[:, :k] = f[:, :k]
            grown[:, 1:] -= miss[:, None] * g
            f[:, : k + 1] = grown / (1 - np.abs(miss) ** 2)[:, None]
            rest = b[:, k] - np.einsum("sj,sj->s", last, x[:, :k])
            x[:, : k + 1] += rest[:, None] * np.conj(f[:, : k + 1][:, ::-1])
    return np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0)


def _matrix(data: pd.Series, nt: int) -> np.ndarray:
    out = np.zeros((len(data), nt))
    for k, d in enumerate(data):
        d = np.asarray(d, dtype=np.float64)[:nt]
        out[k, : len(d)] = d
    return out


def _sums(traces: DataFrame, panel: list[str], position: Column, nt: int, dt: float, slopes: np.ndarray, matrix: bool) -> DataFrame:
    """Panel, j (frequency), k (slope), n (traces), and the sums ur, ui of d e^{iwpg} and rr, ri of e^{-iw k dp g}."""
    rows = traces.select(*panel, position.cast("double").alias("g_"), "data").where("g_ is not null and data is not null")
    length, w = frequencies(nt, dt)
    step = slopes[1] - slopes[0] if len(slopes) > 1 else 0.0
    names = ("ur", "ui", "rr", "ri")
    kind = T.StructType([*(rows.schema[c] for c in panel), T.StructField("j", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(panel, dropna=False, sort=False):
                u = np.zeros((len(w), len(slopes)), dtype=complex)
                r = np.zeros_like(u)
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    g = some["g_"].to_numpy()
                    d = np.fft.rfft(_matrix(some["data"], nt), length, axis=1)
                    for k, p in enumerate(slopes):
                        u[:, k] += np.einsum("xw,xw->w", d, np.exp(1j * np.outer(g * p, w)))
                        if matrix:
                            r[:, k] += np.exp(-1j * np.outer(g * (k * step), w)).sum(axis=0)
                head = part[panel].iloc[[0] * u.size].reset_index(drop=True)
                j, k = (x.ravel() for x in np.indices(u.shape))
                yield head.assign(j=j.astype(np.int32), k=k.astype(np.int32), n=len(part), ur=u.real.ravel(), ui=u.imag.ravel(), rr=r.real.ravel(), ri=r.imag.ravel())

    return rows.mapInPandas(run, kind).groupBy(*panel, "j", "k").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def _models(sums: DataFrame, panel: list[str], nt: int, dt: float, slopes: np.ndarray, solve: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Panel, ip, p, data: the model traces; solve(u, r, n) gives the spectra (frequency, slope)."""
    length, w = frequencies(nt, dt)
    kind = T.StructType([*(sums.schema[c] for c in panel), T.StructField("ip", T.IntegerType()), T.StructField("p", T.DoubleType()), T.StructField("data", T.ArrayType(T.DoubleType()))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        u, r = np.zeros((len(w), len(slopes)), dtype=complex), np.zeros((len(w), len(slopes)), dtype=complex)
        j, k = rows["j"].to_numpy(), rows["k"].to_numpy()
        u[j, k] = rows["ur"].to_numpy() + 1j * rows["ui"].to_numpy()
        r[j, k] = rows["rr"].to_numpy() + 1j * rows["ri"].to_numpy()
        out = np.fft.irfft(solve(u, r, int(rows["n"].iloc[0])), length, axis=0)[:nt].T
        head = rows[panel].iloc[[0] * len(slopes)].reset_index(drop=True)
        return head.assign(ip=np.arange(len(slopes), dtype=np.int32), p=slopes, data=list(out))

    return sums.groupBy(*panel).applyInPandas(run, kind)


def even_slopes(first: float, step: float, count: int) -> np.ndarray:
    return first + step * np.arange(count)


def radon(traces: DataFrame, panel: list[str], position: Column, nt: int, dt: float, first: float, step: float, count: int, prewhite: float = 0.01, f1: float | None = None, f2: float | None = None) -> DataFrame:
    """Least-squares tau-p model of each panel: panel, ip, p, data.

    ``position`` is g of a trace (offset squared for the parabolic transform); ``prewhite`` adds to the
    diagonal in parts of it; f1 and f2 taper high frequencies off.
    """
    slopes = even_slopes(first, step, count)
    weight = frequency_weights(nt, dt, f1, f2)

    def solve(u: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
        r = r / (n * count)
        r[:, 0] *= 1 + prewhite
        return solve_toeplitz(r, u * weight[:, None] / n)

    return _models(_sums(traces, panel, position, nt, dt, slopes, True), panel, nt, dt, slopes, solve)


def slant_stack(traces: DataFrame, panel: list[str], position: Column, nt: int, dt: float, first: float, step: float, count: int, dx: float = 1.0) -> DataFrame:
    """Slant stack in the F-K domain: the panel's transform over position read at the wavenumbers k = p f, times dx.

    The transform is evaluated at these wavenumbers themselves rather than interpolated from a
    regular grid of them, so positions needn't be evenly spaced and nothing wraps around in k.
    """
    slopes = even_slopes(first, step, count)
    return _models(_sums(traces, panel, position, nt, dt, slopes, False), panel, nt, dt, slopes, lambda u, r, n: u * dx)


def dealt(traces: DataFrame, panel: list[str], rows: int = BLOCK) -> DataFrame:
    """Traces with ``block_``: panels of more than ``rows`` traces are dealt by the hash of seq to as many blocks as they need."""
    large = traces.groupBy(*panel).count().where(F.col("count") > rows).withColumn("blocks_", F.ceil(F.col("count") / rows)).drop("count")
    large = large.withColumnsRenamed({c: f"{c}_large_" for c in panel})
    met = traces.join(large, [traces[c].eqNullSafe(large[f"{c}_large_"]) for c in panel], "left").drop(*(f"{c}_large_" for c in panel))
    return met.withColumn("block_", F.coalesce(F.pmod(F.xxhash64("seq"), F.col("blocks_")), F.lit(0)).cast("int")).drop("blocks_")


def spread(traces: DataFrame, model: DataFrame, panel: list[str], position: Column, nt: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Replace each trace's samples by its row of f(model (slope, time), slopes, positions); panels without a model become null."""
    rows = dealt(traces.withColumn("g_", position.cast("double")), panel)
    blocks = rows.select(*panel, "block_").distinct()
    renamed = model.withColumnsRenamed({c: f"{c}_model_" for c in panel})
    sent = blocks.join(renamed, [blocks[c].eqNullSafe(renamed[f"{c}_model_"]) for c in panel]).select(*[F.col(c).alias(f"{c}_sent_") for c in (*panel, "block_")], "ip", "p", F.col("data").alias("model_"))
    columns = traces.columns
    number = np.float64 if traces.schema["data"].dataType.elementType == T.DoubleType() else np.float32

    def run(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(part)
        ready = np.flatnonzero(part["g_"].notna().to_numpy())
        if len(own) and len(ready):
            own = own.sort_values("ip")
            new = f(_matrix(own["model_"], nt), own["p"].to_numpy(), part["g_"].to_numpy()[ready])
            for k, v in zip(ready, new):
                out[k] = v.astype(number)
        return part.assign(data=pd.Series(out, index=part.index, dtype=object))[columns]

    return rows.groupBy(*panel, "block_").cogroup(sent.groupBy(*[f"{c}_sent_" for c in (*panel, "block_")])).applyInPandas(run, traces.schema)


def _modelled(nt: int, dt: float, weight: np.ndarray) -> Callable:
    length, w = frequencies(nt, dt)

    def run(model: np.ndarray, slopes: np.ndarray, g: np.ndarray) -> np.ndarray:
        u = np.fft.rfft(model, length, axis=1) * weight
        out = np.zeros((len(g), nt))
        for at in range(0, len(g), 256):
            some = g[at : at + 256]
            d = sum(u[k] * np.exp(-1j * np.outer(some * p, w)) for k, p in enumerate(slopes))
            out[at : at + 256] = np.fft.irfft(d, length, axis=1)[:, :nt]
        return out

    return run


def inverse_radon(traces: DataFrame, model: DataFrame, panel: list[str], position: Column, nt: int, dt: float, count: int, f1: float | None = None, f2: float | None = None) -> DataFrame:
    """Traces modelled from their panel's model at their own positions: (1/count) sum over slopes."""
    return spread(traces, model, panel, position, nt, _modelled(nt, dt, frequency_weights(nt, dt, f1, f2) / count))


def inverse_slant_stack(traces: DataFrame, model: DataFrame, panel: list[str], position: Column, nt: int, dt: float, step: float) -> DataFrame:
    """Inverse of :func:`slant_stack`: going from slopes to wavenumbers, dk = f dp, so frequencies are weighted by f and summed over slopes."""
    _, w = frequencies(nt, dt)
    return spread(traces, model, panel, position, nt, _modelled(nt, dt, w / (2 * np.pi) * abs(step)))


def rho_filter(points: int, nt: int, dt: float) -> np.ndarray:
    """Symmetric time filter with the amplitude |f|, 1 in its middle; ``points`` is odd."""
    if points % 2 == 0 or points // 2 > nt:
        raise ValueError("an odd number of points, half of them at most the trace's length")
    n = real_fft_length(nt)
    half = np.fft.irfft(np.fft.rfftfreq(n, dt), n)[: points // 2 + 1]
    half = half / half[0]
    return np.concatenate((half[:0:-1], half))


def filtered_back_projection(traces: DataFrame, model: DataFrame, panel: list[str], position: Column, nt: int, dt: float, points: int = 35) -> DataFrame:
    """Inverse slant stack in t-x: model traces through the rho filter, then summed along tau = t - p g with linear interpolation."""
    rho = rho_filter(points, nt, dt)
    half = points // 2

    def run(model: np.ndarray, slopes: np.ndarray, g: np.ndarray) -> np.ndarray:
        filtered = np.stack([np.convolve(m, rho)[half : half + nt] for m in model])
        out = np.zeros((len(g), nt))
        for m, p in zip(filtered, slopes):
            place = np.arange(nt) - (g * p / dt)[:, None]
            at = np.floor(place).astype(np.int64)
            share = place - at
            padded = np.concatenate((m, [0.0]))
            pick = lambda i: np.where((i >= 0) & (i < nt), padded[np.clip(i, 0, nt)], 0.0)
            out += (1 - share) * pick(at) + share * pick(at + 1)
        return out

    return spread(traces, model, panel, position, nt, run)
