"""Batch kernels on [trace, sample] matrices, and how they run over a trace table.

A kernel takes a matrix of traces of equal length and equal sample interval and
gives back a matrix. :func:`apply_kernels` fuses any number of them into one
Arrow pass over the samples, so chained filters cross to Python once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray, float], np.ndarray]


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The samples of each row, in double; null rows are empty."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(column) else np.zeros(0)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    return [values[e - n : e] for e, n in zip(ends, lengths)]


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.float32 if pa.types.is_float32(kind.value_type) else np.float64)))


def apply_kernels(traces: DataFrame, *kernels: Kernel, column: str = "data") -> DataFrame:
    """Run the kernels one after another over ``column``; every other column passes unchanged.

    Rows of a batch are grouped by length and sample interval, so ragged tables
    and mixed intervals are fine. No shuffle.
    """
    has_dt = "d_sample" in traces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rows = rows_of(batch.column(at))
            steps = batch.column("d_sample").to_pylist() if has_dt else [1.0] * len(rows)
            groups: dict[tuple[int, float], list[int]] = {}
            for k, (r, dt) in enumerate(zip(rows, steps, strict=True)):
                groups.setdefault((len(r), dt or 0.0), []).append(k)
            for (n, dt), own in groups.items():
                if n:
                    block = np.stack([rows[k] for k in own])
                    for kernel in kernels:
                        block = kernel(block, dt)
                    for k, r in zip(own, block):
                        rows[k] = r
            out = list_array(rows, batch.schema.field(at).type)
            if batch.column(at).null_count:
                keep = batch.column(at).is_valid().to_pylist()
                out = pa.array([v if ok else None for v, ok in zip(out.to_pylist(), keep)], out.type)
            yield batch.set_column(at, pa.field(column, out.type), out)

    return traces.mapInArrow(run, traces.schema)


# --- Butterworth filters ------------------------------------------------------


def butterworth_design(f_pass: float, a_pass: float, f_stop: float, a_stop: float) -> tuple[int, float]:
    """(poles, -3 dB frequency) of the filter that meets both amplitudes; frequencies in cycles a sample.

    With the bilinear map w = 2 tan(pi f) and |H|^2 = 1 / (1 + (w / w3)^(2 n)) for
    a low-pass (its inverse ratio for a high-pass).
    """
    wp, ws = 2 * math.tan(math.pi * f_pass), 2 * math.tan(math.pi * f_stop)
    dp, ds = 1 / a_pass**2 - 1, 1 / a_stop**2 - 1
    real = abs(math.log(dp / ds) / math.log(wp / ws)) / 2
    poles = 1 + int(real)
    # the -3 dB frequency is that of the real-valued order, at which both amplitudes are met exactly
    w3 = wp * dp ** ((-1 if f_pass < f_stop else 1) / (2 * real))
    return poles, math.atan(w3 / 2) / math.pi


def _sections(poles: int, f3db: float, high: bool) -> list[tuple[float, float, float, float, float]]:
    """(b0, b1, b2, a1, a2) of the first- and second-order sections of the bilinear Butterworth filter."""
    r = 2 * math.tan(math.pi * abs(f3db))
    out = []
    if poles % 2:
        g, a = (2 / (r + 2), (r - 2) / (r + 2)) if high else (r / (r + 2), (r - 2) / (r + 2))
        out.append((g, -g if high else g, 0.0, a, 0.0))
    for k in range(poles // 2):
        theta = math.pi * (2 * k + 1) / (2 * poles)
        d = 4 + 4 * r * math.sin(theta) + r * r
        g = 4 / d if high else r * r / d
        out.append((g, -2 * g if high else 2 * g, g, (2 * r * r - 8) / d, (4 - 4 * r * math.sin(theta) + r * r) / d))
    return out


def _recurse(x: np.ndarray, sections) -> np.ndarray:
    """Cascaded recursive sections along the samples, for all traces at once."""
    y = np.ascontiguousarray(x.T)
    for b0, b1, b2, a1, a2 in sections:
        out = np.empty_like(y)
        x1 = x2 = y1 = y2 = np.zeros(y.shape[1])
        for t in range(len(y)):
            now = b0 * y[t] + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, y[t], y1, now
            out[t] = now
        y = out
    return y.T


def butterworth(poles: int, f3db: float, high: bool, zero_phase: bool = True) -> Kernel:
    """High- or low-pass kernel; zero phase runs it forward, then backward."""
    sections = _sections(poles, f3db, high)

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        y = _recurse(x, sections)
        return _recurse(y[:, ::-1], sections)[:, ::-1] if zero_phase else y

    return run


@lru_cache(maxsize=256)
def _band(dt: float, options: tuple) -> tuple[Kernel, ...]:
    o = dict(options)
    root = math.sqrt if o["zero_phase"] else float
    out = []
    for side, high, stop, pas, f3 in (("low", True, 0.05, 0.075, 0.075), ("high", False, 0.275, 0.2, 0.2)):
        if not o[f"{side}_cut"]:
            continue
        hz = lambda key, default: default if o[key] is None else o[key] * dt
        poles = o[f"n_poles_{side}"]
        if poles:
            f3db = hz(f"f3db_{side}", f3)
        else:
            poles, f3db = butterworth_design(hz(f"f_pass_{side}", pas), root(o[f"a_pass_{side}"]), hz(f"f_stop_{side}", stop), root(o[f"a_stop_{side}"]))
        out.append(butterworth(poles, f3db, high, o["zero_phase"]))
    return tuple(out)


def bandpass_kernel(
    low_cut: bool = True, high_cut: bool = True, f_stop_low: float | None = None, a_stop_low: float = 0.05, f_pass_low: float | None = None, a_pass_low: float = 0.95,
    f_stop_high: float | None = None, a_stop_high: float = 0.05, f_pass_high: float | None = None, a_pass_high: float = 0.95, n_poles_low: int = 0,
    f3db_low: float | None = None, n_poles_high: int = 0, f3db_high: float | None = None, zero_phase: bool = True,
) -> Kernel:
    """Low cut, then high cut. Frequencies in Hz; the design depends on the sample interval only and is kept."""
    options = tuple(sorted(locals().items()))

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        for kernel in _band(dt, options) if dt else ():
            x = kernel(x, dt)
        return x

    return run


def butterworth_bandpass(traces: DataFrame, **options) -> DataFrame:
    return apply_kernels(traces, bandpass_kernel(**options))


# --- transform lengths --------------------------------------------------------


@lru_cache(maxsize=1)
def fft_lengths() -> tuple[int, ...]:
    """All products of mutually prime factors, each one of (1, 2, 4, 8, 16), (1, 3, 9), 5, 7, 11 and 13."""
    out = {a * b * c * d * e * f for a in (1, 2, 4, 8, 16) for b in (1, 3, 9) for c in (1, 5) for d in (1, 7) for e in (1, 11) for f in (1, 13)}
    return tuple(sorted(out))


def fft_length(least: int) -> int:
    """Smallest such length for a complex transform; there is none above 720720."""
    if least > fft_lengths()[-1]:
        raise ValueError(f"no transform length holds {least} samples; the longest is {fft_lengths()[-1]}")
    return fft_lengths()[bisect_left(fft_lengths(), least)]


def real_fft_length(least: int) -> int:
    """Smallest even length for a real transform."""
    return 2 * fft_length((least + 1) // 2)


# --- spectral kernels (forward kernel e^{+iwt}) -------------------------------


def _rfft(x: np.ndarray, n: int) -> np.ndarray:
    return np.conj(np.fft.rfft(x, n, axis=-1))


def _irfft(c: np.ndarray, n: int, nt: int) -> np.ndarray:
    return np.fft.irfft(np.conj(c), n, axis=-1)[..., :nt]


def polygon(f: list[float], amps: list[float], freqs: np.ndarray, power: int = 2) -> np.ndarray:
    """Weights with sin ** power slopes between the corners, constant outside."""
    out = np.full(len(freqs), float(amps[0]))
    for f0, f1, a0, a1 in zip(f, f[1:], amps, amps[1:]):
        s = np.sin(0.5 * np.pi * np.clip((freqs - f0) / (f1 - f0), 0, 1)) ** power
        if a1 < a0:
            s = 1 - np.sin(0.5 * np.pi * np.clip((f1 - freqs) / (f1 - f0), 0, 1)) ** power
        out = np.where((freqs >= f0) & (freqs <= f1), a0 + (a1 - a0) * s, out)
    return np.where(freqs > f[-1], float(amps[-1]), out)


def frequency_filter(f: list[float] | None = None, amps: list[float] | None = None) -> Kernel:
    """Zero-phase filter of polygonal shape; by default 0.10, 0.15, 0.45 and 0.50 of 1 / dt, amplitudes 0, 1, 1, 0."""
    if f is not None and (any(b <= a for a, b in zip(f, f[1:])) or min(f) < 0):
        raise ValueError("frequencies must rise")
    if amps is not None and (min(amps) < 0 or not any(amps)):
        raise ValueError("amplitudes must be non-negative and not all 0")
    if f is not None and amps is not None and len(f) != len(amps):
        raise ValueError("as many amplitudes as frequencies")

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        dt = dt or 0.004
        corners = f or [c * 0.5 / dt for c in (0.10, 0.15, 0.45, 0.50)]
        heights = amps or [0.0, *[1.0] * (len(corners) - 2), 0.0]
        n = real_fft_length(x.shape[1])
        return _irfft(_rfft(x, n) * polygon(corners, heights, np.fft.rfftfreq(n, dt)), n, x.shape[1])

    return run


def time_varying_bandpass(times: list[float], corners: list[list[float]]) -> Kernel:
    """Four-corner band-pass for each gate time, cross-faded linearly between the gates and constant outside."""
    if len(times) != len(corners) or any(len(c) != 4 for c in corners) or any(b <= a for a, b in zip(times, times[1:])):
        raise ValueError("a rising time and four corners for each gate")

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        t = np.arange(x.shape[1]) * dt
        out = np.zeros_like(x)
        for k, c in enumerate(corners):
            knots = np.zeros(len(times))
            knots[k] = 1
            out += np.interp(t, times, knots) * frequency_filter(list(c), [0, 1, 1, 0])(x, dt)
        return out

    return run


def fractional(power: float = 0.0, sign: int = -1, phase_factor: float = 0.0) -> Kernel:
    """Fractional derivative or integral: (sign i w) ** power with an added phase in fractions of pi."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        n = real_fft_length(x.shape[1])
        w = 2 * np.pi * np.fft.rfftfreq(n, dt or 1.0)
        with np.errstate(divide="ignore"):
            amp = np.where(w > 0, w**power, 0.0 if power else 1.0) if power < 0 else w**power
        c = amp * np.exp(1j * (sign * np.pi / 2 * power + phase_factor * np.pi))
        return _irfft(_rfft(x, n) * c, n, x.shape[1])

    return run


def phase_change(a: float = 0.0, b: float = 180 / np.pi, c: float = 0.0) -> Kernel:
    """New phase a + b * phase + c * frequency (degrees), same amplitudes."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        n = real_fft_length(x.shape[1])
        s = _rfft(x, n)
        f = np.fft.rfftfreq(n, dt or 1.0)
        phase = np.deg2rad(a + b * np.angle(s) + c * f)
        return _irfft(np.abs(s) * np.exp(1j * phase), n, x.shape[1])

    return run


def minimum_phase(noise: float = 1e-9) -> Kernel:
    """Minimum-phase trace with the same amplitude spectrum, by folding the cepstrum."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        nt = x.shape[1]
        n = fft_length(2 * nt)
        n += n % 2
        amp = np.abs(np.fft.fft(x, n, axis=1))
        top = amp.max(axis=1, keepdims=True)
        cep = np.fft.ifft(np.log(amp + noise * np.where(top > 0, top, 1.0)), axis=1).real
        fold = np.zeros(n)
        fold[0] = fold[n // 2] = 1
        fold[1 : n // 2] = 2
        out = np.fft.ifft(np.exp(np.fft.fft(cep * fold, axis=1)), axis=1).real[:, :nt]
        return np.where(top > 0, out, 0.0)

    return run


def gaussian_smooth(half_width: int) -> Kernel:
    """Gaussian mean over samples; the weight is one half at ``half_width`` / 2 samples; renormalised at the ends.

    Weights under 1e-40 are left out, so a trace of n samples takes n times the width, not n * n.
    """
    width = max(1, half_width)
    reach = math.ceil(width * 6)
    weights = np.exp(-np.log(2) * (2 * np.arange(-reach, reach + 1) / width) ** 2)

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        return _banded(x, weights, reach) / _banded(np.ones((1, x.shape[1])), weights, reach)

    return run


def _banded(x: np.ndarray, weights: np.ndarray, before: int) -> np.ndarray:
    """Sums over neighbours: weights[j] is that of the sample j - before places on; outside are zeros."""
    n = x.shape[1]
    out = np.zeros(x.shape)
    for j, w in enumerate(weights):
        k = j - before
        if abs(k) < n:
            out[:, max(0, -k) : n - max(0, k)] += w * x[:, max(0, k) : n - max(0, -k)]
    return out


def savitzky_golay_weights(left: int, right: int, derivative: int = 0, degree: int = 2) -> np.ndarray:
    """Weights of left + 1 + right samples that give the local polynomial fit, or its derivative, at the middle one."""
    k = np.arange(-left, right + 1)
    return np.linalg.pinv(np.vander(k, degree + 1, increasing=True))[derivative] * math.factorial(derivative)


def savitzky_golay(left: int, right: int, derivative: int = 0, degree: int = 2) -> Kernel:
    """Local polynomial fit over left + 1 + right samples; the ends use the samples there are."""
    weights = savitzky_golay_weights(left, right, derivative, degree)

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        pad = np.pad(x, ((0, 0), (left, right)), mode="edge")
        return sum(w * pad[:, j : j + x.shape[1]] for j, w in enumerate(weights)) / ((dt or 1.0) ** derivative)

    return run


def resample(n_out: int, dt_out: float, taps: int = 8) -> Kernel:
    """Band-limited resampling to a new interval by tapered sinc interpolation."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        place = np.arange(n_out) * dt_out / dt
        first = np.floor(place).astype(np.int64) - taps // 2
        out = np.zeros((len(x), n_out))
        for j in range(taps + 2):
            at = first + j
            d = place - at
            inside = (np.abs(d) < taps / 2) & (at >= 0) & (at < x.shape[1])
            out[:, inside] += x[:, at[inside]] * (np.sinc(d) * np.cos(np.pi * d / taps) ** 2)[inside]
        return out

    return run


def time_shift(seconds: float, taps: int = 8) -> Kernel:
    """Fractional time shift by tapered sinc interpolation; zero comes in."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        places = seconds / dt
        k = np.arange(math.ceil(-places - taps / 2), math.floor(-places + taps / 2) + 1)
        d = -places - k
        return _banded(x, np.where(np.abs(d) < taps / 2, np.sinc(d) * np.cos(np.pi * d / taps) ** 2, 0.0), -int(k[0]))

    return run


def hartley() -> Kernel:
    """Discrete Hartley transform (cosine plus sine sums), unscaled."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        c = np.fft.fft(x, axis=1)
        return c.real - c.imag

    return run


def unwrap_phase() -> Kernel:
    """Continuous phase of the real transform's half spectrum, padded with its last value to the trace's length."""

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        p = np.unwrap(np.angle(_rfft(x, x.shape[1])), axis=1)
        return np.pad(p, ((0, 0), (0, x.shape[1] - p.shape[1])), mode="edge")

    return run


def antialias(fraction: float, minimum: bool = False) -> Kernel:
    """Low-pass before keeping every 1 / fraction-th sample; a copy if fraction is 1 or more."""
    if fraction >= 1:
        return lambda x, dt: x
    poles, f3db = butterworth_design(0.6 * 0.5 * fraction, 0.99 if minimum else math.sqrt(0.99), 0.5 * fraction, 0.01 if minimum else 0.1)
    if minimum:
        return butterworth(poles, f3db, False, zero_phase=False)
    return lambda x, dt: butterworth(poles, f3db, False)(np.pad(x, ((0, 0), (0, 100))), dt)[:, : x.shape[1]]
