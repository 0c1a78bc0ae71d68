"""Operators across traces: mixing, medians, stacks, gathers and panels.

Aggregations run on exploded samples or directly on arrays, keyed by a panel or
gather, so they spread over keys; windows along a panel run in blocks of it (see
``blocks``). Panel filters transform each trace
by itself and then work by (panel, frequency), so no task holds a panel, and a
panel may have any number of traces; ``seq`` tells a panel's traces apart.
``panel_map`` is for small panels: it gathers a panel in one task, and
``max_traces`` refuses one that wouldn't fit there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions import stacks
from tracefold.functions.arrays import let
from tracefold.operators import blocks
from tracefold.operators.kernels import _irfft, _rfft, polygon, real_fft_length

MIX_WEIGHTS = (0.6, 1.0, 1.0, 1.0, 0.6)
MAX_TRACES = 200_000


def samples(traces: DataFrame, *keep: str) -> DataFrame:
    """One row a sample: the kept columns, seq, it (index) and v (double)."""
    return traces.select(*keep, "seq", F.posexplode("data").alias("it", "v")).withColumn("v", F.col("v").cast("double"))


def from_samples(rows: DataFrame, *keys: str) -> DataFrame:
    """Samples back to arrays, in the order of their index."""
    sorted_ = F.array_sort(F.collect_list(F.struct("it", "v")))
    return rows.groupBy(*keys).agg(F.transform(sorted_, lambda s: s["v"]).alias("data"))


def _beside(traces: DataFrame, panel: list[str], width: int) -> tuple[DataFrame, Column]:
    """Traces in blocks with margins, and the arrays of the ``width`` traces around each, the panel's ends mirrored."""
    half = width // 2
    df, w = blocks.with_margins(traces, panel, before=half, after=half), blocks.window(panel)
    arrays = []
    for k in range(-half, half + 1):
        there, mirrored = F.lead("data", k).over(w), F.lead("data", -k).over(w)
        arrays.append(F.coalesce(there, mirrored, F.col("data")) if k else F.col("data"))
    return df, F.array(*arrays)


def mix(traces: DataFrame, panel: list[str], weights: tuple[float, ...] = MIX_WEIGHTS) -> DataFrame:
    """Weighted mean of neighbouring traces, divided by their number; the panel's ends are mirrored."""
    df, near = _beside(traces, panel, len(weights))
    value = lambda n, i: sum((F.get(F.get(n, F.lit(k)), i).cast("double") * w for k, w in enumerate(weights)), F.lit(0.0)) / len(weights)
    kind = df.schema["data"].dataType.elementType
    return blocks.without_margins(df.withColumn("near_", near)).withColumn("data", let("near_", lambda n: F.transform("data", lambda v, i: value(n, i).cast(kind)))).drop("near_")


def median(traces: DataFrame, panel: list[str], width: int = 5) -> DataFrame:
    """Median over neighbouring traces at each sample; the panel's ends are mirrored."""
    df, near = _beside(traces, panel, width)
    middle = lambda n, i: F.element_at(F.sort_array(F.transform(n, lambda a: F.get(a, i))), width // 2 + 1)
    return blocks.without_margins(df.withColumn("near_", near)).withColumn("data", let("near_", lambda n: F.transform("data", lambda v, i: middle(n, i)))).drop("near_")


def moveout_median(traces: DataFrame, panel: list[str], key: str, xs: list[float], ts: list[float], width: int = 5, sign: int = -1, subtract: bool = True, use_mix: bool = False) -> DataFrame:
    """Shift along a moveout curve, smooth across traces, shift back, and subtract (or keep) the result."""
    from tracefold.functions.arrays import interpolate

    shift = F.round(F.lit(float(sign)) * (interpolate(F.lit([float(x) for x in xs]), F.lit([float(t) for t in ts]), F.col(key)) - min(ts)) / F.col("d_sample")).cast("int")
    moved = lambda k: let("data", lambda d: F.transform(d, lambda v, i: F.coalesce(F.when(i - k >= 0, F.get(d, i - k)), F.lit(0.0)).cast("float")))
    df = traces.withColumn("shift_", shift).withColumn("before_", F.col("data")).withColumn("data", moved(F.col("shift_")))
    df = mix(df, panel) if use_mix else median(df, panel, width)
    df = df.withColumn("data", moved(-F.col("shift_")))
    if subtract:
        df = df.withColumn("data", F.zip_with("before_", "data", lambda a, b: a - b))
    return df.drop("shift_", "before_")


def runs(df: DataFrame, line: list[str], order: str, key: str, name: str = "run") -> DataFrame:
    """Numbers of consecutive rows with an equal key, from 1 within each line."""
    w = blocks.window(line, order)
    beside = blocks.with_margins(df, line, order, before=1, after=0)
    change = (~F.col(key).eqNullSafe(F.lag(key).over(w))) | (F.row_number().over(w) == 1)
    return blocks.totals_before(blocks.without_margins(beside.withColumn("change_", change.cast("int"))), line, "change_", name, order).drop("change_")


def segments_at_gaps(df: DataFrame, line: list[str], index: str, gap: float, name: str = "segment") -> DataFrame:
    """Numbers of stretches that a jump of more than ``gap`` in the index parts, from 1."""
    w = blocks.window(line, index)
    beside = blocks.with_margins(df, line, index, before=1, after=0)
    jump = F.coalesce((F.col(index) - F.lag(index).over(w) > gap).cast("int"), F.lit(0))
    return blocks.totals_before(blocks.without_margins(beside.withColumn("jump_", jump)), line, "jump_", name, index).withColumn(name, F.col(name) + 1).drop("jump_")


def stack(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Mean trace of each gather, with its fold; two aggregations with map-side sums."""
    summed = samples(traces, *keys).groupBy(*keys, "it").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("fold"))
    return summed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("it", "v"))), lambda s: s["v"].cast("float")).alias("data"), F.max("fold").alias("fold"))


def alpha_trimmed_stack(traces: DataFrame, keys: list[str], percent: float = 15.0) -> DataFrame:
    """Mean of each gather's sample after dropping ``percent`` of the values at each end."""
    ordered = Window.partitionBy(*keys, "it").orderBy("v", "seq")
    whole = Window.partitionBy(*keys, "it")
    rows = samples(traces, *keys).withColumn("rank_", F.row_number().over(ordered)).withColumn("n_", F.count(F.lit(1)).over(whole))
    drop = F.floor(F.col("n_") * (percent / 100) + 0.5)
    kept = rows.where((F.col("rank_") > drop) & (F.col("rank_") <= F.col("n_") - drop))
    return from_samples(kept.groupBy(*keys, "it").agg(F.avg("v").alias("v")), *keys)


def slant_stack(traces: DataFrame, panel: list[str], offset: str, slopes: list[float], nt: int, dt: float) -> DataFrame:
    """Linear tau-p transform in t-x: for each slope, samples summed along t = tau + p * x, linearly interpolated.

    Samples meet the slopes (a fixed list) and are summed by (panel, slope, tau) with map-side aggregation.
    """
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("ip"), F.lit(float(s)).alias("p")) for k, s in enumerate(slopes)])).alias("s")
    rows = samples(traces, *panel, offset).select(*panel, offset, "it", "v", p)
    tau = F.col("it") - F.col("s.p") * F.col(offset) / dt
    whole = F.floor(tau).cast("int")
    parts = F.explode(F.array(F.struct(whole.alias("it"), ((1 - (tau - whole)) * F.col("v")).alias("v")), F.struct((whole + 1).alias("it"), ((tau - whole) * F.col("v")).alias("v")))).alias("x")
    summed = rows.select(*panel, F.col("s.ip").alias("ip"), F.col("s.p").alias("p"), parts).select(*panel, "ip", "p", "x.it", "x.v").where((F.col("it") >= 0) & (F.col("it") < nt))
    return summed.groupBy(*panel, "ip", "p", "it").agg(F.sum("v").alias("v"))


def adjacent_coherence(traces: DataFrame, panel: list[str]) -> DataFrame:
    """Normalised zero-lag correlation with the next trace of the panel; null for the last."""
    from tracefold.functions.arrays import dot

    beside = blocks.with_margins(traces, panel, before=0, after=1)
    df = blocks.without_margins(beside.withColumn("next_", F.lead("data").over(blocks.window(panel))))
    return df.withColumn("coherence", dot("data", "next_") / F.sqrt(dot("data", "data") * dot("next_", "next_"))).drop("next_")


# --- panels -------------------------------------------------------------------


def panel_map(traces: DataFrame, panel: list[str], f: Callable[[np.ndarray, pd.DataFrame], np.ndarray], max_traces: int = MAX_TRACES) -> DataFrame:
    """Apply f(matrix [trace, sample], headers) to each panel, traces in the order of ``seq``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > max_traces:
            raise ValueError(f"a panel of {len(rows)} traces; raise max_traces or cut the panel")
        rows = rows.sort_values("seq", kind="stable")
        block = np.stack([np.asarray(d, dtype=np.float64) for d in rows["data"]])
        out = f(block, rows)
        rows = rows.copy()
        rows["data"] = [np.asarray(r, dtype=np.float32) for r in out]
        return rows

    return traces.groupBy(*panel).applyInPandas(run, traces.schema)


# --- panels of any size ---------------------------------------------------------


def _spectra(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row a frequency of each trace: keys, seq, nt (samples), j, re, im."""
    rows = traces.select(*keys, "seq", "data")
    numbers = [T.StructField("nt", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]
    schema = T.StructType([*(rows.schema[k] for k in (*keys, "seq")), *numbers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stacks.in_slices(batches):
            data = batch.column("data")
            sizes = stacks.lengths(data)
            if (sizes < 0).any():
                raise ValueError("a null trace has no spectrum")
            for nt in np.unique(sizes):
                own = np.flatnonzero(sizes == nt)
                c = _rfft(stacks.stack(data, own, nt), real_fft_length(int(nt)))
                row, j = np.repeat(own, c.shape[1]), np.tile(np.arange(c.shape[1], dtype=np.int32), len(own))
                found = {"nt": np.full(len(row), nt, dtype=np.int32), "j": j, "re": c.real.ravel(), "im": c.imag.ravel()}
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in (*keys, "seq")), *map(pa.array, found.values())], names=[*keys, "seq", *found])

    return rows.mapInArrow(run, schema)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys that may be null; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"{k}_right_" for k in keys})
    on = [left[k].eqNullSafe(right[f"{k}_right_"]) for k in keys]
    return left.join(right, on).drop(*(f"{k}_right_" for k in keys))


def _arrays(spectra: DataFrame, *keys: str) -> DataFrame:
    """Rows of frequencies back to samples: keys, filtered_."""
    whole = spectra.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "re", "im"))).alias("s"), F.max("nt").alias("nt"))
    whole = whole.select(*keys, F.col("s.re").alias("re"), F.col("s.im").alias("im"), "nt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stacks.in_slices(batches):
            sizes = np.stack((stacks.lengths(batch.column("re")), batch.column("nt").to_numpy()), axis=1)
            found = []
            for n, nt in np.unique(sizes, axis=0):
                own = np.flatnonzero((sizes == (n, nt)).all(axis=1))
                c = stacks.stack(batch.column("re"), own, n) + 1j * stacks.stack(batch.column("im"), own, n)
                found.append((own, _irfft(c, real_fft_length(int(nt)), int(nt))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), stacks.lists(len(batch), found)], names=[*keys, "filtered_"])

    # a map of batches, since a function of columns is worked out twice where an explode follows
    return whole.mapInArrow(run, T.StructType([*(whole.schema[k] for k in keys), T.StructField("filtered_", T.ArrayType(T.DoubleType()))]))


def along_traces(traces: DataFrame, panel: list[str], f: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Apply f(values of all traces in order of seq, frequency number, samples) at each frequency of each panel."""
    spectra = _spectra(traces, panel)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        if rows["nt"].nunique() > 1:
            raise ValueError("a panel's traces must have one length")
        out = f(rows["re"].to_numpy() + 1j * rows["im"].to_numpy(), int(rows["j"].iloc[0]), int(rows["nt"].iloc[0]))
        return rows.assign(re=out.real, im=out.imag)

    new = _arrays(spectra.groupBy(*panel, "j").applyInPandas(run, spectra.schema), *panel, "seq")
    return _joined(traces, new, [*panel, "seq"]).withColumn("data", F.col("filtered_").cast(traces.schema["data"].dataType)).drop("filtered_")


def wavenumber_filter(traces: DataFrame, panel: list[str], weight: Callable[[int, int, int], np.ndarray]) -> DataFrame:
    """Multiply by weight(j, n1, n2) over the n2 wavenumbers across traces, at frequency j of a transform of length n1."""

    def run(c: np.ndarray, j: int, nt: int) -> np.ndarray:
        n2 = real_fft_length(len(c))
        return np.fft.ifft(np.fft.fft(c, n2) * weight(j, real_fft_length(nt), n2))[: len(c)]

    return along_traces(traces, panel, run)


def filter_dips(traces: DataFrame, panel: list[str], slopes: list[float], amps: list[float], dt: float, dx: float, bias: float = 0.0) -> DataFrame:
    """F-K weights by piecewise linear interpolation of k / w + bias, constant outside."""
    if any(b <= a for a, b in zip(slopes, slopes[1:])) or len(slopes) != len(amps):
        raise ValueError("rising slopes with an amplitude each")
    step = lambda n1: 2 * np.pi / (n1 * dt)
    return wavenumber_filter(traces, panel, lambda j, n1, n2: np.interp(2 * np.pi * np.fft.fftfreq(n2, dx) / (step(n1) * (j + 1e-6)) + bias, slopes, amps))


def filter_radial(traces: DataFrame, panel: list[str], k: list[float], amps: list[float], d1: float = 1.0, d2: float = 1.0) -> DataFrame:
    """Polygonal filter (sine slopes) of the radial wavenumber of a depth panel, with unit gain where the amplitude is 1."""
    return wavenumber_filter(traces, panel, lambda j, n1, n2: polygon(k, amps, np.hypot(np.fft.fftfreq(n2, d2), j / (n1 * d1)), 1))


def filter_separable(traces: DataFrame, panel: list[str], k1: list[float], amps1: list[float], k2: list[float], amps2: list[float], d1: float = 1.0, d2: float = 1.0) -> DataFrame:
    """Product of polygonal filters along both axes of a depth panel."""
    return wavenumber_filter(traces, panel, lambda j, n1, n2: polygon(k2, amps2, np.abs(np.fft.fftfreq(n2, d2)), 1) * polygon(k1, amps1, np.array([j / (n1 * d1)]), 1)[0])


def filter_radial_power(traces: DataFrame, panel: list[str], power: float = 0.0, d1: float = 1.0, d2: float = 1.0) -> DataFrame:
    """Fractional Laplacian-like filter |k| ** power; the mean is dropped when the power is negative."""

    def weight(j: int, n1: int, n2: int) -> np.ndarray:
        r = 2 * math.pi * np.hypot(np.fft.fftfreq(n2, d2), j / (n1 * d1))
        return np.where(r > 0, np.where(r > 0, r, 1.0) ** power, 1.0 if power == 0 else 0.0)

    return wavenumber_filter(traces, panel, weight)


def filter_gaussian(traces: DataFrame, panel: list[str], a1: float = 0.0, a2: float = 0.0) -> DataFrame:
    """Gaussian wavenumber weights exp(-(a k / 2)^2) along both axes, rescaled to the input's largest value."""
    out = wavenumber_filter(traces, panel, lambda j, n1, n2: np.exp(-((a2 * math.pi * np.fft.fftfreq(n2)) ** 2) - (a1 * math.pi * j / n1) ** 2))
    top = lambda df, name: df.groupBy(*panel).agg(F.max(F.array_max(F.transform("data", lambda v: F.abs(v.cast("double"))))).alias(name))
    scale = _joined(top(traces, "before_"), top(out, "after_"), panel).withColumn("scale_", F.when(F.col("after_") > 0, F.col("before_") / F.col("after_")).otherwise(1.0))
    scaled = _joined(out, scale.select(*panel, "scale_"), panel)
    return scaled.withColumn("data", F.transform("data", lambda v: v * F.col("scale_")).cast(traces.schema["data"].dataType)).drop("scale_")


def subtract_eigenimages(traces: DataFrame, panel: list[str], count: int | None = None, subtract: bool = True) -> DataFrame:
    """Keep, or subtract, the panel's first singular images (1 in 100 traces by default, at least 1).

    By sums of the traces' outer products, and projection of each trace on their first eigenvectors.
    """
    keys = [traces.schema[k] for k in panel]
    sums = T.StructType([*keys, T.StructField("i", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.DoubleType())])

    def outer(batches):
        for batch in batches:
            for _, part in batch.groupby(panel, dropna=False):
                x = np.stack([np.asarray(d, dtype=np.float64) for d in part["data"]])
                g = (x.T @ x).ravel()
                head = part[panel].iloc[[0] * len(g)].reset_index(drop=True)
                yield head.assign(i=np.arange(len(g)), n=len(x), v=g)

    def vectors(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows.sort_values("i")["v"].to_numpy()
        nt = math.isqrt(len(g))
        n = min(count or max(1, int(rows["n"].iloc[0]) // 100), nt)
        v = np.linalg.eigh(g.reshape(nt, nt))[1][:, ::-1][:, :n].T
        return rows[panel].head(1).assign(vectors_=[v.ravel()])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(data: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(data, vs):
            x = np.asarray(d, dtype=np.float64)
            v = np.asarray(v).reshape(-1, len(x))
            part = (v @ x) @ v
            out.append(x - part if subtract else part)
        return pd.Series(out, dtype=object)

    added = traces.select(*panel, "data").mapInPandas(outer, sums).groupBy(*panel, "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    found = added.groupBy(*panel).applyInPandas(vectors, T.StructType([*keys, T.StructField("vectors_", T.ArrayType(T.DoubleType()))]))
    return _joined(traces, found, panel).withColumn("data", project("data", "vectors_").cast(traces.schema["data"].dataType)).drop("vectors_")


def filter_phase_coherence(traces: DataFrame, panel: list[str], high: float = 1.0, low: float = 0.3) -> DataFrame:
    """Zero F-X cells whose phase step to the next trace of the panel has a cosine outside [low, high]; the last trace stays."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(data: pd.Series, following: pd.Series) -> pd.Series:
        out = []
        for d, after in zip(data, following):
            d = np.asarray(d, dtype=np.float64)
            if after is not None:
                n = real_fft_length(len(d))
                own, other = _rfft(np.stack([d, np.asarray(after, dtype=np.float64)]), n)
                step = np.cos(np.angle(other) - np.angle(own))
                keep = (step <= high + 1e-12) & (step >= low)
                keep[-1] = True
                d = _irfft(np.where(keep, own, 0), n, len(d))
            out.append(d)
        return pd.Series(out, dtype=object)

    beside = blocks.with_margins(traces, panel, before=0, after=1)
    return blocks.without_margins(beside.withColumn("next_", F.lead("data").over(blocks.window(panel)))).withColumn("data", run("data", "next_").cast(traces.schema["data"].dataType)).drop("next_")


def mix_low_frequencies(traces: DataFrame, panel: list[str], dt: float, f1: float = 3.0, f2: float = 20.0, ramp: float = 5.0, velocity: float = 1000.0, dx: float = 10.0, max_mix: int | None = None) -> DataFrame:
    """Mix traces more at lower frequencies: an odd width of velocity / (f dx) traces between f1 and f2, blended over the ramp."""

    def run(c: np.ndarray, j: int, nt: int) -> np.ndarray:
        nx, f = len(c), j / (real_fft_length(nt) * dt)
        if not f1 <= f <= f2 + ramp:
            return c
        sums = np.concatenate((np.zeros(1), np.cumsum(c)))
        width = min(int(round(velocity / (f * dx))) | 1, (max_mix or nx) | 1)
        lo, hi = np.maximum(np.arange(nx) - width // 2, 0), np.minimum(np.arange(nx) + width // 2 + 1, nx)
        share = 1.0 if f <= f2 else 1 - (f - f2) / ramp
        return share * (sums[hi] - sums[lo]) / (hi - lo) + (1 - share) * c

    return along_traces(traces, panel, run)


def trimmed_spectrum_stack(traces: DataFrame, keys: list[str], percent: float = 15.0) -> DataFrame:
    """One trace a gather: alpha-trimmed means of the real and the imaginary parts at each frequency."""
    rows = _spectra(traces, keys)
    whole = Window.partitionBy(*keys, "j")
    n = F.count(F.lit(1)).over(whole)
    rows = rows.withColumn("n_", n).withColumn("re_", F.row_number().over(whole.orderBy("re", "seq"))).withColumn("im_", F.row_number().over(whole.orderBy("im", "seq")))
    drop = F.least(F.floor(F.col("n_") * percent / 100 + 0.5), F.floor((F.col("n_") - 1) / 2))
    mean = lambda v: F.avg(F.when((F.col(f"{v}_") > drop) & (F.col(f"{v}_") <= F.col("n_") - drop), F.col(v))).alias(v)
    new = _arrays(rows.groupBy(*keys, "j").agg(mean("re"), mean("im"), F.max("nt").alias("nt")), *keys)
    first = traces.groupBy(*keys).agg(F.min_by(F.struct(*traces.columns), "seq").alias("first_")).select("first_.*")
    return _joined(first, new, keys).withColumn("data", F.col("filtered_").cast(traces.schema["data"].dataType)).drop("filtered_")
