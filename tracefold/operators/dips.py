"""Dips between neighbouring traces, and new traces interpolated along them.

The low frequencies are taken to be unaliased: traces are levelled by a running
mean of their absolute values, kept between about f1 and f2, and at each sample the
dip to the next trace, in samples a trace, is minus the product of the differences
across and along, over the latter's square, both smoothed along the trace (and
across traces). New traces blend both neighbours shifted along the dip, at full
bandwidth, by least-squares sinc interpolation.

A panel's traces are in the order of ``seq``; its last trace has the difference of
the one before, and no trace follows it. Defined results: a panel of one trace has
dip 0 and gives that trace alone; a trace with null samples, or next to one, gets
null dips and no new traces beside it; neighbours must have one length; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions import stacks
from tracefold.operators import blocks, sinc
from tracefold.operators.kernels import real_fft_length

_TINY = 1e-30
_ARRAY = T.ArrayType(T.DoubleType())


def running_mean(x: np.ndarray, length: int) -> np.ndarray:
    """Mean of the samples within length // 2 places along the last axis; shorter at the ends."""
    half, n = length // 2, x.shape[-1]
    sums = np.concatenate((np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)), axis=-1)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (sums[..., hi] - sums[..., lo]) / (hi - lo)


def _twice(x: np.ndarray, length: int) -> np.ndarray:
    return running_mean(running_mean(x, length), length)


def low_frequencies(x: np.ndarray, dt: float, f1: float, f2: float, agc: float) -> tuple[np.ndarray, np.ndarray]:
    """Levelled traces between f1 and f2, and their derivative along the trace (a sample)."""
    levelled = x / (_twice(np.abs(x), 1 + int(agc / dt)) + _TINY)
    n = real_fft_length(x.shape[-1])
    f = np.fft.rfftfreq(n, dt)
    low, high = (f / f1) ** 4, (f / f2) ** 4
    c = np.fft.rfft(levelled, n, axis=-1) * (low / ((1 + low) * (1 + high)))
    slope = c * (2j * np.pi * np.arange(len(f)) / n)
    slope[..., -1] = 0  # the Nyquist frequency has no derivative
    return np.fft.irfft(c, n, axis=-1)[..., : x.shape[-1]], np.fft.irfft(slope, n, axis=-1)[..., : x.shape[-1]]


def _products(batch: pa.RecordBatch, dt: float, f1: float, f2: float, agc: float, length: int) -> tuple[pa.Array, pa.Array]:
    """Smoothed products of each trace's difference to its neighbour (before_ at the panel's end) and along it, and squares of the latter."""
    data, before, after = (batch.column(c) for c in ("data", "before_", "next_"))
    own, n_before, n_after = (stacks.lengths(c) for c in (data, before, after))
    other = np.where(n_after >= 0, n_after, n_before)
    across, along = [], []
    for n in np.unique(own[own >= 0]):
        rows = np.flatnonzero(own == n)
        if (other[rows][other[rows] >= 0] != n).any():
            raise ValueError("neighbouring traces must have one length")
        alone = rows[other[rows] < 0]
        across.append((alone, np.zeros((len(alone), n))))
        along.append((alone, np.zeros((len(alone), n))))
        for beside, sign, there in ((after, 1, (n_after[rows] >= 0)), (before, -1, (n_after[rows] < 0) & (n_before[rows] >= 0))):
            with_one = rows[there]
            if len(with_one) and n:
                low, slope = low_frequencies(np.stack((stacks.stack(data, with_one, n), stacks.stack(beside, with_one, n))), dt, f1, f2, agc)
                across.append((with_one, _twice(sign * (low[1] - low[0]) * slope[0], length)))
                along.append((with_one, _twice(slope[0] * slope[0], length)))
            elif len(with_one):
                across.append((with_one, np.zeros((len(with_one), 0))))
                along.append((with_one, np.zeros((len(with_one), 0))))
    return stacks.lists(len(own), across), stacks.lists(len(own), along)


def _mean_across(df: DataFrame, panel: list[str], columns: list[str], width: int) -> DataFrame:
    """Mean of arrays over the traces within width // 2, fewer at the panel's ends."""
    half = width // 2
    beside = blocks.with_margins(df, panel, before=half, after=half)
    w = blocks.window(panel).rowsBetween(-half, half)
    for c in columns:
        near = F.collect_list(c).over(w)
        beside = beside.withColumn(f"{c}_near_", near)
    out = blocks.without_margins(beside)
    for c in columns:
        summed = F.aggregate(F.slice(f"{c}_near_", F.lit(2), F.greatest(F.size(f"{c}_near_"), F.lit(1))), F.get(f"{c}_near_", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
        n = F.size(f"{c}_near_")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.transform(summed, lambda v: v / n)))  # noqa: B023
    return out.drop(*(f"{c}_near_" for c in columns))


def dip_picks(traces: DataFrame, panel: list[str], dt: float, f1: float = 3.0, f2: float = 20.0, agc: float = 0.4, length: int = 5, width: int = 1) -> DataFrame:
    """Traces with ``dip`` (samples a trace, to the next trace) and ``next_`` (the next trace's samples; null at the panel's end)."""
    w = blocks.window(panel)
    beside = blocks.with_margins(traces, panel, before=1, after=1)
    df = blocks.without_margins(beside.withColumn("before_", F.lag("data").over(w)).withColumn("next_", F.lead("data").over(w)))
    kept = [*traces.columns, "next_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stacks.in_slices(batches):
            made = _products(batch, dt, f1, f2, agc, 1 + 2 * (length // 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "across_", "along_"])

    # a map of batches, since a function of columns is worked out twice where an explode follows
    df = df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField("across_", _ARRAY), T.StructField("along_", _ARRAY)]))
    if width > 1:
        for _ in range(2):
            df = _mean_across(df, panel, ["across_", "along_"], width)
    return df.withColumn("dip", F.zip_with("across_", "along_", lambda a, b: -a / (b + _TINY))).drop("across_", "along_")


def _between(batch: pa.RecordBatch, count: int) -> list[pa.Array]:
    """The new traces after each of a batch, a column for each of their places; null where there are none."""
    data, following, dip = (batch.column(c) for c in ("data", "next_", "dip"))
    sizes = np.stack([stacks.lengths(c) for c in (data, following, dip)])
    made: list[list] = [[] for _ in range(count)]
    for n in np.unique(sizes[0][sizes.min(axis=0) >= 0]):
        rows = np.flatnonzero((sizes[0] == n) & (sizes.min(axis=0) >= 0))
        d, a, p = (stacks.stack(c, rows, n) for c in (data, following, dip))
        at = np.arange(n)
        for k in range(1, count + 1):
            share = k / (1 + count)
            made[k - 1].append((rows, (1 - share) * sinc.at_places(d, at - p * share) + share * sinc.at_places(a, at + p * (1 - share))))
    return [stacks.lists(len(batch), found) for found in made]


def interpolate_traces(traces: DataFrame, panel: list[str], count: int, dt: float, **options) -> DataFrame:
    """All traces (``between`` 0) and ``count`` new ones after each but its panel's last (``between`` 1, 2, ...); new rows carry the headers of the trace before them."""
    picked = dip_picks(traces, panel, dt, **options)
    kind = traces.schema["data"].dataType
    kept = [*traces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stacks.in_slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_between(batch, count)], names=[*kept, *new])

    new = [f"made_{k}_" for k in range(1, count + 1)]
    made = picked.mapInArrow(run, T.StructType([*(picked.schema[c] for c in kept), *[T.StructField(c, _ARRAY) for c in new]]))
    row = lambda between, data: F.struct(F.lit(between).alias("between"), data.alias("data"))
    own: Column = F.array(row(0, F.col("data")))
    if new:
        between = F.array(*[row(k, F.col(c).cast(kind)) for k, c in enumerate(new, 1)])
        own = F.when(F.col(new[0]).isNull(), own).otherwise(F.concat(own, between))
    rows = made.withColumn("row_", F.explode(own))
    return rows.select(*[F.col("row_.data").alias(c) if c == "data" else F.col(c) for c in traces.columns], F.col("row_.between").alias("between"))
