"""Damped least-squares smoothing along and across traces, and smoothing within segments.

Damped smoothing of a line of rows with link weights L solves, for all samples at once,

    (1 + L[i - 1] + L[i]) z[i] - L[i - 1] z[i - 1] - L[i] z[i + 1] = x[i]

A link is a number, or depends on the distance to the next row: none where a gap parts
segments, larger where rows lie close. The system runs across rows, so a line is cut
into blocks: every block is eliminated but for its first and last row, the few numbers
of the blocks of a line are solved in order, and every block then has its solution.
A line that is not large is one block, and the blocks of an Arrow batch are eliminated
together. What one task holds is a batch and a block, or the two rows of each block of one line.

Defined results: null samples give null, and the rows beside them are consecutive; a null line is a line;
shorter arrays beside longer ones raise; rows of a line are told apart by the order
column; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators import blocks, cross
from tracefold.operators.kernels import Kernel, savitzky_golay_weights

_ARRAY = T.ArrayType(T.DoubleType())


def solve_line(before: np.ndarray, after: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of the damped system for rows with link weights to the row before and after; the first and the last link leave the rows given."""
    n = len(rhs)
    x, c = np.array(rhs, dtype=np.float64), np.zeros(n)
    for i in range(n):
        d = 1 + before[i] + after[i]
        if i:
            d += before[i] * c[i - 1]
            x[i] += before[i] * x[i - 1]
        c[i] = -after[i] / d
        x[i] /= d
    for i in range(n - 2, -1, -1):
        x[i] -= c[i] * x[i + 1]
    return x


def damped(smoothness: float) -> Kernel:
    """Along the samples of a trace; the first sample stays as it is."""
    link = smoothness**2 / 4

    def run(x: np.ndarray, dt: float) -> np.ndarray:
        n = x.shape[1] - 1
        if n < 1:
            return x
        before, after = np.full(n, link), np.full(n, link)
        after[-1] = 0
        rest = np.array(x.T[1:], dtype=np.float64)
        rest[0] += link * x.T[0]
        return np.concatenate((x[:, :1], solve_line(before, after, rest).T), axis=1)

    return run


def solve_lines(before: np.ndarray, after: np.ndarray, rhs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """:func:`solve_line` of each of the consecutive lines of these sizes (1 or more); the rows at one place of all lines go together."""
    large = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[large] = np.arange(len(sizes))
    place = np.arange(len(rhs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((np.repeat(rank, sizes), place))
    live = np.bincount(place)  # lines that reach a place: at each, the first of the lines by size
    starts = np.cumsum(live) - live
    before, after, x, c = before[order], after[order], np.array(rhs[order], dtype=np.float64), np.zeros(len(rhs))
    for i, (s, n) in enumerate(zip(starts, live)):
        here = slice(s, s + n)
        d = 1 + before[here] + after[here]
        if i:
            above = slice(starts[i - 1], starts[i - 1] + n)
            d += before[here] * c[above]
            x[here] += before[here, None] * x[above]
        c[here] = -after[here] / d
        x[here] /= d[:, None]
    for i in range(len(live) - 2, -1, -1):
        n = live[i + 1]
        here, below = slice(starts[i], starts[i] + n), slice(starts[i + 1], starts[i + 1] + n)
        x[here] -= c[here, None] * x[below]
    out = np.empty_like(x)
    out[order] = x
    return out


def _eliminated(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole blocks one after another: every row's solution without the block's neighbours, and its answer to the row before and after the block."""
    place, before, after = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("place_", "prev_link_", "next_link_"))
    data = rows.column("value_")
    values, at = data.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), data.offsets.to_numpy()
    starts = np.flatnonzero(place == 1)
    sizes, widths = np.diff(np.append(starts, len(place))), np.diff(at)
    if (widths != np.repeat(widths[starts], sizes)).any():
        raise ValueError("a line's arrays must have one length")
    solved, answers = np.empty(at[-1] - at[0]), np.empty((len(place), 2))
    for width in np.unique(widths):
        own, blocks_ = np.flatnonzero(widths == width), sizes[widths[starts] == width]
        cells = at[own][:, None] + np.arange(width)
        first = np.cumsum(blocks_) - blocks_
        ends = np.zeros((len(own), 2))
        ends[first, 0], ends[first + blocks_ - 1, 1] = before[own][first], after[own][first + blocks_ - 1]
        got = solve_lines(before[own], after[own], np.concatenate((values[cells], ends), axis=1), blocks_)
        solved[cells - at[0]], answers[own] = got[:, :width], got[:, width:]
    made = {"smoothed_": pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(solved)), "by_before_": pa.array(answers[:, 0].copy()), "by_after_": pa.array(answers[:, 1].copy())}
    kept = [c for c in rows.schema.names if c not in ("value_", "prev_link_", "next_link_")]
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *made.values()], names=[*kept, *made])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that none ends within a block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("place_").to_numpy(zero_copy_only=False) == 1)
        if len(starts):
            held.append(batch.slice(0, starts[-1]))
            if sum(len(b) for b in held):
                yield pa.concat_batches(held)
            held = [batch.slice(starts[-1])]
        elif len(batch):
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def smooth_across(df: DataFrame, line: list[str], order: str, value: str, link: Callable[[Column], Column]) -> DataFrame:
    """Damped smoothing of ``value`` (a number or an array of samples) along each line; link(distance) is the weight between consecutive rows."""
    kind = df.schema[value].dataType
    numeric = not isinstance(kind, T.ArrayType)
    w = blocks.window(line, order)
    by_block = [*line, "block_"]
    given = df.withColumn("value_", (F.array(F.col(value)) if numeric else F.col(value)).cast(_ARRAY))
    if numeric:
        given = given.withColumn("value_", F.when(F.col(value).isNotNull(), F.col("value_")))
    ready = given.where("value_ is not null")
    large_ones = blocks.has_large(ready, line, blocks.ROWS)
    beside = blocks.with_margins(ready, line, order, large_ones=large_ones).repartition(*by_block)
    own = F.col(order)
    beside = beside.withColumn("prev_link_", F.coalesce(link(own - F.lag(own).over(w)), F.lit(0.0)).cast("double")).withColumn("next_link_", F.coalesce(link(F.lead(own).over(w) - own), F.lit(0.0)).cast("double"))
    rows = beside.where(~F.col("margin_")).withColumn("large_", F.col("least_").isNotNull()).withColumn("place_", F.row_number().over(w))
    rows = rows.select(*by_block, order, "large_", "place_", "value_", "prev_link_", "next_link_").sortWithinPartitions(*by_block, "place_")
    keys = [rows.schema[c] for c in by_block]
    solved = T.StructType([*keys, *(rows.schema[c] for c in (order, "large_", "place_")), T.StructField("smoothed_", _ARRAY), *[T.StructField(c, T.DoubleType()) for c in ("by_before_", "by_after_")]])
    around = T.StructType([*keys, T.StructField("before_", _ARRAY), T.StructField("after_", _ARRAY)])

    def eliminate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_eliminated, _whole_blocks(batches))

    def between(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_")
        first, last, answers = (np.stack(part[c].to_list()) for c in ("first_", "last_", "answers_"))
        n = len(part)
        # going forward: a block's last row by the first row of the next block
        fixed, by_next, own = np.zeros_like(last), np.zeros(n), []
        for b in range(n):
            p0, p1, q0, q1 = answers[b]
            if b:
                share = 1 / (1 - p0 * by_next[b - 1])
                own.append((share * (first[b] + p0 * fixed[b - 1]), share * q0))
                at, by = fixed[b - 1] + by_next[b - 1] * own[b][0], by_next[b - 1] * own[b][1]
                fixed[b], by_next[b] = last[b] + p1 * at, q1 + p1 * by
            else:
                own.append((first[0], q0))
                fixed[0], by_next[0] = last[0], q1
        after, firsts = np.zeros_like(last), np.zeros_like(last)
        for b in range(n - 1, -1, -1):
            after[b] = firsts[b + 1] if b + 1 < n else 0
            firsts[b] = own[b][0] + own[b][1] * after[b]
        before = np.concatenate((np.zeros((1, last.shape[1])), fixed[:-1] + by_next[:-1, None] * firsts[1:]))
        return part[by_block].assign(before_=list(before), after_=list(after))

    new = rows.mapInArrow(eliminate, solved)
    if large_ones:
        row = F.struct("smoothed_", "by_before_", "by_after_")
        ends = new.where("large_").groupBy(*by_block).agg(F.min_by(row, "place_").alias("f"), F.max_by(row, "place_").alias("l"))
        ends = ends.select(*by_block, F.col("f.smoothed_").alias("first_"), F.col("l.smoothed_").alias("last_"), F.array("f.by_before_", "l.by_before_", "f.by_after_", "l.by_after_").alias("answers_"))
        sides = ends.groupBy(*line).applyInPandas(between, around).withColumnsRenamed({c: f"{c}_side_" for c in by_block})
        new = new.join(sides, blocks.null_safe(new, sides, by_block, "_side_"), "left")
        moved = lambda by: lambda s, x: s + F.col(by) * x
        whole = F.zip_with(F.zip_with("smoothed_", "before_", moved("by_before_")), "after_", moved("by_after_"))
        new = new.withColumn("smoothed_", F.when(F.col("before_").isNull(), F.col("smoothed_")).otherwise(whole))
    new = new.select(*(F.col(c).alias(f"{c}_new_") for c in (*line, order)), "smoothed_")
    met = df.join(new, blocks.null_safe(df, new, [*line, order], "_new_"), "left").drop(*(f"{c}_new_" for c in (*line, order)))
    out = F.get("smoothed_", F.lit(0)) if numeric else F.col("smoothed_")
    return met.withColumn(value, out.cast("double" if numeric else kind)).drop("smoothed_")


def even_link(smoothness: float) -> Callable[[Column], Column]:
    """The same weight between all rows."""
    return lambda gap: F.when(gap.isNotNull(), F.lit(smoothness**2 / 4))


def spaced_link(length: float) -> Callable[[Column], Column]:
    """Weight by the squared distance of unevenly spaced rows, for an operator of this length."""
    return lambda gap: F.lit(0.5 * (length / 5.19) ** 2) / (gap * gap)


def parted(link: Callable[[Column], Column], gap: float) -> Callable[[Column], Column]:
    """No link over a distance of more than ``gap``."""
    return lambda d: F.when(d <= gap, link(d))


def damped_panel(traces: DataFrame, panel: list[str], along: float, across: float) -> DataFrame:
    """Damped smoothing of panels: across traces in the order of ``seq``, then along each."""
    from tracefold.operators.kernels import apply_kernels

    return apply_kernels(smooth_across(traces, panel, "seq", "data", even_link(across)), damped(along))


def smooth_segments(df: DataFrame, line: list[str], index: str, value: str, gap: float, radius: int, method: str = "mean") -> DataFrame:
    """Smooth ``value`` (a number) within the stretches of a line that a jump of more than ``gap`` in the index parts.

    mean, triangle: weighted sums over the rows within ``radius``, missing ones counting as 0, weights adding to 1.
    savitzky_golay: the local fit of degree 4, likewise. median: of 2 radius + 1 rows; rows nearer to an end stay.
    """
    parts = cross.segments_at_gaps(df, line, index, gap, "segment_")
    beside = blocks.with_margins(parts, line, index, before=radius, after=radius)
    w = blocks.window(line, index)
    offsets = range(-radius, radius + 1)
    same = lambda k: F.when(F.lead("segment_", k).over(w) == F.col("segment_"), F.lead(value, k).over(w).cast("double"))
    near = F.array(*[same(k) if k else F.col(value).cast("double") for k in offsets])
    found = blocks.without_margins(beside.withColumn("near_", near))
    if method == "median":
        whole = ~F.exists("near_", lambda v: v.isNull())
        out = F.when(whole, F.element_at(F.array_sort("near_"), radius + 1)).otherwise(F.col(value).cast("double"))
    else:
        weights = {"mean": [1.0] * (2 * radius + 1), "triangle": [float(radius + 1 - abs(k)) for k in offsets]}.get(method)
        weights = savitzky_golay_weights(radius, radius, 0, 4).tolist() if weights is None and method == "savitzky_golay" else weights
        if weights is None:
            raise ValueError(f"no method {method}")
        total = sum(weights)
        out = F.when(F.col(value).isNotNull(), sum((F.coalesce(F.get("near_", F.lit(k)), F.lit(0.0)) * (x / total) for k, x in enumerate(weights)), F.lit(0.0)))
    return found.withColumn(value, out).drop("near_", "segment_")
