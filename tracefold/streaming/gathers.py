"""Streaming twins: stateful gather completion and running quantiles.

Filters of :mod:`tracefold.operators.kernels` are stateless and run on a
streaming table as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATHER_SCHEMA = "ensemble_number long, n_traces long, complete boolean, stack array<double>"
_STATE = "seen long, sums array<double>"


def complete_gathers(traces: DataFrame, fold: int, timeout_ms: int = 60_000) -> DataFrame:
    """One row a gather: its mean trace when ``fold`` traces have come, or what there is when none came for a while.

    State is a count and a sum trace a gather, so it stays small however many traces a gather has.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, sums = (0, None)
        if state.exists:
            seen, held = state.get
            sums = np.array(held)
        if not state.hasTimedOut:
            for frame in frames:
                for data in frame["data"]:
                    x = np.asarray(data, dtype=float)
                    sums = x if sums is None else sums + x
                    seen += 1
        if state.hasTimedOut or seen >= fold:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"ensemble_number": [key[0]], "n_traces": [seen], "complete": [seen >= fold], "stack": [(sums / seen).tolist()]})
        else:
            state.update((seen, sums.tolist()))
            state.setTimeoutDuration(timeout_ms)

    return traces.groupBy("ensemble_number").applyInPandasWithState(run, GATHER_SCHEMA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


class RunningQuantile:
    """Five-marker estimate of a quantile (P-square), updated value by value in constant memory."""

    def __init__(self, p: float, state: list[float] | None = None):
        self.p = p
        self.n = int(state[0]) if state else 0
        self.heights = list(state[1:6]) if state else []
        self.places = list(state[6:11]) if state else [1.0, 2.0, 3.0, 4.0, 5.0]
        if state and self.n < 5:
            self.heights = self.heights[: self.n]

    def state(self) -> list[float]:
        return [float(self.n), *(self.heights + [0.0] * 5)[:5], *self.places]

    def update(self, x: float) -> None:
        self.n += 1
        h, pos = self.heights, self.places
        if self.n <= 5:
            h.append(x)
            h.sort()
            return
        if x < h[0]:
            h[0], k = x, 0
        elif x >= h[4]:
            h[4], k = x, 3
        else:
            k = next(i for i in range(4) if h[i] <= x < h[i + 1])
        for i in range(k + 1, 5):
            pos[i] += 1
        wanted = [1 + (self.n - 1) * q for q in (0, self.p / 2, self.p, (1 + self.p) / 2, 1)]
        for i in (1, 2, 3):
            d = wanted[i] - pos[i]
            if (d >= 1 and pos[i + 1] - pos[i] > 1) or (d <= -1 and pos[i - 1] - pos[i] < -1):
                s = 1 if d > 0 else -1
                up, down = (h[i + 1] - h[i]) / (pos[i + 1] - pos[i]), (h[i] - h[i - 1]) / (pos[i] - pos[i - 1])
                curve = h[i] + s / (pos[i + 1] - pos[i - 1]) * ((pos[i] - pos[i - 1] + s) * up + (pos[i + 1] - pos[i] - s) * down)
                if h[i - 1] < curve < h[i + 1]:
                    h[i] = curve
                else:
                    h[i] += s * (h[i + s] - h[i]) / (pos[i + s] - pos[i])
                pos[i] += s

    def value(self) -> float:
        if not self.n:
            return float("nan")
        if self.n <= 5:
            return float(np.quantile(self.heights, self.p))
        return self.heights[2]


def running_quantile(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """The current estimate of each key's quantile after every batch; state is eleven numbers a key."""
    kind = rows.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = RunningQuantile(p, list(state.get[0]) if state.exists else None)
        for frame in frames:
            for v in frame[value]:
                if v is not None and v == v:
                    q.update(float(v))
        state.update((q.state(),))
        yield pd.DataFrame({key: [k[0]], "n": [q.n], "quantile": [q.value()]})

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long, quantile double", "markers array<double>", "update", GroupStateTimeout.NoTimeout)
