"""Small dense systems per row: array<array<double>> matrices, solved in Arrow batches.

Rows of one shape are stacked and solved in one call. A null, ragged or empty
matrix, a shape that doesn't fit the operation, and a singular system give null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR, MATRIX = "array<double>", "array<array<double>>"


def _dense(value) -> np.ndarray | None:
    """The cell as an array of one or two axes; None where it is no full one."""
    if value is None:
        return None
    try:
        out = np.array([list(v) if isinstance(v, np.ndarray | list) else v for v in value], dtype=float)
    except (TypeError, ValueError):
        return None
    return out if out.size and np.isfinite(out).all() else None


def _plain(row: np.ndarray):
    return row.tolist()


def _stacked(kind: str, solve: Callable[..., np.ndarray]):
    """A function of columns that runs ``solve`` on stacks of rows of like shapes; rows it can't solve are null."""

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return _by_shape(solve, a)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _by_shape(solve, a, b)

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)


def _by_shape(solve: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    rows = [[_dense(v) for v in row] for row in zip(*columns, strict=True)]
    groups: dict[tuple, list[int]] = {}
    for k, row in enumerate(rows):
        if all(v is not None for v in row):
            groups.setdefault(tuple(v.shape for v in row), []).append(k)
    out: list = [None] * len(rows)
    for own in groups.values():
        try:
            found = solve(*(np.stack([rows[k][j] for k in own]) for j in range(len(columns))))
        except (np.linalg.LinAlgError, ValueError):
            found = []
            for k in own:  # one singular row mustn't cost the others their solution
                try:
                    found.append(solve(*(v[None] for v in rows[k]))[0])
                except (np.linalg.LinAlgError, ValueError):
                    found.append(None)
        for k, v in zip(own, found, strict=True):
            if v is not None and np.isfinite(v).all():
                out[k] = _plain(v)
    return pd.Series(out)


def solve(a: Column, b: Column, transposed: bool = False) -> Column:
    """x with a x = b (or a' x = b)."""
    return _stacked(VECTOR, lambda m, v: np.linalg.solve(np.swapaxes(m, 1, 2) if transposed else m, v[..., None])[..., 0])(a, b)


def inverse(a: Column) -> Column:
    return _stacked(MATRIX, np.linalg.inv)(a)


def inverse_times(a: Column, b: Column) -> Column:
    """The matrix a⁻¹ b, without forming the inverse."""
    return _stacked(MATRIX, np.linalg.solve)(a, b)


def reciprocal_condition(a: Column) -> Column:
    """1 / (|a| |a⁻¹|) in the 1-norm, as an array of one number; 0 for a singular matrix."""
    return _stacked(VECTOR, lambda m: 1 / np.linalg.cond(m, 1)[:, None])(a)


def least_squares(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """x of least norm that minimises |a x - b|; singular values under ``tolerance`` times the largest count as 0."""
    return _stacked(VECTOR, lambda m, v: (np.linalg.pinv(m, rcond=tolerance) @ v[..., None])[..., 0])(a, b)


def orthogonal_fit(a: Column, b: Column) -> Column:
    """x that minimises |a x - b| by orthogonal triangles; a has full column rank."""

    def run(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        q, r = np.linalg.qr(m)
        return np.linalg.solve(r, np.swapaxes(q, 1, 2) @ v[..., None])[..., 0]

    return _stacked(VECTOR, run)(a, b)


def conjugate_gradient(a: Column, b: Column, steps: int) -> Column:
    """x of |a x - b| after at most ``steps`` conjugate gradient steps on the normal equations, from 0."""

    def run(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        t = np.swapaxes(m, 1, 2)
        x, rest = np.zeros((len(m), m.shape[2], 1)), v[..., None].copy()
        s = t @ rest
        p, size = s, (s * s).sum(axis=1, keepdims=True)
        floor = 1e-28 * size
        for _ in range(steps):
            q = m @ p
            below = (q * q).sum(axis=1, keepdims=True)
            live = (size > floor) & (below > 0)
            step = np.where(live, size / np.where(below > 0, below, 1), 0)
            x, rest = x + step * p, rest - step * q
            s = t @ rest
            new = (s * s).sum(axis=1, keepdims=True)
            p, size = s + np.where(live, new / np.where(size > 0, size, 1), 0) * p, new
        return x[..., 0]

    return _stacked(VECTOR, run)(a, b)


def eigenvalues(a: Column) -> Column:
    """Eigenvalues of a symmetric matrix, largest first."""
    return _stacked(VECTOR, lambda m: np.linalg.eigvalsh(m)[:, ::-1])(a)


def eigenvectors(a: Column) -> Column:
    """Rows: unit eigenvectors of a symmetric matrix in the order of :func:`eigenvalues`, their largest entry positive."""

    def run(m: np.ndarray) -> np.ndarray:
        v = np.swapaxes(np.linalg.eigh(m)[1][:, :, ::-1], 1, 2)
        top = np.take_along_axis(v, np.abs(v).argmax(axis=2)[..., None], axis=2)
        return v * np.sign(top)

    return _stacked(MATRIX, run)(a)


def singular_values(a: Column) -> Column:
    """Singular values, largest first."""
    return _stacked(VECTOR, lambda m: np.linalg.svd(m, compute_uv=False))(a)
