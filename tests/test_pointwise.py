"""Odd cases of the small dense systems, and bilinear lookups at and beyond the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import arrays as A
from tracefold.functions import curves, linear

SCHEMA = "k int, a array<array<double>>, b array<double>"


@pytest.fixture(scope="module")
def systems(spark):
    rows = [
        (0, [[2.0, 1.0], [1.0, 3.0]], [1.0, 2.0]),
        (1, [[1.0, 2.0], [2.0, 4.0]], [1.0, 2.0]),  # singular
        (2, None, [1.0, 2.0]),
        (3, [[1.0, 2.0], [3.0]], [1.0, 2.0]),  # ragged
        (4, [], []),
        (5, [[4.0]], [2.0]),
        (6, [[2.0, None], [1.0, 3.0]], [1.0, 2.0]),
        (7, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [1.0, 2.0, 4.0]),  # three equations, two unknowns
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_key(df, column):
    return {r.k: r[0] for r in df.select(column.alias("v"), "k").collect()}


def test_solutions_leave_unfit_rows_null(systems):
    found = by_key(systems, linear.solve(F.col("a"), F.col("b")))
    assert np.allclose(found[0], [0.2, 0.6]) and found[5] == [0.5]
    assert all(found[k] is None for k in (1, 2, 3, 4, 6, 7))


def test_least_squares_agree_and_take_singular_systems(systems):
    ways = [linear.least_squares(F.col("a"), F.col("b")), linear.conjugate_gradient(F.col("a"), F.col("b"), 4)]
    for found in (by_key(systems, w) for w in ways):
        assert np.allclose(found[1], [0.2, 0.4]) and np.allclose(found[7], [4 / 3, 7 / 3])
        assert found[2] is None and found[3] is None
    assert np.allclose(by_key(systems, linear.orthogonal_fit(F.col("a"), F.col("b")))[7], [4 / 3, 7 / 3])


def test_spectra(systems):
    square = systems.where("k in (0, 5)")
    assert np.allclose(by_key(square, linear.eigenvalues(F.col("a")))[0], [(5 + math.sqrt(5)) / 2, (5 - math.sqrt(5)) / 2])
    v = np.array(by_key(square, linear.eigenvectors(F.col("a")))[0])
    assert np.allclose(v @ v.T, np.eye(2)) and np.allclose(np.array([[2, 1], [1, 3]]) @ v[0], (5 + math.sqrt(5)) / 2 * v[0])
    assert np.allclose(by_key(systems, linear.singular_values(F.col("a")))[1], [5, 0])
    assert by_key(systems, linear.reciprocal_condition(F.col("a")))[5] == [1.0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert empty.select(linear.solve(F.col("a"), F.col("b")), linear.inverse(F.col("a"))).collect() == []


def test_bilinear_takes_the_edge_outside(spark):
    grid = F.lit([[0.0, 1.0], [2.0, 5.0]])
    at = lambda x, y: spark.range(1).select(A.bilinear(grid, F.lit(x), F.lit(y))).first()[0]
    assert [at(0.0, 0.0), at(1.0, 1.0), at(0.5, 0.5), at(9.0, -3.0), at(-1.0, 0.5)] == [0.0, 5.0, 2.0, 1.0, 1.0]
    one = spark.range(1).select(A.bilinear(F.lit([[7.0]]), F.lit(3.0), F.lit(-2.0))).first()[0]
    assert one == 7.0


def test_curves_of_a_stack_equal_each_rows(spark):
    rng = np.random.default_rng(4)
    for n in (3, 4, 9):
        x, y = np.cumsum(rng.uniform(0.1, 2, (20, n)), axis=1), rng.normal(size=(20, n))
        at = rng.uniform(-1, x.max() + 1, (20, 7))
        for kind, slopes in curves.SLOPES.items():
            s = slopes(x, y)
            assert np.allclose(s, np.stack([slopes(*row) for row in zip(x, y)])), kind
            for d in range(4):
                k = np.clip((x[:, None, :] <= at[..., None]).sum(axis=2) - 1, 0, n - 2)
                assert (curves._interval(x, at) == k).all()
                assert np.allclose(curves.evaluate(x, y, s, at, d), np.stack([curves.evaluate(*row, d) for row in zip(x, y, s, at)]))
    rows = [(0, [0.0, 1.0, 2.0], [0.0, 1.0, 4.0], [0.5]), (1, [0.0, 2.0], [1.0, 5.0], [1.0, 3.0]), (2, [5.0], [7.0], [0.0, 1.0, 2.0]), (3, None, [1.0], [1.0]), (4, [0.0, 1.0], [0.0, 1.0], []), (5, [0.0, 1.0, 2.0], [0.0, 2.0, 4.0], [1.5])]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>, p array<double>").coalesce(1)
    got = {r.k: r.v for r in df.select("k", curves.spline("x", "y", "p").alias("v")).collect()}
    assert got[1] == [3.0, 7.0] and got[2] == [7.0] * 3 and got[3] is None and got[4] == [] and abs(got[5][0] - 3) < 1e-12 and abs(got[0][0] - 0.3125) < 1e-12
