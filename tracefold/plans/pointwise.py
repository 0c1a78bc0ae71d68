"""Queries of the row-wise functions: small systems, curves, complex numbers, grids, wavelets; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions import arrays as A
from tracefold.functions import complexes as C
from tracefold.functions import curves, linear
from tracefold.functions import geometry as G
from tracefold.plans.catalog import query, table

#: Two numbers of each event, s and c, that systems and curves are made of.
E = "e AS (SELECT event_id, sin(event_id) AS s, cos(event_id) AS c FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sin("event_id").alias("s"), F.cos("event_id").alias("c"))


def _array(*values) -> Column:
    return F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in values])


def _round(v: Column, name: str, digits: int = 6) -> Column:
    return F.round(v, digits).alias(name)


def _det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


def _cramer(m, b) -> list[str]:
    """SQL of the solution of a system of three."""
    put = lambda j: [[b[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]
    return [f"{_det(put(j))} / {_det(m)}" for j in range(3)]


def _solutions(m, b, prefix: str) -> str:
    """Rounded columns; + 0.0 makes SQL's negative zeros positive, as Spark's rounding does."""
    return ", ".join(f"round({x}, 6) + 0.0 AS {prefix}{j}" for j, x in enumerate(_cramer(m, b)))


def _places(v: Column, prefix: str, n: int = 3) -> list[Column]:
    return [_round(F.get(v, F.lit(j)), f"{prefix}{j}") for j in range(n)]


# --- dense systems ------------------------------------------------------------

_M = [["4 + s", "1", "c"], ["0.5", "5", "s"], ["c", "0.3", "6"]]
_T = [list(r) for r in zip(*_M)]
_B = ["c", "1", "s + 2"]


def _matrix() -> Column:
    s, c = F.col("s"), F.col("c")
    return F.array(_array(4 + s, 1, c), _array(0.5, 5, s), _array(c, 0.3, 6))


def _rhs() -> Column:
    return _array(F.col("c"), 1, F.col("s") + 2)


@query(f"WITH {E} SELECT event_id, {_solutions(_M, _B, 'x')}, {_solutions(_T, _B, 'y')} FROM e")
def dense_solutions(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", linear.solve(_matrix(), _rhs()).alias("x"), linear.solve(_matrix(), _rhs(), transposed=True).alias("y"))
    return e.select("event_id", *_places(F.col("x"), "x"), *_places(F.col("y"), "y"))


@query(f"""
WITH {E} SELECT event_id, {", ".join(_solutions(_M, ["1" if i == j else "0" for i in range(3)], f"i{j}") for j in range(3))}, {_solutions(_M, ["s", "c", "1"], "p")}, {_solutions(_M, ["2", "s", "c"], "q")} FROM e""")
def dense_inverses(spark, sf_dir):
    s, c = F.col("s"), F.col("c")
    two = F.array(_array(s, 2), _array(c, s), _array(1, c))
    e = _events(spark, sf_dir).select("event_id", linear.inverse(_matrix()).alias("i"), linear.inverse_times(_matrix(), two).alias("p"))
    at = lambda m, i, j, name: _round(F.get(F.get(F.col(m), F.lit(i)), F.lit(j)), name)
    return e.select("event_id", *[at("i", i, j, f"i{j}{i}") for j in range(3) for i in range(3)], *[at("p", i, 0, f"p{i}") for i in range(3)], *[at("p", i, 1, f"q{i}") for i in range(3)])


@query(f"""
WITH {E}, b AS (SELECT event_id, c AS b0, s AS b1, 1 + c AS b2, 2 + s AS b3 FROM e)
SELECT event_id, round((7 * b0 + 4 * b1 + b2 - 2 * b3) / 10, 6) AS intercept, round((3 * b3 + b2 - b1 - 3 * b0) / 10, 6) AS slope FROM b""")
def least_squares_lines(spark, sf_dir):
    """Lines through four points by the generalised inverse."""
    return _lines(spark, sf_dir, linear.least_squares)


def _lines(spark, sf_dir, fit):
    s, c = F.col("s"), F.col("c")
    x = fit(F.array(*[_array(1, k) for k in range(4)]), _array(c, s, 1 + c, 2 + s))
    e = _events(spark, sf_dir).select("event_id", x.alias("x"))
    return e.select("event_id", _round(F.get("x", F.lit(0)), "intercept"), _round(F.get("x", F.lit(1)), "slope"))


_LINES = f"""
WITH {E}, p AS (SELECT event_id, unnest([0, 1, 2, 3]) AS x, unnest([c, s, 1 + c, 2 + s]) AS y FROM e)
SELECT event_id, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM p GROUP BY event_id"""


@query(_LINES)
def orthogonal_lines(spark, sf_dir):
    return _lines(spark, sf_dir, linear.orthogonal_fit)


@query(_LINES)
def conjugate_gradient_lines(spark, sf_dir):
    return _lines(spark, sf_dir, lambda a, b: linear.conjugate_gradient(a, b, 6))


@query(f"""
WITH {E}, h AS (SELECT event_id, (3 + s + c) / 2 AS m, sqrt(pow((3 + s - c) / 2, 2) + 1) AS r, 3 + s AS a FROM e),
v AS (SELECT event_id, m, r, 1 / sqrt(1 + pow(m + r - a, 2)) AS x, (m + r - a) / sqrt(1 + pow(m + r - a, 2)) AS y FROM h)
SELECT event_id, round(m + r, 6) AS first, round(m - r, 6) AS second, round(abs(x), 6) AS v0, round(abs(y), 6) AS v1 FROM v""")
def symmetric_eigen(spark, sf_dir):
    s, c = F.col("s"), F.col("c")
    m = F.array(_array(3 + s, 1), _array(1, c))
    e = _events(spark, sf_dir).select("event_id", linear.eigenvalues(m).alias("w"), F.get(linear.eigenvectors(m), F.lit(0)).alias("v"))
    at = lambda a, k: F.get(F.col(a), F.lit(k))
    return e.select("event_id", _round(at("w", 0), "first"), _round(at("w", 1), "second"), _round(F.abs(at("v", 0)), "v0"), _round(F.abs(at("v", 1)), "v1"))


@query(f"""
WITH {E}, n AS (SELECT event_id, pow(2 + s, 2) + 0.25 AS a, (2 + s) * c + 1.5 AS b, c * c + 9 AS d FROM e),
r AS (SELECT event_id, (a + d) / 2 AS m, sqrt(pow((a - d) / 2, 2) + b * b) AS r FROM n)
SELECT event_id, round(sqrt(m + r), 6) AS first, round(sqrt(m - r), 5) AS second FROM r""")
def singular_pairs(spark, sf_dir):
    s, c = F.col("s"), F.col("c")
    e = _events(spark, sf_dir).select("event_id", linear.singular_values(F.array(_array(2 + s, c), _array(0.5, 3))).alias("w"))
    return e.select("event_id", _round(F.get("w", F.lit(0)), "first"), _round(F.get("w", F.lit(1)), "second", 5))


_TOEPLITZ = [["4 + s", "1", "c"], ["1", "4 + s", "1"], ["c", "1", "4 + s"]]
_BANDED = [["4", "s", "0"], ["c", "5", "1"], ["0", "s", "6"]]
_POWERS = [["1", "1", "1"], ["s", "2", "c + 4"], ["s * s", "4", "pow(c + 4, 2)"]]


@query(f"WITH {E} SELECT event_id, {_solutions(_TOEPLITZ, _B, 't')}, {_solutions(_BANDED, _B, 'd')}, {_solutions(_POWERS, _B, 'v')} FROM e")
def structured_systems(spark, sf_dir):
    """Toeplitz, tridiagonal and Vandermonde systems of three."""
    s, c = F.col("s"), F.col("c")
    e = _events(spark, sf_dir).select(
        "event_id", curves.toeplitz_solve(_array(4 + s, 1, c), _rhs()).alias("t"), curves.tridiagonal_solve(_array(0, c, s), _array(4, 5, 6), _array(s, 1, 0), _rhs()).alias("d"), curves.vandermonde_solve(_array(s, 2, c + 4), _rhs()).alias("v")
    )
    return e.select("event_id", *[x for k in "tdv" for x in _places(F.col(k), k)])


# --- curves -------------------------------------------------------------------


@query(f"""
WITH {E}, k AS (SELECT event_id, s, (s - 1) AS d0, (2 - s) / 2 AS d1 FROM e), n AS (SELECT event_id, s, d1 - d0 AS m FROM k),
q AS (SELECT event_id, 1 - s AS d0, c - 1 AS d1, 3 - c AS d2, s AS y0, 1.0 AS y1, c AS y2 FROM e),
a AS (SELECT *, (abs(d2 - d1) * d0 + abs(d1 - d0) * d1) / (abs(d2 - d1) + abs(d1 - d0)) AS a1, (abs(d2 - d1) * d1 + abs(d1 - d0) * d2) / (abs(d2 - d1) + abs(d1 - d0)) AS a2,
  CASE WHEN d0 * d1 > 0 THEN 2 * d0 * d1 / (d0 + d1) ELSE 0 END AS h1, CASE WHEN d1 * d2 > 0 THEN 2 * d1 * d2 / (d1 + d2) ELSE 0 END AS h2 FROM q)
SELECT event_id, round(m * 0.125 / 6 + (s - m / 6) * 0.5 + 0.5, 6) AS natural, round(m * 0.5, 6) AS natural_bend, round((y1 + y2) / 2 + (a1 - a2) / 8, 6) AS akima, round(1.5 * d1 - (a1 + a2) / 4, 6) AS akima_slope,
  round((y1 + y2) / 2 + (h1 - h2) / 8, 6) AS monotone FROM n JOIN a USING (event_id)""")
def curve_middles(spark, sf_dir):
    """Natural, Akima and monotone curves, and a derivative of each kind, half way between two knots."""
    s, c = F.col("s"), F.col("c")
    three, four = (_array(0, 1, 3), _array(1, s, 2), _array(0.5)), (_array(0, 1, 2, 3), _array(s, 1, c, 3), _array(1.5))
    found = {"natural": curves.spline(*three), "natural_bend": curves.spline(*three, derivative=2), "akima": curves.spline(*four, kind="akima"), "akima_slope": curves.spline(*four, kind="akima", derivative=1), "monotone": curves.spline(*four, kind="monotone")}
    e = _events(spark, sf_dir).select("event_id", *[v.alias(k) for k, v in found.items()])
    return e.select("event_id", *[_round(F.get(k, F.lit(0)), k) for k in found])


@query("""
WITH g(j, i, z) AS (SELECT j, i, i * i + 3.0 * j + i * j FROM range(4) a(j), range(5) b(i)),
p AS (SELECT event_id, greatest(0, least(4, (3 * sin(event_id) + 1) / 0.5 + 1)) AS x, greatest(0, least(3, 2 + 2 * cos(event_id))) AS y FROM events),
c AS (SELECT *, least(floor(x), 3) AS i, least(floor(y), 2) AS j FROM p)
SELECT c.event_id, round(sum(g.z * CASE WHEN g.i = c.i THEN 1 - (x - c.i) ELSE x - c.i END * CASE WHEN g.j = c.j THEN 1 - (y - c.j) ELSE y - c.j END), 6) AS v
FROM c JOIN g ON g.i IN (c.i, c.i + 1) AND g.j IN (c.j, c.j + 1) GROUP BY c.event_id""")
def bilinear_lookup(spark, sf_dir):
    grid = F.lit([[float(i * i + 3 * j + i * j) for i in range(5)] for j in range(4)])
    e = _events(spark, sf_dir)
    return e.select("event_id", _round(A.bilinear(grid, 3 * F.col("s") + 1, F.col("c"), 0.5, -0.5, 0.5, -1.0), "v"))


# --- complex numbers, vectors -------------------------------------------------


@query(f"""
WITH {E}, k AS (SELECT event_id, 2 + s AS ar, c AS ai, c AS br, 2 - s AS bi FROM e),
g AS (SELECT *, sqrt(ar * ar + ai * ai) AS m, atan2(ai, ar) AS p, br * br + bi * bi AS d FROM k)
SELECT event_id, round(ar - br, 6) AS sub_r, round((ar * br + ai * bi) / d, 6) AS div_r, round((ai * br - ar * bi) / d, 6) AS div_i, round(sqrt(m) * cos(p / 2), 6) AS sqrt_r, round(sqrt(m) * sin(p / 2), 6) AS sqrt_i,
  round(ln(m), 6) AS log_r, round(p, 6) AS log_i, round(exp(br * ln(m) - bi * p) * cos(br * p + bi * ln(m)), 5) AS pow_r, round(cos(ar) * (exp(ai) + exp(-ai)) / 2, 6) AS cos_r, round(cos(ar) * (exp(ai) - exp(-ai)) / 2, 6) AS sin_i,
  round(cos(ai) * (exp(ar) + exp(-ar)) / 2, 5) AS cosh_r, round(sin(ai) * (exp(ar) + exp(-ar)) / 2, 5) AS sinh_i, round(-ai, 6) AS conj_i, round(-ar, 6) AS neg_r, round(ar * 3 + br, 6) AS times_r FROM g""")
def complex_functions(spark, sf_dir):
    a, b = C.complex_(2 + F.col("s"), F.col("c")), C.complex_(F.col("c"), 2 - F.col("s"))
    q = C.div(a, b)
    parts = {
        "sub_r": C.sub(a, b)["r"], "div_r": q["r"], "div_i": q["i"], "sqrt_r": C.sqrt(a)["r"], "sqrt_i": C.sqrt(a)["i"], "log_r": C.log(a)["r"], "log_i": C.log(a)["i"], "cos_r": C.cos(a)["r"], "sin_i": C.sin(a)["i"],
        "conj_i": C.conj(a)["i"], "neg_r": C.neg(a)["r"], "times_r": C.add(C.times(a, 3.0), b)["r"],
    }
    wide = {"pow_r": C.power(a, b)["r"], "cosh_r": C.cosh(a)["r"], "sinh_i": C.sinh(a)["i"]}
    return _events(spark, sf_dir).select("event_id", *[_round(v, k) for k, v in parts.items()], *[_round(v, k, 5) for k, v in wide.items()])


@query("""
WITH s AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm, round(sum(2.5 * v + v), 5) AS axpy_sum, round(sum(abs(-3 * v)), 5) AS scaled FROM s GROUP BY vec_id""")
def vector_sums(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", _round(A.norm2(x), "norm"), _round(A._sum(A.axpy(2.5, x, x)), "axpy_sum", 5), _round(A.abs_sum(A.scale(-3, x)), "scaled", 5))


# --- survey grids, headers, media ---------------------------------------------


@query("""
WITH c AS (SELECT event_id, event_id % 45 AS ib, event_id % 13 AS ic FROM events), i AS (SELECT *, ib BETWEEN 1 AND 41 AND ic BETWEEN 1 AND 11 AS ok, (ib - 1) * 25.0 AS gx, (ic - 1) * 50.0 AS gy FROM c)
SELECT event_id, CASE WHEN ok THEN ib + (ic - 1) * 41 ELSE -2147483645 END AS cdp, CASE WHEN ok THEN ib ELSE -2147483645 END AS back_ib, CASE WHEN ok THEN ic ELSE -2147483645 END AS back_ic,
  round(100 + gx * 0.8 - gy * 0.6, 6) AS x, round(50 + gx * 0.6 + gy * 0.8, 6) AS y, round(gx, 6) AS gx FROM i""")
def grid_centres(spark, sf_dir):
    grid = G.Grid.from_corners((100.0, 50.0), (900.0, 650.0), (-200.0, 450.0), 25.0, 50.0)
    ib, ic = F.col("event_id") % 45, F.col("event_id") % 13
    cdp, (x, y) = grid.cdp(ib, ic), grid.centre(ib, ic)
    back, gx = grid.cell_of_cdp(cdp), grid.to_grid(x, y)[0]
    return table(spark, sf_dir, "events").select("event_id", cdp.alias("cdp"), back[0].alias("back_ib"), back[1].alias("back_ic"), _round(x, "x"), _round(y, "y"), _round(gx, "gx"))


@query("""
WITH o AS (SELECT event_id, 100 * sin(event_id) AS h, event_id % 4 AS trid FROM events)
SELECT event_id, round((h - 5) * (h - 5), 4) AS parabola, round(sqrt(900 + (h - 5) * (h - 5)), 6) AS hyperbola, round(h - 5, 6) AS line, round(abs(h - 5), 6) AS both, round(sqrt(900 + (h - 5) * (h - 5)) - 30, 6) AS static,
  round(CASE WHEN h <= 10 THEN 1.0 WHEN h >= 60 THEN 0.0 ELSE (60 - h) / 50 END, 6) AS weight, trid <= 1 AS seismic, (CASE WHEN h < -50 THEN 0 WHEN h < 0 THEN 1 WHEN h < 50 THEN 2 ELSE 3 END) AS below FROM o""")
def moveout_functions(spark, sf_dir):
    h = 100 * F.sin("event_id")
    kinds = [_round(G.offset_function(k, h, 5.0, 30.0), name, 4 if k == 1 else 6) for k, name in enumerate(("parabola", "hyperbola", "line", "both", "static"), 1)]
    return table(spark, sf_dir, "events").select("event_id", *kinds, _round(G.ramp_weight(h, 10.0, 60.0), "weight"), G.is_seismic(F.col("event_id") % 4).alias("seismic"), A.upper_bound(F.lit([-50.0, 0.0, 50.0]), h).alias("below"))


@query("""
WITH e AS (SELECT event_id, 2.5 + (event_id % 7) * 0.1 AS vp, 1.2 + (event_id % 5) * 0.05 AS vs, 0.05 + (event_id % 3) * 0.1 AS eps, 0.02 + (event_id % 4) * 0.05 AS delta, 0.01 + (event_id % 6) * 0.03 AS gamma, 2 + 0.1 * sin(event_id) AS rho FROM events)
SELECT event_id, round(vp, 6) AS vp, round(vs, 6) AS vs, round(eps, 6) AS eps, round(delta, 6) AS delta, round(gamma, 6) AS gamma, round(vs * sqrt(1 + 2 * gamma), 6) AS sh_across, round((2.4 * 3.5 - rho * vp) / (2.4 * 3.5 + rho * vp), 6) AS reflected FROM e""")
def elastic_round_trip(spark, sf_dir):
    """Thomsen parameters through stiffnesses and back, the SH velocity across the axis, and reflection at normal incidence."""
    e = F.col("event_id")
    vp, vs = 2.5 + (e % 7) * 0.1, 1.2 + (e % 5) * 0.05
    c = G.thomsen_to_stiffness(vp, vs, 0.05 + (e % 3) * 0.1, 0.02 + (e % 4) * 0.05, 0.01 + (e % 6) * 0.03)
    back = G.stiffness_to_thomsen(c)
    reflected = G.reflection_pp(vp, vs, 2 + 0.1 * F.sin(e), F.lit(3.5), F.lit(2.0), F.lit(2.4), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", *[_round(back[k], k) for k in ("vp", "vs", "eps", "delta", "gamma")], _round(G.phase_velocity(c, F.lit(1.0), "SH"), "sh_across"), _round(reflected, "reflected"))


@query("""
WITH k AS (SELECT k, k * 0.004 AS t, (k - 31) * 0.004 / 0.05 AS r FROM (SELECT unnest(range(63)) AS k)), w AS (SELECT *, 1 / (sqrt(2) * pi() * 20) AS s FROM k)
SELECT k AS it, round(2 * pow(t, 2.0) * exp(-15 * t) * cos(40 * pi() * t + 0.3), 9) + 0.0 AS berlage, round(exp(-pow(t - 0.05, 2) / (2 * s * s)) / (s * sqrt(2 * pi())), 6) AS gauss,
  round(-(t - 0.05) * exp(-pow(t - 0.05, 2) / (2 * s * s)) / (pow(s, 3) * sqrt(2 * pi())), 4) + 0.0 AS slope, round(3 * (1 - 2 * pow(2.5 * r, 2)) * exp(-pow(2.5 * r, 2)) * (1 - 0.4 * r), 9) + 0.0 AS ricker,
  CASE WHEN k = 7 THEN 1.0 ELSE 0.0 END AS spike, 1.0 AS unit, 0.0 AS zero FROM w""".replace("1.0 ELSE 0.0 END", "1.0::DOUBLE ELSE 0.0::DOUBLE END").replace("1.0 AS unit, 0.0 AS zero", "1.0::DOUBLE AS unit, 0.0::DOUBLE AS zero"))
def source_wavelets(spark, sf_dir):
    n, dt = 63, 0.004
    parts = {"berlage": A.berlage(n, dt, 20.0, 2.0, 2.0, 15.0, 0.3), "gauss": A.gaussian(n, dt, 20.0), "slope": A.gaussian_derivative(n, dt, 20.0), "ricker": A.distorted_ricker(32, dt, 0.05, 3.0, 0.2), "spike": A.spike_wavelet(n, 7), "unit": A.unit_wavelet(n), "zero": A.zero_wavelet(n)}
    one = spark.range(1).select(F.posexplode(F.arrays_zip(*[v.alias(k) for k, v in parts.items()])).alias("it", "w"))
    digits = {"gauss": 6, "slope": 4}
    return one.select(F.col("it").cast("long").alias("it"), *[_round(F.col("w")[k], k, digits.get(k, 9)) for k in parts])


@query("""
WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS it, CAST(unnest(embedding) AS DOUBLE) AS v, 10 + vec_id % 5 AS live FROM embeddings)
SELECT vec_id, it, round(CASE WHEN it < live THEN 0.0 WHEN it < live + 4 THEN v * (it - live + 1) / 5.0 ELSE v END, 6) AS muted, round(greatest(-0.5, least(0.5, v)), 6) AS clipped FROM s""")
def muted_samples(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    both = F.arrays_zip(A.mute(x, 10 + F.col("vec_id") % 5, 4).alias("m"), A.clip(x, -0.5, 0.5).alias("c"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(both).alias("it", "w"))
    return out.select("vec_id", F.col("it").cast("long").alias("it"), _round(F.col("w.m"), "muted"), _round(F.col("w.c"), "clipped"))
