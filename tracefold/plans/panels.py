"""Queries of the tau-p transforms, with SQL by Fourier sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions import geometry as G
from tracefold.operators import radon
from tracefold.plans.catalog import S, doubles, query, sampled

NT, DT = 64, 0.004
#: Slopes in s/m**2 (parabolic) and s/m (linear): first, step, number.
PARABOLIC = (-2.4e-7, 1.2e-7, 8)
LINEAR = (-3.0e-4, 1.5e-4, 5)
PANEL = ["ensemble_number"]


def _offset():
    return F.pmod("seq", F.lit(24)) * 10.0


def _model_rows(model):
    rows = model.select(F.col("ensemble_number").alias("label"), F.col("ip").cast("long").alias("ip"), F.posexplode("data").alias("it", "v"))
    return rows.select("label", "ip", F.col("it").cast("long").alias("it"), F.round("v", 5).alias("v"))


def _sums(g: str, slopes: tuple) -> str:
    """Spectra c (a - ib of each trace), and their sums u over the panel at each slope."""
    first, step, count = slopes
    return f"""{S}, k AS (SELECT unnest(range(34)) AS k), i AS (SELECT unnest(range(64)) AS it),
turn AS (SELECT k, it, cos(2 * pi() * ((k * it) % 66) / 66) AS cs, sin(2 * pi() * ((k * it) % 66) / 66) AS sn, CASE WHEN k IN (0, 33) THEN 1 ELSE 2 END / 66.0::DOUBLE AS wt FROM k, i),
c AS (SELECT vec_id, label, k, sum(v * cs) AS a, sum(v * sn) AS b FROM s JOIN turn USING (it) GROUP BY ALL),
p AS (SELECT ip, {first}::DOUBLE + ip * {step}::DOUBLE AS p, ip * {step}::DOUBLE AS dp FROM (SELECT unnest(range({count})) AS ip)),
x AS (SELECT vec_id, label, CAST({g} AS DOUBLE) AS g FROM embeddings), n AS (SELECT label, count(*) AS n FROM x GROUP BY label),
h AS (SELECT c.label, k, ip, a, b, 2 * pi() * (k / 0.264) * p * g AS th, 2 * pi() * (k / 0.264) * dp * g AS td FROM c JOIN x USING (vec_id), p),
u AS (SELECT label, k, ip, sum(a * cos(th) + b * sin(th)) AS re, sum(a * sin(th) - b * cos(th)) AS im, sum(cos(td)) AS rr, -sum(sin(td)) AS ri FROM h GROUP BY ALL)"""


def _solved(count: int) -> str:
    """The normal equations of each panel and frequency as real systems, by elimination: z (label, k, ip, re, im)."""
    real = f"list_transform(range({count}), lambda q: rr[abs(q - e) + 1])"
    part = f"list_transform(range({count}), lambda q: sign(q - e) * ri[abs(q - e) + 1])"
    return f"""l AS (SELECT label, k, list(rr / ({count} * n) * CASE WHEN ip = 0 THEN 1.01 ELSE 1 END ORDER BY ip) AS rr, list(ri / ({count} * n) ORDER BY ip) AS ri, list(re / n ORDER BY ip) AS br, list(im / n ORDER BY ip) AS bi FROM u JOIN n USING (label) GROUP BY label, k),
j AS (SELECT label, k, 0 AS i, list_concat(
    list_transform(range({count}), lambda e: list_concat(list_concat({real}, list_transform({part}, lambda y: -y)), [br[e + 1]])),
    list_transform(range({count}), lambda e: list_concat(list_concat({part}, {real}), [bi[e + 1]]))) AS m FROM l
  UNION ALL SELECT label, k, i + 1, list_transform(m, lambda r, q: CASE WHEN q = i + 1 THEN list_transform(r, lambda y: y / r[i + 1]) ELSE list_transform(r, lambda y, w: y - r[i + 1] / m[i + 1][i + 1] * m[i + 1][w]) END) FROM j WHERE i < {2 * count}),
z AS (SELECT label, k, ip, m[ip + 1][{2 * count + 1}] AS re, m[ip + 1 + {count}][{2 * count + 1}] AS im FROM j, p WHERE i = {2 * count})"""


#: Spectra z to the model's samples y.
_MODEL = "y AS (SELECT label, ip, it, sum(wt * (re * cs - im * sn)) AS v FROM z JOIN turn USING (k) GROUP BY ALL)"
_MODEL_ROWS = "SELECT CAST(label AS BIGINT) AS label, CAST(ip AS BIGINT) AS ip, CAST(it AS BIGINT) AS it, round(v, 5) AS v FROM y"


def _back(weight: str) -> str:
    """The model's samples y to traces at their own positions."""
    return f"""f AS (SELECT label, ip, k, sum(v * cs) AS a, sum(v * sn) AS b FROM y JOIN turn USING (it) GROUP BY ALL),
o AS (SELECT x.vec_id, k, a, b, 2 * pi() * (k / 0.264) * p * g AS th FROM f JOIN x USING (label) JOIN p USING (ip)),
q AS (SELECT vec_id, k, sum({weight} * (a * cos(th) - b * sin(th))) AS re, sum({weight} * (-b * cos(th) - a * sin(th))) AS im FROM o GROUP BY ALL)
SELECT vec_id, CAST(it AS BIGINT) AS it, round(sum(wt * (re * cs - im * sn)), 4) AS v FROM q JOIN turn USING (k) GROUP BY vec_id, it"""


_PARABOLA = "pow((vec_id % 24) * 10.0, 2)"
_LINE = "(vec_id % 24) * 10.0"


@query(f"WITH RECURSIVE {_sums(_PARABOLA, PARABOLIC)}, {_solved(PARABOLIC[2])}, {_MODEL} {_MODEL_ROWS}")
def radon_model(spark, sf_dir):
    """Least-squares parabolic Radon transform of each panel."""
    return _model_rows(radon.radon(doubles(spark, sf_dir), PANEL, G.offset_function(1, _offset()), NT, DT, *PARABOLIC))


@query(f"WITH RECURSIVE {_sums(_PARABOLA, PARABOLIC)}, {_solved(PARABOLIC[2])}, {_MODEL}, {_back('1.0 / 8')}")
def radon_round_trip(spark, sf_dir):
    """Traces modelled back from their panel's Radon transform."""
    t, g = doubles(spark, sf_dir), G.offset_function(1, _offset())
    return sampled(radon.inverse_radon(t, radon.radon(t, PANEL, g, NT, DT, *PARABOLIC), PANEL, g, NT, DT, PARABOLIC[2]), digits=4)


_STACKED = "z AS (SELECT label, k, ip, re * 10 AS re, im * 10 AS im FROM u)"


@query(f"WITH {_sums(_LINE, LINEAR)}, {_STACKED}, {_MODEL} {_MODEL_ROWS}")
def slant_stack_fk(spark, sf_dir):
    return _model_rows(radon.slant_stack(doubles(spark, sf_dir), PANEL, G.offset_function(3, _offset()), NT, DT, *LINEAR, dx=10.0))


@query(f"WITH {_sums(_LINE, LINEAR)}, {_STACKED}, {_MODEL}, {_back('k / 0.264 * 1.5e-4')}")
def slant_round_trip_fk(spark, sf_dir):
    t, g = doubles(spark, sf_dir), G.offset_function(3, _offset())
    return sampled(radon.inverse_slant_stack(t, radon.slant_stack(t, PANEL, g, NT, DT, *LINEAR, dx=10.0), PANEL, g, NT, DT, LINEAR[1]), digits=4)


@query(f"""WITH {_sums(_LINE, LINEAR)}, {_STACKED}, {_MODEL},
e AS (SELECT unnest(range(-17, 18)) AS e), w AS (SELECT e, sum(wt * k * cos(2 * pi() * k * e / 66)) / (SELECT sum(wt * k) FROM turn WHERE it = 0) AS c FROM e, turn WHERE it = 0 GROUP BY e),
r AS (SELECT y.label, y.ip, i.it, sum(y.v * w.c) AS v FROM i, w, y WHERE y.it = i.it - w.e GROUP BY ALL),
d AS (SELECT x.vec_id, x.label, ip, i.it, i.it - g * p / 0.004 AS pl FROM x, p, i)
SELECT vec_id, CAST(d.it AS BIGINT) AS it, round(sum(coalesce((1 - (pl - floor(pl))) * f.v, 0) + coalesce((pl - floor(pl)) * n.v, 0)), 3) AS v
FROM d LEFT JOIN r f ON f.label = d.label AND f.ip = d.ip AND f.it = floor(pl) LEFT JOIN r n ON n.label = d.label AND n.ip = d.ip AND n.it = floor(pl) + 1 GROUP BY vec_id, d.it""")
def slant_round_trip_tx(spark, sf_dir):
    """Slant stack, then its inverse in t-x through the rho filter."""
    t, g = doubles(spark, sf_dir), G.offset_function(3, _offset())
    return sampled(radon.filtered_back_projection(t, radon.slant_stack(t, PANEL, g, NT, DT, *LINEAR, dx=10.0), PANEL, g, NT, DT), digits=3)
