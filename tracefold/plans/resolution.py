"""Queries of wavelets, sinc tables, dips and smoothing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions import geometry as G
from tracefold.operators import controls, dips, kernels, polar, radial, sinc, smoothing, statistics, wavelets
from tracefold.plans.catalog import S, doubles, query, sampled, table

DT = 0.004
PANEL = ["ensemble_number"]

_ROWS = "SELECT vec_id, CAST(it AS BIGINT) AS it, round(v, 6) AS v FROM"
#: The filter of four taps in closed form, and one level of n samples of ``source``: coarse places first, then details.
_TAPS = "t AS (SELECT * FROM (VALUES (0, (1 + sqrt(3)) / (4 * sqrt(2)), (1 - sqrt(3)) / (4 * sqrt(2))), (1, (3 + sqrt(3)) / (4 * sqrt(2)), -(3 - sqrt(3)) / (4 * sqrt(2))), (2, (3 - sqrt(3)) / (4 * sqrt(2)), (3 + sqrt(3)) / (4 * sqrt(2))), (3, (1 - sqrt(3)) / (4 * sqrt(2)), -(1 + sqrt(3)) / (4 * sqrt(2)))) x(k, c, d))"


def _level(name: str, source: str, n: int) -> str:
    return f"""{name} AS (SELECT vec_id, m + CASE WHEN part = 1 THEN {n // 2} ELSE 0 END AS it, sum(v * CASE WHEN part = 1 THEN d ELSE c END) AS v
  FROM {source} s, t, (SELECT unnest(range({n // 2})) AS m), (VALUES (0), (1)) p(part) WHERE s.it = (2 * m + k) % {n} GROUP BY ALL)"""


def _back(name: str, source: str, n: int) -> str:
    return f"""{name} AS (SELECT vec_id, (2 * (s.it % {n // 2}) + k) % {n} AS it, sum(v * CASE WHEN s.it >= {n // 2} THEN d ELSE c END) AS v FROM {source} s, t GROUP BY ALL)"""


_LEVELS = f"WITH {S}, {_TAPS}, {_level('l1', 's', 64)}, {_level('l2', '(SELECT * FROM l1 WHERE it < 32)', 32)}"


@query(f"{_LEVELS} {_ROWS} (SELECT * FROM l2 UNION ALL SELECT * FROM l1 WHERE it >= 32)")
def wavelet_levels(spark, sf_dir):
    """Coefficients of two levels."""
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), wavelets.transform(4, 2)))


@query(f"{_LEVELS}, {_back('b2', '(SELECT * FROM l2 WHERE it < 16)', 32)}, {_back('b1', 'b2', 64)} {_ROWS} b1")
def wavelet_coarse(spark, sf_dir):
    """Traces from the coarse coefficients of two levels alone."""
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), wavelets.transform(4, 2), wavelets.inverse(4, 2, coarse_only=True)))


@query(f"WITH {S} {_ROWS} s")
def wavelet_round_trip(spark, sf_dir):
    """Three levels of a filter of 20 taps, and back."""
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), wavelets.transform(20, 3), wavelets.inverse(20, 3)))


def _table() -> str:
    rows = ", ".join(f"({k}, {j}, {float(x)!r})" for k, row in enumerate(sinc.table()) for j, x in enumerate(row))
    return f"w AS (SELECT * FROM (VALUES {rows}) x(q, j, c))"


@query(f"""WITH {S}, {_table()}, o AS (SELECT o, 0.001 / 0.004 + o * 0.0025 / 0.004 AS pl FROM (SELECT unnest(range(101)) AS o))
SELECT s.vec_id, o.o AS it, round(sum(s.v * w.c), 6) AS v FROM o JOIN w ON w.q = floor((pl - floor(pl)) * 512 + 0.5) JOIN s ON s.it = floor(pl) + w.j - 3 GROUP BY s.vec_id, o.o""")
def sinc_resampled(spark, sf_dir):
    """101 samples every 2.5 ms, from 1 ms on."""
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), sinc.resample(101, 0.0025, 0.001)))


@query(f"""WITH {S}, w(j, c) AS (VALUES {", ".join(f"({j}, {float(x)!r})" for j, x in enumerate(sinc.coefficients(0.0013 / 0.004)))}), i AS (SELECT unnest(range(64)) AS it)
SELECT s.vec_id, i.it, round(sum(s.v * w.c), 6) AS v FROM i, w, s WHERE s.it = i.it + w.j - 3 GROUP BY s.vec_id, i.it""")
def sinc_shifted(spark, sf_dir):
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), sinc.shift(0.0013)))


def _mean(name: str, source: str, half: int, columns: str) -> str:
    """Running mean over samples of some columns of source (vec_id, label, it), twice."""
    w = f"OVER (PARTITION BY vec_id ORDER BY it ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    means = ", ".join(f"avg({c}) {w} AS {c}" for c in columns.split())
    return f"{name}_1 AS (SELECT * REPLACE ({means}) FROM {source}), {name} AS (SELECT * REPLACE ({means}) FROM {name}_1)"


_DIPS = f"""{S}, g0 AS (SELECT *, abs(v) AS g FROM s), {_mean("g", "g0", 50, "g")}, lv AS (SELECT vec_id, it, v / (g + 1e-30) AS v FROM g),
turn AS (SELECT k, it, cos(2 * pi() * ((k * it) % 66) / 66) AS cs, sin(2 * pi() * ((k * it) % 66) / 66) AS sn, CASE WHEN k IN (0, 33) THEN 1 ELSE 2 END / 66.0::DOUBLE AS wt FROM (SELECT unnest(range(34)) AS k), (SELECT unnest(range(64)) AS it)),
c AS (SELECT vec_id, k, sum(v * cs) AS a, sum(v * sn) AS b FROM lv JOIN turn USING (it) GROUP BY ALL),
f AS (SELECT k, lo / ((1 + lo) * (1 + hi)) AS g, CASE WHEN k = 33 THEN 0 ELSE 2 * pi() * k / 66 END AS w FROM (SELECT k, pow(k / 0.264 / 3, 4) AS lo, pow(k / 0.264 / 20, 4) AS hi FROM (SELECT unnest(range(34)) AS k))),
y AS (SELECT vec_id, it, sum(wt * g * (a * cs + b * sn)) AS low, sum(wt * g * w * (b * cs - a * sn)) AS sl FROM c JOIN f USING (k) JOIN turn USING (k) GROUP BY ALL),
n AS (SELECT y.*, label, lead(low) OVER z AS up, lag(low) OVER z AS dn FROM y JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WINDOW z AS (PARTITION BY label, it ORDER BY vec_id)),
p0 AS (SELECT vec_id, label, it, coalesce(up - low, low - dn, 0) * sl AS x, sl * sl AS a FROM n), {_mean("p", "p0", 2, "x a")}, d AS (SELECT vec_id, it, -x / (a + 1e-30) AS dip FROM p)"""


@query(f"WITH {_DIPS} SELECT vec_id, CAST(it AS BIGINT) AS it, round(dip, 4) AS v FROM d")
def dip_picks(spark, sf_dir):
    """Dip from each trace to the next of its panel, in samples a trace."""
    return sampled(dips.dip_picks(doubles(spark, sf_dir), PANEL, DT), "dip", digits=4)


@query(f"""WITH {_DIPS}, {_table()}, nx AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
h AS (SELECT d.vec_id, nxt, it, unnest([0, 1]) AS side, unnest([it - dip * 0.5, it + dip * 0.5]) AS pl FROM d JOIN nx USING (vec_id) WHERE nxt IS NOT NULL),
e AS (SELECT h.vec_id, h.it, h.side, coalesce(sum(s.v * w.c), 0) AS v FROM h JOIN w ON w.q = floor((pl - floor(pl)) * 512 + 0.5) LEFT JOIN s ON s.vec_id = CASE side WHEN 0 THEN h.vec_id ELSE nxt END AND s.it = floor(pl) + w.j - 3 GROUP BY ALL)
SELECT vec_id, CAST(0 AS BIGINT) AS between_, it, round(v, 4) AS v FROM s UNION ALL SELECT vec_id, 1, CAST(it AS BIGINT), round(sum(v) * 0.5, 4) FROM e GROUP BY vec_id, it""")
def dip_interpolated(spark, sf_dir):
    """A trace inserted after each but its panel's last, along the dips."""
    rows = dips.interpolate_traces(doubles(spark, sf_dir), PANEL, 1, DT)
    out = rows.select(F.col("seq").alias("vec_id"), F.col("between").cast("long").alias("between_"), F.posexplode("data").alias("it", "v"))
    return out.select("vec_id", "between_", F.col("it").cast("long").alias("it"), F.round("v", 4).alias("v"))


def _line(name: str, source: str, key: str, value: str) -> str:
    """The damped system of rows i of each line (before, after: link weights), by recursion forward, then backward: {name}_b (key, i, v)."""
    return f"""{name}_f AS (SELECT {key}, i, n, -after / (1 + after) AS c, {value} / (1 + after) AS x FROM {source} WHERE i = 1
  UNION ALL SELECT s.{key.replace(", ", ", s.")}, s.i, s.n, -s.after / (1 + s.before + s.after + s.before * f.c), (s.{value} + s.before * f.x) / (1 + s.before + s.after + s.before * f.c) FROM {name}_f f JOIN {source} s USING ({key}) WHERE s.i = f.i + 1),
{name}_b AS (SELECT {key}, i, x AS v FROM {name}_f WHERE i = n UNION ALL SELECT f.{key.replace(", ", ", f.")}, f.i, f.x - f.c * b.v FROM {name}_b b JOIN {name}_f f USING ({key}) WHERE f.i = b.i - 1)"""


@query(f"""
WITH RECURSIVE {S}, x AS (SELECT *, 4.0 AS q FROM (SELECT label, it, vec_id, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY label, it) AS n FROM s WINDOW w AS (PARTITION BY label, it ORDER BY vec_id))),
l AS (SELECT label, it, i, n, v, CASE WHEN i = 1 THEN 0 ELSE q END AS before, CASE WHEN i = n THEN 0 ELSE q END AS after FROM x), {_line("a", "l", "label, it", "v")},
r AS (SELECT vec_id, x.it, a_b.v FROM a_b JOIN x USING (label, it, i)),
m AS (SELECT vec_id, it AS i, 63 AS n, CASE WHEN it = 1 THEN v + 2.25 * first ELSE v END AS v, 2.25 AS before, CASE WHEN it = 63 THEN 0 ELSE 2.25 END AS after FROM r JOIN (SELECT vec_id, v AS first FROM r WHERE it = 0) USING (vec_id) WHERE it > 0),
t_f AS (SELECT vec_id, i, n, -after / (1 + before + after) AS c, v / (1 + before + after) AS x FROM m WHERE i = 1
  UNION ALL SELECT s.vec_id, s.i, s.n, -s.after / (1 + s.before + s.after + s.before * f.c), (s.v + s.before * f.x) / (1 + s.before + s.after + s.before * f.c) FROM t_f f JOIN m s USING (vec_id) WHERE s.i = f.i + 1),
t_b AS (SELECT vec_id, i, x AS v FROM t_f WHERE i = n UNION ALL SELECT f.vec_id, f.i, f.x - f.c * b.v FROM t_b b JOIN t_f f USING (vec_id) WHERE f.i = b.i - 1)
SELECT vec_id, CAST(it AS BIGINT) AS it, round(v, 6) AS v FROM r WHERE it = 0 UNION ALL SELECT vec_id, CAST(i AS BIGINT), round(v, 6) FROM t_b""")
def damped_smoothing(spark, sf_dir):
    """Damped least-squares smoothing of each panel, across traces and along them."""
    return sampled(smoothing.damped_panel(doubles(spark, sf_dir), PANEL, 3.0, 4.0))


@query(f"""
WITH RECURSIVE x AS (SELECT user_id, event_id, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(event_id) OVER w AS dn, lead(event_id) OVER w AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, coalesce(CASE WHEN event_id - dn <= 60 THEN 0.5 * pow(80 / 5.19, 2) / pow(event_id - dn, 2) END, 0) AS before, coalesce(CASE WHEN up - event_id <= 60 THEN 0.5 * pow(80 / 5.19, 2) / pow(up - event_id, 2) END, 0) AS after FROM x), {_line("a", "l", "user_id", "v")}
SELECT event_id, round(a_b.v, 4) AS v FROM a_b JOIN x USING (user_id, i)""")
def damped_segments(spark, sf_dir):
    """Damped smoothing of each user's values, unevenly spaced by event_id, in segments that gaps of more than 60 part."""
    link = smoothing.parted(smoothing.spaced_link(80.0), 60)
    return smoothing.smooth_across(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", link).select("event_id", F.round("value", 4).alias("v"))


_SEGMENTS = """o AS (SELECT user_id, event_id, value AS v, coalesce(event_id - lag(event_id) OVER w > 60, false)::INT AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM o), i AS (SELECT *, row_number() OVER (PARTITION BY user_id, q ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, q) AS n FROM g)"""


@query(f"""WITH {_SEGMENTS}, w AS (SELECT k, (4 - abs(k)) / 16.0::DOUBLE AS c FROM (SELECT unnest(range(-3, 4)) AS k))
SELECT i.event_id, round(sum(b.v * w.c), 6) AS v FROM i JOIN w ON true JOIN i b ON b.user_id = i.user_id AND b.q = i.q AND b.i = i.i + w.k GROUP BY i.event_id""")
def triangle_segments(spark, sf_dir):
    return smoothing.smooth_segments(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 60, 3, "triangle").select("event_id", F.round("value", 6).alias("v"))


@query(f"""WITH {_SEGMENTS}
SELECT i.event_id, round(CASE WHEN i.i > 2 AND i.i <= i.n - 2 THEN median(b.v) ELSE any_value(i.v) END, 4) AS v FROM i JOIN i b ON b.user_id = i.user_id AND b.q = i.q AND abs(b.i - i.i) <= 2 GROUP BY i.event_id, i.i, i.n""")
def median_segments(spark, sf_dir):
    return smoothing.smooth_segments(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 60, 2, "median").select("event_id", F.round("value", 4).alias("v"))


@query("""
WITH h AS (SELECT least(CAST(floor(l_extendedprice / 2000) AS BIGINT) + 1, 50) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1),
b AS (SELECT unnest(range(1, 51)) AS bin), s AS (SELECT b.bin, sum(n * exp(-pi() * pow(h.bin - b.bin, 2))) AS v FROM b JOIN h ON abs(h.bin - b.bin) <= 5 GROUP BY b.bin)
SELECT b.bin, round(coalesce(v, 0) / (SELECT sum(v) FROM s), 8) AS share FROM b LEFT JOIN s USING (bin)""")
def smoothed_histogram(spark, sf_dir):
    return statistics.smoothed_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 100_000.0, 50).select("bin", F.round("share", 8).alias("share"))


def _abel(source: str) -> str:
    """Abel transform of the samples of source: weights b0, b1 of samples m + 1 and m decay by (m / i) ** p from place m in to i."""
    pairs = ", ".join(f"({h!r}, {p!r})" for h, p in zip(radial.WEIGHTS, radial.EXPONENTS))
    return f"""e(h, p) AS (SELECT CAST(h AS DOUBLE), CAST(p AS DOUBLE) FROM (VALUES {pairs}) x(h, p)), ms AS (SELECT unnest(range(1, 64)) AS m),
b AS (SELECT m, p, 2 * h * m / ((p + 1) * (p + 2)) * (m + (p + 1 - m) * pow((m + 1) / m, p + 1)) AS b0, -2 * h * m / ((p + 1) * (p + 2)) * (p + 2 + m - (m + 1) * pow((m + 1) / m, p + 1)) AS b1 FROM ms, e),
w0 AS (SELECT i.m AS i, b.m AS m, sum(pow(b.m / i.m, p) * b0) AS c0, sum(pow(b.m / i.m, p) * b1) AS c1 FROM ms i JOIN b ON b.m >= i.m GROUP BY ALL),
w AS (SELECT i, k, sum(c) AS c FROM (SELECT i, m AS k, c1 AS c FROM w0 UNION ALL SELECT i, m + 1, c0 FROM w0 WHERE m < 63 UNION ALL SELECT 0, m, 2 FROM ms UNION ALL SELECT 0, 0, 1) GROUP BY ALL),
ab AS (SELECT vec_id, i AS it, sum(v * c) AS v FROM {source} s JOIN w ON w.k = s.it GROUP BY ALL)"""


@query(f"WITH {S}, {_abel('s')} SELECT vec_id, CAST(it AS BIGINT) AS it, round(v, 5) AS v FROM ab")
def abel_transform(spark, sf_dir):
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), radial.abel()), digits=5)


@query(f"""WITH {S}, {_abel('s')}, k AS (SELECT unnest(range(64)) AS k)
SELECT vec_id, CAST(k AS BIGINT) AS it, round(sum(v * CASE WHEN it IN (0, 63) THEN 1 ELSE 2 END * cos(2 * pi() * ((k * it) % 126) / 126)) / (2 * pi()), 5) AS v FROM ab, k GROUP BY vec_id, k""")
def hankel_zero(spark, sf_dir):
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), radial.hankel(0)), digits=5)


@query(f"""WITH {S}, r AS (SELECT vec_id, it, CASE WHEN it > 0 THEN v / it ELSE 0 END AS v FROM s), {_abel('r')}, k AS (SELECT unnest(range(64)) AS k)
SELECT vec_id, CAST(k AS BIGINT) AS it, round(sum(CASE WHEN it < 63 THEN v * it ELSE 0 END * sin(2 * pi() * ((k * it) % 126) / 126)) / pi(), 5) AS v FROM ab, k GROUP BY vec_id, k""")
def hankel_first(spark, sf_dir):
    return sampled(kernels.apply_kernels(doubles(spark, sf_dir), radial.hankel(1)), digits=5)


@query("""
WITH g AS (SELECT l_linenumber * l_linenumber AS x, floor(l_quantity / 10) * 100 AS y, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
xs AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM g)), ys AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i FROM (SELECT DISTINCT y FROM g)),
p AS (SELECT xs.i AS ix, ys.i AS iy, v FROM g JOIN xs USING (x) JOIN ys USING (y)),
e AS (SELECT event_id, greatest(event_id % 61, 1) AS x, least(event_id % 577, 500) AS y FROM events),
u AS (SELECT e.*, (SELECT greatest(1, least(6, count(*))) FROM xs WHERE xs.x <= e.x) AS ux, (SELECT greatest(1, least(5, count(*))) FROM ys WHERE ys.y <= e.y) AS uy FROM e),
w AS (SELECT u.event_id, ux, uy, (a.x - u.x) / (a.x - b.x) AS wx, (c.y - u.y) / (c.y - d.y) AS wy FROM u JOIN xs a ON a.i = ux JOIN xs b ON b.i = ux - 1 JOIN ys c ON c.i = uy JOIN ys d ON d.i = uy - 1)
SELECT event_id, round(sum(v * CASE WHEN ix = ux THEN 1 - wx ELSE wx END * CASE WHEN iy = uy THEN 1 - wy ELSE wy END), 4) AS v FROM w JOIN p ON p.ix IN (ux, ux - 1) AND p.iy IN (uy, uy - 1) GROUP BY event_id""")
def control_points(spark, sf_dir):
    """Mean prices on an uneven grid of line numbers and quantities, interpolated at each event's place; the last slope in x goes on beyond its last line."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") * F.col("l_linenumber")).alias("x"), (F.floor(F.col("l_quantity") / 10) * 100).alias("y")).agg(F.avg("l_extendedprice").alias("v"))
    places = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 61).alias("x"), (F.col("event_id") % 577).alias("y"))
    return controls.interpolate_controls(places, "x", "y", lines, "v", extrapolate_x="high").select("event_id", F.round("value", 4).alias("v"))


@query("""
WITH s AS (SELECT l_orderkey AS k, count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy
  FROM (SELECT l_orderkey, l_linenumber AS x, l_extendedprice AS y, 1 / pow(20000 * (1 + l_tax), 2) AS w FROM lineitem) GROUP BY l_orderkey HAVING min(x) < max(x)),
f AS (SELECT *, s * sxx - sx * sx AS d FROM s), g AS (SELECT *, (sxx * sy - sx * sxy) / d AS a, (s * sxy - sx * sy) / d AS b FROM f),
h AS (SELECT *, greatest(0, syy - 2 * a * sy - 2 * b * sxy + a * a * s + 2 * a * b * sx + b * b * sxx) / 2 AS x, (n - 2) / 2.0::DOUBLE AS p FROM g)
SELECT l.k AS l_orderkey, round(sqrt(sxx / d), 3) AS sig_a, round(sqrt(s / d), 3) AS sig_b, round(2 * x, 5) AS chi2,
  CASE WHEN n > 2 THEN round(1 - CASE WHEN x < 1e-300 THEN 0 ELSE exp(p * ln(x) - x - lgamma(p + 1)) * list_sum(list_transform(range(200), lambda e: exp(e * ln(x) - lgamma(p + e + 1) + lgamma(p + 1)))) END, 5) END AS q
FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) l LEFT JOIN h ON h.k = l.k""")
def fit_errors(spark, sf_dir):
    """Line through each order's prices: deviations of both coefficients, chi squared and its chance."""
    rows = table(spark, sf_dir, "lineitem").withColumn("sigma", 20_000 * (1 + F.col("l_tax").cast("double"))).withColumns({"x": F.col("l_linenumber").cast("double"), "y": F.col("l_extendedprice").cast("double")})
    out = statistics.weighted_fit(rows, ["l_orderkey"], "y", "x", "sigma")
    return out.select("l_orderkey", F.round("sig_a", 3).alias("sig_a"), F.round("sig_b", 3).alias("sig_b"), F.round("chi2", 5).alias("chi2"), F.round("q", 5).alias("q"))


@query("""
WITH m AS (SELECT event_id, 2.0 + (event_id % 5) * 0.1 AS a1, 1.0 + (event_id % 3) * 0.05 AS b1, 2.2::DOUBLE AS r1, 2.6 + (event_id % 7) * 0.1 AS a2, 1.4 + (event_id % 4) * 0.05 AS b2, 2.4::DOUBLE AS r2, sin(0.05 * (event_id % 12)) AS s FROM events),
p AS (SELECT *, s / a1 AS p FROM m), c AS (SELECT *, sqrt(1 - pow(p * a1, 2)) / a1 AS i1, sqrt(1 - pow(p * a2, 2)) / a2 AS i2, sqrt(1 - pow(p * b1, 2)) / b1 AS j1, sqrt(1 - pow(p * b2, 2)) / b2 AS j2 FROM p),
k AS (SELECT *, r2 * (1 - 2 * b2 * b2 * p * p) - r1 * (1 - 2 * b1 * b1 * p * p) AS a, r2 * (1 - 2 * b2 * b2 * p * p) + 2 * r1 * b1 * b1 * p * p AS b, r1 * (1 - 2 * b1 * b1 * p * p) + 2 * r2 * b2 * b2 * p * p AS c, 2 * (r2 * b2 * b2 - r1 * b1 * b1) AS d FROM c),
g AS (SELECT *, b * i1 + c * i2 AS e, b * j1 + c * j2 AS f, a - d * i1 * j2 AS g, a - d * i2 * j1 AS h FROM k)
SELECT event_id, round(((b * i1 - c * i2) * f - (a + d * i1 * j2) * h * p * p) / (e * f + g * h * p * p), 8) AS r FROM g""")
def reflection_angles(spark, sf_dir):
    """Plane-wave reflection between two halves at angles up to 0.55."""
    e = F.col("event_id")
    lit = lambda v: F.lit(float(v))
    r = G.reflection_pp(2.0 + (e % 5) * 0.1, 1.0 + (e % 3) * 0.05, lit(2.2), 2.6 + (e % 7) * 0.1, 1.4 + (e % 4) * 0.05, lit(2.4), F.sin(0.05 * (e % 12)))
    return table(spark, sf_dir, "events").select("event_id", F.round(r, 8).alias("r"))


_NUMBERED = "n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings), v AS (SELECT n.label, place, it, v FROM s JOIN n USING (vec_id))"


@query(f"""
WITH {S}, {_NUMBERED}, g AS (SELECT label, angle, radius, 12 + sin(2 * pi() / 24 * angle) * radius * 1.5 AS pl, 32 + cos(2 * pi() / 24 * angle) * radius * 1.5 AS ps FROM (SELECT DISTINCT label FROM n), (SELECT unnest(range(24)) AS angle), (SELECT unnest(range(16)) AS radius)),
c AS (SELECT label, angle, radius, floor(pl) + a AS place, floor(ps) + i AS it, (CASE a WHEN 1 THEN pl - floor(pl) ELSE 1 - pl + floor(pl) END) * (CASE i WHEN 1 THEN ps - floor(ps) ELSE 1 - ps + floor(ps) END) AS w FROM g, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(i))
SELECT CAST(c.label AS BIGINT) AS label, CAST(angle AS BIGINT) AS angle, CAST(radius AS BIGINT) AS radius, round(sum(w * coalesce(v, 0)), 5) AS v FROM c LEFT JOIN v ON v.label = c.label AND v.place = c.place AND v.it = c.it GROUP BY c.label, angle, radius""")
def polar_panels(spark, sf_dir):
    """Each panel around its trace 12 and sample 32, at 24 angles and 16 radii."""
    out = polar.to_polar(doubles(spark, sf_dir), PANEL, (12.0, 32.0), 24, 16, 1.5)
    rows = out.select(F.col("ensemble_number").alias("label"), F.col("angle").cast("long").alias("angle"), F.posexplode("data").alias("radius", "v"))
    return rows.select("label", "angle", F.col("radius").cast("long").alias("radius"), F.round("v", 5).alias("v"))
