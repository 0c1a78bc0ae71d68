"""Registry of the trace-analytics queries and their SQL counterparts.

The ``embeddings`` table stands for a trace collection: vec_id orders the
traces, label is the ensemble, the vector holds the samples.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import arrays as A
from tracefold.functions import complexes as C
from tracefold.functions import geometry as G
from tracefold.operators import cross, kernels, statistics
from tracefold.schema import vectors_as_traces
from tracefold.sources import synthetics

#: Samples of the trace analogue in SQL.
S = "s AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS it, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_as_traces(table(spark, sf_dir, "embeddings"))


def doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces with double samples, so that operators keep them."""
    return traces(spark, sf_dir).withColumn("data", F.col("data").cast("array<double>"))


def sampled(df: DataFrame, data: str = "data", digits: int = 6, key: str = "seq", name: str = "vec_id") -> DataFrame:
    return df.select(F.col(key).alias(name), F.posexplode(data).alias("it", "v")).select(name, F.col("it").cast("long").alias("it"), F.round(F.col("v").cast("double"), digits).alias("v"))


# --- sources ------------------------------------------------------------------


@query("""
SELECT tr.i AS trace_id, t.j AS it, CASE WHEN tr.i IN (8, 24) AND t.j IN (15, 47) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v
FROM (SELECT unnest(range(32)) AS i) tr, (SELECT unnest(range(64)) AS j) t""")
def spike_samples(spark, sf_dir):
    return sampled(synthetics.spike(spark), name="trace_id")


@query("""
WITH p(dip) AS (VALUES (0.0), (4.0), (8.0)), hit AS (
  SELECT i, CAST(31 - (15 - i) * dip / 4.0 AS DOUBLE) AS fit FROM (SELECT unnest(range(32)) AS i) tr, p WHERE i BETWEEN 3 AND 27
), part AS (
  SELECT i, CAST(floor(fit) AS BIGINT) AS it, 1 - (fit - floor(fit)) AS v FROM hit WHERE fit >= 0 AND fit < 63
  UNION ALL SELECT i, CAST(floor(fit) AS BIGINT) + 1, fit - floor(fit) FROM hit WHERE fit >= 0 AND fit < 63
)
SELECT i AS trace_id, it, round(sum(v), 6) AS v FROM part GROUP BY ALL HAVING sum(v) <> 0""")
def plane_samples(spark, sf_dir):
    return sampled(synthetics.plane(spark), name="trace_id").where("v <> 0")


@query("""
WITH p(q, dip) AS (VALUES (0, 0.0), (1, 4.0), (2, 8.0)), hit AS (
  SELECT i, q, CAST(31 - (15 - i) * dip / 4.0 AS DOUBLE) AS fit, CASE WHEN i IN (3, 27) THEN 6.0 WHEN i IN (4, 26) THEN 3.0 ELSE 1.0 END AS share FROM (SELECT unnest(range(32)) AS i) tr, p WHERE i BETWEEN 3 AND 27
), part AS (
  SELECT i, CAST(floor(fit) AS BIGINT) AS it, (1 - (fit - floor(fit))) / pow(share, 3 - q) AS v FROM hit WHERE fit >= 0 AND fit < 63
  UNION ALL SELECT i, CAST(floor(fit) AS BIGINT) + 1, (fit - floor(fit)) / pow(share, 3 - q) FROM hit WHERE fit >= 0 AND fit < 63
)
SELECT i AS trace_id, it, round(sum(v), 6) AS v FROM part GROUP BY ALL HAVING sum(v) <> 0""")
def plane_tapered(spark, sf_dir):
    return sampled(synthetics.plane(spark, taper=True), name="trace_id").where("v <> 0")


@query()
def synlv_midpoints(spark, sf_dir):
    return sampled(synthetics.synlv(spark), digits=5, name="trace_id")


@query()
def synlv_shots_gradient(spark, sf_dir):
    return sampled(synthetics.synlv(spark, nxm=0, nxs=11, nxo=3, dvdz=0.4, dvdx=0.1), digits=5, name="trace_id")


@query("""
SELECT i AS trace_id, CAST(i AS DOUBLE) * 0.05 AS x, i + 1 AS ensemble_number, 1 AS ensemble_trace_number, 0.0::DOUBLE AS offset_
FROM (SELECT unnest(range(101)) AS i)""")
def synlv_headers(spark, sf_dir):
    return synthetics.synlv(spark).select("trace_id", F.col("mid_point.x").alias("x"), "ensemble_number", F.col("ensemble_trace_number").cast("int").alias("ensemble_trace_number"), F.col("offset").alias("offset_"))


# --- per-trace filters --------------------------------------------------------


def _recursive(name: str, source: str, high: bool, f_pass: float, f_stop: float, a_pass: float, a_stop: float, length: int = 64) -> str:
    """Zero-phase Butterworth of the samples of ``source``: its impulse response from the product of its sections, convolved forward, then backward."""
    top = "w3 * w3" if not high else "4"
    first = ("2 / (w3 + 2)", "-2 / (w3 + 2)") if high else ("w3 / (w3 + 2)", "w3 / (w3 + 2)")
    second = "-2" if high else "2"
    return f"""{name}_o AS (SELECT *, abs(ln(dp / ds) / ln(wp / ws)) / 2 AS r FROM (SELECT 2 * tan(pi() * {f_pass}) AS wp, 2 * tan(pi() * {f_stop}) AS ws, 1 / {a_pass} - 1 AS dp, 1 / {a_stop} - 1 AS ds)),
{name}_d AS (SELECT 1 + CAST(floor(r) AS INT) AS n, wp * pow(dp, {"1" if high else "-1"} / (2 * r)) AS w3 FROM {name}_o),
{name}_s AS (SELECT k, w3, {top} / d AS g, (2 * w3 * w3 - 8) / d AS a1, (4 - 4 * w3 * sn + w3 * w3) / d AS a2 FROM (SELECT k, w3, sin(pi() * (2 * k + 1) / (2 * n)) AS sn, 4 + 4 * w3 * sin(pi() * (2 * k + 1) / (2 * n)) + w3 * w3 AS d FROM {name}_d, (SELECT unnest(range(40)) AS k) WHERE k < n // 2)),
{name}_p AS (SELECT CAST(0 AS BIGINT) AS k, CASE WHEN n % 2 = 1 THEN [{first[0]}, {first[1]}] ELSE [1.0::DOUBLE] END AS b, CASE WHEN n % 2 = 1 THEN [1.0::DOUBLE, (w3 - 2) / (w3 + 2)] ELSE [1.0::DOUBLE] END AS a FROM {name}_d
  UNION ALL SELECT p.k + 1, list_transform(range(len(p.b) + 2), lambda e: q.g * (coalesce(p.b[e + 1], 0) + {second} * CASE WHEN e > 0 THEN coalesce(p.b[e], 0) ELSE 0 END + CASE WHEN e > 1 THEN coalesce(p.b[e - 1], 0) ELSE 0 END)),
    list_transform(range(len(p.a) + 2), lambda e: coalesce(p.a[e + 1], 0) + q.a1 * CASE WHEN e > 0 THEN coalesce(p.a[e], 0) ELSE 0 END + q.a2 * CASE WHEN e > 1 THEN coalesce(p.a[e - 1], 0) ELSE 0 END) FROM {name}_p p JOIN {name}_s q ON q.k = p.k),
{name}_c AS (SELECT b, a FROM {name}_p JOIN {name}_d ON k = n // 2),
{name}_r AS (SELECT 0 AS t, CAST([] AS DOUBLE[]) AS h FROM {name}_c UNION ALL SELECT t + 1, list_append(h, coalesce(b[t + 1], 0) - coalesce(list_sum(list_transform(range(1, least(t, len(a) - 1) + 1), lambda e: a[e + 1] * h[t + 1 - e])), 0)) FROM {name}_r, {name}_c WHERE t < {length}),
{name}_h AS (SELECT unnest(range({length})) AS e, unnest(h) AS h FROM {name}_r WHERE t = {length}),
{name}_f AS (SELECT vec_id, it + e AS it, sum(v * h) AS v FROM {source}, {name}_h WHERE it + e < {length} GROUP BY ALL),
{name} AS (SELECT vec_id, it - e AS it, sum(v * h) AS v FROM {name}_f, {name}_h WHERE it - e BETWEEN 0 AND 63 GROUP BY ALL)"""


_LOW_CUT = _recursive("lc", "s", True, 0.075, 0.05, 0.95, 0.05)
_HIGH_CUT = _recursive("hc", "lc", False, 0.2, 0.275, 0.95, 0.05)


@query(f"WITH RECURSIVE {S}, {_LOW_CUT}, {_HIGH_CUT} SELECT vec_id, CAST(it AS BIGINT) AS it, round(v, 5) AS v FROM hc")
def bandpass_samples(spark, sf_dir):
    return sampled(kernels.butterworth_bandpass(doubles(spark, sf_dir)), digits=5)


@query(f"""
WITH RECURSIVE {S}, {_LOW_CUT}, {_HIGH_CUT}
SELECT vec_id AS trace_id, CAST(any_value(label) AS BIGINT) AS ensemble_number, round(sqrt(avg(v * v)), 4) AS rms, round(max(abs(v)), 4) AS peak FROM hc JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY vec_id""")
def bandpass_rms(spark, sf_dir):
    out = kernels.butterworth_bandpass(doubles(spark, sf_dir))
    return out.select(F.col("trace_id"), F.col("ensemble_number"), F.round(A.rms("data"), 4).alias("rms"), F.round(A.abs_max("data"), 4).alias("peak"))


def _kernel_query(name: str, *ks: kernels.Kernel, sql: str | None = None) -> None:
    def run(spark, sf_dir):
        out = kernels.apply_kernels(doubles(spark, sf_dir), *ks)
        return sampled(out, digits=5)

    run.__name__ = name
    query(sql)(run)


#: From the filtered samples y (vec_id, it, v).
_ROWS = "SELECT vec_id, CAST(it AS BIGINT) AS it, round(v, 5) AS v FROM y"


def _weighted(weight: str) -> str:
    """A kernel that is a sum of samples; weight: of sample j in output it."""
    return f"WITH {S}, i AS (SELECT unnest(range(64)) AS it), y AS (SELECT s.vec_id, i.it, sum(s.v * {weight}) AS v FROM s, (SELECT it AS j FROM i) j, i WHERE s.it = j.j GROUP BY ALL) {_ROWS}"


def _spectral(re: str, im: str, gates: str = "(VALUES (0, 0, 0, 0, 0))", share: str = "1") -> str:
    """A kernel on the spectrum of 66 places; re, im: the new spectrum of a, b at frequency f; share: what a gate g, of corners c0 to c3, gets at time t."""
    return f"""
WITH {S}, k AS (SELECT k, k / (66 * 0.004) AS f FROM (SELECT unnest(range(34)) AS k)), g(g, c0, c1, c2, c3) AS {gates},
c AS (SELECT vec_id, k, f, sum(v * cos(2 * pi() * k * it / 66)) AS a, sum(v * sin(2 * pi() * k * it / 66)) AS b FROM s, k GROUP BY ALL),
d AS (SELECT vec_id, g, k, {re} AS a, {im} AS b FROM c, g),
i AS (SELECT it, it * 0.004 AS t FROM (SELECT unnest(range(64)) AS it)),
y AS (SELECT vec_id, it, sum({share} * CASE WHEN k IN (0, 33) THEN 1 ELSE 2 END * (d.a * cos(2 * pi() * k * it / 66) + d.b * sin(2 * pi() * k * it / 66))) / 66 AS v FROM d, i GROUP BY ALL) {_ROWS}"""


_BAND = "CASE WHEN f <= c0 OR f >= c3 THEN 0 WHEN f < c1 THEN pow(sin(0.5 * pi() * (f - c0) / (c1 - c0)), 2) WHEN f > c2 THEN pow(sin(0.5 * pi() * (c3 - f) / (c3 - c2)), 2) ELSE 1 END"
_ROOT = "CASE WHEN k = 0 THEN 0 ELSE 1 / sqrt(2 * pi() * f) END * sqrt(0.5)"
_FADE = "CASE g WHEN 0 THEN 1 - greatest(0, least(1, (t - 0.05) / 0.15)) ELSE greatest(0, least(1, (t - 0.05) / 0.15)) END"
_GAUSS = "exp(-ln(2) * pow(2 * (i.it - j) / 5.0, 2)) / (SELECT sum(exp(-ln(2) * pow(2 * (i.it - m) / 5.0, 2))) FROM (SELECT unnest(range(64)) AS m))"
_SHIFT = "CASE WHEN abs(i.it - 0.325 - j) < 4 THEN sin(pi() * (i.it - 0.325 - j)) / (pi() * (i.it - 0.325 - j)) * pow(cos(pi() * (i.it - 0.325 - j) / 8), 2) ELSE 0 END"
_SAVITZKY = f"""
WITH {S}, w(k, c) AS (VALUES (-3, -2), (-2, 3), (-1, 6), (0, 7), (1, 6), (2, 3), (3, -2)), i AS (SELECT unnest(range(64)) AS it),
y AS (SELECT s.vec_id, i.it, sum(s.v * w.c) / 21 AS v FROM i, w, s WHERE s.it = greatest(0, least(63, i.it + w.k)) GROUP BY ALL) {_ROWS}"""

_kernel_query("polygonal_filter", kernels.frequency_filter(), sql=_spectral(f"a * {_BAND}", f"b * {_BAND}", "(VALUES (0, 12.5, 18.75, 56.25, 62.5))"))
_kernel_query("time_varying_bandpass", kernels.time_varying_bandpass([0.05, 0.2], [[5, 10, 60, 80], [5, 10, 30, 40]]), sql=_spectral(f"a * {_BAND}", f"b * {_BAND}", "(VALUES (0, 5, 10, 60, 80), (1, 5, 10, 30, 40))", _FADE))
_kernel_query("half_integral", kernels.fractional(-0.5), sql=_spectral(f"(a - b) * {_ROOT}", f"(a + b) * {_ROOT}"))
_kernel_query("phase_rotation", kernels.phase_change(90.0), sql=_spectral("-b", "a"))
_kernel_query("minimum_phase", kernels.minimum_phase(), sql=f"""
WITH {S}, k AS (SELECT unnest(range(130)) AS k), turn AS (SELECT x.k AS m, cos(2 * pi() * x.k / 130) AS c, sin(2 * pi() * x.k / 130) AS s FROM k x),
amp AS (SELECT vec_id, k, sqrt(pow(sum(v * c), 2) + pow(sum(v * turn.s), 2)) AS a FROM s, k, turn WHERE m = (k * it) % 130 GROUP BY ALL),
lg AS (SELECT vec_id, k, ln(a + 1e-9 * max(a) OVER (PARTITION BY vec_id)) AS l FROM amp),
cep AS (SELECT vec_id, n.k AS n, sum(l * c) / 130 * CASE WHEN n.k IN (0, 65) THEN 1 ELSE 2 END AS q FROM lg, k n, turn WHERE m = (lg.k * n.k) % 130 AND n.k <= 65 GROUP BY vec_id, n.k),
ph AS (SELECT vec_id, k.k, sum(q * c) AS re, -sum(q * turn.s) AS im FROM cep, k, turn WHERE m = (k.k * n) % 130 GROUP BY ALL),
y AS (SELECT vec_id, t.k AS it, sum(exp(re) * (cos(im) * c - sin(im) * turn.s)) / 130 AS v FROM ph, k t, turn WHERE m = (ph.k * t.k) % 130 AND t.k < 64 GROUP BY vec_id, t.k) {_ROWS}""")
_kernel_query("antialias", kernels.antialias(0.5), sql=f"WITH RECURSIVE {S}, {_recursive('y', 's', False, 0.15, 0.25, 0.99, 0.01, 164)} {_ROWS}")
_kernel_query("gaussian_smoothing", kernels.gaussian_smooth(5), sql=_weighted("w.c").replace("i AS (SELECT unnest(range(64)) AS it),", f"i AS (SELECT unnest(range(64)) AS it), w AS (SELECT i.it, j, {_GAUSS} AS c FROM i, (SELECT it AS j FROM i)),").replace(", i WHERE s.it = j.j", ", i, w WHERE s.it = j.j AND w.j = s.it AND w.it = i.it"))
_kernel_query("savitzky_golay", kernels.savitzky_golay(3, 3), sql=_SAVITZKY)
_kernel_query("fractional_shift", kernels.time_shift(0.0013), sql=_weighted(_SHIFT))
_kernel_query("hartley_transform", kernels.hartley(), sql=_weighted("(cos(2 * pi() * ((i.it * j) % 64) / 64) + sin(2 * pi() * ((i.it * j) % 64) / 64))"))
_kernel_query("fused_filters", kernels.bandpass_kernel(), kernels.gaussian_smooth(3), kernels.time_shift(0.002), sql=f"""
WITH RECURSIVE {S}, {_LOW_CUT}, {_HIGH_CUT}, i AS (SELECT unnest(range(64)) AS it), g AS (SELECT it, j, w / sum(w) OVER (PARTITION BY it) AS w FROM (SELECT it, j, exp(-ln(2) * pow(2 * (it - j) / 3.0, 2)) AS w FROM i, (SELECT it AS j FROM i))),
m AS (SELECT vec_id, g.it, sum(v * w) AS v FROM hc JOIN g ON g.j = hc.it GROUP BY ALL),
y AS (SELECT vec_id, i.it, sum(v * {_SHIFT.replace("0.325", "0.5").replace("- j", "- m.it")}) AS v FROM m, i GROUP BY ALL) {_ROWS}""")


@query(f"""
WITH RECURSIVE {S}, f AS (
  SELECT vec_id, it, v, (v * 0.2) AS y FROM s WHERE it = 0
  UNION ALL SELECT s.vec_id, s.it, s.v, 0.2 * (s.v + f.v) + 0.6 * f.y FROM f JOIN s ON s.vec_id = f.vec_id AND s.it = f.it + 1
)
SELECT vec_id, it, round(y, 4) AS v FROM f""")
def one_pole_lowpass(spark, sf_dir):
    """First-order section of the recursive low-pass with coefficient 0.2."""
    f3db = math.atan(0.25) / math.pi  # the bilinear frequency whose section is 0.2 (1 + z) / (1 - 0.6 z)
    out = kernels.apply_kernels(doubles(spark, sf_dir), kernels.butterworth(1, f3db, high=False, zero_phase=False))
    return sampled(out, digits=4)


@query(f"""
WITH {S} SELECT vec_id, count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms, round(max(abs(v)), 6) AS peak, round(avg(v), 6) AS mean, round(sum(abs(v)), 5) AS abs_sum,
  arg_max(it, v ORDER BY v DESC, it) AS argmax, arg_min(it, v ORDER BY v, it) AS argmin FROM s GROUP BY vec_id""".replace("arg_max(it, v ORDER BY v DESC, it)", "first(it ORDER BY v DESC, it)").replace("arg_min(it, v ORDER BY v, it)", "first(it ORDER BY v, it)"))
def trace_statistics(spark, sf_dir):
    return traces(spark, sf_dir).select(
        F.col("seq").alias("vec_id"), F.col("n_sample").cast("long").alias("n"), F.round(A.rms("data"), 6).alias("rms"), F.round(A.abs_max("data"), 6).alias("peak"), F.round(A.mean("data"), 6).alias("mean"),
        F.round(A.abs_sum("data"), 5).alias("abs_sum"), A.argmax("data").alias("argmax"), A.argmin("data").alias("argmin"),
    )


@query(f"""
WITH {S} SELECT vec_id, it, round((coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / (CASE WHEN it IN (0, 63) THEN 1 ELSE 2 END * 0.004), 4) AS v
FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY it)""")
def differentiate(spark, sf_dir):
    return sampled(traces(spark, sf_dir).withColumn("data", A.differentiate(F.col("data").cast("array<double>"), 0.004)), digits=4)


@query(f"""
WITH {S}, h AS (SELECT k, (0.54 + 0.46 * cos(pi() * k / 30.0)) * CASE WHEN k % 2 <> 0 THEN 2 / (pi() * k) ELSE 0 END AS c FROM (SELECT unnest(range(-30, 31)) AS k) WHERE k <> 0 AND k % 2 <> 0)
SELECT a.vec_id, a.it, round(sum(b.v * h.c), 5) AS v FROM s a JOIN h ON true JOIN s b ON b.vec_id = a.vec_id AND b.it = a.it - h.k GROUP BY ALL""")
def hilbert_transform(spark, sf_dir):
    return sampled(traces(spark, sf_dir).withColumn("data", A.hilbert("data", n=64).cast("array<double>")), digits=5)


@query(f"""
WITH {S}, w AS (SELECT k, exp(-x) * (1 - 2 * x) AS c FROM (SELECT k, pow(pi() * 25 * (k * 0.004 - 1 / 25.0), 2) AS x FROM (SELECT unnest(range(21)) AS k)))
SELECT a.vec_id, a.it, round(sum(b.v * w.c), 5) AS v FROM s a JOIN w ON true JOIN s b ON b.vec_id = a.vec_id AND b.it = a.it - w.k GROUP BY ALL""")
def convolve_ricker(spark, sf_dir):
    wavelet = A.ricker(21, 0.004, 25.0)
    return sampled(traces(spark, sf_dir).withColumn("data", A.convolve(wavelet, 0, "data", 0, 64, 0)), digits=5)


@query(f"""
WITH {S}, p AS (SELECT it, v FROM s WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), l AS (SELECT unnest(range(-8, 9)) AS lag)
SELECT s.vec_id, lag, round(sum(p.v * s.v), 5) AS v FROM l JOIN p ON true JOIN s ON s.it = p.it + lag GROUP BY ALL""")
def correlate_pilot(spark, sf_dir):
    """Correlation of every trace with the first one, the pilot, which one broadcast row carries."""
    t = traces(spark, sf_dir)
    pilot = t.agg(F.min_by("data", "seq").alias("pilot"))
    both = t.select("seq", "data", F.lit(0).alias("k")).join(F.broadcast(pilot.withColumn("k", F.lit(0))), "k")
    return both.select(F.col("seq").alias("vec_id"), F.posexplode(A.correlate("pilot", 0, "data", 0, 17, -8)).alias("i", "v")).select("vec_id", (F.col("i") - 8).cast("long").alias("lag"), F.round("v", 5).alias("v"))


@query(f"""
WITH {S}, k AS (SELECT unnest(range(33)) AS k)
SELECT vec_id, k, round(sqrt(pow(sum(v * cos(2 * pi() * ((it * k) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((it * k) % 64) / 64)), 2)), 4) AS amp FROM s, k GROUP BY ALL""")
def dft_amplitude(spark, sf_dir):
    out = traces(spark, sf_dir).select(F.col("seq").alias("vec_id"), F.posexplode(A.amplitude(A.dft("data"))).alias("k", "amp"))
    return out.select("vec_id", F.col("k").cast("long").alias("k"), F.round("amp", 4).alias("amp"))


@query(f"""
WITH {S} SELECT vec_id, it, round(v * CASE WHEN it < 8 THEN (it + 1) / 9.0 ELSE 1 END * CASE WHEN it > 55 THEN (64 - it) / 9.0 ELSE 1 END, 6) AS v FROM s""")
def tapered(spark, sf_dir):
    return sampled(traces(spark, sf_dir).withColumn("data", A.taper(F.col("data").cast("array<double>"), 8, 8)))


@query(f"""
WITH {S} SELECT vec_id, (it + 5) % 64 AS it, round(v, 6) AS v FROM s""")
def rotated(spark, sf_dir):
    return sampled(traces(spark, sf_dir).withColumn("data", A.rotate("data", 5)))


@query(f"""
WITH {S} SELECT vec_id, it, round(avg(v) OVER (PARTITION BY vec_id ORDER BY it ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS v FROM s""")
def running_average(spark, sf_dir):
    return sampled(traces(spark, sf_dir).withColumn("data", A.running_average("data", 7)))


@query("""
SELECT k AS it, round(0.5 * (1 - cos(2 * pi() * (k + 1) / 65)), 9) AS hann, round(exp(-x) * (1 - 2 * x), 9) AS ricker,
  round(-60 * (k * 0.004 - 0.09) * exp(-2 * 400 * pow(k * 0.004 - 0.09, 2)), 9) AS akb, CASE WHEN k = 0 THEN 1.0 ELSE round(sin(pi() * k / 8) / (pi() * k / 8), 9) END AS sinc
FROM (SELECT k, pow(pi() * 20 * (k * 0.004 - 0.05), 2) AS x FROM (SELECT unnest(range(64)) AS k))""")
def wavelets(spark, sf_dir):
    one = spark.range(1).select(F.posexplode(F.arrays_zip(A.hanning(64).alias("h"), A.ricker(64, 0.004, 20.0).alias("r"), A.akb(64, 0.004, 20.0).alias("a"))).alias("it", "w"))
    return one.select(F.col("it").cast("long").alias("it"), F.round("w.h", 9).alias("hann"), F.round("w.r", 9).alias("ricker"), F.round("w.a", 9).alias("akb"), F.round(A.sinc(F.col("it") / F.lit(8.0)), 9).alias("sinc"))


# --- across traces ------------------------------------------------------------


_MIRROR = "SELECT vec_id, label, it, v, row_number() OVER (PARTITION BY label, it ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label, it) AS n FROM s"


@query(f"""
WITH {S}, o AS ({_MIRROR}), w(k, c) AS (VALUES (-2, 0.6), (-1, 1.0), (0, 1.0), (1, 1.0), (2, 0.6))
SELECT o.vec_id, o.it, round(sum(b.v * w.c) / 5, 5) AS v FROM o JOIN w ON true
JOIN o b ON b.label = o.label AND b.it = o.it AND b.r = CASE WHEN o.r + w.k BETWEEN 1 AND o.n THEN o.r + w.k WHEN o.r - w.k BETWEEN 1 AND o.n THEN o.r - w.k ELSE o.r END GROUP BY ALL""")
def trace_mix5(spark, sf_dir):
    return sampled(cross.mix(traces(spark, sf_dir).withColumn("data", F.col("data").cast("array<double>")), ["ensemble_number"]), digits=5)


@query(f"""
WITH {S}, o AS ({_MIRROR}), w(k) AS (VALUES (-2), (-1), (0), (1), (2))
SELECT o.vec_id, o.it, round(median(b.v), 5) AS v FROM o JOIN w ON true
JOIN o b ON b.label = o.label AND b.it = o.it AND b.r = CASE WHEN o.r + w.k BETWEEN 1 AND o.n THEN o.r + w.k WHEN o.r - w.k BETWEEN 1 AND o.n THEN o.r - w.k ELSE o.r END GROUP BY o.vec_id, o.it""")
def trace_median5(spark, sf_dir):
    return sampled(cross.median(traces(spark, sf_dir), ["ensemble_number"]), digits=5)


@query(f"WITH {S} SELECT CAST(label AS BIGINT) AS label, it, round(CAST(avg(v) AS FLOAT), 5) AS v FROM s GROUP BY ALL".replace("round(CAST(avg(v) AS FLOAT), 5)", "round(avg(v), 5)"))
def gather_stack(spark, sf_dir):
    rows = cross.samples(traces(spark, sf_dir), "ensemble_number").groupBy("ensemble_number", "it").agg(F.avg("v").alias("v"))
    return rows.select(F.col("ensemble_number").alias("label"), F.col("it").cast("long").alias("it"), F.round("v", 5).alias("v"))


@query(f"""
WITH {S}, o AS (SELECT label, it, v, row_number() OVER (PARTITION BY label, it ORDER BY v, vec_id) AS r, count(*) OVER (PARTITION BY label, it) AS n FROM s)
SELECT CAST(label AS BIGINT) AS label, it, round(avg(v), 5) AS v FROM o WHERE r > floor(n * 0.15 + 0.5) AND r <= n - floor(n * 0.15 + 0.5) GROUP BY ALL""")
def alpha_trim_stack(spark, sf_dir):
    return sampled(cross.alpha_trimmed_stack(traces(spark, sf_dir), ["ensemble_number"]), digits=5, key="ensemble_number", name="label")


@query("""
WITH o AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT user_id, event_id, event_type, sum(c::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run""")
def run_gathers(spark, sf_dir):
    r = cross.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH o AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t FROM events),
g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 86400, false) AS jump FROM o),
r AS (SELECT user_id, t, 1 + sum(jump::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM g)
SELECT user_id, CAST(max(segment) AS BIGINT) AS segments, count(*) AS n FROM r GROUP BY user_id""")
def segments_at_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000000.0)
    return cross.segments_at_gaps(e, ["user_id"], "t", 86400.0).groupBy("user_id").agg(F.max("segment").alias("segments"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {S}, d AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)
SELECT d.vec_id, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS coherence FROM d JOIN s a ON a.vec_id = d.vec_id JOIN s b ON b.vec_id = d.nxt AND b.it = a.it GROUP BY d.vec_id""")
def adjacent_coherence(spark, sf_dir):
    return cross.adjacent_coherence(traces(spark, sf_dir), ["ensemble_number"]).where("coherence is not null").select(F.col("seq").alias("vec_id"), F.round("coherence", 6).alias("coherence"))


@query(f"""
WITH {S}, x AS (SELECT label, (vec_id % 24) * 10.0 AS x, it, v FROM s), p(ip, p) AS (VALUES (0, 0.0), (1, 0.0002), (2, 0.0005)),
q AS (SELECT label, ip, it - p * x / 0.004 AS tau, v FROM x, p),
u AS (SELECT label, ip, floor(tau) AS it, (1 - (tau - floor(tau))) * v AS v FROM q UNION ALL SELECT label, ip, floor(tau) + 1, (tau - floor(tau)) * v FROM q)
SELECT CAST(label AS BIGINT) AS label, CAST(ip AS BIGINT) AS ip, CAST(it AS BIGINT) AS it, round(sum(v), 4) AS v FROM u WHERE it >= 0 AND it < 64 GROUP BY ALL""")
def slant_stack(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("x", F.pmod("seq", F.lit(24)) * 10.0)
    out = cross.slant_stack(t, ["ensemble_number"], "x", [0.0, 0.0002, 0.0005], 64, 0.004)
    return out.select(F.col("ensemble_number").alias("label"), F.col("ip").cast("long").alias("ip"), F.col("it").cast("long").alias("it"), F.round("v", 4).alias("v"))


def _panel_query(name: str, f, *args, sql: str | None = None) -> None:
    def run(spark, sf_dir):
        return sampled(f(doubles(spark, sf_dir), ["ensemble_number"], *args), digits=5)

    run.__name__ = name
    query(sql)(run)


#: Spectra (a, b) of the traces at 66 places; x numbers the traces of a panel.
_SPECTRA = f"""{S}, k AS (SELECT unnest(range(34)) AS k), turn AS (SELECT k, it, cos(2 * pi() * ((k * it) % 66) / 66) AS cs, sin(2 * pi() * ((k * it) % 66) / 66) AS sn FROM k, (SELECT unnest(range(64)) AS it)),
c AS (SELECT vec_id, label, k, sum(v * cs) AS a, sum(v * sn) AS b FROM s JOIN turn USING (it) GROUP BY ALL)"""
#: From spectra d (vec_id, label, k, a, b) to the samples y.
_SAMPLES = "y AS (SELECT vec_id, label, it, sum(CASE WHEN k IN (0, 33) THEN 1 ELSE 2 END * (a * cs + b * sn)) / 66 AS v FROM d JOIN turn USING (k) GROUP BY ALL)"


def _wavenumbers(weight: str, scaled: str = "") -> str:
    """A panel filter; weight: of frequency number k and wavenumber w, both axes padded to a transform length."""
    return f"""
WITH {_SPECTRA}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS x FROM embeddings),
len AS (SELECT 2 * p * q * r * t * u * z AS l FROM (VALUES (1), (2), (4), (8), (16)) a(p), (VALUES (1), (3), (9)) b(q), (VALUES (1), (5)) c(r), (VALUES (1), (7)) d(t), (VALUES (1), (11)) e(u), (VALUES (1), (13)) f(z)),
n AS (SELECT label, min(l) AS n FROM (SELECT label, count(*) AS nx FROM o GROUP BY label) JOIN len ON l >= nx GROUP BY label),
m AS (SELECT label, n, m, (CASE WHEN 2 * m < n THEN m ELSE m - n END) / n AS w FROM (SELECT label, n, unnest(range(n)) AS m FROM n)),
h AS (SELECT o.vec_id, o.label, m, w, n, cos(2 * pi() * ((m * x) % n) / n) AS mc, sin(2 * pi() * ((m * x) % n) / n) AS ms FROM o JOIN m USING (label)),
f AS (SELECT h.label, k, m, any_value(w) AS w, any_value(n) AS n, sum(a * mc + b * ms) AS a, sum(b * mc - a * ms) AS b FROM c JOIN h USING (vec_id) GROUP BY h.label, k, m),
g AS (SELECT label, k, m, a * g / n AS a, b * g / n AS b FROM (SELECT *, {weight} AS g FROM f)),
d AS (SELECT h.vec_id, h.label, k, sum(a * mc - b * ms) AS a, sum(b * mc + a * ms) AS b FROM g JOIN h ON h.label = g.label AND h.m = g.m GROUP BY h.vec_id, h.label, k),
{_SAMPLES} {scaled or _ROWS}"""


_SLOPES = "CASE WHEN {0} <= 0.05 OR {0} >= 0.5 THEN 0 WHEN {0} < 0.1 THEN sin(0.5 * pi() * ({0} - 0.05) / 0.05) WHEN {0} > 0.4 THEN sin(0.5 * pi() * (0.5 - {0}) / 0.1) ELSE 1 END"
_RADIUS = "sqrt(w * w + pow(k / 66, 2))"
_LARGEST = """, top AS (SELECT label, max(abs(v)) AS after FROM y GROUP BY label), was AS (SELECT label, max(abs(v)) AS before FROM s GROUP BY label)
SELECT vec_id, CAST(it AS BIGINT) AS it, round(v * before / after, 5) AS v FROM y JOIN top ON top.label = y.label JOIN was ON was.label = y.label"""

_panel_query("dip_filter", cross.filter_dips, [-0.002, -0.001, 0.001, 0.002], [0, 1, 1, 0], 0.004, 1.0, sql=_wavenumbers("greatest(0, least(1, 2 - abs(w * 0.264 / (k + 1e-6)) / 0.001))"))
_panel_query("radial_k_filter", cross.filter_radial, [0.05, 0.1, 0.4, 0.5], [0, 1, 1, 0], sql=_wavenumbers(_SLOPES.format(_RADIUS)))
_panel_query("separable_k_filter", cross.filter_separable, [0.05, 0.1, 0.4, 0.5], [0, 1, 1, 0], [0.05, 0.1, 0.4, 0.5], [0, 1, 1, 0], sql=_wavenumbers(f"({_SLOPES.format('abs(w)')}) * ({_SLOPES.format('(k / 66)')})"))
_panel_query("fractional_k_filter", cross.filter_radial_power, 0.5, sql=_wavenumbers(f"sqrt(2 * pi() * {_RADIUS})"))
_panel_query("gaussian_k_filter", cross.filter_gaussian, 1.0, 1.0, sql=_wavenumbers("exp(-pow(pi() * w, 2) - pow(pi() * k / 66, 2))", _LARGEST))
_panel_query("svd_filter", cross.subtract_eigenimages, 2)
_panel_query("phase_coherence_filter", cross.filter_phase_coherence, sql=f"""
WITH {_SPECTRA}, t AS (SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM c WINDOW w AS (PARTITION BY label, k ORDER BY vec_id)),
d AS (SELECT vec_id, label, k, a, b FROM t WHERE na IS NULL OR k = 33 OR a * na + b * nb >= 0.3 * sqrt((a * a + b * b) * (na * na + nb * nb))),
{_SAMPLES} {_ROWS}""")
_panel_query("low_frequency_array", cross.mix_low_frequencies, 0.004, sql=f"""
WITH {_SPECTRA}, t AS (SELECT *, k / 0.264 AS f FROM c), w(k, half) AS (VALUES (1, 13), (2, 6), (3, 4), (4, 3), (5, 2), (6, 2)),
u AS (SELECT t.*, avg(a) OVER z AS ma, avg(b) OVER z AS mb FROM t JOIN w USING (k) WINDOW z AS (PARTITION BY label, k ORDER BY vec_id ROWS BETWEEN half PRECEDING AND half FOLLOWING)),
d AS (SELECT vec_id, label, k, g * ma + (1 - g) * a AS a, g * mb + (1 - g) * b AS b FROM (SELECT *, CASE WHEN f <= 20 THEN 1 ELSE 1 - (f - 20) / 5 END AS g FROM u)
  UNION ALL SELECT vec_id, label, k, a, b FROM c WHERE k NOT BETWEEN 1 AND 6),
{_SAMPLES} {_ROWS}""")


@query("""
WITH s AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS it, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings),
t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n, CAST(round(-1 * (CASE WHEN vec_id > 500 THEN 0.05 ELSE 0.05::DOUBLE * vec_id / 500.0 END) / 0.004::DOUBLE) AS BIGINT) AS k FROM embeddings),
i AS (SELECT unnest(range(64)) AS it),
p AS (SELECT t.vec_id, t.label, r, n, k, i.it, coalesce(s.v, CAST(0 AS FLOAT)) AS v FROM t JOIN i ON true LEFT JOIN s ON s.vec_id = t.vec_id AND s.it = i.it - k),
m AS (SELECT a.vec_id, a.k, a.it, median(b.v) AS v FROM p a JOIN (VALUES (-2), (-1), (0), (1), (2)) w(q) ON true
  JOIN p b ON b.label = a.label AND b.it = a.it AND b.r = CASE WHEN a.r + q BETWEEN 1 AND a.n THEN a.r + q WHEN a.r - q BETWEEN 1 AND a.n THEN a.r - q ELSE a.r END GROUP BY a.vec_id, a.k, a.it)
SELECT s.vec_id, s.it, round(CAST(CAST(s.v - coalesce(m.v, 0) AS FLOAT) AS DOUBLE), 6) AS v FROM s JOIN t USING (vec_id) LEFT JOIN m ON m.vec_id = s.vec_id AND m.it = s.it + t.k""")
def moveout_median_filter(spark, sf_dir):
    return sampled(cross.moveout_median(traces(spark, sf_dir), ["ensemble_number"], "trace_id", [0.0, 500.0], [0.0, 0.05]))


@query(f"""
WITH {_SPECTRA}, o AS (SELECT *, row_number() OVER (PARTITION BY label, k ORDER BY a, vec_id) AS ra, row_number() OVER (PARTITION BY label, k ORDER BY b, vec_id) AS rb, count(*) OVER (PARTITION BY label, k) AS n FROM c),
q AS (SELECT *, least(floor(n * 15.0 / 100 + 0.5), floor((n - 1) / 2)) AS q FROM o),
d AS (SELECT label AS vec_id, label, k, avg(a) FILTER (WHERE ra > q AND ra <= n - q) AS a, avg(b) FILTER (WHERE rb > q AND rb <= n - q) AS b FROM q GROUP BY label, k),
{_SAMPLES} SELECT CAST(label AS BIGINT) AS label, CAST(it AS BIGINT) AS it, round(v, 5) AS v FROM y""")
def trimmed_spectrum_stack(spark, sf_dir):
    return sampled(cross.trimmed_spectrum_stack(doubles(spark, sf_dir), ["ensemble_number"]), digits=5, key="ensemble_number", name="label")


# --- relational and statistical -----------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
  round(abs(corr(l_extendedprice, l_quantity)), 6) AS r FROM lineitem GROUP BY ALL""")
def regression_per_key(spark, sf_dir):
    out = statistics.regression(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "l_linestatus", F.col("n").alias("n"), F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"))


@query("""
WITH g AS (SELECT l_returnflag AS k, 1 / pow(1 + l_tax, 2) AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT k, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM g GROUP BY k)
SELECT k AS l_returnflag, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 2) AS a, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 4) AS b FROM s""")
def weighted_fit(spark, sf_dir):
    out = statistics.weighted_fit(table(spark, sf_dir, "lineitem").withColumn("sigma", 1 + F.col("l_tax")), ["l_returnflag"], "l_extendedprice", "l_quantity", "sigma")
    return out.select("l_returnflag", F.round("a", 2).alias("a"), F.round("b", 4).alias("b"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1")
def quantiles(spark, sf_dir):
    out = statistics.quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.9])
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q90")])


@query("SELECT o_orderpriority, round(o_totalprice, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r FROM orders) WHERE r = 11")
def order_statistic(spark, sf_dir):
    return statistics.order_statistic(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 10).select("o_orderpriority", F.round("value", 2).alias("value"))


@query("SELECT least(CAST(floor(l_quantity / 5) AS BIGINT) + 1, 10) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram(spark, sf_dir):
    return statistics.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 10)


@query("""
WITH k(x, y) AS (VALUES (0.0, 1.0), (50.0, 3.0), (200.0, 2.0), (1000.0, 10.0))
SELECT event_id, round(CASE WHEN value < 0 THEN 1.0 WHEN value >= 1000 THEN 10.0 ELSE (
  SELECT a.y + (b.y - a.y) * (value - a.x) / (b.x - a.x) FROM k a JOIN k b ON b.x = (SELECT min(x) FROM k WHERE x > a.x) WHERE a.x <= value AND value < b.x) END, 6) AS v FROM events""")
def linear_lookup(spark, sf_dir):
    xs, ys = F.lit([0.0, 50.0, 200.0, 1000.0]), F.lit([1.0, 3.0, 2.0, 10.0])
    return table(spark, sf_dir, "events").select("event_id", F.round(A.interpolate(xs, ys, F.col("value")), 6).alias("v"))


@query("""
SELECT event_id, round(CASE WHEN value < 50 THEN 1 + 2 * value / 50 WHEN value < 200 THEN 3 - (value - 50) / 150 ELSE 2 + 8 * (value - 200) / 800 END, 6) AS v FROM events""")
def extrapolated_lookup(spark, sf_dir):
    xs, ys = F.lit([0.0, 50.0, 200.0, 1000.0]), F.lit([1.0, 3.0, 2.0, 10.0])
    return table(spark, sf_dir, "events").select("event_id", F.round(A.extrapolate(xs, ys, F.col("value"), 1), 6).alias("v"))


@query("""
WITH e AS (SELECT event_id, value, cos(value) AS ar, sin(value) AS ai FROM events)
SELECT event_id, round(ar * ar - ai * ai, 6) AS sq_r, round(2 * ar * ai, 6) AS sq_i, round(exp(ar) * cos(ai), 6) AS exp_r, round(ar / (ar * ar + ai * ai), 6) AS inv_r FROM e""")
def complex_arithmetic(spark, sf_dir):
    a = C.complex_(F.cos("value"), F.sin("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(C.mul(a, a)["r"], 6).alias("sq_r"), F.round(C.mul(a, a)["i"], 6).alias("sq_i"), F.round(C.exp(a)["r"], 6).alias("exp_r"), F.round(C.inv(a)["r"], 6).alias("inv_r"))


@query("""
WITH p AS (SELECT event_id, CAST(event_id % 97 AS DOUBLE) * 10 AS x, CAST(event_id % 89 AS DOUBLE) * 10 AS y FROM events),
g AS (SELECT event_id, (x - 100) * 0.8 + (y - 50) * 0.6 AS gx, (y - 50) * 0.8 - (x - 100) * 0.6 AS gy FROM p),
c AS (SELECT event_id, floor(gx / 25 + 0.5) + 1 AS ib, floor(gy / 50 + 0.5) + 1 AS ic FROM g)
SELECT event_id, CAST(CASE WHEN ib BETWEEN 1 AND 41 AND ic BETWEEN 1 AND 11 THEN ib + (ic - 1) * 41 ELSE -2147483645 END AS BIGINT) AS cdp FROM c""")
def grid_cells(spark, sf_dir):
    grid = G.Grid.from_corners((100.0, 50.0), (900.0, 650.0), (-200.0, 450.0), 25.0, 50.0)
    x, y = F.pmod("event_id", F.lit(97)).cast("double") * 10, F.pmod("event_id", F.lit(89)).cast("double") * 10
    return table(spark, sf_dir, "events").select("event_id", grid.cell(x, y)[0].alias("cdp"))


@query("""
SELECT event_id, CASE WHEN s > 0 THEN CAST(s AS DOUBLE) WHEN s < 0 THEN 1 / CAST(-s AS DOUBLE) ELSE 1.0 END AS multiplier FROM (SELECT event_id, event_id % 5 - 2 AS s FROM events)""")
def coordinate_multiplier(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", statistics.coordinate_multiplier(F.col("event_id") % 5 - 2).alias("multiplier"))


@query("""
WITH v AS (SELECT event_id, 2.5 + (event_id % 7) * 0.1 AS vp, 1.2 + (event_id % 5) * 0.05 AS vs, (event_id % 3) * 0.1 AS eps, (event_id % 4) * 0.05 AS delta, sin(0.1 * (event_id % 15)) AS s FROM events),
c AS (SELECT event_id, s * s AS s2, 1 - s * s AS k2, vp * vp AS c33, vs * vs AS c44, vp * vp * (1 + 2 * eps) AS c11, sqrt(2 * delta * vp * vp * (vp * vp - vs * vs) + pow(vp * vp - vs * vs, 2)) - vs * vs AS c13 FROM v),
d AS (SELECT event_id, c11 * s2 + c44 * k2 AS a, c44 * s2 + c33 * k2 AS b, pow(c13 + c44, 2) * s2 * k2 AS m FROM c)
SELECT event_id, round(sqrt((a + b + sqrt(pow(a - b, 2) + 4 * m)) / 2), 6) AS p, round(sqrt((a + b - sqrt(pow(a - b, 2) + 4 * m)) / 2), 6) AS sv FROM d""")
def anisotropic_velocity(spark, sf_dir):
    e = F.col("event_id")
    c = G.thomsen_to_stiffness(2.5 + (e % 7) * 0.1, 1.2 + (e % 5) * 0.05, (e % 3) * 0.1, (e % 4) * 0.05, F.lit(0.0))
    s = F.sin(0.1 * (e % 15))
    return table(spark, sf_dir, "events").select("event_id", F.round(G.phase_velocity(c, s, "P"), 6).alias("p"), F.round(G.phase_velocity(c, s, "SV"), 6).alias("sv"))


@query(f"""
WITH {S}, e AS (SELECT vec_id, label, sum(v * v) AS e FROM s GROUP BY ALL)
SELECT vec_id, label, r FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY e DESC, vec_id) AS r FROM e) WHERE r <= 3""")
def strongest_traces(spark, sf_dir):
    """The three traces of most energy in each gather; the rank limit is applied before the shuffle too."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.desc(A.dot("embedding", "embedding")), "vec_id")
    return table(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(w).cast("long")).where("r <= 3").select("vec_id", "label", "r")


def queries() -> dict:
    from tracefold.plans import files, panels, pointwise, resolution  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict:
    from tracefold.plans import files, panels, pointwise, resolution  # noqa: F401  register their SQL

    return dict(_SQL)
