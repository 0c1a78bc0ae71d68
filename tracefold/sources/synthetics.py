"""Synthetic trace sources as DataFrame plans.

Traces come from ``spark.range``, so any number of them is spread over the
cluster; samples are array expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.schema import ENSEMBLE_TYPES, as_traces, point


def _range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "seq")


def spike(spark: SparkSession, nt: int = 64, ntr: int = 32, dt: float = 0.004, offset: float = 400.0, spikes: list[tuple[int, int]] | None = None) -> DataFrame:
    """Zero traces with ones at (trace, sample) places; by default four places on a grid of quarters."""
    if spikes is None:
        spikes = [(x, t) for x in (ntr // 4, 3 * ntr // 4) for t in (nt // 4 - 1, 3 * nt // 4 - 1)]
    at = F.array(*[F.struct(F.lit(int(x)).alias("x"), F.lit(int(t)).alias("t")) for x, t in spikes]) if spikes else F.array().cast("array<struct<x:int,t:int>>")
    hit = lambda i: F.exists(at, lambda s: (s["x"] == F.col("seq")) & (s["t"] == i))
    data = F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), lambda i: F.when(hit(i), 1.0).otherwise(0.0))
    return as_traces(_range(spark, ntr).withColumn("data", data), d_sample=float(dt), offset=float(offset), tx_loc=point(F.col("seq")), rx_loc=point(F.col("seq") + F.lit(float(offset))), trace_id=F.col("seq") + 1)


def plane(spark: SparkSession, nt: int = 64, ntr: int = 32, taper: bool = False, dt: float = 0.004, offset: float = 400.0, planes: list[tuple[float, int, int, int]] | str | None = None) -> DataFrame:
    """Dipping planes (dip in ms a trace, length, centre time and centre trace in samples).

    ``taper`` divides what has accumulated so far at the ends of each plane's
    extent by 6, and next to them by 3. ``planes="liner"`` is 64 x 64 with three
    separate planes.
    """
    if planes == "liner":
        nt = ntr = 64
        planes = [(0.0, ntr // 4, nt // 2, ntr // 4), (4.0, ntr // 4, nt // 2, ntr // 2), (8.0, ntr // 4, nt // 2, 3 * ntr // 4)]
    elif planes is None:
        planes = [(dip, 3 * ntr // 4, nt // 2 - 1, ntr // 2 - 1) for dip in (0.0, 4.0, 8.0)]
    if any(len(p) != 4 for p in planes):
        raise TypeError("a plane is (dip, length, centre time, centre trace)")
    data = F.array_repeat(F.lit(0.0), nt)
    df = _range(spark, ntr).withColumn("data", data)
    for dip, length, ct, cx in planes:
        lo, hi = cx - length // 2, cx + length // 2
        fit = F.lit(float(ct)) - (F.lit(float(cx)) - F.col("seq")) * F.lit(dip / (1000.0 * dt))
        whole = F.floor(fit)
        inside = F.col("seq").between(lo, hi)
        hits = inside & (fit >= 0) & (fit < nt - 1)
        place = F.col("seq") - max(0, lo)
        share = F.lit(1.0)
        if taper:
            share = F.when(place.isin(0, length), 6.0).when(place.isin(1, length - 1), 3.0).otherwise(1.0)
        df = df.withColumn("data", _add_plane(hits, whole, fit - whole))
        if taper:
            df = df.withColumn("data", _divided(inside, share))
    return as_traces(df, d_sample=float(dt), offset=abs(float(offset)), line_id=1, tx_loc=point(F.col("seq")), rx_loc=point(F.col("seq") + F.lit(float(offset))), trace_id=F.col("seq") + 1)


def _add_plane(hits, whole, part):
    return F.when(hits, F.transform("data", lambda v, i: v + F.when(i == whole, 1 - part).when(i == whole + 1, part).otherwise(0.0))).otherwise(F.col("data"))


def _divided(inside, share):
    return F.when(inside, F.transform("data", lambda v: v / share)).otherwise(F.col("data"))


def ricker_operator(fpeak: float, dt: float) -> tuple[int, list[float]]:
    """(first index, samples) of a symmetric Ricker wavelet with peak frequency ``fpeak``."""
    half = int(np.float32(1) + np.float32(1) / (np.float32(fpeak) * np.float32(dt)))
    x = np.pi * fpeak * dt * np.arange(-half, half + 1)
    return -half, (np.exp(-x * x) * (1 - 2 * x * x)).tolist()


def half_derivative(half: int = 20, h: float = 1.0) -> list[float]:
    """2 * half + 1 coefficients of a tapered half-derivative operator.

    Fourier integral of sqrt(|w|) (cos(w k) + sign sin(w k)) / sqrt(2) over the
    Nyquist band, by Simpson's rule, under a Hamming taper.
    """
    k = np.arange(-half, half + 1)
    w = np.linspace(0, np.pi, 4001)
    f = np.sqrt(w / 2) * (np.cos(np.outer(k, w)) - np.sin(np.outer(k, w)))
    step = w[1] - w[0]
    coefficient = step / 3 * (f[:, 0] + f[:, -1] + 4 * f[:, 1:-1:2].sum(axis=1) + 2 * f[:, 2:-1:2].sum(axis=1)) / np.pi
    return (coefficient * (0.54 + 0.46 * np.cos(np.pi * k / half)) / math.sqrt(h)).tolist()


def segments(reflectors: list, dsmax: float, smooth: bool = False) -> list[tuple[float, float, float, float, float, float]]:
    """(amplitude, x, z, sine, cosine, length) of reflector pieces of equal length at most ``dsmax``.

    A reflector is an optional amplitude and (x, z) points. Without ``smooth``
    each stretch between two points is cut by itself; with it, the pieces follow
    a natural cubic through the points.
    """
    out = []
    for r in reflectors:
        amp, pts = (1.0, r) if isinstance(r[0], tuple | list) else (float(r[0]), r[1:])
        runs = [pts] if smooth and len(pts) > 2 else [pts[i : i + 2] for i in range(len(pts) - 1)]
        for run in runs:
            u = np.arange(len(run), dtype=float)
            fine = np.linspace(0, len(run) - 1, 20 * len(run))
            xs, zs = (_curve(u, np.array([p[j] for p in run], dtype=float), fine) for j in (0, 1))
            arc = np.concatenate(([0], np.cumsum(np.hypot(np.diff(xs), np.diff(zs)))))
            ns = 1 + int(np.float32(arc[-1]) / np.float32(dsmax))
            ds = arc[-1] / ns
            at = np.interp((np.arange(ns) + 0.5) * ds, arc, fine)
            dx, dz = (_curve(u, np.array([p[j] for p in run], dtype=float), at, 1) for j in (0, 1))
            size = np.hypot(dx, dz)
            x, z = (_curve(u, np.array([p[j] for p in run], dtype=float), at) for j in (0, 1))
            out += [(amp, *map(float, row), float(ds)) for row in zip(x, z, -dz / size, dx / size)]
    return out


def _curve(u: np.ndarray, y: np.ndarray, at: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Natural cubic spline through (u, y), or its slope; a line for two points."""
    n = len(u)
    m = np.zeros(n)
    if n > 2:
        a = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
        m[1:-1] = np.linalg.solve(a, 6 * (y[2:] - 2 * y[1:-1] + y[:-2]))
    k = np.clip(at.astype(int), 0, n - 2)
    t = at - k
    if derivative:
        return y[k + 1] - y[k] - (3 * (1 - t) ** 2 - 1) / 6 * m[k] + (3 * t**2 - 1) / 6 * m[k + 1]
    return (1 - t) * y[k] + t * y[k + 1] + ((1 - t) ** 3 - (1 - t)) / 6 * m[k] + (t**3 - t) / 6 * m[k + 1]


def ray_columns(x0, z0, x, z, v0: float, dvdx: float, dvdz: float) -> dict:
    """Travel time, geometrical spreading and emergence of the ray between two points where speed is linear.

    Closed form: with velocities v1 and v2 at the ends, gradient g and distance d,
    time is acosh(1 + (g d)**2 / (2 v1 v2)) / g; without gradient d / v. The angle
    is that of the circular (or straight) ray at the first point.
    """
    v1, v2 = v0 + dvdx * x0 + dvdz * z0, v0 + dvdx * x + dvdz * z
    d = F.hypot(x - x0, z - z0)
    g = math.hypot(dvdx, dvdz)
    if g == 0:
        speed = F.lit(v0) + x0 * 0
        return {"t": d / speed, "q": d * speed, "c": F.when(d > 0, (z - z0) / d).otherwise(1.0), "s": F.when(d > 0, (x - x0) / d).otherwise(0.0), "v1": v1, "v2": v2}
    # along the gradient (p) and across it (o); the ray is an arc about the level where speed is 0
    gx, gz = dvdx / g, dvdz / g
    p, o = (x - x0) * gx + (z - z0) * gz, (x - x0) * gz - (z - z0) * gx
    t = F.acosh(1 + g * g * d * d / (2 * v1 * v2)) / g
    # the start's tangent of the circle through both ends whose centre lies where speed is 0
    along = 2 * v1 * p + g * (p * p + o * o)
    across = 2 * v1 * o
    size = F.hypot(along, across)
    ca, sa = F.when(size > 0, along / size).otherwise(1.0), F.when(size > 0, across / size).otherwise(0.0)
    return {"t": t, "q": d * F.sqrt(v1 * v2) * F.sqrt(1 + g * g * d * d / (4 * v1 * v2)), "c": ca * gz - sa * gx, "s": ca * gx + sa * gz, "v1": v1, "v2": v2}


def synlv(
    spark: SparkSession, nt: int = 101, dt: float = 0.04, ft: float = 0.0, nxo: int = 1, dxo: float = 0.05, fxo: float = 0.0, xo: list[float] | None = None,
    nxm: int = 101, dxm: float = 0.05, fxm: float = 0.0, nxs: int = 0, dxs: float = 0.05, fxs: float = 0.0, x0: float = 0.0, z0: float = 0.0, v00: float = 2.0,
    dvdx: float = 0.0, dvdz: float = 0.0, fpeak: float | None = None, reflectors: list | None = None, smooth: bool = False, er: bool = False, ls: bool = False,
    ob: bool = True, tmin: float | None = None, ndpfz: int = 5,
) -> DataFrame:
    """Kirchhoff-style synthetics of reflectors in a medium of linear velocity.

    Midpoints (``nxm``) or shots (``nxs``) are the outer loop and offsets the
    inner one; exactly one of the two must be given. Traces meet the reflector
    segments, a broadcast table whose size the arguments fix, and each meeting
    adds a band-limited spike; wavelet and half-derivative follow per trace.
    """
    if bool(nxs) == bool(nxm):
        raise TypeError("give exactly one of nxs and nxm")
    fpeak = fpeak or 0.2 / dt
    tmin = 10 * dt if tmin is None else tmin
    offsets = [float(v) for v in xo] if xo is not None else [fxo + i * dxo for i in range(nxo)]
    reflectors = reflectors or [[1, (1.0, 4.0), (2.0, 2.0)]]
    v0 = v00 - (dvdx * x0 + dvdz * z0)
    corners = [p for r in reflectors for p in r if isinstance(p, tuple | list)] + [(0.0, 0.0)]
    vmin = min(v00 + dvdx * (x - x0) + dvdz * (z - z0) for x, z in corners)
    tmin = max(tmin, ft, dt)
    dsmax = vmin / (2 * ndpfz) * math.sqrt(tmin / fpeak)
    segs = segments(reflectors, dsmax, smooth)
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "x", "z", "s", "c", "ds"), row)]) for row in segs])
    shots = bool(nxs)
    count, step, first = (nxs, dxs, fxs) if shots else (nxm, dxm, fxm)
    n_off = len(offsets)
    base = _range(spark, count * n_off).select(
        "seq", F.floor(F.col("seq") / n_off).cast("long").alias("ixsm"), F.pmod("seq", F.lit(n_off)).cast("int").alias("ixo")
    )
    base = base.withColumn("xo", F.get(F.array(*[F.lit(v) for v in offsets]), F.col("ixo"))).withColumn("pos", F.lit(first) + F.col("ixsm") * F.lit(step))
    base = base.withColumn("xs", F.col("pos") if shots else F.col("pos") - F.col("xo") / 2).withColumn("xg", F.col("xs") + F.col("xo"))
    met = base.select("seq", "xs", "xg", F.explode(table).alias("d"))
    zero = F.lit(0.0)
    src = ray_columns(F.col("xs"), zero, F.col("d.x"), F.col("d.z"), v0, dvdx, dvdz)
    rec = ray_columns(F.col("xg"), zero, F.col("d.x"), F.col("d.z"), v0, dvdx, dvdz)
    src_end = ray_columns(F.col("d.x"), F.col("d.z"), F.col("xs"), zero, v0, dvdx, dvdz)
    rec_end = ray_columns(F.col("d.x"), F.col("d.z"), F.col("xg"), zero, v0, dvdx, dvdz)
    # obliquity: the angle between the segment's normal and the rays that leave it
    cosine = lambda r: F.lit(1.0) if not ob else -(r["c"] * F.col("d.c") + r["s"] * F.col("d.s"))
    ci, cr = cosine(src_end), cosine(rec_end)
    vd = src["v2"]
    if er:
        amp = F.sqrt(rec["v1"] * vd / rec["q"])
    elif ls:
        amp = F.sqrt(src["v1"] * vd * vd * rec["v1"] / (src["q"] * rec["q"]))
    else:
        amp = F.sqrt(src["v1"] * vd * vd * rec["v1"] / (src["q"] * rec["q"] * (src["q"] + rec["q"])))
    hits = met.select("seq", (src["t"] + rec["t"]).alias("time"), (amp * (ci + cr) * F.col("d.a") * F.col("d.ds")).alias("amp"), ci.alias("ci"), cr.alias("cr")).where("ci >= 0 and cr >= 0")
    place = (F.col("time") - F.lit(ft)) / F.lit(dt)
    taps = hits.select("seq", "amp", place.alias("place"), F.explode(F.sequence(F.lit(-3), F.lit(4))).alias("k"))
    it = F.floor("place").cast("int") + F.col("k")
    sinc = F.when(F.abs(F.col("place") - it) < 1e-9, 1.0).otherwise(F.sin(F.lit(math.pi) * (F.col("place") - it)) / (F.lit(math.pi) * (F.col("place") - it)))
    near = F.col("place") - it
    window = F.when(F.abs(near) < 4, F.pow(F.cos(F.lit(math.pi) * near / 8), 2)).otherwise(0.0)
    added = taps.select("seq", it.alias("it"), (F.col("amp") * sinc * window).alias("v")).where((F.col("it") >= 0) & (F.col("it") < nt)).groupBy("seq", "it").agg(F.sum("v").alias("v"))
    sparse = added.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("it", "v"))).alias("m"))
    from tracefold.functions.arrays import convolve

    iw, wavelet = ricker_operator(fpeak, dt)
    dense = base.join(sparse, "seq", "left").withColumn("data", F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))))
    half = F.lit(half_derivative())
    dense = dense.withColumn("data", convolve(half, -20, F.col("data"), 0, nt, 0)).withColumn("data", convolve(F.lit(wavelet), iw, F.col("data"), 0, nt, 0))
    return as_traces(
        dense,
        line_id=1,
        trace_id=F.col("seq"),
        d_sample=float(np.float32(dt)),
        sample_start=float(ft),
        ensemble_type=ENSEMBLE_TYPES["tx" if shots else "cmp"],
        tx_loc=point(F.col("xs")),
        rx_loc=point(F.col("xg")),
        mid_point=point((F.col("xs") + F.col("xg")) / 2),
        offset=F.abs("xo"),
        ensemble_number=F.col("ixsm") + 1,
        ensemble_trace_number=F.col("ixo") + 1,
    )
