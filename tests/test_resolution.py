"""Wavelets, sinc tables, dips and smoothing against plain loops, on hot lines and odd tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracefold.functions import stacks
from tracefold.functions.special import upper_gamma
from tracefold.operators import blocks, controls, dips, polar, radial, sinc, smoothing, statistics, wavelets


# --- wavelets --------------------------------------------------------------------


@pytest.mark.parametrize("order", range(2, 22, 2))
def test_filters_are_orthogonal(order):
    c, d = wavelets.daubechies(order)
    for shift in range(0, order, 2):
        assert abs(c[shift:] @ c[: order - shift] - (shift == 0)) < 1e-7
    assert abs(c.sum() - math.sqrt(2)) < 1e-12
    k = np.arange(order)
    for power in range(order // 2):  # the details of polynomials vanish
        assert abs((d * (k / order) ** power).sum()) < 1e-6
    x = np.random.default_rng(order).normal(size=(3, 64))
    got = wavelets.transform(order, 3)(x, 1.0)
    assert np.allclose((got**2).sum(axis=1), (x**2).sum(axis=1)) and np.allclose(wavelets.inverse(order, 3)(got, 1.0), x, atol=1e-7)


def test_one_level_by_loops():
    c, d = wavelets.daubechies(6)
    assert np.allclose(wavelets.daubechies(4)[0], [0.4829629131445341, 0.8365163037378079, 0.2241438680420134, -0.1294095225512604])
    x = np.random.default_rng(1).normal(size=16)
    want = [sum(t[k] * x[(2 * m + k + 2 - 3) % 16] for k in range(6)) for t in (c, d) for m in range(8)]
    assert np.allclose(wavelets.transform(6, 1)(x[None], 1.0)[0], want)
    with pytest.raises(ValueError, match="halved"):
        wavelets.transform(4, 3)(np.zeros((1, 16)), 1.0)
    with pytest.raises(ValueError, match="even order"):
        wavelets.daubechies(22)


def test_cascade_refines():
    phi, psi = wavelets.cascade(6, 7)
    c, d = wavelets.daubechies(6)
    assert abs(phi.sum() / 2**7 - 1) < 1e-9 and abs(psi.sum() / 2**7) < 1e-9
    half = lambda x, k, n: x[2 * n - k * 2**7] if 0 <= 2 * n - k * 2**7 < len(x) else 0.0
    for n in range(0, len(phi), 37):  # the two-scale relations, up to the cascade's step
        assert abs(phi[n] - math.sqrt(2) * sum(c[k] * half(phi, k, n) for k in range(6))) < 0.2
        assert abs(psi[n] - math.sqrt(2) * sum(d[k] * half(phi, k, n) for k in range(6))) < 0.3


def test_wavelets_across_traces(spark):
    rng = np.random.default_rng(2)
    panels = {"a": rng.normal(size=(12, 5)), None: rng.normal(size=(4, 5)), "c": rng.normal(size=(40, 5))}
    df = spark.createDataFrame([(p, k, row.tolist()) for p, x in panels.items() for k, row in enumerate(x)], "panel string, place long, data array<double>").repartition(5)
    made = wavelets.across(df, ["panel"], 6)
    got, back = ({(r.panel, r.place): r.data for r in x.collect()} for x in (made, wavelets.across(made, ["panel"], 6, invert=True)))
    for p, x in panels.items():
        assert np.allclose([got[p, k] for k in range(len(x))], wavelets.split(x.T, 6).T)
        assert np.allclose([back[p, k] for k in range(len(x))], x)
    with pytest.raises(Exception, match="odd number"):
        wavelets.across(df.where("place < 3"), ["panel"]).collect()


# --- sinc ---------------------------------------------------------------------------


def test_sinc_coefficients_are_least_squares():
    """They minimise the error of the ideal shift over the band, so no other weights do better."""
    f = np.linspace(0, 0.5 * (0.066 + 0.265 * math.log(8)), 4001)
    j = np.arange(8) - 3
    for d in (0.1, 0.5, 0.873):
        error = lambda w: np.trapezoid(np.abs(np.exp(2j * np.pi * np.outer(f, j)) @ w - np.exp(2j * np.pi * f * d)) ** 2, f)
        w = sinc.coefficients(d)
        assert error(w) < 1e-4
        for k in range(8):
            for step in (1e-3, -1e-3):
                assert error(w + step * np.eye(8)[k]) > error(w)


def test_sinc_table_by_loops():
    rng = np.random.default_rng(3)
    x, places = rng.normal(size=(4, 20)), rng.uniform(-6, 26, size=(4, 30))
    places[0, :4] = [3.0, 7.999999, -0.0001, 19.0]
    got = sinc.at_places(x, places, left=1.5, right=-2.0)
    for row in range(4):
        for p, v in zip(places[row], got[row]):
            whole = math.floor(p)
            w = sinc.table()[int((p - whole) * 512 + 0.5)]
            want = sum(c * (1.5 if at < 0 else -2.0 if at >= 20 else x[row, at]) for c, at in zip(w, range(whole - 3, whole + 5)))
            assert abs(v - want) < 1e-12
    t = np.arange(200) * 0.004
    wave = np.sin(2 * np.pi * 30 * t)[None]
    assert np.abs(sinc.shift(0.0017)(wave, 0.004) - np.sin(2 * np.pi * 30 * (t + 0.0017)))[0, 10:-10].max() < 0.01
    assert np.abs(sinc.resample(100, 0.003, 0.1)(wave, 0.004) - np.sin(2 * np.pi * 30 * (0.1 + 0.003 * np.arange(100)))).max() < 0.01
    assert sinc.table().shape == (513, 8) and np.array_equal(sinc.table()[[0, -1]], np.eye(8)[[3, 4]])


# --- dips -----------------------------------------------------------------------------


def runav(x, length):
    h = length // 2
    return [float(np.mean(x[max(0, i - h) : i + h + 1])) for i in range(len(x))]


def brute_dips(panel, dt, length, width):
    """Dips of a panel (list of traces in order) by loops."""
    n, nt = len(panel), len(panel[0])
    lows, slopes = [], []
    for x in panel:
        level = runav(runav(np.abs(x), 1 + int(0.4 / dt)), 1 + int(0.4 / dt))
        a, b = dips.low_frequencies(np.array([x]), dt, 3.0, 20.0, 0.4)
        m = 40  # a transform length itself
        f = np.fft.rfftfreq(m, dt)
        c = np.fft.rfft(np.array(x) / (np.array(level) + 1e-30), m) * ((f / 3) ** 4 / ((1 + (f / 3) ** 4) * (1 + (f / 20) ** 4)))
        s = c * 2j * np.pi * np.arange(len(f)) / m
        s[-1] = 0
        assert np.allclose(a[0], np.fft.irfft(c, m)[:nt]) and np.allclose(b[0], np.fft.irfft(s, m)[:nt])
        lows.append(np.fft.irfft(c, m)[:nt]), slopes.append(np.fft.irfft(s, m)[:nt])
    step = [lows[k + 1] - lows[k] for k in range(n - 1)]
    step.append(step[-1] if step else np.zeros(nt))
    x = [np.array(runav(runav(s * b, length), length)) for s, b in zip(step, slopes)]
    y = [np.array(runav(runav(b * b, length), length)) for b in slopes]
    if n == 1:
        x, y = [np.zeros(nt)], [np.zeros(nt)]
    for _ in range(2 if width > 1 else 0):
        h = width // 2
        x, y = ([np.mean(v[max(0, i - h) : i + h + 1], axis=0) for i in range(n)] for v in (x, y))
    return [-a / (b + 1e-30) for a, b in zip(x, y)]


@pytest.mark.parametrize("width, rows", [(1, None), (3, None), (3, 9)])
def test_dips_and_new_traces_by_loops(spark, monkeypatch, width, rows):
    if rows:
        monkeypatch.setattr(blocks, "ROWS", rows)
    rng = np.random.default_rng(6)
    panels = {"hot": rng.normal(size=(40, 40)), "two": rng.normal(size=(2, 40)), None: rng.normal(size=(1, 40))}
    rows_ = [(100 * i + 7 * k, p, d.tolist()) for i, (p, x) in enumerate(panels.items()) for k, d in enumerate(x)]
    df = spark.createDataFrame(rows_, "seq long, panel string, data array<double>").repartition(4)
    got = {(r.seq, r.between): np.array(r.data) for r in dips.interpolate_traces(df, ["panel"], 2, 0.004, width=width).collect()}
    picked = {r.seq: np.array(r.dip) for r in dips.dip_picks(df, ["panel"], 0.004, width=width).collect()}
    assert len(got) == sum(3 * len(x) - 2 for x in panels.values())
    for i, x in enumerate(panels.values()):
        want = brute_dips(list(x), 0.004, 5, width)
        for k, p in enumerate(want):
            seq = 100 * i + 7 * k
            assert np.allclose(picked[seq], p, rtol=1e-6, atol=1e-9) and np.allclose(got[seq, 0], x[k])
            for m in (1, 2) if k + 1 < len(x) else ():
                a = sinc.at_places(x[k : k + 1], (np.arange(40) - p * m / 3)[None])[0]
                b = sinc.at_places(x[k + 1 : k + 2], (np.arange(40) + p * (1 - m / 3))[None])[0]
                assert np.allclose(got[seq, m], (1 - m / 3) * a + m / 3 * b, atol=1e-4)


def test_a_dipping_event_is_followed(spark):
    t = np.arange(64)
    trace = lambda k: np.exp(-(((t - 20 - 1.5 * k) / 5) ** 2)) * np.cos((t - 20 - 1.5 * k) / 4)
    df = spark.createDataFrame([(k, "p", trace(2 * k).tolist()) for k in range(8)] + [(50, "q", [0.0] * 64), (51, "q", None), (52, "q", [1.0] * 64)], "seq long, panel string, data array<double>")
    out = {(r.seq, r.between): r.data for r in dips.interpolate_traces(df, ["panel"], 1, 0.004).collect()}
    for k in range(2, 5):
        assert np.abs(np.array(out[k, 1]) - trace(2 * k + 1))[10:50].max() < 0.12
    assert (50, 1) not in out and (51, 1) not in out and out[51, 0] is None


def test_dips_run_once_in_slices(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(12, 30))
    rows = [x[k].tolist() if k != 5 else None for k in range(12)]
    after = [None if k in (3, 11) else rows[(k + 1) % 12] for k in range(12)]
    batch = pa.RecordBatch.from_pydict({"data": rows, "before_": [None if k in (3, 4) else rows[k - 1] for k in range(12)], "next_": after})
    whole = [a.to_pylist() for a in dips._products(batch, 0.004, 3.0, 20.0, 0.4, 5)]
    parts = [dips._products(b, 0.004, 3.0, 20.0, 0.4, 5) for b in stacks.in_slices([batch], 5)]
    assert len(parts) == 3 and whole[0][5] is None
    for k, want in enumerate(whole):
        got = [v for p in parts for v in p[k].to_pylist()]
        assert all((a is None and b is None) or np.allclose(a, b) for a, b in zip(got, want, strict=True))
    assert whole[0][3] == [0.0] * 30  # no neighbour at all
    df = spark.createDataFrame([(k, "p", v.tolist()) for k, v in enumerate(x)], "seq long, panel string, data array<double>")
    for out in (dips.dip_picks(df, ["panel"], 0.004).select("seq", F.posexplode("dip")), dips.interpolate_traces(df, ["panel"], 1, 0.004).select("seq", F.posexplode("data"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


# --- smoothing ---------------------------------------------------------------------------


def dense_line(links, x):
    """links: between consecutive rows."""
    n = len(x)
    m = np.eye(n)
    for i, w in enumerate(links):
        m[i, i] += w
        m[i + 1, i + 1] += w
        m[i, i + 1] -= w
        m[i + 1, i] -= w
    return np.linalg.solve(m, x)


@pytest.mark.parametrize("rows", [4096, 11])
def test_damped_lines_equal_dense_solutions(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "ROWS", rows)
    rng = np.random.default_rng(7)
    at = {p: np.cumsum(rng.integers(1, 9, size=n)) for p, n in (("hot", 150), (None, 5), ("one", 1))}
    x = {p: rng.normal(size=(len(a), 6)) for p, a in at.items()}
    given = [(p, int(s), v.tolist(), float(v[0])) for p in at for s, v in zip(at[p], x[p])] + [("one", 999, None, None)]
    df = spark.createDataFrame(given, "line string, at long, data array<double>, v double").repartition(4)
    for link, weight in ((smoothing.even_link(4.0), lambda d: 4.0), (smoothing.spaced_link(30.0), lambda d: 0.5 * (30 / 5.19) ** 2 / d**2), (smoothing.parted(smoothing.even_link(4.0), 6), lambda d: 4.0 * (d <= 6))):
        got = {(r.line, r["at"]): r.data for r in smoothing.smooth_across(df, ["line"], "at", "data", link).collect()}
        assert len(got) == 157 and got["one", 999] is None
        for p, a in at.items():
            want = dense_line([weight(d) for d in np.diff(a)], x[p])
            assert np.allclose([got[p, int(s)] for s in a], want, atol=1e-9)
    single = {(r.line, r["at"]): r.v for r in smoothing.smooth_across(df, ["line"], "at", "v", smoothing.even_link(4.0)).collect()}
    assert np.allclose([single["hot", int(s)] for s in at["hot"]], dense_line([4.0] * 149, x["hot"][:, 0])) and single["one", 999] is None
    assert smoothing.smooth_across(df.where("false"), ["line"], "at", "data", smoothing.even_link(4.0)).count() == 0


def test_short_lines_are_solved_together(spark):
    rng = np.random.default_rng(14)
    for sizes in ([5], [1, 7, 3, 7, 1, 2], [2, 2, 2]):
        before, after, x = rng.uniform(0, 3, sum(sizes)), rng.uniform(0, 3, sum(sizes)), rng.normal(size=(sum(sizes), 4))
        at = np.cumsum([0, *sizes])
        want = np.concatenate([smoothing.solve_line(before[i:j], after[i:j], x[i:j]) for i, j in zip(at, at[1:])])
        assert np.allclose(smoothing.solve_lines(before, after, x, np.array(sizes)), want)
    x = {p: rng.normal(size=(p % 3 + 1, 2 + p % 2)) for p in range(30)}  # lines of unlike lengths, arrays of unlike lengths
    df = spark.createDataFrame([(p, k, v.tolist()) for p, rows in x.items() for k, v in enumerate(rows)], "line int, at int, data array<double>")
    out = smoothing.smooth_across(df, ["line"], "at", "data", smoothing.even_link(4.0))
    got = {(r.line, r["at"]): r.data for r in out.collect()}
    for p, rows in x.items():
        assert np.allclose([got[p, k] for k in range(len(rows))], dense_line([4.0] * (len(rows) - 1), rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "GroupsInPandas" not in plan
    uneven = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0])], "line int, at int, data array<double>")
    with pytest.raises(Exception, match="one length"):
        smoothing.smooth_across(uneven, ["line"], "at", "data", smoothing.even_link(4.0)).collect()


def test_damped_samples():
    x = np.random.default_rng(8).normal(size=(3, 20))
    got = smoothing.damped(3.0)(x, 1.0)
    for row, y in zip(x, got):
        m = np.eye(20)
        for i in range(1, 20):
            m[i, i] += 2.25 * (1 if i == 19 else 2)
            m[i, i - 1] -= 2.25
            if i < 19:
                m[i, i + 1] -= 2.25
        assert np.allclose(y, np.linalg.solve(m, row)) and y[0] == row[0]
    assert smoothing.damped(3.0)(np.ones((1, 1)), 1.0).tolist() == [[1.0]]


@pytest.mark.parametrize("rows", [4096, 13])
def test_segments_by_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "ROWS", rows)
    rng = np.random.default_rng(9)
    at = np.cumsum(rng.choice([1, 1, 1, 2, 9], size=200))
    v = rng.normal(size=200)
    df = spark.createDataFrame([("hot", int(a), float(x)) for a, x in zip(at, v)] + [(None, 1, 2.0), (None, 2, None)], "line string, at long, v double").repartition(3)
    cuts = [0, *(np.flatnonzero(np.diff(at) > 2) + 1), 200]
    k = np.arange(-2, 3)
    local = np.linalg.pinv(np.vander(k, 5, increasing=True))[0]
    for method, weights in (("mean", np.ones(5) / 5), ("triangle", np.array([1, 2, 3, 2, 1]) / 9), ("savitzky_golay", local / local.sum()), ("median", None)):
        got = {(r.line, r["at"]): r.v for r in smoothing.smooth_segments(df, ["line"], "at", "v", 2, 2, method).collect()}
        assert len(got) == 202 and got[None, 2] is None
        for a, b in zip(cuts, cuts[1:]):
            s = v[a:b]
            for i in range(len(s)):
                if weights is None:
                    want = np.median(s[i - 2 : i + 3]) if 2 <= i < len(s) - 2 else s[i]
                else:
                    want = sum(w * s[i + j] for w, j in zip(weights, k) if 0 <= i + j < len(s))
                assert abs(got["hot", int(at[a + i])] - want) < 1e-9
    with pytest.raises(ValueError, match="no method"):
        smoothing.smooth_segments(df, ["line"], "at", "v", 2, 2, "other")


def test_smoothed_histogram(spark):
    v = np.random.default_rng(10).uniform(0, 10, 500)
    got = {r.bin: r.share for r in statistics.smoothed_histogram(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 0.0, 10.0, 20).collect()}
    n, _ = np.histogram(v, 20, (0, 10))
    want = np.array([sum(n[j] * math.exp(-math.pi * (i - j) ** 2) for j in range(20) if abs(i - j) <= 5) for i in range(20)])
    assert np.allclose([got[i + 1] for i in range(20)], want / want.sum())
    assert {r.share for r in statistics.smoothed_histogram(spark.createDataFrame([], "v double"), "v", 0.0, 10.0, 3).collect()} == {None}


# --- radial transforms and control points ---------------------------------------------------


def test_abel_of_known_functions():
    n, a = 200, 120.0
    r = np.arange(n, dtype=float)
    disc = (r <= a).astype(float)  # a disc gives the chord
    chord = 2 * np.sqrt(np.maximum(a * a - r * r, 0))
    got = radial.abel()(np.stack([disc, np.exp(-((r / 40) ** 2))]), 1.0)
    assert np.abs(got[0] - chord)[:110].max() < 0.01 * 2 * a
    assert np.abs(got[1] - 40 * math.sqrt(math.pi) * np.exp(-((r / 40) ** 2))).max() < 0.3  # a Gaussian gives a Gaussian
    x = np.random.default_rng(11).normal(size=(2, 30))
    for row, y in zip(x, radial.abel()(x, 1.0)):  # the bank of recursions by loops
        want = [row[0] + 2 * row[1:].sum()]
        for i in range(1, 30):
            total = 0.0
            for h, p in zip(radial.WEIGHTS, radial.EXPONENTS):
                state = 0.0
                for m in range(29, i - 1, -1):
                    q = (m + 1) / m
                    scale = 2 * h * m / ((p + 1) * (p + 2))
                    state = state * q**p + scale * (m + (p + 1 - m) * q ** (p + 1)) * (row[m + 1] if m < 29 else 0.0) - scale * (p + 2 + m - (m + 1) * q ** (p + 1)) * row[m]
                total += state
            want.append(total)
        assert np.allclose(y, want)


def test_hankel_there_and_back():
    r = np.arange(129, dtype=float)
    f = np.exp(-((r / 15) ** 2))[None]
    step = 2 * np.pi / 256
    back = radial.hankel(0)(radial.hankel(0)(f, 1.0), 1.0) * (2 * np.pi * step) ** 2 / 1.0
    scale = (back[0, :40] @ f[0, :40]) / (f[0, :40] @ f[0, :40])
    assert np.abs(back[0] / scale - f[0])[:60].max() < 0.03
    odd = (r * np.exp(-((r / 15) ** 2)))[None]
    again = radial.hankel(1)(radial.hankel(1)(odd, 1.0), 1.0)
    scale = (again[0, :40] @ odd[0, :40]) / (odd[0, :40] @ odd[0, :40])
    assert np.abs(again[0] / scale - odd[0])[:60].max() < 0.05 * odd.max()
    with pytest.raises(ValueError, match="order"):
        radial.hankel(2)
    assert radial.hankel(0)(np.ones((1, 1)), 1.0).tolist() == [[0.0]] and radial.abel()(np.ones((1, 1)), 1.0).tolist() == [[1.0]]


@pytest.mark.parametrize("mode", controls.EXTRAPOLATE)
def test_control_points_by_loops(spark, mode):
    rng = np.random.default_rng(12)
    xs, ys = [0.0, 3.0, 10.0, 11.0], [-5.0, 0.0, 8.0]
    v = {(x, y): float(rng.normal()) for x in xs for y in ys}
    given = [(x, y, z) for (x, y), z in v.items()]
    places = [(k, *(float(q) for q in rng.uniform(-9, 16, 2))) for k in range(200)] + [(900, 3.0, 0.0), (901, 11.0, 8.0), (902, None, 1.0), (903, 0.0, -5.0)]
    df = spark.createDataFrame(places, "k long, x double, y double")
    got = {r.k: r.value for r in controls.interpolate_controls(df, "x", "y", spark.createDataFrame(given, "x double, y double, z double"), "z", mode, mode).collect()}
    assert len(got) == 204 and got[902] is None and abs(got[900] - v[3.0, 0.0]) < 1e-12 and abs(got[901] - v[11.0, 8.0]) < 1e-12

    def part(q, lines):
        if q < lines[0] and mode not in ("both", "low"):
            q = lines[0]
        if q > lines[-1] and mode not in ("both", "high"):
            q = lines[-1]
        k = max(1, min(len(lines) - 1, sum(a <= q for a in lines)))
        return lines[k - 1], lines[k], (lines[k] - q) / (lines[k] - lines[k - 1])

    for k, x, y in places[:200]:
        a, b, p = part(x, xs)
        c, d, q = part(y, ys)
        want = p * (q * v[a, c] + (1 - q) * v[a, d]) + (1 - p) * (q * v[b, c] + (1 - q) * v[b, d])
        assert abs(got[k] - want) < 1e-9
    few = spark.createDataFrame([(2.0, y, v[0.0, y]) for y in ys], "x double, y double, z double")
    line = {r.k: r.value for r in controls.interpolate_controls(df, "x", "y", few, "z", mode, mode).collect()}
    c, d, q = part(places[0][2], ys)
    assert abs(line[0] - (q * v[0.0, c] + (1 - q) * v[0.0, d])) < 1e-9 and line[902] is None
    assert controls.interpolate_controls(df, "x", "y", few.where("false"), "z").where("value is not null").count() == 0
    holed = {r.k: r.value for r in controls.interpolate_controls(df, "x", "y", spark.createDataFrame(given[1:], "x double, y double, z double"), "z", mode, mode).collect()}
    assert holed[903] is None


# --- polar panels and fits ------------------------------------------------------------------


@pytest.mark.parametrize("rows", [4096, 7])
def test_polar_by_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "ROWS", rows)
    rng = np.random.default_rng(13)
    panels = {"a": rng.normal(size=(31, 33)), None: rng.normal(size=(9, 33))}
    df = spark.createDataFrame([(1000 * i + 3 * k, p, x.tolist()) for i, (p, m) in enumerate(panels.items()) for k, x in enumerate(m)], "seq long, panel string, data array<double>").repartition(4)
    got = {(r.panel, r.angle): r.data for r in polar.to_polar(df, ["panel"], (15.0, 16.0), 12, 10, 1.3).collect()}
    assert len(got) == 24

    def value(m, a, i):
        total = 0.0
        for p in (math.floor(a), math.floor(a) + 1):
            for q in (math.floor(i), math.floor(i) + 1):
                if 0 <= p < m.shape[0] and 0 <= q < m.shape[1]:
                    total += (1 - abs(a - p)) * (1 - abs(i - q)) * m[p, q]
        return total

    for p, m in panels.items():
        for angle in range(12):
            turn = 2 * math.pi / 12 * angle
            want = [value(m, 15 + math.sin(turn) * r * 1.3, 16 + math.cos(turn) * r * 1.3) for r in range(10)]
            assert np.allclose(got[p, angle], want, atol=1e-9)


def test_polar_and_back(spark):
    t, s = np.meshgrid(np.arange(41), np.arange(41), indexing="ij")
    m = np.exp(-(((t - 22) / 6.0) ** 2) - ((s - 18) / 7.0) ** 2)
    df = spark.createDataFrame([(k, "p", x.tolist()) for k, x in enumerate(m)], "seq long, panel string, data array<double>")
    made = polar.to_polar(df, ["panel"], (20.0, 20.0), 120, 60, 0.5)
    back = polar.from_polar(made, ["panel"], (20.0, 20.0), 120, 41, 41, 0.5).orderBy("place").collect()
    inside = (t - 20) ** 2 + (s - 20) ** 2 < 400
    assert np.abs(np.array([r.data for r in back]) - m)[inside].max() < 0.03


def test_incomplete_gamma():
    x = np.linspace(0, 60, 25)
    for a in (0.5, 1.0, 1.5, 2.0, 7.5, 40.0):
        grid = np.concatenate((np.linspace(0, 1, 200_001)[1:] ** 4, np.linspace(1, 400, 400_000)[1:]))
        f = np.exp((a - 1) * np.log(grid) - grid - math.lgamma(a))
        for v, q in zip(x, upper_gamma(np.full(25, a), x)):
            above = np.trapezoid(np.where(grid >= v, f, 0), grid)
            assert abs(q - above) < 2e-3 and 0 <= q <= 1
    assert np.allclose(upper_gamma(np.full(25, 1.0), x), np.exp(-x), rtol=1e-12) and np.allclose(upper_gamma(np.full(25, 2.0), x), np.exp(-x) * (1 + x), rtol=1e-12)
    assert abs(float(upper_gamma(np.array([0.5]), np.array([1.7]))[0]) - math.erfc(math.sqrt(1.7))) < 1e-14
    assert np.isnan(upper_gamma(np.array([0.0, 1.0, np.nan]), np.array([1.0, -1.0, 1.0]))).all()


def test_fits_without_enough_rows(spark):
    rows = [("one", 1.0, 2.0, 1.0), ("same", 3.0, 1.0, 1.0), ("same", 3.0, 2.0, 1.0), ("two", 0.0, 1.0, 2.0), ("two", 1.0, 3.0, 2.0), ("null", None, 1.0, 1.0)] + [("all", float(k), 2.0 * k + (-1) ** k, 1.0) for k in range(8)]
    got = {r.k: r for r in statistics.weighted_fit(spark.createDataFrame(rows, "k string, x double, y double, s double"), ["k"], "y", "x", "s").collect()}
    assert all(got[k].a is None and got[k].chi2 is None and got[k].q is None for k in ("one", "same", "null"))
    assert abs(got["two"].b - 2) < 1e-12 and got["two"].q is None
    x, y = np.arange(8.0), 2.0 * np.arange(8) + (-1.0) ** np.arange(8)
    b, a = np.polyfit(x, y, 1)
    chi2 = float(((y - a - b * x) ** 2).sum())
    r = got["all"]
    assert np.allclose([r.a, r.b, r.chi2], [a, b, chi2]) and abs(r.q - math.exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2)) < 1e-9
