"""Tau-p transforms against dense solutions, on odd and hot panels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.operators import radon
from tracefold.operators.kernels import real_fft_length

NT, DT, FIRST, STEP, COUNT = 40, 0.004, -2e-4, 1e-4, 6


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(4)
    rows = [(k, ["a", None, "b"][k % 3 if k % 7 else 0], float(rng.integers(0, 40) * 12.5), rng.normal(size=NT).tolist()) for k in range(90)]
    return rows


@pytest.fixture(scope="module")
def traces(spark, given):
    odd = [(900, "a", None, [1.0] * NT), (901, "a", 50.0, None), (902, "lone", None, [2.0] * NT)]
    return spark.createDataFrame(given + odd, "seq long, panel string, x double, data array<double>").withColumns({"k": F.lit("x"), "n": F.lit(1), "j": F.lit(0)}).repartition(5)


def panels(given):
    out = {}
    for k, panel, x, d in given:
        out.setdefault(panel, []).append((k, x, d))
    return {p: (np.array([r[0] for r in rs]), np.array([r[1] for r in rs]), np.array([r[2] for r in rs])) for p, rs in out.items()}


def spectra():
    n = real_fft_length(NT)
    return n, 2 * np.pi * np.fft.rfftfreq(n, DT)


def dense_radon(g, d, prewhite=0.01):
    """Model by forming and solving the dense normal equations at each frequency."""
    n, w = spectra()
    c = np.fft.rfft(d, n, axis=1)
    p = FIRST + STEP * np.arange(COUNT)
    out = np.zeros((COUNT, len(w)), dtype=complex)
    for j, f in enumerate(w):
        b = np.exp(-1j * f * np.outer(g, p))
        r = b.conj().T @ b / (len(g) * COUNT)
        out[:, j] = np.linalg.solve(r + prewhite * r[0, 0] * np.eye(COUNT), b.conj().T @ c[:, j] / len(g))
    return np.fft.irfft(out, n, axis=1)[:, :NT]


def dense_model(model, g, weight):
    n, w = spectra()
    u = np.fft.rfft(model, n, axis=1)
    p = FIRST + STEP * np.arange(COUNT)
    d = np.array([sum(u[k] * np.exp(-1j * w * p[k] * x) for k in range(COUNT)) for x in g]) * weight
    return np.fft.irfft(d, n, axis=1)[:, :NT]


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.panel, {})[r.ip] = r.data
    return {p: np.array([m[k] for k in sorted(m)]) for p, m in out.items()}


def test_radon_equals_dense_solution(traces, given, monkeypatch):
    model = radon.radon(traces, ["panel"], F.col("x"), NT, DT, FIRST, STEP, COUNT)
    got = collected(model)
    assert set(got) == {"a", None, "b"}  # "lone" has no usable trace
    for block in (radon.BLOCK, 7):
        monkeypatch.setattr(radon.dealt, "__defaults__", (block,))
        back = {r.seq: r.data for r in radon.inverse_radon(traces, model, ["panel"], F.col("x"), NT, DT, COUNT).collect()}
        assert len(back) == 93 and back[900] is None and back[902] is None and back[901] is not None
        for p, (seq, g, d) in panels(given).items():
            want = dense_radon(g, d)
            assert np.allclose(got[p], want, atol=1e-9)
            again = dense_model(want, g, 1 / COUNT)
            assert np.allclose([back[k] for k in seq], again, atol=1e-9)


def test_no_group_holds_a_panel(spark, given):
    one = spark.createDataFrame([(k, "hot", x, d) for k, _, x, d in given], "seq long, panel string, x double, data array<double>")
    dealt = radon.dealt(one, ["panel"], 10)
    sizes = [r["count"] for r in dealt.groupBy("panel", "block_").count().collect()]
    assert sum(sizes) == 90 and max(sizes) <= 25 and len(sizes) >= 5
    sums = radon._sums(one.repartition(6), ["panel"], F.col("x"), NT, DT, radon.even_slopes(FIRST, STEP, COUNT), True)
    n, w = spectra()
    assert sums.count() == len(w) * COUNT  # what a panel's model gathers is bounded by the parameters


def test_slant_stacks_and_inverses(traces, given):
    model = radon.slant_stack(traces, ["panel"], F.col("x"), NT, DT, FIRST, STEP, COUNT, dx=12.5)
    got, (n, w) = collected(model), spectra()
    back = {r.seq: r.data for r in radon.inverse_slant_stack(traces, model, ["panel"], F.col("x"), NT, DT, STEP).collect()}
    projected = {r.seq: r.data for r in radon.filtered_back_projection(traces, model, ["panel"], F.col("x"), NT, DT, points=9).collect()}
    p = FIRST + STEP * np.arange(COUNT)
    full = np.fft.irfft(np.fft.rfftfreq(n, DT), n)
    rho = np.array([full[abs(k)] / full[0] for k in range(-4, 5)])
    assert np.allclose(radon.rho_filter(9, NT, DT), rho)
    for name, (seq, g, d) in panels(given).items():
        c = np.fft.rfft(d, n, axis=1)
        want = np.fft.irfft(np.array([12.5 * (c * np.exp(1j * np.outer(g * q, w))).sum(axis=0) for q in p]), n, axis=1)[:, :NT]
        assert np.allclose(got[name], want, atol=1e-8)
        assert np.allclose([back[k] for k in seq], dense_model(want, g, w / (2 * np.pi) * STEP), atol=1e-8)
        filtered = [np.convolve(m, rho)[4 : 4 + NT] for m in want]
        for k, x in zip(seq, g):
            at = [np.arange(NT) - x * q / DT for q in p]
            line = sum(np.interp(a, np.arange(-1, NT + 1), np.concatenate(([0], m, [0])), left=0, right=0) for a, m in zip(at, filtered))
            assert np.allclose(projected[k], line, atol=1e-7)


def test_a_linear_event_is_focused(spark):
    """An event on t = tau + p x becomes one spike of the model, and comes back."""
    n, w = spectra()
    x = np.arange(30) * 12.5
    spike = np.exp(-((np.arange(NT) - 15.0) ** 2) / 4)
    c = np.fft.rfft(spike, n)
    data = np.fft.irfft(c * np.exp(-1j * np.outer(x * 1e-4, w)), n, axis=1)[:, :NT]
    df = spark.createDataFrame([(k, "a", float(v), d.tolist()) for k, (v, d) in enumerate(zip(x, data))], "seq long, panel string, x double, data array<double>")
    model = radon.radon(df, ["panel"], F.col("x"), NT, DT, FIRST, STEP, COUNT, prewhite=1e-4)
    m = collected(model)["a"]
    assert np.abs(m).max(axis=1).argmax() == 3 and abs(np.abs(m[3]).argmax() - 15) <= 0
    back = np.array([r.data for r in radon.inverse_radon(df, model, ["panel"], F.col("x"), NT, DT, COUNT).orderBy("seq").collect()])
    assert np.abs(back - data)[:10].max() < 0.05


def test_empty_table(traces):
    none = traces.where("false")
    model = radon.radon(none, ["panel"], F.col("x"), NT, DT, FIRST, STEP, COUNT)
    assert model.count() == 0 and radon.inverse_radon(none, model, ["panel"], F.col("x"), NT, DT, COUNT).count() == 0
    with pytest.raises(ValueError, match="odd"):
        radon.rho_filter(8, NT, DT)


def test_singular_systems_give_zeros():
    assert not radon.solve_toeplitz(np.ones((1, 3), dtype=complex), np.ones((1, 3), dtype=complex)).any()
    assert np.allclose(radon.frequency_weights(40, 0.004, 30.0, 60.0)[[0, -1]], [1, 0])
