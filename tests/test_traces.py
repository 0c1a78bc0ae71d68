"""Trace sources, functions, filters and files against independent oracles."""

from __future__ import annotations

import io
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import whole_panels
from tracefold.operators import cross, kernels
from tracefold.plans import catalog
from tracefold.schema import from_arrays, vectors_as_traces
from tracefold.session import ship
from tracefold.sources import native, synthetics
from tracefold.streaming import gathers

SF = os.environ.get("TRACEFOLD_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="session")
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(shipped, duck, name):
    got = catalog.queries()[name](shipped, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert str(got[c].dtype) == str(want[c].dtype), c
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c], atol=2e-4, rtol=1e-6, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_finite_rows(shipped, name):
    got = catalog.queries()[name](shipped, SF).toPandas()
    assert len(got) and not got.isna().any().any()


@pytest.mark.parametrize("name, rows", [("one_pole_lowpass", 64), ("hilbert_transform", 64), ("convolve_ricker", 64), ("dft_amplitude", 33), ("trace_mix5", 64), ("trace_median5", 64)])
def test_queries_return_every_sample(shipped, name, rows):
    assert catalog.queries()[name](shipped, SF).count() == rows * shipped.read.parquet(f"{SF}/embeddings.parquet").count()


def test_butterworth_design():
    root = math.sqrt
    for zero, low, high in ((True, (8, 0.0613010), (7, 0.2371440)), (False, (10, 0.0672567), (9, 0.2199121))):
        r = root if zero else float
        for (poles, f3), args in ((low, (0.075, r(0.95), 0.05, r(0.05))), (high, (0.2, r(0.95), 0.275, r(0.05)))):
            n, f = kernels.butterworth_design(*args)
            assert n == poles and abs(f - f3) < 1e-6, (n, f, poles, f3)


def test_butterworth_response():
    for high in (False, True):
        for poles in (1, 2, 3, 8):
            x = np.zeros((1, 4096))
            x[0, 0] = 1
            h = np.abs(np.fft.rfft(kernels.butterworth(poles, 0.1, high, zero_phase=False)(x, 1.0)[0]))
            f = np.fft.rfftfreq(4096)
            ratio = np.tan(np.pi * np.clip(f, 1e-9, 0.5 - 1e-9)) / np.tan(np.pi * 0.1)
            want = 1 / np.sqrt(1 + (1 / ratio if high else ratio) ** (2 * poles))
            assert np.allclose(h, want, atol=1e-6)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.integers(2, 80), st.floats(-3, 3))
def test_filters_are_linear(k, n, a):
    rng = np.random.default_rng(n * 7 + k)
    x, y = rng.normal(size=(2, k, n))
    for f in (kernels.bandpass_kernel(), kernels.frequency_filter(), kernels.fractional(0.5), kernels.gaussian_smooth(5), kernels.savitzky_golay(2, 2), kernels.time_shift(0.003)):
        assert np.allclose(f(a * x + y, 0.004), a * f(x, 0.004) + f(y, 0.004), atol=1e-7)


def test_spectral_identities():
    x = np.random.default_rng(0).normal(size=(3, 64))
    assert np.allclose(kernels.frequency_filter([1, 2], [1, 1])(x, 0.004), x)
    assert np.allclose(kernels.fractional(0.0)(x, 0.004), x)
    assert np.allclose(kernels.phase_change(0.0, 180 / np.pi)(x, 0.004), x)
    assert np.allclose(kernels.time_shift(0.0)(x, 0.004), x)
    with pytest.raises(ValueError):
        kernels.frequency_filter([2, 1])
    with pytest.raises(ValueError):
        kernels.frequency_filter([1, 2], [0, 0])


def test_banded_kernels_by_dense_weights():
    x = np.random.default_rng(3).normal(size=(3, 50))
    d = np.subtract.outer(np.arange(50), np.arange(50)).astype(float)
    w = np.exp(-np.log(2) * (2 * d / 7) ** 2)
    assert np.allclose(kernels.gaussian_smooth(7)(x, 0.004), x @ (w / w.sum(axis=1, keepdims=True)).T)
    taper = lambda d: np.where(np.abs(d) < 4, np.sinc(d) * np.cos(np.pi * d / 8) ** 2, 0.0)
    for seconds in (0.0, 0.0013, -0.0071, 0.02, 0.5):
        assert np.allclose(kernels.time_shift(seconds)(x, 0.004), x @ taper(d - seconds / 0.004).T)
    for n_out, dt_out in ((80, 0.0031), (30, 0.009), (50, 0.004)):
        assert np.allclose(kernels.resample(n_out, dt_out)(x, 0.004), x @ taper(np.arange(n_out)[:, None] * dt_out / 0.004 - np.arange(50)[None, :]).T)
    assert kernels.gaussian_smooth(5)(np.ones((1, 200_000)), 0.004).shape == (1, 200_000)


def test_minimum_phase_keeps_amplitudes():
    x = np.zeros((1, 64))
    x[0, 20:23] = [1.0, 0.5, 0.2]  # already minimum phase but for its delay
    assert np.allclose(kernels.minimum_phase()(x, 0.004)[0, :3], [1.0, 0.5, 0.2], atol=1e-3)
    assert not kernels.minimum_phase()(np.zeros((1, 9)), 0.004).any()


def test_fft_lengths():
    found = kernels.fft_lengths()
    assert len(found) == 240 and found[-1] == 720720
    assert kernels.fft_length(17) == 18 and kernels.fft_length(720720) == 720720
    with pytest.raises(ValueError):
        kernels.fft_length(720721)
    assert kernels.real_fft_length(64) % 2 == 0 and kernels.real_fft_length(64) >= 64


def test_ragged_and_null_traces(shipped):
    df = shipped.createDataFrame([(0, 0.004, [1.0, 2.0, 3.0]), (1, 0.004, []), (2, 0.002, [1.0] * 40), (3, 0.004, None)], "seq long, d_sample double, data array<float>")
    got = {r.seq: r.data for r in kernels.butterworth_bandpass(df).collect()}
    assert len(got[0]) == 3 and got[1] == [] and len(got[2]) == 40 and got[3] is None
    want = kernels.bandpass_kernel()(np.ones((1, 40)), 0.002)[0]
    assert np.allclose(got[2], want, atol=1e-5)


def test_plane_facts(spark):
    total, live = 0.0, set()
    rows = synthetics.plane(spark).collect()
    for r in rows:
        total += sum(r.data)
        if any(r.data):
            live.add(r.seq)
    assert total == 75.0 and live == set(range(3, 28)) and rows[15].data[31] == 3.0
    assert {i for i, v in enumerate(rows[3].data) if v} == {7, 19, 31}
    assert synthetics.plane(spark, planes="liner").count() == 64
    with pytest.raises(TypeError):
        synthetics.plane(spark, planes=[(1, 2, 3)])


def test_linear_velocity_facts(spark):
    assert len(synthetics.segments([[1, (1.0, 4.0), (2.0, 2.0)]], 2 / 10 * math.sqrt(0.4 / 5))) == 40
    iw, w = synthetics.ricker_operator(5.0, 0.04)
    assert iw == -6 and len(w) == 13 and w[6] == 1.0 and len(synthetics.half_derivative()) == 41
    with pytest.raises(TypeError):
        synthetics.synlv(spark, nxs=3)
    # the reflector 2x + z = 6 dips away from receivers beyond x = 3, which it doesn't light
    rows = {r.seq: r for r in synthetics.synlv(spark).where("seq in (20, 80)").collect()}
    assert max(map(abs, rows[20].data)) > 0.01 and not any(rows[80].data)
    assert rows[20].ensemble_number == 21 and rows[20].mid_point.x == 1.0
    # energy arrives between the two-way times to the nearest and farthest segment
    near, far = (2 * math.hypot(1 - x, z) / 2.0 for x, z in ((2.0, 2.0), (1.0, 4.0)))
    live = [0.04 * i for i, v in enumerate(rows[20].data) if abs(v) > 0.02 * max(map(abs, rows[20].data))]
    assert near - 0.4 < live[0] and live[-1] < far + 1.0


def test_ray_times_in_a_gradient(spark):
    """Against numerical integration along the circular ray."""
    df = spark.createDataFrame([(0.0, 0.0, 1.5, 2.0), (0.3, 0.0, 0.3, 1.0), (2.0, 0.0, 0.0, 3.0)], "x0 double, z0 double, x double, z double")
    c = synthetics.ray_columns(*(F.col(n) for n in ("x0", "z0", "x", "z")), 2.0, 0.0, 0.5)
    for row in df.select("*", c["t"].alias("t"), c["c"].alias("c"), c["s"].alias("s")).collect():
        angle = math.atan2(row.s, row.c)
        x, z, t, dt = row.x0, row.z0, 0.0, row.t / 20000
        for _ in range(20000):  # dx = v sin, dz = v cos, d(angle) = g sin for the gradient along z
            v = 2.0 + 0.5 * z
            x, z, angle, t = x + v * math.sin(angle) * dt, z + v * math.cos(angle) * dt, angle + 0.5 * math.sin(angle) * dt, t + dt
        assert abs(x - row.x) < 2e-3 and abs(z - row.z) < 2e-3


def test_parts_are_replaced_or_added(shipped, tmp_path):
    shipped.dataSource.register(native.TraceFile)
    spike, path = synthetics.spike(shipped), f"file://{tmp_path}/replaced"
    save = lambda df, mode: df.write.format("tracefile").mode(mode).save(path)
    ids = lambda: [r.trace_id for r in native.read_file(shipped, path).orderBy("seq").collect()]
    save(spike.repartition(4), "append")
    assert sorted(ids()) == list(range(1, 33))
    three = spike.where("trace_id <= 3").coalesce(1).sortWithinPartitions("seq")
    save(three, "overwrite")
    assert ids() == [1, 2, 3]
    save(three, "append")
    save(spike.where("trace_id = 9").coalesce(1), "append")
    assert ids() == [1, 2, 3, 1, 2, 3, 9]
    save(spike.where("false"), "overwrite")
    assert ids() == [] and not [n for n in os.listdir(tmp_path / "replaced") if not n.endswith((".trc", ".crc"))]


def test_native_files(shipped, tmp_path):
    spike = synthetics.spike(shipped)
    path = str(tmp_path / "spike.trc")
    back = native.write_file(spike, path)
    assert os.path.getsize(path) == 13_316
    order = lambda df: [r.asDict(True) for r in df.orderBy("seq").collect()]
    assert order(back) == order(spike)
    out = io.BytesIO()
    native.write_stream(spike, out)
    assert out.getvalue() == open(path, "rb").read()
    assert native.read_file(shipped, path, traces_per_partition=5).rdd.getNumPartitions() == 7
    assert native.read_file(shipped, path, header_only=True).where("data is not null").count() == 0
    ragged = from_arrays(shipped, [[1.0], [1.0, 2.0], list(range(64)), []], 0.002)
    p2 = str(tmp_path / "ragged.trc")
    assert order(native.write_file(ragged, p2)) == order(ragged)
    shipped.dataSource.register(native.TraceFile)
    spike.repartition(4).write.format("tracefile").mode("append").save(str(tmp_path / "parts"))
    parts = native.read_file(shipped, str(tmp_path / "parts"))
    assert parts.count() == 32 and sorted(r.trace_id for r in parts.collect()) == list(range(1, 33))
    raw = open(path, "rb").read()
    for cut in (len(raw) - 10, 4 + 100):
        bad = str(tmp_path / f"cut{cut}.trc")
        open(bad, "wb").write(raw[:cut])
        with pytest.raises(Exception, match="cut off"):
            native.read_file(shipped, bad).collect()


@pytest.mark.parametrize("kind", ["u2", "u4", "u8", "i2", "i4", "i8", "f4", "f8"])
def test_byte_order(kind):
    raw = bytes(range(1, np.dtype(kind).itemsize + 1))
    x = np.frombuffer(raw * 10, dtype=kind)
    assert native.swap_bytes(x, ">").tobytes() == b"".join(x[i : i + 1].tobytes()[::-1] for i in range(10))
    assert native.swap_bytes(x, "<").tobytes() == x.tobytes()
    pairs = np.frombuffer(raw, dtype="u2").byteswap().tobytes()[::-1]
    assert native.swap_bytes(x, "<>").tobytes() == pairs * 10
    assert native.swap_bytes(x[0], ">") == native.swap_bytes(x, ">")[0]
    with pytest.raises(ValueError):
        native.swap_bytes(x, "!")
    with pytest.raises(ValueError):
        native.swap_bytes(x[:0], "!")


def test_panels(shipped):
    t = vectors_as_traces(shipped.read.parquet(f"{SF}/embeddings.parquet"))
    one = t.where("ensemble_number = 1")
    x = np.stack([r.data for r in one.orderBy("seq").collect()]).astype(float)
    take = lambda f: np.stack([r.data for r in cross.panel_map(one, ["ensemble_number"], f).orderBy("seq").collect()])
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(take(whole_panels.eigenimages(1, subtract=False)), s[0] * np.outer(u[:, 0], v[0]), atol=1e-4)
    for f in (whole_panels.dip_filter([-1, 1], [1, 1], 0.004, 1.0), whole_panels.radial_filter([0.1, 0.2], [1, 1]), whole_panels.separable_filter([0.1, 0.2], [1, 1], [0.1, 0.2], [1, 1]), whole_panels.radial_power(0.0), whole_panels.phase_coherence_filter(1, -1)):
        assert np.allclose(take(f), x, atol=1e-4)
    with pytest.raises(Exception, match="a panel of"):
        cross.panel_map(one, ["ensemble_number"], whole_panels.radial_power(0.0), max_traces=3).collect()


PANEL_WAYS = {
    "dip_filter": whole_panels.dip_filter([-0.002, -0.001, 0.001, 0.002], [0, 1, 1, 0], 0.004, 1.0),
    "radial_k_filter": whole_panels.radial_filter([0.05, 0.1, 0.4, 0.5], [0, 1, 1, 0]),
    "separable_k_filter": whole_panels.separable_filter([0.05, 0.1, 0.4, 0.5], [0, 1, 1, 0], [0.05, 0.1, 0.4, 0.5], [0, 1, 1, 0]),
    "fractional_k_filter": whole_panels.radial_power(0.5),
    "gaussian_k_filter": whole_panels.gaussian_panel(1.0, 1.0),
    "svd_filter": whole_panels.eigenimages(2),
    "phase_coherence_filter": whole_panels.phase_coherence_filter(),
    "low_frequency_array": whole_panels.low_frequency_array(0.004),
}


@pytest.mark.parametrize("name", PANEL_WAYS)
def test_panel_queries_gather_no_panel(shipped, monkeypatch, name):
    """Each panel query equals the same filter of whole panels in memory, and puts no panel in one task."""
    rows = vectors_as_traces(shipped.read.parquet(f"{SF}/embeddings.parquet")).orderBy("seq").collect()
    want = {}
    for label in {r.ensemble_number for r in rows}:
        own = [r for r in rows if r.ensemble_number == label]
        for r, y in zip(own, PANEL_WAYS[name](np.array([r.data for r in own], dtype=float), None)):
            want.update({(r.trace_id, it): v for it, v in enumerate(y)})
    monkeypatch.setattr(cross, "panel_map", None)
    got = {(r.vec_id, r.it): r.v for r in catalog.queries()[name](shipped, SF).collect()}
    assert set(got) == set(want)
    assert all(abs(v - want[k]) < 1e-5 + 1e-9 * abs(v) for k, v in got.items())


def test_panel_filters_transform_traces_once(spark):
    x = np.random.default_rng(16).normal(size=(9, 20))
    rows = [(k, "p", v.tolist()) for k, v in enumerate(x)] + [(20, None, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "seq long, panel string, data array<double>").coalesce(1)
    out = cross.filter_separable(df, ["panel"], [0.0, 1.0], [1, 1], [0.0, 1.0], [1, 1])  # a filter that passes all
    got = {r.seq: r.data for r in out.collect()}
    assert len(got) == 10 and np.allclose([got[k] for k in range(9)], x) and np.allclose(got[20], [1, 2, 4])
    plan = out.select("seq", F.posexplode("data"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan
    with pytest.raises(Exception, match="null trace"):
        cross.filter_separable(df.withColumn("data", F.when(F.col("seq") > 0, F.col("data"))), ["panel"], [0.0, 1.0], [1, 1], [0.0, 1.0], [1, 1]).collect()


def test_trimmed_spectrum_in_ranks(shipped):
    from tracefold.operators.kernels import real_fft_length

    t = vectors_as_traces(shipped.read.parquet(f"{SF}/embeddings.parquet"))
    rows, stacked = t.orderBy("seq").collect(), cross.trimmed_spectrum_stack(t, ["ensemble_number"])
    assert "FlatMapGroupsInPandas" not in stacked._jdf.queryExecution().toString()
    got = {r.ensemble_number: r for r in stacked.collect()}
    assert set(got) == {r.ensemble_number for r in rows}
    for label, r in got.items():
        x = np.array([q.data for q in rows if q.ensemble_number == label], dtype=float)
        s, k = np.fft.rfft(x, real_fft_length(64)), int(len(x) * 0.15 + 0.5)
        trim = lambda v: np.sort(v, axis=0)[k : len(x) - k].mean(axis=0)
        assert r.seq == min(q.seq for q in rows if q.ensemble_number == label)
        assert np.allclose(r.data, np.fft.irfft(trim(s.real) + 1j * trim(s.imag), real_fft_length(64))[:64], atol=1e-5)


def test_streaming_equals_batch(shipped, tmp_path):
    t = vectors_as_traces(shipped.read.parquet(f"{SF}/embeddings.parquet")).where("ensemble_number < 3").select("seq", "ensemble_number", F.col("data").cast("array<double>").alias("data"), "d_sample")
    src = str(tmp_path / "in")
    t.repartition(3).write.parquet(src)
    fold = {r.ensemble_number: r["count"] for r in t.groupBy("ensemble_number").count().collect()}
    least = min(fold.values())
    stream = shipped.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = gathers.complete_gathers(stream.where(f"seq >= 0"), least).writeStream.format("memory").queryName("gathers").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = shipped.table("gathers").collect()
    assert {r.ensemble_number for r in got} == set(fold) and all(r.complete and r.n_traces >= least for r in got)
    q = kernels.butterworth_bandpass(stream).writeStream.format("memory").queryName("filtered").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    order = lambda df: [(r.seq, r.data) for r in df.orderBy("seq").collect()]
    assert order(shipped.table("filtered")) == order(kernels.butterworth_bandpass(t))


def test_running_quantile():
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000)
    q = gathers.RunningQuantile(0.9)
    for v in x:
        q.update(float(v))
        q = gathers.RunningQuantile(0.9, q.state())  # through its stored state
    assert abs(q.value() - np.quantile(x, 0.9)) < 0.03
    few = gathers.RunningQuantile(0.5)
    assert few.value() != few.value()
    for v in (3.0, 1.0, 2.0):
        few.update(v)
    assert few.value() == 2.0
