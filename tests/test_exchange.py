"""Exchange-format files, positioning records, curves and solvers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import curves
from tracefold.session import ship
from tracefold.sources import exchange, sps


@pytest.fixture(scope="module")
def shipped(spark):
    return ship(spark)


def frame(spark):
    rows = [(k, k + 1, 5 - k, 2000, -100, 12345 + k, [float(np.float32(np.sin(j + k))) for j in range(6)]) for k in range(7)]
    return spark.createDataFrame(rows, "seq long, tracl int, cdp int, dt int, scalco int, sx int, data array<float>")


@pytest.mark.parametrize("endian", ["native", "big", "little"])
def test_round_trip(shipped, tmp_path, endian):
    path, df = str(tmp_path / "x.su"), frame(shipped)
    assert exchange.write_exchange(df, path, endian) == 7
    got = exchange.read_exchange(shipped, path, endian=endian, tracesPerPartition=3)
    cols = df.columns
    assert got.rdd.getNumPartitions() == 3  # one file, cut by traces
    assert [tuple(r) for r in got.select(*cols).orderBy("seq").collect()] == [tuple(r) for r in df.orderBy("seq").collect()]
    assert exchange.read_exchange(shipped, path, endian=endian, headerOnly=True).where("data is null and ns = 6").count() == 7
    t = exchange.exchange_as_traces(got).orderBy("seq").first()
    assert t.d_sample == 0.002 and t.tx_loc.x == 123.45 and t.ensemble_number == 5


@pytest.mark.parametrize("code", [1, 2, 3, 5, 8])
def test_line_headers(shipped, tmp_path, code):
    path = str(tmp_path / f"x{code}.sgy")
    df = frame(shipped).withColumn("data", F.transform("data", lambda v: F.floor(v * 100).cast("float")))
    exchange.write_exchange(df, path, "big", text=["C 1 CLIENT somebody"], sample_code=code)
    assert exchange.text_header(path)[0].startswith("C 1 CLIENT somebody")
    got = exchange.read_exchange(shipped, path, endian="big").orderBy("seq").collect()
    assert [r.data for r in got] == [r.data for r in df.orderBy("seq").collect()]


def test_unequal_lengths(shipped, tmp_path):
    path = str(tmp_path / "v.su")
    df = shipped.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0]), (2, [])], "seq long, data array<float>")
    exchange.write_exchange(df, path)
    assert [r.data for r in exchange.read_exchange(shipped, path, variableLength=True).orderBy("seq").collect()] == [[1.0], [1.0, 2.0, 3.0], []]
    with pytest.raises(Exception, match="unequal length|samples, not"):
        exchange.read_exchange(shipped, path).collect()


def test_ibm_floats():
    raw = np.array([0x42640000, 0xC276A000, 0x00000000, 0x41100000], dtype=np.uint32)
    assert exchange.ibm_to_float(raw).tolist() == [100.0, -118.625, 0.0, 1.0]
    x = np.concatenate((np.random.default_rng(0).normal(size=1000) * 10.0 ** np.arange(-5, 5).repeat(100), [0.0]))
    assert np.allclose(exchange.ibm_to_float(exchange.float_to_ibm(x)), x, rtol=1e-6, atol=0)


def test_positioning(shipped, tmp_path):
    def put(fields, layout, kind):
        line = [" "] * 80
        line[0] = kind
        for n, a, b, _ in layout:
            if n in fields:
                line[a - 1 : b] = f"{fields[n]:>{b - a + 1}}"
        return "".join(line)

    for rev in ("0", "2.1"):
        path = str(tmp_path / f"s{rev}.txt")
        lines = ["H00 header", put({"line": 101, "point": 7, "easting": 1234.5, "code": "A1"}, sps.POINT[rev], "R"), put({"line": 5, "point": "x"}, sps.POINT[rev], "S"), put({"line": 5, "point": 7, "from_channel": 1, "to_channel": 5, "channel_increment": 2, "receiver_line": 101, "from_receiver": 10, "to_receiver": 14}, sps.RELATION[rev], "X")]
        open(path, "w").write("\n".join(lines))
        a, b = sps.read_points(shipped, path, rev).orderBy("kind").collect()
        assert (a.kind, a.line, a.point, a.easting, a.code, a.depth) == ("R", 101.0, 7.0, 1234.5, "A1", None) and b.point is None
        live = sps.receivers_of_shots(sps.read_relations(shipped, path, rev)).orderBy("channel").collect()
        assert [(r.channel, r.receiver) for r in live] == [(1, 10.0), (3, 12.0), (5, 14.0)]


def test_curves():
    x = np.array([0.0, 1.0, 2.5, 3.0, 5.0])
    at = np.linspace(0, 5, 41)
    for kind, slopes in curves.SLOPES.items():
        line = 2 * x - 1
        assert np.allclose(curves.evaluate(x, line, slopes(x, line), at), 2 * at - 1), kind
        y = np.array([0.0, 1.0, 1.0, 4.0, 4.5])
        got = curves.evaluate(x, y, slopes(x, y), at)
        assert np.allclose(curves.evaluate(x, y, slopes(x, y), x), y), kind
        if kind == "monotone":
            assert (np.diff(got) >= -1e-12).all()
    s = curves.natural_slopes(x, x**2)
    e = 1e-6
    second = lambda p: curves.evaluate(x, x**2, s, np.array([p]), 2)[0]
    assert abs(second(0.0)) < 1e-9 and abs(second(1 - e) - second(1 + e)) < 1e-4


def test_solvers(shipped):
    rng = np.random.default_rng(1)
    r = np.array([4.0, 1.0, 0.5, 0.2, 0.1])
    g = rng.normal(size=5)
    full = np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)])
    assert np.allclose(curves.levinson(r, g), np.linalg.solve(full, g))
    a, b, c = rng.random(5), 4 + rng.random(5), rng.random(5)
    tri = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
    assert np.allclose(curves.tridiagonal(a, b, c, g), np.linalg.solve(tri, g))
    df = shipped.createDataFrame([(r.tolist(), g.tolist(), [1.0, 2.0, 3.0], [1.0, 4.0, 9.0], [1.5])], "r array<double>, g array<double>, x array<double>, y array<double>, p array<double>")
    row = df.select(curves.toeplitz_solve("r", "g").alias("t"), curves.spline("x", "y", "p", "akima").alias("s"), curves.vandermonde_solve("x", "y").alias("v")).first()
    assert np.allclose(row.t, np.linalg.solve(full, g)) and abs(row.s[0] - 2.25) < 0.1
    assert np.allclose(np.vander([1.0, 2.0, 3.0], increasing=True).T @ row.v, [1, 4, 9])


def test_no_row_reaches_the_driver(shipped, tmp_path, monkeypatch):
    """A folder of parts and one file hold the same bytes; what comes to the driver is a line for each task."""
    from pyspark.sql import DataFrame

    df = shipped.range(5000).select(F.col("id").alias("seq"), F.col("id").cast("int").alias("tracl"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.col("id") + k).cast("float")).alias("data")).repartition(7)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of so few rows
    one, parts = str(tmp_path / "one.su"), str(tmp_path / "parts")
    assert exchange.write_exchange(df, one) == exchange.write_exchange(df, parts, single=False) == 5000
    shipped.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with open(one, "rb") as f:
        whole = f.read()
    pieces = [open(p, "rb").read() for p in exchange._files(parts)]
    assert len(pieces) > 1 and b"".join(pieces) == whole
    for path in (one, parts):
        got = exchange.read_exchange(shipped, path, tracesPerPartition=700).orderBy("seq").collect()
        assert [r.tracl for r in got] == [r.seq for r in got] == list(range(5000)) and got[77].data == [float(77 + k) for k in range(10)]
    assert exchange.write_exchange(df.where("seq < 3"), parts, single=False, text=["C 1"]) == 3  # replaced
    assert exchange.read_exchange(shipped, parts).count() == 3 and exchange.text_header(parts)[0].startswith("C 1")
    assert exchange.write_exchange(df.where("false"), one) == 0 and exchange.read_exchange(shipped, one).count() == 0
    with pytest.raises(Exception, match="65535"):
        exchange.write_exchange(shipped.range(1).select(F.col("id").alias("seq"), F.array_repeat(F.lit(0.0), 70_000).alias("data")), one)


def test_written_positions(shipped, tmp_path):
    df = shipped.createDataFrame([(1, 22, "AB", 5.5), (None, 7, None, -3.25)], "line int, point int, code string, easting double")
    for kind in "SR":
        sps.write_points(df, str(tmp_path / kind), kind)
        got = sps.read_points(shipped, str(tmp_path / kind)).orderBy("point").collect()
        assert [(r.kind, r.line, r.point, r.code, r.easting, r.day) for r in got] == [(kind, None, 7.0, None, -3.25, None), (kind, 1.0, 22.0, "AB", 5.5, None)]
    sps.write_relations(shipped.createDataFrame([(3, 9, 1, 4)], "record long, point int, from_channel int, to_channel int"), str(tmp_path / "x"))
    r = sps.read_relations(shipped, str(tmp_path / "x")).first()
    assert (r.record, r.point, r.from_channel, r.to_channel) == (3, 9.0, 1, 4)
