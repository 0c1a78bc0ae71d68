"""Exchange-format trace files: 240-byte headers with named keys, with or without line headers.

``spark.read.format("exchange").load(path)`` gives one row a trace: ``seq``, one
column a key, and ``data``. Options: ``endian`` (native, big, little),
``lineHeader`` (auto, true, false: a 3200-byte text and a 400-byte binary
header come first), ``variableLength``, ``headerOnly``, ``tracesPerPartition``.
With a line header the samples are decoded by its format code (1 IBM float,
2 int32, 3 int16, 5 IEEE float, 8 int8); without one they are IEEE floats.
The path is a file, or a folder of part files that :func:`write_exchange` made, on
any file system that ``pyarrow.fs`` knows.

Writing sends no row to the driver: tasks write the stretches of an ordered table
as parts, and what they return is a line each, so an attempt that failed leaves no
trace in the result. Parts have no frame of their own, so the file is the parts one
after the other; one task copies their bytes where a single file is asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracefold.operators.kernels import rows_of
from tracefold.operators.statistics import coordinate_multiplier
from tracefold.schema import as_traces, point
from tracefold.sources.native import store_of

# Fixed header keys in file order, with their binary types.
KEYS = (
    [(k, "i4") for k in "tracl tracr fldr tracf ep cdp cdpt".split()]
    + [(k, "i2") for k in "trid nvs nhs duse".split()]
    + [(k, "i4") for k in "offset gelev selev sdepth gdel sdel swdep gwdep".split()]
    + [(k, "i2") for k in "scalel scalco".split()]
    + [(k, "i4") for k in "sx sy gx gy".split()]
    + [(k, "i2") for k in "counit wevel swevel sut gut sstat gstat tstat laga lagb delrt muts mute".split()]
    + [(k, "u2") for k in "ns dt".split()]
    + [(k, "i2") for k in "gain igc igi corr sfs sfe slen styp stas stae tatyp afilf afils nofilf nofils lcf hcf lcs hcs year day hour minute sec timbas trwf grnors grnofr grnlof gaps otrav".split()]
    + [(k, "f4") for k in "d1 f1 d2 f2 ungpow unscale".split()]
    + [("ntr", "i4"), ("mark", "i2"), ("shortpad", "i2")]
)
TEXT_BYTES, BINARY_BYTES, HEADER_BYTES = 3200, 400, 240
# Fixed sample codes: binary type and bytes.
FORMATS = {1: ("ibm", 4), 2: ("i4", 4), 3: ("i2", 2), 5: ("f4", 4), 8: ("i1", 1)}
_SPARK = {"i4": T.IntegerType(), "i2": T.ShortType(), "u2": T.IntegerType(), "f4": T.FloatType()}
SCHEMA = T.StructType([T.StructField("seq", T.LongType(), False), *[T.StructField(k, _SPARK[t]) for k, t in KEYS], T.StructField("data", T.ArrayType(T.FloatType()))])


def header_type(order: str) -> np.dtype:
    out = np.dtype([(k, order + t) for k, t in KEYS] + [("unass", order + "i2", (14,))])
    assert out.itemsize == HEADER_BYTES
    return out


def byte_order(endian: str) -> str:
    return {"native": "=", "big": ">", "little": "<"}[endian]


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """IBM single precision (as unsigned 32-bit values) to doubles: sign, base-16 exponent over 64, 24-bit fraction."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    return sign * (raw & 0xFFFFFF).astype(np.float64) / 2.0**24 * 16.0 ** (((raw >> 24) & 0x7F).astype(np.float64) - 64)


def float_to_ibm(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    a = np.abs(x)
    with np.errstate(divide="ignore"):
        e = np.where(a > 0, np.floor(np.log2(np.where(a > 0, a, 1.0)) / 4) + 1, -64).astype(int)
    m = np.rint(a / 16.0**e * 2**24).astype(np.int64)
    e, m = np.where(m >= 1 << 24, e + 1, e), np.where(m >= 1 << 24, m >> 4, m)
    return np.where(a > 0, (np.where(x < 0, 1, 0) << 31) | ((e + 64) << 24) | m, 0).astype(np.uint32)


def looks_like_text(raw: bytes) -> str | None:
    """'ascii' or 'cp037' (EBCDIC), whichever gives more letters, digits and blanks, if over nine tenths are printable."""
    best = None
    for codec in ("ascii", "cp037"):
        text = raw.decode(codec, "replace").replace("\ufffd", "\0")
        plain = sum(c.isalnum() or c == " " for c in text)
        if raw and sum(c.isprintable() or c in "\r\n" for c in text) > 0.9 * len(text) and (best is None or plain > best[0]):
            best = (plain, codec)
    return best[1] if best else None


def text_header(path: str) -> list[str]:
    """The 40 lines of a file's text header."""
    store, name = store_of(_files(path)[0])
    with store.open_input_file(name) as f:
        raw = f.read(TEXT_BYTES)
    text = raw.decode(looks_like_text(raw[:240]) or "ascii", "replace")
    return [text[k : k + 80] for k in range(0, TEXT_BYTES, 80)]


def _files(path: str) -> list[str]:
    """The file, or the part files of a folder in order."""
    store, root = store_of(path)
    if store.get_file_info(root).type != pafs.FileType.Directory:
        return [path]
    found = store.get_file_info(pafs.FileSelector(root))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name) if x.is_file and not x.base_name.startswith((".", "_"))]


class _Part(InputPartition):
    def __init__(self, path: str, first: int, count: int, at: int, kind: str, width: int):
        self.path, self.first, self.count, self.at, self.kind, self.width = path, first, count, at, kind, width


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        yes = lambda k: str(options.get(k, "false")).lower() == "true"
        self.path, self.order = options["path"], byte_order(options.get("endian", "native"))
        self.line, self.variable, self.header_only = options.get("lineHeader", "auto"), yes("variableLength"), yes("headerOnly")
        self.chunk = int(options.get("tracesPerPartition", 10_000))

    def partitions(self):
        out: list[_Part] = []
        kind, width, ns = "f4", 4, None
        head = header_type(self.order)
        for number, path in enumerate(_files(self.path)):
            store, name = store_of(path)
            size, at = store.get_file_info(name).size, 0
            with store.open_input_file(name) as f:
                if number == 0:
                    start = f.read(HEADER_BYTES)
                    if self.line == "true" or (self.line == "auto" and len(start) == HEADER_BYTES and looks_like_text(start)):
                        f.seek(TEXT_BYTES)
                        binary = f.read(BINARY_BYTES)
                        code = int(np.frombuffer(binary[24:26], dtype=self.order + "u2")[0])
                        kind, width = FORMATS.get(code, ("f4", 4))
                        at = TEXT_BYTES + BINARY_BYTES
                if size > at:
                    before = out[-1].first + out[-1].count if out else 0
                    found, ns = self._stretches(f, at, size, head, width, ns)
                    out += [_Part(path, before + a, n, b, kind, width) for a, n, b in found]
        return out

    def _stretches(self, f, at: int, size: int, head: np.dtype, width: int, given: int | None) -> tuple[list[tuple[int, int, int]], int]:
        """(first trace, traces, byte offset) of stretches of a file, and its number of samples."""

        def samples_at(at: int) -> int:
            f.seek(at)
            raw = f.read(HEADER_BYTES)
            if len(raw) != HEADER_BYTES:
                raise OSError("trace header is cut off")
            return int(np.frombuffer(raw, dtype=head)["ns"][0])

        ns = samples_at(at)
        if not self.variable:
            step = HEADER_BYTES + width * ns
            if (size - at) % step or given not in (None, ns):
                raise OSError("traces of unequal length, or samples cut off")
            count = (size - at) // step
            return [(k, min(self.chunk, count - k), at + k * step) for k in range(0, count, self.chunk)], ns
        out, k = [], 0
        while at < size:
            if k % self.chunk == 0:
                out.append([k, 0, at])
            at += HEADER_BYTES + width * samples_at(at)
            out[-1][1] += 1
            k += 1
        if at > size:
            raise OSError("trace samples are cut off")
        return [tuple(x) for x in out], ns

    def read(self, part: _Part | None) -> Iterator[tuple]:
        if part is None:  # no files, or none with traces
            return
        head = header_type(self.order)
        first_ns = None
        store, name = store_of(part.path)
        with store.open_input_file(name) as f:
            f.seek(part.at)
            for k in range(part.count):
                h = np.frombuffer(f.read(HEADER_BYTES), dtype=head)[0]
                ns = int(h["ns"])
                first_ns = ns if first_ns is None else first_ns
                if not self.variable and ns != first_ns:
                    raise OSError(f"trace {part.first + k} has {ns} samples, not {first_ns}")
                data = None
                if self.header_only:
                    f.seek(f.tell() + part.width * ns)
                else:
                    raw = np.frombuffer(f.read(part.width * ns), dtype=self.order + ("u4" if part.kind == "ibm" else part.kind))
                    data = (ibm_to_float(raw) if part.kind == "ibm" else raw).astype(np.float32).tolist()
                yield (part.first + k, *(float(h[n]) if t == "f4" else int(h[n]) for n, t in KEYS), data)


class ExchangeFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_exchange(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ExchangeFile)
    return spark.read.format("exchange").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(path)


def encode_batch(batch: pa.RecordBatch, order: str, kind: str) -> bytes:
    """The traces of a batch, one after the other; missing and null keys are 0."""
    rows = rows_of(batch.column("data"))
    ns = np.array([len(r) for r in rows], dtype=np.int64)
    if len(ns) and ns.max() > 65_535:
        raise ValueError("a trace has more than 65535 samples")
    head = header_type(order)
    h = np.zeros(len(rows), dtype=head)
    for k, _ in KEYS:
        if k in batch.schema.names:
            h[k] = pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False)
    h["ns"] = ns
    stored = lambda x: float_to_ibm(x).astype(order + "u4") if kind == "ibm" else x.astype(order + kind)
    if len(ns) and (ns == ns[0]).all():
        data = stored(np.stack(rows))
        out = np.zeros(len(rows), dtype=[("h", head), ("d", data.dtype, (int(ns[0]),))])
        out["h"], out["d"] = h, data
        return out.tobytes()
    return b"".join(x.tobytes() + stored(r).tobytes() for x, r in zip(h, rows))


def _line_headers(order: str, text: list[str], dt: int, ns: int, sample_code: int) -> bytes:
    binary = np.zeros(BINARY_BYTES // 2, dtype=order + "u2")
    binary[8], binary[10], binary[12] = dt, ns, sample_code
    return "".join(f"{t[:80]:<80}" for t in (text + [""] * 40)[:40]).encode("cp037") + binary.tobytes()


def write_exchange(traces: DataFrame, path: str, endian: str = "native", text: list[str] | None = None, sample_code: int = 5, single: bool = True) -> int:
    """Write traces in the order of ``seq``, as one file or (``single`` false) a folder of parts; returns their number.

    With ``text`` lines the line headers come first, and samples are in ``sample_code``. What was at the path is replaced
    once everything is written.
    """
    order = byte_order(endian)
    kind, _ = FORMATS[sample_code if text is not None else 5]
    folder = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        part, n, first = TaskContext.get().partitionId(), 0, (0, 0)
        name = f"part-{part + 1:06d}-{uuid.uuid4().hex}.su"
        with store.open_output_stream(f"{root}/{name}") as f:
            for batch in batches:
                if batch.num_rows and not n:
                    dt = batch.column("dt")[0].as_py() if "dt" in batch.schema.names else 0
                    first = (dt or 0, len(rows_of(batch.column("data").slice(0, 1))[0]))
                n += batch.num_rows
                for k in range(0, batch.num_rows, 1000):
                    f.write(encode_batch(batch.slice(k, 1000), order, kind))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, n, *first)], ["part", "name", "n", "dt", "ns"])

    keys = [c for c, _ in KEYS if c in traces.columns]
    ordered = traces.select("seq", *keys, "data").repartitionByRange("seq").sortWithinPartitions("seq")
    written = sorted(ordered.mapInArrow(write, "part long, name string, n long, dt long, ns long").collect())  # a line for each task
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    first = written[0] if written else None
    head = _line_headers(order, text, first.dt if first else 0, first.ns if first else 0, sample_code) if text is not None else b""
    names = [r.name for r in written]
    if head:
        names.insert(0, "part-000000-head.su")
        with store.open_output_stream(f"{root}/{names[0]}") as f:
            f.write(head)
    _, final = store_of(path)
    if single:

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = store_of(folder)
            for _ in batches:
                pass
            name = f"whole-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{name}") as f:
                for x in names:
                    with store.open_input_stream(f"{root}/{x}") as g:
                        while piece := g.read(1 << 22):
                            f.write(piece)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        whole = traces.sparkSession.range(0, 1, 1, 1).mapInArrow(copy, "name string").first()["name"]
        _clear(store, final)
        store.move(f"{root}/{whole}", final)
        store.delete_dir(root)
        return sum(r.n for r in written)
    for x in store.get_file_info(pafs.FileSelector(root)):
        if x.base_name not in names:  # of attempts that didn't count
            store.delete_file(x.path)
    _clear(store, final)
    store.move(root, final)
    return sum(r.n for r in written)


def _clear(store: pafs.FileSystem, path: str) -> None:
    kind = store.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        store.delete_dir(path)
    elif kind == pafs.FileType.File:
        store.delete_file(path)


def exchange_as_traces(df: DataFrame) -> DataFrame:
    """The trace table of an exchange table: coordinates scaled, interval in seconds (dt) or d1."""
    xy, z = coordinate_multiplier(F.col("scalco")), coordinate_multiplier(F.col("scalel"))
    return as_traces(
        df.select(
            "seq", "data",
            F.when(F.col("dt") > 0, F.col("dt") * 1e-6).otherwise(F.col("d1").cast("double")).alias("d_sample"),
            (F.col("delrt") * 1e-3).alias("sample_start"),
            F.col("offset").cast("double").alias("offset"),
            point(F.col("sx") * xy, F.col("sy") * xy, F.col("selev") * z).alias("tx_loc"),
            point(F.col("gx") * xy, F.col("gy") * xy, F.col("gelev") * z).alias("rx_loc"),
            F.col("fldr").cast("long").alias("line_id"), F.col("tracl").cast("long").alias("trace_id"), F.col("cdp").cast("long").alias("ensemble_number"), F.col("cdpt").cast("long").alias("ensemble_trace_number"),
        )
    )
