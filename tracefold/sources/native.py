"""Native trace files as a Spark data source and sink.

A file is an int32 count, then for each trace a 160-byte header and its float32
samples, all in the byte order of the machine. The header's fields and offsets
are listed in ``FIELDS``; the last 12 bytes are padding and a stored pointer, 0.

The reader makes one partition for each stretch of records. Files of one sample
count are cut by arithmetic; ragged files by one pass over the headers that
skips the samples. ``headerOnly`` leaves the samples out. ``df.write.format("tracefile")``
writes one part file a partition in the given folder, on any file system that
``pyarrow.fs`` knows; appended parts follow those before, overwriting replaces
them. :func:`write_file` writes a single ordered file.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tracefold.schema import TRACE_SCHEMA

# Fixed record layout: field, type, count.
FIELDS = [
    ("n_sample", "u8", 1), ("d_sample", "f8", 1), ("sample_start", "f8", 1), ("offset", "f8", 1), ("tx_loc", "f8", 3), ("rx_loc", "f8", 3), ("mid_point", "f8", 3),
    ("line_id", "u8", 1), ("trace_id", "u8", 1), ("ensemble_number", "u8", 1), ("ensemble_trace_number", "u8", 1), ("ensemble_type", "i4", 1), ("sampling_unit", "u4", 1), ("sampling_domain", "u4", 1), ("padding", "u1", 12),
]
HEADER = np.dtype([(n, f"={t}" if t != "u1" else t) if c == 1 else (n, f"={t}" if t != "u1" else t, (c,)) for n, t, c in FIELDS])
assert HEADER.itemsize == 160


def encode(row) -> bytes:
    """One trace record; row is any mapping or Row with the trace columns."""
    h = np.zeros(1, dtype=HEADER)
    data = np.asarray(row["data"], dtype="=f4")
    for name, _, count in FIELDS[:-1]:
        value = row[name]
        h[name] = (0 if value is None else value) if count == 1 else [list(value or (0, 0, 0))]
    h["n_sample"] = len(data)
    return h.tobytes() + data.tobytes()


def decode(raw: bytes, seq: int, with_data: bool = True, data: np.ndarray | None = None) -> tuple:
    h = np.frombuffer(raw, dtype=HEADER, count=1)[0]
    out = [seq, int(h["n_sample"])]
    for name, kind, count in FIELDS[1:-1]:
        v = h[name]
        out.append({c: float(x) for c, x in zip("xyz", v)} if count == 3 else float(v) if kind == "f8" else int(v))
    out.append(data.tolist() if with_data and data is not None else None)
    return tuple(out)


def read_header(f) -> bytes:
    raw = f.read(HEADER.itemsize)
    if len(raw) != HEADER.itemsize:
        raise OSError("trace header is cut off")
    return raw


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def part_files(store: pafs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.base_name.endswith(".trc"))


def file_index(path: str, chunk: int) -> list[tuple[int, int, int]]:
    """(first trace, traces, byte offset) of stretches of about ``chunk`` records."""
    store, name = store_of(path)
    size = store.get_file_info(name).size
    with store.open_input_file(name) as f:
        first = f.read(4)
        if len(first) != 4:
            raise OSError("trace count is cut off")
        count = int(np.frombuffer(first, dtype="=i4")[0])
        if not count:
            return []
        n = int(np.frombuffer(read_header(f), dtype=HEADER)["n_sample"][0])
        step = HEADER.itemsize + 4 * n
        if size == 4 + count * step:
            f.seek(4 + (count - 1) * step)
            if int(np.frombuffer(read_header(f), dtype=HEADER)["n_sample"][0]) == n:
                return [(k, min(chunk, count - k), 4 + k * step) for k in range(0, count, chunk)]
        out, at = [], 4
        for k in range(count):
            if k % chunk == 0:
                out.append((k, min(chunk, count - k), at))
            f.seek(at)
            at += HEADER.itemsize + 4 * int(np.frombuffer(read_header(f), dtype=HEADER)["n_sample"][0])
        if at > size:
            raise OSError("trace samples are cut off")
        return out


class _Stretch(InputPartition):
    def __init__(self, path: str, first: int, count: int, at: int):
        self.path, self.first, self.count, self.at = path, first, count, at


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("tracesPerPartition", 10_000))
        self.with_data = str(options.get("headerOnly", "false")).lower() != "true"

    def _files(self) -> list[str]:
        store, root = store_of(self.path)
        if store.get_file_info(root).type != pafs.FileType.Directory:
            return [self.path]
        head = self.path.rstrip("/")
        return [f"{head}/{os.path.basename(n)}" for n in part_files(store, root)]

    def partitions(self):
        out, before = [], 0
        for path in self._files():
            index = file_index(path, self.chunk)
            out += [_Stretch(path, before + k, n, at) for k, n, at in index]
            before += sum(n for _, n, _ in index)
        return out

    def read(self, partition: _Stretch | None) -> Iterator[tuple]:
        if partition is None:  # no files, or none with traces
            return
        store, name = store_of(partition.path)
        with store.open_input_file(name) as f:
            f.seek(partition.at)
            for k in range(partition.count):
                raw = read_header(f)
                n = int(np.frombuffer(raw, dtype=HEADER)["n_sample"][0])
                if self.with_data:
                    body = f.read(4 * n)
                    if len(body) != 4 * n:
                        raise OSError("trace samples are cut off")
                    yield decode(raw, partition.first + k, True, np.frombuffer(body, dtype="=f4"))
                else:
                    f.seek(f.tell() + 4 * n)
                    yield decode(raw, partition.first + k, False)


class _Written(WriterCommitMessage):
    def __init__(self, temp: str, final: str):
        self.temp, self.final = temp, final


class _Writer(DataSourceWriter):
    """Part files under names of this job alone, visible once it commits; overwriting removes the parts that were there before."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        # parts sort in the order they were written in: appended ones come last
        have = [os.path.basename(n) for n in part_files(store, root)]
        self.number = 0 if overwrite or not have else 1 + max(int(n.split("-")[1]) if n.split("-")[1].isdigit() else 0 for n in have)

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        store, root = store_of(self.path)
        part = TaskContext.get().partitionId()
        temp = f"{root}/.{uuid.uuid4().hex}.tmp"
        body, count = io.BytesIO(), 0
        with store.open_output_stream(f"{temp}.body") as f:
            for row in rows:
                body.write(encode(row))
                count += 1
                if body.tell() > 1 << 22:
                    f.write(body.getvalue())
                    body = io.BytesIO()
            f.write(body.getvalue())
        # object stores can't go back to the count at the start, so the body is copied behind it
        with store.open_output_stream(temp) as f, store.open_input_stream(f"{temp}.body") as g:
            f.write(np.array([count], dtype="=i4").tobytes())
            while piece := g.read(1 << 22):
                f.write(piece)
        store.delete_file(f"{temp}.body")
        return _Written(temp, f"{root}/part-{self.number:06d}-{part:06d}-{self.job}.trc")

    def commit(self, messages) -> None:
        store, root = store_of(self.path)
        old = part_files(store, root) if self.overwrite else []
        for m in messages:
            if m:
                store.move(m.temp, m.final)
        for name in old:
            store.delete_file(name)

    def abort(self, messages) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            if m and store.get_file_info(m.temp).type == pafs.FileType.File:
                store.delete_file(m.temp)


class TraceFile(DataSource):
    """``spark.read.format("tracefile").load(path)``; a file, or a folder of part files."""

    @classmethod
    def name(cls) -> str:
        return "tracefile"

    def schema(self):
        return TRACE_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def read_file(spark: SparkSession, path: str, header_only: bool = False, traces_per_partition: int = 10_000) -> DataFrame:
    spark.dataSource.register(TraceFile)
    return spark.read.format("tracefile").option("headerOnly", str(header_only).lower()).option("tracesPerPartition", traces_per_partition).load(path)


def write_stream(traces: DataFrame, out) -> int:
    """Write one ordered file to an open binary stream, a partition at a time; returns the number of traces.

    For a file that leaves the cluster: rows come to the driver one partition after another, never all at once.
    """
    n = traces.count()
    out.write(np.array([n], dtype="=i4").tobytes())
    for row in traces.orderBy("seq").toLocalIterator():
        out.write(encode(row))
    return n


def write_file(traces: DataFrame, path: str) -> DataFrame:
    """Write one ordered file, and return the traces read from it."""
    with open(path, "wb") as f:
        write_stream(traces, f)
        f.flush()
        os.fsync(f.fileno())
    return read_file(traces.sparkSession, path)


def swap_bytes(x, endian: str = ">"):
    """Values stored in a byte order to native ones, or back: '>' big, '<' little, '<>' big with swapped 16-bit pairs."""
    if endian not in (">", "<", "<>"):
        raise ValueError(f"unknown byte order {endian!r}")
    a = np.asarray(x)
    little = np.little_endian
    if endian == "<":
        out = a if little else a.byteswap()
    elif endian == ">":
        out = a.byteswap() if little else a
    else:
        pairs = np.atleast_1d(a).view("u2").byteswap().view(a.dtype).reshape(a.shape)
        out = pairs.byteswap() if little else pairs
    return out if isinstance(x, np.ndarray) else out.dtype.type(out)


def arrow_headers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch without its samples."""
    return batch.select([n for n in batch.schema.names if n != "data"])
