"""Token files with fixed-width bit packing.

A shard file holds ids in the fewest bits that number the vocabulary. Ids are
cut into blocks; the header gives each block's byte offset, so that one block
can be read and unpacked with numpy without the others.

    magic 8 bytes | bits, block_ids, n_docs, n_blocks (u32 each) | n_ids u64
    block byte offsets u64[n_blocks + 1] (from the file's start)
    document ids i64[n_docs] | their null marks u8[n_docs] | first ids u64[n_docs + 1]
    blocks: ids in `bits` bits each, lowest bits first, whole bytes to a block

All numbers are little-endian. Shards are written by the tasks of one range
partitioned stage, so the shards in order of (partition, shard) hold the
documents in ascending doc_id order. A task writes under a temporary name and
renames, so a task that runs again after a lost executor replaces its own file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.bpe import default_vocabulary, encoder
from tracefold.llm.common import tidied

MAGIC = b"TFTOKEN1"
BLOCK_IDS = 4096
SHARD_IDS = 1 << 22
READ_IDS = 1 << 25


def id_bits(vocab_size: int) -> int:
    """The fewest bits that tell apart ids 0 to vocab_size - 1."""
    return max(1, (max(2, vocab_size) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill exactly ``bits`` bytes; the last group is padded with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 8)
    lanes = np.zeros((groups, 8), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits + 8), dtype=np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = lanes[:, k] << np.uint64(shift)
        for j in range(-(-(bits + shift) // 8)):
            out[:, byte + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :bits]).tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    groups = -(-n // 8)
    packed = np.zeros(groups * bits, dtype=np.uint8)
    packed[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    packed = packed.reshape(groups, bits)
    out = np.zeros((groups, 8), dtype="<u4")
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = np.zeros(groups, dtype=np.uint64)
        for j in range(-(-(bits + shift) // 8)):
            value |= packed[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """One shard file. ids: those of all documents, one after the other; lengths: how many each has."""
    first = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype("<u8")
    blocks = [pack_bits(ids[k : k + block_ids], bits) for k in range(0, len(ids), block_ids)]
    head = 8 + 16 + 8 + 8 * (len(blocks) + 1) + 9 * len(doc_ids) + 8 * (len(doc_ids) + 1)
    offsets = head + np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64)))
    return b"".join([
        MAGIC,
        np.array([bits, block_ids, len(doc_ids), len(blocks)], dtype="<u4").tobytes(),
        np.array([len(ids)], dtype="<u8").tobytes(),
        offsets.astype("<u8").tobytes(),
        np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
        np.array([x is None for x in doc_ids], dtype="u1").tobytes(),
        first.tobytes(),
        *blocks,
    ])


class ShardReader:
    """Random access to a shard; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self._in = source
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block_ids, n_docs, n_blocks = np.frombuffer(self._read(8, 16), dtype="<u4").tolist()
        self.n_ids = int(np.frombuffer(self._read(24, 8), dtype="<u8")[0])
        at = 32
        self.offsets = np.frombuffer(self._read(at, 8 * (n_blocks + 1)), dtype="<u8")
        at += 8 * (n_blocks + 1)
        ids = np.frombuffer(self._read(at, 8 * n_docs), dtype="<i8").tolist()
        missing = np.frombuffer(self._read(at + 8 * n_docs, n_docs), dtype="u1")
        self.doc_ids = [None if m else x for x, m in zip(ids, missing, strict=True)]
        self.first = np.frombuffer(self._read(at + 9 * n_docs, 8 * (n_docs + 1)), dtype="<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1; only the blocks that hold them are read."""
        if end <= start:
            return np.zeros(0, dtype="<u4")
        a, b = start // self.block_ids, -(-end // self.block_ids)
        raw = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        parts = []
        for k in range(a, b):
            part = raw[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])]
            parts.append(unpack_bits(part, min(self.block_ids, self.n_ids - k * self.block_ids), self.bits))
        return np.concatenate(parts)[start - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def write_token_files(docs: DataFrame, out_dir: str, vocabulary: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents' ids, each followed by ``end_id``, in ascending doc_id order.

    Returns the manifest (part, shard, path, n_docs, n_ids), one row a file. Null
    text is empty; null doc_ids come first; rows that share a doc_id are ordered
    by their text and may span partitions, so that a hot id isn't one task.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        bits = id_bits(max(enc.vocab_size, end_id + 1))
        store, root = pafs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        doc_ids, ids, lengths, size, rows = [], [], [], 0, []

        def flush():
            nonlocal size
            name = f"{root}/part-{part:06d}-{len(rows):05d}.tok"
            temp = f"{root}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(temp) as f:
                f.write(shard_bytes(doc_ids, np.concatenate(ids), np.concatenate(lengths), bits))
            store.move(temp, name)
            rows.append((part, len(rows), f"{out_dir}/{name.rpartition('/')[2]}", len(doc_ids), size))
            doc_ids.clear(), ids.clear(), lengths.clear()
            size = 0

        for batch in batches:
            own = batch["doc_id"].to_pylist()
            for a, b, got, cuts in enc.encode_column(batch["text"], end_id):
                while a < b:  # as many documents as still fit into the shard, one at least
                    n = max(1, int(np.searchsorted(cuts, cuts[0] + shard_ids - size, side="left")))
                    n = min(n, b - a)
                    doc_ids += own[a : a + n]
                    ids.append(got[cuts[0] : cuts[n]])
                    lengths.append(np.diff(cuts[: n + 1]))
                    size += int(cuts[n] - cuts[0])
                    a, cuts = a + n, cuts[n:]
                    if size >= shard_ids:
                        flush()
        if doc_ids:
            flush()
        names, kinds = ["part", "shard", "path", "n_docs", "n_ids"], [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(tidied(run), "part int, shard int, path string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    A partition's first id comes from the totals of the partitions before it: one
    number a partition reaches the driver, never one for each file or document.
    """
    spark = manifest.sparkSession
    before, bases, n_files = 0, [], manifest.count()
    for part, n in sorted(manifest.groupBy("part").agg(F.sum("n_ids")).collect()):
        bases.append((part, before))
        before += n
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        manifest.withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(spark.createDataFrame(bases, "part int, base long"), "part")
        .select("path", (F.col("base") + F.col("within")).alias("base"))
        # a given number of tasks, which isn't brought down for so small a table: READ_IDS ids each, a file each at most
        .repartition(max(1, min(n_files, max(spark.sparkContext.defaultParallelism, -(-before // READ_IDS)))), F.xxhash64("path"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    shard = ShardReader(f)
                    step = max(1, len(shard.doc_ids) // 16)
                    for k in range(0, len(shard.doc_ids), step):
                        some = range(k, min(k + step, len(shard.doc_ids)))
                        lo = int(shard.first[some.start])
                        ids = memoryview(shard.ids(lo, int(shard.first[some.stop])).tobytes())
                        first = (shard.first[some.start : some.stop + 1] - lo).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([shard.doc_ids[i] for i in some], pa.int64()),
                                pa.array([base + lo + x for x in first[:-1]], pa.int64()),
                                pa.array([b - a for a, b in zip(first, first[1:])], pa.int64()),
                                pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(first, first[1:])], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return files.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
