"""Best-fit packing of token sequences (bounded-space online best fit).

Each Spark partition streams its documents once. A fixed number of bins is
open; a bitset keyed by free space finds the fullest bin that still has room,
and when one bin too many is open the fullest closes first. The bins that are
still open at a partition's end are then packed into each other by the same
method, fullest first, in groups of about ``REGROUPED`` bins, so that the number
of partitions costs few sequences. Only such bins (number and fill) are dealt by
key; a task holds the open bins, or one group, so the work is linear in the text
and a hot source or a group of copies needs no special care.

Defined results: null text counts as empty (one piece, the end id alone);
documents longer than the capacity are cut into pieces of the capacity, the
first one shorter; repeated rows are packed each; a null doc_id stays null; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.bpe import default_vocabulary, encoder
from tracefold.llm.common import materialise, tidied

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
OPEN_BINS = 1024
REGROUPED = 200_000


class BestFit:
    """Online best fit with at most ``open_bins`` bins open at once."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self._free_bits = 0  # bit f is set: some open bin has f places free
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._open = 0
        self.opened = 0

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        found = bins.pop()
        if not bins:
            self._free_bits &= ~(1 << free)
        self._open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1 to ``capacity`` tokens."""
        fits = self._free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            where = self._take(free)
        else:
            free, where = self.capacity, self.opened
            self.opened += 1
        left = free - size
        if left:
            self._by_free[left].append(where)
            self._free_bits |= 1 << left
            self._open += 1
            if self._open > self.open_bins:  # the fullest closes first
                self._take((self._free_bits & -self._free_bits).bit_length() - 1)
        return where, self.capacity - free

    def left_open(self) -> list[tuple[int, int]]:
        """(bin, places used) of the bins that are still open."""
        return [(where, self.capacity - free) for free, bins in enumerate(self._by_free) for where in bins]


def _merged(capacity: int, open_bins: int):
    """Bins packed into each other: bin, the sequence it becomes part of, and where it begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: list[tuple[int, int]] = []
        for batch in batches:
            bins += zip(batch["length"].to_pylist(), batch["sequence_id"].to_pylist(), strict=True)
        bins.sort(reverse=True)
        fit, names, rows = BestFit(capacity, open_bins), [], []
        for used, name in bins:
            where, offset = fit.place(used)
            if where == len(names):  # a sequence goes by the first bin's number
                names.append(name)
            rows.append((name, names[where], offset))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["bin", "into", "shift"])

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    ``with_ids`` adds the ids of each piece (little-endian unsigned 32-bit
    binary), so that sorting by (sequence_id, offset) yields the sequences.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = SCHEMA + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x == "piece" else pa.binary() if x == "ids" else pa.int64() for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fit = encoder(vocabulary), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        table = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
        for batch in batches:
            own = batch["doc_id"].to_pylist()
            for first, last, ids, cuts in enc.encode_column(batch["text"], end_id):
                cols: list[list] = [[] for _ in names]
                raw = memoryview(ids.tobytes())
                cuts = cuts.tolist()
                for doc_id, begin, end in zip(own[first:last], cuts, cuts[1:]):
                    total, start, piece = end - begin, 0, 0
                    length = total % capacity or capacity
                    while start < total:
                        where, offset = fit.place(length)
                        part = raw[4 * (begin + start) : 4 * (begin + start + length)]
                        row = (doc_id, piece, start, length, zlib.crc32(part), base + where, offset, *((bytes(part),) if with_ids else ()))
                        for col, v in zip(cols, row, strict=True):
                            col.append(v)
                        start, piece, length = start + length, piece + 1, capacity
                yield table(cols)
        # a row with piece -1 for each bin that is still open
        rest = [(None, -1, None, used, None, base + where, None, *((None,) if with_ids else ())) for where, used in fit.left_open()]
        yield table([[r[k] for r in rest] for k in range(len(names))])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed, _ = materialise(texts.mapInArrow(tidied(run), schema), "pieces")
    bins = placed.where("piece = -1").select("length", "sequence_id")
    groups = max(1, -(-bins.count() // REGROUPED))
    moved, _ = materialise(bins.repartition(groups, F.xxhash64("sequence_id")).mapInArrow(tidied(_merged(capacity, open_bins)), "bin long, into long, shift long").where("bin <> into"), "moved-bins")
    return (
        placed.where("piece >= 0")
        .join(moved, F.col("sequence_id") == F.col("bin"), "left")
        .withColumns({"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
        .select(*names)
    )
