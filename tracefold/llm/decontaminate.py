"""Benchmark decontamination: SimHash of item-sized windows and multi-index Hamming search.

The benchmark is cut into blocks of about ``BLOCK_ITEMS`` items, or fewer longer
ones; a block's index is the only thing sent to the tasks, so its size is bounded.
Each block is searched over all documents, and its leaks are written before the
next one's index is made, so that no two are held at once.

In a document, windows of exactly an item's number of words are told by 64-bit
SimHashes of their weighted five-word shingles. Fingerprints within ``RADIUS``
bits differ in at most ``PROBED`` bits in at least one of the bit blocks (if each
differed in more, the blocks together would in more than RADIUS), so looking up
all values that near in the blocks' tables finds all of them. So wide a radius
lets through about half of unlike items as well; what it passes is compared in
all 64 bits, and then verified by the exact weighted Jaccard similarity of the
two shingle multisets, 0.75 or more. A shingle weighs ln(1 + items / items that
have it) over the whole benchmark, however it is cut into blocks, with 1 where
no item has it.

Only windows that hold a shingle of some item of their size are made, since
another window has similarity 0 with every item. Of two shingle multisets with
similarity 0.75, about 11 of 64 bits differ (standard deviation 3).

Defined results: null or blank texts and items match nothing; an item or window
of fewer than five words is one shingle; rows that repeat an id give their own
rows; no document or no item gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import words
from tracefold.llm.common import materialise, tidied

WIDTH = 5
RADIUS = 20
PROBED = 2  # so there are (RADIUS + 1) / (PROBED + 1) bit blocks
THRESHOLD = 0.75
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 40_000_000  # of items that are together on the driver, on average
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_BITS = np.arange(64, dtype=np.uint64)
_MARK_BITS = 20


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def bit_blocks(radius: int = RADIUS, probed: int = PROBED) -> list[tuple[int, int]]:
    """(shift, width) of bit blocks that make up 64 bits, so many that ``probed`` more bits in each exceed the radius."""
    edges = np.linspace(0, 64, -(-(radius + 1) // (probed + 1)) + 1).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=4)
def _flips(width: int, probed: int = PROBED) -> tuple[int, ...]:
    """What to xor a block's value with to get all values within ``probed`` bits."""
    return tuple(sum(1 << b for b in some) for n in range(probed + 1) for some in combinations(range(width), n))


def item_shingles(items: list[tuple[int, str]]) -> list[tuple[int, int, np.ndarray]]:
    """(item, words, shingles) of the items that have words."""
    out = []
    if items:
        for _, _, raw, offsets in words.text_blocks(pa.array([t or "" for _, t in items], pa.string()), 1 << 62):
            h, first = words.word_hashes(raw, offsets)
            out += [(item, int(b - a), words.shingle_hashes(h[a:b], min(WIDTH, int(b - a)))) for (item, _), a, b in zip(items, first, first[1:]) if b > a]
    return out


class Index:
    """Items of one block: shingles, weights, fingerprints by size and bit block."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int] | None = None, total: int | None = None):
        """frequency: in how many of all ``total`` items each shingle is; without it these are all items."""
        own = item_shingles(items)
        self.ids, self.sizes, self.shingles = [x for x, _, _ in own], [n for _, n, _ in own], [s for _, _, s in own]
        df = Counter(x for s in self.shingles for x in set(s.tolist())) if frequency is None else frequency
        self.known = np.array(sorted({x for s in self.shingles for x in s.tolist()}), dtype=np.uint64)
        self.total = len(own) if total is None else total
        n = len(own)
        self.weights = np.log(1 + self.total / np.array([df[x] for x in self.known.tolist()], dtype=np.float64))
        self.bags = [Counter(s.tolist()) for s in self.shingles]
        self.marks = np.zeros(1 << _MARK_BITS, dtype=bool)
        self.marks[(self.known >> np.uint64(64 - _MARK_BITS)).astype(np.int64)] = True
        self.sizes_of: dict[int, set[int]] = defaultdict(set)
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        self.prints = np.zeros(n, dtype=np.uint64)
        for k, s in enumerate(self.shingles):
            self.prints[k] = _fingerprints((_signs(s) * self.weight(s)[:, None]).sum(axis=0)[None, :])[0]
            for x in s.tolist():
                self.sizes_of[x].add(self.sizes[k])
            tables = self.tables.setdefault(self.sizes[k], [defaultdict(list) for _ in bit_blocks()])
            for table, (shift, width) in zip(tables, bit_blocks()):
                table[(int(self.prints[k]) >> shift) & ((1 << width) - 1)].append(k)
        self.widths = sorted({min(WIDTH, s) for s in self.sizes})

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, shingles), max(0, len(self.known) - 1))
        return np.where(self.known[at] == shingles, self.weights[at], np.log(1 + self.total))

    def near(self, size: int, fingerprint: int) -> set[int]:
        """All items of ``size`` words whose fingerprint differs in at most RADIUS bits."""
        found: set[int] = set()
        for table, (shift, width) in zip(self.tables[size], bit_blocks()):
            value = (fingerprint >> shift) & ((1 << width) - 1)
            for flip in _flips(width):
                found.update(table.get(value ^ flip, ()))
        return {k for k in found if (int(self.prints[k]) ^ fingerprint).bit_count() <= RADIUS}

    def similarity(self, k: int, window: np.ndarray, weights: np.ndarray) -> float:
        theirs, w = Counter(window.tolist()), dict(zip(window.tolist(), weights.tolist()))
        ours = self.bags[k]
        w.update(zip(self.shingles[k].tolist(), self.weight(self.shingles[k]).tolist()))
        keys = theirs.keys() | ours.keys()
        union = sum(w[x] * max(theirs[x], ours[x]) for x in keys)
        return sum(w[x] * min(theirs[x], ours[x]) for x in keys) / union if union else 0.0

    def matches(self, h: np.ndarray, hits: dict[int, np.ndarray]) -> list[tuple[int, float, int, int]]:
        """Best window for each item: (item, similarity, first word, words). hits: places by shingle width."""
        best: dict[int, tuple[float, int, int]] = {}
        for width, places in hits.items():
            s = words.shingle_hashes(h, width)
            w = self.weight(s)
            starts: dict[int, set[int]] = defaultdict(set)
            for p in places.tolist():
                for size in self.sizes_of.get(int(s[p]), ()):
                    if min(WIDTH, size) == width:
                        starts[size].update(range(max(0, p + width - size), min(p, len(h) - size) + 1))
                        if len(h) < size:  # the whole of a shorter text
                            starts[size].add(0)
            for size, found in starts.items():
                n = size - width + 1
                at = np.array(sorted(found), dtype=np.int64)
                lo, hi = int(at[0]), min(len(s), int(at[-1]) + n)
                sums = np.concatenate((np.zeros((1, 64)), np.cumsum(_signs(s[lo:hi]) * w[lo:hi, None], axis=0)))
                ends = np.minimum(at + n, hi)
                prints = _fingerprints(sums[ends - lo] - sums[at - lo])
                for a, e, f in zip(at.tolist(), ends.tolist(), prints.tolist()):
                    for k in self.near(size, f):
                        sim = self.similarity(k, s[a:e], w[a:e])
                        if sim >= THRESHOLD and sim > best.get(k, (0,))[0]:
                            best[k] = (sim, a, min(size, len(h) - a))
        return [(k, *v) for k, v in best.items()]


def _search(docs: DataFrame, index: Index) -> tuple[DataFrame, Broadcast]:
    """The leaks of a block's items, and what was sent to find them."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for batch in batches:
            rows: list[tuple] = []
            for a, _, raw, offsets in words.text_blocks(batch.column("text")):
                h, first = words.word_hashes(raw, offsets)
                hits: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
                for width in ix.widths:
                    s = words.shingle_hashes(h, width)
                    at = np.flatnonzero(ix.marks[(s >> np.uint64(64 - _MARK_BITS)).astype(np.int64)])
                    at = at[np.isin(s[at], ix.known)]
                    row = np.searchsorted(first, at, side="right") - 1
                    inside = at + width <= first[row + 1]
                    at, row = at[inside], row[inside]
                    for r in np.unique(row).tolist():
                        hits[r][width] = at[row == r] - first[r]
                for r, own in hits.items():
                    doc_id = batch.column("doc_id")[a + r].as_py()
                    for k, sim, start, n in ix.matches(h[first[r] : first[r + 1]], own):
                        rows.append((doc_id, ix.ids[k], sim, start, n))
            rows.sort(key=str)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA), sent


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct shingles, and a null for the item."""
    for batch in batches:
        found = item_shingles(list(zip(batch["item_id"].to_pylist(), batch["text"].to_pylist())))
        rows = np.concatenate([np.unique(s) for _, _, s in found]) if found else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(rows.view(np.int64)), pa.nulls(len(found), pa.int64())])], ["shingle"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of each benchmark item found in a document (its best window)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(1, -(-n // block_items), -(-(chars or 0) // BLOCK_CHARS))
    if blocks == 1:
        return _search(docs, Index(sorted(((r[0], r[1]) for r in items.collect()), key=str)))[0]
    frequency, _ = materialise(items.mapInArrow(tidied(_frequency_rows), "shingle long").groupBy("shingle").count(), "item-shingles")
    total = frequency.where("shingle is null").agg(F.sum("count")).first()[0] or 0
    out = None
    for k in range(blocks):
        # blocks by hash: each is about block_items long, and all together are every item
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        own = frequency.join(some.mapInArrow(tidied(_frequency_rows), "shingle long").distinct(), "shingle", "left_semi").collect()  # those of a block
        index = Index(sorted(((r[0], r[1]) for r in some.collect()), key=str), {x & (1 << 64) - 1: n for x, n in own}, total)
        found, sent = _search(docs, index)
        found, _ = materialise(found, "block-leaks")
        sent.destroy()  # driver and executors hold one block's index at a time
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    # written first: the ids' true size then decides whether they are broadcast
    found, _ = materialise(find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_doc_id")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked_doc_id"]), "left_anti")
