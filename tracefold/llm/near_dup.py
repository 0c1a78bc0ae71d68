"""Near-duplicate components: banded MinHash, sequential Bayesian verification, exact check.

One pass over the texts gives each document's distinct five-word shingles as a
count, a 64-bit name of the whole set (the class), a signature of 288 minima in
8 bits each, and 48 band keys of 6 minima. Documents of one class are one node. A 128-bit digest of the
full set goes along: where a name stands for several sets, all but one are renamed.
Two sets of similarity 0.75 share no band with chance (1 - 0.75**6)**48, which
is 8e-5; at 0.8 it is 5e-7.

Candidates never come as all pairs of a bucket. First every member of a bucket
is compared with a few of the bucket's own members drawn by hash; pairs inside
one component are left out, since they can't change the result. What then
remains is exact: in each bucket that still holds several components, the
members outside its largest component are compared with the other components',
but for pairs that exact bounds on their intersection rule out.

A pair is pruned as soon as, after some batch of signature places, the posterior
probability of a similarity of 0.75 or more is under ``MISS``; the survivors are
verified on their full shingle sets. Only verified links count.

Defined results: null, empty and blank texts have no shingles and link with
nothing; a text of fewer than five words is one shingle; rows that repeat a
doc_id are rows of their own, each with the class of its text; a row without an
id is kept only if it reaches none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import words
from tracefold.llm.common import materialise, release, tidied
from tracefold.llm.components import connected_components, join_groups

BANDS, ROWS = 48, 6
SIGNATURE = BANDS * ROWS
FIRST_BANDS = 12
BATCH = 32
MISS = 1e-5
SIMILAR = (75, 100)
BLOCKS = 128  # hash blocks of the exact bound on intersections

_rng = np.random.default_rng(20240)
_XOR = _rng.integers(0, 1 << 32, size=(SIGNATURE, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, size=(SIGNATURE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_MUL = _rng.integers(0, 1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of 288 hash functions over a non-empty shingle set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, ((x[None, k : k + 2048] ^ _XOR) * _MUL).min(axis=1), out=out)
    return out


def set_name(shingles: np.ndarray) -> int:
    """A 64-bit name of the whole set, the same for equal sets only (but for hash collisions)."""
    total = words.mix(np.array([np.add.reduce(shingles * np.uint64(0x9FB21C651E98DF25)), np.bitwise_xor.reduce(shingles), len(shingles)], dtype=np.uint64))
    return int(words.mix(total[:1] * np.uint64(3) + total[1:2] * np.uint64(5) + total[2:] * np.uint64(7)).view(np.int64)[0])


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits of the full set (its hashes come sorted), to confirm that sets of one name are equal."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(name_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for a, b, raw, offsets in words.text_blocks(batch.column("text")):
            sizes, names, full, least = [], [], [], []
            for s in words.shingle_sets(raw, offsets):
                sizes.append(len(s))
                if len(s):
                    names.append(set_name(s) >> (64 - name_bits))
                    full.append(set_digest(s))
                    least.append(minima(s))
                else:
                    names.append(None)
                    full.append(None)
                    least.append(np.zeros(SIGNATURE, dtype=np.uint32))
            m = np.stack(least)
            keys = words.mix((m.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND_MUL).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(full, pa.binary()),
                    pa.array([x.tobytes() for x in m.astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))),
                ],
                ["doc_id", "n_shingles", "class", "full", "signature", "bands"],
            )


@lru_cache(maxsize=1)
def least_matches() -> np.ndarray:
    """By number of compared places (in batches): the fewest matches that keep a pair.

    A uniform prior on the similarity, and a match in 8 bits with probability
    J + (1 - J) / 256; a pair goes when P(J >= 0.75 | matches) < MISS.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    p = grid + (1 - grid) / 256
    high = grid >= SIMILAR[0] / SIMILAR[1]
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        keep = post[:, high].sum(axis=1) / post.sum(axis=1) >= MISS
        out.append(int(np.argmax(keep)))
    return np.array(out)


def _sequential(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches()
    for batch in batches:
        n = batch.num_rows
        sig = []
        for name in ("sig_a", "sig_b"):
            col = batch.column(name)
            data = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(n, SIGNATURE)
            sig.append(data)
        alive = np.arange(n)
        matches = np.zeros(n, dtype=np.int64)
        for k, least in enumerate(need):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (sig[0][alive, part] == sig[1][alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        take = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(matches[alive], pa.int64())], ["a", "b", "matches"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict = {}

    def shingles(key, text):
        if key not in last:
            if len(last) > 64:
                last.clear()
            (_, _, raw, offsets), *_ = words.text_blocks(pa.array([text], pa.string()))
            (last[key],) = words.shingle_sets(raw, offsets)
        return last[key]

    for batch in batches:
        ok = []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            x, y = shingles(a, ta), shingles(b, tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])


class _Search:
    """The tables of one run, and the steps that compare candidate pairs of classes."""

    def __init__(self, docs: DataFrame, name_bits: int):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.paths: list[str] = []
        self.name_bits, self.renamed = name_bits, None
        self.rows = self.keep(self.texts.mapInArrow(tidied(partial(_describe, name_bits)), "doc_id long, n_shingles long, class long, full binary, signature binary, bands array<long>"), "sets")
        self.classes = self._grouped()
        several = self.classes.where("least_full <> most_full").select("class", "least_full")
        if not several.isEmpty():
            others = self.rows.select("class", "full").join(several, "class").where("full <> least_full").select("class", "full").distinct()
            self.renamed = self.keep(others.withColumn("to", F.xxhash64("class", "full")), "renamed")
            self.rows = self.keep(self.settled(self.rows), "sets")
            self.classes = self._grouped()
        self.checked: DataFrame | None = None
        self.component: DataFrame | None = None

    def _grouped(self) -> DataFrame:
        firsts = [F.first(c).alias(c) for c in ("signature", "bands")]
        full = [F.min("full").alias("least_full"), F.max("full").alias("most_full")]
        return self.keep(self.rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("min_doc"), F.first("n_shingles").alias("n"), *firsts, *full), "classes")

    def settled(self, named: DataFrame) -> DataFrame:
        """Rows with a class and its full set's digest, under the class's new name where it has one."""
        if self.renamed is None:
            return named
        return named.join(self.renamed, ["class", "full"], "left").select(*[F.coalesce("to", "class").alias("class") if c == "class" else c for c in named.columns])

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label)
        self.paths.append(path)
        return out

    def crossing(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that aren't inside one component, each once, a < b."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.component is None:
            return pairs
        c = self.component
        return (
            pairs.join(c.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(c.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
            .select("a", "b")
        )

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """(a, b, matches) of the pairs that sequential comparison of signatures leaves."""
        side = lambda x: self.classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"))
        sig = lambda x: self.classes.select(F.col("class").alias(x), F.col("signature").alias(f"sig_{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(SIMILAR[1] * F.least("n_a", "n_b") >= SIMILAR[0] * F.greatest("n_a", "n_b")).select("a", "b")
        return self.keep(sized.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(tidied(_sequential), "a long, b long, matches long"), "pruned")

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """(class, text), one row for each of the classes."""
        wanted = wanted.join(self.classes.select("class", "min_doc"), "class").withColumnRenamed("min_doc", "doc_id")
        if not self.repeated:
            return self.texts.join(wanted, "doc_id").select("class", "text")
        ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
        named = self.texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").mapInArrow(tidied(partial(_named, self.name_bits)), "class long, full binary, text string")
        return self.settled(named).select("class", "text").join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])

    def linked(self, pairs: DataFrame) -> None:
        """Verify pairs on full sets, take in the links, and bring the components up to date."""
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = self.keep(pairs.select("a", "b"), "pairs")
        texts = self.keep(self.texts_of(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()), "texts")
        side = lambda x: texts.select(F.col("class").alias(x), F.col("text").alias(f"text_{x}"))
        done = self.keep(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(tidied(_exact), "a long, b long, linked boolean"), "links")
        self.checked = done.select("a", "b") if self.checked is None else self.checked.unionByName(done.select("a", "b"))
        links = done.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if self.component is None:
            self.component, path = connected_components(links)
            self.paths.append(path)
            return
        c = self.component
        between = (
            links.join(c.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
            .join(c.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
            .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        )
        moved, path = connected_components(between)
        self.paths.append(path)
        moved = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
        old = join_groups(c, moved, "component").select("node", F.coalesce("to", "component").alias("component"))
        new = moved.join(c, "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
        self.component = self.keep(old.unionByName(new), "components")

    @property
    def repeated(self) -> bool:
        """Whether some doc_id is null or stands for several rows, so that a text must be found by its class."""
        if not hasattr(self, "_repeated"):
            self._repeated = not self.rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
        return self._repeated


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in words.text_blocks(batch.column("text")):
            sets = list(words.shingle_sets(raw, offsets))
            own = np.repeat(batch.column("class").slice(a, b - a).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sets).view(np.int64))], ["class", "shingle"])


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in words.text_blocks(batch.column("text")):
            sets = list(words.shingle_sets(raw, offsets))
            counts = [np.bincount((s & np.uint64(BLOCKS - 1)).astype(np.int64), minlength=BLOCKS) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class").slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array([c.astype(np.int32) for c in counts], pa.list_(pa.int32()))],
                ["class", "n", "blocks"],
            )


def _named(name_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in words.text_blocks(batch.column("text")):
            sets = list(words.shingle_sets(raw, offsets))
            names = [set_name(s) >> (64 - name_bits) if len(s) else None for s in sets]
            full = [set_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(full, pa.binary()), batch.column("text").slice(a, b - a)], ["class", "full", "text"])


def near_duplicates(docs: DataFrame, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row a row of ``docs``.

    name_bits: length of a class's name; fewer bits give the same result with more renaming (for tests).
    """
    run = _Search(docs, name_bits)
    drawn = [F.min_by("class", F.xxhash64("class", "key", F.lit(k))).alias(f"r{k}") for k in range(3)]
    bands = run.classes.select("class", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *drawn).where("members > 1")
    hot = run.keep(bands.join(shared, "key"), "buckets")

    def star(rows: DataFrame, k: int) -> DataFrame:
        return rows.select(F.col("class").alias("a"), F.col(f"r{k}").alias("b"))

    # each class is first verified with its most alike drawn partner
    first = run.pruned(run.crossing(star(hot.where(F.col("band") < FIRST_BANDS), 0)))
    best = first.groupBy("b").agg(F.max_by("a", "matches").alias("a")).select("a", "b")
    run.linked(best.unionByName(first.groupBy("a").agg(F.max_by("b", "matches").alias("b")).select("a", "b")).distinct())
    # then with all drawn partners outside its component
    rest = run.pruned(run.crossing(star(hot, 0).unionByName(star(hot, 1)).unionByName(star(hot, 2)).unionByName(first.select("a", "b"))))
    run.linked(run.crossing(rest))
    # and what remains in buckets that hold several components, exactly
    c = run.component
    placed = run.keep(hot.select("key", "class").join(c.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    groups = placed.groupBy("key", "component").count()
    largest = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("component", F.struct("count", "component")).alias("largest")).where("n > 1").drop("n")
    open_ = placed.join(largest, "key")
    # bounds on what two sets can share: a shingle that no other of these classes has lies in no intersection,
    # and by hash block the others can't share more than the fewer that either has
    texts = run.keep(run.texts_of(open_.select("class").distinct()), "open-texts")
    rows = texts.mapInArrow(tidied(_shingle_rows), "class long, shingle long")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class")).where("n = 1").select("class", F.expr(f"shingle & {BLOCKS - 1}").cast("int").alias("block"))
    alone = alone.groupBy("class", "block").count().groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("block", F.col("count").cast("int")))).alias("alone"))
    sizes = texts.mapInArrow(tidied(_block_counts), "class long, n int, blocks array<int>").join(alone, "class", "left")
    sizes = sizes.withColumn("blocks", F.transform("blocks", lambda v, j: v - F.coalesce(F.try_element_at("alone", j), F.lit(0)))).drop("alone")
    sizes = sizes.withColumn("shared", F.aggregate("blocks", F.lit(0), lambda t, v: t + v)).where(SIMILAR[1] * F.col("shared") >= SIMILAR[0] * F.col("n"))
    bounded = run.keep(open_.join(run.keep(sizes, "bounds"), "class").select("key", "class", "component", "largest", "n", "shared", "blocks"), "open")
    side = lambda df, x: df.select("key", F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("component", "n", "shared", "blocks")])
    reach = lambda most: SIMILAR[1] * most >= SIMILAR[0] * (F.col("n_a") + F.col("n_b") - most)
    in_blocks = F.aggregate(F.zip_with("blocks_a", "blocks_b", lambda x, y: F.least(x, y)), F.lit(0), lambda t, v: t + v)
    few = side(bounded.where("component <> largest"), "a").join(side(bounded, "b"), "key")
    few = few.where((F.col("component_a") != F.col("component_b")) & reach(F.least("shared_a", "shared_b")) & reach(in_blocks))
    run.linked(run.pruned(run.crossing(few.select("a", "b"))))

    c = run.component
    node = run.keep(run.classes.select("class", "min_doc").join(c.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")), "nodes")
    least = node.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    by_class = join_groups(node, least, "component").select("class", "component_id")
    out, _ = materialise(
        run.rows.select("doc_id", "n_shingles", "class")
        .join(by_class, "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))),
        "near-duplicates",
    )
    release(docs.sparkSession, *run.paths)
    return out


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id
), c AS (
  SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
