"""Hidden Markov language model over words: Baum-Welch over the whole corpus, exact scaled forward scores.

Symbols are the ``VOCABULARY`` most frequent training words (of equally frequent
ones at the end, those of least hash), one symbol for all other words, and the end
of a text. A word outside the vocabulary is told apart
by a unigram model over such words, so the model's probability of a text is
exact: that of its symbol sequence (scaled forward recursion over the whole
text) times that of each such word among them, (c + 1) / (N + V + 1).

Training: a few local iterations on about ``START_DOCS`` different documents (twice
as many at most, drawn by hash) give a starting point; then ``ROUNDS`` Baum-Welch rounds over all training documents.
Every task runs forward-backward over its documents and puts out expected counts,
which Spark sums over the partitions by symbol.

What grows with the corpus stays distributed: word counts are a table, and words
outside the vocabulary meet their counts in a join. Only the vocabulary with its
emissions (bounded) is sent to tasks.

Words are told by 64-bit hashes. Defined results: null and blank texts are the
end token alone; whole texts are read, and long ones are batched with few others;
repeated rows and ids count and score each; a null doc_id isn't held out; without
training documents scores come from the smoothing alone; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import words
from tracefold.llm.common import materialise, release, tidied

_log = logging.getLogger(__name__)

STATES = 8
VOCABULARY = 65_000
ROUNDS = 3
START_DOCS = 600
START_ROUNDS = 6
HELD_OUT = (7, 2)
SMOOTH = 0.05
_CELLS = 300_000  # places of one padded batch


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))


class Model:
    """start (K), move (K, K) and emit (symbols, K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        unigram = emit.sum(axis=1) + 1e-3
        unigram /= unigram.sum()
        e = emit + SMOOTH * len(unigram) * unigram[:, None]
        k = len(start)
        return cls((start + 1) / (start.sum() + k), (move + 1) / (move.sum(axis=1, keepdims=True) + k), e / e.sum(axis=0))


def padded(docs: list[np.ndarray]):
    """Index lists of documents of like length, so that a padded batch has few places."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]), reverse=True)
    k = 0
    while k < len(order):
        n = max(1, min(256, _CELLS // max(1, len(docs[order[k]]))))
        yield order[k : k + n]
        k += n


def forward(model: Model, docs: list[np.ndarray], keep: bool = False):
    """ln probability of each document (sorted by falling length); with ``keep`` also the scaled alphas and scales."""
    lengths = np.array([len(d) for d in docs])
    top = int(lengths[0])
    ids = np.zeros((top, len(docs)), dtype=np.int64)
    for j, d in enumerate(docs):
        ids[: len(d), j] = d
    live = np.searchsorted(-lengths, -np.arange(top), side="left")  # documents longer than t come first
    total = np.zeros(len(docs))
    alphas = np.zeros((top, len(docs), len(model.start))) if keep else None
    scales = np.ones((top, len(docs))) if keep else None
    a = model.start * model.emit[ids[0]]
    for t in range(top):
        if t:
            n = int(live[t])
            a = (a[:n] @ model.move) * model.emit[ids[t, :n]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        total[: len(c)] += np.log(c)
        if keep:
            alphas[t, : len(c)] = a
            scales[t, : len(c)] = c
    return (total, ids, live, alphas, scales) if keep else total


def expected_counts(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, move, emit) over documents of any lengths, and their ln likelihood."""
    k, symbols = len(model.start), len(model.emit)
    start, move, emit, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k)), 0.0
    for some in padded(docs):
        part = [docs[i] for i in some]
        total, ids, live, alphas, scales = forward(model, part, keep=True)
        likelihood += float(total.sum())
        top, n = ids.shape
        beta = np.ones((n, k))
        gammas = np.zeros_like(alphas)
        for t in range(top - 1, -1, -1):
            here = int(live[t]) if t else n
            if t + 1 < top:
                m = int(live[t + 1])
                u = model.emit[ids[t + 1, :m]] * beta[:m] / scales[t + 1, :m, None]
                move += model.move * (alphas[t, :m].T @ u)
                beta[:m] = u @ model.move.T
            gammas[t, :here] = alphas[t, :here] * beta[:here]
        start += gammas[0].sum(axis=0)
        flat, g = ids.reshape(-1), gammas.reshape(-1, k)
        for j in range(k):
            emit[:, j] += np.bincount(flat, weights=g[:, j], minlength=symbols)
    return start, move, emit, likelihood


def starting_model(docs: list[np.ndarray], unigram: np.ndarray, states: int = STATES, rounds: int = START_ROUNDS) -> Model:
    """States from groups of documents that share words with seed documents, then local Baum-Welch."""
    rng = np.random.default_rng(7)
    symbols = len(unigram)
    emit = np.repeat(unigram[:, None], states, axis=1) * 0.02 * max(1, sum(map(len, docs))) / states
    if docs:
        bags = [np.unique(d) for d in docs]
        rare = 1 / np.log(2 + unigram / unigram.min())
        seeds = [int(rng.integers(len(docs)))]
        mark = np.zeros((symbols, states))
        like = np.zeros((len(docs), states))
        for j in range(states):
            mark[bags[seeds[j]], j] = 1
            like[:, j] = [(mark[b, j] * rare[b]).sum() / rare[b].sum() for b in bags]
            seeds.append(int(np.argmin(like[:, : j + 1].max(axis=1))))  # next: the least like any so far
        for _ in range(3):
            own = like.argmax(axis=1)
            share = np.full((symbols, states), 1e-6)
            for d, j in zip(docs, own):
                share[:, j] += np.bincount(d, minlength=symbols)
            share /= share.sum(axis=0)
            logs = np.log(share + 1e-7)
            like = np.stack([logs[d].mean(axis=0) for d in docs])
        for d, j in zip(docs, like.argmax(axis=1)):
            emit[:, j] += np.bincount(d, minlength=symbols)
    model = Model.from_counts(np.ones(states), np.eye(states) * 50 * states + 1, emit)
    for _ in range(rounds if docs else 0):
        model = Model.from_counts(*expected_counts(model, docs)[:3])
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count) of a partition's texts; what is held is put out when it grows large."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = docs = 0

    def merged():
        w, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return w, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    def batch_of(w, c):
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["word", "count"])

    for batch in batches:
        docs += batch.num_rows
        for _, _, raw, offsets in words.text_blocks(batch.column("text")):
            h, _ = words.word_hashes(raw, offsets)
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield batch_of(*held[0])
                    held, size = [], 0
    if held:
        yield batch_of(*merged())
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], ["word", "count"])  # the end token


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, count) in training documents; the end token is the null word."""
    return _texts(docs).where("not held_out").select("text").mapInArrow(tidied(_counted), "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def choose_vocabulary(counts: DataFrame, most: int = VOCABULARY) -> list[tuple[int, int]]:
    """(word, count) of the ``most`` most frequent words; words of one count in the order of a hash."""
    known = counts.where("word is not null")
    # a level holds a word at least, so ``most`` levels are enough
    levels = known.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).limit(most).collect()
    held, cut, tied = 0, None, 0
    for level in levels:
        if held + level["n"] > most:
            cut, tied = level["count"], level["n"]
            break
        held += level["n"]
    least = cut if cut is not None else -1
    chosen = [(r[0], r[1]) for r in known.where(F.col("count") > least).collect()]
    rest = most - held
    if cut is not None and rest:
        place = F.pmod(F.xxhash64("word"), F.lit(1 << 40))
        level = known.where(F.col("count") == cut)
        # the share of the level that holds ``rest`` words but for a chance of 1e-9, so that tasks sort no more than that
        share = min(1.0, (rest + 6 * rest**0.5 + 20) / tied)
        first = level.where(place <= int(share * (1 << 40))).orderBy(place, "word").limit(rest).collect()
        if len(first) < rest:
            first = level.orderBy(place, "word").limit(rest).collect()
        chosen += [(r["word"], r["count"]) for r in first]
    return chosen


def _encode(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Each row with its symbols (u16 binary) and the words outside the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        other, end = len(known), len(known) + 1
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, raw, offsets in words.text_blocks(batch.column("text")):
                h, first = words.word_hashes(raw, offsets)
                at = np.minimum(np.searchsorted(known, h), max(0, other - 1))
                inside = known[at] == h if other else np.zeros(len(h), dtype=bool)
                symbols = np.where(inside, at, other).astype("<u2")
                outside = h[~inside]
                cuts = np.concatenate(([0], np.cumsum(~inside)))[first].astype(np.int32)
                tail = np.array([end], dtype="<u2").tobytes()
                ids = [symbols[x:y].tobytes() + tail for x, y in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + b - a), pa.int64()),
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("held_out").slice(a, b - a),
                        pa.array(ids, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(outside.view(np.int64))),
                    ],
                    ["row", "doc_id", "held_out", "symbols", "outside"],
                )
                row += b - a

    return _texts(docs).mapInArrow(tidied(run), "row long, doc_id long, held_out boolean, symbols binary, outside array<long>")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in column.to_pylist()]


def baum_welch_round(encoded: DataFrame, model: Model) -> tuple[Model, float]:
    """One round over all training documents: expected counts of every partition, summed by symbol.

    Also gives the ln likelihood of the training symbols under the model that came in.
    """
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(model)
    k = len(model.start)
    kinds = "symbol int, " + ", ".join(f"c{j} double" for j in range(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                got = expected_counts(sent.value, _sequences(batch.slice(at, 2000).column("symbols")))
                sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
        if sums is not None:
            start, move, emit, likelihood = sums
            used = np.flatnonzero(emit.sum(axis=1))
            symbol = np.concatenate((used, np.arange(-k, 0), [-k - 1, -k - 2])).astype(np.int32)
            table = np.concatenate((emit[used], move, start[None, :], np.eye(1, k) * likelihood))
            yield pa.RecordBatch.from_arrays([pa.array(symbol), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(k))], ["symbol", *(f"c{j}" for j in range(k))])

    summed = encoded.where("not held_out").select("symbols").mapInArrow(tidied(run), kinds).groupBy("symbol").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).toPandas()
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    symbol, table = summed["symbol"].to_numpy(), summed.drop(columns="symbol").to_numpy()
    emit[symbol[symbol >= 0]] = table[symbol >= 0]
    move[symbol[(symbol < 0) & (symbol >= -k)] + k] = table[(symbol < 0) & (symbol >= -k)]
    if (symbol == -k - 1).any():
        start = table[symbol == -k - 1][0]
    sent.destroy()
    return Model.from_counts(start, move, emit), float(table[symbol == -k - 2].sum())


def score_language(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, vocabulary_size: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    counts, counts_path = materialise(count_words(docs), "words")
    n_all, n_words, n_end = counts.agg(F.sum("count"), F.count("word"), F.sum(F.when(F.col("word").isNull(), F.col("count")))).first()
    n_all, n_end = n_all or 0, n_end or 0
    distinct = n_words + (n_end > 0)
    chosen = choose_vocabulary(counts, vocabulary_size)
    pairs = np.array(sorted((w & (1 << 64) - 1, c) for w, c in chosen), dtype=np.uint64).reshape(-1, 2)
    vocabulary, freq = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)
    tail_tokens = n_all - n_end - int(freq.sum())
    tail_words = n_words - len(freq)

    encoded, encoded_path = materialise(_encode(docs, vocabulary), "encoded")
    unigram = np.concatenate((freq, [tail_tokens + 1, n_end + 1])).astype(float)
    unigram /= unigram.sum()
    ready = encoded.where("not held_out").select("symbols")
    # different texts, those of least hash among a share of about START_DOCS: the same ones in every run, however many copies a text has
    drawn = ready.where(F.pmod(F.xxhash64("symbols"), F.lit(1 << 20)) < max(1, int((1 << 20) * START_DOCS / max(1, n_end, START_DOCS))))
    start = drawn.distinct().orderBy(F.xxhash64("symbols"), "symbols").limit(2 * START_DOCS).collect() if n_end else []
    seqs = sorted((np.frombuffer(r[0], dtype="<u2").astype(np.int64) for r in start), key=lambda d: d.tobytes())
    model = starting_model(seqs, unigram, states)
    for k in range(rounds if n_end else 0):
        model, likelihood = baum_welch_round(encoded, model)
        _log.info("before round %d: log10 likelihood of the training symbols %.6g", k + 1, likelihood / np.log(10))

    sent = spark.sparkContext.broadcast((model, np.concatenate((np.log10(freq + 1.0), [0.0, np.log10(n_end + 1.0)])), len(freq)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, other = sent.value
        for batch in batches:
            seqs = _sequences(batch.column("symbols"))
            score = np.zeros(len(seqs))
            for some in padded(seqs):
                score[some] = forward(model, [seqs[i] for i in some]) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([len(s) for s in seqs], pa.int64()),
                    pa.array([int((s < other).sum()) for s in seqs], pa.int64()),
                    pa.array([float(logs[s].sum()) for s in seqs], pa.float64()),
                    pa.array(score, pa.float64()),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_inside", "base", "symbol_score"],
            )

    inside = encoded.select("row", "doc_id", "held_out", "symbols").mapInArrow(tidied(run), "row long, doc_id long, held_out boolean, n_tokens long, n_inside long, base double, symbol_score double")
    # words outside the vocabulary: each met with its count, then summed by row
    outside = encoded.select("row", F.explode("outside").alias("word"))
    met = outside.join(counts.where("word is not null"), "word", "left").select("row", F.coalesce("count", F.lit(0)).alias("c"))
    summed = met.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("known"), F.count(F.lit(1)).alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    scale, tail_scale = float(np.log10(n_all + distinct + 1)), float(np.log10(tail_tokens + tail_words + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out, _ = materialise(
        inside.join(summed, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_inside") + zero("known") + F.lit(int(n_end > 0))).cast("long").alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("base") + zero("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
            (F.col("symbol_score") + zero("logs") - zero("n") * F.lit(tail_scale)).alias("score"),
        ),
        "language",
    )
    release(spark, counts_path, encoded_path)
    return out
