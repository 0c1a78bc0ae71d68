r"""Language identification by inference of each document's mixture of languages.

A token is a place of the text that holds a letter byte (A-Z, a-z, or any byte of a
non-ASCII character), told by the three bytes around it: signs and digits count as
a space, and letters are lower-cased where one byte tells them (ASCII and Latin-1).
Tokens are hashed to ``BUCKETS``; each language is a multinomial over the buckets,
smoothed towards all languages' together.

For a document, expectation-maximisation estimates its proportions of the
languages: each token is shared among them by proportion times likelihood, and the
shares' means are the next proportions. Languages are then taken in falling order
of their proportion, each set is fitted by itself, and the set with the largest
penalised likelihood stands: log likelihood / 3 (a letter is in three tokens) less
(ln(tokens) / 2 + ``PENALTY``) for each language after the first. Adding languages
stops when the penalised likelihood falls. The prediction is the set's largest
proportion. The score is that proportion, or for a set of one language its
posterior chance among the languages taken alone.

Counts are summed by (language, bucket) in each task first, so a frequent language
or token is no hot key, and at most BUCKETS rows a language leave a task. The model
is BUCKETS numbers for each of at most ``LANGUAGES`` values of lang: more values
raise, since such a column holds no languages.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and
for all texts when nothing could be learned; ties go to the language that sorts
first; whole texts are used; null languages aren't learned from; repeated rows and
ids count each; a null doc_id isn't held out; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm import words
from tracefold.llm.common import tidied

BUCKETS = 1 << 16
LANGUAGES = 128
SHRINK = 2000.0
PENALTY = 6.0
OVERLAP = 3
ROUNDS = 20
HELD_OUT = (5, 0)
UNKNOWN = "und"

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, row of each token)."""
    code = _FOLD[raw]
    after = np.concatenate(([False], raw[:-1] == 0xC3)) if len(raw) else np.zeros(0, dtype=bool)
    code[after & (raw >= 0x80) & (raw <= 0x9E)] += 32  # capitals of Latin-1
    before, behind = np.full(len(raw), 32, dtype=np.uint32), np.full(len(raw), 32, dtype=np.uint32)
    before[1:], behind[:-1] = code[:-1], code[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner], behind[inner - 1] = 32, 32  # texts don't touch
    at = np.flatnonzero(code != 32)
    h = (before[at] << np.uint32(16)) | (code[at] << np.uint32(8)) | behind[at]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return h.astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition's texts."""
    sums: dict[str, np.ndarray] = {}

    def put():
        for lang, c in sums.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(c[used])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, raw, offsets in words.text_blocks(batch.column("text")):
            names = sorted(set(langs[a:b]))
            number = {x: k for k, x in enumerate(names)}
            h, row = tokens(raw, offsets)
            own = np.array([number[x] for x in langs[a:b]], dtype=np.int64)[row]
            key, n = np.unique(own * BUCKETS + h, return_counts=True)
            for lang, k in number.items():
                lo, hi = np.searchsorted(key, (k * BUCKETS, (k + 1) * BUCKETS))
                sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))[key[lo:hi] - k * BUCKETS] += n[lo:hi]
            if len(sums) > LANGUAGES:
                yield from put()
    yield from put()


class Model:
    """Languages in order, and ln P(bucket | language) as float32 (BUCKETS, languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts.astype(np.float64)
        pooled = c.sum(axis=1) + 0.5
        pooled /= pooled.sum()
        self.logs = np.log((c + SHRINK * pooled[:, None]) / (c.sum(axis=0) + SHRINK)).astype(np.float32)


def train(docs: DataFrame) -> Model:
    """Bucket counts of every language over all documents that aren't held out."""
    ready = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    ready = ready.where("not held_out and lang is not null and text is not null").select("lang", "text")
    summed = ready.mapInArrow(tidied(_counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = [r[0] for r in ready.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    found = summed.toArrow()  # at most LANGUAGES * BUCKETS rows
    known = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(known)), dtype=np.int64)
    if known:
        column = np.searchsorted(np.array(known, dtype=object), np.array(found.column("lang").to_pylist(), dtype=object))
        counts[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    return Model(known, counts)


def fit(p: np.ndarray, n: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and ln likelihoods of documents by expectation-maximisation.

    p: likelihood of each distinct token by language, n: its count, first: each document's first token
    (all have one), allowed: (documents, languages).
    """
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
    total = np.add.reduceat(n, first)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mixed = np.einsum("ul,ul->u", p, share[doc])
        share = share * np.add.reduceat(p * (n / mixed)[:, None], first, axis=0) / total[:, None]
    mixed = np.einsum("ul,ul->u", p, share[doc])
    return share, np.add.reduceat(n * np.log(mixed), first)


def infer(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by language, score of the largest) of each row; zeros without a token."""
    rows, languages = len(offsets) - 1, len(model.languages)
    shares, scores = np.zeros((rows, languages)), np.zeros(rows)
    h, row = tokens(raw, offsets)
    if not len(h) or not languages:
        return shares, scores
    key, n = np.unique(row * BUCKETS + h, return_counts=True)
    of, logs = key // BUCKETS, model.logs[key % BUCKETS].astype(np.float64)
    present, first = np.unique(of, return_index=True)
    n = n.astype(np.float64)
    total = np.add.reduceat(n, first)
    alone = np.add.reduceat(logs * n[:, None], first, axis=0)
    # likelihoods are scaled by each token's largest, which changes no share
    top = logs.max(axis=1)
    p, extra = np.exp(logs - top[:, None]), np.add.reduceat(top * n, first)
    whole, _ = fit(p, n, first, np.ones((len(present), languages)))
    order = np.argsort(-whole, axis=1, kind="stable")
    # sets of one language: the best by itself
    best = alone.argmax(axis=1)
    chosen = np.zeros((len(present), languages))
    chosen[np.arange(len(present)), best] = 1
    value = alone.max(axis=1) / OVERLAP
    chance = np.exp(alone / OVERLAP - value[:, None])
    score = 1 / chance.sum(axis=1)
    live = np.arange(len(present))
    for k in range(2, languages + 1):
        allowed = np.zeros((len(live), languages))
        np.put_along_axis(allowed, order[live, :k], 1.0, axis=1)
        mark = np.zeros(len(present), dtype=bool)
        mark[live] = True
        picked = np.repeat(mark, np.diff(np.append(first, len(n))))
        starts = np.cumsum(np.concatenate(([0], np.diff(np.append(first, len(n)))[live])))[:-1]
        share, likelihood = fit(p[picked], n[picked], starts, allowed)
        new = (likelihood + extra[live]) / OVERLAP - (k - 1) * (np.log(total[live]) / 2 + PENALTY)
        better = new > value[live]
        chosen[live[better]], value[live[better]] = share[better], new[better]
        score[live[better]] = share[better].max(axis=1)
        live = live[better]
        if not len(live):
            break
    shares[present], scores[present] = chosen, score
    return shares, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the set with its proportions, largest first)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), dtype=bool)
            for a, b, raw, offsets in words.text_blocks(batch.column("text")):
                shares, scores = infer(model, raw, offsets)
                said = letters[a:b] & (shares.sum(axis=1) > 0) if len(model.languages) else np.zeros(b - a, dtype=bool)
                pred, mixes = [], []
                for ok, share in zip(said, shares):
                    used = sorted((k for k in np.flatnonzero(share > 0.005)), key=lambda k: (-share[k], k)) if ok else []
                    pred.append(model.languages[used[0]] if ok else UNKNOWN)
                    mixes.append(",".join(f"{model.languages[k]}:{share[k]:.2f}" for k in used))
                arrays = [batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(np.where(said, np.clip(scores, 0, 1), 0.0)), pa.array(mixes, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held_out().alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double, languages string")
