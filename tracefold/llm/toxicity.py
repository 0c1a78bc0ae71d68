"""Toxicity scores by a weighted finite-state pattern grammar.

A text becomes a string of symbols: insult, threat, person spoken to or of,
negation, reporting verb, quotation mark, other word, end of clause. A
transducer that reads from the right marks insults and threats that a target
follows; four composed ones then read from the left: a target near an insult
makes it directed, a threat needs a target, a negation just before makes either
denied, a reporting frame makes it reported. The last one takes what it finds
together into clauses, each of its gravest kind, and puts out each clause's
weight where the clause ends. A document's score is the logistic of the weight
that this transducer gives to its whole string.

Learned from labelled documents outside the held-out fold (crc32(doc_id) % 4 <> 2):
word stems whose documents are labelled toxic far more often than others become
insults, and the kinds' weights come from a small logistic regression. Both use
at most ``TRAIN_ROWS`` rows, drawn by hash. Equal texts count once, and a word
counts once for all texts where it stands between the same two words, so groups
of near copies make no stems. Threats, targets, negations and reporting verbs
are written out below.

Labels, lang, source and doc_id are no inputs of a score. Scoring is one pass
over the texts, without a shuffle; what is sent to tasks are the stems learned
from the bounded training rows.

Defined results: null and empty texts get the score of a text without matches;
whole texts are read; repeated rows and ids get a row each; a null doc_id isn't
held out; without usable labels only the written words and weights count; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import materialise, release, tidied
from tracefold.llm.transducers import Transducer, compose

TRAIN_ROWS = 20_000
HELD_OUT = (4, 2)
CUT = 0.3
MAX_STEM = 14

# Fixed word lists, English, French, German and Spanish.
TARGETS = "you your yours u ur he she they him her them his their it those these people tu te toi vous votre il elle ils elles lui leur du dich dir ihr euch er sie ihn ihm usted ustedes ti tus ellos ellas".split()
NEGATIONS = "not no never n't don't doesn't isn't aren't wasn't cannot can't without pas jamais sans aucun nicht kein keine nie ohne nunca sin ningún ninguna".split()
REPORTING = "said says say told tells wrote writes called calls quoted quote reported according dit disait écrit selon sagte schrieb laut dijo dice escribió según".split()
THREATS = "kill hurt destroy murder shoot stab burn beat hang strangle attack tuer frapper détruire töten schlagen umbringen matar golpear destruir".split()

ALPHABET = ["insult", "insult>", "threat", "threat>", "target", "negation", "report", "quote", "word", "end"]
#: Kinds of clauses, gravest first.
KINDS = ["threat", "directed", "insult", "reported", "denied"]
#: Weights where nothing could be learned; the bias comes first.
PRIOR = {"bias": -3.0, "insult": 3.0, "directed": 3.5, "denied": 1.0, "reported": 1.0, "threat": 2.0}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")
_WORD = re.compile(r"[^\W\d_]+")
_REACH = 4  # words within which a target or a negation bears on an insult
_CLAUSE = 8  # words after its last cue that end a clause without punctuation


def following() -> Transducer:
    """Read from the right: insults and threats with a target within reach after them, in their clause, get a ">"."""
    out = Transducer()
    for s in range(_REACH + 1):  # 0 none near, else words since a target
        far = s + 1 if 0 < s < _REACH else 0
        for x in ("insult", "threat"):
            out.arcs[s, x] = (far, f"{x}>" if s else x, 0.0)
        for x in ("word", "negation", "report", "quote"):
            out.arcs[s, x] = (far, x, 0.0)
        out.arcs[s, "target"] = (1, "target", 0.0)
        out.arcs[s, "end"] = (0, "end", 0.0)
    return out


def grammar(weights: dict[str, float]) -> Transducer:
    """Composition of the target, negation, reporting and clause transducers."""
    target, negation, report, clause = Transducer(), Transducer(), Transducer(), Transducer()
    for s in range(_REACH + 1):  # 0 none near, else words since a target, or a negation
        far = s + 1 if 0 < s < _REACH else 0
        target.arcs |= {(s, "target"): (1, "word", 0.0), (s, "insult>"): (far, "directed", 0.0), (s, "threat>"): (far, "threat", 0.0), (s, "end"): (0, "end", 0.0)}
        target.arcs |= {(s, "insult"): (far, "directed" if s else "insult", 0.0), (s, "threat"): (far, "threat" if s else "word", 0.0)}
        target.arcs |= {(s, x): (far, x, 0.0) for x in ("word", "negation", "report", "quote")}
        negation.arcs |= {(s, "negation"): (1, "word", 0.0), (s, "end"): (0, "end", 0.0)}
        negation.arcs |= {(s, x): (far, "denied" if s else x, 0.0) for x in ("insult", "directed", "threat")}
        negation.arcs |= {(s, x): (far, x, 0.0) for x in ("word", "report", "quote")}
    # reporting: 0 own speech, 1 after a reporting verb, 2 inside its quotation
    report.arcs |= {(0, "report"): (1, "word", 0.0), (0, "quote"): (0, "word", 0.0), (1, "quote"): (2, "word", 0.0), (2, "quote"): (0, "word", 0.0), (1, "end"): (0, "end", 0.0)}
    for s in (1, 2):
        report.arcs |= {(s, x): (s, "reported", 0.0) for x in ("insult", "directed", "denied", "threat")} | {(s, "report"): (s, "word", 0.0)}
    # clause: state 0 nothing found, else kind and words since its last cue
    state = lambda kind, far: 1 + kind * _CLAUSE + far
    for k, x in enumerate(KINDS):
        clause.arcs[0, x] = (state(k, 0), "word", 0.0)
        for far in range(_CLAUSE):
            here = state(k, far)
            clause.arcs[here, "word"] = (state(k, far + 1), "word", 0.0) if far + 1 < _CLAUSE else (0, x, weights[x])
            clause.arcs[here, "end"] = (0, x, weights[x])
            clause.arcs |= {(here, y): (state(min(j, k), 0), "word", 0.0) for j, y in enumerate(KINDS)}
    out = compose(target, negation, ALPHABET)
    out = compose(out, report, ALPHABET)
    return compose(out, clause, ALPHABET)


class Scorer:
    """Finds cue words with an Aho-Corasick automaton and runs the grammar over their clauses."""

    def __init__(self, stems: list[str], weights: dict[str, float]):
        import ahocorasick

        self.bias = weights["bias"]
        self.following, self.grammar = following(), grammar(weights)
        self.find = ahocorasick.Automaton()
        for stem in stems:  # "$" ends a stem that must be the whole word
            self.find.add_word(stem.rstrip("$"), (len(stem.rstrip("$")), "insult", stem.endswith("$")))
        for w in THREATS:
            self.find.add_word(w, (len(w), "threat", True))
        self.find.make_automaton()
        self.classes = dict.fromkeys(TARGETS, "target") | dict.fromkeys(NEGATIONS, "negation") | dict.fromkeys(REPORTING, "report")

    def _cues(self, low: str) -> dict[int, str]:
        found: dict[int, str] = {}
        for end, (n, kind, whole) in self.find.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalnum():
                continue
            if whole and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            if found.get(start) != "insult":
                found[start] = kind
        return found

    def read(self, text: str | None) -> tuple[float, Counter]:
        """The weight that the grammar gives to the text, and how many clauses of each kind it matches."""
        low = (text or "").lower()
        cues = self._cues(low)
        found: Counter = Counter()
        total, done = 0.0, 0
        for at in sorted(cues):
            if at < done:
                continue
            # the stretch of clauses with this cue: from the line's start, so that a reporting frame is seen
            begin = max(low.rfind("\n", 0, at) + 1, done)
            stop = low.find("\n", at)
            stop = len(low) if stop < 0 else stop
            symbols = ["end"]
            for m in _TOKEN.finditer(low, begin, stop):
                t = m[0]
                symbols.append(cues.get(m.start()) or ("end" if t in _ENDS else "quote" if t in _QUOTES else self.classes.get(t, "negation" if t.endswith("n't") else "word")))
            symbols.append("end")
            _, marked = self.following.run(reversed(symbols))
            weight, names = self.grammar.run(reversed(marked))
            total += weight
            found.update(x for x in names if x in PRIOR)
            done = stop
        return total, found

    def score(self, weight: float) -> float:
        return round(logistic(self.bias + weight), 9)


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


@lru_cache(maxsize=2)
def _scorer(stems: tuple[str, ...], weights: tuple[tuple[str, float], ...]) -> Scorer:
    return Scorer(list(stems), dict(weights))


def fold(column: str, of: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold, about ``bound`` at most, drawn by hash."""
    usable = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if n > bound:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.98 * bound / n))
    return _documents(docs).join(F.broadcast(usable), "doc_id").select("text", "toxic")  # bounded by ``bound`` rows


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of each text once, with one of the pairs of words that it stands between there."""
    for batch in batches:
        cols: tuple[list, list, list] = ([], [], [])
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            ws = _WORD.findall((text or "").lower())
            least: dict[str, int] = {}
            for before, w, after in zip(["", *ws], ws, [*ws[1:], ""]):
                between = zlib.crc32(f"{before} {after}".encode())
                if between < least.get(w, 1 << 32):
                    least[w] = between
            cols[0].extend(least)
            cols[1].extend(least.values())
            cols[2].extend([int(bool(toxic))] * len(least))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["word", "between", "toxic"])


def learn_stems(train: DataFrame, n_toxic: int, n_other: int) -> list[str]:
    """Word beginnings that mark toxic documents more than chance explains; the bounded training rows bound their number."""
    if not n_toxic or not n_other:
        return []
    rate = n_toxic / (n_toxic + n_other)
    once = train.mapInArrow(tidied(_vocabulary), "word string, between long, toxic int").distinct()
    vocabulary = once.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("other"))
    longest = F.least(F.length("word"), F.lit(MAX_STEM))
    stems = vocabulary.where(F.length("word") >= 3).select(
        "toxic", "other", F.explode(F.concat(F.transform(F.sequence(F.lit(3), longest), lambda k: F.substring("word", F.lit(1), k)), F.array(F.concat("word", F.lit("$"))))).alias("stem")
    )
    counted = stems.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where("t >= 4")
    tried = counted.count()
    share = (F.col("t") + 0.05) / (F.col("t") + F.col("o") + 0.1)
    gain = F.col("t") * F.log(share / rate) + F.col("o") * F.log((1 - share) / (1 - rate))
    # beyond what the best of so many stems would reach by chance
    marked = counted.where(share >= 0.85).withColumn("gain", gain).where(F.col("gain") > math.log(max(2, tried)) + 2.0)
    best = {r["stem"]: r["t"] for r in marked.select("stem", "t").collect()}
    # a beginning is as good as a longer one only if that one explains fewer documents
    longer: dict[str, int] = {}
    for stem, t in best.items():
        longer[stem[:-1]] = max(t, longer.get(stem[:-1], 0))
    out = {stem for stem, t in best.items() if stem.endswith("$") or stem not in longer or longer[stem] < 0.9 * t}
    # what a chosen beginning covers needs no stem of its own
    return sorted(s for s in out if not any(s[:k] in out for k in range(1, len(s))))


def learn_weights(rows: list[tuple[list[int], int]]) -> dict[str, float]:
    """Logistic regression (Newton steps, ridge towards PRIOR) on event counts of training documents."""
    if not rows or len({y for _, y in rows}) < 2:
        return dict(PRIOR)
    x = np.column_stack([np.ones(len(rows)), np.array([e for e, _ in rows], dtype=float)])
    y = np.array([r for _, r in rows], dtype=float)
    prior = np.array([PRIOR["bias"], *(PRIOR[k] for k in KINDS)])
    w, ridge = prior.copy(), np.array([0.01, 4.0, 1, 1, 1, 1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (w - prior))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return dict(zip(["bias", *KINDS], w.round(6).tolist()))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[tuple[str, ...], tuple[tuple[str, float], ...]]:
    """(stems, weights) for :func:`score_toxicity`."""
    rows, path = materialise(training_rows(docs, labels, bound).dropDuplicates(["text", "toxic"]), "toxicity")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    stems = tuple(learn_stems(rows, counts.get(1, 0), counts.get(0, 0)))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(stems, tuple(PRIOR.items()))
        for batch in batches:
            found = [scorer.read(t)[1] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], *(pa.array([e[k] for e in found], pa.int64()) for k in KINDS)], ["toxic", *KINDS])

    table = rows.mapInArrow(tidied(events), "toxic int, " + ", ".join(f"{k} long" for k in KINDS)).groupBy("toxic", *KINDS).count().collect()
    weights = learn_weights([([r[k] for k in KINDS], r["toxic"]) for r in table for _ in range(r["count"])])
    release(docs.sparkSession, path)
    return stems, tuple(weights.items())


def score_toxicity(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, score, predicted, and the clause counts by kind."""
    stems, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(stems, weights)
        for batch in batches:
            read = [scorer.read(t) for t in batch["text"].to_pylist()]
            scores, found = [scorer.score(weight) for weight, _ in read], [e for _, e in read]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32()), *(pa.array([e[k] for e in found], pa.int64()) for k in KINDS)],
                ["doc_id", "score", "predicted", *KINDS],
            )

    out = _documents(docs).mapInArrow(tidied(run), "doc_id long, score double, predicted int, " + ", ".join(f"{k} long" for k in KINDS))
    held = F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", *[F.col(k).alias(f"n_{k}") for k in KINDS])
