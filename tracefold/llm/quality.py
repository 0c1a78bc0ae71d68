"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares two multinomials over hashed one- and two-grams of words (as
they are written; case and signs count): one of the trusted target, at most
``TARGET_ROWS`` documents labelled as good, and one of the raw corpus, all documents. A bucket weighs
ln((target + K) / (expected + K)), where expected is what the raw corpus would
give for as many n-grams, so rare n-grams weigh about nothing. A document's ratio
is the mean weight of its n-grams, which makes it independent of length, and it
is rejected under a fixed threshold. The base rule rejects by itself.

Two passes over the texts. The first counts all n-grams of all documents by
bucket, with map-side aggregation, so only ``BUCKETS`` rows a task are shuffled
and a hot n-gram or a very long text needs no special care. The second is a
projection: the weights, exactly ``BUCKETS`` numbers, are an array literal in it. Its
result, a few numbers a document, is written to the shared folder.

Defined results: null text has no words (all counts 0, base_failed); without any
labelled document every ratio is 0; a document without n-grams has ratio 0;
repeated rows and ids give a row each, and count in the corpus each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import materialise

BUCKETS = 1 << 16
SHRINK = 5.0
THRESHOLD = -0.11
#: Labelled documents that make up the trusted target, at most (about; drawn by hash when there are more).
TARGET_ROWS = 100_000
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def describe(docs: DataFrame) -> DataFrame:
    """The base counts of each row, by itself, and the hashes of its words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
    )
    second = first.select(
        "doc_id",
        "n_symbols",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n = F.col("n_words").cast("int")
    trios = F.arrays_zip(*[F.slice("hashes", F.lit(k), n - 2).alias(f"h{k}") for k in (1, 2, 3)])
    second = second.withColumn("windows", F.when(n >= 3, F.transform(trios, lambda t: F.xxhash64(t))))
    ordered = F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    third = second.select("doc_id", "n_symbols", "word_chars", "hashes", "n_words", "n_dup_lines", ordered.alias("ordered"))
    near = lambda x, k: ((k > 0) & (F.get("ordered", k - 1)["h"] == x["h"])) | ((k + 1 < F.size("ordered")) & (F.get("ordered", k + 1)["h"] == x["h"]))
    again = F.when(F.col("ordered").isNotNull(), F.sort_array(F.filter(F.transform("ordered", lambda x, k: F.when(near(x, k), x["i"])), lambda x: x.isNotNull())))
    covered = F.aggregate(
        again,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return third.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "hashes")


def bucket_counts(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(g, raw, target): n-grams of all documents and of those labelled as good, by bucket."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("good_id")).where("good_id is not null").distinct()
    n = good.count()
    if n > target_rows:
        good = good.where(F.pmod(F.xxhash64("good_id"), F.lit(1 << 30)) < int((1 << 30) * 0.98 * target_rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most about target_rows ids are broadcast; the texts aren't shuffled
    marked = texts.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select(F.col("good_id").isNotNull().alias("good"), F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    pairs = marked.select("good", F.inline(F.arrays_zip(F.col("hashes").alias("a"), F.slice("hashes", F.lit(2), F.size("hashes")).alias("b"))))
    second = F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b")))
    grams = pairs.select("good", F.explode(F.array(_bucket(F.col("a")), second)).alias("g")).where("g is not null")
    return grams.groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))


def weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The weight of every bucket."""
    out = [0.0] * BUCKETS
    rows = bucket_counts(docs, labels).collect()  # at most BUCKETS
    raw, target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    if target:
        for r in rows:
            out[r["g"]] = math.log((r["target"] + SHRINK) / (r["raw"] * target / raw + SHRINK))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio."""
    # one string is folded to one array literal, which tasks index
    w = F.split(F.lit(",".join(f"{x:.6g}" for x in weights(docs, labels))), ",").cast("array<double>")
    n = F.size("hashes")
    summed = F.aggregate(
        F.transform("hashes", lambda h, i: F.get(w, _bucket(h)) + F.when(i + 1 < n, F.get(w, _bucket(F.xxhash64(h, F.get("hashes", i + 1))))).otherwise(F.lit(0.0))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    ratio = F.when(n > 0, summed / (2 * n - 1)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = describe(docs).withColumns({"base_failed": failed, "ratio": ratio})
    out = scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"), "ratio")
    # a table of its own: a later filter, moved into the projection by the optimizer, would compute the arrays once for each word
    return materialise(out, "quality")[0]
