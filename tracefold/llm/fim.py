r"""Fill-in-middle transformation by an index of distinct texts.

A text is cut into lines (a line ends after its \n), and two seeded cuts between
lines part it into prefix, middle and suffix, which are put out in the order that
the form names:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text itself, where it is empty or holds a mark

Documents with one text share an entry of the index: texts are grouped by their
SHA-256 and length, one text a group (and a map task) is shuffled, once, and the
line ends of each distinct text are kept as an Elias-Fano list, found once. Documents
join their list by the digest, without any text; a cut reads one entry of the list,
and then meets the text where it lies. Content is verified at the end: the text that is rebuilt from every
document's output must have the digest of that document's own text, or the job
fails.

Groups with more than ``HOT_ROWS`` documents (or a 10,000th of all, so that there
are at most 10,000 such groups, whose digests are broadcast) are joined by digest
and a drawn part number, with a copy of the entry for each part.

Elias-Fano: of n + 1 rising offsets up to m, each one's low ``bits`` =
log2(m / (n + 1)) are packed into words, as many whole values as fit a word, and
the rest, o >> bits, is a unary list: entry i sets bit (o >> bits) + i. ``ranks``
counts the bits set before each word. That is about 2 + bits bits an offset.

Defined results: null texts are empty; an empty text has no line and is plain; a
null doc_id draws as the empty string; repeated rows and ids give a row each;
whole texts are used, of any length; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

P, S, M = "<P>", "<S>", "<M>"
SEED = 7
HOT_ROWS = 1000
_LIST = T.StructType([T.StructField("bits", T.IntegerType()), T.StructField("low", T.ArrayType(T.LongType())), T.StructField("high", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.IntegerType()))])


def elias_fano(offsets: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, low words, high words, set bits before each high word) of rising offsets."""
    n, top = len(offsets), int(offsets[-1])
    bits = max(0, (top // n).bit_length() - 1)
    per = 64 // bits if bits else 1
    low = np.zeros(-(-n // per) if bits else 0, dtype=np.uint64)
    places = np.arange(n)
    if bits:
        kept = offsets.astype(np.uint64) & np.uint64((1 << bits) - 1)
        np.bitwise_or.at(low, places // per, kept << (places % per * bits).astype(np.uint64))
    unary = (offsets >> bits) + places
    high = np.zeros(int(unary[-1]) // 64 + 1, dtype=np.uint64)
    np.bitwise_or.at(high, unary // 64, np.uint64(1) << (unary % 64).astype(np.uint64))
    ranks = np.searchsorted(unary, np.arange(len(high)) * 64).astype(np.int32)
    return bits, low.view(np.int64), high.view(np.int64), ranks


@F.pandas_udf(_LIST)
def _boundaries(sizes: pd.Series, chars: pd.Series) -> pd.DataFrame:
    """Lists of line boundaries (0 first) from the sizes of a text's \\n-split parts."""
    out = []
    for parts, total in zip(sizes, chars):
        ends = np.minimum(np.cumsum(np.asarray(parts, dtype=np.int64) + 1), total)
        if len(ends) > 1 and ends[-1] == ends[-2]:
            ends = ends[:-1]  # nothing follows the last \n
        out.append(elias_fano(np.concatenate(([0], ends)) if total else np.zeros(1, dtype=np.int64)))
    return pd.DataFrame(out, columns=["bits", "low", "high", "ranks"])


def entry(list_: Column, k: Column) -> Column:
    """Offset k of an Elias-Fano list."""
    word = F.size(F.filter(list_["ranks"], lambda r: r <= k)) - 1
    left = F.struct(F.get(list_["high"], word).alias("word"), (k - F.get(list_["ranks"], word)).alias("rest"), word.alias("at"))
    # the place of the set bit that has ``rest`` set bits before it
    upto = [F.lit((2 << b) - 1 if b < 63 else -1).cast("long") for b in range(64)]
    place = lambda x: F.size(F.filter(F.array(*upto), lambda m: F.bit_count(x["word"].bitwiseAND(m)) <= x["rest"]))
    high = F.element_at(F.transform(F.array(left), lambda x: x["at"].cast("long") * 64 + place(x) - k), 1)
    bits = list_["bits"]
    per = F.when(bits > 0, F.floor(F.lit(64) / bits)).otherwise(F.lit(1)).cast("int")
    packed = F.get(list_["low"], F.floor(k / per).cast("int"))
    low = F.call_function("shiftrightunsigned", packed, (k % per) * bits).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return F.call_function("shiftleft", high, bits) + F.when(bits > 0, low).otherwise(F.lit(0))


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """digest, chars, text of each distinct text."""
    return _digested(docs).groupBy("digest", "chars").agg(F.first("text").alias("text"))


def distinct_index(texts: DataFrame) -> DataFrame:
    """digest, chars, n (lines), marked (holds a mark), ends (Elias-Fano list of 0 and the lines' ends) of distinct texts."""
    parts = F.split("text", "\n")
    n = F.size(parts) - (F.col("text").endswith("\n") | (F.col("text") == "")).cast("int")
    marked = F.col("text").contains(P) | F.col("text").contains(S) | F.col("text").contains(M)
    sized = texts.select("digest", "chars", n.alias("n"), marked.alias("marked"), F.transform(parts, lambda x: F.length(x)).alias("sizes"))
    return sized.select("digest", "chars", "n", "marked", _boundaries("sizes", "chars").alias("ends"))


def _drawn(seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def _chosen(met: DataFrame, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """The form and cuts of documents with their index entry."""
    h = met.withColumn("h", _drawn(seed))
    cuts = [F.pmod(F.get("h", F.lit(k)), F.col("n") + 1).cast("int") for k in (0, 1)]
    plain = (F.col("chars") == 0) | F.col("marked") | (F.pmod(F.get("h", F.lit(2)), F.lit(100)) >= fim_percent)
    form = F.when(plain, "plain").when(F.pmod(F.get("h", F.lit(3)), F.lit(100)) < spm_percent, "spm").otherwise("psm")
    keys = [c for c in ("digest", "chars", "part") if c in met.columns]
    drawn = h.select("doc_id", *keys, "n", "ends", form.alias("form"), F.least(*cuts).alias("i"), F.greatest(*cuts).alias("j"))
    return drawn.select("doc_id", *keys, "n", "form", *[F.when(F.col("form") != "plain", entry(F.col("ends"), F.col(c))).cast("long").alias(a) for c, a in (("i", "at"), ("j", "to"))])


def _cut(chosen: DataFrame) -> DataFrame:
    """Documents with their form, cuts and text to their outputs."""
    a, b = F.col("at").cast("int"), F.col("to").cast("int")
    parts = chosen.select(
        "doc_id", "digest", "text", "n", "form", F.col("at").alias("prefix_chars"), (F.col("to") - F.col("at")).alias("middle_chars"),
        F.substring("text", F.lit(1), a).alias("p"), F.substring("text", a + 1, b - a).alias("m"), F.substring("text", b + 1, F.col("chars")).alias("s"),
    )
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(P), "p", F.lit(S), "s", F.lit(M), "m")).otherwise(F.concat(F.lit(S), "s", F.lit(P), "p", F.lit(M), "m"))
    return parts.select("doc_id", F.col("n").cast("long").alias("n"), "form", "prefix_chars", "middle_chars", output.alias("output"), "digest")


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone. A text with a mark is plain, so each mark is the first of its kind."""
    second = F.when(form == "psm", S).otherwise(P)
    body = F.substring(output, F.lit(4), F.length(output))
    cut, end = F.call_function("instr", body, second), F.call_function("instr", body, F.lit(M))
    head, tail = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + 3, end - cut - 3)
    middle = F.substring(body, end + 3, F.length(body))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = 100, spm_percent: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (text), digest (SHA-256 of the document's own text)."""
    rows = docs.count()
    own = _digested(docs).select("doc_id", "digest", "chars")
    limit = max(hot_rows, -(-rows // 10_000))
    hot = own.groupBy("digest", "chars").count().where(F.col("count") > limit).collect()  # at most 10,000
    texts = distinct_texts(docs)
    index = distinct_index(texts)

    def cut(rows: DataFrame, index: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
        return _cut(_chosen(rows.join(index, on), seed, fim_percent, spm_percent).join(texts, on))

    if not hot:
        return cut(own, index, texts, ["digest", "chars"])
    spark = docs.sparkSession
    parts = F.broadcast(spark.createDataFrame([(bytes(r["digest"]), -(-r["count"] // limit)) for r in hot], "digest binary, parts int"))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int")
    many = own.join(parts, "digest").withColumn("part", drawn).drop("parts")
    hot_texts = distinct_texts(docs.join(parts, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)) == parts["digest"], "left_semi"))
    dealt = lambda df: df.join(parts, "digest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    few = own.join(parts, "digest", "left_anti")
    return cut(few, index, texts, ["digest", "chars"]).unionByName(cut(many, dealt(distinct_index(hot_texts)), dealt(hot_texts), ["digest", "chars", "part"]))


def digests(made: DataFrame) -> DataFrame:
    """Hex digests of the outputs and of the texts rebuilt from them, which must be the documents' own."""
    hashed = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"), "digest")
    wrong = F.raise_error(F.concat(F.lit("another text than its own was rebuilt for document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    checked = F.when(F.unhex("restored_sha256") == F.col("digest"), F.col("restored_sha256")).otherwise(wrong)
    return hashed.withColumn("restored_sha256", checked).drop("digest")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS sizes, len(string_split(text, chr(10))) - CASE WHEN text = '' OR text[-1] = chr(10) THEN 1 ELSE 0 END AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(length(text), coalesce(list_sum(sizes[1:least(h1 % (n + 1), h2 % (n + 1))]), 0)) AS i, least(length(text), coalesce(list_sum(sizes[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, substr(text, 1, CAST(i AS BIGINT)) AS p, substr(text, CAST(i AS BIGINT) + 1, CAST(j - i AS BIGINT)) AS m, substr(text, CAST(j AS BIGINT) + 1) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM p
"""
