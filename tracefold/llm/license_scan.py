"""License scan with ordered signature rules, in DataFrame functions only.

Every text is brought into a normal form once. A few dozen keywords decide which
rule families are tried on it; each tried rule gives the word intervals where it
matches. A match inside another rule's interval is dropped if the other rule has
the higher priority, or the same priority and a longer interval (of equal ones
the first label in order stays). What is left labels the document, beside the
base phrases, which always count.

It is a projection: no shuffle, no join, and no row meets another row.

Defined results: null and empty texts have no words and no labels, score 0;
texts are scanned whole; repeated rows and ids give a row each; an empty table
gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.arrays import let
from tracefold.llm.license_rules import BASE, W, rules
from tracefold.llm.scans import pieces, totals_before

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = "array<struct<first:int,last:int,priority:int,label:string>>"


def _count(text: Column, of: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(of), F.lit("")))) / len(of)).cast("long")


def _words_in(text: Column) -> Column:
    """Words of a stretch of normal form; every word is followed by at least one space."""
    return F.regexp_count(text, F.lit("[^ ]+"))


def _base(norm: Column) -> Column:
    """(places, first word, last word, labels) of the base phrases."""
    found = []
    for phrase, label in BASE:
        form = f" {W.join(phrase.split())} "
        before = F.substring_index(norm, form, 1)
        upto = F.substring(norm, F.lit(1), F.length(norm) - F.length(F.substring_index(norm, form, -1)))
        found.append(
            F.when(
                F.contains(norm, F.lit(form)),
                F.struct(
                    _count(norm, form).alias("n"),
                    _words_in(before).cast("long").alias("first"),
                    (_words_in(upto) - len(phrase.split())).cast("long").alias("last"),
                    F.lit(label).alias("label"),
                ),
            )
        )
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _literal_rules() -> tuple[Column, Column]:
    """(all keywords, all rules grouped by keyword), as literal arrays built once for each query."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by: dict[str, list[tuple[str, int, str]]] = {}
    for label, priority, keyword, pattern in rules():
        by.setdefault(keyword, []).append((label, priority, pattern))
    groups = [
        f"named_struct('keyword', {quote(k)}, 'rules', array({', '.join(f'named_struct({quote("label")}, {quote(a)}, {quote("priority")}, {p}, {quote("pattern")}, {quote(r)})' for a, p, r in rs)}))"
        for k, rs in by.items()
    ]
    return F.array(*[F.lit(k) for k in by]), F.expr(f"array({', '.join(groups)})")


def _spans(norm: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches: the words before a match are those of what lies between matches."""
    gaps = F.transform(F.split(norm, rule["pattern"]), lambda g: F.regexp_count(g, F.lit("[^ ]+")))
    hits = F.transform(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), lambda m: F.regexp_count(m, F.lit("[^ ]+")))
    # the words before hit i are those of the gaps up to it and of the hits before it
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def placed(x: Column) -> Column:
        before = totals_before(F.transform(x, lambda v: v["gap"] + v["hit"]))
        return F.zip_with(x, before, lambda v, at: F.struct((at + v["gap"]).cast("int").alias("first"), (at + v["gap"] + v["hit"] - 1).cast("int").alias("last"), rule["priority"].alias("priority"), rule["label"].alias("label")))

    return let(lengths, placed)


#: All priorities, ascending.
_LEVELS = sorted({priority for _, priority, _, _ in rules()})


def _suppressed(spans: Column) -> Column:
    """Spans that no other one suppresses, sorted.

    In the order of first word, then falling last word and priority, then label, whatever holds a span
    comes before it. So a span goes if one before it, of its priority or a higher one, reaches as far as it,
    which an equal one does, too.
    ``reach`` holds the farthest last word by least priority; it is carried from piece to piece.
    """
    key = F.transform(spans, lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("back"), (-x["priority"]).alias("low"), x["label"].alias("label")))
    levels = F.lit(_LEVELS)
    none = F.transform(levels, lambda p: F.lit(-1))
    farther = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))
    own = lambda x: F.transform(levels, lambda p: F.when(-x["low"] >= p, -x["back"]).otherwise(F.lit(-1)))

    def kept(parts: Column) -> Column:
        reached = F.transform(parts, lambda part: F.aggregate(part, none, lambda r, x: farther(r, own(x))))
        start = F.struct(none.alias("reach"), F.array().cast("array<array<int>>").alias("before"))
        carried = F.aggregate(reached, start, lambda s, r: F.struct(farther(s["reach"], r).alias("reach"), F.concat(s["before"], F.array(s["reach"])).alias("before")))["before"]

        def within(part: Column, reach: Column) -> Column:
            begin = F.struct(reach.alias("reach"), F.slice(part, 1, 0).alias("out"))
            held = lambda s, x: F.get(s["reach"], (F.array_position(levels, -x["low"]) - 1).cast("int")) >= -x["back"]
            return F.aggregate(part, begin, lambda s, x: F.struct(farther(s["reach"], own(x)).alias("reach"), F.when(held(s, x), s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out")))["out"]

        return F.flatten(F.zip_with(parts, carried, within))

    out = let(F.array_sort(key), lambda x: let(pieces(x), kept))
    return F.array_sort(F.transform(out, lambda x: F.struct(x["first"].alias("first"), (-x["back"]).alias("last"), (-x["low"]).alias("priority"), x["label"].alias("label"))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    keywords, groups = _literal_rules()
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    inner = F.regexp_replace(text, _BETWEEN, W)
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), inner.alias("inner")).select("doc_id", F.concat(F.lit(" "), F.trim("inner"), F.lit(" ")).alias("norm"))
    n = F.when(F.length("norm") <= 2, F.lit(0)).otherwise((F.length("norm") - F.length(F.replace("norm", F.lit(W), F.lit(" "))) + 1).cast("long")).cast("long")
    kept = F.filter(keywords, lambda k: F.contains(F.col("norm"), k))
    first = norm.select("doc_id", "norm", n.alias("n_words"), _base(F.col("norm")).alias("base"), kept.alias("keywords"))
    tried = F.filter(groups, lambda g: F.array_contains(F.col("keywords"), g["keyword"]))
    spans = F.flatten(F.transform(tried, lambda g: F.flatten(F.transform(g["rules"], lambda r: _spans(F.col("norm"), r)))))
    empty = F.array().cast(_SPAN)
    second = first.select("doc_id", "n_words", "base", F.when(F.size("keywords") > 0, spans).otherwise(empty).alias("spans"))

    third = second.select("doc_id", "n_words", "base", F.when(F.size("spans") > 0, _suppressed(F.col("spans"))).otherwise(empty).alias("detections"))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base_labels = F.transform("base", lambda b: b["label"])
    return third.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        labels(base_labels).alias("base_labels"),
        labels(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        # each detection leaves a share of doubt that falls with its priority
        (1 - F.aggregate("detections", F.lit(1.0), lambda s, d: s * (1 - d["priority"] / F.lit(125.0)))).alias("score"),
        "detections",
    )
