"""Running totals over arrays, as Spark expressions.

A fold that appends to an array copies it at every step. Here an array of n values
is folded in pieces of about the root of n, and the pieces' totals are folded in
turn, so the copies come to n times that root.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions.arrays import let


def pieces(x: Column) -> Column:
    """The array in pieces of about the root of its length, in order."""
    step = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(x, k, step))


def _folded(values: Column) -> Column:
    """total and before (of each value, the sum of those before it)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(values, start, lambda s, v: F.struct((s["total"] + v).cast("long").alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))


def totals_before(values: Column) -> Column:
    """Of each value (integers, none null) the sum of those before it; no sums of a null array."""

    def joined(parts: Column) -> Column:
        bases = _folded(F.transform(parts, lambda p: p["total"]))["before"]
        return let(bases, lambda b: F.flatten(F.zip_with(parts, b, lambda p, base: F.transform(p["before"], lambda v: v + base))))

    return let(values, lambda x: let(F.transform(pieces(x), _folded), joined))
