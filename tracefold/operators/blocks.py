"""Panels cut into blocks of consecutive rows, so that no task sorts or holds a whole panel.

A panel of more than ``rows`` rows is cut at rows drawn by the hash of their order
value, one in ``rows`` on average. The cuts of a panel (one number for each
block) are one aggregate with map-side combination; they meet the rows in a join
whose one side is a row a large panel, which Spark broadcasts when it measures
it small. Within a block, windows and groups see about ``rows`` rows.

Tables whose panels are all small keep a plain window: that is found out first, by
one job over the panel columns.

``with_margins`` copies to each block the rows that precede its first and follow
its last, wherever they lie, so that windows over neighbours give within (panel,
block) what they would give over the panel.

The order column must tell a panel's rows apart; a null order comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 4096
_ADDED = ("block_", "least_", "most_")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> list[Column]:
    return [left[k].eqNullSafe(right[f"{k}{suffix}"]) for k in keys]


def has_large(df: DataFrame, panel: list[str], rows: int) -> bool:
    """Whether some panel has more than ``rows`` rows; one job over the panel columns."""
    return not df.groupBy(*panel).count().where(F.col("count") > rows).isEmpty()


def _block(order: Column) -> Column:
    """Number of cuts at or before a row, found in two steps of about the root of their number."""
    step = F.greatest(F.ceil(F.sqrt(F.size("cuts_"))).cast("int"), F.lit(1))
    firsts = F.filter("cuts_", lambda c, i: i % step == 0)
    before = F.greatest(F.size(F.filter(firsts, lambda c: c <= order)) - 1, F.lit(0)) * step
    return F.when(F.size("cuts_") == 0, 0).otherwise(before + F.size(F.filter(F.slice("cuts_", before + 1, step), lambda c: c <= order)))


def in_blocks(df: DataFrame, panel: list[str], order: str = "seq", rows: int | None = None, large_ones: bool | None = None) -> DataFrame:
    """df with block_, and for large panels the least and the greatest order value (null for panels of one block).

    ``rows`` is ``ROWS`` unless it is given; ``large_ones`` is whether there are large panels, where that is known.
    """
    rows = rows or ROWS
    if not (has_large(df, panel, rows) if large_ones is None else large_ones):
        none = F.lit(None).cast(df.schema[order].dataType)
        return df.withColumns({"least_": none, "most_": none, "block_": F.lit(0)})
    drawn = F.when(F.pmod(F.xxhash64(F.col(order)), F.lit(rows)) == 0, F.col(order))
    large = df.groupBy(*panel).agg(F.count(F.lit(1)).alias("n_"), F.min(order).alias("least_"), F.max(order).alias("most_"), F.array_sort(F.collect_set(drawn)).alias("cuts_"))
    large = large.where(F.col("n_") > rows).drop("n_").withColumnsRenamed({k: f"{k}_large_" for k in panel})
    met = df.join(large, null_safe(df, large, panel, "_large_"), "left").drop(*(f"{k}_large_" for k in panel))
    return met.withColumn("block_", F.coalesce(_block(F.col(order)), F.lit(0)).cast("int")).drop("cuts_")


def with_margins(df: DataFrame, panel: list[str], order: str = "seq", before: int = 1, after: int = 1, rows: int | None = None, large_ones: bool | None = None) -> DataFrame:
    """df in blocks, with copies (``margin_``) of the rows next to each block."""
    rows = rows or ROWS
    large_ones = has_large(df, panel, rows) if large_ones is None else large_ones
    blocked = in_blocks(df, panel, order, rows, large_ones)
    if not large_ones:
        return blocked.withColumn("margin_", F.lit(False))
    own = Window.partitionBy(*panel, "block_")
    keys = blocked.where("least_ is not null").select(*panel, "block_", order)
    keys = keys.withColumn("rank_", F.row_number().over(own.orderBy(order))).withColumn("back_", F.row_number().over(own.orderBy(F.desc(order))))
    # rows that a neighbouring block may need; between such a row and that block lie such rows only
    edges = keys.where((F.col("rank_") <= max(1, after)) | (F.col("back_") <= max(1, before)))
    line = Window.partitionBy(*panel).orderBy(order)
    blocks = F.array_compact(F.array(*[F.lead("block_", k).over(line) for k in range(1, before + 1)], *[F.lag("block_", k).over(line) for k in range(1, after + 1)]))
    edges = edges.withColumn("blocks_", blocks)
    sent = edges.select(*panel, order, F.explode(F.array_distinct(F.filter("blocks_", lambda b: b != F.col("block_")))).alias("to_")).distinct()
    sent = sent.withColumnsRenamed({k: f"{k}_sent_" for k in (*panel, order)})
    copies = blocked.join(sent, null_safe(blocked, sent, [*panel, order], "_sent_")).withColumn("block_", F.col("to_"))
    return blocked.withColumn("margin_", F.lit(False)).unionByName(copies.select(*blocked.columns).withColumn("margin_", F.lit(True)))


def without_margins(df: DataFrame) -> DataFrame:
    return df.where(~F.col("margin_")).drop("margin_", *_ADDED)


def window(panel: list[str], order: str = "seq"):
    """Rows of a block, margins among them, in order."""
    return Window.partitionBy(*panel, "block_").orderBy(order)


def totals_before(df: DataFrame, panel: list[str], value: str, name: str, order: str = "seq", rows: int | None = None) -> DataFrame:
    """df with the running total of ``value`` along the panel, this row included, as ``name``: totals within blocks, and of the blocks before."""
    rows = rows or ROWS
    large_ones = has_large(df, panel, rows)
    blocked = in_blocks(df, panel, order, rows, large_ones)
    if not large_ones:
        return blocked.withColumn(name, F.sum(value).over(window(panel, order).rowsBetween(Window.unboundedPreceding, 0))).drop(*_ADDED)
    sums = blocked.groupBy(*panel, "block_").agg(F.sum(value).alias("sum_"))
    earlier = sums.withColumn("base_", F.coalesce(F.sum("sum_").over(Window.partitionBy(*panel).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum_")
    earlier = earlier.withColumnsRenamed({k: f"{k}_base_" for k in (*panel, "block_")})
    inside = blocked.withColumn(name, F.sum(value).over(window(panel, order).rowsBetween(Window.unboundedPreceding, 0)))
    met = inside.join(earlier, null_safe(inside, earlier, [*panel, "block_"], "_base_")).withColumn(name, F.col(name) + F.col("base_"))
    return met.drop("base_", *(f"{k}_base_" for k in (*panel, "block_")), *_ADDED)
