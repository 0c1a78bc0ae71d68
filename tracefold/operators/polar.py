"""Panels resampled to polar places, sample by sample.

Places of the new grid are made for each panel (their number is a parameter), and
meet the four samples around them in joins by (panel, trace, sample), with bilinear
weights; places beyond the samples are 0. A panel is never one array, and a new trace
is gathered from as many values as it has samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators import blocks


def numbered(traces: DataFrame, panel: list[str]) -> DataFrame:
    """Traces with ``place``, their number in the panel from 0, in the order of ``seq``."""
    return blocks.totals_before(traces.withColumn("one_", F.lit(1)), panel, "one_", "place").withColumn("place", F.col("place") - 1).drop("one_")


def _gathered(places: DataFrame, samples: DataFrame, panel: list[str], row: str, column: str) -> DataFrame:
    """places (panel, row, column, at_, it_: fractional trace and sample) to rows panel, row, data."""
    whole_a, whole_i = F.floor("at_").cast("long"), F.floor("it_").cast("long")
    corners = F.explode(F.array(*[F.struct((whole_a + a).alias("place"), (whole_i + i).alias("it"), ((F.col("at_") - whole_a if a else 1 - F.col("at_") + whole_a) * (F.col("it_") - whole_i if i else 1 - F.col("it_") + whole_i)).alias("w")) for a in (0, 1) for i in (0, 1)]))
    wanted = places.select(*panel, row, column, corners.alias("c")).select(*panel, row, column, F.col("c.place").alias("near_place_"), F.col("c.it").alias("near_it_"), F.col("c.w").alias("w_"))
    right = samples.withColumnsRenamed({"place": "near_place", "it": "near_it"}).withColumnsRenamed({k: f"{k}_s_" for k in panel}).withColumnsRenamed({"near_place": "near_place__s_", "near_it": "near_it__s_"})
    met = wanted.join(right, blocks.null_safe(wanted, right, [*panel, "near_place_", "near_it_"], "_s_"), "left")
    summed = met.groupBy(*panel, row, column).agg(F.sum(F.col("w_") * F.coalesce("v", F.lit(0.0))).alias("v"))
    data = F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), "v"))), lambda s: s["v"])
    return summed.groupBy(*panel, row).agg(data.alias("data"))


def _samples(traces: DataFrame, panel: list[str], place: str) -> DataFrame:
    rows = traces.select(*panel, F.col(place).cast("long").alias("place"), F.posexplode("data").alias("it", "v"))
    return rows.select(*panel, "place", F.col("it").cast("long").alias("it"), F.col("v").cast("double").alias("v"))


def _grid(traces: DataFrame, panel: list[str], row: str, rows: int, column: str, columns: int) -> DataFrame:
    one = traces.select(*panel).distinct()
    return one.withColumn(row, F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))


def to_polar(traces: DataFrame, panel: list[str], centre: tuple[float, float], angles: int, radii: int, step: float = 1.0) -> DataFrame:
    """Panel, angle (number), data (by radius): the panel around (trace number, sample number) ``centre``; angle 0 points along the samples."""
    turn = F.lit(2 * math.pi / angles) * F.col("angle")
    places = _grid(traces, panel, "angle", angles, "radius", radii).withColumn("at_", centre[0] + F.sin(turn) * F.col("radius") * step).withColumn("it_", centre[1] + F.cos(turn) * F.col("radius") * step)
    return _gathered(places, _samples(numbered(traces, panel), panel, "place"), panel, "angle", "radius")


def from_polar(polar: DataFrame, panel: list[str], centre: tuple[float, float], angles: int, traces: int, samples: int, step: float = 1.0) -> DataFrame:
    """Panel, place, data: traces from rows (panel, angle, data); angles go round, so the first follows the last."""
    across, along = F.col("place") - centre[0], F.col("sample") - centre[1]
    angle: Column = F.pmod(F.atan2(across, along), F.lit(2 * math.pi)) * (angles / (2 * math.pi))
    places = _grid(polar, panel, "place", traces, "sample", samples).withColumn("at_", angle).withColumn("it_", F.sqrt(across * across + along * along) / step)
    rows = _samples(polar, panel, "angle")
    again = rows.where("place = 0").withColumn("place", F.lit(angles).cast("long"))
    return _gathered(places, rows.unionByName(again), panel, "place", "sample")
