"""Values at places interpolated from control points on the lines of an uneven grid.

Each place finds the pair of grid lines around it in both directions by itself, and
meets the four control points of that cell in one join by line numbers; weights are
linear. Beyond the outer lines the outer value holds, or the last slope goes on.

Defined results: a place with a null coordinate, or with a corner that has no control
point, gets null; with one line in a direction there is no weight in it; control points
on a line are told by (x, y), and of repeated ones the mean counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRAPOLATE = ("none", "both", "low", "high")


def bracket(place: Column, lines: list[float], extrapolate: str = "none") -> tuple[Column, Column]:
    """(number of the upper line, from 1; weight of the lower line) of a place among rising lines."""
    if extrapolate not in EXTRAPOLATE:
        raise ValueError(f"no mode {extrapolate}")
    if any(b <= a for a, b in zip(lines, lines[1:])) or not lines:
        raise ValueError("rising lines")
    if len(lines) == 1:
        return F.when(place.isNotNull(), F.lit(1)), F.when(place.isNotNull(), F.lit(1.0))
    if extrapolate not in ("both", "low"):
        place = F.greatest(place, F.lit(float(lines[0])))
    if extrapolate not in ("both", "high"):
        place = F.least(place, F.lit(float(lines[-1])))
    upper = F.lit(1)
    for k in range(1, len(lines) - 1):
        upper = upper + (place >= lines[k]).cast("int")
    grid = F.lit([float(x) for x in lines])
    high, low = F.get(grid, upper), F.get(grid, upper - 1)
    return upper, (high - place) / (high - low)


def interpolate_controls(df: DataFrame, x: str, y: str, controls: DataFrame, value: str, extrapolate_x: str = "none", extrapolate_y: str = "none", name: str = "value") -> DataFrame:
    """df with ``name``: the value at (x, y) from controls (x, y, value), which name their columns alike.

    The lines are the controls' distinct x and y: grid lines of a survey, collected to the driver. The control
    points themselves stay a table.
    """
    xs, ys = (sorted(float(r[0]) for r in controls.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).distinct().collect()) for c in (x, y))
    spark = df.sparkSession
    if not xs or not ys:
        return df.withColumn(name, F.lit(None).cast("double"))
    number = lambda lines, c: spark.createDataFrame([(k, v) for k, v in enumerate(lines)], f"i{c} int, at{c} double")
    placed = controls.select(F.col(x).cast("double").alias("atx"), F.col(y).cast("double").alias("aty"), F.col(value).cast("double").alias("v")).join(F.broadcast(number(xs, "x")), "atx").join(F.broadcast(number(ys, "y")), "aty")
    points = placed.groupBy("ix", "iy").agg(F.avg("v").alias("v_"))
    ux, wx = bracket(F.col(x).cast("double"), xs, extrapolate_x)
    uy, wy = bracket(F.col(y).cast("double"), ys, extrapolate_y)
    rows = df.withColumns({"ux_": ux, "wx_": wx, "uy_": uy, "wy_": wy})
    rows = rows.withColumns({"wx_": F.when(F.col(x).isNotNull(), F.col("wx_")), "wy_": F.when(F.col(y).isNotNull(), F.col("wy_"))})
    # every control point is a corner of up to four cells; a cell is told by its upper lines, and meets the rows in one join
    kinds = [(dx, dy) for dx in ((1, 0) if len(xs) > 1 else (1,)) for dy in ((1, 0) if len(ys) > 1 else (1,))]  # 1: the lower line
    corners = F.explode(F.array(*[F.struct((F.col("ix") + dx).alias("ux"), (F.col("iy") + dy).alias("uy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(kinds)]))
    cells = points.select("v_", corners.alias("c")).groupBy(F.col("c.ux").alias("cell_x_"), F.col("c.uy").alias("cell_y_"))
    cells = cells.agg(*[F.max(F.when(F.col("c.k") == k, F.col("v_"))).alias(f"v{k}_") for k in range(len(kinds))])
    weight = lambda dx, dy: (F.col("wx_") if dx else 1 - F.col("wx_")) * (F.col("wy_") if dy else 1 - F.col("wy_"))
    total = sum((weight(*kind) * F.col(f"v{k}_") for k, kind in enumerate(kinds)), F.lit(0.0))
    met = rows.join(cells, (F.col("ux_") == F.col("cell_x_")) & (F.col("uy_") == F.col("cell_y_")), "left").withColumn(name, total)
    return met.drop("ux_", "uy_", "wx_", "wy_", "cell_x_", "cell_y_", *(f"v{k}_" for k in range(len(kinds))))
