"""Statistics over groups: regression, fits, quantiles, histograms, coordinate scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.special import chi_square_tail


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """slope, intercept, absolute correlation and standard error of y over x in each group.

    One aggregation with map-side partial sums; groups of fewer than three rows have no standard error.
    """
    n = F.regr_count(y, x)
    sums = df.groupBy(*keys).agg(
        n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.abs(F.corr(y, x)).alias("r"), F.regr_syy(y, x).alias("syy_"), F.regr_sxy(y, x).alias("sxy_")
    )
    rest = F.greatest(F.col("syy_") - F.col("slope") * F.col("sxy_"), F.lit(0.0))
    return sums.withColumn("std_error", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2)))).drop("syy_", "sxy_")


def weighted_fit(df: DataFrame, keys: list[str], y: str, x: str, sigma: str) -> DataFrame:
    """y = a + b x with weights 1 / sigma**2: a, b, their deviations, chi squared and the chance that it is exceeded.

    Groups of one row or one x have no fit (nulls), those of two rows no such chance.
    """
    w = 1 / (F.col(sigma) * F.col(sigma))
    s = df.groupBy(*keys).agg(
        F.sum(w).alias("s"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"), F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(x) * F.col(y)).alias("sxy"),
        F.sum(w * F.col(y) * F.col(y)).alias("syy"), F.count(w * F.col(x) * F.col(y)).alias("n"), F.min(x).alias("least_"), F.max(x).alias("most_"),
    )
    d = F.when(F.col("most_") > F.col("least_"), F.nullif(F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)))
    a = (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / d
    b = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / d
    chi2 = F.greatest(F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + a * a * F.col("s") + 2 * a * b * F.col("sx") + b * b * F.col("sxx"), F.lit(0.0))
    fitted = s.select(*keys, a.alias("a"), b.alias("b"), F.sqrt(F.col("sxx") / d).alias("sig_a"), F.sqrt(F.col("s") / d).alias("sig_b"), F.when(d.isNotNull(), chi2).alias("chi2"), "n")
    return fitted.withColumn("q", chi_square_tail(F.col("chi2"), F.col("n") - 2)).drop("n")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Quantiles of each group; ``exact=False`` uses a bounded sketch, for groups that are too large to hold."""
    name = lambda p: f"q{int(round(100 * p)):02d}"
    if exact:
        return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(name(p)) for p in at])
    return df.groupBy(*keys).agg(F.percentile_approx(value, at, accuracy).alias("q")).select(*keys, *[F.get("q", F.lit(k)).alias(name(p)) for k, p in enumerate(at)])


def order_statistic(df: DataFrame, keys: list[str], value: str, m: int) -> DataFrame:
    """The m-th smallest value (from 0) of each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") == m + 1).select(*keys, F.col(value).alias("value"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins between low and high; values outside are left out, high counts in the last bin."""
    inside = df.where(F.col(value).between(low, high))
    return inside.groupBy(F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def smoothed_histogram(df: DataFrame, value: str, low: float, high: float, bins: int, reach: int = 5) -> DataFrame:
    """bin, share: the counts of :func:`histogram` under a Gaussian of exp(-pi r²) within ``reach`` bins, as shares that add to 1.

    Every bin has a row. Without a value inside the shares are null.
    """
    spread = F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda r: F.struct((F.col("bin") + r).alias("bin"), (F.col("n") * F.exp(-math.pi * r * r)).alias("v"))))
    parts = histogram(df, value, low, high, bins).select(spread.alias("p")).select("p.bin", "p.v").where(F.col("bin").between(1, bins))
    summed = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin").join(parts.groupBy("bin").agg(F.sum("v").alias("v")), "bin", "left")
    total = summed.agg(F.sum("v").alias("total_"))  # one row
    return summed.join(F.broadcast(total)).select("bin", (F.when(F.col("total_") > 0, F.coalesce("v", F.lit(0.0)) / F.col("total_"))).alias("share"))


def coordinate_multiplier(scalar: Column) -> Column:
    """Factor of a stored coordinate: s for positive, 1 / |s| for negative scalars, 1 for 0."""
    return F.when(scalar > 0, scalar.cast("double")).when(scalar < 0, 1 / F.abs(scalar).cast("double")).otherwise(1.0)


def coordinate_scalar(df: DataFrame, keys: list[str], coordinates: list[str], digits: int = 2_147_483_647) -> DataFrame:
    """The power of ten, as a header scalar, that keeps most decimals of a group's largest coordinate in 32 bits."""
    top = F.max(F.greatest(*[F.abs(c) for c in coordinates], F.lit(0.0)))
    out = df.groupBy(*keys).agg(top.alias("largest"))
    scalar = F.lit(None).cast("int")
    for k in (-10_000, -1000, -100, -10, 1, 10, 100, 1000, 10_000):
        factor = -k if k < 0 else 1 / k
        scalar = F.coalesce(scalar, F.when(F.col("largest") * factor < digits, F.lit(k)))
    return out.withColumn("scalar", scalar)


def fractal_dimension(x: Column, shortest: int, longest: int, step: int) -> Column:
    """Divider dimension of a sample array: 1 - slope of ln(length) over ln(ruler)."""
    from tracefold.functions.arrays import _sum

    rulers = list(range(shortest, longest + 1, step))

    def length(k: int) -> Column:
        n = F.floor((F.size(x) - 1) / k).cast("int")
        return _sum(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.hypot(F.lit(float(k)), F.get(x, (i + 1) * k).cast("double") - F.get(x, i * k))))

    logs = [(F.log(F.lit(float(k))), F.log(length(k))) for k in rulers]
    mx = sum(a for a, _ in logs) / len(logs)
    my = sum(b for _, b in logs) / len(logs)
    return 1 - sum((a - mx) * (b - my) for a, b in logs) / sum((a - mx) * (a - mx) for a, _ in logs)
