"""Complex arithmetic on struct<r: double, i: double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_(r, i=0.0) -> Column:
    one = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(one(r).alias("r"), one(i).alias("i"))


def add(a: Column, b: Column) -> Column:
    return complex_(a["r"] + b["r"], a["i"] + b["i"])


def sub(a: Column, b: Column) -> Column:
    return complex_(a["r"] - b["r"], a["i"] - b["i"])


def mul(a: Column, b: Column) -> Column:
    return complex_(a["r"] * b["r"] - a["i"] * b["i"], a["r"] * b["i"] + a["i"] * b["r"])


def times(a: Column, x) -> Column:
    return complex_(a["r"] * x, a["i"] * x)


def conj(a: Column) -> Column:
    return complex_(a["r"], -a["i"])


def neg(a: Column) -> Column:
    return complex_(-a["r"], -a["i"])


def abs_(a: Column) -> Column:
    return F.hypot(a["r"], a["i"])


def arg(a: Column) -> Column:
    return F.atan2(a["i"], a["r"])


def inv(a: Column) -> Column:
    d = a["r"] * a["r"] + a["i"] * a["i"]
    return complex_(a["r"] / d, -a["i"] / d)


def div(a: Column, b: Column) -> Column:
    return mul(a, inv(b))


def polar(radius: Column, angle: Column) -> Column:
    return complex_(radius * F.cos(angle), radius * F.sin(angle))


def exp(a: Column) -> Column:
    return polar(F.exp(a["r"]), a["i"])


def log(a: Column) -> Column:
    return complex_(F.ln(abs_(a)), arg(a))


def sqrt(a: Column) -> Column:
    """The root with a non-negative real part."""
    return polar(F.sqrt(abs_(a)), arg(a) / 2)


def power(a: Column, b: Column) -> Column:
    """a ** b for complex b; 0 for a = 0."""
    return F.when(abs_(a) == 0, complex_(0.0)).otherwise(exp(mul(log(a), b)))


def cos(a: Column) -> Column:
    return complex_(F.cos(a["r"]) * F.cosh(a["i"]), -F.sin(a["r"]) * F.sinh(a["i"]))


def sin(a: Column) -> Column:
    return complex_(F.sin(a["r"]) * F.cosh(a["i"]), F.cos(a["r"]) * F.sinh(a["i"]))


def cosh(a: Column) -> Column:
    return complex_(F.cosh(a["r"]) * F.cos(a["i"]), F.sinh(a["r"]) * F.sin(a["i"]))


def sinh(a: Column) -> Column:
    return complex_(F.sinh(a["r"]) * F.cos(a["i"]), F.cosh(a["r"]) * F.sin(a["i"]))
