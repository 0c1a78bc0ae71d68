"""The trace table: one row a trace, header columns and the samples.

``seq`` gives the order that a file or a source has. Missing header values are
0, never null. Samples are single precision; computations run in double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("n_sample", T.IntegerType(), False),
        *[T.StructField(c, T.DoubleType()) for c in ("d_sample", "sample_start", "offset")],
        *[T.StructField(c, _POINT) for c in ("tx_loc", "rx_loc", "mid_point")],
        *[T.StructField(c, T.LongType()) for c in ("line_id", "trace_id", "ensemble_number", "ensemble_trace_number")],
        *[T.StructField(c, T.IntegerType()) for c in ("ensemble_type", "sampling_unit", "sampling_domain")],
        T.StructField("data", T.ArrayType(T.FloatType())),
    ]
)

# Fixed codes of header values.
ENSEMBLE_TYPES = {"unknown": 0, "tx": 1, "rx": 2, "cmp": 3, "offset": 4}
SAMPLING_UNITS = {"s": 0, "m": 1}
SAMPLING_DOMAINS = {"unit": 0, "fourier": 1}


def point(x=0.0, y=0.0, z=0.0):
    """A location struct; arguments are columns or numbers."""
    one = lambda v: (v if hasattr(v, "cast") else F.lit(v)).cast("double")
    return F.struct(one(x).alias("x"), one(y).alias("y"), one(z).alias("z"))


def as_traces(df: DataFrame, **headers) -> DataFrame:
    """A full trace table from one with ``seq`` and ``data``; headers are columns or values, others 0."""
    out = df.withColumns({k: v if hasattr(v, "cast") else F.lit(v) for k, v in headers.items()})
    out = out.withColumn("data", F.col("data").cast("array<float>")).withColumn("n_sample", F.size("data"))
    cols = []
    for f in TRACE_SCHEMA.fields:
        if f.name in out.columns:
            c = F.col(f.name)
        elif isinstance(f.dataType, T.StructType):
            c = point()
        else:
            c = F.lit(0)
        cols.append(c.cast(f.dataType).alias(f.name))
    return out.select(*cols)


def from_arrays(spark, arrays, d_sample: float, sample_start: float = 0.0, sampling_unit: str = "s", sampling_domain: str = "unit", **headers) -> DataFrame:
    """A trace table from a list of sample sequences or a 2-D array, in their order."""
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "seq long, data array<double>")
    return as_traces(df, d_sample=d_sample, sample_start=sample_start, sampling_unit=SAMPLING_UNITS[sampling_unit], sampling_domain=SAMPLING_DOMAINS[sampling_domain], **headers)


def vectors_as_traces(vectors: DataFrame, d_sample: float = 0.004) -> DataFrame:
    """The ``embeddings`` table seen as traces: vec_id orders them, label is the ensemble."""
    return as_traces(
        vectors.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("data"), F.col("vec_id").alias("trace_id"), F.col("label").cast("long").alias("ensemble_number")),
        d_sample=d_sample,
    )
