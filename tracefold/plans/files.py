"""Queries over files: tables written in a format and read back, with SQL on the table itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.plans.catalog import S, query, table, traces
from tracefold.session import work_path
from tracefold.sources import exchange, native, sps

_SAMPLES = f"WITH {S} SELECT vec_id, CAST(label AS BIGINT) AS label, it, round(v, 6) AS v FROM s"


def _rows(df, vec_id: str, label: str):
    out = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.posexplode("data").alias("it", "v"))
    return out.select("vec_id", "label", F.col("it").cast("long").alias("it"), F.round(F.col("v").cast("double"), 6).alias("v"))


def _keyed(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("seq"), F.col("vec_id").cast("int").alias("tracl"), F.col("label").alias("cdp"), F.lit(4000).alias("dt"), F.col("embedding").alias("data"))


@query(_SAMPLES)
def exchange_round_trip(spark, sf_dir):
    """Traces as a folder of exchange parts in the other byte order, and back."""
    path = work_path(spark, "exchange")
    exchange.write_exchange(_keyed(spark, sf_dir), path, "big", single=False)
    return _rows(exchange.read_exchange(spark, path, endian="big"), "tracl", "cdp")


@query(f"WITH {S} SELECT vec_id, CAST(label AS BIGINT) AS label, it, round(v * 100) AS v FROM s")
def exchange_line_headers(spark, sf_dir):
    """One exchange file with line headers and 16-bit samples (hundredths), and back."""
    path = work_path(spark, "exchange") + ".sgy"
    hundredths = F.transform("data", lambda v: F.round(v.cast("double") * 100))
    exchange.write_exchange(_keyed(spark, sf_dir).withColumn("data", hundredths), path, "little", text=["C 1 HUNDREDTHS"], sample_code=3)
    return _rows(exchange.read_exchange(spark, path, endian="little", tracesPerPartition=500), "tracl", "cdp")


@query(_SAMPLES)
def native_round_trip(spark, sf_dir):
    """Traces in native part files, and back."""
    path = work_path(spark, "native")
    spark.dataSource.register(native.TraceFile)
    traces(spark, sf_dir).write.format("tracefile").mode("append").save(path)
    return _rows(native.read_file(spark, path), "trace_id", "ensemble_number")


@F.pandas_udf(T.IntegerType())
def _swapped(x: pd.Series) -> pd.Series:
    return pd.Series(native.swap_bytes(x.to_numpy().astype("=i4"), ">"))


@F.pandas_udf(T.IntegerType())
def _pairs(x: pd.Series) -> pd.Series:
    return pd.Series(native.swap_bytes(x.to_numpy().astype("=i4"), "<>"))


@query("""
WITH b AS (SELECT event_id, event_id & 255 AS b0, (event_id >> 8) & 255 AS b1, (event_id >> 16) & 255 AS b2, (event_id >> 24) & 255 AS b3 FROM events),
s AS (SELECT event_id, b3 + b2 * 256 + b1 * 65536 + b0 * 16777216 AS whole, b2 + b3 * 256 + b0 * 65536 + b1 * 16777216 AS pairs FROM b)
SELECT event_id, CAST(CASE WHEN whole >= 2147483648 THEN whole - 4294967296 ELSE whole END AS INT) AS whole, CAST(CASE WHEN pairs >= 2147483648 THEN pairs - 4294967296 ELSE pairs END AS INT) AS pairs, true AS back FROM s""")
def swapped_bytes(spark, sf_dir):
    """32-bit values in the other byte orders, and whether swapping twice gives them back."""
    x = F.col("event_id").cast("int")
    return table(spark, sf_dir, "events").select("event_id", _swapped(x).alias("whole"), _pairs(x).alias("pairs"), (_swapped(_swapped(x)) == x).alias("back"))


@query("""
SELECT CAST(c_nationkey AS DOUBLE) AS line, CAST(c_custkey AS DOUBLE) AS point, 'C' || c_nationkey % 10 AS code, round(c_acctbal * 1.0, 2) AS northing, CAST(c_custkey % 1000 AS DOUBLE) AS elevation, CAST(c_custkey % 366 AS INT) AS day FROM customer""")
def sps_positions(spark, sf_dir):
    """Customers as source points of positioning records, and back."""
    c = table(spark, sf_dir, "customer")
    path = work_path(spark, "positions")
    sps.write_points(c.select(F.col("c_nationkey").alias("line"), F.col("c_custkey").alias("point"), F.concat(F.lit("C"), F.col("c_nationkey") % 10).alias("code"), F.round("c_acctbal", 2).cast("decimal(10,2)").alias("northing"), (F.col("c_custkey") % 1000).alias("elevation"), (F.col("c_custkey") % 366).alias("day")), path)
    return sps.read_points(spark, path).select("line", "point", "code", "northing", "elevation", "day")
