"""Positioning records (SPS): fixed-width point (R, S) and relation (X) lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed layouts: field, first column, last column (from 1), type.
POINT = {
    "2.1": [("line", 2, 11, "double"), ("point", 12, 21, "double"), ("index", 24, 24, "int"), ("code", 25, 26, "string"), ("static", 27, 30, "int"), ("depth", 31, 34, "double"), ("datum", 35, 38, "int"), ("uphole", 39, 40, "int"), ("water", 41, 46, "double"), ("easting", 47, 55, "double"), ("northing", 56, 65, "double"), ("elevation", 66, 71, "double"), ("day", 72, 74, "int"), ("time", 75, 80, "int")],
    "0": [("line", 2, 17, "double"), ("point", 18, 25, "double"), ("index", 26, 26, "int"), ("code", 27, 28, "string"), ("static", 29, 32, "int"), ("depth", 33, 36, "double"), ("datum", 37, 40, "int"), ("uphole", 41, 42, "int"), ("water", 43, 46, "double"), ("easting", 47, 55, "double"), ("northing", 56, 65, "double"), ("elevation", 66, 71, "double"), ("day", 72, 74, "int"), ("time", 75, 80, "int")],
}
RELATION = {
    "2.1": [("tape", 2, 7, "string"), ("record", 8, 15, "long"), ("increment", 16, 16, "int"), ("instrument", 17, 17, "int"), ("line", 18, 27, "double"), ("point", 28, 37, "double"), ("index", 38, 38, "int"), ("from_channel", 39, 43, "int"), ("to_channel", 44, 48, "int"), ("channel_increment", 49, 49, "int"), ("receiver_line", 50, 59, "double"), ("from_receiver", 60, 69, "double"), ("to_receiver", 70, 79, "double"), ("receiver_index", 80, 80, "int")],
    "0": [("tape", 2, 7, "string"), ("record", 8, 11, "long"), ("increment", 12, 12, "int"), ("instrument", 13, 13, "int"), ("line", 14, 29, "double"), ("point", 30, 37, "double"), ("index", 38, 38, "int"), ("from_channel", 39, 42, "int"), ("to_channel", 43, 46, "int"), ("channel_increment", 47, 47, "int"), ("receiver_line", 48, 63, "double"), ("from_receiver", 64, 71, "double"), ("to_receiver", 72, 79, "double"), ("receiver_index", 80, 80, "int")],
}


def _fields(lines: DataFrame, layout: list) -> DataFrame:
    def one(first: int, last: int, kind: str):
        text = F.trim(F.substring("value", first, last - first + 1))
        return F.when(text != "", text if kind == "string" else text.try_cast(kind))

    return lines.select(F.substring("value", 1, 1).alias("kind"), *[one(a, b, k).alias(n) for n, a, b, k in layout])


def _lines(df: DataFrame, kind: str, layout: list) -> DataFrame:
    """Fixed-width lines from columns named like the fields; missing and null ones are blank, longer ones are cut."""
    parts, at = [F.lit(kind)], 2
    for name, first, last, _ in layout:
        text = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
        parts += [F.lit(" " * (first - at)), F.lpad(text, last - first + 1, " ")]
        at = last + 1
    return df.select(F.concat(*parts).alias("value"))


def write_points(df: DataFrame, path: str, kind: str = "S", revision: str = "2.1") -> None:
    """R or S records as text files."""
    _lines(df, kind, POINT[revision]).write.mode("overwrite").text(path)


def write_relations(df: DataFrame, path: str, revision: str = "2.1") -> None:
    _lines(df, "X", RELATION[revision]).write.mode("overwrite").text(path)


def read_points(spark: SparkSession, path: str, revision: str = "2.1") -> DataFrame:
    """R and S records of a text file; blank or unreadable fields are null."""
    return _fields(spark.read.text(path).where("substring(value, 1, 1) IN ('R', 'S')"), POINT[revision])


def read_relations(spark: SparkSession, path: str, revision: str = "2.1") -> DataFrame:
    return _fields(spark.read.text(path).where("substring(value, 1, 1) = 'X'"), RELATION[revision])


def receivers_of_shots(relations: DataFrame) -> DataFrame:
    """One row a live channel: shot line and point, channel, and its receiver by equal steps along the line."""
    n = F.floor((F.col("to_channel") - F.col("from_channel")) / F.greatest("channel_increment", F.lit(1))).cast("int")
    step = F.when(n > 0, (F.col("to_receiver") - F.col("from_receiver")) / n).otherwise(0.0)
    rows = relations.where("to_channel >= from_channel").select("line", "point", "receiver_line", "from_channel", "from_receiver", "channel_increment", step.alias("step"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return rows.select("line", "point", (F.col("from_channel") + F.col("k") * F.greatest("channel_increment", F.lit(1))).alias("channel"), "receiver_line", (F.col("from_receiver") + F.col("k") * F.col("step")).alias("receiver"))
