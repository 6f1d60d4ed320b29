"""Text sources: pattern lines, CSV pattern lines, circuit lines, packed circuits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions import gates, words72


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One ``value`` per line. A missing path fails when the plan is built."""
    return spark.read.text(path)


def pattern_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(int_plane, sqrt2_plane) from 72-character lines in column ``value``.

    Malformed lines fail the query, or are left out when ``strict`` is false.
    """
    parsed = lines.select(words72.parse_pattern_text(F.col("value"), strict).struct().alias("w"))
    ints, roots = words72.to_planes(words72.Word72.field("w"))
    out = parsed.select(ints.alias("int_plane"), roots.alias("sqrt2_plane"))
    return out if strict else out.where("int_plane IS NOT NULL")


def csv_pattern_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """The same from lines of 36 comma-separated values."""
    text = lines.select(words72.csv_to_pattern_text(F.col("value"), strict).alias("value"))
    return pattern_lines(text if strict else text.where("value IS NOT NULL"), strict)


def circuit_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Keeps the columns of ``lines`` and adds ``gates`` from column ``value``."""
    out = lines.withColumn("gates", gates.parse_word(F.col("value"), strict))
    return out if strict else out.where("gates IS NOT NULL")


def packed_circuits(df: DataFrame, column: str) -> DataFrame:
    """Adds ``gates`` from a BINARY column with two gates per byte."""
    return df.withColumn("gates", gates.unpack_word(F.col(column)))


def read_patterns(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return pattern_lines(read_lines(spark, path), strict)


def read_csv_patterns(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return csv_pattern_lines(read_lines(spark, path), strict)


def read_circuits(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Circuit files as written by ``write_witnesses``; ``t`` comes from the folder name."""
    return circuit_lines(read_lines(spark, path), strict)
