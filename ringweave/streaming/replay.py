"""Structured Streaming form of circuit replay.

The replay of a line is a projection, so the batch functions apply unchanged to a
stream. The only state is which cases have been seen: at most nine keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions import gates
from ringweave.functions.matrices import WIDE, Lanes
from ringweave.operators.words import with_matrix, with_pattern
from ringweave.sources.lines import circuit_lines


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Circuit files that appear in a folder."""
    return spark.readStream.text(path)


def replay(lines: DataFrame, lanes: Lanes = WIDE) -> DataFrame:
    """circuit, lde and case_num of each line in column ``value``."""
    rows = with_pattern(with_matrix(circuit_lines(lines), lanes), lanes)
    return rows.select(gates.word_text(F.col("gates")).alias("circuit"), "lde", "case_num")


def first_of_each_case(replayed: DataFrame) -> DataFrame:
    """Emits a circuit when it is the first of its case; later ones are dropped."""
    return replayed.where("case_num <> 0").dropDuplicates(["case_num"])
