"""Witness sink, one folder per level, and level summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_witnesses(witnesses: DataFrame, path: str, t: int) -> None:
    """Circuits of one level as text lines under ``path/t=<t>``, replacing older ones.

    A level without witnesses still leaves its (empty) folder behind.
    """
    witnesses.select("circuit").write.mode("overwrite").text(f"{path}/t={t}")


def observed(level: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Counts rows and the largest exponent while the level is being written."""
    seen = Observation(name)
    return level.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("m.k").alias("max_k")), seen


def duration_text(milliseconds: int) -> str:
    """Elapsed time as h:mm:ss.mmm."""
    seconds, rest = divmod(milliseconds, 1000)
    return f"{seconds // 3600}:{seconds // 60 % 60:02}:{seconds % 60:02}.{rest:03}"
