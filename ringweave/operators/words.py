"""Gate words out of relational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.functions import matrices, patterns
from ringweave.functions.bits import fence
from ringweave.functions.gates import N_GATES
from ringweave.functions.matrices import NARROW, Lanes


def slot_words(
    df: DataFrame, keys: Sequence[str], slot: Column, value: Column, slots: Sequence
) -> DataFrame:
    """One word per key: for each slot in order, gate = min(value) mod 15.

    Slots are a fixed list, so the whole word is a row of ``min`` buffers: one
    shuffle, partial aggregation before it, no collected groups and no sort. A hot
    key shrinks to one row per map task. A slot value outside the list fails the
    query instead of losing rows.
    """
    known = slot.isin(list(slots))
    checked = F.when(known | slot.isNull(), slot).otherwise(
        F.raise_error(F.lit("slot value outside the declared list"))
    )
    picked = df.select(*keys, checked.alias("__slot"), value.cast("bigint").alias("__value"))
    lowest = [
        F.min(F.when(F.col("__slot") == s, F.col("__value"))).alias(f"__s{i}")
        for i, s in enumerate(slots)
    ]
    gates = [(F.col(f"__s{i}") % N_GATES).cast("tinyint") for i in range(len(slots))]
    return (
        picked.groupBy(*keys)
        .agg(*lowest)
        .select(*keys, F.array_compact(F.array(*gates)).alias("gates"))
    )


def with_matrix(df: DataFrame, lanes: Lanes = NARROW, gates: str = "gates") -> DataFrame:
    """Adds ``m``, the matrix of each row's word."""
    return df.withColumn("m", fence(matrices.apply_word(gates, lanes=lanes)))


def with_pattern(df: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """Adds lde, int_plane, sqrt2_plane and case_num of column ``m``."""
    planes = F.struct(
        matrices.int_plane("m", lanes).alias("ints"), matrices.sqrt2_plane("m", lanes).alias("roots")
    )
    fenced = df.withColumn("lde", matrices.least_exponent("m")).withColumn("__planes", fence(planes))
    return (
        fenced.withColumns({"int_plane": F.col("__planes.ints"), "sqrt2_plane": F.col("__planes.roots")})
        .drop("__planes")
        .withColumn("case_num", patterns.case_num(patterns.Pattern.field()))
    )
