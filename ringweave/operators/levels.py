"""One search level: expand by all gates, key, drop what was seen, keep one each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.functions import canonical, gates, matrices
from ringweave.functions.bits import lit64, pin, shru, trailing_zeros
from ringweave.functions.matrices import NARROW, Lanes


def expand(level: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """Every row times each of the fifteen gates (a bounded explode, not a join).

    Takes ``gates`` and ``m`` and returns ``gates``, ``m`` and the ``gate`` applied.
    """
    step = level.select("gates", "m", F.explode(gates.all_gates()).alias("gate"))
    return step.select(
        gates.append(F.col("gates"), F.col("gate")).alias("gates"),
        pin(matrices.apply_gate("m", "gate", lanes)).alias("m"),
        "gate",
    )


def with_key(df: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """Adds ``canon_key``, the exact canonical key of column ``m``."""
    return df.withColumn("canon_key", canonical.canonical_key("m", lanes))


def one_per_class(df: DataFrame) -> DataFrame:
    """One row per ``canon_key``: the one with the least word.

    ``coset_word`` is the least word of the class whose last gate is not 0, null where
    all its words end in 0. ``min`` combines before the shuffle, so a class with very
    many members reaches its reducer as one row per map task.
    """
    payload = [c for c in df.columns if c not in ("canon_key", "gates", "coset_word")]
    best = F.min(F.struct("gates", *payload)).alias("best")
    coset = F.min(F.when(F.get("gates", F.size("gates") - 1) != 0, F.col("gates"))).alias("coset_word")
    return df.groupBy("canon_key").agg(best, coset).select("canon_key", "best.*", "coset_word")


def one_per_class_of_words(df: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """``one_per_class`` of rows whose ``m`` is the matrix of their word of at most fifteen gates.

    Words are aggregated as BIGINT codes, by hash and without a sort; only key and codes are
    shuffled, and the matrices are made again from the words that are kept.
    """
    return from_codes(least_codes(df.select("canon_key", gates.word_code(F.col("gates")).alias("code"))), lanes)


def least_codes(df: DataFrame) -> DataFrame:
    """(canon_key, code, coset): the least code of every class, and the least whose last gate is not 0."""
    # The last gate's digit is the lowest that is not zero; gate 0 is the digit 1.
    shift = F.call_function("div", trailing_zeros(F.col("code")), F.lit(4)).cast("int") * 4
    last = shru(F.col("code"), shift).bitwiseAND(lit64(15))
    coset = F.when((F.col("code") != 0) & (last != 1), F.col("code"))
    return df.groupBy("canon_key").agg(F.min("code").alias("code"), F.min(coset).alias("coset"))


def from_codes(df: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """Level rows (canon_key, gates, m, coset_word) from a class's codes."""
    words = df.select(
        "canon_key",
        pin(gates.code_word(F.col("code"))).alias("gates"),
        gates.code_word(F.col("coset")).alias("coset_word"),
    )
    return words.select("canon_key", "gates", pin(matrices.apply_word("gates", lanes=lanes)).alias("m"), "coset_word")


def drop_seen(df: DataFrame, *seen: DataFrame) -> DataFrame:
    """Rows whose class is in none of the given levels (left anti joins)."""
    for level in seen:
        df = df.join(level.select("canon_key"), "canon_key", "left_anti")
    return df


#: Rows that one task expands, about: each costs fifteen canonical keys.
TASK_ROWS = 4096


def rebalance(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in even partitions: one per core at least, and as many as its rows need."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)))


def next_level(current: DataFrame, *seen: DataFrame, lanes: Lanes = NARROW, rows: int = 0) -> DataFrame:
    """The classes one gate away from ``current`` that are in no ``seen`` level.

    ``rows``: how many rows ``current`` has, where that is known; it only sets how they are spread.
    """
    candidates = with_key(expand(rebalance(current, rows), lanes).drop("gate"), lanes)
    return drop_seen(one_per_class(candidates), *seen)


def next_level_of_words(current: DataFrame, *seen: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """The same where every ``m`` is the matrix of its word and words have at most fifteen gates.

    Candidates are a key and a code from the start. One exchange, by ``canon_key``: levels in
    ``seen`` that are stored in buckets of that key are joined where they lie.
    """
    parents = current.select(
        "m", gates.word_code(F.col("gates")).alias("code"), F.size("gates").alias("n"), F.explode(gates.all_gates()).alias("gate")
    )
    made = parents.select(
        gates.extend_code(F.col("code"), F.col("n"), F.col("gate")).alias("code"),
        pin(matrices.apply_gate("m", "gate", lanes)).alias("m"),
    )
    candidates = with_key(made, lanes).select("canon_key", "code")
    return from_codes(drop_seen(least_codes(candidates), *seen), lanes)


def coset_generators(
    level: DataFrame, lanes: Lanes = NARROW, legacy_suffix: bool = False
) -> DataFrame:
    """Rows whose last gate is not 0, times gate 0.

    ``legacy_suffix`` filters on the last *character* of the circuit text instead,
    which also drops words that end in gate 10.
    """
    last = F.element_at(F.col("gates"), -1)
    keep = (last != 0) & (last != 10) if legacy_suffix else last != 0
    return level.where(keep).select(
        gates.append(F.col("gates"), F.lit(0)).alias("gates"),
        pin(matrices.apply_gate("m", "0", lanes)).alias("m"),
    )
