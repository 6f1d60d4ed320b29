"""A Bloom filter of join keys as one row of bits, applied to the other side before the join."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.functions.bits import lit64, shl, shru

#: Bits of a filter at most: 128 KB, whatever the number of keys.
MOST_BITS = 1 << 20
#: Bits per key that a filter is made with; about one key in two thousand passes by chance.
BITS_PER_KEY = 16
#: Places that a key sets.
HASHES = 4


def size_for(keys: int) -> int | None:
    """Bits for that many keys, or None where ``MOST_BITS`` would give a key less than eight."""
    bits = 64
    while bits < keys * BITS_PER_KEY:
        bits *= 2
    bits = min(bits, MOST_BITS)
    return bits if keys * 8 <= bits else None


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits).cast("bigint")) for i in range(HASHES)]


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with ``bits`` as ARRAY<BIGINT>: words are OR-ed map side before they are put in order."""
    spark = keys.sparkSession
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    mask = shl(lit64(1), F.col("p").bitwiseAND(lit64(63)).cast("int"))
    words = places.select(shru(F.col("p"), 6).alias("word"), mask.alias("mask"))
    every = words.union(spark.range(bits // 64).select("id", lit64(0)))
    merged = every.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return merged.agg(F.transform(ordered, lambda w: w["mask"]).alias("bits"))


def might_hold(made: DataFrame, key: Column, bits: int) -> Column:
    """False only for keys that the filter ``made`` was not built with; null keys are not held."""
    array = made.scalar()

    def is_set(place: Column) -> Column:
        word = F.get(array, shru(place, 6).cast("int"))
        return shru(word, place.bitwiseAND(lit64(63)).cast("int")).bitwiseAND(lit64(1)) == 1

    return key.isNotNull() & reduce(and_, map(is_set, _places(key, bits)))
