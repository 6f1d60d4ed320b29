import random

import pytest

from pyspark.sql import functions as F

from ringweave.functions import words72 as W
from ringweave.functions.words72 import Word72

TOP = 1 << 72
M36 = (1 << 36) - 1


def _frame(spark, values):
    rows = [(x >> 36, x & M36, y >> 36, y & M36, n) for x, y, n in values]
    return spark.createDataFrame(rows, "xh long, xl long, yh long, yl long, n int")


X = lambda: Word72(F.col("xh"), F.col("xl"))
Y = lambda: Word72(F.col("yh"), F.col("yl"))
value = lambda s: s.hi << 36 | s.lo


def test_arithmetic_shifts_and_windows(spark):
    rng = random.Random(3)
    values = [(rng.getrandbits(72), rng.getrandbits(72), rng.randrange(0, 80)) for _ in range(300)]
    values += [(TOP - 1, 1, 0), (1 << 64, 1, 36), (1, 0, 71), (2 << 64, 0, 1), (5, 5, 72)]
    n = F.col("n")
    got = _frame(spark, values).select(
        W.add(X(), Y()).struct(),
        W.sub(X(), Y()).struct(),
        W.shl(X(), n).struct(),
        W.shr(X(), n).struct(),
        W.bit_and(X(), Y()).struct(),
        W.bit_or(X(), Y()).struct(),
        W.bit_not(X()).struct(),
        W.popcount(X()),
        W.equals(X(), Y()),
        W.get_bits16(X(), n),
        W.get_pair(X(), n),
    ).collect()
    for (x, y, k), r in zip(values, got):
        assert value(r[0]) == (x + y) % TOP
        assert value(r[1]) == (x - y) % TOP
        assert value(r[2]) == (x << k) % TOP
        assert value(r[3]) == x >> k
        assert value(r[4]) == x & y
        assert value(r[5]) == x | y
        assert value(r[6]) == TOP - 1 - x
        assert r[7] == x.bit_count()
        assert r[8] == (x == y)
        assert r[9] == (x >> k) & 0xFFFF
        assert r[10] == (x >> k) & 3


def test_fixed_examples(spark):
    o = 0x12 << 64 | 0x123456789ABCDEF0
    got = _frame(spark, [(o, 0, 0)]).select(
        W.get_bits16(X(), 60), W.binary_text(X()), *W.to_64_8(X())
    ).first()
    assert got[0] == 0b0000000100100001
    assert got[1] == f"{o:072b}"
    assert (got[2], got[3]) == (0x123456789ABCDEF0, 0x12)


def test_single_bits_and_pairs_across_the_limb_edge(spark):
    for pos in (0, 35, 62, 63, 64, 70, 71):
        rows = _frame(spark, [(0, 0, pos), (TOP - 1, 0, pos)])
        one = rows.select(
            W.set_bit(X(), F.col("n"), F.lit(1)).struct(), W.set_bit(X(), F.col("n"), F.lit(0)).struct()
        ).collect()
        assert value(one[0][0]) == 1 << pos and value(one[0][1]) == 0
        assert value(one[1][1]) == TOP - 1 - (1 << pos)
        if pos < 71:
            pair = rows.select(W.set_pair(X(), F.col("n"), F.lit(2)).struct()).collect()
            assert value(pair[0][0]) == 2 << pos
            assert value(pair[1][0]) == (TOP - 1) & ~(3 << pos) | 2 << pos


def test_text_planes_and_64_8_round_trip(spark):
    rng = random.Random(5)
    values = [(rng.getrandbits(72), 0, 0) for _ in range(100)]
    df = _frame(spark, values).withColumn("t", W.pattern_text(X()))
    ints, roots = W.to_planes(X())
    again = W.from_planes(ints, roots)
    df = df.select(
        "t",
        ints.alias("i"),
        roots.alias("s"),
        again.struct().alias("again"),
        W.parse_pattern_text(F.col("t")).struct().alias("parsed"),
        W.from_64_8(*W.to_64_8(X())).struct().alias("via64"),
    )
    for (x, _, _), r in zip(values, df.collect()):
        bit = lambda p: x >> p & 1
        assert r.t == "".join(f"{bit(2 * i + 1)}{bit(2 * i)}" for i in range(36))
        assert r.i == sum(bit(2 * i + 1) << i for i in range(36))
        assert r.s == sum(bit(2 * i) << i for i in range(36))
        assert value(r.again) == value(r.parsed) == value(r.via64) == x


def test_csv_values_outside_the_range_fail_or_drop(spark):
    good, sevens, words = ",".join("0123" * 9), ",".join(["7"] * 36), ",".join(["x"] * 36)
    lines = spark.createDataFrame([(good,), (sevens,), (words,), ("",), (None,)], "line string")
    kept = [r[0] for r in lines.select(W.csv_to_pattern_text(F.col("line"), strict=False)).collect()]
    assert kept == ["00011011" * 9, None, None, None, None]
    for bad in (sevens, words):
        with pytest.raises(Exception, match="36 values"):
            lines.where(F.col("line") == bad).select(W.csv_to_pattern_text(F.col("line"))).collect()


def test_inputs_from_large_keys_stay_in_range(spark, tmp_path):
    from ringweave.plans.queries import pattern_orbit, word72_arith

    big = 10**12 + 7
    spark.createDataFrame(
        [(big, 1, big + 1, big + 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(big,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert word72_arith(spark, str(tmp_path)).count() == 1
    assert pattern_orbit(spark, str(tmp_path)).count() == 1
