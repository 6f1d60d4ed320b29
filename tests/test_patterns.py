import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ringweave.functions import patterns as P
from ringweave.functions.patterns import Pattern
from ringweave.operators.orbits import orbit

# Cells at the largest exponent, as blocks (rows, columns), by expected case.
BLOCKS = {
    "1": [((0, 2), (0, 2))],
    "2": [((0, 4), (0, 2))],
    "2t": [((0, 2), (0, 4))],
    "3": [((0, 4), (0, 4))],
    "4": [((0, 2), (0, 4)), ((2, 4), (0, 2))],
    "5": [((0, 2), (0, 2)), ((2, 4), (2, 4))],
    "6": [((0, 2), (0, 4)), ((2, 4), (0, 2)), ((2, 4), (4, 6))],
    "6t": [((0, 4), (0, 2)), ((0, 2), (2, 4)), ((4, 6), (2, 4))],
    "7": [((0, 2), (0, 2)), ((2, 4), (2, 4)), ((4, 6), (4, 6))],
}


def plane_of(blocks):
    return sum(
        1 << (6 * c + r)
        for rows, cols in blocks
        for r in range(*rows)
        for c in range(*cols)
    )


def test_every_cell_and_value_round_trips(spark):
    rng = random.Random(1)
    rows = [
        (r, c, v, rng.getrandbits(36), rng.getrandbits(36))
        for r in range(6)
        for c in range(6)
        for v in range(4)
    ]
    df = spark.createDataFrame(rows, "r int, c int, v int, int_plane long, sqrt2_plane long")
    p, r, c = Pattern.field(), F.col("r"), F.col("c")
    by_value = P.set_value(p, r, c, F.col("v"))
    by_bits = P.set_bits(p, r, c, F.expr("v div 2"), F.expr("v % 2"))
    cleared = P.set_value(by_value, r, c, F.lit(0))
    got = df.select(
        "*",
        P.get_value(by_value, r, c).alias("seen"),
        P.equals(by_value, by_bits).alias("same"),
        P.get_value(cleared, r, c).alias("gone"),
        by_value.ints.alias("ints"),
    ).collect()
    assert len(got) == 144
    for row in got:
        assert row.seen == row.v and row.same and row.gone == 0
        other = ~(1 << (6 * row.c + row.r))
        assert row.ints & other == row.int_plane & other


def test_masks_follow_the_cell_formula():
    for i in range(6):
        assert P.ROW_MASKS[i] == sum(1 << (6 * c + i) for c in range(6))
        assert P.COLUMN_MASKS[i] == sum(1 << (6 * i + r) for r in range(6))


@pytest.mark.parametrize("name", BLOCKS)
def test_case_is_invariant_under_row_and_column_orders(spark, name):
    """All 720 * 720 arrangements; equal planes are merged between the two halves."""
    start = spark.createDataFrame([(plane_of(BLOCKS[name]), 0)], "int_plane long, sqrt2_plane long")
    orders = F.expr(f"array({', '.join(f'array{o}' for o in P.ROW_ORDERS)})")

    def all_orders(df):
        moved = P.permute_rows(Pattern.field(), "o")
        return df.select("*", F.explode(orders).alias("o")).select(
            moved.ints.alias("int_plane"), moved.roots.alias("sqrt2_plane")
        ).distinct()

    by_rows = all_orders(start)
    flipped = P.transpose(Pattern.field())
    turned = by_rows.select(flipped.ints.alias("int_plane"), flipped.roots.alias("sqrt2_plane"))
    cases = all_orders(turned).select(P.case_num(Pattern.field()).alias("c")).distinct().collect()
    assert [r.c for r in cases] == [int(name[0])]


def test_case_zero_and_eight(spark):
    full4 = sum(15 << (6 * c) for c in range(6))  # 24 cells
    df = spark.createDataFrame([(P.IDENTITY_PLANE, 0), (full4, 0), (0, 0)], "int_plane long, sqrt2_plane long")
    assert [r[0] for r in df.select(P.case_num(Pattern.field())).collect()] == [0, 8, 0]


def _orbit_by_hand(ints, roots, all_mods):
    cell = lambda plane, r, c: plane >> (6 * c + r) & 1
    out = set()
    for order in permutations(range(6)):
        base = [
            [(cell(ints, order[r], c), cell(roots, order[r], c)) for c in range(6)] for r in range(6)
        ]
        mods = range(64) if all_mods or order != tuple(range(6)) else [0]
        for mask in mods:
            i = s = 0
            for r in range(6):
                for c in range(6):
                    a, b = base[r][c]
                    b ^= a & (mask >> r)
                    i |= a << (6 * c + r)
                    s |= (b & 1) << (6 * c + r)
            out.add((i, s))
    return out


@pytest.mark.parametrize("all_mods", [False, True])
def test_orbits_against_enumeration(spark, all_mods):
    rng = random.Random(11)
    samples = [
        (rng.getrandbits(36), rng.getrandbits(36)),  # six different rows
        (plane_of(BLOCKS["5"]), 0),
        (plane_of(BLOCKS["1"]), rng.getrandbits(36) & sum(P.ROW_MASKS[:3])),
    ]
    rows = [(k, i, s) for k, (i, s) in enumerate(samples)]
    df = spark.createDataFrame(rows, "k int, int_plane long, sqrt2_plane long")
    found = orbit(df, "k", all_mods).collect()
    sizes = {r[0]: r[1] for r in df.select("k", P.orbit_size(Pattern.field(), all_mods)).collect()}
    for k, (i, s) in enumerate(samples):
        expected = _orbit_by_hand(i, s, all_mods)
        mine = [(r.int_plane, r.sqrt2_plane) for r in found if r.k == k]
        assert len(mine) == len(set(mine)) == sizes[k] == len(expected)
        assert set(mine) == expected


def test_orbit_key_is_constant_on_orbits_and_separates_them(spark):
    rng = random.Random(13)
    rows = [(k, rng.getrandbits(36), rng.getrandbits(36)) for k in range(4)]
    df = spark.createDataFrame(rows, "k int, int_plane long, sqrt2_plane long")
    keys = orbit(df, "k", all_mods=True).select("k", P.orbit_key(Pattern.field()).alias("key")).distinct()
    assert keys.count() == keys.select("key").distinct().count() == 4


def test_same_class_and_bucket_hash_follow_case_and_planes(spark):
    rows = [(plane_of(BLOCKS["1"]), 0, plane_of(BLOCKS["1"]), 5), (plane_of(BLOCKS["1"]), 1, plane_of(BLOCKS["5"]), 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    p, q = Pattern(F.col("a"), F.col("b")), Pattern(F.col("c"), F.col("d"))
    got = df.select(P.same_class(p, q), P.equals(p, q), P.bucket_hash(p) == P.bucket_hash(p)).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, False, True)]
    assert df.select(P.bucket_hash(p)).distinct().count() == 2
