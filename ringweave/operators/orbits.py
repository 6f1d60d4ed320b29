"""Orbits of patterns under row orders and row mods."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.functions import patterns
from ringweave.functions.bits import let, pin
from ringweave.functions.patterns import Pattern
from ringweave.operators.levels import rebalance


PAIRS = list(combinations(range(6), 2))


def _swapped(order: tuple[int, ...]) -> int:
    """Bits of the row pairs that an order puts the other way round."""
    return sum(1 << i for i, (p, q) in enumerate(PAIRS) if order.index(p) > order.index(q))


def distinct_orders(p: Pattern) -> Column:
    """ARRAY of the row orders that give different patterns.

    Orders of six rows that differ only in how equal rows are placed give one pattern; of
    these the one that keeps equal rows in their order is listed. So what is listed
    stands for the cosets of the rows' stabiliser, and nothing has to be compared afterwards.
    """
    rows = [patterns.row_code(p, r) for r in range(6)]
    equal = F.lit(0)
    for i, (r, s) in enumerate(PAIRS):
        equal = equal.bitwiseOR(F.when(rows[r] == rows[s], 1 << i).otherwise(0))
    table = ", ".join(f"named_struct('rows', array{o}, 'swapped', {_swapped(o)})" for o in patterns.ROW_ORDERS)
    return let(
        equal,
        lambda e: F.transform(
            F.filter(F.expr(f"array({table})"), lambda o: o["swapped"].bitwiseAND(e) == 0), lambda o: o["rows"]
        ),
    )


def orbit(df: DataFrame, key: str, all_mods: bool = False) -> DataFrame:
    """(key, int_plane, sqrt2_plane): the distinct orbit members of each row's pattern.

    Needs a unique ``key`` with int_plane and sqrt2_plane. Rows are first brought to their
    lesser mod; ``distinct_orders`` of those are listed, and each takes every mod of its
    non-empty rows. Members are distinct by construction, so nothing is shuffled.

    With ``all_mods`` false the mods of the unpermuted pattern are left out unless
    another row order gives them too, i.e. unless two rows agree up to a mod.
    """
    base = patterns.least_mods(Pattern.field())
    start = df.select(
        key,
        F.col("sqrt2_plane").alias("own"),
        pin(base.ints).alias("i0"),
        pin(base.roots).alias("s0"),
        pin(F.size(F.array_distinct(patterns.orbit_key(Pattern.field()))) == 6).alias("all_differ"),
    )
    moved = patterns.permute_rows(Pattern(F.col("i0"), F.col("s0")), "order")
    listed = start.select("*", F.explode(distinct_orders(Pattern(F.col("i0"), F.col("s0")))).alias("order"))
    arranged = listed.select(
        key, "own", "i0", "s0", "all_differ", pin(moved.ints).alias("i1"), pin(moved.roots).alias("s1")
    )
    live = patterns.live_rows(Pattern(F.col("i1"), F.col("s1")))
    masks = F.filter(
        F.sequence(F.lit(0), F.lit(63)), lambda m: m.bitwiseAND(F.bitwise_not(F.col("live"))) == 0
    )
    members = arranged.withColumn("live", pin(live)).withColumn("mods", F.explode(masks))
    changed = patterns.mod_rows(Pattern(F.col("i1"), F.col("s1")), F.col("mods"))
    if not all_mods:
        unmoved = (F.col("i1") == F.col("i0")) & (F.col("s1") == F.col("s0"))
        members = members.where(~(F.col("all_differ") & unmoved & (changed.roots != F.col("own"))))
    return members.select(
        key, changed.ints.alias("int_plane"), changed.roots.alias("sqrt2_plane")
    )


#: Patterns of one task of ``orbit_digests``.
DIGEST_ROWS = 1000


def members(ints: int, roots: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the distinct members of one pattern's orbit, as ``orbit`` lists them: (orders,) and (orders, mods)."""
    mask = patterns.ROW_MASKS[0]
    i = [ints >> r & mask for r in range(6)]
    own = [roots >> r & mask for r in range(6)]
    s = [min(x, x ^ y) for x, y in zip(own, i, strict=True)]
    rows = list(zip(i, s, strict=True))
    equal = sum(1 << at for at, (p, q) in enumerate(PAIRS) if rows[p] == rows[q])
    orders = _ORDERS[_SWAPPED & equal == 0]
    places = np.argsort(orders, axis=1)
    planes = (np.array(i, np.int64)[orders] << np.arange(6)).sum(axis=1)
    made = (np.array(s, np.int64)[orders] << np.arange(6)).sum(axis=1)[:, None]
    for r in range(6):
        if i[r]:
            made = np.concatenate([made, made ^ (np.int64(i[r]) << places[:, r])[:, None]], axis=1)
    return planes, made


_ORDERS = np.array(patterns.ROW_ORDERS)
_SWAPPED = np.array([_swapped(o) for o in patterns.ROW_ORDERS])


def orbit_digests(df: DataFrame, modulus: int) -> DataFrame:
    """Adds members, least_ints, roots_xor and roots_sum (of sqrt2_plane mod ``modulus``) over each row's orbit.

    Needs int_plane and sqrt2_plane. Every member is made, in arrays inside the row's task, so
    none becomes a row. Mods of the unpermuted pattern are left out as ``orbit`` does.
    """
    names = df.columns
    at = [names.index("int_plane"), names.index("sqrt2_plane")]

    def digest(ints: int, roots: int) -> tuple[int, int, int, int]:
        planes, made = members(ints, roots)
        values, left_out = made, 0
        if len(made) == len(_ORDERS):  # all rows differ: the first order alone keeps the pattern
            values, left_out = made[1:], made.shape[1] - 1
        total, odd = int((values % modulus).sum()), int(np.bitwise_xor.reduce(values, axis=None))
        if left_out:
            total, odd = total + roots % modulus, odd ^ roots
        elif values is not made:
            total, odd = total + int(made[0, 0]) % modulus, odd ^ int(made[0, 0])
        return made.size - left_out, int(planes.min()), odd, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(*x) for x in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            digests = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *digests], [*names, *DIGESTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{d} bigint" for d in DIGESTS)])
    return rebalance(df, df.count(), DIGEST_ROWS).mapInArrow(run, schema)


DIGESTS = ("members", "least_ints", "roots_xor", "roots_sum")
