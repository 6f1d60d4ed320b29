"""6x6 patterns of two-bit residues as two 36-bit planes.

Bit 6*col + row of ``int_plane`` is the integer residue of a cell, the same bit of
``sqrt2_plane`` its sqrt2 residue. A cell's value is 2*int + sqrt2.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add, or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringweave.functions.bits import let, lit64, shl, shru

COLUMN_MASKS = [0b111111 << (6 * c) for c in range(6)]
ROW_MASKS = [sum(1 << (6 * c + r) for c in range(6)) for r in range(6)]
FULL = (1 << 36) - 1
# Residues of the identity matrix: ones below the largest exponent, on the diagonal.
IDENTITY_PLANE = sum(1 << (7 * i) for i in range(6))
ROW_ORDERS = list(permutations(range(6)))


class Pattern(NamedTuple):
    ints: Column
    roots: Column

    @staticmethod
    def field(name: str | None = None) -> "Pattern":
        """From a struct column, or from top-level int_plane and sqrt2_plane."""
        get = F.col if name is None else lambda f: F.col(name)[f]
        return Pattern(get("int_plane"), get("sqrt2_plane"))

    def struct(self) -> Column:
        return F.struct(self.ints.alias("int_plane"), self.roots.alias("sqrt2_plane"))


def empty() -> Pattern:
    return Pattern(lit64(0), lit64(0))


def identity() -> Pattern:
    """Pattern of the identity matrix, whose largest exponent is 0: value 2 on the diagonal."""
    return Pattern(lit64(IDENTITY_PLANE), lit64(0))


def _cell(row, col) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return as_col(col) * 6 + as_col(row)


def get_bits(p: Pattern, row, col) -> tuple[Column, Column]:
    """(integer bit, sqrt2 bit) of a cell."""
    bit = lambda plane: shru(plane, _cell(row, col)).bitwiseAND(lit64(1)).cast("int")
    return bit(p.ints), bit(p.roots)


def get_value(p: Pattern, row, col) -> Column:
    """Cell value 0..3."""
    i, s = get_bits(p, row, col)
    return i * 2 + s


def set_bits(p: Pattern, row, col, int_bit: Column, sqrt2_bit: Column) -> Pattern:
    position = _cell(row, col)
    hole = F.bitwise_not(shl(lit64(1), position))
    put = lambda plane, bit: plane.bitwiseAND(hole).bitwiseOR(
        shl(bit.cast("bigint").bitwiseAND(lit64(1)), position)
    )
    return Pattern(put(p.ints, int_bit), put(p.roots, sqrt2_bit))


def set_value(p: Pattern, row, col, value: Column) -> Pattern:
    return set_bits(p, row, col, shru(value.cast("bigint"), 1), value)


def set_bit(p: Pattern, position: Column, value: Column) -> Pattern:
    """Write one raw bit 0..71: odd positions are integer bits, even ones sqrt2 bits."""
    cell, odd = shru(position, 1), position % 2 == 1
    hole = F.bitwise_not(shl(lit64(1), cell))
    bit = shl(value.cast("bigint").bitwiseAND(lit64(1)), cell)
    put = lambda plane, chosen: F.when(chosen, plane.bitwiseAND(hole).bitwiseOR(bit)).otherwise(plane)
    return Pattern(put(p.ints, odd), put(p.roots, ~odd))


def masked_row(p: Pattern, row: int) -> Column:
    """Integer bits of one row, in place."""
    return p.ints.bitwiseAND(lit64(ROW_MASKS[row]))


def masked_column(p: Pattern, col: int) -> Column:
    return p.ints.bitwiseAND(lit64(COLUMN_MASKS[col]))


def weight(p: Pattern) -> Column:
    return F.bit_count(p.ints).cast("int")


def row_weight(p: Pattern, row: int) -> Column:
    return F.bit_count(masked_row(p, row)).cast("int")


def column_weight(p: Pattern, col: int) -> Column:
    return F.bit_count(masked_column(p, col)).cast("int")


def column_signature(p: Pattern, col: int) -> Column:
    """8 * (integer bits) + (sqrt2 bits) of one column."""
    mask = lit64(COLUMN_MASKS[col])
    return (F.bit_count(p.ints.bitwiseAND(mask)) * 8 + F.bit_count(p.roots.bitwiseAND(mask))).cast("int")


def case_num(p: Pattern) -> Column:
    """Case 0..8 of a pattern, from its weight and its first lines.

    Fixed rules. Weights 4 and 24 decide alone (1 and 8). Weight 16 is case 6 when
    one of the first three columns or rows has weight 2, else 3. Weight 12 is case 4
    when one of the first three columns has weight 4 or 0, else 7. Weight 8 is case 2
    when, among the first four columns or among the first four rows, one has weight 4
    or more than two are empty, else 5. Every other weight is case 0.
    """
    lines = [column_weight(p, i) for i in range(4)] + [row_weight(p, i) for i in range(4)]
    either = lambda conditions: reduce(or_, conditions)

    def decide(weights: Column) -> Column:
        cols = [F.get(weights, F.lit(i)) for i in range(4)]
        rows = [F.get(weights, F.lit(4 + i)) for i in range(4)]
        empty = lambda four: reduce(add, [(x == 0).cast("int") for x in four]) > 2
        six = either([x == 2 for x in cols[:3] + rows[:3]])
        four = either([(x == 4) | (x == 0) for x in cols[:3]])
        two = either([x == 4 for x in cols + rows]) | empty(cols) | empty(rows)
        return (
            F.when(w == 16, F.when(six, 6).otherwise(3))
            .when(w == 12, F.when(four, 4).otherwise(7))
            .otherwise(F.when(two, 2).otherwise(5))
        )

    w = weight(p)
    return (
        F.when(w == 4, 1)
        .when(w == 24, 8)
        .when(w.isin(8, 12, 16), let(F.array(*lines), decide))
        .otherwise(0)
    )


def same_class(p: Pattern, q: Pattern) -> Column:
    """Equivalence used for target sets: equal case numbers."""
    return case_num(p) == case_num(q)


def equals(p: Pattern, q: Pattern) -> Column:
    """All 72 bits equal."""
    return (p.ints == q.ints) & (p.roots == q.roots)


def bucket_hash(p: Pattern) -> Column:
    """Hash for bucketing only; equality always compares the planes."""
    return F.xxhash64(p.ints, p.roots)


def mod_all(p: Pattern) -> Pattern:
    """Flip the sqrt2 bit of every cell whose integer bit is set."""
    return Pattern(p.ints, p.roots.bitwiseXOR(p.ints))


def mod_rows(p: Pattern, row_bits: Column) -> Pattern:
    """``mod_all`` restricted to the rows whose bit is set in ``row_bits``.

    Multiplying row_bits (6 bits) by the first-row mask copies it to all columns.
    """
    rows = row_bits.cast("bigint").bitwiseAND(lit64(63)) * lit64(ROW_MASKS[0])
    return Pattern(p.ints, p.roots.bitwiseXOR(p.ints.bitwiseAND(rows)))


def mod_row(p: Pattern, row: Column) -> Pattern:
    return mod_rows(p, shl(lit64(1), row))


def permute_rows(p: Pattern, order: str) -> Pattern:
    """Row r of the result is row order[r]; ``order`` names an ARRAY<INT> column."""

    def moved(plane: Column) -> Column:
        out = None
        for r in range(6):
            term = shl(shru(plane, F.get(order, F.lit(r))).bitwiseAND(lit64(ROW_MASKS[0])), r)
            out = term if out is None else out.bitwiseOR(term)
        return out

    return Pattern(moved(p.ints), moved(p.roots))


def transpose(p: Pattern) -> Pattern:
    """Each cell (r, c) moves by 5*(r - c) bits, so whole diagonals move together."""

    def flipped(plane: Column) -> Column:
        out = plane.bitwiseAND(lit64(IDENTITY_PLANE))
        for d in range(1, 6):
            above = lit64(sum(1 << (6 * (i + d) + i) for i in range(6 - d)))
            below = lit64(sum(1 << (6 * i + i + d) for i in range(6 - d)))
            out = out.bitwiseOR(shru(plane.bitwiseAND(above), 5 * d))
            out = out.bitwiseOR(shl(plane.bitwiseAND(below), 5 * d))
        return out

    return Pattern(flipped(p.ints), flipped(p.roots))


def row_code(p: Pattern, row: int) -> Column:
    """(int bits, sqrt2 bits) of one row as one number."""
    line = lambda plane: shru(plane, row).bitwiseAND(lit64(ROW_MASKS[0]))
    return shl(line(p.ints), 31).bitwiseOR(line(p.roots))


def packed(p: Pattern) -> Column:
    """Both planes as one DECIMAL that orders as (int_plane, sqrt2_plane) does.

    A DECIMAL minimum is aggregated by hash; a minimum of structs would sort.
    """
    return p.ints.cast("decimal(38,0)") * F.lit(1 << 36) + p.roots


def unpacked(value: Column) -> Pattern:
    """Inverse of ``packed``."""
    ints = F.call_function("div", value, F.lit(1 << 36)).cast("bigint")
    return Pattern(ints, (value % F.lit(1 << 36)).cast("bigint"))


def _row_codes(p: Pattern) -> Column:
    """Per row, (int bits, sqrt2 bits) as one number, the lesser of the row and its mod.

    The cells of a row sit six bits apart in a plane; a shift and a mask bring any
    row to the place of row 0, whose mask is 31 bits wide.
    """
    line = lambda plane, r: shru(plane, r).bitwiseAND(lit64(ROW_MASKS[0]))
    codes = []
    for r in range(6):
        i, s = line(p.ints, r), line(p.roots, r)
        codes.append(shl(i, 31).bitwiseOR(F.least(s, s.bitwiseXOR(i))))
    return F.array(*codes)


def orbit_key(p: Pattern) -> Column:
    """Equal exactly for patterns that row orders and row mods carry into each other.

    Row orders and mods act on the rows independently, so sorting the per-row
    minima is canonical: matching whole orbits is an equi-join on this key and
    the up to 46,080 members never have to be produced.
    """
    return F.array_sort(_row_codes(p))


def orbit_size(p: Pattern, all_mods: bool = False) -> Column:
    """Number of distinct patterns in the orbit, from the key alone.

    With ``all_mods`` false the mods of the unpermuted pattern are left out unless
    another row order produces them too, which happens when two rows agree.
    """
    key = orbit_key(p)
    arrangements = F.aggregate(
        F.array_distinct(key),
        F.lit(720),
        lambda acc, code: F.call_function(
            "div", acc, F.factorial(F.size(F.filter(key, lambda c: c == code)))
        ).cast("int"),
    )
    live_rows = F.size(F.filter(key, lambda c: c >= 1 << 31))
    mods = F.call_function("shiftleft", F.lit(1), live_rows)
    all_members = arrangements * mods
    if all_mods:
        return all_members
    distinct_rows = F.size(F.array_distinct(key)) == 6
    return F.when(distinct_rows, all_members - mods + 1).otherwise(all_members)


def least_mods(p: Pattern) -> Pattern:
    """Every row replaced by the lesser of itself and its mod.

    A row's cells sit six bits apart in a plane, in column order, so masked planes
    compare like the rows themselves.
    """
    roots = None
    for mask in ROW_MASKS:
        row, flipped = p.roots.bitwiseAND(lit64(mask)), mod_all(p).roots.bitwiseAND(lit64(mask))
        least = F.least(row, flipped)
        roots = least if roots is None else roots.bitwiseOR(least)
    return Pattern(p.ints, roots)


def live_rows(p: Pattern) -> Column:
    """Six bits: which rows have an integer bit, i.e. are changed by their mod."""
    bits = F.lit(0)
    for r, mask in enumerate(ROW_MASKS):
        bits = bits.bitwiseOR(F.when(p.ints.bitwiseAND(lit64(mask)) != 0, 1 << r).otherwise(0))
    return bits


def text(p: Pattern) -> Column:
    """Six lines of ``int,sqrt2`` cells."""
    six = F.sequence(F.lit(0), F.lit(5))
    cell = lambda r, c: F.concat_ws(",", *[b.cast("string") for b in get_bits(p, r, c)])
    row = lambda r: F.array_join(F.transform(six, lambda c: cell(r, c)), " ")
    return F.array_join(F.transform(six, row), "\n")
