"""72-bit words as two 36-bit BIGINT limbs, and the text forms of such words.

Two limbs of 36 bits keep clear of the sign bit, so carries and shifts are plain
BIGINT arithmetic. A word also reads as 36 bit *pairs*: pair i is bits 2i and
2i+1, the odd bits forming the integer plane and the even bits the sqrt2 plane.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringweave.functions.bits import lit64, require, shl as shift_left, shru

LIMB_BITS = 36
LIMB = (1 << LIMB_BITS) - 1

# Spreading 18 bits to the even positions of a limb, one halving per step:
# (shift, mask after the shift). Derived from the step size alone.
_SPREAD = [
    (s, sum(((1 << s) - 1) << p for p in range(0, LIMB_BITS, 2 * s)) & LIMB)
    for s in (16, 8, 4, 2, 1)
]
_EVEN = _SPREAD[-1][1]


class Word72(NamedTuple):
    hi: Column
    lo: Column

    @staticmethod
    def field(name: str) -> "Word72":
        return Word72(F.col(name)["hi"], F.col(name)["lo"])

    def struct(self) -> Column:
        return F.struct(self.hi.alias("hi"), self.lo.alias("lo"))


def word(hi: Column, lo: Column) -> Word72:
    """From two 36-bit limbs; higher bits are dropped."""
    return Word72(_limb(hi.cast("bigint")), _limb(lo.cast("bigint")))


def from_64_8(low: Column, high: Column) -> Word72:
    """From the low 64 bits (as BIGINT) and the high 8 bits."""
    high = high.cast("bigint").bitwiseAND(lit64(0xFF))
    return Word72(
        shru(low, LIMB_BITS).bitwiseOR(shift_left(high, 64 - LIMB_BITS)), _limb(low)
    )


def to_64_8(w: Word72) -> tuple[Column, Column]:
    """Low 64 bits as (signed) BIGINT and high 8 bits."""
    return shift_left(w.hi, LIMB_BITS).bitwiseOR(w.lo), shru(w.hi, 64 - LIMB_BITS)


def _limb(x: Column) -> Column:
    return x.bitwiseAND(lit64(LIMB))


def _position(pos) -> Column:
    return pos if isinstance(pos, Column) else F.lit(pos)


def bit_and(x: Word72, y: Word72) -> Word72:
    return Word72(x.hi.bitwiseAND(y.hi), x.lo.bitwiseAND(y.lo))


def bit_or(x: Word72, y: Word72) -> Word72:
    return Word72(x.hi.bitwiseOR(y.hi), x.lo.bitwiseOR(y.lo))


def bit_not(x: Word72) -> Word72:
    return Word72(_limb(F.bitwise_not(x.hi)), _limb(F.bitwise_not(x.lo)))


def equals(x: Word72, y: Word72) -> Column:
    return (x.hi == y.hi) & (x.lo == y.lo)


def popcount(x: Word72) -> Column:
    return (F.bit_count(x.hi) + F.bit_count(x.lo)).cast("int")


def shl(x: Word72, n) -> Word72:
    """x * 2^n mod 2^72 for any n >= 0."""
    n = _position(n)
    near, far = n < LIMB_BITS, n < 2 * LIMB_BITS
    return Word72(
        F.when(near, _limb(shift_left(x.hi, n)).bitwiseOR(shru(x.lo, F.lit(LIMB_BITS) - n)))
        .when(far, _limb(shift_left(x.lo, n - LIMB_BITS)))
        .otherwise(lit64(0)),
        F.when(near, _limb(shift_left(x.lo, n))).otherwise(lit64(0)),
    )


def shr(x: Word72, n) -> Word72:
    """x / 2^n rounded down, for any n >= 0."""
    n = _position(n)
    near, far = n < LIMB_BITS, n < 2 * LIMB_BITS
    return Word72(
        F.when(near, shru(x.hi, n)).otherwise(lit64(0)),
        F.when(near, shru(x.lo, n).bitwiseOR(_limb(shift_left(x.hi, F.lit(LIMB_BITS) - n))))
        .when(far, shru(x.hi, n - LIMB_BITS))
        .otherwise(lit64(0)),
    )


def add(x: Word72, y: Word72) -> Word72:
    """Sum mod 2^72."""
    low = x.lo + y.lo
    return Word72(_limb(x.hi + y.hi + shru(low, LIMB_BITS)), _limb(low))


def sub(x: Word72, y: Word72) -> Word72:
    """Difference mod 2^72."""
    borrow = F.when(x.lo < y.lo, 1).otherwise(0)
    return Word72(_limb(x.hi - y.hi - borrow), _limb(x.lo - y.lo))


def window(x: Word72, pos, width: int) -> Column:
    """``width`` (at most 36) bits from position ``pos`` up, as BIGINT."""
    return shr(x, pos).lo.bitwiseAND(lit64((1 << width) - 1))


def get_bit(x: Word72, pos) -> Column:
    return window(x, pos, 1)


def get_pair(x: Word72, pos) -> Column:
    """Bits pos and pos+1 as a value 0..3, at any position."""
    return window(x, pos, 2)


def get_bits16(x: Word72, pos) -> Column:
    return window(x, pos, 16)


def _put(x: Word72, pos, value: Column, width: int) -> Word72:
    mask = shl(Word72(lit64(0), lit64((1 << width) - 1)), pos)
    bits = shl(Word72(lit64(0), value.cast("bigint").bitwiseAND(lit64((1 << width) - 1))), pos)
    return bit_or(bit_and(x, bit_not(mask)), bits)


def set_bit(x: Word72, pos, value: Column) -> Word72:
    return _put(x, pos, value, 1)


def set_pair(x: Word72, pos, value: Column) -> Word72:
    return _put(x, pos, value, 2)


def _gather_even(x: Column) -> Column:
    """The 18 bits at even positions of a limb, packed together."""
    x = x.bitwiseAND(lit64(_EVEN))
    for (s, _), (_, mask) in zip(reversed(_SPREAD), reversed([(0, (1 << 18) - 1)] + _SPREAD[:-1])):
        x = x.bitwiseOR(shru(x, s)).bitwiseAND(lit64(mask))
    return x


def _spread_even(x: Column) -> Column:
    for s, mask in _SPREAD:
        x = x.bitwiseOR(shift_left(x, s)).bitwiseAND(lit64(mask))
    return x


def to_planes(w: Word72) -> tuple[Column, Column]:
    """(integer plane, sqrt2 plane), bit i of each taken from pair i."""
    odd = lambda x: _gather_even(shru(x, 1))
    join = lambda f: f(w.lo).bitwiseOR(shift_left(f(w.hi), 18))
    return join(odd), join(_gather_even)


def from_planes(int_plane: Column, sqrt2_plane: Column) -> Word72:
    half = lambda x: x.bitwiseAND(lit64((1 << 18) - 1))
    pack = lambda i, s: shift_left(_spread_even(i), 1).bitwiseOR(_spread_even(s))
    return Word72(
        pack(shru(int_plane, 18), shru(sqrt2_plane, 18)), pack(half(int_plane), half(sqrt2_plane))
    )


def binary_text(w: Word72) -> Column:
    """72 binary digits, highest bit first."""
    digits = lambda x: F.lpad(F.bin(x), LIMB_BITS, "0")
    return F.concat(digits(w.hi), digits(w.lo))


def pattern_text(w: Word72) -> Column:
    """72 characters, pair 0 first, each pair as integer bit then sqrt2 bit."""
    return F.regexp_replace(F.reverse(binary_text(w)), "(.)(.)", "$2$1")


def parse_pattern_text(text: Column, strict: bool = True) -> Word72:
    """Inverse of ``pattern_text``. Any character other than 1 counts as 0.

    A text that is not 72 characters long fails the query, or gives null limbs
    when ``strict`` is false.
    """
    whole = F.length(text) == 2 * LIMB_BITS
    checked = (
        require(whole, text, "a pattern line needs exactly 72 characters")
        if strict
        else F.when(whole, text)
    )
    bits = F.reverse(F.regexp_replace(F.regexp_replace(checked, "[^1]", "0"), "(.)(.)", "$2$1"))
    limb = lambda start: F.conv(F.substring(bits, start, LIMB_BITS), 2, 10).cast("bigint")
    return Word72(limb(1), limb(LIMB_BITS + 1))


def csv_to_pattern_text(line: Column, strict: bool = True) -> Column:
    """36 comma-separated values 0..3 to the 72-character form (two digits each)."""
    values = F.transform(F.split(line, ","), lambda v: F.trim(v))
    digit = lambda v: F.coalesce(v.isin("0", "1", "2", "3"), F.lit(False))
    whole = F.coalesce((F.size(values) == LIMB_BITS) & F.forall(values, digit), F.lit(False))
    pairs = F.transform(values, lambda v: F.lpad(F.bin(F.try_to_number(v, F.lit("9"))), 2, "0"))
    text = F.array_join(pairs, "")
    if strict:
        return require(whole, text, "a CSV pattern line needs exactly 36 values from 0 to 3")
    return F.when(whole, text)
