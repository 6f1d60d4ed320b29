"""Shifts and bit counts on BIGINT columns, with column or literal shift amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit64(v: int) -> Column:
    return F.lit(v).cast("bigint")


def as_int(n) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def shl(x: Column, n) -> Column:
    return F.call_function("shiftleft", x, as_int(n))


def shr(x: Column, n) -> Column:
    """Arithmetic shift: floor division by 2^n."""
    return F.call_function("shiftright", x, as_int(n))


def shru(x: Column, n) -> Column:
    """Logical shift."""
    return F.call_function("shiftrightunsigned", x, as_int(n))


def trailing_zeros(x: Column) -> Column:
    """Number of trailing zero bits of a BIGINT; 63 for zero."""
    return (F.bit_count(x.bitwiseXOR(x - lit64(1))) - 1).cast("int")


def power_of_two(n: Column) -> Column:
    """2^n as BIGINT; fails the query when it would not fit."""
    return F.when(n <= 62, shl(lit64(1), n)).otherwise(
        F.raise_error(F.lit("power of two does not fit in BIGINT")).cast("bigint")
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    For use inside lambdas, where Spark does not share common subexpressions.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def require(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; otherwise the query fails with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def fence(value: Column) -> Column:
    """The same value out of an explode of one element, for one column of a select.

    Catalyst never copies a generator's expression into what stands above it, yet pushes
    filters on other columns below it, so key filters still reach the scan.
    """
    return F.explode(F.array(value))


def pin(value: Column) -> Column:
    """The same value, marked so that Catalyst computes it exactly where it is written.

    Filters and semi joins on a derived column are otherwise pushed below the
    projection that derives it, which copies its expression once per use and
    multiplies through a chain of large expressions. Reading the value out of an
    array at (partition id * 0) makes it non-deterministic in the optimizer's eyes.
    """
    return F.get(F.array(value), F.spark_partition_id() * 0)
