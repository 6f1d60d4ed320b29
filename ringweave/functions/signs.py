"""Sign masks: six two-bit codes in one INT, and the signed order of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringweave.functions.bits import let

# The four codes of a position.
UNSET, POSITIVE, NEGATIVE, CONFLICT = 0b00, 0b01, 0b10, 0b11
ALL_POSITIVE = sum(POSITIVE << (2 * i) for i in range(6))


def mask_at(mask: Column, index) -> Column:
    index = index if isinstance(index, Column) else F.lit(index)
    return F.call_function("shiftright", mask, index * 2).bitwiseAND(F.lit(3)).cast("int")


def set_sign(mask: Column, index, code) -> Column:
    index = index if isinstance(index, Column) else F.lit(index)
    code = code if isinstance(code, Column) else F.lit(code)
    hole = F.bitwise_not(F.call_function("shiftleft", F.lit(3), index * 2))
    return mask.bitwiseAND(hole).bitwiseOR(
        F.call_function("shiftleft", code.cast("int"), index * 2)
    )


def reverse(mask: Column) -> Column:
    """Every code complemented: positive and negative trade places, unset becomes conflict."""
    return mask.bitwiseXOR(F.lit((1 << 12) - 1))


def text(mask: Column) -> Column:
    """One character per position: + - ¿ (conflict) ? (unset)."""
    symbol = lambda code: (
        F.when(code == POSITIVE, "+").when(code == NEGATIVE, "-").when(code == CONFLICT, "¿").otherwise("?")
    )
    return F.concat(*[symbol(mask_at(mask, i)) for i in range(6)])


def factors(mask: Column) -> Column:
    """ARRAY<INT> of +1/-1: negative and conflict positions give -1."""
    return F.array(*[F.when(mask_at(mask, i) >= NEGATIVE, -1).otherwise(1) for i in range(6)])


def row_choices() -> Column:
    """ARRAY of the 32 masks that keep row 0 positive, for exploding."""

    def mask(n: Column) -> Column:
        out = F.lit(POSITIVE)
        for i in range(1, 6):
            negative = F.call_function("shiftright", n, F.lit(i - 1)).bitwiseAND(F.lit(1)) == 1
            out = out.bitwiseOR(
                F.when(negative, F.lit(NEGATIVE << (2 * i))).otherwise(F.lit(POSITIVE << (2 * i)))
            )
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(31)), mask)


def line_order_key(cells: Column, signs: Column) -> Column:
    """Sort key of a line of (a, b, e) structs under row signs (ARRAY<INT>).

    The line is multiplied by the signs, then flipped as a whole so that its first
    nonzero cell is positive. Lines sort by descending cells with zeros last, so
    the key negates the cells and leads with a zero flag; plain array comparison
    of keys is the order.
    """
    times = lambda c, s: F.struct((c["a"] * s).alias("a"), (c["b"] * s).alias("b"), c["e"].alias("e"))
    lead = lambda line: F.coalesce(
        F.signum(F.get(F.filter(line, lambda c: c["a"] != 0), F.lit(0))["a"]), F.lit(1.0)
    ).cast("int")
    ordered = lambda c, flip: F.struct(
        (c["a"] == 0).cast("int").alias("z"),
        (-c["a"] * flip).alias("a"),
        (-c["b"] * flip).alias("b"),
        (-c["e"]).alias("e"),
    )
    return let(
        F.zip_with(cells, signs, times),
        lambda line: let(lead(line), lambda flip: F.transform(line, lambda c: ordered(c, flip))),
    )


#: Pairs (row, column) in the order in which their signs are joined.
_CELLS = [(r, c) for r in range(6) for c in range(6)]


def propagated(cells: Column) -> Column:
    """STRUCT<row_mask, col_mask, conflicts>: signs of rows and columns under which all entries are positive.

    ``cells``: 36 signs (-1, 0, 1), row by row. Rows and columns are the nodes of a graph, nonzero
    entries its edges: a positive one wants equal signs, a negative one unequal. A union-find with
    parities takes the 36 edges once each, so it always ends: every node has the number of its part
    (the least node in it, rows before columns) and a sign relative to it. An edge inside a part
    that its parities contradict is a conflict and changes nothing. The least row of a part is
    positive; columns without an entry stay unset. Conflicts are counted, and both lines of a
    conflicting entry are marked so, as a mask's code.
    """
    nodes = F.sequence(F.lit(0), F.lit(11))
    start = F.struct(
        nodes.alias("part"), F.array_repeat(F.lit(1), 12).alias("sign"), F.array().cast("array<int>").alias("bad")
    )

    def join(s: Column, i: Column) -> Column:
        row, col = F.call_function("div", i, F.lit(6)).cast("int"), (i % 6 + 6).cast("int")
        want = F.get(cells, i).cast("int")
        a, b = F.get(s["part"], row), F.get(s["part"], col)
        now = F.get(s["sign"], row) * F.get(s["sign"], col)
        low, high = F.least(a, b), F.greatest(a, b)
        turn = now * want  # -1: the part that is joined is turned round
        joined = F.struct(
            F.transform(s["part"], lambda p: F.when(p == high, low).otherwise(p)).alias("part"),
            F.zip_with(s["sign"], s["part"], lambda x, p: F.when(p == high, x * turn).otherwise(x)).alias("sign"),
            s["bad"].alias("bad"),
        )
        clash = F.struct(s["part"].alias("part"), s["sign"].alias("sign"), F.concat(s["bad"], F.array(i)).alias("bad"))
        return F.when(want == 0, s).when(a != b, joined).when(turn < 0, clash).otherwise(s)

    def masks(s: Column) -> Column:
        def of(first: int) -> Column:
            out = F.lit(0)
            for k in range(6):
                node = first + k
                hit = F.exists(s["bad"], lambda i: (F.call_function("div", i, F.lit(6)) if first == 0 else i % 6) == k)
                alone = (F.get(s["part"], F.lit(node)) == node) & F.lit(first == 6)
                sign = F.when(F.get(s["sign"], F.lit(node)) > 0, POSITIVE).otherwise(NEGATIVE)
                code = F.when(hit, CONFLICT).when(alone, UNSET).otherwise(sign)
                out = out.bitwiseOR(F.call_function("shiftleft", code, F.lit(2 * k)))
            return out

        return F.struct(of(0).alias("row_mask"), of(6).alias("col_mask"), F.size(s["bad"]).alias("conflicts"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(_CELLS) - 1)), start, join)
    return let(found, masks)
