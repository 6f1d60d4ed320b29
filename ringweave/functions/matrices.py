"""6x6 ring matrices as packed BIGINT lanes.

A matrix is ``struct(a ARRAY<BIGINT>, b ARRAY<BIGINT>, k INT)``: every entry is
(A + B*sqrt2)/sqrt2^k over one common exponent. A row of A (or B) is stored as
sum of entry*2^(width*lane), several columns per BIGINT. That packing is linear,
so adding, subtracting and doubling *rows* is one BIGINT operation per word, and
a gate costs a dozen of them. The matrix is reduced when the numerators have no
common factor sqrt2; then k is its least denominator exponent.

Entries and their conjugates lie in [-1, 1], so |A|, |B| <= 2^(k/2). A layout with
``width`` bits per lane is therefore exact up to k = 2*width - 3, and anything
beyond fails the query rather than wrapping.

The functions take column names (or any SQL expression text) and return Columns.
Expressions over 36 entries are long, and one SQL text reaches the JVM in one call
where the same tree built from Column calls would take thousands. Names starting
with ``rw_`` are the lambda variables of these texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringweave.functions import ring
from ringweave.functions.bits import let
from ringweave.functions.gates import FIRST_ROWS, SECOND_ROWS


@dataclass(frozen=True)
class Lanes:
    """How many columns share a BIGINT: 6 (k <= 17), 3 (k <= 37) or 1 (k <= 121)."""

    columns: int = 6

    @property
    def width(self) -> int:
        return {6: 10, 3: 20, 1: 62}[self.columns]

    @property
    def words(self) -> int:
        """BIGINTs per row."""
        return 6 // self.columns

    @property
    def size(self) -> int:
        return 6 * self.words

    @property
    def max_k(self) -> int:
        return 2 * self.width - 3

    @property
    def mask(self) -> int:
        return (1 << self.width) - 1

    def spread(self, v: int) -> int:
        """v in every lane."""
        return sum(v << (self.width * i) for i in range(self.columns))

    @property
    def bias(self) -> int:
        """Added to a word, makes every lane non-negative and keeps parities."""
        return self.spread(1 << (self.width - 1))


NARROW, MEDIUM, WIDE = Lanes(6), Lanes(3), Lanes(1)


def lanes_for(max_gates: int) -> Lanes:
    """Smallest layout that is exact for words of up to ``max_gates`` gates."""
    return next(lanes for lanes in (NARROW, MEDIUM, WIDE) if max_gates <= lanes.max_k)


def _let(name: str, value: str, body: str) -> str:
    """Evaluate a value once per row and bind it to a name inside the body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _require(condition: str, value: str, message: str) -> str:
    return f"if({condition}, {value}, raise_error('{message}'))"


def _struct(a: list[str], b: list[str], k: str) -> str:
    return f"named_struct('a', array({', '.join(a)}), 'b', array({', '.join(b)}), 'k', int({k}))"


def _at(words: str, i: int | str) -> str:
    return f"get({words}, {i})"


def _identity(lanes: Lanes) -> str:
    def word(row: int, w: int) -> str:
        lane = row - w * lanes.columns
        return f"{1 << (lanes.width * lane) if 0 <= lane < lanes.columns else 0}L"

    a = [word(r, w) for r in range(6) for w in range(lanes.words)]
    return _struct(a, ["0L"] * lanes.size, "0")


def _zero(lanes: Lanes) -> str:
    return _struct(["0L"] * lanes.size, ["0L"] * lanes.size, "0")


def _mix_rows(m: str, gate: str, k: str, lanes: Lanes) -> str:
    """One gate over the next exponent, not reduced.

    The gate's rows become their sum and (second - first); over the larger
    exponent every other row is multiplied by sqrt2, i.e. (A, B) -> (2B, A).
    """
    w = lanes.words
    table = lambda rows: f"get(array({', '.join(map(str, rows))}), int({gate}))"

    def mixed(own: str, other: str) -> list[str]:
        out = []
        for i in range(lanes.size):
            row = i // w
            partner = lambda r: _at(own, r if w == 1 else f"{r} * {w} + {i % w}")
            out.append(
                f"CASE WHEN rw_p.r1 = {row} THEN {_at(own, i)} + {partner('rw_p.r2')}"
                f" WHEN rw_p.r2 = {row} THEN {_at(own, i)} - {partner('rw_p.r1')}"
                f" ELSE {other.format(i)} END"
            )
        return out

    body = _struct(
        mixed(f"{m}.a", f"2 * get({m}.b, {{}})"), mixed(f"{m}.b", f"get({m}.a, {{}})"), k
    )
    pair = f"named_struct('r1', {table(FIRST_ROWS)}, 'r2', {table(SECOND_ROWS)})"
    return _let("rw_p", pair, body)


def _lowest_bits(words: str, lanes: Lanes) -> str:
    """Smallest number of trailing zero bits over all lanes of all words."""
    merged = " | ".join(f"({_at(words, i)} + {lanes.bias}L)" for i in range(lanes.size))
    folded = " | ".join(
        f"(shiftrightunsigned(rw_o, {lanes.width * j}) & {lanes.mask}L)"
        for j in range(lanes.columns)
    )
    zeros = _let("rw_d", folded, "bit_count(rw_d ^ (rw_d - 1L)) - 1")
    return _let("rw_o", merged, zeros)


def _reduce(m: str, lanes: Lanes) -> str:
    """Divide out the common power of sqrt2 of a nonzero matrix, in one step.

    An even power halves both parts; an odd one also swaps them.
    """
    valuation = (
        f"least({_lowest_bits(f'{m}.a', lanes)} * 2, {_lowest_bits(f'{m}.b', lanes)} * 2 + 1)"
    )
    shifted = lambda part, i, n: f"shiftright({_at(f'{m}.{part}', i)}, {n})"
    half = "shiftright(rw_v, 1)"
    even = _struct(
        [shifted("a", i, half) for i in range(lanes.size)],
        [shifted("b", i, half) for i in range(lanes.size)],
        f"{m}.k - rw_v",
    )
    odd = _struct(
        [shifted("b", i, half) for i in range(lanes.size)],
        [shifted("a", i, f"{half} + 1") for i in range(lanes.size)],
        f"{m}.k - rw_v",
    )
    body = f"CASE WHEN rw_v = 0 THEN {m} WHEN rw_v % 2 = 0 THEN {even} ELSE {odd} END"
    return _let("rw_v", valuation, body)


def _reduce_after_gate(m: str, lanes: Lanes) -> str:
    """``_reduce`` for a reduced matrix times one gate, given over the next exponent.

    A gate changes the least exponent by at most one, so at most two factors come
    out, and parities alone tell how many.
    """
    words = range(lanes.size)
    odd = lambda p: (
        "(" + " | ".join(f"({_at(f'{m}.{p}', i)} + {lanes.bias}L)" for i in words)
        + f") & {lanes.spread(1)}L <> 0L"
    )
    plain = lambda p: [_at(f"{m}.{p}", i) for i in words]
    halved = lambda p: [f"shiftright({_at(f'{m}.{p}', i)}, 1)" for i in words]
    once = _struct(plain("b"), halved("a"), f"{m}.k - 1")
    twice = _struct(halved("a"), halved("b"), f"{m}.k - 2")
    return f"CASE WHEN {odd('a')} THEN {m} WHEN {odd('b')} THEN {once} ELSE {twice} END"


def _digit(words: str, row: int, col: int, lanes: Lanes) -> str:
    w, lane = divmod(col, lanes.columns)
    biased = f"{_at(words, row * lanes.words + w)} + {lanes.bias}L"
    digit = f"shiftrightunsigned({biased}, {lanes.width * lane}) & {lanes.mask}L"
    return f"(({digit}) - {1 << (lanes.width - 1)}L)"


def _pack(digits, lanes: Lanes) -> list[str]:
    """Words from a function (row, col) -> SQL text of a BIGINT."""
    return [
        " + ".join(
            f"shiftleft({digits(r, w * lanes.columns + i)}, {lanes.width * i})"
            for i in range(lanes.columns)
        )
        for r in range(6)
        for w in range(lanes.words)
    ]


def _from_digits(digits_a, digits_b, k: str, lanes: Lanes) -> str:
    return _struct(_pack(digits_a, lanes), _pack(digits_b, lanes), k)


def identity(lanes: Lanes = NARROW) -> Column:
    return F.expr(_identity(lanes))


def zero(lanes: Lanes = NARROW) -> Column:
    return F.expr(_zero(lanes))


def apply_gate(m: str, gate: str, lanes: Lanes = NARROW) -> Column:
    """Left-multiply a reduced matrix by one gate; the result is reduced again."""
    k = _require(f"{m}.k < {lanes.max_k}", f"{m}.k + 1", "matrix exponent too large for its lanes")
    known = _require(f"{gate} BETWEEN 0 AND 14", gate, "gate number outside 0..14")
    return F.expr(_let("rw_m", _mix_rows(m, known, k, lanes), _reduce_after_gate("rw_m", lanes)))


def apply_word(gates: str, start: str | None = None, lanes: Lanes = NARROW) -> Column:
    """Left-multiply ``start`` (default identity) by a word, first gate first; reduced.

    The fold itself is linear and never divides; the common factor comes out once.
    """
    start_k = f"{start}.k" if start else "0"
    fits = _require(
        f"size({gates}) + {start_k} <= {lanes.max_k}", gates, "word too long for its lanes"
    )
    known = _require(
        f"forall({gates}, rw_g -> rw_g BETWEEN 0 AND 14)", fits, "gate number outside 0..14"
    )
    step = _mix_rows("rw_m", "rw_g", "rw_m.k + 1", lanes)
    return F.expr(
        f"aggregate({known}, {start or _identity(lanes)}, "
        f"(rw_m, rw_g) -> {step}, rw_m -> {_reduce('rw_m', lanes)})"
    )


def digits(m: str, row: int, col: int, lanes: Lanes = NARROW) -> tuple[Column, Column]:
    """Numerator parts of entry (row, col) over the matrix's exponent."""
    return tuple(F.expr(_digit(f"{m}.{part}", row, col, lanes)) for part in "ab")


def entry(m: str, row: int, col: int, lanes: Lanes = NARROW) -> ring.Element:
    """Entry (row, col) in lowest terms."""
    return ring.reduce(ring.Element(*digits(m, row, col, lanes), F.expr(f"{m}.k")))


def entries(m: str, lanes: Lanes = NARROW) -> Column:
    """ARRAY<STRUCT<row, col, a, b, e>> of all 36 entries in lowest terms, column by column."""
    raw = ", ".join(
        f"named_struct('row', {r}, 'col', {c}, 'a', {_digit(f'{m}.a', r, c, lanes)}, "
        f"'b', {_digit(f'{m}.b', r, c, lanes)}, 'e', {m}.k)"
        for c in range(6)
        for r in range(6)
    )

    def lowest_terms(cell: Column) -> Column:
        reduced = ring.reduce(ring.Element(cell["a"], cell["b"], cell["e"]))
        return F.struct(
            cell["row"].alias("row"),
            cell["col"].alias("col"),
            *[v.alias(n) for n, v in zip("abe", reduced)],
        )

    return F.transform(F.expr(f"array({raw})"), lowest_terms)


def transpose(m: str, lanes: Lanes = NARROW) -> Column:
    part = lambda p: lambda r, c: _digit(f"{m}.{p}", c, r, lanes)
    return F.expr(_from_digits(part("a"), part("b"), f"{m}.k", lanes))


def permute_rows(m: str, rows: str, lanes: Lanes = NARROW) -> Column:
    """Row r of the result is row rows[r]; ``rows`` is an ARRAY<INT>."""
    w = lanes.words
    take = lambda p: [
        _at(f"{m}.{p}", f"get({rows}, {i // w}) * {w} + {i % w}") for i in range(lanes.size)
    ]
    return F.expr(_struct(take("a"), take("b"), f"{m}.k"))


def permute_columns(m: str, cols: str, lanes: Lanes = NARROW) -> Column:
    """Column c of the result is column cols[c]."""

    def take(p: str):
        line = lambda r: f"array({', '.join(_digit(f'{m}.{p}', r, j, lanes) for j in range(6))})"
        return lambda r, c: f"get({line(r)}, get({cols}, {c}))"

    return F.expr(_from_digits(take("a"), take("b"), f"{m}.k", lanes))


def apply_signs(m: str, row_signs: str, col_signs: str, lanes: Lanes = NARROW) -> Column:
    """Multiply rows and columns by +1/-1, given as ARRAY<INT>."""
    part = lambda p: (
        lambda r, c: f"{_digit(f'{m}.{p}', r, c, lanes)} * get({row_signs}, {r}) * get({col_signs}, {c})"
    )
    return F.expr(_from_digits(part("a"), part("b"), f"{m}.k", lanes))


def negate_row(m: str, row: str, lanes: Lanes = NARROW) -> Column:
    w = lanes.words
    flip = lambda p: [
        f"if({row} = {i // w}, -{_at(f'{m}.{p}', i)}, {_at(f'{m}.{p}', i)})"
        for i in range(lanes.size)
    ]
    return F.expr(_struct(flip("a"), flip("b"), f"{m}.k"))


def product(left: str, right: str, lanes: Lanes = NARROW) -> Column:
    """left * right, reduced. Scalars of the left times packed rows of the right."""
    a, b = [], []
    for r in range(6):
        scalars = [
            (_digit(f"{left}.a", r, j, lanes), _digit(f"{left}.b", r, j, lanes)) for j in range(6)
        ]
        for i in range(lanes.words):
            row = lambda p, j: _at(f"{right}.{p}", j * lanes.words + i)
            a.append(
                " + ".join(
                    f"{x} * {row('a', j)} + 2 * {y} * {row('b', j)}"
                    for j, (x, y) in enumerate(scalars)
                )
            )
            b.append(
                " + ".join(
                    f"{x} * {row('b', j)} + {y} * {row('a', j)}" for j, (x, y) in enumerate(scalars)
                )
            )
    k = f"{left}.k + {right}.k"
    checked = _require(f"{k} <= {lanes.max_k}", k, "matrix exponent too large for its lanes")
    return F.expr(_let("rw_m", _struct(a, b, checked), _reduce("rw_m", lanes)))


def least_exponent(m: str) -> Column:
    """Least denominator exponent of a reduced matrix."""
    return F.expr(f"{m}.k")


def _parities(words: str, lanes: Lanes) -> str:
    """36-bit plane of entry parities, bit 6*col+row."""
    out = []
    for w in range(lanes.words):
        stacked = " | ".join(
            f"shiftleft(({_at(words, r * lanes.words + w)} + {lanes.bias}L) & {lanes.spread(1)}L, {r})"
            for r in range(6)
        )
        gathered = " | ".join(
            f"shiftleft(shiftrightunsigned(rw_s, {lanes.width * j}) & 63L, {6 * (w * lanes.columns + j)})"
            for j in range(lanes.columns)
        )
        out.append(_let("rw_s", stacked, gathered))
    return " | ".join(out)


def int_plane(m: str, lanes: Lanes = NARROW) -> Column:
    """Integer residues of a reduced matrix: the entries at the largest exponent."""
    return F.expr(_parities(f"{m}.a", lanes))


def sqrt2_plane(m: str, lanes: Lanes = NARROW) -> Column:
    """sqrt2 residues of a reduced matrix."""
    return F.expr(_parities(f"{m}.b", lanes))


def from_planes(ints: str, roots: str, lanes: Lanes = NARROW) -> Column:
    """Matrix with the given residues: (0,1) -> 1, (1,x) -> (1 + x*sqrt2)/sqrt2."""
    bit = lambda plane: lambda r, c: f"(shiftrightunsigned({plane}, {6 * c + r}) & 1L)"
    raw = _from_digits(bit(ints), bit(roots), "1", lanes)
    return F.expr(
        f"if(({ints} | {roots}) = 0, {_zero(lanes)}, {_let('rw_m', raw, _reduce('rw_m', lanes))})"
    )


def text(m: str, lanes: Lanes = NARROW, columns: str | None = None) -> Column:
    """Six lines, entries in ``a,bee`` form separated by blanks.

    ``columns``: an ARRAY<INT> of the columns to show, in that order; all of them by default.
    Numbers that are no column show nothing.
    """
    cells = F.transform(
        entries(m, lanes), lambda x: F.format_string("%d,%de%d", x["a"], x["b"], x["e"])
    )
    shown = F.expr(columns) if columns else F.sequence(F.lit(0), F.lit(5))
    good = F.filter(shown, lambda c: (c >= 0) & (c < 6))
    row = lambda cells, r: F.array_join(F.transform(good, lambda c: F.get(cells, c * 6 + r)), " ")
    return let(cells, lambda all_cells: F.array_join(F.array(*[row(all_cells, r) for r in range(6)]), "\n"))
