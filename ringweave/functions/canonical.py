"""Canonical keys of matrices under signed row and column permutations.

Two matrices get the same key exactly when one is the other with rows and columns
reordered and negated. The key spells out the whole canonical matrix (exponent,
value table, columns), so key equality is an exact test, never a hash.

``canonical_key`` is an Arrow-batched function. Per batch of matrices:

* entries become signed ranks of their absolute value within the matrix, an
  odd, order-free code;
* rows and columns are coloured by sorted ranks, then each by the other's
  colours, until only truly similar rows share a colour;
* for every row order that respects the colours and every choice of row signs,
  each column is one integer (base-128 digits). Its absolute value is the column
  with its sign normalised, sorting the six values normalises column order, and
  the least such list wins.

The candidates come from one small matrix product per group of matrices with the
same colour sizes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ringweave.functions.bits import shl
from ringweave.functions.matrices import NARROW, Lanes, digits

_BASE = 128
_PLACES = float(_BASE) ** np.arange(5, -1, -1)
# Row signs with the first row kept positive; the global sign is a column sign.
_SIGNS = np.array([(1,) + s for s in product((1, -1), repeat=5)], dtype=np.float64)
# Compare-and-swap network that sorts six values.
_NETWORK = [(0, 5), (1, 3), (2, 4), (1, 2), (3, 4), (0, 3), (2, 5), (0, 1), (2, 3), (4, 5), (1, 2), (3, 4)]
_CHUNK = 1 << 22


def _unpack(words: np.ndarray, lanes: Lanes) -> np.ndarray:
    """(n, words) packed lanes to (n, 6, 6) numerators."""
    shifts = lanes.width * np.arange(lanes.columns, dtype=np.int64)
    biased = (words + lanes.bias)[:, :, None] >> shifts
    digits = (biased & ((1 << lanes.width) - 1)) - (1 << (lanes.width - 1))
    return digits.reshape(len(words), 6, 6)


def _dense_rank(values: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct values of its line (last axis), from 0."""
    order = np.argsort(values, axis=-1, kind="stable")
    ordered = np.take_along_axis(values, order, -1)
    steps = np.zeros(values.shape, dtype=np.int64)
    steps[..., 1:] = np.cumsum(ordered[..., 1:] != ordered[..., :-1], axis=-1)
    ranks = np.empty_like(steps)
    np.put_along_axis(ranks, order, steps, -1)
    return ranks


def _recolour(labels: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """New colours of lines from old ones, their entries and the crossing lines' colours.

    labels: (n, line, crossing) with values up to 36. Packs into one integer
    exactly: six entries of 9 bits and an old colour of 3.
    """
    marked = np.sort(labels * 8 + other[:, None, :], axis=-1)
    packed = own.copy()
    for i in range(6):
        packed = packed * 512 + marked[..., i]
    return _dense_rank(packed)


def _row_colours(ranks: np.ndarray, rounds: int = 3) -> np.ndarray:
    flipped = ranks.transpose(0, 2, 1)
    rows = cols = np.zeros(ranks.shape[:2], dtype=np.int64)
    for _ in range(rounds):
        rows, cols = _recolour(ranks, rows, cols), _recolour(flipped, cols, rows)
    return rows


@lru_cache(maxsize=None)
def _candidate_weights(breaks: int) -> np.ndarray:
    """(candidates, 6) signed place values for colour-sorted rows.

    Bit i of ``breaks`` says that row i+1 starts a new colour.
    """
    groups, start = [], 0
    for i in range(6):
        if i == 5 or breaks >> i & 1:
            groups.append(range(start, i + 1))
            start = i + 1
    orders = [sum(p, ()) for p in product(*(tuple(permutations(g)) for g in groups))]
    signed = _SIGNS * _PLACES
    weights = np.empty((len(orders), len(signed), 6))
    for i, order in enumerate(orders):
        weights[i][:, list(order)] = signed
    return weights.reshape(-1, 6)


def _least_columns(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(n, 6 rows, 6 cols) signed codes to the (n, 6) least list of column values."""
    # Exact in float64: every value is below 128^6 = 2^42.
    values = np.abs(np.matmul(weights, codes))  # n, candidates, cols
    cols = [values[..., c] for c in range(6)]
    for i, j in _NETWORK:
        cols[i], cols[j] = np.minimum(cols[i], cols[j]), np.maximum(cols[i], cols[j])
    out = np.empty((len(codes), 6), dtype=np.int64)
    alive = np.ones(cols[0].shape, dtype=bool)
    for c in range(6):
        masked = np.where(alive, cols[c], np.inf)
        least = masked.min(axis=1)
        out[:, c] = least
        alive &= masked == least[:, None]
    return out


def canonical_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical columns (n, 6), sorted absolute values (n, 36) and first-of-value marks.

    a, b: (n, 6, 6) numerators of reduced matrices, absolute value below 2^31.
    """
    n = len(a)
    value = a * (1 << 32) + b  # odd in (a, b); its sign is that of the first nonzero part
    magnitude = np.abs(value).reshape(n, 36)
    ranks = _dense_rank(magnitude)
    # Rank 0 is kept for zero.
    ranks += (magnitude.min(axis=1) > 0)[:, None]
    ranks = ranks.reshape(n, 6, 6)
    table = np.sort(magnitude, axis=1)
    first = np.ones(table.shape, dtype=bool)
    first[:, 1:] = table[:, 1:] != table[:, :-1]

    colours = _row_colours(ranks)
    order = np.argsort(colours, axis=1, kind="stable")
    colours = np.take_along_axis(colours, order, 1)
    codes = np.take_along_axis((ranks * np.sign(value)).astype(np.float64), order[:, :, None], 1)
    breaks = ((colours[:, 1:] != colours[:, :-1]) << np.arange(5)).sum(axis=1)

    columns = np.empty((n, 6), dtype=np.int64)
    for shape in np.unique(breaks):
        weights = _candidate_weights(int(shape))
        members = np.flatnonzero(breaks == shape)
        step = max(1, _CHUNK // (len(weights) * 6))
        for at in range(0, len(members), step):
            rows = members[at : at + step]
            columns[rows] = _least_columns(codes[rows], weights)
    return columns, table, first


def canonical_array(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.Array:
    """One exact key per matrix: exponent, six columns, then the distinct values.

    All keys lie in one buffer, cut out of the numbers of all rows by one mask.
    """
    columns, table, first = canonical_parts(a, b)
    numbers = np.column_stack([k.astype(np.int64), columns, table]).astype(">i8")
    kept = np.column_stack([np.ones((len(k), 7), bool), first])
    offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1) * 8)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(numbers[kept].tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(k), buffers)


def canonical_bytes(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> list[bytes]:
    """The keys as bytes."""
    return canonical_array(a, b, k).to_pylist()


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def canonical_key(m: str, lanes: Lanes = NARROW) -> Column:
    """BINARY canonical key of a reduced, non-null matrix column (k at most 60)."""

    @F.arrow_udf("binary")
    def key(a: pa.Array, b: pa.Array, k: pa.Array) -> pa.Array:
        if len(k) == 0:
            return pa.array([], pa.binary())
        if k.to_numpy().max() > 60:
            raise ValueError("canonical keys are exact up to exponent 60 only")
        numerators = (_unpack(_flat(v, lanes.size), lanes) for v in (a, b))
        return canonical_array(*numerators, k.to_numpy())

    return key(*[F.expr(f"{m}.{part}") for part in "abk"])


def signature(m: str, lanes: Lanes = NARROW) -> Column:
    """Text invariant of a class from built-in functions only.

    Equal classes have equal signatures; the converse does not hold, so this is
    a pre-key or a check, not an identity. It lists the exponent and, for rows and
    for columns, the sorted list of sorted absolute entries.
    """

    def magnitude(r: int, c: int) -> Column:
        a, b = digits(m, r, c, lanes)
        return F.abs(shl(a, 32) + b)

    line = lambda cells: F.array_join(F.array_sort(F.array(*cells)), ",")
    lines = lambda cell: F.array_join(
        F.array_sort(F.array(*[line([cell(i, j) for j in range(6)]) for i in range(6)])), ";"
    )
    return F.concat_ws(
        "|", F.expr(f"{m}.k").cast("string"), lines(magnitude), lines(lambda i, j: magnitude(j, i))
    )


def exhaustive_key(m: str, lanes: Lanes = NARROW) -> Column:
    """Canonical columns over all 720*32 candidates with built-in functions only.

    A slow cross-check of ``canonical_key``: it induces the same classes. Exact
    for exponents up to 9, where a column fits one BIGINT.
    """
    base = 1 << 10
    places = [base**p for p in range(5, -1, -1)]

    def cell(r: int, c: int) -> Column:
        a, b = digits(m, r, c, lanes)
        return a * 20 + b

    matrix = F.array(*[F.array(*[cell(r, c) for r in range(6)]) for c in range(6)])
    orders = F.array(*[F.array(*map(F.lit, p)) for p in permutations(range(6))])
    signs = F.array(*[F.array(*[F.lit(int(x)) for x in s]) for s in _SIGNS])

    def candidate(order: Column, sign: Column) -> Column:
        def column(col: Column) -> Column:
            terms = [
                F.get(col, F.get(order, F.lit(i))) * F.get(sign, F.lit(i)) * F.lit(p).cast("bigint")
                for i, p in enumerate(places)
            ]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            return F.abs(total)

        return F.array_sort(F.transform(matrix, column))

    best = F.array_min(
        F.flatten(F.transform(orders, lambda o: F.transform(signs, lambda s: candidate(o, s))))
    )
    return F.struct(F.expr(f"{m}.k").alias("k"), best.alias("columns"))
