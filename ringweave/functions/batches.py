"""Matrices of whole batches of words as numpy arrays: (n, 6, 6) numerators a, b over sqrt2^k.

The same numbers as in ``matrices``, for jobs that make one product or signature per row: a step
costs one array operation a batch, where an expression is evaluated cell by cell and row by row.
Numerators are 64 bits wide, exact up to ``MAX_GATES`` gates in all; beyond it they raise.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ringweave.functions.gates import FIRST_ROWS, N_GATES, SECOND_ROWS

#: Gates of a product at most: numerators stay below 2^(k/2), sums of six products of them below 2^62.
MAX_GATES = 100
_FIRST, _SECOND = np.array(FIRST_ROWS), np.array(SECOND_ROWS)


class Batch(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    k: np.ndarray


def of_words(words: pa.ListArray, right: Batch | None = None) -> Batch:
    """The matrices of gate words, first gate first, times ``right`` if given; not reduced."""
    sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
    starts = words.offsets.to_numpy()[:-1].astype(np.int64)
    gates = words.values.to_numpy(zero_copy_only=False).astype(np.int64)
    if right is None:
        right = Batch(np.tile(np.eye(6, dtype=np.int64), (len(sizes), 1, 1)), np.zeros((len(sizes), 6, 6), np.int64), np.zeros(len(sizes), np.int64))
    k = right.k + sizes
    if len(k) and k.max() > MAX_GATES:
        raise ValueError("word too long for 64-bit numerators")
    used = gates[starts[0] : starts[-1] + sizes[-1]] if len(sizes) else gates[:0]
    if len(used) and (used.min() < 0 or used.max() >= N_GATES):
        raise ValueError("gate number outside 0..14")
    a, b = right.a.copy(), right.b.copy()
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > step)
        gate = gates[starts[live] + step]
        at, first, second = np.arange(len(live)), _FIRST[gate], _SECOND[gate]
        x, y = a[live], b[live]
        mixed = [(m[at, first] + m[at, second], m[at, second] - m[at, first]) for m in (x, y)]
        x, y = 2 * y, x  # other rows over the next exponent
        for m, (total, difference) in zip((x, y), mixed, strict=True):
            m[at, first], m[at, second] = total, difference
        a[live], b[live] = x, y
    return Batch(a, b, k)


def multiply(left: Batch, right: Batch) -> Batch:
    """left * right, not reduced."""
    k = left.k + right.k
    if len(k) and k.max() > MAX_GATES:
        raise ValueError("matrix exponent too large for 64-bit numerators")
    times = lambda x, y: np.einsum("nij,njk->nik", x, y)
    return Batch(times(left.a, right.a) + 2 * times(left.b, right.b), times(left.a, right.b) + times(left.b, right.a), k)


def all_products(left: Batch, right: Batch) -> Batch:
    """left * right for every pair, those of one left matrix together; not reduced."""
    n, m = len(left.k), len(right.k)
    k = (left.k[:, None] + right.k).ravel()
    if len(k) and k.max() > MAX_GATES // 2:
        raise ValueError("matrix exponent too large for products in double precision")
    beside = lambda x: x.transpose(1, 0, 2).reshape(6, 6 * m).astype(float)
    # Exact in doubles: every sum stays below 2^53.
    times = lambda x, y: (x.reshape(6 * n, 6).astype(float) @ beside(y)).astype(np.int64)
    apart = lambda x: x.reshape(n, 6, m, 6).transpose(0, 2, 1, 3).reshape(n * m, 6, 6)
    a = times(left.a, right.a) + 2 * times(left.b, right.b)
    return Batch(apart(a), apart(times(left.a, right.b) + times(left.b, right.a)), k)


def _zeros(numerators: np.ndarray) -> np.ndarray:
    """Trailing zero bits common to all entries of a matrix; 64 where all are zero."""
    merged = np.bitwise_or.reduce(numerators.reshape(len(numerators), 36), axis=1)
    low = merged & -merged
    return np.where(merged == 0, 64, np.log2(np.where(merged == 0, 1, np.abs(low)).astype(float)).astype(np.int64))


def reduced(m: Batch) -> Batch:
    """Without the common power of sqrt2."""
    common = np.minimum(2 * _zeros(m.a), 2 * _zeros(m.b) + 1)
    half, odd = (common >> 1)[:, None, None], (common & 1 == 1)[:, None, None]
    return Batch(np.where(odd, m.b >> half, m.a >> half), np.where(odd, m.a >> half + odd, m.b >> half), m.k - common)


def planes(m: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Integer and sqrt2 residues of reduced matrices, bit 6*col+row."""
    places = np.int64(1) << (6 * np.arange(6)[None, :] + np.arange(6)[:, None])
    return tuple(((part & 1) * places).sum(axis=(1, 2)) for part in (m.a, m.b))


def signatures(m: Batch) -> np.ndarray:
    """Per reduced matrix 576 bytes that hold what ``canonical.signature`` lists but for the exponent:
    the sorted lists of sorted absolute entries of rows and of columns."""
    size = np.abs((m.a << 32) + m.b)
    lines = [np.sort(x, axis=2).astype(">i8") for x in (size, size.transpose(0, 2, 1))]
    # Bytes of a fixed width compare as the numbers do, entry by entry.
    ordered = [np.sort(np.ascontiguousarray(x).view("S48")[:, :, 0], axis=1) for x in lines]
    return np.ascontiguousarray(np.concatenate(ordered, axis=1)).view("S576")[:, 0]
