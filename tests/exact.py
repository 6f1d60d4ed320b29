"""Plain-Python model of the mathematics, one entry and one step at a time."""

from __future__ import annotations

from itertools import combinations, permutations, product

PAIRS = list(combinations(range(6), 2))


def reduce(a, b, e):
    if a == 0 and b == 0:
        return (0, 0, 0)
    while a % 2 == 0:
        a, b, e = b, a // 2, e - 1
    return (a, b, e)


def add(x, y):
    if x[:2] == (0, 0):
        return reduce(*y)
    if y[:2] == (0, 0):
        return reduce(*x)
    (a, b, e), (c, d, f) = x, y
    while e < f:
        a, b, e = 2 * b, a, e + 1
    while f < e:
        c, d, f = 2 * d, c, f + 1
    return reduce(a + c, b + d, e)


def mul(x, y):
    (a, b, e), (c, d, f) = x, y
    return (a * c + 2 * b * d, a * d + b * c, e + f)


def neg(x):
    return (-x[0], -x[1], x[2])


def identity():
    return [[(1, 0, 0) if r == c else (0, 0, 0) for c in range(6)] for r in range(6)]


def gate(m, g):
    p, q = PAIRS[g]
    root = lambda x: reduce(x[0], x[1], x[2] + 1)
    out = [list(r) for r in m]
    out[p] = [root(add(x, y)) for x, y in zip(m[p], m[q])]
    out[q] = [root(add(y, neg(x))) for x, y in zip(m[p], m[q])]
    return out


def word(gates, start=None):
    m = identity() if start is None else start
    for g in gates:
        m = gate(m, g)
    return m


def matmul(x, y):
    out = []
    for r in range(6):
        row = []
        for c in range(6):
            total = (0, 0, 0)
            for k in range(6):
                total = add(total, mul(x[r][k], y[k][c]))
            row.append(total)
        out.append(row)
    return out


def transpose(m):
    return [list(r) for r in zip(*m)]


def lde(m):
    return max(x[2] for row in m for x in row if x[0])


def planes(m):
    top, ints, roots = lde(m), 0, 0
    for r in range(6):
        for c in range(6):
            a, b, e = m[r][c]
            if a and e == top:
                ints |= 1 << (6 * c + r)
                roots |= (b & 1) << (6 * c + r)
            elif a and e == top - 1:
                roots |= 1 << (6 * c + r)
    return ints, roots


def class_key(m):
    """Least form over all row orders and row signs, columns sign-normalised and sorted."""
    best = None
    for order in permutations(range(6)):
        for signs in product((1, -1), repeat=5):
            cols = []
            for c in range(6):
                col = [
                    m[r][c] if s == 1 else neg(m[r][c]) for r, s in zip(order, (1,) + signs)
                ]
                lead = next((x for x in col if x[0]), (1, 0, 0))
                cols.append(tuple(col if lead[0] > 0 else [neg(x) for x in col]))
            cols.sort()
            if best is None or cols < best:
                best = cols
    return tuple(best)
