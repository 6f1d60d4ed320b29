"""SQL twins of the registered queries, written for DuckDB.

They derive the same inputs from the tables and compute the results by other
means where there is a choice: 36-entry lists instead of packed lanes, HUGEINT
instead of limbs, divisibility search instead of closed forms, and all 23,040
candidates instead of coloured ones for canonical classes.
"""

from __future__ import annotations

from itertools import combinations, permutations, product

FULL = (1 << 36) - 1
K = 1 << 20  # range of a key before it is multiplied
PAIRS = list(combinations(range(6), 2))
R1 = "[" + ", ".join(str(p) for p, _ in PAIRS) + "]"
R2 = "[" + ", ".join(str(q) for _, q in PAIRS) + "]"
ROW_MASKS = [sum(1 << (6 * c + r) for c in range(6)) for r in range(6)]
COLUMN_MASKS = [0b111111 << (6 * c) for c in range(6)]
EYE = "[" + ", ".join("1" if i % 7 == 0 else "0" for i in range(36)) + "]::BIGINT[]"
NIL = "[" + ", ".join("0" for _ in range(36)) + "]::BIGINT[]"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


# --- inputs -----------------------------------------------------------------

RING = """
ring_in AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CAST(l_quantity AS BIGINT) - 25 AS xa, l_suppkey % 9 - 4 AS xb, l_partkey % 5 AS xe,
         l_suppkey % 5 - 2 AS ya, l_partkey % 7 - 3 AS yb, l_orderkey % 4 AS ye
  FROM lineitem)
"""

WORDS = f"""
words_in AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         (l_orderkey % {K} * 2654435761 + l_partkey % {K} * 104729) & {FULL} AS xhi,
         (l_partkey % {K} * 2246822519 + l_suppkey % {K} * 15485863) & {FULL} AS xlo,
         (l_suppkey % {K} * 3266489917 + l_orderkey % {K} * 32452843) & {FULL} AS yhi,
         (l_partkey % {K} * 668265263 + l_orderkey % {K} * 374761393) & {FULL} AS ylo,
         l_partkey % 80 AS n
  FROM lineitem),
huge_in AS (
  SELECT *, xhi::HUGEINT * {1 << 36} + xlo AS x, yhi::HUGEINT * {1 << 36} + ylo AS y FROM words_in)
"""

PLANES = (
    WORDS
    + """,
planes_in AS (
  SELECT l_orderkey, l_linenumber, n,
         CASE n % 3 WHEN 0 THEN xhi & yhi WHEN 1 THEN xhi & (yhi | xlo) ELSE xhi END AS int_plane,
         ylo AS sqrt2_plane
  FROM words_in)
"""
)

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

ORDER_WORDS = """
order_slots AS (
  SELECT l_orderkey, l_linenumber AS slot, min(l_partkey) % 15 AS g FROM lineitem GROUP BY 1, 2),
order_words AS (
  SELECT l_orderkey, list(g ORDER BY slot) AS gates FROM order_slots GROUP BY 1)
"""

CUSTOMER_WORDS = """
customer_slots AS (
  SELECT o_custkey, o_orderpriority AS slot, min(o_orderkey) % 15 AS g FROM orders GROUP BY 1, 2),
customer_words AS (
  SELECT o_custkey, list(g ORDER BY slot) AS gates FROM customer_slots GROUP BY 1)
"""

MONTH_WORDS = """
month_slots AS (
  SELECT user_id, strftime(ts, '%Y-%m') AS month, day(ts) AS slot, min(event_id) % 15 AS g
  FROM events GROUP BY 1, 2, 3),
month_words AS (
  SELECT user_id, month, list(g ORDER BY slot) AS gates FROM month_slots GROUP BY 1, 2)
"""


def tz(x: str) -> str:
    """Trailing zero bits, 63 for zero."""
    return f"(bit_count(xor({x}, {x} - 1))::BIGINT - 1)"


def fold(source: str, keys: str, out: str) -> str:
    """CTEs that replay ``gates`` of a source and leave reduced numerators A, B over k.

    Entry (row, col) is element 6*col + row + 1 of the lists.
    """
    step = lambda own, other: (
        f"list_transform(range(36), lambda j: CASE"
        f" WHEN j % 6 = p THEN {own}[j + 1] + {own}[j + 1 + q - p]"
        f" WHEN j % 6 = q THEN {own}[j + 1] - {own}[j + 1 - q + p]"
        f" ELSE {other} END)"
    )
    low = lambda v: f"list_min(list_transform({v}, lambda z: {tz('z')}))"
    return f"""
{out}_steps AS (
  SELECT {keys}, gates, 0 AS i, {EYE} AS A, {NIL} AS B FROM {source}
  UNION ALL
  SELECT {keys}, gates, i + 1, {step("A", "2 * B[j + 1]")}, {step("B", "A[j + 1]")}
  FROM (SELECT *, {R1}[gates[i + 1] + 1] AS p, {R2}[gates[i + 1] + 1] AS q
        FROM {out}_steps WHERE i < len(gates))),
{out}_val AS (
  SELECT *, least(2 * {low("A")}, 2 * {low("B")} + 1) AS v
  FROM {out}_steps WHERE i = len(gates)),
{out} AS (
  SELECT {keys}, gates, CAST(i - v AS BIGINT) AS k,
         CASE WHEN v % 2 = 0 THEN list_transform(A, lambda z: z >> (v // 2))
              ELSE list_transform(B, lambda z: z >> (v // 2)) END AS A,
         CASE WHEN v % 2 = 0 THEN list_transform(B, lambda z: z >> (v // 2))
              ELSE list_transform(A, lambda z: z >> (v // 2 + 1)) END AS B
  FROM {out}_val)
"""


def plane(v: str) -> str:
    return f"CAST(list_sum(list_transform(range(36), lambda j: ({v}[j + 1] & 1) << j)) AS BIGINT)"


def case_num(p: str) -> str:
    cols = "[" + ", ".join(f"bit_count({p} & {COLUMN_MASKS[i]})" for i in range(4)) + "]"
    rows = "[" + ", ".join(f"bit_count({p} & {ROW_MASKS[i]})" for i in range(4)) + "]"
    has = lambda lines, v: f"list_contains({lines}, {v})"
    sparse = lambda lines: f"len(list_filter({lines}, lambda z: z = 0)) > 2"
    return f"""CASE bit_count({p}) WHEN 4 THEN 1 WHEN 24 THEN 8
      WHEN 16 THEN CASE WHEN {has(cols + "[1:3]", 2)} OR {has(rows + "[1:3]", 2)} THEN 6 ELSE 3 END
      WHEN 12 THEN CASE WHEN {has(cols + "[1:3]", 4)} OR {has(cols + "[1:3]", 0)} THEN 4 ELSE 7 END
      WHEN 8 THEN CASE WHEN {has(cols, 4)} OR {has(rows, 4)} OR {sparse(cols)} OR {sparse(rows)}
                       THEN 2 ELSE 5 END
      ELSE 0 END"""


def patterned(source: str, words: str, keys: str, out: str) -> str:
    """Replay plus planes and case: columns keys, gates, k, A, B, int_plane, sqrt2_plane, case_num."""
    return (
        words
        + ","
        + fold(source, keys, f"{out}_m")
        + f""",
{out}_p AS (SELECT *, {plane("A")} AS int_plane, {plane("B")} AS sqrt2_plane FROM {out}_m),
{out} AS (SELECT *, CAST({case_num("int_plane")} AS BIGINT) AS case_num FROM {out}_p)
"""
    )


ORDERS_P = patterned("order_words", ORDER_WORDS, "l_orderkey", "op")
CUSTOMERS_P = patterned("customer_words", CUSTOMER_WORDS, "o_custkey", "cp")
MONTHS_P = patterned("month_words", MONTH_WORDS, "user_id, month", "mp")


def query(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def lowest_terms(a: str, b: str, e: str, prefix: str) -> list[str]:
    """Reduced (a, b, e) by searching the largest dividing power of sqrt2."""
    v = (
        "list_max(list_filter(range(0, 60), lambda v: CASE WHEN v % 2 = 0"
        f" THEN ({a}) % (1::BIGINT << (v // 2)) = 0 AND ({b}) % (1::BIGINT << (v // 2)) = 0"
        f" ELSE ({b}) % (1::BIGINT << (v // 2)) = 0 AND ({a}) % (1::BIGINT << (v // 2 + 1)) = 0 END))"
    )
    zero = f"({a}) = 0 AND ({b}) = 0"
    return [
        big(
            f"CASE WHEN {zero} THEN 0 WHEN {v} % 2 = 0 THEN ({a}) >> ({v} // 2) ELSE ({b}) >> ({v} // 2) END",
            f"{prefix}a",
        ),
        big(
            f"CASE WHEN {zero} THEN 0 WHEN {v} % 2 = 0 THEN ({b}) >> ({v} // 2)"
            f" ELSE ({a}) >> ({v} // 2 + 1) END",
            f"{prefix}b",
        ),
        big(f"CASE WHEN {zero} THEN 0 ELSE ({e}) - {v} END", f"{prefix}e"),
    ]


def select(source: str, *columns: str) -> str:
    return "SELECT " + ",\n  ".join(columns) + f"\nFROM {source}"


LI = ("l_orderkey", "l_linenumber")
ORACLES: dict[str, str] = {}

# --- ring elements ----------------------------------------------------------

ORACLES["ring_reduce"] = query(
    RING, select("ring_in", *LI, *lowest_terms("xa", "xb", "xe", "r"))
)


def _lifted(part: str, a: str, b: str, d: str) -> str:
    """One numerator part of (a + b*sqrt2) * sqrt2^d."""
    p = f"(1::BIGINT << (({d}) // 2))"
    if part == "a":
        return f"CASE WHEN ({d}) % 2 = 0 THEN {a} * {p} ELSE 2 * {b} * {p} END"
    return f"CASE WHEN ({d}) % 2 = 0 THEN {b} * {p} ELSE {a} * {p} END"


_SUMS = ",\n".join(
    f"{_lifted(p, 'xa', 'xb', 'greatest(xe, ye) - xe')} {op} {_lifted(p, 'ya', 'yb', 'greatest(xe, ye) - ye')}"
    f" AS {name}{p}"
    for name, op in (("s", "+"), ("d", "-"))
    for p in "ab"
)
ORACLES["ring_add_sub"] = query(
    RING + f", summed AS (SELECT *, greatest(xe, ye) AS ze, {_SUMS} FROM ring_in)",
    select(
        "summed", *LI, *lowest_terms("sa", "sb", "ze", "s"), *lowest_terms("da", "db", "ze", "d")
    ).replace("CAST(CASE WHEN (sa)", "CAST(CASE WHEN (sa)"),
)

ORACLES["ring_multiply"] = query(
    RING,
    select(
        "ring_in",
        *LI,
        big("xa * ya + 2 * xb * yb", "pa"),
        big("xa * yb + xb * ya", "pb"),
        big("xe + ye", "pe"),
        big("-xa", "na"),
        big("-xb", "nb"),
        big("xe", "ne"),
        big("xa", "ha"),
        big("xb", "hb"),
        big("CASE WHEN xa = 0 THEN xe ELSE xe + 1 END", "he"),
    ),
)

_RED = "red AS (SELECT *, " + ", ".join(
    lowest_terms("xa", "xb", "xe", "u") + lowest_terms("ya", "yb", "ye", "w")
    + lowest_terms("xa * ya + 2 * xb * yb", "xa * yb + xb * ya", "xe + ye", "z")
) + " FROM ring_in)"


def _quotient(x: str, prefix: str) -> list[str]:
    norm = "(wa * wa - 2 * wb * wb)"
    qa, qb = f"({x}a * wa - 2 * {x}b * wb)", f"({x}b * wa - {x}a * wb)"
    ok = f"{norm} <> 0 AND {qa} % nullif({norm}, 0) = 0 AND {qb} % nullif({norm}, 0) = 0"
    part = lambda q: f"CASE WHEN {ok} THEN {q} // nullif({norm}, 0) END"
    return [
        big(part(qa), f"{prefix}a"),
        big(part(qb), f"{prefix}b"),
        big(f"CASE WHEN {ok} THEN CASE WHEN {x}a = 0 THEN 0 ELSE {x}e - we END END", f"{prefix}e"),
    ]


ORACLES["ring_divide"] = query(
    RING + ", " + _RED, select("red", *LI, *_quotient("u", "q"), *_quotient("z", "back"))
)

_LESS = "(xa < ya OR (xa = ya AND (xb < yb OR (xb = yb AND xe < ye))))"
_SAME = "(xa = ya AND xb = yb AND xe = ye)"
ORACLES["ring_order"] = query(
    RING,
    select(
        "ring_in",
        *LI,
        big("CASE WHEN xa < 0 THEN -xa ELSE xa END", "absa"),
        big("CASE WHEN xa < 0 THEN -xb ELSE xb END", "absb"),
        big("xe", "abse"),
        big("xa < 0 OR (xa = 0 AND xb < 0)", "negative"),
        big(f"CASE WHEN {_LESS} THEN -1 WHEN {_SAME} THEN 0 ELSE 1 END", "cmp"),
        big(_LESS, "less"),
        big(_SAME, "same"),
        big(
            "CASE WHEN xa <> ya THEN sign(xa - ya) WHEN xe <> 0 THEN -sign(xe) ELSE sign(xb) END",
            "cmp_int",
        ),
        big("xa = ya AND xe = 0", "same_int"),
    ),
)

ORACLES["ring_text"] = query(
    RING, select("ring_in", *LI, "concat(xa, ',', xb, 'e', xe) AS x_text")
)

ORACLES["ring_sum"] = query(
    RING
    + f""", tops AS (
  SELECT l_orderkey % 1000 AS grp, max(xe) AS ze FROM ring_in GROUP BY 1),
added AS (
  SELECT grp, ze, CAST(sum({_lifted("a", "xa", "xb", "ze - xe")}) AS BIGINT) AS sa,
         CAST(sum({_lifted("b", "xa", "xb", "ze - xe")}) AS BIGINT) AS sb
  FROM ring_in JOIN tops ON grp = l_orderkey % 1000 GROUP BY 1, 2)""",
    select("added", "grp", *lowest_terms("sa", "sb", "ze", "t")),
)

# --- 72-bit words -----------------------------------------------------------

_TOP = 1 << 72


def limbs(expr: str, name: str) -> list[str]:
    return [
        big(f"({expr}) // {1 << 36}", f"{name}_hi"),
        big(f"({expr}) % {1 << 36}", f"{name}_lo"),
    ]


ORACLES["word72_arith"] = query(
    WORDS,
    select(
        "huge_in",
        *LI,
        big("xhi & yhi", "conj_hi"),
        big("xlo & ylo", "conj_lo"),
        big("xhi | yhi", "disj_hi"),
        big("xlo | ylo", "disj_lo"),
        *limbs(f"{_TOP - 1}::HUGEINT - x", "inv"),
        *limbs(f"(x + y) % {_TOP}::HUGEINT", "total"),
        *limbs(f"(x - y + {_TOP}::HUGEINT) % {_TOP}::HUGEINT", "diff"),
        big("length(replace(bin(xhi) || bin(xlo), '0', ''))", "ones"),
        big("x = y", "same"),
    ),
)

_SHL = f"CASE WHEN n >= 72 THEN 0::HUGEINT ELSE (x % (1::HUGEINT << (72 - n))) * (1::HUGEINT << n) END"
_SHR = "CASE WHEN n >= 72 THEN 0::HUGEINT ELSE x // (1::HUGEINT << n) END"
ORACLES["word72_shift"] = query(
    WORDS, select("huge_in", *LI, *limbs(_SHL, "left"), *limbs(_SHR, "right"))
)


def _window(width: int) -> str:
    return f"(x // (1::HUGEINT << (n % 71))) % {1 << width}"


def _replaced(width: int) -> str:
    """x with the window cut out and the low bits of ylo put in, within 72 bits."""
    at = "(1::HUGEINT << (n % 71))"
    return f"(x - ({_window(width)}) * {at} + (ylo % {1 << width}) * {at})"


ORACLES["word72_window"] = query(
    WORDS,
    select(
        "huge_in",
        *LI,
        big(_window(1), "bit"),
        big(_window(2), "pair"),
        big(_window(16), "bits16"),
        *limbs(_replaced(1), "bit"),
        *limbs(_replaced(2), "pair"),
    ),
)


def word_plane(odd: int) -> str:
    """Plane of the odd or even bits of x."""
    return (
        f"list_sum(list_transform(range(36), lambda j: ((x // (1::HUGEINT << (2 * j + {odd}))) % 2)"
        " * (1::BIGINT << j)))"
    )


_BIN72 = "lpad(bin(xhi), 36, '0') || lpad(bin(xlo), 36, '0')"
ORACLES["word72_text"] = query(
    WORDS,
    select(
        "huge_in",
        *LI,
        f"{_BIN72} AS binary",
        "array_to_string(list_transform(range(36), lambda j:"
        " ((x // (1::HUGEINT << (2 * j + 1))) % 2)::VARCHAR || ((x // (1::HUGEINT << (2 * j))) % 2)::VARCHAR),"
        " '') AS pattern",
        big(word_plane(1), "int_plane"),
        big(word_plane(0), "sqrt2_plane"),
        big("xhi", "hi"),
        big("xlo", "lo"),
        big(f"x // {1 << 64}::HUGEINT", "high8"),
    ),
)

# --- patterns ---------------------------------------------------------------

_HEX = "(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1)"
# Bit t (from 0) of the text is bit 3 - t%4 of hex digit t/4.
DOC_BITS = """
doc_hash AS (SELECT doc_id, sha256(text) AS h FROM documents),
doc_bits AS (
  SELECT doc_id, list_transform(range(72), lambda t:
    ((strpos('0123456789abcdef', substr(h, t // 4 + 1, 1)) - 1) >> (3 - t % 4)) & 1) AS bits
  FROM doc_hash),
doc_planes AS (
  SELECT CAST(list_sum(list_transform(range(36), lambda j: bits[2 * j + 1]::BIGINT << j)) AS BIGINT) AS int_plane,
         CAST(list_sum(list_transform(range(36), lambda j: bits[2 * j + 2]::BIGINT << j)) AS BIGINT) AS sqrt2_plane
  FROM doc_bits)
"""
ORACLES["pattern_text_scan"] = query(
    DOC_BITS,
    select("doc_planes", "int_plane", "sqrt2_plane", big(case_num("int_plane"), "case_num")),
)
ORACLES["pattern_csv_scan"] = query(DOC_BITS, select("doc_planes", "int_plane", "sqrt2_plane"))

ORACLES["pattern_case"] = query(
    PLANES,
    select(
        "planes_in",
        *LI,
        big("length(replace(bin(int_plane), '0', ''))", "weight"),
        big(case_num("int_plane"), "case_num"),
    ),
)

_CELL = "(6 * (n % 6) + l_linenumber % 6)"


def _put(p: str, at: str, bit: str) -> str:
    one = f"(1::BIGINT << ({at}))"
    return f"(({p} // {one} // 2) * 2 + ({bit})) * {one} + {p} % {one}"


ORACLES["pattern_cells"] = query(
    PLANES,
    select(
        "planes_in",
        *LI,
        big(f"(int_plane >> {_CELL}) & 1", "int_bit"),
        big(f"(sqrt2_plane >> {_CELL}) & 1", "sqrt2_bit"),
        big(f"((int_plane >> {_CELL}) & 1) * 2 + ((sqrt2_plane >> {_CELL}) & 1)", "value"),
        big(_put("int_plane", _CELL, "(n % 4) // 2"), "set_ints"),
        big(_put("sqrt2_plane", _CELL, "n % 2"), "set_roots"),
        big(
            "CASE WHEN n % 72 % 2 = 1 THEN "
            + _put("int_plane", "n % 72 // 2", "l_linenumber % 2")
            + " ELSE int_plane END",
            "raw_ints",
        ),
        big(
            "CASE WHEN n % 72 % 2 = 0 THEN "
            + _put("sqrt2_plane", "n % 72 // 2", "l_linenumber % 2")
            + " ELSE sqrt2_plane END",
            "raw_roots",
        ),
        big(f"int_plane & {ROW_MASKS[2]}", "row2"),
        big(f"int_plane & {COLUMN_MASKS[3]}", "col3"),
        big(
            f"8 * bit_count(int_plane & {COLUMN_MASKS[1]})::BIGINT + bit_count(sqrt2_plane & {COLUMN_MASKS[1]})",
            "sig1",
        ),
    ),
)


def _rearranged(p: str, source: str) -> str:
    """Plane whose cell j comes from cell ``source`` (an expression in j)."""
    return f"list_sum(list_transform(range(36), lambda j: (({p} >> ({source})) & 1) << j))"


_MOVE = "j // 6 * 6 + (j % 6 + n) % 6"
_FLIP = "j % 6 * 6 + j // 6"
ORACLES["pattern_mods"] = query(
    PLANES,
    select(
        "planes_in",
        *LI,
        big("xor(sqrt2_plane, int_plane)", "all_roots"),
        big(
            "list_sum(list_transform(range(36), lambda j: (xor((sqrt2_plane >> j) & 1,"
            " CASE WHEN j % 6 = l_linenumber % 6 THEN (int_plane >> j) & 1 ELSE 0 END)) << j))",
            "row_roots",
        ),
        big(_rearranged("int_plane", _MOVE), "moved_ints"),
        big(_rearranged("sqrt2_plane", _MOVE), "moved_roots"),
        big(_rearranged("int_plane", _FLIP), "flip_ints"),
        big(_rearranged("sqrt2_plane", _FLIP), "flip_roots"),
    ),
)

_ORDERS = ", ".join(
    "(" + ", ".join(map(str, o)) + ")" for o in permutations(range(6))
)


def _moved(p: str) -> str:
    return " | ".join(f"(((({p} >> o{r}) & {ROW_MASKS[0]})) << {r})" for r in range(6))


_MODROWS = " | ".join(f"(CASE WHEN (m >> {r}) & 1 = 1 THEN {ROW_MASKS[r]} ELSE 0 END)" for r in range(6))
ORACLES["pattern_orbit"] = query(
    f"""
start AS (
  SELECT s_suppkey,
         (s_suppkey % {K} * {2654435761 * 17}) & CASE WHEN s_suppkey % 3 = 0 THEN {sum(ROW_MASKS[:4])} ELSE {FULL} END AS i,
         (s_suppkey % {K} * {2246822519 * 13}) & CASE WHEN s_suppkey % 3 = 0 THEN {sum(ROW_MASKS[:4])} ELSE {FULL} END AS s
  FROM supplier),
orders6(o0, o1, o2, o3, o4, o5) AS (VALUES {_ORDERS}),
moved AS (
  SELECT s_suppkey, o0 = 0 AND o1 = 1 AND o2 = 2 AND o3 = 3 AND o4 = 4 AS unmoved,
         {_moved("i")} AS i, {_moved("s")} AS s FROM start CROSS JOIN orders6),
members AS (
  SELECT DISTINCT s_suppkey, i, xor(s, i & ({_MODROWS})) AS s
  FROM moved CROSS JOIN (SELECT range AS m FROM range(64)) WHERE NOT unmoved OR m = 0)
""",
    select(
        "members",
        "s_suppkey",
        big("count(*)", "members"),
        big("count(*)", "closed_size"),
        big("min(i)", "least_ints"),
        big("bit_xor(s)", "roots_xor"),
        big("sum(s % 1000003)", "roots_sum"),
    )
    + " GROUP BY s_suppkey",
)

_ROW_CODE = (
    "list_transform(range(6), lambda r: list_sum(list_transform(range(6), lambda c:"
    " (({p} >> (6 * c + r)) & 1) << c)))"
)
_ORBIT_KEY = (
    "list_sort(list_transform(range(6), lambda r: ri[r + 1] * 64 + least(rs[r + 1], xor(rs[r + 1]::BIGINT, ri[r + 1]::BIGINT))))"
)


def orbit_keys(source: str, out: str) -> str:
    return f"""
{out}_rows AS (SELECT *, {_ROW_CODE.format(p="int_plane")} AS ri, {_ROW_CODE.format(p="sqrt2_plane")} AS rs FROM {source}),
{out} AS (SELECT * EXCLUDE (ri, rs), {_ORBIT_KEY} AS orbit FROM {out}_rows)
"""


ORACLES["pattern_orbit_classes"] = query(
    ORDERS_P
    + ", pats AS (SELECT DISTINCT case_num, int_plane, sqrt2_plane FROM op), "
    + orbit_keys("pats", "keyed"),
    select(
        "keyed", "case_num", big("count(*)", "n_patterns"), big("count(DISTINCT orbit)", "n_orbits")
    )
    + " GROUP BY case_num",
)

ORACLES["pattern_grid_text"] = query(
    PLANES,
    select(
        "planes_in",
        *LI,
        "array_to_string(list_transform(range(6), lambda r: array_to_string(list_transform(range(6),"
        " lambda c: ((int_plane >> (6 * c + r)) & 1)::VARCHAR || ',' ||"
        " ((sqrt2_plane >> (6 * c + r)) & 1)::VARCHAR), ' ')), chr(10)) AS grid",
    ),
)

# --- circuits ---------------------------------------------------------------

_NIBBLES = (
    "array_to_string(list_transform(range((len({g}) + 1) // 2), lambda i:"
    " substr('0123456789ABCDEF', 1 + coalesce({g}[2 * i + 2] + 1, 0)::BIGINT, 1) ||"
    " substr('0123456789ABCDEF', 2 + {g}[2 * i + 1]::BIGINT, 1)), '')"
)
ORACLES["circuit_text"] = query(
    """
doc_gates AS (
  SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda t: length(t) > 0),
                                lambda t: length(t) % 15) AS g
  FROM documents)
""",
    select(
        "doc_gates",
        "doc_id",
        big("len(g)", "n_gates"),
        "md5(array_to_string(g, ' ')) AS circuit_md5",
        f"md5({_NIBBLES.format(g='g')}) AS packed_md5",
        big("1", "round_trip"),
    ),
)

_PLANE_COLUMNS = ("int_plane", "sqrt2_plane", "case_num")
ORACLES["circuit_replay"] = query(
    ORDERS_P,
    select(
        "op", "l_orderkey", "array_to_string(gates, ' ') AS circuit", "k AS lde", *_PLANE_COLUMNS
    ),
)
ORACLES["circuit_case_histogram"] = query(
    ORDERS_P, "SELECT case_num, k AS lde, count(*) AS n_words FROM op GROUP BY 1, 2"
)
ORACLES["circuit_replay_months"] = query(
    MONTHS_P,
    select("mp", "user_id", "month", big("len(gates)", "n_gates"), "k AS lde", *_PLANE_COLUMNS),
)
ORACLES["packed_replay"] = query(
    CUSTOMERS_P,
    select(
        "cp", "o_custkey", f"{_NIBBLES.format(g='gates')} AS packed_hex", "k AS lde", "case_num"
    ),
)

# --- matrices ---------------------------------------------------------------


def entry_cells(source: str, keys: str, out: str) -> str:
    """Long form (keys, j, row, col, a, b, e) of all entries in lowest terms."""
    return (
        f"{out}_raw AS (SELECT {keys}, j, j % 6 AS row, j // 6 AS col, A[j + 1] AS na, B[j + 1] AS nb, k"
        f" FROM {source} CROSS JOIN (SELECT range AS j FROM range(36))),"
        f"{out} AS ("
        + select(f"{out}_raw", keys, "j", "row", "col", *lowest_terms("na", "nb", "k", ""))
        + ")"
    )


_CELL_COLUMNS = ("row", "col", "a", "b", "e")
ORACLES["matrix_elements"] = query(
    CUSTOMERS_P + ", " + entry_cells("cp", "o_custkey", "cells"),
    select("cells", "o_custkey", *_CELL_COLUMNS) + " WHERE a <> 0",
)

ORACLES["matrix_product"] = query(
    ORDER_WORDS
    + ","
    + patterned(
        "joined",
        CUSTOMER_WORDS
        + """, joined AS (
  SELECT o_orderkey, list_concat(c.gates, w.gates) AS gates
  FROM order_words w JOIN orders ON l_orderkey = o_orderkey JOIN customer_words c USING (o_custkey))""",
        "o_orderkey",
        "pp",
    ),
    select("pp", "o_orderkey", "k AS lde", *_PLANE_COLUMNS),
)

ORACLES["matrix_square_long"] = query(
    CUSTOMER_WORDS
    + ", twice AS (SELECT o_custkey, list_concat(gates, gates) AS gates FROM customer_words),"
    + fold("twice", "o_custkey", "sq")
    + ", "
    + entry_cells("sq", "o_custkey", "cells"),
    select("cells", "o_custkey", *_CELL_COLUMNS) + " WHERE a <> 0",
)


def _cell_text(a: str, b: str) -> str:
    """Text of an entry given its numerators over k, in lowest terms."""
    v = f"least(2 * {tz(a)}, 2 * {tz(b)} + 1)"
    ra = f"CASE WHEN {v} % 2 = 0 THEN {a} >> ({v} // 2) ELSE {b} >> ({v} // 2) END"
    rb = f"CASE WHEN {v} % 2 = 0 THEN {b} >> ({v} // 2) ELSE {a} >> ({v} // 2 + 1) END"
    return (
        f"CASE WHEN {a} = 0 AND {b} = 0 THEN '0,0e0'"
        f" ELSE concat({ra}, ',', {rb}, 'e', k - {v}) END"
    )


def _changed_plane(v: str, source: str) -> str:
    return f"list_sum(list_transform(range(36), lambda j: ({v}[1 + {source}] & 1) << j))"


def _changed_cells(factor: str) -> str:
    cell = _cell_text(f"({factor} * A[1 + 6 * ((2 * i + 1) % 6) + i])", f"({factor} * B[1 + 6 * ((2 * i + 1) % 6) + i])")
    return f"array_to_string(list_transform(range(6), lambda i: {cell}), ' ')"


_TURN = {
    "t": "j % 6 * 6 + j // 6",
    "r": "j // 6 * 6 + (j % 6 + o_custkey) % 6",
    "c": "(j // 6 + o_custkey) % 6 * 6 + j % 6",
}
_SIGN = lambda i: f"(CASE WHEN ({i} + o_custkey) % 3 = 0 THEN -1 ELSE 1 END)"
ORACLES["matrix_transforms"] = query(
    CUSTOMERS_P,
    select(
        "cp",
        "o_custkey",
        *[big(_changed_plane("A", s), f"{k}_ints") for k, s in _TURN.items()],
        *[big(_changed_plane("B", s), f"{k}_roots") for k, s in _TURN.items()],
        _changed_cells("(CASE WHEN i = o_custkey % 6 THEN -1 ELSE 1 END)") + " AS n_cells",
        _changed_cells(_SIGN("i") + " * " + _SIGN("((2 * i + 1) % 6)")) + " AS s_cells",
    ),
)

ORACLES["matrix_text"] = query(
    CUSTOMERS_P,
    select(
        "cp",
        "o_custkey",
        "array_to_string(list_transform(range(6), lambda r: array_to_string(list_transform(range(6),"
        f" lambda c: {_cell_text('A[1 + 6 * c + r]', 'B[1 + 6 * c + r]')}), ' ')), chr(10)) AS grid",
    ),
)

ORACLES["matrix_text_columns"] = query(
    CUSTOMERS_P,
    select(
        "cp",
        "o_custkey",
        "array_to_string(list_transform(range(6), lambda r: array_to_string(list_transform("
        "[(o_custkey + 4) % 6, o_custkey % 6, (o_custkey + 3) % 6],"
        f" lambda c: {_cell_text('A[1 + 6 * c + r]', 'B[1 + 6 * c + r]')}), ' ')), chr(10)) AS grid",
    ),
)

ORACLES["matrix_from_pattern"] = query(
    ORDERS_P,
    """SELECT DISTINCT int_plane AS ints, sqrt2_plane AS roots,
  CAST(int_plane <> 0 AS BIGINT) AS k,
  CASE WHEN int_plane = 0 THEN sqrt2_plane ELSE int_plane END AS int_plane,
  CASE WHEN int_plane = 0 THEN 0 ELSE sqrt2_plane END AS sqrt2_plane,
  CASE WHEN int_plane & 1 = 1 THEN concat('1,', sqrt2_plane & 1, 'e1')
       WHEN sqrt2_plane & 1 = 1 THEN '1,0e0' ELSE '0,0e0' END AS corner
FROM op""",
)

# --- canonical form ---------------------------------------------------------

_ABS_CELLS = (
    CUSTOMERS_P
    + ", "
    + entry_cells("cp", "o_custkey", "cells")
    + """,
abs_cells AS (
  SELECT o_custkey, row, col, a AS sa, CASE WHEN a < 0 THEN -a ELSE a END AS a,
         CASE WHEN a < 0 THEN -b ELSE b END AS b, e FROM cells)
"""
)
ORACLES["line_classes"] = query(
    _ABS_CELLS
    + """,
kinds AS (
  SELECT o_custkey, 'row' AS kind, row AS line, a, b, e FROM abs_cells
  UNION ALL SELECT o_custkey, 'column', col, a, b, e FROM abs_cells),
keyed AS (
  SELECT o_custkey, kind, line,
         string_agg(concat(a, ',', b, 'e', e), ' ' ORDER BY a, b, e) AS entries
  FROM kinds GROUP BY 1, 2, 3)
""",
    "SELECT o_custkey, kind, entries, string_agg(line::VARCHAR, ' ' ORDER BY line) AS members "
    "FROM keyed GROUP BY 1, 2, 3",
)

ORACLES["column_order"] = query(
    CUSTOMERS_P
    + ", "
    + entry_cells("cp", "o_custkey", "cells")
    + """,
leads AS (
  SELECT o_custkey, col, coalesce(arg_min(sign(a), row) FILTER (a <> 0), 1) AS flip
  FROM cells GROUP BY 1, 2),
keyed AS (
  SELECT o_custkey, col,
         list([CAST(a = 0 AS BIGINT), CAST(-a * flip AS BIGINT), CAST(-b * flip AS BIGINT), -e] ORDER BY row) AS key
  FROM cells JOIN leads USING (o_custkey, col) GROUP BY 1, 2)
""",
    "SELECT o_custkey, string_agg(col::VARCHAR, ' ' ORDER BY key, col) AS columns FROM keyed GROUP BY 1",
)

ORACLES["column_order_signed"] = query(
    CUSTOMERS_P
    + ", "
    + entry_cells("cp", "o_custkey", "cells")
    + """,
signed AS (
  SELECT o_custkey, row, col, e, a * s AS a, b * s AS b FROM (
    SELECT *, CASE WHEN row > 0 AND (o_custkey % 32) & (1 << (row - 1)::INT) <> 0 THEN -1 ELSE 1 END AS s FROM cells)),
leads AS (
  SELECT o_custkey, col, coalesce(arg_min(sign(a), row) FILTER (a <> 0), 1) AS flip FROM signed GROUP BY 1, 2),
keyed AS (
  SELECT o_custkey, col,
         list([CAST(a = 0 AS BIGINT), CAST(-a * flip AS BIGINT), CAST(-b * flip AS BIGINT), -e] ORDER BY row) AS key
  FROM signed JOIN leads USING (o_custkey, col) GROUP BY 1, 2)
""",
    """SELECT o_custkey,
  '+' || array_to_string(list_transform(range(5), lambda i: CASE WHEN (o_custkey % 32) & (1 << i::INT) <> 0 THEN '-' ELSE '+' END), '') AS mask_text,
  string_agg(col::VARCHAR, ' ' ORDER BY key, col) AS columns FROM keyed GROUP BY 1""",
)

# One edge a step: node r is row r, node 6 + c column c.
ORACLES["sign_propagation"] = query(
    CUSTOMERS_P
    + ", "
    + entry_cells("cp", "o_custkey", "cells")
    + """,
edges AS (SELECT o_custkey, row::INT * 6 + col::INT AS i, sign(a)::INT AS want FROM cells),
joined AS (
  SELECT DISTINCT o_custkey, -1 AS i, range(12) AS part, list_transform(range(12), lambda x: 1) AS signs, []::INT[] AS bad FROM edges
  UNION ALL
  SELECT o_custkey, i,
    CASE WHEN want <> 0 AND a <> b THEN list_transform(part, lambda p: CASE WHEN p = greatest(a, b) THEN least(a, b) ELSE p END) ELSE part END,
    CASE WHEN want <> 0 AND a <> b THEN list_transform(range(1, 13), lambda k: CASE WHEN part[k] = greatest(a, b) THEN signs[k] * now * want ELSE signs[k] END) ELSE signs END,
    CASE WHEN want <> 0 AND a = b AND now * want < 0 THEN list_append(bad, i) ELSE bad END
  FROM (
    SELECT j.o_custkey, e.i, want, part, signs, bad, part[e.i // 6 + 1] AS a, part[e.i % 6 + 7] AS b,
      signs[e.i // 6 + 1] * signs[e.i % 6 + 7] AS now
    FROM joined j JOIN edges e ON e.o_custkey = j.o_custkey AND e.i = j.i + 1))
""",
    """SELECT o_custkey,
  array_to_string(list_transform(range(6), lambda r: CASE WHEN len(list_filter(bad, lambda x: x // 6 = r)) > 0 THEN '¿' WHEN signs[r + 1] > 0 THEN '+' ELSE '-' END), '') AS rows,
  array_to_string(list_transform(range(6), lambda c: CASE WHEN len(list_filter(bad, lambda x: x % 6 = c)) > 0 THEN '¿' WHEN part[c + 7] = c + 6 THEN '?' WHEN signs[c + 7] > 0 THEN '+' ELSE '-' END), '') AS columns,
  len(bad)::BIGINT AS conflicts
FROM joined WHERE i = 35""",
)

_SYMBOL = "CASE {c} WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '¿' ELSE '?' END"
_MASK = "list_sum(list_transform(range(6), lambda c: code[c + 1] * (1 << (2 * c))))"
_CODES = """
codes AS (
  SELECT o_custkey, list(CASE WHEN a > 0 THEN 1 WHEN a < 0 THEN 2 ELSE 0 END ORDER BY col) AS code
  FROM cells WHERE row = 0 GROUP BY 1)
"""
ORACLES["sign_masks"] = query(
    CUSTOMERS_P + ", " + entry_cells("cp", "o_custkey", "cells") + ", " + _CODES,
    select(
        "codes",
        "o_custkey",
        f"array_to_string(list_transform(code, lambda z: {_SYMBOL.format(c='z')}), '') AS mask_text",
        f"array_to_string(list_transform(code, lambda z: {_SYMBOL.format(c='3 - z')}), '') AS reversed_text",
        big(
            "list_sum(list_transform(range(6), lambda c: (CASE WHEN c = o_custkey % 6"
            " THEN o_custkey % 4 ELSE code[c + 1] END) * (1 << (2 * c))))",
            "changed",
        ),
        big("code[o_custkey % 6 + 1]", "code"),
    ),
)

ORACLES["majority_votes"] = query(
    _ABS_CELLS
    + """,
col_keys AS (
  SELECT o_custkey, col, list([a, b, e, n] ORDER BY a, b, e) AS cls FROM (
    SELECT o_custkey, col, a, b, e, count(*) AS n FROM abs_cells GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2),
col_signs AS (SELECT o_custkey, col, sign(sa) AS s FROM abs_cells WHERE row = 0),
balances AS (
  SELECT o_custkey, row, cls, sum(sign(sa) * s) AS balance
  FROM abs_cells JOIN col_signs USING (o_custkey, col) JOIN col_keys USING (o_custkey, col)
  GROUP BY 1, 2, 3),
decided AS (
  SELECT o_custkey, row, arg_min(balance, cls) FILTER (balance <> 0) AS balance
  FROM balances GROUP BY 1, 2)
""",
    "SELECT o_custkey, row, CAST(CASE WHEN balance > 0 THEN 1 WHEN balance < 0 THEN 2 ELSE 0 END AS BIGINT) AS sign"
    " FROM decided",
)


def _sorted_lines(cell: str) -> str:
    """Sorted list of sorted lists; cell is an expression in the line r and position c."""
    return (
        "list_sort(list_transform(range(6), lambda r: list_sort(list_transform(range(6),"
        f" lambda c: mag[{cell} + 1]))))"
    )


ORACLES["canonical_signatures"] = query(
    ORDER_WORDS
    + ","
    + fold("order_words", "l_orderkey", "om")
    + f""",
mags AS (SELECT k, list_transform(range(36), lambda j: abs(A[j + 1] * 4294967296 + B[j + 1])) AS mag FROM om),
sigs AS (SELECT k, {_sorted_lines("6 * c + r")} AS rows, {_sorted_lines("6 * r + c")} AS cols FROM mags)
""",
    "SELECT k AS lde, count(*) AS n_words, count(DISTINCT (rows, cols)) AS n_signatures FROM sigs GROUP BY 1",
)



def classes(source: str, out: str) -> str:
    """CTE ``out``: id columns k, A, B of the distinct matrices of a source plus their class key.

    A column is one integer over base 1024 with entries coded as 32*A + B (exact for
    k <= 7). Candidates are all row orders that keep the rows sorted by their multiset
    of absolute entries, times all row signs; the least sorted list of absolute column
    values is the key.
    """
    code = "list_transform(range(36), lambda j: 32 * A[j + 1] + B[j + 1])"
    row = "list_sort(list_transform(range(6), lambda c: abs(coded[6 * c + r + 1])))"
    ascending = " AND ".join(f"L[o{i} + 1] <= L[o{i + 1} + 1]" for i in range(5))
    value = "abs(" + " + ".join(
        f"coded[6 * c + o{p} + 1] * {'' if p == 0 else f's{p} * '}{1024 ** (5 - p)}" for p in range(6)
    ) + ")"
    signs = ", ".join(str(s) for s in product((1, -1), repeat=5))
    return f"""
{out}_d AS (SELECT k, A, B, {code} AS coded FROM (SELECT DISTINCT k, A, B FROM {source})),
{out}_l AS (
  SELECT row_number() OVER () AS id, *, list_transform(range(6), lambda r: {row}) AS L FROM {out}_d),
{out}_o(o0, o1, o2, o3, o4, o5) AS (VALUES {_ORDERS}),
{out}_s(s1, s2, s3, s4, s5) AS (VALUES {signs}),
{out}_c AS (SELECT id, coded, o0, o1, o2, o3, o4, o5 FROM {out}_l CROSS JOIN {out}_o WHERE {ascending}),
{out}_k AS (
  SELECT id, min(list_sort(list_transform(range(6), lambda c: {value}))) AS key
  FROM {out}_c CROSS JOIN {out}_s GROUP BY id),
{out} AS (SELECT k, A, B, key FROM {out}_l JOIN {out}_k USING (id))
"""


ORACLES["canonical_classes"] = query(
    CUSTOMERS_P + ", " + classes("cp", "cc"),
    "SELECT min(o_custkey) AS first_custkey, count(*) AS members, k AS lde, min(case_num) AS low_case,"
    " max(case_num) AS high_case FROM cp JOIN cc USING (k, A, B) GROUP BY k, key",
)
ORACLES["level_distinct"] = query(
    ORDERS_P + ", " + classes("op", "oc"),
    """SELECT lde, case_num, count(*) AS n_classes FROM (
  SELECT DISTINCT k AS lde, case_num, key FROM op JOIN oc USING (k, A, B)) GROUP BY 1, 2""",
)

_STEPPED = patterned(
        "stepped",
        CUSTOMER_WORDS
        + """, stepped AS (
  SELECT o_custkey, g AS gate, list_append(gates, g) AS gates
  FROM customer_words CROSS JOIN (SELECT range AS g FROM range(15)))""",
        "o_custkey, gate",
        "sp",
    )
ORACLES["level_expand"] = query(
    _STEPPED,
    f"""SELECT gate, CAST({R1}[gate + 1] AS BIGINT) AS r1, CAST({R2}[gate + 1] AS BIGINT) AS r2,
  k AS lde, case_num, count(*) AS n FROM sp GROUP BY 1, 2, 3, 4, 5""",
)

# Both levels go through one class CTE, so that their keys compare.
ORACLES["level_anti_prior"] = query(
    _STEPPED
    + ","
    + fold("customer_words", "o_custkey", "cm")
    + ", both_levels AS (SELECT k, A, B FROM sp UNION ALL SELECT k, A, B FROM cm), "
    + classes("both_levels", "bc"),
    """SELECT lde, case_num, count(*) AS n_classes FROM (
  SELECT DISTINCT k AS lde, case_num, key FROM sp JOIN bc USING (k, A, B)
  WHERE (k, key) NOT IN (SELECT (k, key) FROM cm JOIN bc USING (k, A, B))) GROUP BY 1, 2""",
)

# --- targets, sets, products ------------------------------------------------

_CUSTOMER_TARGETS = """
SELECT case_num, min((int_plane, sqrt2_plane)) AS p FROM {src} WHERE case_num <> 0 GROUP BY 1
"""
_UNPACK = "SELECT case_num, p[1] AS int_plane, p[2] AS sqrt2_plane FROM loaded"
_LEAST = """
SELECT case_num, int_plane, sqrt2_plane FROM (
  SELECT *, row_number() OVER (PARTITION BY case_num ORDER BY int_plane, sqrt2_plane) AS rn
  FROM {src} WHERE case_num <> 0) WHERE rn = 1
"""
ORACLES["target_load"] = query(CUSTOMERS_P, _LEAST.format(src="cp"))
ORACLES["target_semi_join"] = query(
    ORDERS_P + ", " + MONTHS_P,
    """SELECT case_num, count(*) AS n_words FROM op
WHERE case_num <> 0 AND EXISTS (SELECT 1 FROM mp WHERE mp.case_num = op.case_num) GROUP BY 1""",
)
ORACLES["target_orbit_match"] = query(
    ORDERS_P + ", " + CUSTOMERS_P + ", " + orbit_keys("op", "ok") + ", " + orbit_keys("cp", "ck"),
    """SELECT case_num, count(*) AS n_words FROM ok
WHERE case_num <> 0 AND orbit IN (SELECT orbit FROM ck WHERE case_num <> 0) GROUP BY 1""",
)
ORACLES["target_witness"] = query(
    ORDERS_P,
    """SELECT t, case_num, array_to_string(gates, ' ') AS circuit FROM (
  SELECT CAST(len(gates) AS BIGINT) AS t, case_num, min(gates) AS gates
  FROM op WHERE len(gates) > 0 AND case_num <> 0 GROUP BY 1, 2)""",
)
ORACLES["target_delete"] = query(
    ORDERS_P + ", " + CUSTOMERS_P + ", " + orbit_keys("op", "ok") + ", " + orbit_keys("cp", "ck"),
    """SELECT case_num, int_plane, sqrt2_plane FROM (
  SELECT *, row_number() OVER (PARTITION BY orbit ORDER BY int_plane, sqrt2_plane, case_num) AS rn
  FROM ok WHERE case_num <> 0 AND orbit NOT IN (SELECT orbit FROM ck WHERE case_num <> 0)) WHERE rn = 1""",
)
ORACLES["circuit_delete"] = ORACLES["target_delete"]
ORACLES["set_difference"] = query(
    ORDERS_P + ", " + CUSTOMERS_P,
    "SELECT int_plane, sqrt2_plane FROM op EXCEPT SELECT int_plane, sqrt2_plane FROM cp",
)
ORACLES["top_with_ties"] = query(
    ORDERS_P,
    """SELECT case_num, l_orderkey, k AS lde FROM (
  SELECT *, rank() OVER (PARTITION BY case_num ORDER BY k DESC) AS r FROM op) WHERE r = 1""",
)
ORACLES["coset_filter"] = query(
    patterned(
        "tagged",
        CUSTOMER_WORDS
        + """, tagged AS (
  SELECT legacy, list_append(gates, 0) AS gates
  FROM customer_words CROSS JOIN (SELECT range AS legacy FROM range(2))
  WHERE gates[-1] <> 0 AND (legacy = 0 OR gates[-1] <> 10))""",
        "legacy",
        "tp",
    ),
    "SELECT legacy, k AS lde, case_num, count(*) AS n FROM tp GROUP BY 1, 2, 3",
)
ORACLES["coset_index"] = query(
    CUSTOMER_WORDS,
    """SELECT row_number() OVER (ORDER BY gates) - 1 AS idx, array_to_string(gates, ' ') AS circuit
FROM (SELECT DISTINCT gates FROM customer_words WHERE gates[-1] <> 0)""",
)
NATION_WORDS = """
nation_slots AS (
  SELECT c_nationkey, c_mktsegment AS slot, min(c_custkey) % 15 AS g FROM customer GROUP BY 1, 2),
nation_words AS (
  SELECT c_nationkey, list(g ORDER BY slot) AS gates FROM nation_slots GROUP BY 1)
"""
ORACLES["free_multiply_customers"] = query(
    NATION_WORDS
    + ","
    + patterned(
        "made",
        CUSTOMER_WORDS
        + """, made AS (
  SELECT list_concat(s.gates, g.gates, [0]) AS gates
  FROM (SELECT DISTINCT gates FROM customer_words) s
  CROSS JOIN (SELECT DISTINCT gates FROM nation_words WHERE gates[-1] <> 0) g)""",
        "1 AS one",
        "fp",
    ).replace("SELECT 1 AS one, gates, i + 1", "SELECT one, gates, i + 1").replace(
        "SELECT 1 AS one, gates, CAST", "SELECT one, gates, CAST"
    ),
    "SELECT k AS lde, case_num, count(*) AS n FROM fp GROUP BY 1, 2",
)


ORACLES["free_multiply"] = query(
    NATION_WORDS
    + ","
    + patterned(
        "made",
        ORDER_WORDS
        + """, made AS (
  SELECT list_concat(s.gates, g.gates, [0]) AS gates
  FROM (SELECT DISTINCT gates FROM nation_words) s
  CROSS JOIN (SELECT DISTINCT gates FROM order_words WHERE gates[-1] <> 0) g)""",
        "1 AS one",
        "fp",
    ).replace("SELECT 1 AS one, gates, i + 1", "SELECT one, gates, i + 1").replace(
        "SELECT 1 AS one, gates, CAST", "SELECT one, gates, CAST"
    ),
    "SELECT k AS lde, case_num, count(*) AS n FROM fp GROUP BY 1, 2",
)


def searched(start: str, depth: int) -> str:
    """CTEs lv1..lv<depth> (t, gates, k, A, B, case_num, key): one matrix per class that
    is reached first by that many gates from those of lv0, a CTE with gates, k, A, B, key."""
    parts = []
    for t in range(1, depth + 1):
        words = f"""nx{t} AS (
  SELECT DISTINCT list_append(gates, g) AS gates
  FROM lv{t - 1} CROSS JOIN (SELECT range AS g FROM range(15)))"""
        stepped = patterned(f"nx{t}", words, "len(gates) AS n", f"np{t}")
        stepped = stepped.replace("SELECT len(gates) AS n, gates, i + 1", "SELECT n, gates, i + 1").replace(
            "SELECT len(gates) AS n, gates, CAST", "SELECT n, gates, CAST"
        )
        old = " UNION ALL ".join(f"SELECT k, key FROM lv{p}" for p in range(max(0, t - 2), t))
        parts.append(
            stepped
            + ", "
            + classes(f"np{t}", f"nc{t}")
            + f""",
lv{t} AS MATERIALIZED (
  SELECT {t} AS t, gates, k, A, B, case_num, key FROM (
    SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY gates) AS rn
    FROM np{t} JOIN nc{t} USING (k, A, B) WHERE (k, key) NOT IN ({old})) WHERE rn = 1)"""
        )
    return start + ", " + ", ".join(parts)


#: All eight cases are met by six gates from the identity.
DEPTH = 6
_IDENTITY = (
    patterned("none", "none AS (SELECT 1 AS one, []::BIGINT[] AS gates)", "one", "ip") + ", " + classes("ip", "ic")
    + ", lv0 AS MATERIALIZED (SELECT gates, k, A, B, key FROM ip JOIN ic USING (k, A, B))"
)
_REACHED = " UNION ALL ".join(f"SELECT t, case_num FROM lv{t}" for t in range(1, DEPTH + 1))
ORACLES["search_first_level"] = query(
    ORDERS_P + ", " + searched(_IDENTITY, DEPTH),
    f"""SELECT case_num, CAST(min(t) AS BIGINT) AS t FROM ({_REACHED})
WHERE case_num IN (SELECT case_num FROM op WHERE case_num <> 0) GROUP BY 1""",
)
_CUSTOMER_ROOTS = (
    CUSTOMERS_P + ", " + classes("cp", "rc")
    + """, lv0 AS MATERIALIZED (SELECT gates, k, A, B, key FROM (
  SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY gates) AS rn FROM cp JOIN rc USING (k, A, B)) WHERE rn = 1)"""
)
ORACLES["search_from_customers"] = query(
    searched(_CUSTOMER_ROOTS, 2),
    """SELECT CAST(t AS BIGINT) AS t, k AS lde, case_num, count(*) AS n_classes
FROM (SELECT t, k, case_num FROM lv1 UNION ALL SELECT t, k, case_num FROM lv2) GROUP BY 1, 2, 3""",
)

ORACLES["target_bloom_match"] = ORACLES["target_orbit_match"]
ORACLES["pattern_source_scan"] = ORACLES["pattern_text_scan"]
