"""The fifteen gates and the words (circuits) written in them.

Gate g acts on the row pair number g in the list (0,1), (0,2), ... (4,5). A word
is an ARRAY<TINYINT> of gates in application order: the first gate is applied
first, so it is the rightmost matrix factor.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.functions.bits import let, lit64, require, shl, shr, shru

PAIRS = list(combinations(range(6), 2))
N_GATES = len(PAIRS)
FIRST_ROWS = [p for p, _ in PAIRS]
SECOND_ROWS = [q for _, q in PAIRS]


def gate_rows(gate: Column) -> tuple[Column, Column]:
    """The two rows a gate mixes."""
    table = lambda rows: F.array(*[F.lit(r) for r in rows])
    return F.get(table(FIRST_ROWS), gate), F.get(table(SECOND_ROWS), gate)


def gate_catalog(spark: SparkSession) -> DataFrame:
    """gate, r1, r2 for all fifteen gates."""
    g = spark.range(N_GATES).select(F.col("id").cast("int").alias("gate"))
    r1, r2 = gate_rows(F.col("gate"))
    return g.select("gate", r1.alias("r1"), r2.alias("r2"))


def all_gates() -> Column:
    """Array literal 0..14, to be exploded: the bounded fan-out of one search step."""
    return F.sequence(F.lit(0), F.lit(N_GATES - 1))


def word_text(gates: Column) -> Column:
    """Gates separated by single blanks, in application order."""
    return F.array_join(gates.cast("array<string>"), " ")


def parse_word(text: Column, strict: bool = True) -> Column:
    """Inverse of ``word_text``; surplus white space is ignored.

    A token that is not a gate number fails the query, or makes the word null
    when ``strict`` is false.
    """
    # What remains without gate numbers and white space is what should not be there.
    good = F.regexp_replace(text, r"\b(\d|1[0-4])\b|\s", "") == ""
    tokens = F.split(F.when(good, text), r"\s+")
    word = F.filter(tokens, lambda t: t != "").cast("array<tinyint>")
    if strict:
        return require(good, word, "a circuit line holds something other than gates 0..14")
    return word


def append(gates: Column, gate: Column) -> Column:
    return F.array_append(gates, gate.cast("tinyint"))


# Bit h of entry g: gates g and h share a row, so their order matters.
_BOUND = [sum(1 << h for h, q in enumerate(PAIRS) if set(p) & set(q)) for p in PAIRS]


def normal_word(gates: Column) -> Column:
    """The least word that swaps of neighbouring gates on different rows make of ``gates``.

    Such gates commute, so words with one normal form have one matrix. Gates are put in one
    after the other: each goes left past gates it commutes with, to before the first greater one.
    """
    bound = F.array(*[F.lit(b) for b in _BOUND])

    def put(word: Column, gate: Column) -> Column:
        def place(wall: Column) -> Column:
            ends = F.transform(word, lambda h, i: F.when((i > wall) & (h > gate), i).otherwise(F.size(word)))
            return let(
                F.coalesce(F.array_min(ends), F.lit(0)),
                lambda at: F.concat(F.slice(word, 1, at), F.array(gate), F.slice(word, at + 1, F.size(word) - at)),
            )

        mask = F.get(bound, gate.cast("int"))
        walls = F.transform(word, lambda h, i: F.when(shr(mask, h.cast("int")).bitwiseAND(F.lit(1)) == 1, i).otherwise(-1))
        return let(F.coalesce(F.array_max(walls), F.lit(-1)), place)

    return F.aggregate(gates, F.array().cast("array<tinyint>"), put)


# Codes 1..15 of the gates as hexadecimal digits.
_DIGITS = "123456789ABCDEF"
_SWAP_PAIRS = ("(.)(.)", "$2$1")


def pack_word(gates: Column) -> Column:
    """BINARY with two gates per byte, each stored as gate+1, earlier gate in the low half."""
    codes = F.array_join(
        F.transform(gates, lambda g: F.substring(F.lit(_DIGITS), g.cast("int") + 1, F.lit(1))), ""
    )
    padded = F.concat(codes, F.when(F.size(gates) % 2 == 1, "0").otherwise(""))
    return F.unhex(F.regexp_replace(padded, *_SWAP_PAIRS))


#: Gates that fit a BIGINT code.
CODE_GATES = 15


def word_code(gates: Column) -> Column:
    """BIGINT of a word of at most fifteen gates that orders as the words themselves do.

    Four bits per gate, gate+1 each, the first gate highest. A BIGINT minimum is aggregated
    by hash; a minimum of arrays would sort.
    """
    digit = lambda g, i: shl((g + 1).cast("bigint"), 56 - i.cast("int") * 4)
    code = F.aggregate(F.transform(gates, digit), lit64(0), lambda a, x: a + x)
    return require(F.size(gates) <= CODE_GATES, code, "a word of more than fifteen gates has no code")


def extend_code(code: Column, n_gates: Column, gate: Column) -> Column:
    """Code of a word of ``n_gates`` gates with one more."""
    longer = code.bitwiseOR(shl((gate + 1).cast("bigint"), 56 - n_gates * 4))
    return require(n_gates < CODE_GATES, longer, "a word of more than fifteen gates has no code")


def code_word(code: Column) -> Column:
    """Inverse of ``word_code``."""
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(CODE_GATES - 1)),
        lambda i: (shru(code, 56 - i * 4).bitwiseAND(lit64(15)) - 1).cast("tinyint"),
    )
    return F.when(code.isNotNull(), F.filter(digits, lambda g: g >= 0))


def unpack_word(packed: Column) -> Column:
    """Inverse of ``pack_word``."""
    codes = F.split(F.regexp_replace(F.hex(packed), *_SWAP_PAIRS), "")
    return F.transform(
        F.filter(codes, lambda c: (c != "0") & (c != "")),
        lambda c: (F.instr(F.lit(_DIGITS), c) - 1).cast("tinyint"),
    )
