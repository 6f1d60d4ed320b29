"""Row and column classes of matrices, and sign votes over them.

All functions work on ``cells``, the 36 entries of ``matrices.entries`` in column
order. A matrix has six rows and six columns, so its grouping happens inside its
own row of the table: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.functions import matrices, signs
from ringweave.functions.bits import pin
from ringweave.functions.matrices import NARROW, Lanes

_SIX = "sequence(0, 5)"


def with_cells(df: DataFrame, lanes: Lanes = NARROW) -> DataFrame:
    """Adds ``cells``, the entries of ``m`` in lowest terms."""
    return df.withColumn("cells", pin(matrices.entries("m", lanes)))


def lines(cells: str, by_row: bool) -> Column:
    """ARRAY of six lines, each an ARRAY<STRUCT<a, b, e>>."""
    at = "6 * j + i" if by_row else "6 * i + j"
    cell = f"get({cells}, {at})"
    return F.expr(
        f"transform({_SIX}, i -> transform({_SIX}, j -> "
        f"named_struct('a', {cell}.a, 'b', {cell}.b, 'e', {cell}.e)))"
    )


def magnitudes(line: str) -> str:
    """SQL text: the sorted absolute entries of a line."""
    return (
        f"array_sort(transform({line}, x -> "
        "if(x.a < 0, named_struct('a', -x.a, 'b', -x.b, 'e', x.e), x)))"
    )


def equivalence_classes(df: DataFrame, key: str, by_row: bool) -> DataFrame:
    """(key, entries, members): the lines of each matrix grouped by their entry multiset.

    Needs ``cells``. ``entries`` is the text of the sorted absolute entries.
    """
    text = f"array_join(transform({magnitudes('l')}, x -> concat(x.a, ',', x.b, 'e', x.e)), ' ')"
    keyed = df.select(key, lines("cells", by_row).alias("lines")).select(
        key, pin(F.expr(f"transform(lines, l -> {text})")).alias("texts")
    )
    classes = (
        "transform(array_distinct(texts), t -> named_struct('entries', t, 'members', "
        f"filter({_SIX}, i -> get(texts, i) = t)))"
    )
    return keyed.select(key, F.explode(F.expr(classes)).alias("c")).select(key, "c.*")


def first_row_column_mask(cells: str) -> Column:
    """Column signs implied by a positive row 0: the sign of its entry, unset where zero."""
    code = (
        f"CASE sign(get({cells}, 6 * c).a) WHEN 1 THEN {signs.POSITIVE} "
        f"WHEN -1 THEN {signs.NEGATIVE} ELSE {signs.UNSET} END"
    )
    return F.expr(f"aggregate({_SIX}, 0, (acc, c) -> acc | shiftleft({code}, 2 * c))")


def majority_votes(df: DataFrame, key: str) -> DataFrame:
    """(key, row, sign): the sign most entries of a row vote for.

    Needs ``cells`` and ``col_mask``. An entry votes + when its sign agrees with its
    column's, - otherwise; unset and conflicting columns and zeros do not vote.
    Column classes vote in the order of their (value, count) lists and the first with
    a nonzero balance decides; without one the row stays unset.
    """
    counted = (
        f"transform(array_distinct({magnitudes('l')}), v -> "
        f"named_struct('v', v, 'n', size(filter({magnitudes('l')}, x -> x = v))))"
    )
    staged = (
        df.select(key, "col_mask", "cells", lines("cells", by_row=False).alias("lines"))
        .select(key, "col_mask", "cells", pin(F.expr(f"transform(lines, l -> {counted})")).alias("cls"))
        .withColumn("row", F.explode(F.expr(_SIX)))
    )
    factor = (
        f"CASE shiftright(col_mask, 2 * c) & 3 WHEN {signs.POSITIVE} THEN 1 "
        f"WHEN {signs.NEGATIVE} THEN -1 ELSE 0 END"
    )
    vote = f"if(get(cls, c) = k, int(sign(get(cells, 6 * c + row).a)) * {factor}, 0)"
    balances = (
        "transform(array_sort(array_distinct(cls)), k -> "
        f"aggregate({_SIX}, 0, (acc, c) -> acc + {vote}))"
    )
    decisive = F.expr(f"get(filter({balances}, b -> b <> 0), 0)")
    return staged.select(key, "row", pin(decisive).alias("decisive")).select(
        key,
        "row",
        F.when(F.col("decisive") > 0, signs.POSITIVE)
        .when(F.col("decisive") < 0, signs.NEGATIVE)
        .otherwise(signs.UNSET)
        .alias("sign"),
    )
