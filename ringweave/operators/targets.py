"""Target patterns: load, match, record, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.functions import gates, patterns
from ringweave.functions.bits import pin
from ringweave.functions.matrices import NARROW, Lanes
from ringweave.functions.patterns import Pattern
from ringweave.operators import blooms
from ringweave.operators.words import with_matrix, with_pattern

# What makes two targets the same target.
CASE, ORBIT = "case", "orbit"


def match_column(match: str):
    """Key column of the match mode, from int_plane and sqrt2_plane (or case_num)."""
    if match == CASE:
        return F.col("case_num")
    if match == ORBIT:
        return patterns.orbit_key(Pattern.field())
    raise ValueError(f"match must be {CASE!r} or {ORBIT!r}, not {match!r}")


def build_targets(parsed: DataFrame, match: str = CASE) -> DataFrame:
    """Distinct targets from rows with int_plane and sqrt2_plane.

    Case 0 is dropped. One row per key, the least pattern of it. With
    ``match='case'`` there are at most eight rows whatever the input.
    """
    with_case = parsed.select("int_plane", "sqrt2_plane").withColumn(
        "case_num", patterns.case_num(Pattern.field())
    )
    keyed = with_case.where("case_num <> 0").withColumn("target_key", match_column(match))
    least = keyed.groupBy("target_key").agg(F.min(patterns.packed(Pattern.field())).alias("p"))
    ints, roots = patterns.unpacked(F.col("p"))
    planes = least.select("target_key", pin(ints).alias("int_plane"), pin(roots).alias("sqrt2_plane"))
    return planes.withColumn("case_num", patterns.case_num(Pattern.field()))


def _keys(targets: DataFrame, match: str) -> DataFrame:
    keys = targets.select("target_key")
    # Eight case numbers at most: a proven bound. Orbit keys are left to Catalyst.
    return F.broadcast(keys) if match == CASE else keys


def matching(rows: DataFrame, targets: DataFrame, match: str = CASE, n_targets: int | None = None) -> DataFrame:
    """Rows whose pattern is an open target (left semi join). Adds ``target_key``.

    With ``n_targets``, the number of open targets, orbit keys are first held against a Bloom
    filter of the open ones where one of bounded size can be made, so that few of the other
    rows reach the join's shuffle.
    """
    keyed = rows.withColumn("target_key", match_column(match))
    bits = blooms.size_for(n_targets) if match == ORBIT and n_targets is not None else None
    if bits:
        keyed = keyed.withColumn("target_key", pin(F.col("target_key")))
        keyed = keyed.where(blooms.might_hold(blooms.build(targets, "target_key", bits), F.col("target_key"), bits))
    return keyed.join(_keys(targets, match), "target_key", "left_semi")


def witnesses(hits: DataFrame, t: int, coded: bool = False) -> DataFrame:
    """One row per matched target: t, case_num and the least circuit.

    Each map task first reduces its hits to one per target. ``coded``: words have at most
    fifteen gates, so that the least is found by their codes and without a sort.
    """
    if coded:
        word = gates.word_code(F.col("gates")).cast("decimal(38,0)") * 16 + F.col("case_num")
        least = hits.groupBy("target_key").agg(F.min(word).alias("w"))
        code = F.call_function("div", F.col("w"), F.lit(16)).cast("bigint")
        w = least.select("target_key", gates.code_word(code).alias("gates"), (F.col("w") % 16).alias("case_num"))
    else:
        best = hits.groupBy("target_key").agg(F.min(F.struct("gates", "case_num")).alias("w"))
        w = best.select("target_key", "w.*")
    return w.select(
        F.lit(t).cast("int").alias("t"),
        F.col("case_num").cast("int").alias("case_num"),
        gates.word_text(F.col("gates")).alias("circuit"),
        "target_key",
    )


def delete_matched(targets: DataFrame, found: DataFrame, match: str = CASE) -> DataFrame:
    """Targets that no witness has matched (left anti join)."""
    return targets.join(_keys(found, match), "target_key", "left_anti")


def delete_by_circuits(
    circuits: DataFrame, targets: DataFrame, match: str = CASE, lanes: Lanes = NARROW
) -> DataFrame:
    """Targets left after every circuit (rows with ``gates``) has deleted the one it reaches.

    Circuits are reduced to the distinct targets they reach before the join, so a
    target that very many circuits reach is one row there.
    """
    reached = with_pattern(with_matrix(circuits.select("gates").distinct(), lanes), lanes)
    hits = matching(reached, targets, match).select("target_key").distinct()
    return delete_matched(targets, hits, match)
