"""Bloom filters of open targets, propagated signs, and column subsets."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave.functions import matrices, signs
from ringweave.operators import blooms, targets
from ringweave.operators.words import with_matrix, with_pattern
from ringweave.plans.config import parse_args


@pytest.mark.parametrize("keys", [0, 1, 50, 3000])
def test_a_filter_loses_no_key_and_drops_others(spark, keys):
    held = spark.range(keys).select((F.col("id") * 7).alias("k"))
    bits = blooms.size_for(keys)
    rows = spark.range(0, 40_000).select(F.when(F.col("id") % 100 != 99, F.col("id")).alias("k"))
    kept = rows.where(blooms.might_hold(blooms.build(held, "k", bits), F.col("k"), bits))
    passed = {r.k for r in kept.collect()}
    want = {7 * i for i in range(keys) if 7 * i < 40_000 and (7 * i) % 100 != 99}
    assert want <= passed and None not in passed
    assert len(passed - want) <= 100  # one in four hundred of those that are not held


def test_no_filter_beyond_its_bound():
    assert blooms.size_for(blooms.MOST_BITS // 8) == blooms.MOST_BITS
    assert blooms.size_for(blooms.MOST_BITS // 8 + 1) is None


def test_matching_with_a_filter_gives_the_same_rows(spark):
    words = [([i % 15, (i * 7) % 15, (i * 4 + 1) % 15],) for i in range(60)]
    rows = with_pattern(with_matrix(spark.createDataFrame(words, "gates array<tinyint>")))
    built = targets.build_targets(rows.where("gates[0] < 4"), targets.ORBIT)
    plain = targets.matching(rows, built, targets.ORBIT)
    filtered = targets.matching(rows, built, targets.ORBIT, built.count())
    text = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in text
    assert sorted(map(str, plain.collect())) == sorted(map(str, filtered.collect()))
    assert 0 < plain.count() < rows.count()
    # With nothing open the filter passes nothing on.
    none = built.where("false")
    bits = blooms.size_for(0)
    keyed = rows.withColumn("k", targets.match_column(targets.ORBIT))
    assert keyed.where(blooms.might_hold(blooms.build(none, "target_key", bits), F.col("k"), bits)).count() == 0


def _propagate(spark, grids):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, s array<int>")
    found = df.select("i", signs.propagated(F.col("s")).alias("p")).orderBy("i")
    return found.select(signs.text(F.col("p.row_mask")), signs.text(F.col("p.col_mask")), "p.conflicts").collect()


def test_planted_signs_are_found_without_conflict(spark):
    rng = random.Random(1)
    grids, rows, cols = [], [], []
    for _ in range(30):
        r = [1] + [rng.choice((1, -1)) for _ in range(5)]
        c = [rng.choice((1, -1)) for _ in range(6)]
        shown = [[rng.random() < 0.8 for _ in range(6)] for _ in range(6)]
        grids.append([r[i] * c[j] * shown[i][j] for i in range(6) for j in range(6)])
        rows.append(r)
        cols.append(c)
    for grid, got in zip(grids, _propagate(spark, grids), strict=True):
        assert got[2] == 0
        r = [1 if x == "+" else -1 for x in got[0]]
        for i in range(6):
            for j in range(6):
                if grid[6 * i + j]:
                    assert (1 if got[1][j] == "+" else -1) * r[i] == grid[6 * i + j]


def test_conflicts_are_reported_and_empty_columns_unset(spark):
    clash = [0] * 36
    clash[0] = clash[1] = clash[6] = 1  # rows 0, 1 and columns 0, 1 in one part
    clash[7] = -1
    assert _propagate(spark, [clash, [0] * 36]) == [("+¿++++", "+¿????", 1), ("++++++", "??????", 0)]


def test_text_of_chosen_columns(spark):
    m = with_matrix(spark.createDataFrame([([0, 3, 7],)], "gates array<tinyint>"))
    whole, some = m.select(matrices.text("m").alias("a"), matrices.text("m", columns="array(5, 0, 9)").alias("b")).first()
    want = [" ".join((line.split(" ")[5], line.split(" ")[0])) for line in whole.split("\n")]
    assert some.split("\n") == want


def test_the_suffix_rule_has_a_flag():
    assert parse_args(["--legacy-suffix"]).legacy_suffix and not parse_args([]).legacy_suffix
