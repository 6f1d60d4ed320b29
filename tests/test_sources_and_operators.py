import pytest
from pyspark.sql import functions as F

from ringweave.functions import signs
from ringweave.operators import sets
from ringweave.operators.words import slot_words
from ringweave.sources.lines import circuit_lines, csv_pattern_lines, packed_circuits, pattern_lines
from ringweave.sources.sinks import duration_text
from ringweave.streaming import replay as stream


def _lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_malformed_lines_fail_or_drop(spark):
    good = "10" * 36
    with pytest.raises(Exception, match="72 characters"):
        pattern_lines(_lines(spark, good, "10")).collect()
    assert pattern_lines(_lines(spark, good, "10"), strict=False).count() == 1
    with pytest.raises(Exception, match="36 values"):
        csv_pattern_lines(_lines(spark, "1,2")).collect()
    with pytest.raises(Exception, match="0..14"):
        circuit_lines(_lines(spark, "0 15")).collect()
    assert circuit_lines(_lines(spark, " 3  4 ", "x"), strict=False).collect()[0].gates == [3, 4]


def test_other_characters_count_as_zero(spark):
    a, b = pattern_lines(_lines(spark, "1x" * 36, "10" * 36)).collect()
    assert a == b and a.int_plane == (1 << 36) - 1 and a.sqrt2_plane == 0


def test_csv_and_text_agree(spark):
    csv = csv_pattern_lines(_lines(spark, ",".join(str(i % 4) for i in range(36)))).first()
    text = pattern_lines(_lines(spark, "".join(f"{i % 4:02b}" for i in range(36)))).first()
    assert csv == text


def test_packed_circuits(spark):
    df = spark.createDataFrame([(bytearray([0x21, 0x0F]),)], "p binary")
    assert packed_circuits(df, "p").first().gates == [0, 1, 14]


def test_hot_key_words_are_whole(spark):
    """One key with most rows, in shuffled order, still gives its exact word."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 100).alias("k"),
        (F.col("id") % 5).alias("slot"),
        (F.lit(90_000) - F.col("id")).alias("v"),
    )
    words = slot_words(rows, ["k"], F.col("slot"), F.col("v"), range(5))
    least = {}
    for i in range(60_000):
        k = 7 if i % 3 > 0 else i % 100
        key = (k, i % 5)
        least[key] = min(least.get(key, 1 << 60), 90_000 - i)
    for r in words.collect():
        assert list(r.gates) == [least[r.k, s] % 15 for s in range(5) if (r.k, s) in least]


def test_unknown_slots_fail_instead_of_vanishing(spark):
    rows = spark.createDataFrame([(1, 9, 3)], "k int, slot int, v int")
    with pytest.raises(Exception, match="declared list"):
        slot_words(rows, ["k"], F.col("slot"), F.col("v"), range(5)).collect()


def test_difference_and_ties(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "x int")
    b = spark.createDataFrame([(2,), (2,)], "x int")
    assert sorted(r.x for r in sets.difference(a, b, ["x"]).collect()) == [1, 3]
    t = spark.createDataFrame([("p", 1), ("p", 4), ("p", 4), ("q", 0)], "g string, v int")
    assert sorted(map(tuple, sets.top_with_ties(t, ["g"], "v").collect())) == [("p", 4), ("p", 4), ("q", 0)]


def test_sign_masks(spark):
    df = spark.range(1).select(F.lit(signs.ALL_POSITIVE).alias("m"))
    m = F.col("m")
    got = df.select(
        signs.text(m),
        signs.text(signs.set_sign(signs.set_sign(m, 1, signs.NEGATIVE), 2, signs.CONFLICT)),
        signs.text(signs.reverse(m)),
        signs.factors(signs.set_sign(m, 5, signs.NEGATIVE)),
        F.size(signs.row_choices()),
        F.size(F.array_distinct(signs.row_choices())),
    ).first()
    assert list(got) == ["++++++", "+-¿+++", "------", [1, 1, 1, 1, 1, -1], 32, 32]


def test_duration_text():
    assert [duration_text(x) for x in (850, 12_345, 186_000, 5_400_000, 172_800_000)] == [
        "0:00:00.850",
        "0:00:12.345",
        "0:03:06.000",
        "1:30:00.000",
        "48:00:00.000",
    ]


def test_streaming_replay_equals_batch(spark, tmp_path):
    circuits = ["0", "0 9", "9 0", "0 1 6", ""]
    folder = str(tmp_path / "in")
    _lines(spark, *circuits).coalesce(1).write.text(folder)
    batch = sorted(map(tuple, stream.replay(_lines(spark, *circuits)).collect()))
    for name, plan in (
        ("all_lines", stream.replay(stream.stream_lines(spark, folder))),
        ("first_lines", stream.first_of_each_case(stream.replay(stream.stream_lines(spark, folder)))),
    ):
        query = (
            plan.writeStream.format("memory")
            .queryName(name)
            .option("checkpointLocation", str(tmp_path / name))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("all_lines").collect())) == batch
    assert sorted(r.case_num for r in spark.table("first_lines").collect()) == [1, 2, 5]


def test_key_filters_reach_the_scan_below_derived_columns(spark, sf):
    from ringweave.plans.queries import order_patterns

    plan = order_patterns(spark, sf).where("l_orderkey = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,5)]" in plan
    assert plan.count("aggregate(") == 1  # the replay is not copied
