"""What the plans of levels, targets, orbits and maxima do not contain."""

import re

import pytest
from pyspark.sql import functions as F

from ringweave.functions import gates
from ringweave.operators import levels, orbits, sets, targets
from ringweave.operators.words import with_matrix, with_pattern
from ringweave.plans import queries
from ringweave.plans.config import SearchConfig
from ringweave.plans.search import search
from ringweave.session import materialise_bucketed


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _words(spark, n=40):
    words = [([i % 15, (i * 7) % 15, (i * 4 + 1) % 15],) for i in range(n)]
    return with_matrix(spark.createDataFrame(words, "gates array<tinyint>").distinct())


@pytest.mark.parametrize("word", [[], [0], [14], [0, 0], [14] * 15, list(range(15)), [1, 2, 3]])
def test_codes_round_trip(spark, word):
    df = spark.createDataFrame([(word,)], "gates array<tinyint>").select(gates.word_code(F.col("gates")).alias("c"))
    assert df.select(gates.code_word(F.col("c"))).first()[0] == word


def test_codes_order_as_words(spark):
    words = [[], [0], [0, 0], [0, 14], [1], [1, 0], [14, 3], [14, 14]]
    df = spark.createDataFrame([(w,) for w in words], "gates array<tinyint>")
    codes = [r[0] for r in df.orderBy("gates").select(gates.word_code(F.col("gates"))).collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(words)
    longer = df.where("size(gates) = 2").select(gates.extend_code(gates.word_code(F.col("gates")), F.lit(2), F.lit(5)).alias("c"))
    assert all(r[0][-1] == 5 and len(r[0]) == 3 for r in longer.select(gates.code_word(F.col("c"))).collect())


def test_too_long_a_word_has_no_code(spark):
    df = spark.createDataFrame([([0] * 16,)], "gates array<tinyint>")
    with pytest.raises(Exception, match="more than fifteen"):
        df.select(gates.word_code(F.col("gates"))).collect()


def test_classes_by_code_are_the_classes_by_word(spark):
    keyed = levels.with_key(_words(spark))
    old = {bytes(r.canon_key): (r.gates, r.m, r.coset_word) for r in levels.one_per_class(keyed.select("canon_key", "gates", "m")).collect()}
    new = {bytes(r.canon_key): (r.gates, r.m, r.coset_word) for r in levels.one_per_class_of_words(keyed).collect()}
    assert old == new


def test_a_level_has_one_exchange_and_no_sort_aggregate(spark):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = levels.one_per_class_of_words(levels.with_key(_words(spark)))
    current = materialise_bucketed(classes, "plan-test/level=0", "canon_key", buckets)
    prior = materialise_bucketed(classes.limit(3), "plan-test/level=1", "canon_key", buckets)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(with_pattern(levels.next_level_of_words(current, prior)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"\bExchange\b", text)) == 1
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_levels_by_code_are_the_levels_by_word(spark):
    current = levels.one_per_class_of_words(levels.with_key(_words(spark, 12)))
    columns = ["canon_key", "gates", "m", "coset_word"]
    old = levels.next_level(current.select("canon_key", "gates", "m"), current).select(columns)
    new = levels.next_level_of_words(current, current).select(columns)
    key = lambda rows: sorted((bytes(r[0]), r[1], r[2], r[3] or []) for r in rows)
    assert key(old.collect()) == key(new.collect())


def test_search_leaves_no_tables_and_long_words_take_the_other_path(spark):
    before = {t.name for t in spark.catalog.listTables()}
    result = search(spark, SearchConfig(target=2, root="0 9 " * 7))  # fourteen gates and two more
    assert [r.new_classes for r in result.reports] and {t.name for t in spark.catalog.listTables()} - before
    result.discard(spark)
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_targets_and_witnesses_aggregate_by_hash(spark):
    rows = with_pattern(_words(spark))
    for mode in (targets.CASE, targets.ORBIT):
        built = targets.build_targets(rows, mode)
        assert "SortAggregate" not in plan(built)
        hits = targets.matching(rows, built, mode)
        coded, plain = targets.witnesses(hits, 3, True), targets.witnesses(hits, 3)
        assert "SortAggregate" not in plan(coded)
        assert sorted(map(str, coded.drop("target_key").collect())) == sorted(map(str, plain.drop("target_key").collect()))


def test_orbits_are_listed_without_a_shuffle(spark):
    rows = [(i, r.int_plane, r.sqrt2_plane) for i, r in enumerate(with_pattern(_words(spark, 8)).collect())]
    made = orbits.orbit(spark.createDataFrame(rows, "k int, int_plane bigint, sqrt2_plane bigint"), "k")
    assert "Exchange" not in plan(made)
    assert made.count() == made.distinct().count()


def test_top_with_ties_scans_its_input_once(spark, sf):
    text = plan(queries.top_with_ties(spark, sf))
    assert "lineitem" not in text  # what it reads is what its one pass has written


def test_top_with_ties_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(sets, "KNOWN_GROUPS", 3)
    rows = [(i % 7 if i % 11 else None, (i * 37) % 50 if i % 13 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(3)
    best = {}
    for g, v, _ in rows:
        if g is not None and v is not None:
            best[g] = max(best.get(g, v), v)
    want = sorted(i for g, v, i in rows if g is not None and best[g] == v)
    assert sorted(r.id for r in sets.top_with_ties(df, ["g"], "v").collect()) == want


@pytest.mark.parametrize("parts", [1, 5])
def test_dense_index_has_no_gaps(spark, parts):
    df = spark.range(0, 1000, 3).withColumn("x", F.xxhash64("id")).repartition(parts)
    for _ in range(2):
        rows = sets.dense_index(df, ["x"]).orderBy("x").collect()
        assert [r.idx for r in rows] == list(range(len(rows)))
    assert sets.dense_index(df.where("id < 0"), ["x"]).count() == 0
