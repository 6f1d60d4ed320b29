"""Whole batches as arrays against the expressions and operators they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave.functions import canonical, matrices, patterns
from ringweave.operators import orbits, products
from ringweave.operators.words import with_matrix, with_pattern
from ringweave.plans import queries

WORDS = [random.Random(i).choices(range(15), k=i % 8) for i in range(60)] + [[0] * 7, [14], []]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "k bigint, gates array<tinyint>").repartition(3)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("made", ["random", "equal rows", "empty rows"])
def test_orbit_digests(spark, made):
    rng = random.Random(made)
    mask = {"random": patterns.FULL, "equal rows": sum(patterns.COLUMN_MASKS[::2]), "empty rows": sum(patterns.ROW_MASKS[:3])}[made]
    full = lambda: rng.choice(patterns.COLUMN_MASKS) | rng.choice(patterns.COLUMN_MASKS)
    plane = (lambda: full() & mask) if made == "equal rows" else (lambda: rng.getrandbits(36) & mask)
    rows = spark.createDataFrame([(i, plane(), plane()) for i in range(4)] + [(9, 0, 0)], "k bigint, int_plane bigint, sqrt2_plane bigint")
    want = orbits.orbit(rows, "k").groupBy("k").agg(
        F.count(F.lit(1)), F.min("int_plane"), F.bit_xor("sqrt2_plane"), F.sum(F.col("sqrt2_plane") % 1000003)
    )
    assert _rows(orbits.orbit_digests(rows, 1000003).select("k", *orbits.DIGESTS)) == _rows(want)


def test_products_of_words(words):
    other = words.select((F.lit(len(WORDS) - 1) - F.col("k")).alias("k"), F.col("gates").alias("right"))
    paired = words.join(other, "k").withColumnRenamed("gates", "left")
    got = products.word_products(paired, "left", "right").select("k", "lde", "int_plane", "sqrt2_plane")
    both = with_matrix(paired.withColumnRenamed("left", "gates")).withColumnRenamed("m", "l")
    both = with_matrix(both.drop("gates").withColumnRenamed("right", "gates"))
    want = with_pattern(both.select("k", matrices.product("l", "m").alias("m"))).select("k", "lde", "int_plane", "sqrt2_plane")
    assert _rows(got) == _rows(want)


def test_wrong_words_raise(spark):
    for word in ([15], [3] * 101):
        rows = spark.createDataFrame([(word, [0])], "left array<tinyint>, right array<tinyint>")
        with pytest.raises(Exception, match="gate number|too long"):
            products.word_products(rows, "left", "right").collect()


def test_products_of_two_sets(words):
    got = products.counted_planes(words, words.where("k % 4 = 0").select("gates"))
    right = with_matrix(words.where("k % 4 = 0")).select(F.col("m").alias("r"))
    pairs = with_matrix(words).crossJoin(right).select(matrices.product("m", "r").alias("m"))
    want = with_pattern(pairs).groupBy("lde", "int_plane").count()
    assert _rows(got.groupBy("lde", "int_plane").agg(F.sum("n"))) == _rows(want)


def test_signatures_of_words(words):
    got = products.word_signatures(words).groupBy("lde", "signature").agg(F.sum("n").alias("n"))
    want = with_matrix(words).groupBy(F.expr("m.k").alias("lde"), canonical.signature("m").alias("s")).count()
    assert _rows(got.select("lde", "n")) == _rows(want.select("lde", "count"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_jobs_make_few_rows(spark, sf):
    """No row per orbit member, no matrix of expressions per order, votes per distinct word only."""
    assert "Generate" not in _plan(queries.pattern_orbit(spark, sf))
    for query in (queries.matrix_product, queries.canonical_signatures, queries.free_multiply):
        assert "rw_m" not in _plan(query(spark, sf))
    plan = _plan(queries.majority_votes(spark, sf))
    assert plan.index("Join") < plan.index("decisive") and "Aggregate [gates" in plan
