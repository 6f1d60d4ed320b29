"""Normal forms of words, and products with multiplicities."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from ringweave.functions import gates
from ringweave.operators import products
from ringweave.operators.words import with_matrix


def _commute(g, h):
    return not set(gates.PAIRS[g]) & set(gates.PAIRS[h])


def _swaps(word):
    """All words that swaps of commuting neighbours reach."""
    seen, todo = {word}, [word]
    while todo:
        w = todo.pop()
        for i in range(len(w) - 1):
            if _commute(w[i], w[i + 1]):
                v = w[:i] + (w[i + 1], w[i]) + w[i + 2 :]
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
    return seen


def test_normal_word_is_the_least_of_its_swaps(spark):
    rng = random.Random(5)
    words = [(), (3,)] + [tuple(rng.choices(range(15), k=rng.randint(2, 7))) for _ in range(150)]
    words += [tuple(rng.choices((0, 9, 14), k=6)) for _ in range(10)]
    df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, gates array<tinyint>")
    for r in df.select("i", gates.normal_word(F.col("gates")).alias("n")).collect():
        assert tuple(r.n) == min(_swaps(words[r.i]))


@pytest.mark.parametrize("generators", [[[0, 9], [9, 0], [9, 0, 3]], [[1], [1, 2, 3, 4]], [[0, 14, 9], [14, 9, 0], [9]]])
def test_counted_products_count_every_pair(spark, generators):
    stored = [[0], [9, 0], [0, 9], [3, 4, 5]]
    pairs = [(s + g,) for s, g in product(stored, generators)]
    want = with_matrix(spark.createDataFrame(pairs, "gates array<tinyint>")).groupBy("m").count()
    one = F.lit(1).cast("bigint").alias("n")
    left = with_matrix(spark.createDataFrame([(s,) for s in stored], "gates array<tinyint>")).select("m", one)
    made, steps = products.counted_products(left, spark.createDataFrame([(g,) for g in generators], "gates array<tinyint>").select("gates", one))
    assert sorted((str(r.m), r.n) for r in made.collect()) == sorted((str(r.m), r["count"]) for r in want.collect())
    # [9, 0] and [0, 9] are one matrix and one path.
    assert steps[0] == 3 * len({min(_swaps(tuple(g)))[0] for g in generators})


def test_no_generators_raise(spark):
    none = spark.createDataFrame([], "gates array<tinyint>, n bigint")
    with pytest.raises(ValueError, match="empty"):
        products.counted_products(with_matrix(spark.createDataFrame([([0],)], "gates array<tinyint>")).withColumn("n", F.lit(1)), none)
