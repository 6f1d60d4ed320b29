import random

from pyspark.sql import functions as F

from ringweave.functions import canonical as C
from ringweave.functions import matrices as M
from ringweave.functions.bits import pin
from ringweave.operators import levels
from ringweave.operators.words import with_matrix

import exact


def _frame(spark, words):
    return with_matrix(spark.createDataFrame(list(enumerate(words)), "id long, gates array<tinyint>"))


def _random_words(n, length, seed):
    rng = random.Random(seed)
    return [[rng.randrange(15) for _ in range(rng.randint(1, length))] for _ in range(n)]


def test_key_survives_signed_row_and_column_orders(spark):
    rng = random.Random(21)
    rows = []
    for k, w in enumerate(_random_words(25, 8, seed=20)):
        for _ in range(6):
            shuffled = lambda: rng.sample(range(6), 6)
            signs = lambda: [rng.choice((1, -1)) for _ in range(6)]
            rows.append((k, w, shuffled(), shuffled(), signs(), signs()))
    df = spark.createDataFrame(
        rows,
        "k int, gates array<tinyint>, ro array<int>, co array<int>, rs array<int>, cs array<int>",
    )
    df = with_matrix(df)
    for step in (
        M.permute_rows("m", "ro"),
        M.permute_columns("m", "co"),
        M.apply_signs("m", "rs", "cs"),
    ):
        df = df.withColumn("m", pin(step))
    keyed = df.select("k", C.canonical_key("m").alias("key"), C.signature("m").alias("sig"))
    spread = keyed.groupBy("k").agg(F.countDistinct("key").alias("n"), F.countDistinct("sig").alias("s"))
    assert all(r.n == 1 and r.s == 1 for r in spread.collect())


def test_classes_match_plain_enumeration(spark):
    """Every pair of words: same key exactly when the exhaustive forms agree."""
    words = _random_words(24, 4, seed=22)
    rows = _frame(spark, words).select("id", C.canonical_key("m").alias("key")).collect()
    by_hand = {k: exact.class_key(exact.word(w)) for k, w in enumerate(words)}
    mine = {r.id: bytes(r.key) for r in rows}
    for i in by_hand:
        for j in by_hand:
            assert (mine[i] == mine[j]) == (by_hand[i] == by_hand[j])


def test_classes_match_the_builtin_form(spark):
    """Arrow keys and built-in keys split the same words into the same classes."""
    words = _random_words(30, 5, seed=23)
    rows = _frame(spark, words).select(
        "id", C.canonical_key("m").alias("key"), C.exhaustive_key("m").alias("full")
    )
    pairs = rows.groupBy("key", "full").count().collect()
    assert len(pairs) == len({bytes(r.key) for r in pairs}) == len({tuple(r.full.columns) + (r.full.k,) for r in pairs})


def test_wide_lanes_give_the_same_keys(spark):
    words = _random_words(30, 9, seed=24)
    base = spark.createDataFrame(list(enumerate(words)), "id long, gates array<tinyint>")
    keys = []
    for lanes in (M.NARROW, M.MEDIUM, M.WIDE):
        rows = with_matrix(base, lanes).select("id", C.canonical_key("m", lanes).alias("key"))
        keys.append({r.id: bytes(r.key) for r in rows.collect()})
    assert keys[0] == keys[1] == keys[2]


def test_one_per_class_keeps_the_least_word(spark):
    words = [[g] for g in range(15)] + [[0, 9], [9, 0], [14, 0]]
    kept = levels.one_per_class(levels.with_key(_frame(spark, words).drop("id"))).collect()
    assert sorted(list(r.gates) for r in kept) == [[0], [0, 9]]
