import random

import pytest
from pyspark.sql import functions as F

from ringweave.functions import gates as G
from ringweave.functions import matrices as M
from ringweave.functions.bits import pin
from ringweave.operators.products import multiply_long, to_long
from ringweave.operators.words import with_matrix, with_pattern

import exact


def _words(n, length, seed):
    rng = random.Random(seed)
    return [[rng.randrange(15) for _ in range(rng.randint(0, length))] for _ in range(n)]


def _frame(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "id long, gates array<tinyint>")


def _grid(cells):
    out = [[None] * 6 for _ in range(6)]
    for x in cells:
        out[x.row][x.col] = (x.a, x.b, x.e)
    return out


@pytest.mark.parametrize("lanes,length", [(M.NARROW, 9), (M.MEDIUM, 30), (M.WIDE, 60)])
def test_replay_matches_entrywise_arithmetic(spark, lanes, length):
    words = _words(40, length, seed=length)
    rows = with_pattern(with_matrix(_frame(spark, words), lanes), lanes)
    got = rows.select("id", "lde", "int_plane", "sqrt2_plane", M.entries("m", lanes).alias("cells"))
    for r in got.collect():
        m = exact.word(words[r.id])
        assert _grid(r.cells) == m
        assert r.lde == exact.lde(m)
        assert (r.int_plane, r.sqrt2_plane) == exact.planes(m)


def test_gate_eight_times_is_identity_and_rows_stay_orthogonal(spark):
    words = [[g] * 8 for g in range(15)]
    same = with_matrix(_frame(spark, words)).select((F.col("m") == M.identity()).alias("same"))
    assert all(r.same for r in same.collect())
    rows = with_matrix(_frame(spark, _words(20, 7, seed=2)))
    turned = rows.withColumn("t", pin(M.transpose("m"))).select(pin(M.product("m", "t")).alias("p"))
    assert all(r.same for r in turned.select((F.col("p") == M.identity()).alias("same")).collect())


def test_product_is_the_fold_of_the_joined_words(spark):
    left, right = _words(30, 8, seed=4), _words(30, 8, seed=5)
    rows = spark.createDataFrame(
        [(l, r, r + l) for l, r in zip(left, right)],
        "l array<tinyint>, r array<tinyint>, both array<tinyint>",
    )
    rows = rows.select(
        pin(M.apply_word("l")).alias("ml"),
        pin(M.apply_word("r")).alias("mr"),
        pin(M.apply_word("both")).alias("whole"),
        "l",
    )
    got = rows.select(
        (M.product("ml", "mr") == F.col("whole")).alias("product"),
        (M.apply_word("l", start="mr") == F.col("whole")).alias("continued"),
    )
    assert all(r.product and r.continued for r in got.collect())


def test_long_form_product_matches(spark):
    words = [w for w in _words(12, 6, seed=6)]
    m = with_matrix(_frame(spark, words))
    cells = to_long(m, "id")
    got = multiply_long(cells, cells, "id").collect()
    for k, w in enumerate(words):
        square = exact.matmul(exact.word(w), exact.word(w))
        mine = {(r.row, r.col): (r.a, r.b, r.e) for r in got if r.id == k}
        assert mine == {(r, c): square[r][c] for r in range(6) for c in range(6) if square[r][c][0]}


@pytest.mark.parametrize("lanes", [M.NARROW, M.MEDIUM, M.WIDE])
def test_rearrangements(spark, lanes):
    words = _words(10, 7, seed=8)
    order, signs = [2, 0, 1, 5, 3, 4], [1, -1, -1, 1, 1, -1]
    rows = with_matrix(_frame(spark, words), lanes).select(
        "id",
        "m",
        F.array(*map(F.lit, order)).alias("o"),
        F.array(*map(F.lit, signs)).alias("s"),
    )
    changed = {
        "t": M.transpose("m", lanes),
        "r": M.permute_rows("m", "o", lanes),
        "c": M.permute_columns("m", "o", lanes),
        "n": M.negate_row("m", "3", lanes),
        "s2": M.apply_signs("m", "s", "s", lanes),
    }
    staged = rows.select("id", *[pin(v).alias(k) for k, v in changed.items()])
    for r in staged.select("id", *[M.entries(k, lanes).alias(k) for k in changed]).collect():
        m = exact.word(words[r.id])
        assert _grid(r.t) == exact.transpose(m)
        assert _grid(r.r) == [m[order[i]] for i in range(6)]
        assert _grid(r.c) == [[m[i][order[j]] for j in range(6)] for i in range(6)]
        assert _grid(r.n) == [[exact.neg(x) if i == 3 else x for x in m[i]] for i in range(6)]
        assert _grid(r.s2) == [
            [m[i][j] if signs[i] == signs[j] else exact.neg(m[i][j]) for j in range(6)] for i in range(6)
        ]


def test_matrix_from_pattern_has_that_pattern(spark):
    rng = random.Random(9)
    rows = [(rng.getrandbits(36) | 1, rng.getrandbits(36)) for _ in range(20)] + [(0, 5), (0, 0)]
    df = spark.createDataFrame(rows, "i long, s long").select(
        "i", "s", pin(M.from_planes("i", "s")).alias("m")
    )
    for r in df.select("i", "s", "m", M.int_plane("m").alias("i2"), M.sqrt2_plane("m").alias("s2")).collect():
        if r.i:
            assert (r.i2, r.s2, r.m.k) == (r.i, r.s, 1)
        else:
            assert (r.i2, r.s2, r.m.k) == (r.s, 0, 0)


def test_bad_gates_and_overlong_words_fail(spark):
    for word, message in (([0, 15], "outside 0..14"), ([0] * 18, "too long for its lanes")):
        with pytest.raises(Exception, match=message):
            with_matrix(_frame(spark, [word])).collect()
    assert M.lanes_for(17) == M.NARROW and M.lanes_for(18) == M.MEDIUM and M.lanes_for(38) == M.WIDE


def test_text_of_the_identity(spark):
    text = with_matrix(_frame(spark, [[]])).select(M.text("m")).first()[0]
    assert text.split("\n")[1] == "0,0e0 1,0e0 0,0e0 0,0e0 0,0e0 0,0e0"


def test_word_texts_and_packing(spark):
    words = _words(30, 9, seed=10) + [[], [14], [0, 14], [10, 0, 10]]
    df = _frame(spark, words).select(
        "id",
        G.word_text(F.col("gates")).alias("t"),
        G.pack_word(F.col("gates")).alias("p"),
    )
    df = df.select(
        "*", G.parse_word(F.col("t")).alias("a"), G.unpack_word(F.col("p")).alias("b")
    )
    for r in df.collect():
        w = words[r.id]
        assert r.t == " ".join(map(str, w))
        codes = [g + 1 for g in w] + [0] * (len(w) % 2)
        assert bytes(r.p) == bytes(x | y << 4 for x, y in zip(codes[::2], codes[1::2]))
        assert list(r.a) == list(r.b) == w


def test_catalog(spark):
    rows = [tuple(r) for r in G.gate_catalog(spark).orderBy("gate").collect()]
    assert rows == [(g, p, q) for g, (p, q) in enumerate(exact.PAIRS)]
