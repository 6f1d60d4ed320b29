"""Near copies by SimHash probing: planted copies, large groups, and the plan."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringweave.llm import nearcopies
from ringweave.llm.common import stage


def _text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def _keyed(spark, texts):
    return stage(spark.createDataFrame(list(enumerate(texts)), "k bigint, text string").repartition(4), "texts")


def _groups(pairs):
    by = {}
    for key, root in pairs:
        by.setdefault(root, []).append(key)
    return sorted(sorted(g) for g in by.values())


def test_planted_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        base = _text(rng, 300)
        # 6 changed words of 300: 60 shingles of 592 differ at most on either side, so 0.8 alike or a little more.
        texts += [" ".join(base), " ".join(_edited(rng, base, 6)), " ".join(_edited(rng, base, 2))]
        texts.append(" ".join(_edited(rng, base, 40)))
    texts += [None, "", " \n", "one two", "ONE  two", "one three"]
    got = {r.key: r.root for r in nearcopies.near_copies(_keyed(spark, texts), "k").collect()}
    want = brute.shingle_components(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(max(0, i - 3), i)]
    true = [p for p in pairs if want[p[0]] == want[p[1]]]
    assert len(true) > 300
    assert sum(got[i] == got[j] for i, j in true) >= 0.97 * len(true)
    assert not any(got[i] == got[j] for i, j in pairs if want[i] != want[j])


def test_query_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    texts = [r.text for r in rows]
    got = nearcopies.near_copies(_keyed(spark, texts), "k").collect()
    assert _groups(got) == _groups(enumerate(brute.shingle_components(texts)))


def test_a_group_larger_than_a_bucket_becomes_one(spark):
    rng = random.Random(6)
    base = _text(rng, 200)
    texts = [" ".join(_edited(rng, base, 2)) for _ in range(400)] + [" ".join(_text(rng, 200)) for _ in range(50)]
    got = _groups(nearcopies.near_copies(_keyed(spark, texts), "k").collect())
    assert [len(g) for g in got] == [400] + [1] * 50


def test_copies_among_many_that_are_almost_as_near(spark):
    # 400 texts some 0.76 alike crowd the same buckets; pairs of them share half their edits and are 0.81 alike.
    rng = random.Random(8)
    base = _text(rng, 1000)
    texts = []
    for _ in range(200):
        shared = _edited(rng, base, 7)
        texts += [" ".join(_edited(rng, shared, 7)), " ".join(_edited(rng, shared, 7))]
    want = brute.shingle_components(texts)
    got = {r.key: r.root for r in nearcopies.near_copies(_keyed(spark, texts), "k").collect()}
    true = [(i, i + 1) for i in range(0, 400, 2) if want[i] == want[i + 1]]
    assert len(true) > 100 and len(set(want)) > 100
    assert sum(got[i] == got[j] for i, j in true) >= 0.98 * len(true)
    assert len(set(got.values())) >= len(set(want))


def test_parity_bits_never_exceed_the_hashes_apart():
    rng = np.random.default_rng(3)
    for kept in (0, 10, 300):
        one, two, both = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (40, 60, kept))
        bits = nearcopies.parity(np.concatenate([one, both])) ^ nearcopies.parity(np.concatenate([two, both]))
        assert 0 < sum(int(x).bit_count() for x in bits.view(np.uint64)) <= 100


@pytest.mark.parametrize("words", [1, 2, 8, 32])
def test_folded_parity_bits_are_those_of_fewer_words(words):
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 700).astype(np.uint64)
    full = nearcopies.parity(hashes, nearcopies.WIDE_WORDS)
    assert (nearcopies.folded(full[None], words)[0] == nearcopies.parity(hashes, words)).all()


def test_texts_that_meet_are_compared_across_batches_and_lengths(spark):
    rng = np.random.default_rng(9)
    sets = {}
    for length in (5, 60, 90, 200, 500, 1500):  # bits on one word up to many; 60 and 66 lie on either side of some
        base = rng.integers(0, 1 << 63, 3 * length).astype(np.uint64)
        sets |= {len(sets): base[:length], len(sets) + 1: base[length // 10 :][:length], len(sets) + 2: base[2 * length :]}
    rows = [
        (value, k, len(x), nearcopies.folded(nearcopies.parity(x, 64)[None], nearcopies.words_for(len(x), 0.8)).tobytes())
        for value in (7, 8, 9)
        for k, x in sets.items()
        if value < 9 or k == 3  # a bucket of one
    ]
    entries = spark.createDataFrame(rows, "value bigint, vertex bigint, n int, bits binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = [(r.a, r.b) for r in nearcopies._meeting(entries, 0.8).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = {(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) >= 5
    assert len(set(got) - want) <= 2


def test_a_dense_bucket_is_left_to_blocks(spark):
    base = np.random.default_rng(3).integers(0, 1 << 63, 60).astype(np.uint64)
    bits = nearcopies.folded(nearcopies.parity(base, 64)[None], nearcopies.words_for(60, 0.8)).tobytes()
    rows = [(7, k, 60, bits) for k in range(100)] + [(8, k, 60, bits) for k in range(4)]
    got = nearcopies._meeting(spark.createDataFrame(rows, "value bigint, vertex bigint, n int, bits binary"), 0.8).collect()
    assert [(r.value, r.held) for r in got if r.a is None] == [(7, 100)]
    assert sorted((r.a, r.b) for r in got if r.a is not None) == [(i, j) for i in range(4) for j in range(i + 1, 4)]


def test_entries_of_buckets_are_not_kept(spark, monkeypatch):
    rng, kept = random.Random(12), []
    docs = _keyed(spark, [" ".join(_text(rng, 60)) for _ in range(600)])
    monkeypatch.setattr(nearcopies, "stage", lambda df, name: kept.append(stage(df, name)) or kept[-1])
    monkeypatch.setattr(nearcopies, "unstage", lambda *tables: None)
    assert nearcopies.near_copies(docs, "k").select("root").distinct().count() == 600
    assert all(table.count() <= 600 for table in kept)


def test_equal_texts_and_nothing(spark):
    docs = spark.createDataFrame([(i, "the same words again and again") for i in range(500)], "k bigint, text string")
    assert nearcopies.near_copies(stage(docs, "texts"), "k").agg(F.countDistinct("root")).first()[0] == 1
    assert nearcopies.near_copies(stage(docs.where("k < 0"), "texts"), "k").count() == 0


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**10])
def test_plan_uses_every_bit_once(n):
    rng = np.random.default_rng(1)
    plan = nearcopies.learned_plan(rng.integers(-30, 30, (200, nearcopies.BITS)), n, 0.8)
    bits = [b for group, _ in plan for b in group]
    assert plan and len(bits) == len(set(bits)) and all(0 <= t <= nearcopies.MOST_TURNED for _, t in plan)


def test_probes_meet_where_close_bits_differ():
    rng = np.random.default_rng(2)
    cast = rng.integers(-50, 50, (1, nearcopies.BITS)) * 2 + 1
    bits = list(range(20))
    close = np.argsort(np.abs(cast[0, :20]))
    other = cast.copy()
    other[0, close[:3]] *= -1
    plan = [(bits, 3)]
    assert set(nearcopies.probes(cast, plan)[0]) == set(nearcopies.probes(other, plan)[0])
    other[0, close[10]] *= -1
    assert not set(nearcopies.probes(cast, plan)[0]) & set(nearcopies.probes(other, plan)[0])
